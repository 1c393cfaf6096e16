"""Rules that make a question ambiguous, and checks that it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed

LEVELS = {"easy": 0, "medium": 1, "hard": 2}


def templates(spark: SparkSession) -> DataFrame:
    """The fourteen templates."""
    return spark.createDataFrame(fixed.AMBIGUITY_TEMPLATES, "template string, ambiguity_type string, target_paths array<string>, interface string, difficulty string")


def valid_templates(specs: DataFrame, key: str, spec: str) -> DataFrame:
    """key and template, a row for each that the specification allows."""
    c = F.col(spec)
    get = lambda p: F.get_json_object(c, p)
    channels = F.from_json(get("$.encoding"), "map<string,string>")
    steps = F.from_json(get("$.transform"), "array<map<string,string>>")
    any_step = lambda *ks: F.exists(steps, lambda s: F.array_contains(F.map_keys(s), ks[0]) | F.array_contains(F.map_keys(s), ks[-1]))
    any_channel = lambda k: F.exists(F.map_values(channels), lambda v: F.coalesce(F.get_json_object(v, f"$.{k}"), F.lit("false")) != "false")
    mark = F.get_json_object(c, "$.mark")
    kind = F.when(F.substring(mark, 1, 1) == "{", get("$.mark.type")).otherwise(mark)
    has = lambda p: get(p).isNotNull()
    rules = {
        "aggregation_missing": has("$.encoding.y.aggregate"),
        "time_granularity_missing": has("$.encoding.x.timeUnit") | (get("$.encoding.x.type") == "temporal"),
        "topk_missing": any_step("filter", "window"),
        "filter_scope_missing": any_step("filter"),
        "chart_type_missing": F.lit(True),
        "encoding_channel_missing": has("$.encoding.color") | has("$.encoding.size") | has("$.encoding.shape"),
        "axis_assignment_missing": has("$.encoding.x") & has("$.encoding.y"),
        "bucket_definition_needed": any_channel("bin"),
        "grouping_dimension_missing": kind == "arc",
        "comparison_baseline_missing": any_step("calculate"),
        "data_range_mismatch": F.lit(True),
        "vis_data_incompatible": F.lit(True),
        "field_name_error": any_channel("field"),
        "aggregation_conflict": has("$.encoding.y.field") | has("$.encoding.y.aggregate"),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items())))
    return specs.select(key, F.explode(found).alias("template"))


def template_weights(valid: DataFrame, key: str, usage: DataFrame, prefer: list[str], avoid: list[str], strength: float, seed: int | None = 0) -> DataFrame:
    """Adds a weight to each template: less the more it was used, more if preferred, much less if avoided; a jitter of up
    to 0.1 comes from a hash (none without a seed). With a strength over 0.5, or under ten valid ones, avoided ones go."""
    joined = valid.join(usage.withColumnRenamed("n", "used"), "template", "left")
    preferred = F.col("template").isin(*prefer) if prefer else F.lit(False)
    avoided = F.col("template").isin(*avoid) if avoid else F.lit(False)
    weight = 1 / (F.coalesce("used", F.lit(0)) + 1.0) * F.when(preferred, 1 + 1.5 * strength).otherwise(1.0) * F.when(avoided, max(0.01, 1 - 0.9 * strength)).otherwise(1.0)
    jitter = F.lit(0.0) if seed is None else F.pmod(F.xxhash64(key, "template", F.lit(seed)), F.lit(1 << 20)) / float(10 * (1 << 20))
    size = F.count(F.lit(1)).over(Window.partitionBy(key))
    left = F.count_if(~avoided).over(Window.partitionBy(key))
    strict = (F.lit(strength > 0.5) | (size < 10)) & (left > 0)
    return joined.withColumns({"weight": weight + jitter, "__drop": avoided & strict}).where(~F.col("__drop")).select(key, "template", "weight")


def weighted_pick(weights: DataFrame, key: str, k: int = 3, seed: int = 0) -> DataFrame:
    """k of each key without replacement, with chances by weight: the k least exponential draws."""
    u = (F.pmod(F.xxhash64(key, "template", F.lit(seed), F.lit("pick")), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    order = F.row_number().over(Window.partitionBy(key).orderBy(-F.log(u) / F.col("weight"), "template"))
    return weights.withColumn("place", order).where(F.col("place") <= k)


def ambiguity_profile(picked: DataFrame, key: str, literal: bool = False) -> DataFrame:
    """By key: types, target paths and interfaces of the templates, and their greatest difficulty: easy < medium < hard,
    or by the letters of the words if literal."""
    all_of = picked.join(F.broadcast(templates(picked.sparkSession)), "template")
    level = F.col("difficulty") if literal else F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv))[F.col("difficulty")].cast("string")
    return all_of.groupBy(key).agg(
        F.array_sort(F.collect_set("ambiguity_type")).alias("ambiguity_types"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("target_paths")))).alias("target_paths"),
        F.array_sort(F.collect_set("interface")).alias("interfaces"), F.max_by("difficulty", level).alias("difficulty"),
    )


def plan_ambiguity(intent: Column, paths: Column) -> dict[str, Column]:
    """Type by the intent; at most two paths; interface and difficulty follow."""
    kind = F.when(intent.isin("trend", "distribution"), "data_ambiguity").when(intent.isin("comparison", "ranking"), "visualization_ambiguity").otherwise("info_completion")
    some = F.slice(paths, 1, 2)
    return {"ambiguity_type": kind, "target_paths": some, "interface": F.when(kind == "visualization_ambiguity", "vis").otherwise("text"), "difficulty": F.when(F.size(some) > 1, "medium").otherwise("easy")}


def injection_guidance(profiles: DataFrame, key: str) -> DataFrame:
    """Templates of a profile's types whose target paths meet the profile's."""
    t = templates(profiles.sparkSession).withColumnRenamed("target_paths", "paths")
    joined = profiles.join(F.broadcast(t), F.array_contains("ambiguity_types", F.col("ambiguity_type")) & F.arrays_overlap("target_paths", "paths"))
    return joined.groupBy(key).agg(F.array_sort(F.collect_list("template")).alias("templates"))


def ambiguity_issues(question: Column, types: Column, paths: Column, entities: Column | None = None) -> Column:
    """Issues of a question: too explicit, too short, too many open points, entities lost."""
    q = F.lower(question)
    has = lambda t: F.array_contains(types, t)
    among = lambda word: F.exists(paths, lambda p: F.lower(p).contains(word.lower()))
    open_ = {word: among(word) for word in ("aggregate", "timeUnit", "topk")}
    weak = [F.when(has("data_ambiguity") & q.contains(term) & open_[word], F.lit(f"Ambiguity too weak: '{term}' explicitly mentioned")) for term, word in fixed.EXPLICIT_TERMS]
    weak += [F.when(has("visualization_ambiguity") & q.contains(term), F.lit(f"Ambiguity too weak: chart type '{term}' explicit")) for term in fixed.CHART_TERMS]
    words = F.size(F.filter(F.split(F.trim(question), r"\s+"), lambda w: w != ""))
    strong = [F.when((words < 5) & (F.length(question) < 15), F.lit("Ambiguity too strong: question too short")), F.when(F.size(paths) > 3, F.lit("Ambiguity too strong: too many ambiguous points"))]
    issues = F.array_compact(F.array(*weak, *strong))
    if entities is None:
        return issues
    lost = F.filter(F.transform(entities, F.lower), lambda e: (F.length(e) > 3) & ~F.exists(F.split(e, r"\s+"), lambda w: q.contains(w)))
    return F.concat(issues, F.transform(lost, lambda e: F.concat(F.lit("Semantic drift: entity '"), e, F.lit("' missing"))))


def relevant_feature_types(question: Column) -> Column:
    """Feature types one of whose keywords a question holds, sorted."""
    q = F.lower(question)
    found = []
    for kind, words in sorted(fixed.TYPE_KEYWORDS.items()):
        test = q.contains(words[0])
        for w in words[1:]:
            test = test | q.contains(w)
        found.append(F.when(test, F.lit(kind)))
    return F.array_compact(F.array(*found))
