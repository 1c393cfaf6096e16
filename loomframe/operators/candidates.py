"""Chart candidates: reading them, what they map, and choosing a diverse few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.scratch import state_path
from .chartops import agg_alias

#: What counts in the distance of two candidates.
WEIGHTS = {"category": 2.0, "type": 1.0, "dims": 1.5, "measures": 1.0, "tables": 1.5, "aggregation": 1.0, "intent": 1.0, "features": 2.0, "complexity": 0.5}
INTENTS = ["comparison", "trend", "distribution", "composition", "correlation", "ranking"]


def chart_catalog(spark: SparkSession, folder: str, suffix: str = "json") -> DataFrame:
    """category (folder) and chart_type (file stem) of the examples in a folder; names that begin with _ are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(folder)
    parts = files.select(F.regexp_extract("path", rf"([^/]+)/([^/]+)\.{suffix}$", 1).alias("category"), F.regexp_extract("path", rf"([^/]+)/([^/]+)\.{suffix}$", 2).alias("chart_type"))
    return parts.where(~F.col("chart_type").startswith("_") & (F.col("chart_type") != ""))


def list_charts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("chart_type")), ",").alias("chart_types"))


def _field(c: Column) -> Column:
    return F.nullif(F.trim(F.element_at(F.split(c, r"\("), 1)), F.lit(""))


def _text_at(mapping: Column, path: str, read: Column | None) -> Column:
    """What get_json_object gives; read: the mapping as a variant in a column of its own, so that it is read once for all
    paths. A value that may be no string in the JSON (it begins like a number, an object or an array) is read again as it
    is written, and so is a mapping that isn't read whole."""
    if read is None:
        return F.get_json_object(mapping, path)
    value = F.try_variant_get(read, path, "string")
    return F.when(read.isNull() | value.rlike(r"^[-0-9\[{]"), F.get_json_object(mapping, path)).otherwise(value)


def mapping_dimensions(mapping: Column, read: Column | None = None) -> Column:
    """Fields on x, color, row, column and facet of the primary encodings, then the facet's field."""
    get = lambda k: _field(_text_at(mapping, k, read))
    return F.array_distinct(F.array_compact(F.array(*(get(f"$.primary_encodings.{k}") for k in ("x", "color", "row", "column", "facet")), get("$.facet.field"))))


def mapping_measures(mapping: Column, read: Column | None = None) -> Column:
    get = lambda k: _field(_text_at(mapping, k, read))
    return F.array_distinct(F.array_compact(F.array(get("$.primary_encodings.y"), get("$.secondary_encodings.y"), get("$.primary_encodings.size"))))


def feature_type_set(features: Column) -> Column:
    """Names before a colon, lower-cased; entries without one are left out."""
    return F.array_distinct(F.transform(F.filter(features, lambda f: f.contains(":")), lambda f: F.lower(F.trim(F.element_at(F.split(f, ":"), 1)))))


def mapping_complexity(mapping: Column) -> Column:
    """Two for secondary encodings, one a layer, two for a facet, one a primary encoding."""
    has = lambda k: F.get_json_object(mapping, k).isNotNull()
    n = lambda c: F.coalesce(c, F.lit(0))
    return (
        F.when(has("$.secondary_encodings"), 2).otherwise(0) + n(F.json_array_length(F.get_json_object(mapping, "$.layers"))) + F.when(has("$.facet"), 2).otherwise(0)
        + n(F.size(F.json_object_keys(F.get_json_object(mapping, "$.primary_encodings"))))
    )


def chart_type_mark(chart_type: Column) -> Column:
    c = F.lower(chart_type)
    # Words of a chart type, and its mark; first wins.
    rules = [(("bar",), "bar"), (("line",), "line"), (("scatter", "point"), "point"), (("area",), "area"), (("pie", "arc"), "arc"), (("histogram",), "bar"), (("box",), "boxplot"), (("heatmap",), "rect")]
    return F.coalesce(*(F.when(c.rlike("|".join(words)), F.lit(mark)) for words, mark in rules), F.lit("bar"))


def candidate_features(candidates: DataFrame, key: list[str], contracts: DataFrame | None = None) -> DataFrame:
    """key, path, op, value that a candidate asks for; its contract's demands on other paths are added."""
    f = lambda path, op, value: F.struct(F.lit(path).alias("path"), F.lit(op).alias("op"), value.alias("value"))
    dim = F.try_element_at("dimensions", F.lit(1))
    second, measure = F.try_element_at("dimensions", F.lit(2)), F.try_element_at("measures", F.lit(1))
    rows = F.array(
        f("mark.type", "eq", chart_type_mark(F.col("chart_type"))), F.when(dim.isNotNull(), f("encoding.x.field", "eq", dim)), F.when(measure.isNotNull(), f("encoding.y.field", "eq", measure)),
        F.when(F.col("aggregation").isNotNull(), f("encoding.y.aggregate", "eq", F.lower("aggregation"))), F.when(measure.isNotNull(), f("encoding.y.type", "eq", F.lit("quantitative"))), F.when(second.isNotNull(), f("encoding.color.field", "eq", second)),
    )
    own = candidates.select(*key, F.explode(F.array_compact(rows)).alias("f")).select(*key, "f.path", "f.op", "f.value")
    if contracts is None:
        return own
    more = candidates.select(*key, "chart_type").join(contracts, "chart_type").select(*key, "path", "op", "value").join(own.select(*key, "path"), [*key, "path"], "left_anti")
    return own.union(more)


def valid_candidates(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    return candidates.join(catalog.select("chart_type").distinct(), "chart_type", "left_semi")


def _set(c: Column) -> Column:
    return F.when(F.size(c) == 1, F.array(F.lower(c[0]))).otherwise(F.array_distinct(F.transform(c, F.lower)))


def _jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeated elements; equal ones, and two of one element each, need no sets."""
    both = F.size(F.array_intersect(a, b))
    return F.when(a == b, 0.0).when((F.size(a) == 1) & (F.size(b) == 1), 1.0).otherwise(1 - both / (F.size(a) + F.size(b) - both))


def distance(a, b, lowered: bool = False) -> Column:
    """The distance of two candidates, given as functions from a column's name to the column; lowered: both are as
    lowered_columns makes them."""
    low, sets = (F.lower, _set) if not lowered else (lambda c: c, lambda c: c)
    differs = lambda c: (~low(a(c)).eqNullSafe(low(b(c)))).cast("double")
    apart = lambda c: _jaccard(sets(a(c)), sets(b(c)))
    w = WEIGHTS
    return (
        w["category"] * differs("chart_category") + w["type"] * differs("chart_type") + w["dims"] * apart("dimensions") + w["measures"] * apart("measures")
        + w["tables"] * apart("tables_needed") + w["aggregation"] * differs("aggregation") + w["intent"] * differs("vis_intent_type")
        + w["features"] * apart("feature_types") + w["complexity"] * F.abs(a("complexity") - b("complexity"))
    )


def lowered_columns() -> list[Column]:
    """What the distance looks at, in lower case and without repeated elements, for candidates that are compared many times."""
    sets = ("dimensions", "measures", "tables_needed", "feature_types")
    return [(_set(F.col(c)) if c in sets else F.col(c) if c == "complexity" else F.lower(c)).alias(c) for c in COMPARED]


def candidate_distance(candidates: DataFrame, key: str = "question_id") -> DataFrame:
    """key, pos_a < pos_b and distance of the candidates of a question."""
    a, b = candidates.alias("a"), candidates.alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.pos") < F.col("b.pos")))
    return pairs.select(F.col(f"a.{key}").alias(key), F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), distance(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")).alias("distance"))


#: What the distance of two candidates looks at.
COMPARED = ["chart_category", "chart_type", "dimensions", "measures", "tables_needed", "aggregation", "vis_intent_type", "feature_types", "complexity"]


def diverse_picks(candidates: DataFrame, n: int, key: str = "question_id") -> DataFrame:
    """key, pos, taken and diversity_score of up to n candidates of each question: the first, then again and again the one
    farthest from those taken; ties go to the earliest. diversity_score is the distance at which one was taken (0 for the
    first, and where all are kept).

    Each round holds the few that a question has taken against all its candidates, so that it costs n distances a
    candidate and no pairs; the farthest is found by an aggregate that starts before the shuffle. What has been taken is
    written below the checkpoint folder after each round."""
    me = F.struct("pos", *COMPARED)
    zero = F.lit(0.0)
    # what makes the candidates is computed once, and not again in every round, nor are their letters lowered again
    candidates = _stored(candidates.select(key, "pos", *lowered_columns()), "candidates")
    taken = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("size"), F.min_by(me, "pos").alias("c")).select(key, "size", F.array(F.struct("c", zero.alias("score"))).alias("taken"))
    for _ in range(1, n):
        taken = _stored(taken, "taken")
        near = F.array_min(F.transform("taken", lambda t: distance(lambda c: t["c"][c], F.col, lowered=True)))
        rest = candidates.join(taken, key).where(~F.exists("taken", lambda t: t["c"]["pos"] == F.col("pos")))
        best = rest.select(key, near.alias("near"), me.alias("c")).groupBy(key).agg(F.max_by(F.struct("c", F.col("near").alias("score")), F.struct("near", -F.col("c.pos"))).alias("next"))
        taken = taken.join(best, key, "left").select(key, "size", F.when(F.col("next").isNull(), F.col("taken")).otherwise(F.concat("taken", F.array("next"))).alias("taken"))
    rows = taken.select(key, "size", F.posexplode("taken").alias("taken", "t"))
    return rows.select(key, F.col("t.c.pos").alias("pos"), "taken", F.when(F.col("size") > n, F.col("t.score")).otherwise(zero).alias("diversity_score"))


def select_diverse(candidates: DataFrame, n: int, key: str = "question_id") -> DataFrame:
    """The candidates that diverse_picks takes, with taken and diversity_score."""
    candidates = _stored(candidates, "candidates")
    return candidates.join(diverse_picks(candidates, n, key), [key, "pos"])


def _tokens() -> Column:
    """What two candidates with lowered columns may share: a type, a dimension, a measure; none of these is a token of its own."""
    of = lambda c, kind: F.transform(F.when(F.size(c) > 0, c).otherwise(F.array(F.lit(None).cast("string"))), lambda x: F.concat(F.lit(kind), F.coalesce(F.concat(F.lit("="), x), F.lit(""))))
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(of(F.array("chart_type"), "t"), of(some("dimensions"), "d"), of(some("measures"), "m")))


#: Questions of at most so many candidates are compared whole, each candidate with all others.
FEW = 32


def nearest_candidates(candidates: DataFrame, k: int, key: str = "question_id", few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """(key, pos, place from 1 on, other and distance of the k nearest candidates of the same question, of equals the first;
    stage and pairs looked at).

    In a question of at most few candidates each is held against all others, where the question's rows meet: one shuffle,
    nothing written, at most few distances a candidate. Larger questions go by classes and bounds (_nearest_by_bounds). Sizes are
    counted first, from the key alone. All pairs of small questions are looked at; they count as stage rest.

    Cases: a question of fewer candidates gives fewer; nulls are equal to nulls; an empty table gives empty results."""
    rows = candidates.where(F.col(key).isNotNull()).select(key, "pos", *lowered_columns())
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"))
    pairs = sizes.where(F.col("n") <= few).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0)).alias("pairs"))
    looked = pairs.select(F.inline(F.array(*(F.struct(F.lit(s).alias("stage"), (F.col("pairs") if s == "rest" else F.lit(0)).cast("long").alias("pairs")) for s in ("category", "token", "rest")))))
    large = _stored(sizes.where(F.col("n") > few).select(key), "large")
    if large.isEmpty():
        return _nearest_of_few(rows, k, key), looked
    near, more = _nearest_by_bounds(rows.join(_shuffled(large), key, "left_semi"), k, key)
    near = _nearest_of_few(rows.join(_shuffled(large), key, "left_anti"), k, key).union(near)
    return near, looked.union(more).groupBy("stage").agg(F.sum("pairs").alias("pairs"))


def _nearest_of_few(rows: DataFrame, k: int, key: str) -> DataFrame:
    """nearest_candidates for questions that fit in a row; rows have the lowered columns. A window by the key alone needs no
    shuffle or order besides those of rows that are dealt by the key already."""
    me, x = F.col("me"), F.col("x")
    met = rows.select(key, F.struct("pos", F.struct(*COMPARED).alias("c")).alias("me")).withColumn("all", F.collect_list("me").over(Window.partitionBy(key)))
    pairs = met.select(key, "me", F.explode("all").alias("x")).where(me["pos"] != x["pos"])
    apart = F.when(me["c"].eqNullSafe(x["c"]), 0.0).otherwise(distance(lambda c: me["c"][c], lambda c: x["c"][c], lowered=True))
    found = pairs.select(key, me["pos"].alias("pos"), apart.alias("distance"), x["pos"].alias("other"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy(key, "pos").orderBy("distance", "other"))).where(F.col("place") <= k).select(key, "pos", "place", "other", "distance")


def _nearest_by_bounds(rows: DataFrame, k: int, key: str) -> tuple[DataFrame, DataFrame]:
    """nearest_candidates for questions of any size; rows have the lowered columns.

    Candidates that are compared alike are one class, with its first k + 1 members. Classes are looked at in three steps, each
    only for those that the bounds leave open: classes of the same category; others that share a type, a dimension or a
    measure by an inverted index; all others. A pair of different categories is at least the category's weight apart, and one
    that shares no token the weights of type, dimensions and measures more, so that what lies nearer is final. Pairs are
    not written: the best of a step are taken from its join, and counting the pairs looked at runs the join again."""
    rows = _stored(rows, "compared")
    heads = rows.groupBy(key, *COMPARED).agg(F.min("pos").alias("cid"))
    own = heads.select(F.col(key).alias("__k"), F.col("cid"), *(F.col(c).alias(f"__{c}") for c in COMPARED))
    same = F.col(key) == F.col("__k")
    for c in COMPARED:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    members = _stored(rows.join(_shuffled(own), same).select(key, "pos", "cid"), "members")
    first = members.withColumn("r", F.row_number().over(Window.partitionBy(key, "cid").orderBy("pos"))).where(F.col("r") <= k + 1)
    first = first.groupBy(key, "cid").agg(F.array_sort(F.collect_list("pos")).alias("some"))
    wanted = members.groupBy(key).agg(F.least(F.count("*"), F.lit(k + 1)).alias("wanted"))
    classes = _stored(heads.join(_shuffled(first), [key, "cid"]).join(_shuffled(wanted), key), "classes")
    a = lambda df, *more: df.select(key, *(F.col(c).alias(f"a_{c}") for c in ("cid", *COMPARED)), *more)
    b = lambda df, *more: df.select(F.col(key).alias("b_key"), *(F.col(c).alias(f"b_{c}") for c in ("cid", "some", *COMPARED)), *more)
    apart = distance(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"), lowered=True)
    category = F.col("a_chart_category").eqNullSafe(F.col("b_chart_category"))
    in_question = (F.col(key) == F.col("b_key")) & (F.col("a_cid") != F.col("b_cid"))
    found = lambda pairs: pairs.select(key, F.col("a_cid").alias("cid"), apart.alias("distance"), F.explode("b_some").alias("other"))
    alone = classes.select(key, "cid", F.lit(0.0).alias("distance"), F.explode("some").alias("other"))

    def best(found_rows: DataFrame, name: str) -> DataFrame:
        r = F.row_number().over(Window.partitionBy(key, "cid").orderBy("distance", "other"))
        top = found_rows.withColumn("r", r).where(F.col("r") <= k + 1).groupBy(key, "cid").agg(F.array_sort(F.collect_list(F.struct("distance", "other"))).alias("best"))
        return _stored(top, name)

    def open_classes(top: DataFrame, bound: float) -> DataFrame:
        far = F.coalesce(F.element_at("best", -1)["distance"], F.lit(0.0)) >= bound - 1e-9
        return classes.join(_shuffled(top), [key, "cid"]).where((F.size("best") < F.col("wanted")) | far).select(classes.columns)

    def kept(top: DataFrame) -> DataFrame:
        return top.select(key, "cid", F.inline("best"))

    one = a(classes).join(_shuffled(b(classes)), in_question & category)
    top = best(alone.union(found(one)), "best-category")
    left = _stored(open_classes(top, WEIGHTS["category"]), "open-category")
    # rows of classes meet at each token; a pair that shares several is looked at where the first of them is, and isn't dealt again
    by_token = lambda df, side, name: side(df, _tokens().alias(f"{name}_tokens")).withColumn(f"{name}_token", F.explode(f"{name}_tokens"))
    first_shared = F.get(F.array_intersect("a_tokens", "b_tokens"), F.lit(0)) == F.col("a_token")
    two = by_token(left, a, "a").join(_shuffled(by_token(classes, b, "b")), in_question & (F.col("a_token") == F.col("b_token")) & ~category & first_shared)
    top2 = best(kept(top).union(found(two)), "best-token")
    last = _stored(open_classes(top2, sum(WEIGHTS[w] for w in ("category", "type", "dims", "measures"))), "open-token")
    three = a(last).join(_shuffled(b(classes)), in_question)
    final = best(kept(top2.join(_shuffled(last.select(key, "cid")), [key, "cid"], "left_anti")).union(alone.join(_shuffled(last.select(key, "cid")), [key, "cid"], "left_semi")).union(found(three)), "best")
    near = members.join(_shuffled(final), [key, "cid"]).select(key, "pos", F.posexplode(F.slice(F.filter("best", lambda x: x["other"] != F.col("pos")), 1, k)).alias("place", "n"))
    looked = [df.agg(F.count("*").alias("pairs")).select(F.lit(stage).alias("stage"), "pairs") for stage, df in (("category", one), ("token", two), ("rest", three))]
    return near.select(key, "pos", (F.col("place") + 1).alias("place"), F.col("n.other").alias("other"), F.col("n.distance").alias("distance")), looked[0].union(looked[1]).union(looked[2])


def _shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that isn't sent to all tasks: written tables of candidates look small to the optimizer, but unpacked
    they grow with the candidates, and a broadcast passes them whole through the driver."""
    return df.hint("merge")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = state_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_avoided(candidates: DataFrame, avoid: list[str], n: int, key: str = "question_id") -> DataFrame:
    """Up to n candidates, avoided chart types only to fill up."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.col("chart_type").isin(*avoid), "pos"))
    return candidates.withColumn("__k", k).where(F.col("__k") <= n).drop("__k")


def assign_candidate_ids(candidates: DataFrame, existing: DataFrame | None = None, key: str = "question_id") -> DataFrame:
    """q{question}_c{i}, from after the greatest i that the question has already."""
    k = F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1
    if existing is not None:
        last = existing.groupBy(F.col("source_question_id").alias("__q")).agg(F.max(F.regexp_extract("sample_id", "_c([0-9]+)$", 1).try_cast("long")).alias("__last"))
        candidates = candidates.join(last, F.col(key) == F.col("__q"), "left").drop("__q")
        k = k + F.coalesce(F.col("__last") + 1, F.lit(0))
    out = candidates.withColumn("candidate_id", F.concat(F.lit("q"), F.col(key).cast("string"), F.lit("_c"), k.cast("string")))
    return out.drop("__last")


def dedupe_similar(types: DataFrame, order: str = "pos", key: list[str] | None = None) -> DataFrame:
    """One chart type of each group of similar ones, the first."""
    group = F.coalesce(*(F.when(F.col("chart_type").isin(*g), F.lit(f"group {i}")) for i, g in enumerate(fixed.SIMILAR_TYPES)), F.concat(F.lit("type "), F.col("chart_type")))
    w = Window.partitionBy(*(key or []), "__g").orderBy(order)
    return types.withColumn("__g", group).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__g", "__k")


def sample_chart_types(catalog: DataFrame, preferred: list[str], preferred_categories: list[str], k: int = 5, seed: int = 0) -> DataFrame:
    """Up to k chart types: half from the preferred ones, one of each preferred category, the rest from all, in an order
    drawn by a hash; then one of each group of similar types."""
    drawn = catalog.withColumn("draw", F.xxhash64("chart_type", F.lit(seed)))
    by = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("draw", "chart_type"))
    wanted = F.col("chart_type").isin(*preferred) if preferred else F.lit(False)
    in_category = F.col("category").isin(*preferred_categories) if preferred_categories else F.lit(False)
    staged = drawn.withColumn("wanted", wanted).withColumn("place", by("wanted")).withColumn("in_category", by("category"))
    stage = F.when(F.col("wanted") & (F.col("place") <= k // 2), 0).when(in_category & (F.col("in_category") == 1), 1).otherwise(2)
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("stage", "draw", "chart_type"))  # over the catalogue, a bounded list
    ranked = dedupe_similar(staged.withColumn("stage", stage).withColumn("pos", order))
    return ranked.orderBy("pos").limit(k).select("category", "chart_type", "pos")


def fallback_candidates(questions: DataFrame, n: int) -> DataFrame:
    """Five fixed charts with the first dimension and measure of each question; category and value where it has none."""
    rows = [(i, *c) for i, c in enumerate(fixed.FALLBACK_CHARTS[:n])]
    configs = questions.sparkSession.createDataFrame(rows, "pos int, chart_type string, chart_category string, vis_intent_type string, aggregation string")
    first = lambda c, d: F.array(F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(d)))
    both = questions.select("question_id", first("dimensions", "category").alias("dimensions"), first("measures", "value").alias("measures")).crossJoin(F.broadcast(configs))
    return both.withColumn("candidate_id", F.concat(F.lit("q"), F.col("question_id").cast("string"), F.lit("_c"), F.col("pos").cast("string")))


def injectable_paths(dimensions: Column, chart_type: Column) -> Column:
    """Paths that a question can leave open."""
    dated = F.exists(dimensions, lambda d: F.lower(d).rlike("date|time"))
    return F.array_compact(F.array(
        F.lit("encoding.y.aggregate"), F.when(dated, F.lit("encoding.x.timeUnit")), F.when(F.size(dimensions) > 1, F.lit("encoding.color.field")), F.lit("encoding.x.sort"), F.lit("encoding.y.sort"),
        F.when(F.lower(chart_type).rlike("bar|line|area"), F.lit("mark.type")),
    ))


def has_advanced_effects(features: Column, mapping: Column) -> Column:
    more = F.coalesce(F.size(F.json_object_keys(mapping)) > 1, F.lit(False))
    special = F.get_json_object(mapping, "$.secondary_encodings").isNotNull() | F.get_json_object(mapping, "$.layers").isNotNull() | F.get_json_object(mapping, "$.facet").isNotNull()
    return (F.size(features) > 0) | more | special


def parse_candidates(df: DataFrame, key: str, json: str) -> DataFrame:
    """Candidates of a JSON answer; rows that can't be read are left out."""
    rows = df.select(key, F.posexplode(F.from_json(F.get_json_object(json, "$.candidates"), "array<map<string,string>>")).alias("pos", "c")).where("c is not null")
    g = lambda k: F.try_element_at("c", F.lit(k))
    tables = F.when(F.substring(g("tables_needed"), 1, 1) == "[", F.from_json(g("tables_needed"), "array<string>")).otherwise(F.transform(F.split(F.coalesce(g("tables_needed"), F.lit("")), ","), lambda x: F.trim(x)))
    mapping, read = g("data_mapping"), F.col("read")
    return rows.withColumn("read", F.try_parse_json(mapping)).select(
        key, "pos", F.coalesce(g("chart_type"), F.lit("simple_bar_chart")).alias("chart_type"), F.coalesce(g("chart_category"), F.lit("Simple Charts")).alias("chart_category"),
        F.when(g("vis_intent_type").isin(*INTENTS), g("vis_intent_type")).otherwise("comparison").alias("vis_intent_type"), F.filter(tables, lambda x: x != "").alias("tables_needed"),
        agg_alias(F.coalesce(g("aggregation"), F.lit(""))).alias("aggregation"), mapping_dimensions(mapping, read).alias("dimensions"), mapping_measures(mapping, read).alias("measures"), mapping.alias("data_mapping"),
    )


def parse_required_features(df: DataFrame, key: str, json: str) -> DataFrame:
    """Required features of a JSON answer: known types only (else mark), ids and must by default, no blank text."""
    rows = df.select(key, F.posexplode(F.from_json(F.get_json_object(json, "$.required_key_features"), "array<map<string,string>>")).alias("pos", "f"))
    g = lambda k: F.try_element_at("f", F.lit(k))
    kind = F.lower(g("type"))
    known = ["mark", "encoding", "aggregation", "filter", "composition", "interaction", "overlay_stat_line"]
    return rows.where(F.trim(F.coalesce(g("text"), F.lit(""))) != "").select(
        key, "pos", F.coalesce(g("id"), F.concat(F.lit("kf_"), F.col("pos").cast("string"))).alias("id"), F.when(kind.isin(*known), kind).otherwise("mark").alias("type"), g("text").alias("text"), F.coalesce(g("must").cast("boolean"), F.lit(True)).alias("must")
    )
