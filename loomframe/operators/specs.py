"""Chart specifications as data: their paths, features, constraints and contracts.

A specification stays a JSON string. Values at paths are read in place, whether the path is known when the query is
written or is data; flattening gives all paths as rows of (path, value, kind, length).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.scratch import state_path

#: Levels of nesting that are flattened in one job; deeper ones take further jobs.
DEPTH = 7
CHANNELS = ("x", "y", "color", "size")


def json_path(spec: Column, path: str) -> Column:
    """The text at a dotted path; a number is an index, a star the first element."""
    steps = "".join(f"[{p}]" if p.isdigit() else "[0]" if p == "*" else f"['{p}']" for p in path.replace("[", ".").replace("]", "").split("."))
    return F.get_json_object(spec, f"${steps}")


def flatten_spec(specs: DataFrame, key: str, spec: str, depth: int = DEPTH) -> DataFrame:
    """key, path, value (JSON text, or a text as it is), kind and length of every node below the root, however deep.

    A specification is parsed once, as a variant; opening a node gives its children as variants, with no text in between. Each
    step opens the nodes that the step before found and passes all others on, so that depth steps are one pass over the rows.
    Then they are written, and those that are still to be opened go through further steps.
    Cases: a text that isn't JSON, or has an object with a key twice, has no nodes. A null value is a scalar of no length."""
    rows, found = specs.select(key, F.lit("").alias("path"), F.try_parse_json(spec).alias("node"), F.lit(0).alias("level"), F.lit(True).alias("open")), None
    while True:
        for _ in range(depth):
            rows = _opened(rows, key)
        rows = _written(rows)
        done = rows.where("not open and level > 0")
        found = done if found is None else found.union(done)
        rows = rows.where("open")
        if rows.isEmpty():
            break
    text, items = F.try_variant_get("node", "$", "string"), F.try_variant_get("node", "$", "array<variant>")
    kind = F.when(items.isNotNull(), "array").when(F.try_variant_get("node", "$", "map<string,variant>").isNotNull(), "object").otherwise("scalar")
    return found.select(key, "path", text.alias("value"), kind.alias("kind"), F.coalesce(F.size(F.when(items.isNotNull(), items)), F.length(text)).cast("long").alias("length"))


def _opened(rows: DataFrame, key: str) -> DataFrame:
    """The rows, and in place of each open one itself, closed, and its children."""
    as_map, as_list = F.try_variant_get("node", "$", "map<string,variant>"), F.try_variant_get("node", "$", "array<variant>")
    entries = F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    items = F.transform(as_list, lambda v, i: F.struct(i.cast("string").alias("k"), v.alias("v")))
    inside = lambda v: F.coalesce(F.try_variant_get(v, "$", "map<string,variant>").isNotNull() | F.try_variant_get(v, "$", "array<variant>").isNotNull(), F.lit(False))
    below = lambda k: F.when(F.col("level") == 0, k).otherwise(F.concat("path", F.lit("."), k))
    child = lambda c: F.struct(below(c["k"]).alias("path"), c["v"].alias("node"), (F.col("level") + 1).alias("level"), inside(c["v"]).alias("open"))
    own = F.array(F.struct("path", "node", "level", F.lit(False).alias("open")))
    all_ = F.when(F.col("open"), F.concat(own, F.coalesce(F.transform(F.coalesce(entries, items), child), F.slice(own, F.lit(1), F.lit(0))))).otherwise(own)
    return rows.select(key, F.explode(all_).alias("n")).select(key, "n.path", "n.node", "n.level", "n.open")


def _written(df: DataFrame) -> DataFrame:
    path = state_path(df.sparkSession, "nodes")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _variant_path(path: Column) -> Column:
    """A dotted path as a variant's path: a number is an index, a star the first element; null if it can't be written."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"\]?\[", "."), r"\]", ""), r"\.")
    quoted = lambda p: F.when(p.rlike(r"^[^'?]+$"), F.concat(F.lit("['"), p, F.lit("']"))).when(p.rlike(r'^[^"?]+$'), F.concat(F.lit('["'), p, F.lit('"]')))
    steps = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("["), p, F.lit("]"))).when(p == "*", F.lit("[0]")).otherwise(quoted(p)))
    return F.when(~F.exists(steps, lambda s: s.isNull()), F.concat(F.lit("$"), F.array_join(steps, "")))


def _kind(v: Column) -> Column:
    """NUMBER (booleans too), STRING, ARRAY, OBJECT, or NULL for a null or missing value."""
    name = F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), "^[A-Z]+", 0)
    return F.when(name == "VOID", "NULL").when(name.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN"), "NUMBER").otherwise(name)


def same_value(a: Column, b: Column) -> Column:
    """Whether two variants are equal by type and value: numbers as numbers, texts as texts, and arrays and objects as their
    JSON with sorted keys. A missing value equals a null one; true is 1 and false is 0."""
    exact = F.try_variant_get(a, "$", "decimal(38,18)") == F.try_variant_get(b, "$", "decimal(38,18)")
    number = F.coalesce(exact, F.try_variant_get(a, "$", "double") == F.try_variant_get(b, "$", "double"), F.lit(False))
    return (_kind(a) == _kind(b)) & F.when(_kind(a) == "NULL", True).when(_kind(a) == "NUMBER", number).otherwise(F.to_json(a) == F.to_json(b))


def check_features(specs: DataFrame, features: DataFrame, key: str, spec: str, lenient: bool = False, texts: bool = False) -> DataFrame:
    """features (key, path, op, value as JSON text) with satisfied.

    exists: a value that isn't null; eq; in: one of a list, or part of a text; contains: an element of an array, part of a
    text; len_ge, len_le: of arrays and texts only. Values are compared by type: the text "5" isn't the number 5, and "2024"
    has four characters. lenient: a missing path fails exists and passes any other op, as an unknown op does.
    texts: values are plain texts, as spec_features gives them, and only arrays and objects are read as JSON.

    Each specification is parsed once, as a variant; a feature meets it by the key and reads its value by its path, at any
    depth. Cases: a specification that is missing or isn't JSON has no values; a value that isn't JSON is a text."""
    docs = specs.select(F.col(key).alias("__key"), F.try_parse_json(spec).alias("__doc"))
    return _checked(features.join(docs, F.col(key) == F.col("__key"), "left"), [*(c for c in features.columns if c != "value"), "value"], lenient, texts)


def _checked(joined: DataFrame, columns: list[str], lenient: bool = False, texts: bool = False) -> DataFrame:
    """The columns with satisfied, of demands (path, op, value) that have met their document, a variant (__doc)."""
    text = F.col("value")
    parsed = F.try_parse_json(F.when(text.rlike(r"^\s*[\[{]"), text) if texts else text)
    plain = F.try_parse_json(F.when(text.isNotNull(), F.regexp_replace(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', "$1")))
    joined = joined.withColumns({"__at": F.try_variant_get("__doc", _variant_path(F.col("path")), "variant"), "__want": F.coalesce(parsed, plain)})
    v, want, op = F.col("__at"), F.col("__want"), F.col("op")
    joined = joined.withColumns({"__kind": _kind(v), "__wanted": _kind(want)})
    kind, wanted = F.col("__kind"), F.col("__wanted")
    present, own, other = kind != "NULL", F.try_variant_get(v, "$", "string"), F.try_variant_get(want, "$", "string")
    both_texts = (kind == "STRING") & (wanted == "STRING")
    items = lambda c: F.try_variant_get(c, "$", "array<variant>")
    size = F.when(kind == "ARRAY", F.size(items(v))).when(kind == "STRING", F.length(own)).cast("double")
    n = F.when(wanted == "NUMBER", F.try_variant_get(want, "$", "double")) if not texts else text.try_cast("double")
    strict = (
        F.when(op == "exists", present)
        .when(op == "eq", same_value(v, want))
        .when(op == "in", F.when(wanted == "ARRAY", F.exists(items(want), lambda o: same_value(v, o))).otherwise(both_texts & other.contains(own)))
        .when(op == "contains", F.when(kind == "ARRAY", F.exists(items(v), lambda o: same_value(o, want))).otherwise(both_texts & own.contains(other)))
        .when(op == "len_ge", size >= n)
        .when(op == "len_le", size <= n)
        .otherwise(F.lit(lenient))
    )
    answer = F.coalesce(strict, F.lit(False))
    if lenient:
        answer = F.when(~present, op != "exists").otherwise(answer)
    return joined.select(*columns, answer.alias("satisfied"))


def _feature(path, op: str, value=None) -> Column:
    value = F.lit(None).cast("string") if value is None else value
    return F.struct((F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(op).alias("op"), value.alias("value"))


def mark_type(spec: Column) -> Column:
    mark = F.get_json_object(spec, "$.mark")
    return F.when(F.substring(mark, 1, 1) == "{", F.get_json_object(spec, "$.mark.type")).otherwise(mark)


def _rows(specs: DataFrame, key: str, features: Column) -> DataFrame:
    some = F.filter(features, lambda f: f.isNotNull())
    return specs.select(key, F.posexplode(some).alias("pos", "f")).select(key, "pos", "f.path", "f.op", "f.value")


def spec_features(specs: DataFrame, key: str, spec: str, contract: bool = False) -> DataFrame:
    """key, pos, path, op, value of the features that a specification has.

    contract: the features that a chart type's example demands: fields need to exist only, and inner radius, scales,
    string selections and further transforms count.
    """
    c = F.col(spec)
    get = lambda p: F.get_json_object(c, p)
    channels = F.coalesce(F.from_json(get("$.encoding"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    none = F.array().cast("array<struct<path:string,op:string,value:string>>")
    opt = lambda test, f: F.when(test, f)
    mark = F.array(opt(mark_type(c).isNotNull(), _feature("mark.type", "eq", mark_type(c))))

    def of_channel(e):
        name, body = e["key"], e["value"]
        p = lambda k: F.concat(F.lit("encoding."), name, F.lit("."), F.lit(k))
        g = lambda k: F.get_json_object(body, f"$.{k}")
        one = [
            opt(g("field").isNotNull(), _feature(p("field"), "exists" if contract else "eq", None if contract else g("field"))),
            *(opt(g(k).isNotNull(), _feature(p(k), "eq", g(k))) for k in ("type", "aggregate", "timeUnit")),
            opt(g("bin").isNotNull() & (g("bin") != "false"), _feature(p("bin"), "exists")),
        ]
        if contract:
            one += [opt(g("scale.type").isNotNull(), _feature(p("scale.type"), "eq", g("scale.type"))), opt(name.isin(*CHANNELS) & g("scale.scheme").isNotNull(), _feature(p("scale.scheme"), "exists"))]
        return F.array(*one)

    encoding = F.flatten(F.transform(F.array_sort(F.map_entries(channels)), of_channel))
    steps = F.from_json(get("$.transform"), "array<map<string,string>>")
    kinds = ("aggregate", "filter", "calculate", "window", "bin") + (("fold", "joinaggregate", "density", "loess", "regression") if contract else ())
    of_step = lambda s, i: F.array(*(opt(F.map_contains_key(s, k), _feature(F.concat(F.lit("transform["), i.cast("string"), F.lit(f"].{k}")), "exists")) for k in kinds))
    transform = F.concat(F.array(opt(F.size(steps) > 0, _feature("transform", "exists"))), F.coalesce(F.flatten(F.transform(steps, of_step)), none))
    layers = F.json_array_length(get("$.layer"))
    compound = F.array(
        opt(layers > 0, _feature("layer", "exists")), opt(layers > 0, _feature("layer", "len_ge", layers.cast("string"))),
        *(opt(get(f"$.{k}").isNotNull(), _feature(k, "exists")) for k in ("hconcat", "vconcat", "concat", "facet")),
    )
    resolve = F.from_json(get("$.resolve"), "map<string,map<string,string>>")
    of_resolve = lambda e: F.transform(F.map_entries(e["value"]), lambda x: _feature(F.concat(F.lit("resolve."), e["key"], F.lit("."), x["key"]), "eq", x["value"]))
    resolves = F.coalesce(F.flatten(F.transform(F.map_entries(resolve), of_resolve)), none)
    params = F.from_json(get("$.params"), "array<map<string,string>>")

    def of_param(p, i):
        at = lambda k: F.concat(F.lit("params["), i.cast("string"), F.lit(f"].{k}"))
        select = F.element_at(p, "select")
        kind = F.get_json_object(select, "$.type")
        one = [opt(kind.isNotNull(), _feature(at("select.type"), "eq", kind)), opt(F.map_contains_key(p, "bind"), _feature(at("bind"), "exists"))]
        if contract:
            one.append(opt(select.isNotNull() & ~select.startswith("{"), _feature(at("select"), "eq", select)))
        return F.array(*one)

    interaction = F.concat(F.array(opt(F.size(params) > 0, _feature("params", "exists"))), F.coalesce(F.flatten(F.transform(params, of_param)), none))
    radius = F.array(opt(get("$.mark.innerRadius").isNotNull(), _feature("mark.innerRadius", "exists"))) if contract else none
    return _rows(specs, key, F.concat(mark, radius, encoding, transform, compound, resolves, interaction))


def contract_features(specs: DataFrame, key: str, spec: str) -> DataFrame:
    return spec_features(specs, key, spec, contract=True)


def build_contracts(examples: DataFrame, chart_type: str, spec: str) -> DataFrame:
    """The features of each chart type's example, all of them demanded."""
    return contract_features(examples, chart_type, spec).select(F.col(chart_type).alias("chart_type"), "path", "op", "value").distinct()


def data_requirements(df: DataFrame, category: str) -> DataFrame:
    """Adds what a category's charts need of data; an unknown category needs five rows."""
    rows = [(c, r["min_rows"], r.get("needs_numeric", 0), int(r.get("needs_categorical", 0)), r.get("max_categories"), bool(r.get("needs_ordered")), bool(r.get("needs_positive"))) for c, r in fixed.DATA_REQUIREMENTS.items()]
    table = df.sparkSession.createDataFrame(rows, "__c string, min_rows int, needs_numeric int, needs_categorical int, max_categories int, needs_ordered boolean, needs_positive boolean")
    joined = df.join(F.broadcast(table), F.col(category) == F.col("__c"), "left").drop("__c")
    return joined.withColumn("min_rows", F.coalesce("min_rows", F.lit(fixed.DEFAULT_MIN_ROWS)))


def contract_violations(specs: DataFrame, contracts: DataFrame, key: str, chart_type: str, spec: str) -> DataFrame:
    """Demands of a specification's chart type that it doesn't meet."""
    docs = specs.select(key, F.col(chart_type).alias("chart_type"), F.try_parse_json(spec).alias("__doc"))
    return _checked(docs.join(contracts, "chart_type"), [key, "path", "op", "value"], texts=True).where("not satisfied").drop("satisfied")


def missing_features(specs: DataFrame, features: DataFrame, key: str, spec: str) -> DataFrame:
    return check_features(specs, features, key, spec).where("not satisfied").drop("satisfied")


def feature_violations(specs: DataFrame, features: DataFrame, key: str, spec: str) -> DataFrame:
    """By specification: ok, and the paths of the features that it lacks. One of which nothing is demanded is ok."""
    lacking = missing_features(specs, features, key, spec).groupBy(key).agg(F.array_sort(F.collect_list("path")).alias("missing"))
    missing = F.coalesce("missing", F.array().cast("array<string>"))
    return specs.select(key).join(lacking, key, "left").select(key, (F.size(missing) == 0).alias("ok"), missing.alias("missing"))


def compress_features(features: DataFrame, key: str, cap: int = 15) -> DataFrame:
    """The first feature of each priority path, then other defining ones while there are fewer than the cap."""
    priority = F.coalesce(*(F.when(F.col("path").startswith(p), F.lit(i)) for i, p in enumerate(fixed.PRIORITY_PATHS)), F.lit(99))
    defining = F.col("path").rlike("|".join(fixed.DEFINING_WORDS))
    # a path's features have its priority, so that what can't be kept goes before anything is sorted
    some = features.withColumn("__p", priority).where((F.col("__p") < 99) | defining)
    unique = some.withColumn("__k", F.row_number().over(Window.partitionBy(key, "__p", "path").orderBy("pos"))).where("__k = 1").drop("__k")
    first = F.row_number().over(Window.partitionBy(key, "__p").orderBy("pos"))
    ranked = unique.withColumn("__first", (first == 1) & (F.col("__p") < 99))
    order = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__first"), F.when(F.col("__first"), F.col("__p")), "pos"))
    return ranked.where(F.col("__first") | defining).withColumn("rank", order).where(F.col("__first") | (F.col("rank") <= cap)).drop("__p", "__first")


def encoding_pattern(features: DataFrame, key: str) -> DataFrame:
    """Letters of the types of x, y, color and size, in this order, joined by dashes."""
    typed = F.col("path").isin(*(f"encoding.{ch}.type" for ch in CHANNELS)) & (F.col("op") == "eq")
    # other features are left out but for the first, which keeps the key
    few = features.where(typed | (F.col("pos") == 0)).select(key, F.when(typed, F.col("path")).alias("path"), F.when(typed, F.upper(F.substring("value", 1, 1))).alias("letter"))
    letter = lambda ch: F.max(F.when(F.col("path") == f"encoding.{ch}.type", F.col("letter")))
    return few.groupBy(key).agg(F.concat_ws("-", *(letter(ch) for ch in CHANNELS)).alias("pattern"))


def composition_type(spec: Column) -> Column:
    return F.coalesce(*(F.when(F.get_json_object(spec, f"$.{k}").isNotNull(), F.lit(k)) for k in ("layer", "hconcat", "vconcat", "facet", "repeat")), F.lit("single"))


def interaction_types(specs: DataFrame, key: str, spec: str) -> DataFrame:
    """key and interaction, a row for each that a parameter has; none for a specification without one."""
    params = F.from_json(F.get_json_object(spec, "$.params"), "array<map<string,string>>")

    def of(p):
        select, bind = F.element_at(p, "select"), F.element_at(p, "bind")
        kind = F.coalesce(F.get_json_object(select, "$.type"), select)
        return F.array(
            F.when(kind == "interval", "brush").when(kind == "point", "point_selection"),
            F.when(bind == "legend", "legend").when(bind.startswith("{") | (bind == "scales"), "slider"),
        )

    found = F.filter(F.flatten(F.transform(params, of)), lambda x: x.isNotNull())
    some = F.when(F.size(found) > 0, found).when(F.size(params) > 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("none")))
    return specs.select(key, F.explode(some).alias("interaction"))


def transform_types(specs: DataFrame, features: DataFrame, key: str, spec: str) -> DataFrame:
    """Counts of transforms named by features' paths and, again, by the specification: both count by design."""
    kinds = "|".join(fixed.TRANSFORM_TYPES)
    by_path = features.where(F.col("path").startswith("transform")).select(F.regexp_extract("path", f"({kinds})", 1).alias("transform")).where("transform <> ''")
    steps = specs.select(F.explode(F.from_json(F.get_json_object(spec, "$.transform"), "array<map<string,string>>")).alias("s"))
    in_spec = steps.select(F.explode(F.map_keys("s")).alias("transform")).where(F.col("transform").isin(*fixed.TRANSFORM_TYPES))
    return by_path.union(in_spec).groupBy("transform").agg(F.count(F.lit(1)).alias("n"))


def required_features(specs: DataFrame, key: str, spec: str) -> DataFrame:
    """key, pos, id, type, text and must: what a chart has to show, in words, by rules."""
    c = F.col(spec)
    get = lambda p: F.get_json_object(c, p)
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    item = lambda test, kind, text, must: F.when(test, F.struct(F.lit(kind).alias("type"), text.alias("text"), F.lit(must).alias("must")))
    mark = mark_type(c)
    mark_text = F.coalesce(F.try_element_at(table(fixed.MARK_PHRASES), mark), F.concat(F.lit("Use a "), mark, F.lit(" chart.")))
    unit = F.when(get("$.encoding.x.timeUnit").isNotNull(), F.concat(F.lit(" by "), get("$.encoding.x.timeUnit"))).otherwise("")
    agg = get("$.encoding.y.aggregate")
    agg_text = F.concat(F.lit("Show the "), F.coalesce(F.try_element_at(table(fixed.AGGREGATE_PHRASES), F.lower(agg)), agg), F.lit(" of "), F.coalesce(get("$.encoding.y.field"), F.lit("records")), F.lit("."))
    rules = F.exists(F.from_json(get("$.layer"), "array<map<string,string>>"), lambda m: F.coalesce(F.get_json_object(F.element_at(m, "mark"), "$.type"), F.element_at(m, "mark")) == "rule")
    filters = F.exists(F.from_json(get("$.transform"), "array<map<string,string>>"), lambda m: F.map_contains_key(m, "filter"))
    rows = F.array(
        item(mark.isNotNull(), "mark", mark_text, True),
        item(get("$.encoding.x.field").isNotNull(), "encoding", F.concat(F.lit("Put "), get("$.encoding.x.field"), F.lit(" on the x-axis"), unit, F.lit(".")), True),
        item(agg.isNotNull(), "aggregation", agg_text, True),
        item(get("$.encoding.color.field").isNotNull(), "encoding", F.concat(F.lit("Color by "), get("$.encoding.color.field"), F.lit(".")), False),
        item(F.coalesce(rules, F.lit(False)), "overlay_stat_line", F.lit("Add a reference line."), True),
        item(F.coalesce(filters, F.lit(False)), "filter", F.lit("Filter the data."), False),
        item(F.json_array_length(get("$.params")) > 0, "interaction", F.lit("Make the chart interactive."), False),
    )
    some = F.filter(rows, lambda r: r.isNotNull())
    out = specs.select(key, F.posexplode(some).alias("pos", "r"))
    return out.select(key, "pos", F.concat(F.lit("kf_"), F.col("pos").cast("string")).alias("id"), "r.type", "r.text", "r.must")


def format_required(required: DataFrame, key: str) -> DataFrame:
    """A numbered line for each feature; one that doesn't say is optional here."""
    line = F.concat((F.col("pos") + 1).cast("string"), F.lit(". "), F.when(F.coalesce("must", F.lit(False)), "[Required] ").otherwise("[Optional] "), F.col("text"))
    return required.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def interaction_valid(spec: Column, literal: bool = False) -> Column:
    """Whether a chart has parameters and, unless literal, one of them selects or is bound."""
    params = F.from_json(F.get_json_object(spec, "$.params"), "array<map<string,string>>")
    has = F.coalesce(F.size(params) > 0, F.lit(False))
    used = F.coalesce(F.exists(params, lambda p: F.map_contains_key(p, "select") | F.map_contains_key(p, "bind")), F.lit(False))
    return has if literal else has & used


def is_interactive_type(chart_type: Column) -> Column:
    return F.lower(chart_type).rlike("interactive|brush|selection|hover|slider|crossfilter|linked")


def sanitize_spec(spec: Column) -> Column:
    """Without control characters, raw or as JSON escapes."""
    raw = F.regexp_replace(spec, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.regexp_replace(raw, r"\\u00(?:0[0-8bBcCeEfF]|1[0-9a-fA-F]|7[fF])", "")


#: Keys that every sample has.
REQUIRED_KEYS = ["sample_id", "db_id", "chart_type", "initial_question", "anchor_question", "vis_sql", "data", "vega_lite_spec", "required_key_features"]


def missing_fields(samples: DataFrame, key: str, json: str) -> DataFrame:
    """Required keys that a sample's JSON lacks."""
    return samples.select(key, F.array_except(F.array(*map(F.lit, REQUIRED_KEYS)), F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))).alias("missing"))
