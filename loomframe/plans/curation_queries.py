"""Queries over specifications, candidates, ambiguity, balance, quality, collections, evaluation and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import ambiguity, balance, candidates, collection, evaluation, quality, specs, traces, trees
from ..sources import tables as src
from .fixtures import fx, with_fx

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, fixture: str | None = None, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = with_fx(fixture, sql) if fixture else sql
        return fn

    return add


def rounded(df, digits: int, *names: str):
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- specifications

# What the derived specifications hold: condition, path, op, value; in the order in which features are listed. Contracts
# ask for fields to exist only, and for the inner radius.
_G = "json_extract_string(spec, '$.{}')"
_PARTS = [
    ("true", "mark.type", "eq", "CASE p_size % 3 WHEN 0 THEN 'bar' WHEN 1 THEN 'line' ELSE 'arc' END"), ("contract AND p_size % 3 = 2", "mark.innerRadius", "exists", "NULL"),
    ("p_size % 5 = 0", "encoding.color.field", "field", "'p_type'"), ("p_size % 5 = 0", "encoding.color.type", "eq", "'nominal'"), ("true", "encoding.x.field", "field", _G.format("encoding.x.field")), ("true", "encoding.x.type", "eq", _G.format("encoding.x.type")),
    ("true", "encoding.y.field", "field", "'p_retailprice'"), ("true", "encoding.y.type", "eq", "'quantitative'"), ("p_size % 2 = 0", "encoding.y.aggregate", "eq", "'sum'"),
    ("p_size % 7 = 0", "transform", "exists", "NULL"), ("p_size % 7 = 0", "transform[0].filter", "exists", "NULL"), ("p_size % 7 = 0", "transform[1].window", "exists", "NULL"),
    ("p_size % 6 = 0", "layer", "exists", "NULL"), ("p_size % 6 = 0", "layer", "len_ge", "'2'"), ("p_size % 6 <> 0 AND p_size % 11 = 0", "hconcat", "exists", "NULL"),
    ("p_size % 10 = 0", "params", "exists", "NULL"), ("p_size % 10 = 0", "params[0].select.type", "eq", "'interval'"), ("p_size % 10 = 0", "params[1].bind", "exists", "NULL"),
]


def _features_sql(contract: bool) -> str:
    ops = {"field": "exists" if contract else "eq"}
    return " UNION ALL ".join(
        f"SELECT spec_id, chart_type, {k} AS k, '{path}' AS path, '{ops.get(op, op)}' AS op, {'NULL' if op == 'field' and contract else value}::VARCHAR AS value FROM fx WHERE {when.replace('contract', str(contract).lower())}" for k, (when, path, op, value) in enumerate(_PARTS)
    )

_J = "json_extract_string(spec, '{}')"
_MARK = "CASE WHEN json_type(spec, '$.mark') = 'OBJECT' THEN json_extract_string(spec, '$.mark.type') ELSE json_extract_string(spec, '$.mark') END"


@query("spec_json_path", "specs", f"SELECT spec_id, {_J.format('$.encoding.x.field')} AS x_field, {_J.format('$.layer[1].mark')} AS layer_mark FROM fx")
def spec_json_path(spark, d):
    c = F.col("spec")
    return fx(spark, d, "specs").select("spec_id", specs.json_path(c, "encoding.x.field").alias("x_field"), specs.json_path(c, "layer.1.mark").alias("layer_mark"))


@query("spec_flatten", "specs", r"SELECT spec_id, regexp_replace(replace(substr(j.fullkey, 3), '\"', ''), '\[([0-9]+)\]', '.\1', 'g') AS path, CASE j.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'scalar' END AS kind, CASE WHEN j.type NOT IN ('OBJECT', 'ARRAY') THEN j.atom ->> '$' END AS value FROM fx, json_tree(spec::JSON) AS j WHERE j.parent IS NOT NULL")
def spec_flatten(spark, d):
    flat = specs.flatten_spec(fx(spark, d, "specs"), "spec_id", "spec")
    return flat.select("spec_id", "path", "kind", F.when(F.col("kind") == "scalar", F.col("value")).alias("value"))


def _wanted(spark, d):
    rows = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(o).alias("op"), F.lit(v).alias("value")) for p, o, v in (
        ("mark.type", "eq", '"line"'), ("encoding.color", "exists", None), ("layer", "len_ge", "2"), ("encoding.x.type", "in", '["nominal","ordinal"]'), ("encoding.y.field", "contains", '"retail"'),
    )))
    return fx(spark, d, "specs").select("spec_id", F.explode(rows).alias("f")).select("spec_id", "f.path", "f.op", "f.value")


_CHECKS = f"""SELECT spec_id, 'mark.type' AS path, coalesce({_J.format('$.mark.type')} = 'line', false) AS satisfied FROM fx
UNION ALL SELECT spec_id, 'encoding.color', json_exists(spec, '$.encoding.color') FROM fx
UNION ALL SELECT spec_id, 'layer', coalesce(json_array_length(json_extract(spec, '$.layer')) >= 2, false) FROM fx
UNION ALL SELECT spec_id, 'encoding.x.type', {_J.format('$.encoding.x.type')} IN ('nominal', 'ordinal') FROM fx
UNION ALL SELECT spec_id, 'encoding.y.field', contains({_J.format('$.encoding.y.field')}, 'retail') FROM fx"""


@query("spec_check_features", "specs", _CHECKS)
def spec_check_features(spark, d):
    return specs.check_features(fx(spark, d, "specs"), _wanted(spark, d), "spec_id", "spec").select("spec_id", "path", "satisfied")


@query("spec_missing_features", "specs", f"SELECT spec_id, path FROM ({_CHECKS}) WHERE NOT satisfied")
def spec_missing_features(spark, d):
    return specs.missing_features(fx(spark, d, "specs"), _wanted(spark, d), "spec_id", "spec").select("spec_id", "path")


@query("spec_features", "specs", f"SELECT spec_id, path, op, value FROM ({_features_sql(False)})")
def spec_features(spark, d):
    return specs.spec_features(fx(spark, d, "specs"), "spec_id", "spec").select("spec_id", "path", "op", "value")


@query("spec_contracts", "specs", f"SELECT DISTINCT chart_type, path, op, value FROM ({_features_sql(True)})")
def spec_contracts(spark, d):
    return specs.build_contracts(fx(spark, d, "specs"), "chart_type", "spec")


@query("spec_contract_violations", "specs", f"""WITH w AS (SELECT DISTINCT chart_type, path, op, value FROM ({_features_sql(True)})) SELECT spec_id, path, op, value FROM (SELECT spec_id, w.*, json_extract(spec, concat('$.', path)) AS found FROM fx JOIN w USING (chart_type))
WHERE NOT coalesce(CASE op WHEN 'exists' THEN json_type(found) <> 'NULL' WHEN 'eq' THEN json_type(found) = 'VARCHAR' AND found ->> '$' = value WHEN 'len_ge' THEN json_array_length(found) >= value::INT END, false)""")
def spec_contract_violations(spark, d):
    all_ = fx(spark, d, "specs")
    return specs.contract_violations(all_, specs.build_contracts(all_, "chart_type", "spec"), "spec_id", "chart_type", "spec").select("spec_id", "path", "op", "value")


# paths of derived documents with numbers and texts of digits; whether the demand holds, in SQL
_TYPED = [
    ("a", "eq", "5", "p_size = 5"), ("a", "eq", '"5"', "false"), ("b", "eq", '"5"', "p_size = 5"), ("b", "eq", "5", "false"), ("b", "len_ge", "2", "p_size >= 10"), ("a", "len_ge", "1", "false"), ("b", "len_le", "1", "p_size < 10"),
    ("c", "contains", "7", "p_size = 7"), ("c", "contains", '"7"', "false"), ("c", "contains", '"1"', "true"), ("c", "len_ge", "4", "false"), ("b", "contains", '"1"', "contains(p_size::VARCHAR, '1')"), ("b", "in", '["5",6]', "p_size = 5"),
    ("a", "in", '["5",6]', "p_size = 6"), ("f", "eq", "2", "true"), ("d.e", "eq", '{"y":2,"x":[1]}', "p_size % 2 = 0"), ("c[1]", "eq", '"1"', "true"), ("d['e'].x[0]", "exists", None, "false"), ("d.e.x[0]", "eq", "1", "true"), ("n", "exists", None, "false"),
]
_LENIENT = [("zz.y", "exists", None, "false"), ("zz.y", "eq", "1", "true"), ("n", "len_ge", "3", "true"), ("a", "unheard of", "1", "true"), ("a", "eq", '"5"', "false")]


def _typed_sql(rows: list) -> str:
    return " UNION ALL ".join(f"SELECT p_partkey, {k} AS k, {holds} AS satisfied FROM part" for k, (_, _, _, holds) in enumerate(rows))


def _typed_checks(spark, d, rows: list, **how):
    n = F.col("p_size").cast("string")
    doc = F.concat(F.lit('{"a":'), n, F.lit(',"b":"'), n, F.lit('","c":[1,"1",'), n, F.lit('],"d":{"e":{"x":[1],"y":'), F.when(F.col("p_size") % 2 == 0, "2.0").otherwise("3"), F.lit('}},"f":2.0,"n":null}'))
    docs = src.read_table(spark, d, "part").select("p_partkey", doc.alias("doc"))
    wanted = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(p).alias("path"), F.lit(o).alias("op"), F.lit(v).cast("string").alias("value")) for k, (p, o, v, _) in enumerate(rows)))
    return specs.check_features(docs, docs.select("p_partkey", F.inline(wanted)), "p_partkey", "doc", **how).select("p_partkey", "k", "satisfied")


@query("spec_typed_features", sql=_typed_sql(_TYPED))
def spec_typed_features(spark, d):
    return _typed_checks(spark, d, _TYPED)


@query("spec_lenient_features", sql=_typed_sql(_LENIENT))
def spec_lenient_features(spark, d):
    return _typed_checks(spark, d, _LENIENT, lenient=True)


@query("spec_feature_violations", "specs", f"SELECT spec_id, count(path) = 0 AS ok, coalesce(string_agg(path, ',' ORDER BY path), '') AS missing FROM fx LEFT JOIN (SELECT spec_id, path FROM ({_CHECKS}) WHERE NOT satisfied) USING (spec_id) GROUP BY 1")
def spec_feature_violations(spark, d):
    out = specs.feature_violations(fx(spark, d, "specs"), _wanted(spark, d), "spec_id", "spec")
    return out.select("spec_id", "ok", F.array_join("missing", ",").alias("missing"))


@query("spec_compressed", "specs", f"SELECT DISTINCT spec_id, path FROM ({_features_sql(False)}) WHERE regexp_matches(path, 'mark|encoding|layer|params|resolve')")
def spec_compressed(spark, d):
    found = specs.spec_features(fx(spark, d, "specs"), "spec_id", "spec")
    return specs.compress_features(found, "spec_id").select("spec_id", "path")


@query("spec_encoding_pattern", "specs", "SELECT spec_id, concat(CASE p_size % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'T' WHEN 2 THEN 'O' ELSE 'Q' END, '-Q', CASE WHEN p_size % 5 = 0 THEN '-N' ELSE '' END) AS pattern FROM fx")
def spec_encoding_pattern(spark, d):
    return specs.encoding_pattern(specs.spec_features(fx(spark, d, "specs"), "spec_id", "spec"), "spec_id")


@query("spec_composition", "specs", "SELECT spec_id, CASE WHEN p_size % 6 = 0 THEN 'layer' WHEN p_size % 11 = 0 THEN 'hconcat' ELSE 'single' END AS composition FROM fx")
def spec_composition(spark, d):
    return fx(spark, d, "specs").select("spec_id", specs.composition_type(F.col("spec")).alias("composition"))


@query("spec_interactions", "specs", "SELECT spec_id, unnest(CASE WHEN p_size % 10 = 0 THEN ['brush', 'legend'] ELSE ['none'] END) AS interaction FROM fx")
def spec_interactions(spark, d):
    return specs.interaction_types(fx(spark, d, "specs"), "spec_id", "spec")


@query("spec_transforms", "specs", "SELECT unnest(['filter', 'window']) AS transform, 2 * count(*) AS n FROM fx WHERE p_size % 7 = 0")
def spec_transforms(spark, d):
    all_ = fx(spark, d, "specs")
    return specs.transform_types(all_, specs.spec_features(all_, "spec_id", "spec"), "spec_id", "spec")


_REQUIRED = """SELECT spec_id, row_number() OVER (PARTITION BY spec_id ORDER BY k) - 1 AS pos, type, text, must FROM (
SELECT spec_id, 0 AS k, 'mark' AS type, CASE p_size % 3 WHEN 0 THEN 'Use a bar chart.' WHEN 1 THEN 'Use a line chart.' ELSE 'Use a pie/donut chart.' END AS text, true AS must FROM fx
UNION ALL SELECT spec_id, 1, 'encoding', concat('Put ', json_extract_string(spec, '$.encoding.x.field'), ' on the x-axis.'), true FROM fx
UNION ALL SELECT spec_id, 2, 'aggregation', 'Show the total of p_retailprice.', true FROM fx WHERE p_size % 2 = 0
UNION ALL SELECT spec_id, 3, 'encoding', 'Color by p_type.', false FROM fx WHERE p_size % 5 = 0
UNION ALL SELECT spec_id, 4, 'overlay_stat_line', 'Add a reference line.', true FROM fx WHERE p_size % 6 = 0
UNION ALL SELECT spec_id, 5, 'filter', 'Filter the data.', false FROM fx WHERE p_size % 7 = 0
UNION ALL SELECT spec_id, 6, 'interaction', 'Make the chart interactive.', false FROM fx WHERE p_size % 10 = 0)"""


@query("spec_required", "specs", f"SELECT spec_id, concat('kf_', pos) AS id, type, text, must FROM ({_REQUIRED})")
def spec_required(spark, d):
    return specs.required_features(fx(spark, d, "specs"), "spec_id", "spec").select("spec_id", "id", "type", "text", "must")


@query("spec_required_lines", "specs", f"SELECT spec_id, string_agg(concat(pos + 1, '. ', CASE WHEN must THEN '[Required] ' ELSE '[Optional] ' END, text), chr(10) ORDER BY pos) AS lines FROM ({_REQUIRED}) GROUP BY 1")
def spec_required_lines(spark, d):
    return specs.format_required(specs.required_features(fx(spark, d, "specs"), "spec_id", "spec"), "spec_id")


@query("spec_data_requirements", sql="SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 2 WHEN 1 THEN 20 WHEN 2 THEN 5 ELSE 9 END AS min_rows, CASE p_size % 4 WHEN 1 THEN 1 WHEN 2 THEN NULL ELSE 0 END AS needs_numeric, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 3 THEN 2 END AS needs_categorical, CASE WHEN p_size % 4 = 0 THEN 8 END AS max_categories FROM part")
def spec_data_requirements(spark, d):
    n = F.col("p_size") % 4
    named = src.read_table(spark, d, "part").select("p_partkey", F.when(n == 0, "Circular Plots").when(n == 1, "Distributions").when(n == 2, "no such category").otherwise("Tables").alias("category"))
    return specs.data_requirements(named, "category").select("p_partkey", "min_rows", "needs_numeric", "needs_categorical", "max_categories")


@query("spec_sanitized", sql="SELECT p_partkey, concat('{\"a\":\"', p_brand, '\"}') AS clean FROM part")
def spec_sanitized(spark, d):
    dirty = F.concat(F.lit('{"a":"'), F.char(F.col("p_size") % 8 + 1), "p_brand", F.lit("\\u000b"), F.when(F.col("p_size") % 2 == 0, "\\u001F").otherwise(F.lit("\x7f")), F.lit('"}'))
    return src.read_table(spark, d, "part").select("p_partkey", specs.sanitize_spec(dirty).alias("clean"))


@query("spec_missing_fields", "samples", "SELECT sample_id, concat('initial_question,anchor_question,vis_sql,data,vega_lite_spec', CASE WHEN seq % 2 = 0 THEN '' ELSE ',required_key_features' END) AS missing FROM fx")
def spec_missing_fields(spark, d):
    one = F.to_json(F.struct("sample_id", "db_id", "chart_type", F.when(F.col("seq") % 2 == 0, "x").alias("required_key_features")))
    return specs.missing_fields(fx(spark, d, "samples").withColumn("json", one), "sample_id", "json").select("sample_id", F.array_join("missing", ",").alias("missing"))


@query("spec_interaction_valid", "specs", "SELECT spec_id, p_size % 10 = 0 AS valid FROM fx")
def spec_interaction_valid(spark, d):
    return fx(spark, d, "specs").select("spec_id", specs.interaction_valid(F.col("spec")).alias("valid"))


@query("spec_inline_data", sql="SELECT o_custkey AS spec_id, array_to_string(list_transform(v[1:5], lambda x: concat('{\"k\":', x, '}')), ',') AS kept, len(v)::INT AS original FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS v FROM orders GROUP BY 1)")
def spec_inline_data(spark, d):
    values = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.struct(k.alias("k")))
    rows = src.read_table(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.struct(values.alias("values")).alias("data"))).alias("spec"))
    cut = rows.select(F.col("o_custkey").alias("spec_id"), src.truncate_inline_data(F.col("spec")).alias("c"))
    return cut.select("spec_id", F.array_join("c.rows", ",").alias("kept"), F.col("c.original").alias("original"))


# --- candidates


def _cands(spark, d, by=None):
    base = fx(spark, d, "candidates", by)
    return base.withColumns({
        "dimensions": F.array("dim1", "dim2"), "measures": F.array("measure"), "tables_needed": F.array(F.lit("lineitem")), "feature_types": F.array("chart_category"), "complexity": (F.col("pos") % 3).cast("double"),
    })


_D = """2::DOUBLE * (a.chart_category <> b.chart_category)::INT + (lower(a.chart_type) <> lower(b.chart_type))::INT + 1.5::DOUBLE * (1 - len(list_intersect([a.dim1, a.dim2], [b.dim1, b.dim2])) / len(list_distinct([a.dim1, a.dim2, b.dim1, b.dim2])))
+ (a.measure <> b.measure)::INT + (a.aggregation <> b.aggregation)::INT + (a.vis_intent_type <> b.vis_intent_type)::INT + 2::DOUBLE * (a.chart_category <> b.chart_category)::INT + 0.5::DOUBLE * abs(a.pos % 3 - b.pos % 3)"""


@query("candidate_distance", "candidates", f"SELECT a.question_id, a.pos AS pos_a, b.pos AS pos_b, round({_D}, 6) AS distance FROM fx a JOIN fx b ON a.question_id = b.question_id AND a.pos < b.pos")
def candidate_distance(spark, d):
    return rounded(candidates.candidate_distance(_cands(spark, d)), 6, "distance")


@query("candidate_select", "candidates", f"""WITH d AS (SELECT a.question_id, a.pos, b.pos AS other, {_D} AS distance FROM fx a JOIN fx b ON a.question_id = b.question_id AND a.pos <> b.pos), size AS (SELECT question_id, count(*) AS size FROM fx GROUP BY 1),
one AS (SELECT question_id, min(pos) AS pos FROM fx GROUP BY 1),
two AS (SELECT question_id, pos, distance FROM (SELECT d.*, row_number() OVER (PARTITION BY d.question_id ORDER BY distance DESC, d.pos) AS k FROM d JOIN one ON d.question_id = one.question_id AND d.other = one.pos) WHERE k = 1),
three AS (SELECT question_id, pos, distance FROM (SELECT x.question_id, x.pos, least(x.distance, y.distance) AS distance, row_number() OVER (PARTITION BY x.question_id ORDER BY least(x.distance, y.distance) DESC, x.pos) AS k
FROM d x JOIN one ON x.question_id = one.question_id AND x.other = one.pos JOIN two ON two.question_id = x.question_id AND two.pos <> x.pos JOIN d y ON y.question_id = x.question_id AND y.pos = x.pos AND y.other = two.pos) WHERE k = 1)
SELECT question_id, pos, taken, round(CASE WHEN size > 3 THEN distance ELSE 0 END, 6) AS diversity_score FROM (SELECT *, 0 AS distance, 0 AS taken FROM one UNION ALL SELECT *, 1 FROM two UNION ALL SELECT *, 2 FROM three) JOIN size USING (question_id)""")
def candidate_select(spark, d):
    return rounded(candidates.diverse_picks(_cands(spark, d), 3), 6, "diversity_score")


@query("candidate_nearest", "candidates", f"SELECT question_id, pos, place::INT AS place, other, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY question_id, pos ORDER BY round(distance, 9), other) AS place FROM (SELECT a.question_id, a.pos, b.pos AS other, {_D} AS distance FROM fx a JOIN fx b ON a.question_id = b.question_id AND a.pos <> b.pos)) WHERE place <= 2")
def candidate_nearest(spark, d):
    return rounded(candidates.nearest_candidates(_cands(spark, d, by="l_orderkey"), 2)[0], 6, "distance")


@query("candidate_avoid", "candidates", "SELECT question_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY chart_type IN ('NO', 'RF'), pos) AS k FROM fx) WHERE k <= 3")
def candidate_avoid(spark, d):
    return candidates.drop_avoided(fx(spark, d, "candidates"), ["NO", "RF"], 3).select("question_id", "pos")


@query("candidate_ids", "candidates", "SELECT question_id, pos, concat('q', question_id, '_c', pos) AS candidate_id FROM fx")
def candidate_ids(spark, d):
    return candidates.assign_candidate_ids(fx(spark, d, "candidates")).select("question_id", "pos", "candidate_id")


_TYPE = "CASE pos % 5 WHEN 0 THEN 'Multi Line Chart' WHEN 1 THEN 'scatter_plot' WHEN 2 THEN 'Boxes' WHEN 3 THEN 'Donut arc' ELSE 'unknown' END"


def _typed(df):
    return df.withColumn("chart_type", F.expr(_TYPE))


@query("candidate_features", "candidates", f"SELECT question_id, pos, unnest(['mark.type', 'encoding.x.field', 'encoding.y.field', 'encoding.y.aggregate', 'encoding.y.type', 'encoding.color.field']) AS path, unnest([CASE pos % 5 WHEN 0 THEN 'line' WHEN 1 THEN 'point' WHEN 2 THEN 'boxplot' WHEN 3 THEN 'arc' ELSE 'bar' END, dim1, measure, lower(aggregation), 'quantitative', dim2]) AS value FROM fx")
def candidate_features(spark, d):
    return candidates.candidate_features(_typed(_cands(spark, d)), ["question_id", "pos"]).select("question_id", "pos", "path", "value")


@query("candidate_similar", "candidates", "SELECT question_id, min(pos) AS pos, chart_type FROM fx GROUP BY question_id, chart_type")
def candidate_similar(spark, d):
    return candidates.dedupe_similar(fx(spark, d, "candidates"), key=["question_id"]).select("question_id", "pos", "chart_type")


@query("candidate_valid", "candidates", "SELECT question_id, pos FROM fx WHERE chart_type IN ('AF', 'RF')")
def candidate_valid(spark, d):
    all_ = fx(spark, d, "candidates")
    return candidates.valid_candidates(all_, all_.where("chart_type in ('AF', 'RF')").select("chart_type")).select("question_id", "pos")


@query("candidate_fallback", "samples", """SELECT DISTINCT source_question_id AS question_id, concat('q', source_question_id, '_c', k) AS candidate_id, ['simple_bar_chart', 'simple_line_chart', 'grouped_bar_chart', 'pie_chart', 'bubble_plot'][k + 1] AS chart_type,
CASE WHEN source_question_id % 2 = 0 THEN 'a' ELSE 'category' END AS dimension, CASE WHEN source_question_id % 3 = 0 THEN 'm' ELSE 'value' END AS measure FROM fx, range(5) AS g(k)""")
def candidate_fallback(spark, d):
    q, none = F.col("source_question_id"), F.array().cast("array<string>")
    asked = fx(spark, d, "samples").select(q.alias("question_id"), F.when(q % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(none).alias("dimensions"), F.when(q % 3 == 0, F.array(F.lit("m"))).otherwise(none).alias("measures")).distinct()
    return candidates.fallback_candidates(asked, 5).select("question_id", "candidate_id", "chart_type", F.col("dimensions")[0].alias("dimension"), F.col("measures")[0].alias("measure"))


@query("candidate_paths", "candidates", """SELECT question_id, pos, concat('encoding.y.aggregate', CASE WHEN pos % 3 = 0 THEN ',encoding.x.timeUnit' ELSE '' END, CASE WHEN pos % 2 = 0 THEN ',encoding.color.field' ELSE '' END, ',encoding.x.sort,encoding.y.sort',
CASE WHEN pos % 5 = 0 THEN ',mark.type' ELSE '' END) AS paths FROM fx""")
def candidate_paths(spark, d):
    first = F.when(F.col("pos") % 3 == 0, "order_Date").otherwise(F.col("dim1"))
    dims = F.when(F.col("pos") % 2 == 0, F.array(first, "dim2")).otherwise(F.array(first))
    return _typed(_cands(spark, d)).select("question_id", "pos", F.array_join(candidates.injectable_paths(dims, F.col("chart_type")), ",").alias("paths"))


@query("candidate_parse", "candidates", "SELECT question_id, pos, chart_type, dim1 AS x, aggregation FROM fx")
def candidate_parse(spark, d):
    one = F.struct("chart_type", "aggregation", F.to_json(F.struct(F.struct(F.concat("dim1", F.lit(" (nominal)")).alias("x"), F.col("measure").alias("y")).alias("primary_encodings"))).alias("data_mapping"))
    answers = fx(spark, d, "candidates").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("c")))).alias("cs"))
    answers = answers.select("question_id", F.to_json(F.struct(F.transform("cs", lambda x: x["c"]).alias("candidates"))).alias("answer"))
    parsed = candidates.parse_candidates(answers, "question_id", "answer")
    return parsed.select("question_id", F.col("pos").cast("long").alias("pos"), "chart_type", F.col("dimensions")[0].alias("x"), "aggregation")


# --- ambiguity

_TEMPLATES = """SELECT spec_id, unnest(list_filter([CASE WHEN p_size % 2 = 0 THEN 'aggregation_missing' END, CASE WHEN p_size % 4 = 1 THEN 'time_granularity_missing' END, CASE WHEN p_size % 7 = 0 THEN 'topk_missing' END, CASE WHEN p_size % 7 = 0 THEN 'filter_scope_missing' END,
'chart_type_missing', CASE WHEN p_size % 5 = 0 THEN 'encoding_channel_missing' END, 'axis_assignment_missing', CASE WHEN p_size % 3 = 2 THEN 'grouping_dimension_missing' END, 'data_range_mismatch', 'vis_data_incompatible', 'field_name_error', 'aggregation_conflict'], lambda x: x IS NOT NULL)) AS template FROM fx"""


@query("ambiguity_templates", "specs", _TEMPLATES)
def ambiguity_templates(spark, d):
    return ambiguity.valid_templates(fx(spark, d, "specs"), "spec_id", "spec")


@query("ambiguity_weights", "specs", f"WITH v AS ({_TEMPLATES}), u AS (SELECT template, count(*) AS n FROM v GROUP BY 1), s AS (SELECT *, count(*) OVER (PARTITION BY spec_id) AS size FROM v) SELECT spec_id, template, round((1 / (n + 1.0) * CASE template WHEN 'topk_missing' THEN 1.75 WHEN 'chart_type_missing' THEN 0.55 ELSE 1 END)::DOUBLE, 10) AS weight FROM s JOIN u USING (template) WHERE template <> 'chart_type_missing' OR size >= 10")
def ambiguity_weights(spark, d):
    valid = ambiguity.valid_templates(fx(spark, d, "specs"), "spec_id", "spec")
    usage = valid.groupBy("template").agg(F.count("*").alias("n"))
    out = ambiguity.template_weights(valid, "spec_id", usage, ["topk_missing"], ["chart_type_missing"], 0.5, seed=None)
    return rounded(out, 10, "weight")


@query("ambiguity_pick")
def ambiguity_pick(spark, d):
    valid = ambiguity.valid_templates(fx(spark, d, "specs"), "spec_id", "spec")
    usage = valid.groupBy("template").agg(F.count("*").alias("n"))
    picked = ambiguity.weighted_pick(ambiguity.template_weights(valid, "spec_id", usage, [], [], 0.5), "spec_id")
    return ambiguity.ambiguity_profile(picked, "spec_id")


@query("ambiguity_plan", "candidates", "SELECT question_id, pos, CASE vis_intent_type WHEN 'trend' THEN 'data_ambiguity' ELSE 'visualization_ambiguity' END AS ambiguity_type, CASE vis_intent_type WHEN 'trend' THEN 'text' ELSE 'vis' END AS interface FROM fx")
def ambiguity_plan(spark, d):
    plan = ambiguity.plan_ambiguity(F.col("vis_intent_type"), F.array(F.lit("encoding.y.aggregate")))
    return fx(spark, d, "candidates").select("question_id", "pos", plan["ambiguity_type"].alias("ambiguity_type"), plan["interface"].alias("interface"))


_WEAK = [f"CASE WHEN data AND contains(q, '{term}') AND {word.lower()} THEN 'Ambiguity too weak: ''{term}'' explicitly mentioned' END" for term, word in fixed.EXPLICIT_TERMS] + [f"CASE WHEN NOT data AND contains(q, '{term}') THEN 'Ambiguity too weak: chart type ''{term}'' explicit' END" for term in fixed.CHART_TERMS]


@query("ambiguity_issues", "questions", f"""SELECT question_id, array_to_string(list_filter([{', '.join(_WEAK)}, CASE WHEN len(list_filter(regexp_split_to_array(trim(said), '\\s+'), lambda w: w <> '')) < 5 AND length(said) < 15 THEN 'Ambiguity too strong: question too short' END,
CASE WHEN question_id % 7 = 0 THEN 'Ambiguity too strong: too many ambiguous points' END], lambda x: x IS NOT NULL) || CASE WHEN question_id % 5 = 0 AND NOT contains(q, 'atlantis') AND NOT contains(q, 'city') THEN ['Semantic drift: entity ''atlantis city'' missing'] ELSE [] END, '|') AS issues
FROM (SELECT *, lower(said) AS q, question_id % 2 = 0 AS data, question_id % 3 < 2 OR question_id % 7 = 0 AS aggregate, question_id % 3 = 2 OR question_id % 7 = 0 AS timeunit, question_id % 7 = 0 AS topk FROM (SELECT *, CASE question_id % 6 WHEN 0 THEN concat('Total by month of ', substr(question, 1, 40)) WHEN 1 THEN concat('A Bar Chart of the city ', substr(question, 1, 40)) WHEN 2 THEN 'sum up' ELSE question END AS said FROM fx))""")
def ambiguity_issues(spark, d):
    """Questions that say too much or too little, with one kind of ambiguity each and paths that differ."""
    k = F.col("question_id")
    start = F.substring("question", 1, 40)
    said = F.when(k % 6 == 0, F.concat(F.lit("Total by month of "), start)).when(k % 6 == 1, F.concat(F.lit("A Bar Chart of the city "), start)).when(k % 6 == 2, "sum up").otherwise(F.col("question"))
    every = F.array(*map(F.lit, ("encoding.y.aggregate", "encoding.x.timeUnit", "topk", "mark")))
    paths = F.when(k % 7 == 0, every).when(k % 3 < 2, F.array(F.lit("encoding.y.aggregate"))).otherwise(F.array(F.lit("encoding.x.timeUnit")))
    entities = F.when(k % 5 == 0, F.array(F.lit("Atlantis City"), F.lit("abc"))).otherwise(F.array().cast("array<string>"))
    issues = ambiguity.ambiguity_issues(F.col("said"), F.array(F.when(k % 2 == 0, "data_ambiguity").otherwise("visualization_ambiguity")), paths, entities)
    return fx(spark, d, "questions").withColumn("said", said).select("question_id", F.array_join(issues, "|").alias("issues"))


@query("ambiguity_relevant_types", "questions", "SELECT question_id, contains(lower(question), 'bar') OR contains(lower(question), 'line') OR contains(lower(question), 'pie') OR contains(lower(question), 'mark') OR contains(lower(question), 'scatter') OR contains(lower(question), 'heatmap') OR contains(lower(question), 'histogram') OR contains(lower(question), 'donut') OR contains(lower(question), 'treemap') OR contains(lower(question), 'chart type') OR contains(lower(question), 'area chart') OR contains(lower(question), 'bubble chart') AS mark FROM fx")
def ambiguity_relevant_types(spark, d):
    return fx(spark, d, "questions").select("question_id", F.array_contains(ambiguity.relevant_feature_types(F.col("question")), "mark").alias("mark"))


# --- balance

DIMENSIONS = {"domains": "domain", "chart_types": "chart_type", "chart_categories": "chart_category"}
_DOMAIN = "CASE " + " ".join(f"WHEN regexp_matches(lower(db_id), '{'|'.join(words)}') THEN '{domain}'" for domain, words in fixed.DOMAIN_KEYWORDS.items()) + " ELSE 'other' END"
_COUNTS = f"""counts AS (SELECT dimension, value, count(*) AS n FROM (SELECT unnest(['domains', 'chart_types', 'chart_categories']) AS dimension, unnest([{_DOMAIN}, chart_type, chart_category]) AS value FROM fx) GROUP BY ALL)"""
_SCORES = "scores AS (SELECT dimension, sum(-p * log2(p)) / CASE WHEN k > 1 THEN log2(k) ELSE 1 END AS score FROM (SELECT dimension, n / sum(n) OVER (PARTITION BY dimension) AS p, count(*) OVER (PARTITION BY dimension) AS k FROM counts) GROUP BY dimension, k)"


def _counts(spark, d):
    return balance.feature_counts(fx(spark, d, "samples").withColumn("domain", balance.infer_domain(F.col("db_id"))), DIMENSIONS)


@query("balance_counts", "samples", f"WITH {_COUNTS} SELECT * FROM counts")
def balance_counts(spark, d):
    return _counts(spark, d)


@query("balance_scores", "samples", f"WITH {_COUNTS}, {_SCORES} SELECT dimension, round(score, 10) AS score FROM scores")
def balance_scores(spark, d):
    return rounded(balance.diversity_score(_counts(spark, d)), 10, "score")


@query("balance_overall", "samples", f"WITH {_COUNTS}, {_SCORES} SELECT round(sum(score) / {len(balance.OVERALL)}, 10) AS overall FROM scores WHERE dimension IN ({', '.join(repr(x) for x in balance.OVERALL)})")
def balance_overall(spark, d):
    return rounded(balance.overall_diversity(balance.diversity_score(_counts(spark, d))), 10, "overall")


_CHARTS = "['Stacked Column', 'area stream', 'BUBBLE plot', 'donut', 'Density', 'violin', 'correlation matrix', 'choropleth', 'network', 'bar over line']"
_CATEGORIES = "['Bar Charts', 'Line/Area Charts', 'Scatter/Point Charts', 'Pie/Arc Charts', 'Distribution Charts', 'Statistical Charts', 'Heatmaps', 'Geographic Charts', 'Other', 'Bar Charts']"


@query("balance_category", "samples", f"SELECT sample_id, CASE WHEN seq % 11 = 10 THEN '' ELSE {_CATEGORIES}[seq % 11 + 1] END AS category FROM fx")
def balance_category(spark, d):
    names = F.expr("array(" + _CHARTS[1:-1] + ", '')")
    return fx(spark, d, "samples").select("sample_id", balance.infer_chart_category(F.element_at(names, (F.col("seq") % 11 + 1).cast("int"))).alias("category"))


@query("balance_chart_types", "samples", "WITH c AS (SELECT chart_type, count(*) AS n FROM fx GROUP BY 1), u AS (SELECT DISTINCT chart_type FROM fx UNION SELECT 'never used') SELECT 'under' AS side, chart_type, coalesce(n, 0) AS n FROM u LEFT JOIN c USING (chart_type) WHERE coalesce(n, 0) < 1.1903 * (SELECT sum(n) FROM c) / (SELECT count(*) FROM u) UNION ALL SELECT 'over', chart_type, n FROM c WHERE n > 1.0007 * (SELECT sum(n) FROM c) / (SELECT count(*) FROM c)")
def balance_chart_types(spark, d):
    counts, used = _counts(spark, d), fx(spark, d, "samples").select("chart_type").distinct()
    catalog = used.union(spark.createDataFrame([("never used",)], "chart_type string"))
    few, many = balance.underrepresented_charts(counts, catalog, 1.1903), balance.overrepresented_charts(counts, 1.0007)
    return few.select(F.lit("under").alias("side"), "chart_type", "n").union(many.select(F.lit("over"), "chart_type", "n"))


@query("balance_under", "samples", "SELECT db_id AS value, count(*) AS n FROM fx GROUP BY 1 HAVING count(*) < 0.99 * (SELECT count(*) / count(DISTINCT db_id) FROM fx)")
def balance_under(spark, d):
    counts = balance.feature_counts(fx(spark, d, "samples"), {"db": "db_id"})
    return balance.underrepresented(counts, 0.99).select("value", "n")


@query("balance_over", "samples", "SELECT db_id AS value, count(*) AS n FROM fx GROUP BY 1 HAVING count(*) > 1.01 * (SELECT count(*) / count(DISTINCT db_id) FROM fx)")
def balance_over(spark, d):
    counts = balance.feature_counts(fx(spark, d, "samples"), {"db": "db_id"})
    return balance.overrepresented(counts, 1.01).select("value", "n")


@query("balance_gaps", "samples", "SELECT unnest(['5-LOW', 'missing_chart']) AS value EXCEPT SELECT chart_type FROM fx")
def balance_gaps(spark, d):
    counts = _counts(spark, d).where("dimension = 'chart_types'")
    return balance.coverage_gaps(balance.universe_table(spark, {"chart_types": ["5-LOW", "missing_chart"]}), counts).select("value")


def _lists(name: str, universe: list, cut: str, limit: int) -> str:
    """Values of a list that are used less than a share of its part, in its order."""
    return f"SELECT '{name}' AS dimension, (SELECT string_agg(value, ',' ORDER BY pos) FROM (SELECT u.value, u.pos FROM (SELECT unnest(range({len(universe)})) AS pos, unnest({universe!r}) AS value) u LEFT JOIN (SELECT * FROM c WHERE dimension = '{name}') c ON u.value = c.value WHERE coalesce(n, 0) < {cut} * (SELECT sum(n) FROM c WHERE dimension = '{name}') / {len(universe)} OR NOT EXISTS (FROM c WHERE dimension = '{name}') ORDER BY pos LIMIT {limit})) AS prefer"


_OVER = "(SELECT string_agg(value, ',' ORDER BY n DESC, value) FROM (SELECT *, sum(n) OVER () AS total, count(*) OVER () AS size FROM c WHERE dimension = '{}') WHERE CASE WHEN total < {} THEN n > 0 ELSE n > 2 * total / size END)"
_PATTERN = "concat(CASE p_size % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'T' WHEN 2 THEN 'O' ELSE 'Q' END, '-Q', CASE WHEN p_size % 5 = 0 THEN '-N' ELSE '' END)"


@query("balance_constraints", "specs", f"""WITH c AS (SELECT dimension, value, count(*) AS n FROM (SELECT 'compositions' AS dimension, CASE WHEN p_size % 6 = 0 THEN 'layer' WHEN p_size % 11 = 0 THEN 'hconcat' ELSE 'single' END AS value FROM fx UNION ALL SELECT 'interactions', unnest(CASE WHEN p_size % 10 = 0 THEN ['brush', 'legend'] ELSE ['none'] END) FROM fx
UNION ALL SELECT 'aggregations', 'sum' FROM fx WHERE p_size % 2 = 0 UNION ALL SELECT 'encoding_patterns', {_PATTERN} FROM fx UNION ALL SELECT 'chart_categories', CASE WHEN p_size < 3 THEN 'rare' WHEN p_size < 10 THEN 'few' ELSE 'many' END FROM fx UNION ALL SELECT 'chart_types', chart_type FROM fx WHERE spec_id < 8) GROUP BY ALL),
types AS (SELECT DISTINCT chart_type AS value FROM fx), strong AS (SELECT CASE WHEN count(*) < 10 THEN 0.3 WHEN count(*) < 50 THEN 0.5 ELSE 0.7 END::DOUBLE AS strength FROM fx)
SELECT dimension, coalesce(prefer, '') AS prefer, coalesce(CASE dimension WHEN 'aggregations' THEN {_OVER.format('aggregations', 0)} WHEN 'encoding_patterns' THEN {_OVER.format('encoding_patterns', 0)} WHEN 'chart_types' THEN {_OVER.format('chart_types', 10)} END, '') AS avoid, strength FROM (
{_lists('compositions', fixed.COMPOSITION_TYPES, '0.5', 1)} UNION ALL {_lists('aggregations', fixed.AGGREGATION_TYPES, '0.5', 3)} UNION ALL {_lists('time_units', fixed.TIME_UNITS, '0.5', 3)} UNION ALL {_lists('transforms', fixed.TRANSFORM_TYPES, '0.5', 3)}
UNION ALL SELECT 'interactions', string_split(replace(prefer, 'none,', ''), ',')[1] FROM ({_lists('interactions', fixed.INTERACTION_TYPES, '0.5', 99)})
UNION ALL SELECT 'encoding_patterns', (SELECT value FROM c WHERE dimension = 'encoding_patterns' AND n < 0.3 * (SELECT sum(n) / count(*) FROM c WHERE dimension = 'encoding_patterns') ORDER BY n, value LIMIT 1)
UNION ALL SELECT 'chart_categories', (SELECT string_agg(value, ',' ORDER BY n, value) FROM (SELECT * FROM c WHERE dimension = 'chart_categories' AND n < 0.5 * (SELECT sum(n) / count(*) FROM c WHERE dimension = 'chart_categories') ORDER BY n, value LIMIT 5))
UNION ALL SELECT 'chart_types', (SELECT string_agg(value, ',' ORDER BY value) FROM (SELECT t.value FROM types t LEFT JOIN (SELECT * FROM c WHERE dimension = 'chart_types') c ON t.value = c.value WHERE coalesce(n, 0) < 0.5 * (SELECT sum(n) FROM c WHERE dimension = 'chart_types') / (SELECT count(*) FROM types) ORDER BY t.value LIMIT 10))), strong""")
def balance_constraints(spark, d):
    """All eight dimensions, for interactive charts."""
    s = fx(spark, d, "specs")
    size = F.col("p_size")
    patterns = specs.encoding_pattern(specs.spec_features(s, "spec_id", "spec"), "spec_id")
    kinds = specs.interaction_types(s, "spec_id", "spec").groupBy("spec_id").agg(F.collect_list("interaction").alias("interactions"))
    s = s.join(patterns, "spec_id").join(kinds, "spec_id").withColumns({
        "composition": specs.composition_type(F.col("spec")), "aggregation": F.when(size % 2 == 0, "sum"), "category": F.when(size < 3, "rare").when(size < 10, "few").otherwise("many"), "used": F.when(F.col("spec_id") < 8, F.col("chart_type")),
    })
    counts = balance.feature_counts(s, {"compositions": "composition", "interactions": "interactions", "aggregations": "aggregation", "encoding_patterns": "pattern", "chart_categories": "category", "chart_types": "used"}, "spec_id")
    return balance.diversity_constraints(counts, spark, "Interactive Charts", s.select("chart_type"), s.agg(F.count("*").alias("total")))


_REPORT = f"""WITH {_COUNTS}, {_SCORES}, u AS (SELECT unnest(['chart_types', 'chart_types', 'domains']) AS dimension, unnest(['5-LOW', 'never used', 'social']) AS value), every AS (SELECT * FROM counts UNION ALL SELECT dimension, value, 0 FROM u WHERE (dimension, value) NOT IN (SELECT (dimension, value) FROM counts)),
k AS (SELECT dimension, sum(n) AS total, count(*) AS keys FROM every GROUP BY 1), e AS (SELECT dimension, sum(CASE WHEN n > 0 THEN -(n / total) * log2(n / total) ELSE 0 END) / CASE WHEN keys > 1 THEN log2(keys) ELSE 1 END AS score FROM every JOIN k USING (dimension) GROUP BY dimension, keys),
top AS (SELECT dimension, string_agg(concat(value, '=', n), ',' ORDER BY n DESC, value) AS top FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS r FROM every) WHERE r <= 10 GROUP BY 1),
few AS (SELECT dimension, string_agg(value, ',' ORDER BY value) AS under FROM (SELECT u.*, coalesce(n, 0) AS n, count(*) OVER (PARTITION BY u.dimension) AS size FROM u LEFT JOIN counts c ON u.dimension = c.dimension AND u.value = c.value) JOIN k USING (dimension) WHERE n < 0.5 * total / size GROUP BY 1),
many AS (SELECT dimension, string_agg(value, ',' ORDER BY value) AS over FROM every JOIN k USING (dimension) WHERE n > 2 * total / keys GROUP BY 1)
SELECT dimension, total::BIGINT AS total, keys, round(score, 10) AS score, top, coalesce(under, '') AS under, coalesce(over, '') AS over FROM k JOIN e USING (dimension) JOIN top USING (dimension) LEFT JOIN few USING (dimension) LEFT JOIN many USING (dimension)"""


@query("balance_report", "samples", _REPORT)
def balance_report(spark, d):
    universe = balance.universe_table(spark, {"chart_types": ["5-LOW", "never used"], "domains": ["social"]})
    return rounded(balance.diversity_report(_counts(spark, d), universe), 10, "score")


@query("balance_rebuilt", "samples", "SELECT chart_type AS value, count(*) AS n FROM fx WHERE validation_passed GROUP BY 1")
def balance_rebuilt(spark, d):
    return balance.rebuild_counts(fx(spark, d, "samples"), {"chart_types": "chart_type"}).select("value", "n")


@query("balance_ledger", "samples", "SELECT chart_type AS value, count(*) + (chart_type = '1-URGENT')::INT AS n FROM fx GROUP BY 1")
def balance_ledger(spark, d):
    counts = balance.feature_counts(fx(spark, d, "samples"), {"chart_types": "chart_type"})
    wanted = counts.where("value in ('1-URGENT', '5-LOW')").select("dimension", "value")
    ledger = balance.reserve(wanted, "r1")
    ledger = ledger.union(balance.rollback(ledger, "r1", used=wanted.where("value = '1-URGENT'")))
    return balance.with_ledger(counts, ledger).select("value", "n")


@query("balance_committed", "samples", "SELECT chart_type AS value, 2 * count(*) + (chart_type IN ('1-URGENT', '2-HIGH'))::INT AS n FROM fx GROUP BY 1")
def balance_committed(spark, d):
    """Two reservations: of one a part is used and its commitment outlives a rollback; the other is rolled back."""
    saved = balance.feature_counts(fx(spark, d, "samples"), {"chart_types": "chart_type"})
    counts = balance.restore_counts(saved, saved)
    first = counts.where("value in ('1-URGENT', '2-HIGH', '5-LOW')").select("dimension", "value")
    ledger = balance.reserve(first, "r1").union(balance.reserve(first, "r2"))
    ledger = balance.commit(ledger, "r1", used=first.where("value <> '5-LOW'"))
    ledger = ledger.union(balance.rollback(ledger, "r1")).union(balance.rollback(ledger, "r2"))
    return balance.with_ledger(counts, ledger).select("value", "n")


@query("balance_collection", "samples", "SELECT 'db_id' AS dimension, db_id AS value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM fx GROUP BY db_id UNION ALL SELECT 'chart_category', chart_category, count(*), round(count(*) * 100.0 / sum(count(*)) OVER (), 1) FROM fx GROUP BY chart_category")
def balance_collection(spark, d):
    return balance.collection_stats(fx(spark, d, "samples"), ["db_id", "chart_category"])


@query("balance_lengths", "questions", "SELECT min(length(question))::INT AS low, max(length(question))::INT AS high, round(avg(length(question)), 6) AS mean, median(length(question)) AS median FROM fx")
def balance_lengths(spark, d):
    return rounded(balance.length_stats(fx(spark, d, "questions"), "question"), 6, "mean")


# --- quality


# frames that differ in rows, nulls, categories and signs: a name, its table, a text and a number, as expressions that both know
_FRAMES = [
    ("customers", "customer", "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END", "CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END"), ("balances", "customer", "c_mktsegment", "c_acctbal"), ("parts", "part", "p_brand", "p_size"), ("orders", "orders", "o_orderstatus", "o_totalprice"),
    ("regions", "region", "r_name", "r_regionkey"), ("no regions", "region", "CASE WHEN r_regionkey < 0 THEN r_name END", "CASE WHEN r_regionkey < 0 THEN 1 END"), ("one status", "orders", "'all'", "o_totalprice"), ("nations", "nation", "n_name", "-n_nationkey"),
]
_CHART_NAMES = ["pie_chart", "histogram", "Scatter Plot", "donut"]


@query("quality_validate", sql="SELECT frame, chart, n_rows, round(nulls / (2 * n_rows), 6) AS null_share, array_to_string(issues, ',') AS issues, n_rows > 1000 AS noted, len(issues) = 0 AS passed FROM (SELECT *, list_filter([CASE WHEN n_rows < 5 THEN 'Too few rows' END, CASE WHEN nulls / (2 * n_rows) > 0.5 THEN 'Too many null values' END, "
    "CASE WHEN pie AND kinds < 2 THEN 'pie chart has too few categories' END, CASE WHEN pie AND kinds > 8 THEN 'pie chart has too many categories' END, CASE WHEN pie AND low < 0 THEN 'pie chart has negative values in v' END, CASE WHEN chart = 'Scatter Plot' THEN 'scatter plot needs two numeric columns' END], lambda x: x IS NOT NULL) AS issues "
    "FROM (SELECT *, chart IN ('pie_chart', 'donut') AS pie FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS frame, count(*) AS n_rows, 2 * count(*) - count({k}) - count({v}) AS nulls, count(DISTINCT {k}) AS kinds, min({v})::DOUBLE AS low FROM {table}" for name, table, k, v in _FRAMES) + f"), (SELECT unnest({_CHART_NAMES!r}) AS chart)))")
def quality_validate(spark, d):
    """Four charts of each of eight frames."""
    out = None
    for name, table, k, v in _FRAMES:
        own = src.read_table(spark, d, table).select(F.expr(k).alias("k"), F.expr(v).alias("v"))
        for chart in _CHART_NAMES:
            one = quality.validate_data(own, chart).select(F.lit(name).alias("frame"), F.lit(chart).alias("chart"), "n_rows", F.round("null_share", 6).alias("null_share"), F.array_join("issues", ",").alias("issues"), (F.size("notes") > 0).alias("noted"), "passed")
            out = one if out is None else out.union(one)
    return out


@query("quality_specs", "specs", f"SELECT spec_id, count(*) FILTER (satisfied) AS satisfied, count(*) FILTER (satisfied) >= 4 AS passed FROM ({_CHECKS}) GROUP BY spec_id")
def quality_specs(spark, d):
    all_ = fx(spark, d, "specs")
    checked = specs.check_features(all_, _wanted(spark, d), "spec_id", "spec")
    ok = all_.select("spec_id", F.lit(True).alias("interaction_ok"))
    none = checked.where("false").select("spec_id", "path")
    return quality.validate_specs(checked, none, ok, "spec_id").select("spec_id", "satisfied", "passed")


@query("quality_codes", "runs", """SELECT sample_id, array_to_string(list_filter([CASE WHEN NOT code_renderable THEN 'EXEC_FAIL' END, CASE WHEN sample_id % 9 = 0 THEN 'SEMANTIC_DRIFT' END, CASE WHEN fine AND best_score < 5 THEN 'KF_MISMATCH' END, CASE WHEN fine AND best_score < 3 THEN 'CONTRACT_VIOLATION' END,
CASE WHEN fine AND best_score = 0 THEN 'INTERACT_DEGENERATE' END, CASE WHEN fine AND best_score >= 5 AND sample_id % 4 = 0 THEN 'VIS_UNREADABLE' END, CASE WHEN sample_id % 5 = 0 THEN 'AMB_WEAK' END, CASE WHEN sample_id % 7 = 0 THEN 'AMB_STRONG' END], lambda x: x IS NOT NULL), ',') AS codes FROM (SELECT *, code_renderable AND sample_id % 9 > 0 AS fine FROM fx)""")
def quality_codes(spark, d):
    score, k = F.col("best_score"), F.col("sample_id")
    r = fx(spark, d, "runs").withColumns({
        "exec_ok": F.col("code_renderable"), "anchor_ok": k % 9 > 0, "spec_ok": score >= 5, "features_ok": score >= 5, "contract_ok": score >= 3, "interaction_ok": score > 0, "readable": F.when(k % 4 == 0, False), "amb_weak": k % 5 == 0, "amb_strong": F.when(k % 7 == 0, True),
    })
    return quality.failure_codes(r).select("sample_id", F.array_join("codes", ",").alias("codes"))


def _some(*pairs: str) -> str:
    """A list of texts, each under its condition: 'condition -> text' pairs."""
    return "list_filter([" + ", ".join(f"CASE WHEN {p.split(' -> ')[0]} THEN {p.split(' -> ')[1]} END" for p in pairs) + "], lambda x: x IS NOT NULL)"


def _advice(issues: str, table: list) -> str:
    found = " || ".join(f"CASE WHEN len(list_filter({issues}, lambda x: regexp_matches(lower(x), '{'|'.join(words)}'))) > 0 THEN {advice!r} ELSE [] END".replace('"', "'") for words, advice in table)
    return f"list_sort(list_distinct({found}))"


_ISSUES = {
    "data": _some("best_score = 0 -> 'Data is empty'", "best_score < 3 -> 'Too few rows'", "sample_id % 3 = 0 -> 'Too many null values'", "sample_id % 5 = 0 -> 'wrong type'"),
    "vis": _some("sample_id % 2 = 0 -> 'contract: must have a Mark'", "sample_id % 3 = 1 -> 'color field is missing'", "sample_id % 7 = 0 -> 'selection unused'"),
    "drawn": _some("sample_id % 11 = 0 -> 'labels are Cut Off'", "sample_id % 11 = 1 -> 'too dark'"),
}


@query("quality_feedback", "runs", f"""WITH r AS (SELECT *, {_ISSUES['data']} AS di, {_ISSUES['vis']} AS vi, {_ISSUES['drawn']} AS wi, NOT code_renderable AS bad, prompt_tokens % 4 < 2 AS lacking, sample_id % 6 = 0 AS broken, sample_id % 11 < 2 AS undrawn, CASE sample_id % 3 WHEN 0 THEN 'the legend is small' WHEN 1 THEN 'Colors lack Contrast' END AS said FROM fx)
SELECT sample_id, bad OR lacking OR broken OR undrawn AS needs_iteration, CASE WHEN bad AND (lacking OR broken OR undrawn) THEN 'both' WHEN bad THEN 'sql' WHEN lacking OR broken OR undrawn THEN 'altair_code' ELSE 'none' END AS target, CASE WHEN bad THEN 'high' WHEN lacking OR broken OR undrawn THEN 'medium' ELSE 'low' END AS priority,
CASE WHEN bad THEN array_to_string(list_filter(di, lambda x: regexp_matches(lower(x), 'row|column|empty|null')), '|') ELSE '' END AS sql_issues, CASE WHEN bad THEN array_to_string({_advice('di', fixed.ISSUE_ADVICE)}, '|') ELSE '' END AS sql_suggestions,
array_to_string(CASE WHEN lacking THEN [concat('Key features: ', prompt_tokens % 4, '/2 satisfied')] ELSE [] END || CASE WHEN broken THEN list_filter(vi, lambda x: regexp_matches(lower(x), 'contract|must have')) ELSE [] END, '|') AS code_issues, CASE WHEN lacking THEN array_to_string({_advice('vi', fixed.CODE_ADVICE)}, '|') ELSE '' END AS code_suggestions,
CASE WHEN lacking THEN concat('p', sample_id % 3) ELSE '' END AS missing_features, CASE WHEN undrawn THEN array_to_string(wi, '|') ELSE '' END AS visual_issues,
CASE WHEN undrawn THEN array_to_string(list_sort({_advice("[coalesce(said, '')]", fixed.VISUAL_ADVICE)} || CASE WHEN contains(lower(coalesce(said, '')), 'color') AND regexp_matches(lower(said), 'contrast|distinguish') THEN ['{fixed.COLOR_ADVICE[0]}', '{fixed.COLOR_ADVICE[1].replace("'", "''")}'] ELSE [] END || CASE WHEN sample_id % 11 = 0 THEN {fixed.CLIPPING_ADVICE!r} ELSE [] END), '|') ELSE '' END AS visual_suggestions FROM r""")
def quality_feedback(spark, d):
    k, score = F.col("sample_id"), F.col("best_score")
    texts = lambda *tests: F.array_compact(F.array(*(F.when(t, F.lit(s)) for t, s in tests)))
    r = fx(spark, d, "runs").withColumns({
        "data_ok": F.col("code_renderable"), "data_issues": texts((score == 0, "Data is empty"), (score < 3, "Too few rows"), (k % 3 == 0, "Too many null values"), (k % 5 == 0, "wrong type")),
        "features_satisfied": F.col("prompt_tokens") % 4, "features_total": F.lit(2), "missing": F.array(F.concat(F.lit("p"), k % 3)), "contract_ok": k % 6 != 0,
        "vis_issues": texts((k % 2 == 0, "contract: must have a Mark"), (k % 3 == 1, "color field is missing"), (k % 7 == 0, "selection unused")),
        "drawn_ok": k % 11 >= 2, "drawn_issues": texts((k % 11 == 0, "labels are Cut Off"), (k % 11 == 1, "too dark")), "drawn_feedback": F.when(k % 3 == 0, "the legend is small").when(k % 3 == 1, "Colors lack Contrast"),
    })
    out = quality.iteration_feedback(r)
    lists = ("sql_issues", "sql_suggestions", "code_issues", "code_suggestions", "missing_features", "visual_issues", "visual_suggestions")
    return out.select("sample_id", "needs_iteration", "target", "priority", *(F.array_join(c, "|").alias(c) for c in lists))


@query("quality_chart_gate", "runs", """SELECT sample_id, drawn AND judged AND len(issues) = 0 AS drawn_ok, array_to_string(CASE WHEN NOT drawn THEN ['Failed to render chart to image'] WHEN NOT judged THEN ['Validation of the image failed'] ELSE issues END, '|') AS drawn_issues FROM (SELECT *, code_renderable AS drawn, sample_id % 13 > 0 AS judged,
list_filter([CASE WHEN coalesce(r, 0) < 0.7 THEN printf('Low readability score: %.2f < 0.7', coalesce(r, 0)) END, CASE WHEN sample_id % 5 = 0 THEN 'Data representation incorrect' END, CASE WHEN sample_id % 7 = 0 THEN 'crowded' END], lambda x: x IS NOT NULL) AS issues FROM (SELECT *, CASE WHEN best_score < 10 THEN best_score / 9.0::DOUBLE END AS r FROM fx))""")
def quality_chart_gate(spark, d):
    k = F.col("sample_id")
    r = fx(spark, d, "runs").withColumns({"drawn": F.col("code_renderable"), "judged": k % 13 > 0, "readability": F.when(F.col("best_score") < 10, F.col("best_score") / 9), "data_correct": F.when(k % 5 == 0, False), "found": F.when(k % 7 == 0, F.array(F.lit("crowded")))})
    return quality.gate_charts(r).select("sample_id", "drawn_ok", F.array_join("drawn_issues", "|").alias("drawn_issues"))


@query("quality_suggestions", "runs", "SELECT sample_id, unnest(['Check table and column names for typos', 'Verify the WHERE conditions match existing data']) AS advice FROM fx WHERE best_score = 0")
def quality_suggestions(spark, d):
    issues = fx(spark, d, "runs").select("sample_id", F.when(F.col("best_score") == 0, "Data is empty").otherwise("fine").alias("issue"))
    return quality.suggestions(issues, "sample_id", "issue")


@query("quality_gate", "runs", "SELECT sample_id FROM fx WHERE code_renderable AND best_score / 10 >= 0.3")
def quality_gate(spark, d):
    r = fx(spark, d, "runs").withColumns({"score": F.col("best_score") / 10, "suitable": F.col("code_renderable")})
    return quality.gate_quality(r).select("sample_id")


# --- collections


@query("collection_existing", "samples", "SELECT source_question_id, count(*) AS n FROM fx WHERE validation_passed GROUP BY 1")
def collection_existing(spark, d):
    return collection.existing_samples(fx(spark, d, "samples")).select("source_question_id", "n")


@query("collection_remaining", sql=with_fx("samples", "SELECT c_custkey AS question_id, greatest(10 - coalesce(n, 0), 0) AS remaining FROM customer LEFT JOIN (SELECT source_question_id, count(*) AS n FROM fx WHERE validation_passed GROUP BY 1) ON source_question_id = c_custkey WHERE greatest(10 - coalesce(n, 0), 0) > 0"))
def collection_remaining(spark, d):
    q = src.read_table(spark, d, "customer").select(F.col("c_custkey").alias("question_id"))
    return collection.remaining_work(q, collection.existing_samples(fx(spark, d, "samples")), 10)


@query("collection_outcomes", "runs", "SELECT sample_id % 500 AS question_id, count(*) AS attempted, count(*) FILTER (code_renderable) AS succeeded FROM fx GROUP BY 1")
def collection_outcomes(spark, d):
    r = fx(spark, d, "runs").select((F.col("sample_id") % 500).alias("question_id"), F.col("code_renderable").alias("success"), F.lit("not renderable").alias("error"))
    return collection.question_outcomes(r).select("question_id", "attempted", "succeeded")


@query("collection_summary", "runs", "SELECT count(DISTINCT sample_id % 500) AS instances, count(*) AS attempted, count(*) FILTER (code_renderable) AS succeeded, printf('%.1f%%', count(*) FILTER (code_renderable) * 100.0 / count(*)) AS success_rate FROM fx")
def collection_summary(spark, d):
    r = fx(spark, d, "runs").select((F.col("sample_id") % 500).alias("question_id"), F.col("code_renderable").alias("success"), F.lit("not renderable").alias("error"))
    return collection.pipeline_summary(collection.question_outcomes(r))


@query("collection_distribution", "samples", "SELECT 'chart_type' AS dimension, chart_type AS value, count(*) AS n FROM fx GROUP BY ALL UNION ALL SELECT 'db_id', db_id, count(*) FROM fx GROUP BY ALL")
def collection_distribution(spark, d):
    s = fx(spark, d, "samples")
    return collection.pipeline_distribution(s, ["chart_type", "db_id"], s.select("db_id"))


_REVIEW = "SELECT sample_id, CASE seq % 3 WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' END AS status FROM fx WHERE seq % 3 < 2"


def _review(spark, d):
    s = fx(spark, d, "samples")
    return s, s.where("seq % 3 < 2").select("sample_id", F.when(F.col("seq") % 3 == 0, "fail").otherwise("pass").alias("status"))


@query("collection_finalized", "samples", """SELECT concat('q', source_question_id, '_c', row_number() OVER (PARTITION BY source_question_id ORDER BY seq) - 1) AS sample_id, db_id, CASE WHEN seq % 2 = 0 THEN chart_type ELSE 'bar' END AS chart_type, CASE WHEN seq % 2 = 0 THEN chart_category WHEN seq % 5 = 0 THEN 'Interactive Charts' ELSE 'Bar Charts' END AS chart_category, concat('Q', seq) AS initial_question FROM fx WHERE seq % 3 = 1""")
def collection_finalized(spark, d):
    """Samples with an odd number have no type and category of their own."""
    s, review = _review(spark, d)
    even = F.col("seq") % 2 == 0
    feature = lambda kind, value: F.struct(F.lit(kind).alias("type"), F.lit(value).alias("value"), F.lit("t").alias("text"))
    features = F.when(F.col("seq") % 5 == 0, F.array(feature("mark", "bar"), feature("interaction", "brush"))).otherwise(F.array(feature("filter", "f"), feature("mark", "bar"), feature("mark", "line")))
    s = s.withColumns({"chart_type": F.when(even, F.col("chart_type")), "chart_category": F.when(even, F.col("chart_category")), "key_features": features, "vis_question": F.concat(F.lit("Q"), F.col("seq"))})
    return collection.finalize_reviewed(s, review).drop("key_features")


@query("collection_review", "samples", "SELECT dimension, value, count(*) FILTER (seq % 3 = 1) AS passed, count(*) FILTER (seq % 3 = 0) AS failed, count(*) FILTER (seq % 3 = 2) AS pending FROM (SELECT seq, unnest(['all', 'db_id', 'chart_type', 'chart_category']) AS dimension, unnest(['all', db_id, chart_type, chart_category]) AS value FROM fx) GROUP BY ALL")
def collection_review(spark, d):
    return collection.review_stats(*_review(spark, d))


@query("collection_histogram", "samples", "SELECT n_samples, count(*) AS n_questions FROM (SELECT source_question_id, count(*) AS n_samples FROM fx GROUP BY 1) GROUP BY 1")
def collection_histogram(spark, d):
    return collection.candidates_histogram(fx(spark, d, "samples"))


@query("collection_pending", "samples", f"SELECT sample_id FROM fx WHERE sample_id NOT IN (SELECT sample_id FROM ({_REVIEW}))")
def collection_pending(spark, d):
    s, review = _review(spark, d)
    return collection.pending_rows(s, review, "sample_id").select("sample_id")


@query("collection_upsert", "runs", "SELECT sample_id, CASE WHEN sample_id % 2 = 0 THEN 99 ELSE best_score END AS best_score FROM fx")
def collection_upsert(spark, d):
    old = fx(spark, d, "runs").select("sample_id", "best_score")
    new = old.where("sample_id % 2 = 0").withColumn("best_score", F.lit(99).cast("long"))
    return collection.upsert(old, new, "sample_id")


@query("collection_restore", "runs", "SELECT sample_id FROM fx WHERE code_renderable AND sample_id % 5 <> 0")
def collection_restore(spark, d):
    old = fx(spark, d, "runs").withColumn("eval_success", F.col("code_renderable"))
    return collection.restore_completed(old, old.where("sample_id % 5 = 0").select("sample_id")).select("sample_id")


@query("sample_last_wins", "samples", "SELECT source_question_id, max(seq) AS seq FROM fx GROUP BY 1")
def sample_last_wins(spark, d):
    return src.last_wins(fx(spark, d, "samples"), "source_question_id", "seq").select("source_question_id", "seq")


@query("sample_compact", "samples", "SELECT sample_id, db_id, chart_type FROM fx WHERE validation_passed")
def sample_compact(spark, d):
    return src.to_compact(src.passed(fx(spark, d, "samples"))).select("sample_id", "db_id", "chart_type")


# --- evaluation

_VIEWS = "code_ok AND code_satisfied AS c, chart_ok AND chart_satisfied AS h, code_ok AND code_satisfied AND chart_ok AND chart_satisfied AS g"
_SCORED = f"""(SELECT sample_id, count(*) AS n_features, count(*) FILTER (must) AS n_must, bool_and(code_ok AND chart_ok) AS valid, count(*) FILTER (c) AS code_pass, count(*) FILTER (c AND must) AS code_must_pass, bool_and(c OR NOT must) AS code_strict,
count(*) FILTER (h) AS chart_pass, count(*) FILTER (h AND must) AS chart_must_pass, bool_and(h OR NOT must) AS chart_strict, count(*) FILTER (g) AS merge_pass, count(*) FILTER (g AND must) AS merge_must_pass, bool_and(g OR NOT must) AS merge_strict
FROM (SELECT *, {_VIEWS} FROM fx) GROUP BY sample_id)"""


@query("eval_samples", "judgments", f"SELECT * FROM {_SCORED}")
def eval_samples(spark, d):
    return evaluation.score_samples(fx(spark, d, "judgments")).drop("failed")


_RATES = ", ".join(f"round(sum({v}_pass) FILTER (valid) / sum(n_features) FILTER (valid), 10) AS {v}_rate, round(sum({v}_must_pass) FILTER (valid) / sum(n_must) FILTER (valid), 10) AS {v}_must_rate, round(count(*) FILTER ({v}_strict AND valid) / count(*), 10) AS {v}_strict_rate" for v in ("code", "chart", "merge"))


@query("eval_dataset", "judgments", f"SELECT count(*) AS evaluated, count(*) FILTER (valid) AS n_valid, {_RATES} FROM {_SCORED}")
def eval_dataset(spark, d):
    out = evaluation.score_dataset(evaluation.score_samples(fx(spark, d, "judgments")))
    return rounded(out, 10, *(c for c in out.columns if c.endswith("_rate")))


@query("eval_breakdown", "judgments", f"SELECT 'parity' AS dimension, (sample_id % 2)::VARCHAR AS value, count(*) AS evaluated, count(*) FILTER (valid) AS n_valid, {_RATES} FROM {_SCORED} GROUP BY sample_id % 2 UNION ALL SELECT 'total', 'all', count(*), count(*) FILTER (valid), {_RATES} FROM {_SCORED}")
def eval_breakdown(spark, d):
    scored = evaluation.score_samples(fx(spark, d, "judgments")).withColumn("parity", F.col("sample_id") % 2)
    out = evaluation.score_breakdown(scored, ["parity"])
    return rounded(out, 10, *(c for c in out.columns if c.endswith("_rate")))


@query("eval_runs", "runs", "SELECT count(*) AS total, count(*) FILTER (code_renderable) AS renderable, round(count(*) FILTER (code_renderable) / count(*), 10) AS renderable_rate, round(avg(best_score) FILTER (best_score <> 0), 8) AS mean_score FROM fx")
def eval_runs(spark, d):
    return rounded(rounded(evaluation.run_summary(fx(spark, d, "runs")), 10, "renderable_rate"), 8, "mean_score")


@query("eval_tokens", "runs", """SELECT sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(coalesce(c, 0))::BIGINT AS completion_tokens, sum(CASE WHEN sample_id % 3 = 0 THEN prompt_tokens + coalesce(c, 0) ELSE prompt_tokens * 2 END)::BIGINT AS total_tokens,
quantile_cont(prompt_tokens, 0.5) AS median_tokens, sum(text_questions_asked)::BIGINT AS questions, sum(best_score % 3)::BIGINT AS vis_questions, count(*) AS runs FROM (SELECT *, CASE WHEN sample_id % 7 > 0 THEN sample_id % 77 END AS c FROM fx)""")
def eval_tokens(spark, d):
    sample = F.col("sample_id")
    more = {"completion_tokens": F.when(sample % 7 > 0, sample % 77), "total_tokens": F.when(sample % 3 > 0, F.col("prompt_tokens") * 2), "vis_questions_asked": F.col("best_score") % 3}
    return traces.token_usage(fx(spark, d, "runs").withColumns(more))


# --- traces


@query("trace_depth", "trace", "SELECT sample_id, node_id, floor(log2(node_id + 1))::INT AS depth FROM fx")
def trace_depth(spark, d):
    return traces.trace_depth(fx(spark, d, "trace"))


_FX = with_fx("trace", "SELECT * FROM fx").removeprefix("WITH fx AS (").removesuffix(") SELECT * FROM fx")
_LEAF = "(sample_id, node_id) NOT IN (SELECT (sample_id, parent_id) FROM fx WHERE parent_id IS NOT NULL)"


@query("trace_rewards", sql=f"""WITH RECURSIVE fx AS ({_FX}), parts AS (SELECT *, greatest(least(node_id % 12, 10), 1)::DOUBLE AS d, greatest(least(length(observation) % 11, 10), 1)::DOUBLE AS v, greatest(least((node_id + 3) % 10, 10), 1)::DOUBLE AS i, (user_score % 8)::DOUBLE AS score FROM fx WHERE {_LEAF}),
earned AS (SELECT *, CASE WHEN score > 0 THEN score / (d * {fixed.REWARD_WEIGHTS['data']} + v * {fixed.REWARD_WEIGHTS['vis']} + i * {fixed.REWARD_WEIGHTS['intent']}) / 10 ELSE 0 END AS k FROM parts),
anc AS (SELECT sample_id, node_id, node_id AS up, parent_id AS nxt, least(d * k, 1) AS d, least(v * k, 1) AS v, least(i * k, 1) AS i FROM earned
UNION ALL SELECT a.sample_id, a.node_id, f.node_id, f.parent_id, a.d, a.v, a.i FROM anc a JOIN fx f ON a.sample_id = f.sample_id AND a.nxt = f.node_id)
SELECT a.sample_id, a.up AS node_id, count(*) AS visits, round(sum(CASE f.action_name WHEN 'execute_sql' THEN d WHEN 'execute_altair' THEN v WHEN 'ask_user_text' THEN i ELSE 0 END)::DOUBLE, 6) + 0 AS total
FROM anc a JOIN fx f ON a.sample_id = f.sample_id AND a.up = f.node_id GROUP BY ALL""")
def trace_rewards(spark, d):
    nodes = fx(spark, d, "trace")
    parts = traces.normalize_reward(F.col("node_id") % 12, F.length("observation") % 11, (F.col("node_id") + 3) % 10, (F.col("user_score") % 8).cast("double"))
    rewards = traces.leaves(nodes).select("sample_id", "node_id", *(c.alias(k) for k, c in parts.items()))
    return rounded(traces.propagate_rewards(nodes, rewards), 6, "total")


_WALK = """walk AS (SELECT sample_id, node_id, action_name AS path, concat(action_name, ': ', shown) AS texts FROM cutt WHERE parent_id IS NULL UNION ALL SELECT c.sample_id, c.node_id, concat(w.path, ' > ', c.action_name), concat(w.texts, chr(10), c.action_name, ': ', c.shown) FROM cutt c JOIN walk w ON c.sample_id = w.sample_id AND c.parent_id = w.node_id)"""
_CUT = "cutt AS (SELECT *, array_to_string(string_split(observation, chr(10))[1:15], chr(10)) AS some, concat(substr(array_to_string(string_split(observation, chr(10))[1:15], chr(10)), 1, 200), CASE WHEN len(string_split(observation, chr(10))) > 15 OR length(array_to_string(string_split(observation, chr(10))[1:15], chr(10))) > 200 THEN '...' ELSE '' END) AS shown FROM fx)"


@query("trace_paths", sql=f"WITH RECURSIVE fx AS ({_FX}), {_CUT}, {_WALK} SELECT sample_id, node_id, path, texts FROM walk WHERE (sample_id, node_id) NOT IN (SELECT (sample_id, parent_id) FROM fx WHERE parent_id IS NOT NULL)")
def trace_paths(spark, d):
    return traces.trace_paths(fx(spark, d, "trace"), text="observation")


@query("trace_tree", sql=f"WITH RECURSIVE fx AS ({_FX}), {_CUT}, way AS (SELECT sample_id, node_id, [node_id] AS way FROM fx WHERE parent_id IS NULL UNION ALL SELECT c.sample_id, c.node_id, list_append(w.way, c.node_id) FROM fx c JOIN way w ON c.sample_id = w.sample_id AND c.parent_id = w.node_id) SELECT sample_id, node_id, (row_number() OVER (PARTITION BY sample_id ORDER BY way) - 1)::INT AS line, concat(repeat('  ', len(way) - 1), '[', node_id, '] ', action_name, ': ', shown) AS shown FROM way JOIN cutt USING (sample_id, node_id)")
def trace_tree(spark, d):
    return traces.trace_tree(fx(spark, d, "trace"), "observation")


_WAYS = "way AS (SELECT sample_id, node_id, [node_id] AS way FROM fx WHERE parent_id IS NULL UNION ALL SELECT c.sample_id, c.node_id, list_append(w.way, c.node_id) FROM fx c JOIN way w ON c.sample_id = w.sample_id AND c.parent_id = w.node_id)"


@query("trace_intervals", sql=f"WITH RECURSIVE fx AS ({_FX}), {_WAYS}, placed AS (SELECT sample_id, node_id, way, row_number() OVER (PARTITION BY sample_id ORDER BY way) - 1 AS enter FROM way), inside AS (SELECT sample_id, unnest(way) AS node_id, enter FROM placed) SELECT sample_id, node_id, (len(way) - 1)::INT AS depth, p.enter, last FROM placed p JOIN (SELECT sample_id, node_id, max(enter) AS last FROM inside GROUP BY ALL) USING (sample_id, node_id)")
def trace_intervals(spark, d):
    return trees.intervals(fx(spark, d, "trace"), ["sample_id"]).select("sample_id", "node_id", "depth", "enter", "last")


# scores for two trees in three, rollouts that tie, code on some nodes, and terminal nodes that aren't leaves
_LEAVES = """SELECT *, node_id % 3 <> 1 AS is_terminal, CASE WHEN sample_id % 3 > 0 AND node_id % 4 < 3 THEN user_score % 4 END AS score, node_id % 3 AS rollout_id, CASE WHEN node_id % 5 = 0 THEN '' WHEN node_id % 5 < 4 THEN concat('c', node_id) END AS code, CASE WHEN node_id % 7 < 4 THEN 'ok' ELSE 'render_fail' END AS internal_status FROM fx"""


@query("trace_best_leaf", sql=f"""WITH RECURSIVE fx AS ({_FX}), {_WAYS}, n AS (SELECT * FROM ({_LEAVES}) JOIN way USING (sample_id, node_id) WHERE is_terminal),
scored AS (SELECT sample_id, node_id, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, rollout_id DESC, way) AS k FROM n WHERE score IS NOT NULL), coded AS (SELECT sample_id, node_id, row_number() OVER (PARTITION BY sample_id ORDER BY way DESC) AS k FROM n WHERE code <> '' AND internal_status = 'ok' AND sample_id NOT IN (SELECT sample_id FROM scored))
SELECT sample_id, node_id FROM scored WHERE k = 1 UNION ALL SELECT sample_id, node_id FROM coded WHERE k = 1""")
def trace_best_leaf(spark, d):
    node, sample = F.col("node_id"), F.col("sample_id")
    nodes = fx(spark, d, "trace").withColumns({
        "is_terminal": node % 3 != 1, "user_score": F.when((sample % 3 > 0) & (node % 4 < 3), F.col("user_score") % 4), "rollout_id": node % 3,
        "code": F.when(node % 5 == 0, "").when(node % 5 < 4, F.concat(F.lit("c"), node)), "internal_status": F.when(node % 7 < 4, "ok").otherwise("render_fail"),
    })
    return traces.best_leaf(nodes).select("sample_id", "node_id")


@query("trace_transitions", "trace", "WITH t AS (SELECT sample_id, node_id, parent_id, CASE WHEN node_id % 7 = 3 THEN 'finish' ELSE action_name END AS action_name FROM fx) SELECT p.action_name AS parent_action, c.action_name, count(*) AS n, p.action_name <> 'finish' AND (c.action_name <> 'finish' OR p.action_name = 'execute_altair') AS allowed FROM t c JOIN t p ON c.sample_id = p.sample_id AND c.parent_id = p.node_id GROUP BY ALL")
def trace_transitions(spark, d):
    nodes = fx(spark, d, "trace").withColumn("action_name", F.when(F.col("node_id") % 7 == 3, "finish").otherwise(F.col("action_name")))
    return traces.action_transitions(nodes)


@query("trace_duplicates", "trace", "SELECT sample_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, parent_id, action_name, CASE WHEN action_name = 'execute_altair' THEN substr(args, 1, 200) ELSE lower(trim(args)) END ORDER BY node_id) AS k FROM (SELECT sample_id, node_id, CASE WHEN parent_id IS NOT NULL THEN 0 END AS parent_id, action_name, left(observation, 1 + (node_id % 2)::INT) AS args FROM fx) WHERE parent_id IS NOT NULL) WHERE k > 1")
def trace_duplicates(spark, d):
    """Over flat trees with short arguments, so that siblings repeat each other."""
    nodes = fx(spark, d, "trace").withColumns({"parent_id": F.when(F.col("parent_id").isNotNull(), 0), "action_args": F.expr("left(observation, 1 + node_id % 2)")})
    return traces.duplicate_actions(nodes).select("sample_id", "node_id")


@query("trace_exploration", "trace", "SELECT c.sample_id, c.node_id, round(c.user_score / 2.0 + 1.4 * sqrt(ln(greatest(coalesce(p.v, 1), 1)) / c.v), 8) AS score FROM (SELECT *, node_id % 4 + 1 AS v FROM fx) c LEFT JOIN (SELECT *, node_id % 4 + 1 AS v FROM fx) p ON c.sample_id = p.sample_id AND c.parent_id = p.node_id")
def trace_exploration(spark, d):
    nodes = fx(spark, d, "trace").withColumn("visits", F.col("node_id") % 4 + 1).withColumn("total", F.col("user_score") * F.col("visits") / 2)
    return rounded(traces.exploration_score(nodes).select("sample_id", "node_id", "score"), 8, "score")


_SAID = "CASE node_id % 5 WHEN 0 THEN concat('SQL ERROR: ', observation) WHEN 1 THEN concat(observation, ' ERROR') WHEN 2 THEN concat('Query returned 0 rows ', observation) WHEN 3 THEN concat(observation, ' FAILED') ELSE replace(replace(observation, 'ERROR', ''), 'FAILED', '') END"


@query("trace_status", "trace", "SELECT sample_id, node_id, CASE WHEN node_id % 11 = 10 THEN 'code_error' WHEN action_name = 'execute_sql' AND node_id % 5 IN (0, 2) THEN 'sql_empty' WHEN action_name = 'execute_altair' AND node_id % 5 IN (0, 1, 3) THEN 'render_fail' ELSE 'ok' END AS status FROM (SELECT * FROM fx WHERE NOT regexp_matches(coalesce(observation, ''), 'ERROR|FAILED')) UNION ALL SELECT sample_id, node_id, 'other' FROM fx WHERE regexp_matches(observation, 'ERROR|FAILED')")
def trace_status(spark, d):
    said = fx(spark, d, "trace").withColumns({"said": F.expr(_SAID), "odd": F.coalesce(F.col("observation").rlike("ERROR|FAILED"), F.lit(False))})
    status = traces.status_of(F.col("action_name"), F.col("said"), F.col("node_id") % 11 == 10)
    return said.select("sample_id", "node_id", F.when(F.col("odd"), "other").otherwise(status).alias("status"))


@query("trace_last_code", sql=f"""WITH RECURSIVE fx AS ({_FX}), walk AS (SELECT sample_id, node_id, node_id AS place, parent_id AS nxt, node_id % 5 = 2 AND node_id % 3 > 0 AS good FROM fx
UNION ALL SELECT w.sample_id, w.node_id, f.node_id, f.parent_id, f.node_id % 5 = 2 AND f.node_id % 3 > 0 FROM walk w JOIN fx f ON w.sample_id = f.sample_id AND w.nxt = f.node_id WHERE NOT w.good) SELECT sample_id, node_id, place AS code_node FROM walk WHERE good""")
def trace_last_code(spark, d):
    node = F.col("node_id")
    nodes = fx(spark, d, "trace").withColumns({"code": F.when(node % 5 == 2, node), "internal_status": F.when(node % 3 > 0, "ok").otherwise("render_fail")})
    return traces.last_valid_code(nodes).select("sample_id", "node_id", F.col("code").alias("code_node"))


# --- catalogues, guidance and bundles


def _catalog(spark, d):
    return src.read_table(spark, d, "part").select(F.col("p_brand").alias("category"), F.col("p_type").alias("chart_type")).distinct()


@query("candidate_catalog", sql="SELECT p_brand AS category, count(DISTINCT p_type) AS n, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS chart_types FROM part GROUP BY 1")
def candidate_catalog(spark, d):
    return candidates.list_charts(_catalog(spark, d))


@query("candidate_sampled")
def candidate_sampled(spark, d):
    return candidates.sample_chart_types(_catalog(spark, d), ["PROMO"], ["Brand#11"], 5, seed=7)


@query("candidate_mapping", "candidates", """SELECT question_id, pos, CASE WHEN dim1 = dim2 OR (pos % 2 <> 0 AND pos % 3 <> 0) THEN dim1 ELSE concat(dim1, ',', dim2) END AS dimensions, measure AS measures,
(3 + (pos % 3 = 0)::INT + 2 * (pos % 2 = 0)::INT + 2 * (pos % 5 = 0)::INT + 2 * (pos % 4 = 1)::INT)::INT AS complexity, pos % 2 = 0 OR pos % 5 = 0 OR pos % 4 = 1 AS advanced FROM fx""")
def candidate_mapping(spark, d):
    some = lambda n, k, c: F.when(F.col("pos") % n == k, c)
    inner = F.struct(F.col("dim1").alias("x"), F.col("measure").alias("y"), some(3, 0, F.concat("dim2", F.lit(" (nominal)"))).alias("color"), F.col("measure").alias("size"))
    more = [some(2, 0, F.struct(F.col("dim2").alias("field"))).alias("facet"), some(5, 0, F.struct(F.col("measure").alias("y"))).alias("secondary_encodings"), some(4, 1, F.array(F.lit("bar"), F.lit("rule"))).alias("layers")]
    m = F.to_json(F.struct(inner.alias("primary_encodings"), *more))
    none = F.array().cast("array<string>")
    # the JSON is a column of its own: what looks into it in many places would else write it anew for each of them
    rows = fx(spark, d, "candidates").select("question_id", "pos", m.alias("mapping"))
    m = F.col("mapping")
    return rows.select("question_id", "pos", F.array_join(candidates.mapping_dimensions(m), ",").alias("dimensions"), F.array_join(candidates.mapping_measures(m), ",").alias("measures"), candidates.mapping_complexity(m).alias("complexity"), candidates.has_advanced_effects(none, m).alias("advanced"))


@query("candidate_required", "candidates", "SELECT question_id, pos, CASE WHEN pos % 4 = 1 THEN 'own' ELSE concat('kf_', pos) END AS id, CASE pos % 3 WHEN 0 THEN 'filter' ELSE 'mark' END AS type, chart_type AS text, pos % 2 = 0 AS must FROM fx WHERE pos % 5 <> 4")
def candidate_required(spark, d):
    pos = F.col("pos")
    one = F.struct(F.when(pos % 4 == 1, "own").alias("id"), F.when(pos % 3 == 0, "Filter").when(pos % 3 == 1, "unknown kind").alias("type"), F.when(pos % 5 == 4, " ").otherwise(F.col("chart_type")).alias("text"), F.when(pos % 2 == 1, False).alias("must"))
    answers = fx(spark, d, "candidates").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("f")))).alias("fs"))
    answers = answers.select("question_id", F.to_json(F.struct(F.transform("fs", lambda x: x["f"]).alias("required_key_features"))).alias("answer"))
    return candidates.parse_required_features(answers, "question_id", "answer").withColumn("pos", F.col("pos").cast("long"))


@query("ambiguity_guidance", "specs", "SELECT spec_id, CASE WHEN p_size % 2 = 0 THEN 'aggregation_missing' ELSE 'chart_type_missing' END AS templates FROM fx")
def ambiguity_guidance(spark, d):
    even = F.col("p_size") % 2 == 0
    profiles = fx(spark, d, "specs").select("spec_id", F.array(F.when(even, "DATA").otherwise("VISUALIZATION")).alias("ambiguity_types"), F.array(F.when(even, "encoding.y.aggregate").otherwise("mark.type")).alias("target_paths"))
    return ambiguity.injection_guidance(profiles, "spec_id").select("spec_id", F.array_join("templates", ",").alias("templates"))


@query("balance_ambiguity", "specs", f"""WITH v AS ({_TEMPLATES}), c AS (SELECT 'ambiguity_templates' AS dimension, template AS value, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT 'ambiguity_types', unnest(['DATA', 'VISUALIZATION', 'INFO_COMPLETION']), unnest([5, 3, 0])),
strong AS (SELECT CASE WHEN count(*) < 10 THEN 0.3 WHEN count(*) < 50 THEN 0.5 ELSE 0.7 END::DOUBLE AS strength FROM fx)
SELECT dimension, coalesce(prefer, '') AS prefer, coalesce(array_to_string(string_split(CASE dimension WHEN 'ambiguity_types' THEN {_OVER.format('ambiguity_types', 10)} ELSE {_OVER.format('ambiguity_templates', 10)} END, ',')[1:2], ','), '') AS avoid, strength
FROM ({_lists('ambiguity_types', fixed.AMBIGUITY_TYPES, '0.5', 2)} UNION ALL {_lists('ambiguity_templates', [t[0] for t in fixed.AMBIGUITY_TEMPLATES], '0.5', 4)}), strong""")
def balance_ambiguity(spark, d):
    """Templates of many specifications, and types of which fewer than ten were used."""
    s = fx(spark, d, "specs")
    counts = ambiguity.valid_templates(s, "spec_id", "spec").groupBy(F.lit("ambiguity_templates").alias("dimension"), F.col("template").alias("value")).agg(F.count("*").alias("n"))
    types = s.limit(1).select(F.lit("ambiguity_types").alias("dimension"), F.inline(F.array(*(F.struct(F.lit(v).alias("value"), F.lit(n).cast("long").alias("n")) for v, n in (("DATA", 5), ("VISUALIZATION", 3), ("INFO_COMPLETION", 0))))))
    return balance.ambiguity_constraints(counts.union(types), spark, total=s.agg(F.count("*").alias("total")))


@query("eval_skip", "judgments", f"SELECT sample_id, CASE WHEN sample_id % 3 = 0 THEN 0 ELSE code_pass END AS code_pass, sample_id % 3 <> 0 AND merge_strict AS merge_strict FROM {_SCORED}")
def eval_skip(spark, d):
    scored = evaluation.score_samples(fx(spark, d, "judgments")).withColumns({"code_renderable": F.col("sample_id") % 3 != 0, "has_prediction": F.lit(True), "has_truth": F.lit(True)})
    return evaluation.skip_rule(scored).select("sample_id", "code_pass", "merge_strict")


@query("collection_statistics", "samples", f"""WITH {_COUNTS}, {_SCORES} SELECT 'distribution' AS section, concat('db_id=', db_id) AS key, count(*)::VARCHAR AS value FROM fx GROUP BY db_id UNION ALL SELECT 'diversity', dimension, round(score, 10)::VARCHAR FROM scores
UNION ALL SELECT 'summary', unnest(['instances', 'attempted', 'succeeded', 'success_rate']), unnest([count(DISTINCT source_question_id)::VARCHAR, count(*)::VARCHAR, (count(*) FILTER (validation_passed))::VARCHAR, printf('%.1f%%', count(*) FILTER (validation_passed) * 100.0 / count(*))]) FROM fx""")
def collection_statistics(spark, d):
    samples = fx(spark, d, "samples")
    outcomes = collection.question_outcomes(samples.select(F.col("source_question_id").alias("question_id"), F.col("validation_passed").alias("success"), F.lit("rejected").alias("error")))
    return collection.build_statistics(outcomes, samples, ["db_id"], balance.diversity_report(_counts(spark, d)))


@query("collection_pending_runs", "runs", "SELECT sample_id FROM fx WHERE NOT code_renderable OR sample_id % 4 = 0")
def collection_pending_runs(spark, d):
    runs = fx(spark, d, "runs")
    return collection.pending_runs(runs, runs.where("code_renderable"), runs.where("sample_id % 4 = 0").select("sample_id")).select("sample_id")


@query("collection_fill", "runs", "SELECT sample_id, best_score, prompt_tokens % 7 AS ground_truth FROM fx")
def collection_fill(spark, d):
    runs = fx(spark, d, "runs")
    dataset = runs.select("sample_id", (F.col("prompt_tokens") % 7).alias("ground_truth"), F.lit(-1).alias("best_score"))
    return collection.fill_from_dataset(runs.select("sample_id", "best_score"), dataset, "sample_id", ["ground_truth", "best_score"])
