"""Semantics on literal rows: nulls, ties, empty groups, golden numbers."""

import json
import math
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from loomframe.functions import fixed, text
from loomframe.operators import ambiguity, balance, candidates, chartops, collection, evaluation, profiling, quality, recipes, shaping, specs, traces
from loomframe.plans import fixtures, registry
from loomframe.sources import tables as src
from loomframe.streaming import streams


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_group_rank_averages_ties(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("a", 20.0), ("a", 30.0), ("a", None), ("b", 1.0)], "k string, v double")
    got = sorted(values(shaping.group_rank(df, ["k"], "v"), "k", "v", "rank"), key=str)
    assert sorted(r for k, v, r in got if k == "a" and v is not None) == [1.0, 2.5, 2.5, 4.0]
    assert [r for k, v, r in got if v is None] == [None]


def test_rolling_mean_waits_for_n(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 5)], "t int, v double").withColumn("k", F.lit(1))
    assert [r for _, r in sorted(values(shaping.rolling_mean(df, ["k"], ["t"], "v", 3), "t", "rolling"))] == [None, None, 2.0, 3.0]


def test_casts_and_maps(spark):
    df = spark.createDataFrame([("2024-01-02", "7"), ("bad", "x"), (None, None)], "d string, n string")
    got = values(shaping.cast(shaping.to_datetime(df, "d"), "n", "int"), F.col("d").isNull(), "n")
    assert got == [(False, 7), (True, None), (True, None)]
    assert [r[0] for r in values(shaping.map_values(df, "n", {"7": "seven"}), "n")] == ["seven", None, None]


def test_nice_bins(spark):
    df = spark.createDataFrame([(0.0,), (99.0,), (None,)], "v double")
    assert {(r.bin_start, r.bin_end) for r in chartops.t_bin(df, "v").where("v is not null").collect()} == {(0.0, 10.0), (90.0, 100.0)}
    same = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert {r.bin_start for r in chartops.t_bin(same, "v").collect()} == {5.0}


def test_quadratic_fit_recovers_coefficients(spark):
    df = spark.createDataFrame([(float(x), 3.0 + 2.0 * x - 0.5 * x * x) for x in range(20)], "x double, y double").withColumn("k", F.lit("a"))
    r = chartops.t_regression(df, "x", "y", ["k"], 2).first()
    assert math.isclose(r.c0, 3, abs_tol=1e-6) and math.isclose(r.c1, 2, abs_tol=1e-6) and math.isclose(r.c2, -0.5, abs_tol=1e-7)


def test_loess_follows_a_line(spark):
    df = spark.createDataFrame([(float(x), 1.0 + 4.0 * x) for x in range(50)] + [(3.0, None), (None, 2.0)], "x double, y double").withColumn("k", F.lit("a"))
    for r in chartops.t_loess(df, "x", "y", ["k"]).collect():
        assert math.isclose(r.y, 1 + 4 * r.x, abs_tol=1e-6)


def test_density_sums_to_one(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (5.0,), (10.0,), (None,)], "v double").withColumn("k", F.lit("a"))
    rows = sorted(values(recipes.r_density(df, "v", ["k"], 0.5, 200), "x", "density"))
    assert 0.6 < sum(d for _, d in rows) * (rows[1][0] - rows[0][0]) < 1.0


def test_column_semantics(spark):
    rows = [("updated_by", "text", "temporal"), ("order_id", "integer", "identifier"), ("zip_code", "text", "identifier"), ("zip_code", "integer", "numeric"), ("name", "text", "categorical"), ("b", "blob", "categorical")]
    df = spark.createDataFrame(rows, "name string, kind string, want string")
    assert all(a == b for a, b in values(df, profiling.column_semantics(F.col("name"), F.col("kind")), "want"))


def test_table_groups(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a int, b int")
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 6)], "n int")
    assert sorted(values(profiling.table_groups(edges, nodes), "group_id", "members")) == [(1, [1, 2, 3]), (4, [4]), (5, [5, 6])]


def test_json_safe(spark):
    df = spark.createDataFrame([(float("nan"), "a\u0007b", None), (float("inf"), "", None), (1.5, None, None)], "v double, s string, t timestamp_ntz")
    assert values(src.json_safe(df), "v", "s") == [(None, "ab"), (None, None), (1.5, None)]
    days = spark.sql("select timestamp_ntz'2024-01-02' as t union all select null")
    assert sorted(values(src.json_safe(days), "t"), key=str) == [("2024-01-02",), (None,)]


def test_sql_errors(spark):
    assert src.check_sql(spark, "select 1") == (True, None)
    assert src.check_sql(spark, "select * from no_such_table")[1].startswith("not found")
    assert src.run_sql_with_error(spark, "selec 1")[1].startswith("SQL error")
    assert src.run_sql_safe(spark, "selec 1") is None and src.preview_sql(spark, "select explode(sequence(1, 9))").count() == 5


def test_declared_schema_and_samples(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"db_id": "d", "table_names_original": ["a", "b"], "column_names_original": [[-1, "*"], [0, "id"], [0, "x"], [1, "aid"]], "column_types": ["text", "integer", "text", "integer"], "primary_keys": [1, [2, 3]], "foreign_keys": [[3, 1], [2]]}]')
    columns, keys = src.read_declared_schema(spark, str(tmp_path / "s.json"))
    assert sorted(values(columns, "table_name", "ordinal", "name", "is_primary_key", "is_foreign_key")) == [("a", 0, "id", True, False), ("a", 1, "x", True, False), ("b", 0, "aid", True, True)]
    assert values(keys, "from_table", "from_column", "to_table", "to_column") == [("b", "aid", "a", "id")]
    (tmp_path / "q.json").write_text('[{"question_id": 1, "SQL": "select 1"}, {"question_id": "x"}]')
    assert values(src.read_questions(spark, str(tmp_path / "q.json")), "question_id", "gold_sql") == [(1, "select 1")]
    (tmp_path / "x.json").write_text('[{"sample_id": "a", "n": 1}, {"sample_id": "b", "n": 2}, {"sample_id": "a", "n": 3}]')
    samples = src.read_samples(spark, str(tmp_path / "x.json"))
    assert sorted(values(samples, "sample_id", "n")) == [("a", 3), ("b", 2)]
    assert src.get_sample(samples, "b").first().n == 2
    with pytest.raises(KeyError):
        src.get_sample(samples, "c")
    src.write_samples(samples.withColumn("validation_passed", F.col("n") == 3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


SPEC = '{"mark":{"type":"arc","innerRadius":5},"encoding":{"x":{"field":"a","type":"nominal","bin":true},"y":{"aggregate":"sum"}},"transform":[{"filter":"x"}],"params":[{"select":{"type":"interval"}},{"bind":"legend"}],"layer":[{"mark":"rule"}],"n":1}'


def test_feature_checks(spark):
    df = spark.createDataFrame([("s", SPEC)], "id string, spec string")
    tests = [("mark.type", "eq", '"arc"', True), ("n", "eq", "1.0", True), ("no.path", "exists", None, False), ("no.path", "eq", "1", False), ("layer", "len_ge", "1", True), ("layer", "len_le", "0", False), ("encoding.x.type", "in", '["nominal"]', True), ("encoding.x.type", "in", None, False), ("encoding.x.field", "contains", '"a"', True), ("encoding", "contains", '"x"', False)]
    features = spark.createDataFrame([("s", p, o, v, w) for p, o, v, w in tests], "id string, path string, op string, value string, want boolean")
    for r in specs.check_features(df, features, "id", "spec").collect():
        assert r.satisfied == r.want, r
    lenient = {(r.path, r.op): r.satisfied for r in specs.check_features(df, features, "id", "spec", lenient=True).collect()}
    assert lenient["no.path", "eq"] and not lenient["no.path", "exists"]


def test_spec_features(spark):
    df = spark.createDataFrame([("s", SPEC), ("e", "{}")], "id string, spec string")
    got = {r.path for r in specs.spec_features(df, "id", "spec").collect()}
    assert got == {"mark.type", "encoding.x.field", "encoding.x.type", "encoding.x.bin", "encoding.y.aggregate", "transform", "transform[0].filter", "layer", "params", "params[0].select.type", "params[1].bind"}
    contract = {(r.path, r.op) for r in specs.contract_features(df, "id", "spec").collect()}
    assert ("encoding.x.field", "exists") in contract and ("mark.innerRadius", "exists") in contract
    assert sorted(values(specs.interaction_types(df, "id", "spec"), "id", "interaction")) == [("e", "none"), ("s", "brush"), ("s", "legend")]
    assert values(df, specs.interaction_valid(F.col("spec"))) == [(True,), (False,)]


def test_golden_diversity(spark):
    counts = {"encoding_patterns": [4, 1], "aggregations": [1] * 6 + [0] * 3, "time_units": [1] * 6 + [0] * 3, "transforms": [1] * 7 + [0] * 3, "compositions": [6, 1, 1, 1, 1], "interactions": [5, 1, 1], "domains": [6]}
    want = {"encoding_patterns": 0.7219280948873623, "aggregations": 0.8154648767857288, "time_units": 0.8154648767857288, "transforms": 0.8450980400142569, "compositions": 0.7627069065377662, "interactions": 0.72483409150576, "domains": 0.0}
    df = spark.createDataFrame([(d, f"v{i}", n) for d, ns in counts.items() for i, n in enumerate(ns)], "dimension string, value string, n long")
    scores = balance.diversity_score(df)
    assert {r.dimension: pytest.approx(r.score) for r in scores.collect()} == want
    assert balance.overall_diversity(scores).first().overall == pytest.approx(0.6693566980738004)
    assert {r.value for r in balance.underrepresented(df.where("dimension = 'aggregations'")).collect()} == {"v6", "v7", "v8"}


def test_ledger_is_undone(spark):
    counts = spark.createDataFrame([("a", "x", 2), ("a", "y", 0)], "dimension string, value string, n long")
    ledger = balance.reserve(counts.select("dimension", "value"), "r")
    undone = ledger.union(balance.rollback(ledger, "r"))
    assert sorted(values(balance.with_ledger(counts, undone), "value", "n")) == [("x", 2), ("y", 0)]


def test_golden_evaluation(spark):
    rows = [("s", 0, "A", True, True, True, True, True), ("s", 1, "B", True, True, True, True, False), ("s", 2, "C", False, True, False, True, True), ("s", 3, "D", False, False, True, True, True)]
    df = spark.createDataFrame(rows, "sample_id string, feature_pos int, feature_id string, must boolean, code_ok boolean, code_satisfied boolean, chart_ok boolean, chart_satisfied boolean")
    r = evaluation.score_samples(df).first()
    assert (r.code_pass, r.code_must_pass, r.code_strict, r.failed) == (2, 2, True, "3")
    assert (r.chart_pass, r.chart_must_pass, r.chart_strict) == (3, 1, False)
    assert (r.merge_pass, r.merge_must_pass, r.merge_strict, r.valid) == (1, 1, False, False)
    total = evaluation.score_dataset(evaluation.score_samples(df)).first()
    assert total.evaluated == 1 and total.n_valid == 0 and total.code_rate == 0.0


def test_expand_judgments(spark):
    samples = spark.sql("select 's' as sample_id, array(named_struct('id', 'a', 'type', 'mark', 'must', cast(null as boolean)), named_struct('id', 'b', 'type', 'mark', 'must', false)) as key_features")
    judged = spark.createDataFrame([("s", "code", "a", True, True)], "sample_id string, view string, feature_id string, satisfied boolean, eval_success boolean")
    got = sorted(values(evaluation.expand_judgments(samples, judged), "feature_id", "must", "code_satisfied", "code_ok", "chart_ok"))
    assert got == [("a", True, True, True, False), ("b", False, False, False, False)]


def test_weights(spark):
    valid = spark.createDataFrame([("s", t) for t in ("aggregation_missing", "topk_missing", "chart_type_missing", "x1", "x2", "x3", "x4", "x5", "x6", "x7")], "id string, template string")
    usage = spark.createDataFrame([("topk_missing", 3)], "template string, n long")
    w = {r.template: r.weight for r in ambiguity.template_weights(valid, "id", usage, ["aggregation_missing"], ["chart_type_missing"], 0.5, seed=None).collect()}
    assert w["aggregation_missing"] == 1.75 and w["topk_missing"] == 0.25 and w["chart_type_missing"] == pytest.approx(0.55)
    picked = ambiguity.weighted_pick(ambiguity.template_weights(valid, "id", usage, [], [], 0.5), "id")
    assert picked.count() == 3 and picked.select("template").distinct().count() == 3


def test_difficulty_order(spark):
    picked = spark.createDataFrame([("s", "field_name_error"), ("s", "chart_type_missing")], "id string, template string")
    assert ambiguity.ambiguity_profile(picked, "id").first().difficulty == "hard"
    assert ambiguity.ambiguity_profile(picked, "id", literal=True).first().difficulty == "medium"


def test_select_diverse(spark):
    rows = [(1, 0, "bar", "Bar", ["a"], 0.0), (1, 1, "bar", "Bar", ["a"], 0.0), (1, 2, "pie", "Pie", ["b"], 3.0), (2, 0, "bar", "Bar", [], 0.0)]
    df = spark.createDataFrame(rows, "question_id long, pos long, chart_type string, chart_category string, dimensions array<string>, complexity double").withColumns({"measures": F.col("dimensions"), "tables_needed": F.col("dimensions"), "feature_types": F.col("dimensions"), "aggregation": F.lit("SUM"), "vis_intent_type": F.lit("trend")})
    got = sorted(values(candidates.select_diverse(df, 2), "question_id", "pos", "taken"))
    assert got == [(1, 0, 0), (1, 2, 1), (2, 0, 0)]


def test_similar_types_and_ids(spark):
    df = spark.createDataFrame([(0, "pie_chart"), (1, "donut_chart"), (2, "other"), (3, "scatter_plot")], "pos int, chart_type string")
    assert sorted(r.chart_type for r in candidates.dedupe_similar(df).collect()) == ["other", "pie_chart", "scatter_plot"]
    old = spark.createDataFrame([("q7_c4", 7)], "sample_id string, source_question_id long")
    new = candidates.assign_candidate_ids(spark.createDataFrame([(7, 0), (8, 0)], "question_id long, pos int"), old)
    assert sorted(r.candidate_id for r in new.collect()) == ["q7_c5", "q8_c0"]


def test_renumbering(spark):
    samples = spark.createDataFrame([("q1473_c0", 1473), ("q1473_c1", 1473), ("q1473_c2", 1473)], "sample_id string, source_question_id long")
    review = spark.createDataFrame([("q1473_c0", "pass"), ("q1473_c1", "fail"), ("q1473_c2", "pass")], "sample_id string, status string")
    assert sorted(r.sample_id for r in collection.finalize_reviewed(samples, review).collect()) == ["q1473_c0", "q1473_c1"]


def test_trace_tree(spark):
    nodes = spark.createDataFrame([("s", 0, None, "root", 1), ("s", 1, 0, "execute_sql", 5), ("s", 2, 1, "execute_altair", 9), ("s", 3, 2, "finish", 9), ("s", 4, 0, "finish", 2)], "sample_id string, node_id long, parent_id long, action_name string, user_score int")
    assert dict(values(traces.trace_depth(nodes), "node_id", "depth")) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 1}
    assert dict(values(traces.trace_paths(nodes), "node_id", "path"))[3] == "root > execute_sql > execute_altair > finish"
    assert {(r.parent_action, r.action_name): r.allowed for r in traces.action_transitions(nodes).collect()}["root", "finish"] is False


def test_quality(spark):
    df = spark.createDataFrame([("a", -1.0), ("b", 2.0), ("c", None)], "k string, v double")
    r = quality.validate_data(df, "pie_chart").first()
    assert r.n_rows == 3 and "Too few rows" in r.issues and "pie chart has negative values in v" in r.issues and not r.passed
    assert quality.validate_data(df.limit(0), "bar").first().issues == ["Data is empty"]


def test_text(spark):
    df = spark.createDataFrame([("Show 'big deal' for Alpha and The beta",), ("",), (None,)], "t string")
    assert values(df, text.key_entities(F.col("t")))[0][0] == ["big deal", "Alpha"]
    one = lambda c, s: spark.createDataFrame([(s,)], "t string").select(c(F.col("t")).alias("x")).first().x
    assert one(text.extract_json, 'noise {"a": 1} noise') == '{"a":1}' and one(text.extract_json, "nothing") is None
    assert one(text.clean_sql, "```sql\nnote SELECT 1\n```") == "SELECT 1"
    assert one(text.clean_question, '"what now"') == "What now?"
    assert one(text.drop_limit1, "select 1 LIMIT 1;") == "select 1" and one(text.expand_limit, "select 1") == "select 1 LIMIT 20"
    assert one(text.feedback_score, "Score: 99") == 10 and one(text.feedback_score, "none") is None


def test_flatten_spec_at_any_depth(spark):
    steps = ["layer", "0"] * 9
    deep = '{"layer":[' * 9 + '"bar"' + "]}" * 9
    df = spark.createDataFrame([("deep", deep), ("flat", '{"mark":"bar"}'), ("none", None)], "k string, s string")
    got = {(r.k, r.path): r.value for r in specs.flatten_spec(df, "k", "s").collect()}
    assert got.keys() == {("flat", "mark"), *(("deep", ".".join(steps[: n + 1])) for n in range(len(steps)))}
    assert got["deep", ".".join(steps)].strip('"') == "bar"
    wanted = spark.createDataFrame([("deep", ".".join(steps), "exists", None), ("deep", ".".join([*steps, "0"]), "exists", None)], "k string, path string, op string, value string")
    assert {r.path.count("."): r.satisfied for r in specs.check_features(df, wanted, "k", "s").collect()} == {17: True, 18: False}


@pytest.mark.parametrize(("mode", "batches"), [("append", 0), ("append", 3), ("complete", 0), ("complete", 3), ("update", 3)])
def test_streams_end_in_files(spark, tmp_path, mode, batches):
    folder, state = f"{tmp_path}/in", f"{tmp_path}/out"
    (tmp_path / "in").mkdir()
    for k in range(batches):
        spark.createDataFrame([(i, 0.5) for i in range(4 + k)], "k long, x double").coalesce(1).write.mode("append").parquet(folder)
    df = streams.read_stream(spark, folder, "k long, x double", 1)
    out = streams.run_to_end(df if mode == "append" else df.groupBy("k").agg(F.sum("x").alias("x")), f"ends_{mode}_{batches}", state, mode)
    assert out.columns == ["k", "x"]
    got = sorted((r.k, r.x) for r in out.collect())
    if mode == "append":
        assert got == sorted((i, 0.5) for k in range(batches) for i in range(4 + k))
    else:
        last = {i: 0.5 * sum(i < 4 + k for k in range(batches)) for i in range(4 + batches - 1 if batches else 0)}
        assert dict(got) == last and (mode == "update" or len(got) == len(last))
    # executors wrote the table: nothing was held in the driver
    assert all(f"{state}/table/" in f for f in out.inputFiles()) and bool(out.inputFiles()) == bool(batches)


def test_fixed_values():
    assert len(fixed.AMBIGUITY_TEMPLATES) == 14 and len(fixed.FAILURE_CODES) == 8 and len(fixed.DATA_REQUIREMENTS) == 11
    assert sum(fixed.REWARD_WEIGHTS.values()) == pytest.approx(1)


def test_sql_and_catalogue(spark, sf, tmp_path):
    src.load_tables(spark, sf, ("region", "nation"))
    assert src.run_sql(spark, "SELECT * FROM nation", 3).count() == 3 and src.run_sql(spark, "SELECT r_name FROM region").columns == ["r_name"]
    assert {"region", "nation"} <= {r.name for r in src.list_tables(spark).collect()}
    for name in ("b", "a"):
        spark.range(3).write.parquet(f"{tmp_path}/{name}.parquet")
    assert [r.db_id for r in src.list_databases(spark, str(tmp_path)).collect()] == ["a", "b"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "x", True), (1, "y", None), (3, "z", False)], "sample_id long, data string, validation_passed boolean")
    src.write_statistics(rows, f"{tmp_path}/stats")
    assert sorted(r.data for r in src.read_statistics(spark, f"{tmp_path}/stats", "sample_id long, data string").collect()) == ["x", "y", "z"]
    for _ in range(2):
        src.write_run_results(rows, f"{tmp_path}/runs")
    assert [r.sample_id for r in spark.read.json(f"{tmp_path}/runs").orderBy("sample_id").collect()] == [1, 2, 3]
    for _ in range(2):
        collection.append_samples(rows, f"{tmp_path}/samples")
    assert sorted(r.sample_id for r in spark.read.parquet(f"{tmp_path}/samples").collect()) == [1, 1, 2, 2]
    assert src.to_export(rows).columns == src.EXPORT and src.to_full(rows).columns[: len(src.COMPACT)] == src.COMPACT
    assert {r.vis_intent_type for r in src.to_export(rows).collect()} == {None}


def test_chart_catalogue_and_feature_types(spark, tmp_path):
    for name in ("Bars/simple", "Bars/_hidden", "Lines/multi"):
        path = tmp_path / f"{name}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text("{}")
    assert sorted(values(candidates.chart_catalog(spark, str(tmp_path)), "category", "chart_type")) == [("Bars", "simple"), ("Lines", "multi")]
    df = spark.createDataFrame([(["Mark: bar", "no kind", "mark:line", " Filter : x"],), ([],)], "f array<string>")
    assert [r[0] for r in values(df.select(candidates.feature_type_set(F.col("f")).alias("s")), "s")] == [["mark", "filter"], []]


def test_strengths_checks_and_judgments(spark):
    df = spark.createDataFrame([(0,), (9,), (10,), (49,), (50,)], "n int")
    assert [r[0] for r in values(df.select(balance.constraint_strength(F.col("n")).alias("s")), "s")] == [0.3, 0.3, 0.5, 0.5, 0.7]
    pies = spark.createDataFrame([("a", 1.0), ("b", -2.0)], "k string, v double")
    found = {kind: quality.chart_requirements(df_, kind).first().issues for kind, df_ in (("Donut", pies), ("pie", pies.where("v > 0")), ("histogram", pies.select("k")), ("Scatter plot", pies), ("bar", pies))}
    assert found == {"Donut": ["pie chart has negative values in v"], "pie": ["pie chart has too few categories"], "histogram": ["histogram needs a numeric column"], "Scatter plot": ["scatter plot needs two numeric columns"], "bar": []}
    samples = spark.createDataFrame([(1, "[1]", "{ }"), (2, " ", "{ }"), (3, None, "{ }"), (4, "[1]", None)], "id int, data string, vega_lite_spec string")
    assert [r.id for r in quality.basic_sample_check(samples).collect()] == [1]
    both = spark.createDataFrame([(a, b) for a in (True, False) for b in (True, False)], "a boolean, b boolean").select(evaluation.merge_satisfied(F.col("a"), F.col("b")).alias("m"))
    assert [r.m for r in both.collect()] == [True, False, False, False]


def test_texts_of_queries_and_code(spark):
    one = spark.createDataFrame([("```sql\nHere: select a, SUM(b) from t where x > 1 group by a\n```",), ("no statement",), (None,)], "s string")
    assert [r[0] for r in values(one.select(text.clean_sql(F.col("s")).alias("s")), "s")] == ["select a, SUM(b) from t where x > 1 group by a", "", None]
    code = spark.createDataFrame([("say\n```python\nx = 1\n```\nend",), ("```\ny = 2\n```",), (" z = 3 ",)], "s string")
    assert [r[0] for r in values(code.select(text.clean_code(F.col("s")).alias("s")), "s")] == ["x = 1", "y = 2", "z = 3"]
    said = values(spark.createDataFrame([("SELECT a, SUM(b) FROM t WHERE x > 1 GROUP BY a ORDER BY a",), ("SELECT 1",)], "s string").select(text.intent_text(F.col("s")).alias("s")), "s")
    assert said[0][0].startswith("tables: t; ") and "grouped by: a" in said[0][0] and "filters: x > 1" in said[0][0] and said[1][0] == ""


def test_paths_of_any_depth(spark):
    deep = {"leaf": None, "list": [1, "two", {"x": [5]}]}
    for k in "kjihgfedcb":
        deep = {k: deep}
    spec = spark.createDataFrame([(1, json.dumps({"a": deep})), (2, "{}")], "id int, spec string")
    path = ".".join("abcdefghijk")
    wanted = [("list", "len_ge", "3"), ("list.2.x.0", "eq", "5"), ("list[2].x[0]", "eq", "5"), ("list.1", "in", '["two"]'), ("leaf", "exists", None), ("list", "contains", '"two"')]
    features = spark.createDataFrame([(i, f"{path}.{p}", op, v) for i in (1, 2) for p, op, v in wanted], "id int, path string, op string, value string")
    got = {(r.id, r.path): r.satisfied for r in specs.check_features(spec, features, "id", "spec").collect()}
    assert [got[1, f"{path}.{p}"] for p, *_ in wanted] == [True, True, True, True, False, True] and not any(v for (i, _), v in got.items() if i == 2)
    assert {(r.id, r.ok, len(r.missing)) for r in specs.feature_violations(spec.union(spark.createDataFrame([(3, "{}")], spec.schema)), features, "id", "spec").collect()} == {(1, False, 1), (2, False, 6), (3, True, 0)}
    assert specs.flatten_spec(spec, "id", "spec").where(F.col("path") == f"{path}.list.2.x.0").first().value == "5"


def test_long_chain_is_one_group(spark):
    n = 700
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(n + 5, n + 5)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(n + 1)] + [(n + 5,)], "node long")
    assert values(profiling.table_groups(edges, nodes, members=False), "group_id", "size", "n_links") == [(0, n + 1, n), (n + 5, 1, 0)]
    assert [len(r.members) for r in profiling.table_groups(edges, nodes).collect()] == [n + 1, 1]


def test_preview_of_sparse_columns(spark, monkeypatch):
    monkeypatch.setattr(profiling, "HEAD_ROWS", 5)
    rows = spark.createDataFrame([(i, f"v{i}", f"late{i}" if i > 90 else None, None) for i in range(100)], "id int, a string, b string, c string")
    assert {r.column: r["values"] for r in profiling.column_preview(rows, "id").collect()} == {"id": "0|1|2", "a": "v0|v1|v2", "b": "late91|late92|late93"}


def test_reports_texts_are_cut(spark):
    rows = spark.createDataFrame([("x" * 201,), ("y" * 200,), ("\n".join(map(str, range(16))),), (None,)], "t string")
    assert [r[0] for r in values(rows.select(traces.shown_text(F.col("t")).alias("s")), "s")] == ["x" * 200 + "...", "y" * 200, "\n".join(map(str, range(15))) + "...", ""]


def chained(*values_):
    """Spark's hash of 64 bits over columns: each is hashed with the hash before as seed."""
    h = 42
    for v in values_:
        data = v.encode() if isinstance(v, str) else int(v).to_bytes(4, "little", signed=True) if isinstance(v, int) and abs(v) < 1 << 31 else v
        h = xxhash.xxh64(data, seed=h).intdigest()
    return h - (1 << 64) if h >= 1 << 63 else h


def test_seeded_picks_by_brute_force(spark):
    weights = {(f"s{i}", f"t{j}"): 0.1 + (i * j % 7) for i in range(40) for j in range(6)}
    df = spark.createDataFrame([(k, t, w) for (k, t), w in weights.items()], "id string, template string, weight double")
    got = {(r.id, r.place): r.template for r in ambiguity.weighted_pick(df, "id", 3, seed=5).collect()}
    for i in range(40):
        key = f"s{i}"
        draw = {t: (-math.log((chained(key, t, 5, "pick") % (1 << 30) + 1) / ((1 << 30) + 1)) / w, t) for (k, t), w in weights.items() if k == key}
        assert [got[key, p] for p in (1, 2, 3)] == sorted(draw, key=draw.get)[:3]
    types = [(f"cat{i % 4}", f"type {i}") for i in range(30)] + [("cat0", "pie_chart"), ("cat1", "donut_chart")]
    catalog = spark.createDataFrame(types, "category string, chart_type string")
    preferred, categories = ["type 3", "type 8", "type 20"], ["cat2", "cat1"]
    order = sorted(types, key=lambda x: (chained(x[1], 7), x[1]))
    liked = [x for x in order if x[1] in preferred][:2]
    firsts = [next(x for x in order if x[0] == c) for c in categories]
    stage = {x: 0 if x in liked else 1 if x in firsts else 2 for x in order}
    want, alike = [], set()
    for x in sorted(order, key=lambda x: stage[x]):
        group = next((i for i, g in enumerate(fixed.SIMILAR_TYPES) if x[1] in g), x[1])
        if group not in alike:
            alike.add(group)
            want.append(x)
    assert values(candidates.sample_chart_types(catalog, preferred, categories, 5, seed=7), "category", "chart_type") == want[:5]


def test_points_lose_spaces_and_no_digits(spark):
    df = spark.createDataFrame([("  a point of evidence \n1219538112535716 1; 2 third point 2　",)], "t string")
    assert df.select(text.evidence_points(F.col("t"))).first()[0] == ["a point of evidence", "1219538112535716 1", "2 third point 2"]


def test_conditions_keep_their_digits(spark):
    df = spark.createDataFrame([("SELECT a FROM t WHERE 0 = x AND y > 11 AND z = 2", '{"candidates":[{"tables_needed":"0t, 1t1"}]}')], "s string, j string")
    assert df.select(text.sql_clauses(F.col("s"))["filters"]).first()[0] == ["0 = x", "y > 11", "z = 2"]
    assert candidates.parse_candidates(df, "s", "j").first().tables_needed == ["0t", "1t1"]


def test_quantiles_in_range_parts(spark):
    rng = random.Random(3)
    a, b = [float(rng.randrange(40)) for _ in range(57)], [rng.random() for _ in range(57)]
    df = spark.createDataFrame([*zip(a, b), (None, 0.5)], "a double, b double").repartition(5)
    got = recipes.r_qq(df, "a", "b").orderBy("p")
    assert "percentile(" not in got._jdf.queryExecution().toString()
    probs = [k / 20 for k in range(21)]
    want = df.agg(F.percentile("a", probs), F.percentile("b", probs)).first()
    assert [r.qa for r in got.collect()] == pytest.approx(want[0]) and [r.qb for r in got.collect()] == pytest.approx(want[1])
    assert [tuple(r)[1:] for r in recipes.r_qq(df.where("false"), "a", "b", 2).collect()] == [(None, None)] * 3


def test_specs_are_dealt_over_all_cores(spark, sf):
    rows = spark.range(0, 1000, 1, 1).toDF("k")
    assert src.spread(rows, "k").rdd.getNumPartitions() == 4 and src.spread(rows, "k", 100).rdd.getNumPartitions() == 10
    assert src.spread(rows, "k").distinct().count() == 1000
    assert fixtures.fx(spark, sf, "specs").rdd.getNumPartitions() >= 4


def test_mapping_is_written_once_a_row(spark, sf):
    plan = registry.QUERIES["candidate_mapping"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("to_json(") <= 1


def test_violations_parse_a_specification_before_its_demands(spark):
    docs = spark.createDataFrame([(1, "t", '{"mark":"bar"}'), (2, "t", '{"mark":{"type":"arc"}}'), (3, "u", "no JSON")], "id int, kind string, spec string")
    wanted = spark.createDataFrame([("t", "mark.type", "eq", "arc"), ("t", "mark", "exists", None), ("u", "mark", "exists", None)], "chart_type string, path string, op string, value string")
    found = specs.contract_violations(docs, wanted, "id", "kind", "spec")
    assert sorted(values(found, "id", "path")) == [(1, "mark.type"), (3, "mark")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_picks_lower_once(spark, monkeypatch):
    """Letter case and repeated elements count for nothing, by hand; what is compared is lowered before the rounds."""
    row = lambda pos, kind, dims, measures=("m",): (1, pos, "C", kind, list(dims), list(measures), ["t"], None, "trend", [], 1.0)
    rows = [row(0, "Bar", ["A", "b", "a"]), row(1, "bar", ["B", "A"]), row(2, "line", ["b"]), row(3, "LINE", ["B", "b"]), row(4, "area", ["x"], ("n", "M"))]
    names = "question_id long, pos long, chart_category string, chart_type string, dimensions array<string>, measures array<string>, tables_needed array<string>, aggregation string, vis_intent_type string, feature_types array<string>, complexity double"
    frame = spark.createDataFrame(rows, names)
    picks = candidates.diverse_picks(frame, 3)
    assert sorted(values(picks, "pos", "taken", "diversity_score")) == [(0, 0, 0.0), (2, 2, 1.75), (4, 1, 3.0)]
    plans, stored = [], candidates._stored
    monkeypatch.setattr(candidates, "_stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, name))
    assert len(candidates.select_diverse(frame, 3).columns) == len(frame.columns) + 2
    rounds = [p for p in plans if "max_by" in p]
    assert rounds and not any("lower(" in p or "array_union" in p for p in rounds)
    pairs = {(r.pos_a, r.pos_b): r.distance for r in candidates.candidate_distance(frame).collect()}
    assert pairs[0, 1] == pairs[2, 3] == 0.0 and pairs[0, 4] == 3.0 and pairs[0, 2] == 1.75


def test_mapping_is_read_once_for_all_paths(spark):
    """The same texts as by get_json_object, path by path, on odd mappings; each mapping is read as JSON once."""
    rows = [
        '{"primary_encodings":{"x":"a (n)","y":"b","color":"a"},"facet":{"field":" f "}}', '{"primary_encodings":{"x":1.50,"y":1e3,"color":-2,"row":true,"column":null,"facet":""}}', '{"primary_encodings":{"x":{"field": "a"},"y":["b", 1]}}',
        '{"primary_encodings":{"x":"first","x":"second"}}', '{"primary_encodings":{"x":"cut"', '{"primary_encodings":{"x":"a"},', '{"primary_encodings":"x","facet":"y"}', "{'primary_encodings':{'x':'a'}}", "{}", "", "null", None, "[1]", '"x"',
        '{"primary_encodings":{"x":"a"}} more', '{"primary_encodings":{"x":NaN,"y":"\\u00e9\\n(z"}}', '{"primary_encodings":{"x":"1.50","color":"{z","row":"[q","column":"-"}}', '{"primary_encodings":{"x":"tab\there"}}', '{"primary_encodings":{"x":"  ","color":"(n)"}}',
    ]
    df = spark.createDataFrame([(k, m) for k, m in enumerate(rows)], "k int, m string").withColumn("r", F.try_parse_json("m"))
    got = df.select("k", candidates.mapping_dimensions(F.col("m"), F.col("r")).alias("d"), candidates.mapping_measures(F.col("m"), F.col("r")).alias("v"))
    plain = lambda path: candidates._field(F.get_json_object("m", path))
    want = df.select(
        "k", F.array_distinct(F.array_compact(F.array(*(plain(f"$.primary_encodings.{c}") for c in ("x", "color", "row", "column", "facet")), plain("$.facet.field")))).alias("d"),
        F.array_distinct(F.array_compact(F.array(plain("$.primary_encodings.y"), plain("$.secondary_encodings.y"), plain("$.primary_encodings.size")))).alias("v"),
    )
    assert sorted(values(got, "k", "d", "v")) == sorted(values(want, "k", "d", "v"))
    answer = json.dumps({"candidates": [{"chart_type": "bar", "data_mapping": rows[0]}]})
    parsed = candidates.parse_candidates(spark.createDataFrame([(1, answer)], "q long, a string"), "q", "a")
    assert parsed.first().dimensions == ["a", "f"]
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("parseJson") + parsed._jdf.queryExecution().optimizedPlan().toString().count("parse_json") == 1


@pytest.mark.parametrize("few,bucket", [(20_000, 16), (0, 7)])
def test_loess_buckets_points_without_a_join(spark, monkeypatch, few, bucket):
    """Against a plain fit, null keys and ties included; all points get their buckets and moments with no join."""
    monkeypatch.setattr(chartops, "FEW_BUCKETS", few)
    rng, rows = random.Random(4), []
    for g in (None, "a", "b"):
        rows += [(g, x := round(rng.uniform(100, 110), 1 if g == "a" else 4), math.sin(x) + rng.random()) for _ in range(400)]
    frame = spark.createDataFrame([*rows, ("c", 5.0, 1.0), ("c", 5.0, 2.0), ("c", None, 2.0)], "k string, x double, y double")
    plans, kept = [], chartops._kept
    monkeypatch.setattr(chartops, "_kept", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df))
    got = {(r.k, r.step): (r.x, r.y) for r in chartops.t_loess(frame, "x", "y", ["k"], steps=4, bucket=bucket).collect()}
    assert "Join" not in plans[0]
    assert len(got) == 20 and all(abs(got["c", j][1] - 1.5) < 1e-9 for j in range(5))
    for g in (None, "a", "b"):
        own = [(x, y) for k, x, y in rows if k == g]
        for j in range(5):
            at, y = got[g, j]
            reach = sorted(abs(x - at) for x, _ in own)[math.ceil(0.3 * len(own)) - 1]
            w = [(max(0.0, 1 - (abs(x - at) / (reach * 1.000001)) ** 3) ** 3, x - at, v) for x, v in own if abs(x - at) <= reach]
            s0, s1, s2, t0, t1 = (sum(a * u**p * (v if q else 1) for a, u, v in w) for p, q in ((0, 0), (1, 0), (2, 0), (0, 1), (1, 1)))
            assert abs(y - (t0 * s2 - t1 * s1) / (s0 * s2 - s1 * s1)) < 1e-6
    bare = frame.where("k = 'b'").drop("k")
    assert sorted(r.step for r in chartops.t_loess(bare, "x", "y", [], steps=4, bucket=bucket).collect()) == [0, 1, 2, 3, 4]
    assert chartops.t_loess(frame.limit(0), "x", "y", ["k"]).count() == 0
