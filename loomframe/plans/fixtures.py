"""Collections that queries derive from the test tables: one statement each, read by Spark and by SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import tables as src

SAMPLES = """SELECT concat('q', o_custkey, '_c', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS sample_id,
 o_custkey AS source_question_id, concat(lower(c_mktsegment), CASE o_custkey % 6 WHEN 0 THEN '_sales' WHEN 1 THEN '_hospital' WHEN 2 THEN '_user_log' WHEN 3 THEN '_geo' WHEN 4 THEN '' ELSE '_sensor' END) AS db_id, o_orderpriority AS chart_type, o_orderstatus AS chart_category, o_totalprice > 20000 AS validation_passed, o_orderkey AS seq
 FROM orders JOIN customer ON o_custkey = c_custkey"""
SPECS = """SELECT p_partkey AS spec_id, p_type AS chart_type, concat('{"mark":',
 CASE p_size % 3 WHEN 0 THEN '"bar"' WHEN 1 THEN '{"type":"line"}' ELSE '{"type":"arc","innerRadius":20}' END,
 ',"encoding":{"x":{"field":"', p_brand, '","type":"', CASE p_size % 4 WHEN 0 THEN 'nominal' WHEN 1 THEN 'temporal' WHEN 2 THEN 'ordinal' ELSE 'quantitative' END, '"},"y":{"field":"p_retailprice","type":"quantitative"',
 CASE WHEN p_size % 2 = 0 THEN ',"aggregate":"sum"' ELSE '' END, '}', CASE WHEN p_size % 5 = 0 THEN ',"color":{"field":"p_type","type":"nominal"}' ELSE '' END, '}',
 CASE WHEN p_size % 7 = 0 THEN ',"transform":[{"filter":"datum.v > 0"},{"window":[]}]' ELSE '' END,
 CASE WHEN p_size % 6 = 0 THEN ',"layer":[{"mark":"bar"},{"mark":"rule"}]' WHEN p_size % 11 = 0 THEN ',"hconcat":[]' ELSE '' END,
 CASE WHEN p_size % 10 = 0 THEN ',"params":[{"name":"b","select":{"type":"interval"}},{"name":"l","bind":"legend"}]' ELSE '' END, '}') AS spec, p_size FROM part"""
JUDGMENTS = """SELECT l_orderkey AS sample_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS feature_pos, l_returnflag AS feature_type, l_linestatus = 'O' AS must,
 l_quantity > 1 AS code_ok, l_discount < 0.08 AS code_satisfied, l_quantity < 50 AS chart_ok, l_tax < 0.06 AS chart_satisfied FROM lineitem"""
RUNS = """SELECT o_orderkey AS sample_id, o_orderstatus <> 'P' AS code_renderable, CAST(floor(o_totalprice) AS BIGINT) % 11 AS best_score,
 o_orderkey % 1000 AS prompt_tokens, o_custkey % 7 AS text_questions_asked FROM orders"""
TRACE = """SELECT conv_id AS sample_id, turn AS node_id, CASE WHEN turn = 0 THEN NULL ELSE CAST(floor((turn - 1) / 2) AS BIGINT) END AS parent_id,
 CASE WHEN turn = 0 THEN 'root' WHEN turn % 3 = 0 THEN 'ask_user_text' WHEN turn % 3 = 1 THEN 'execute_sql' ELSE 'execute_altair' END AS action_name,
 length(text) % 10 + 1 AS user_score, text AS observation FROM conversations"""
CANDIDATES = """SELECT l_orderkey AS question_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS pos, concat(l_returnflag, l_linestatus) AS chart_type, l_returnflag AS chart_category,
 concat('d', l_partkey % 5) AS dim1, concat('d', l_suppkey % 3) AS dim2, concat('m', l_partkey % 4) AS measure,
 CASE WHEN l_quantity > 25 THEN 'SUM' ELSE 'AVG' END AS aggregation, CASE WHEN l_discount > 0.05 THEN 'trend' ELSE 'ranking' END AS vis_intent_type FROM lineitem"""
QUESTIONS = "SELECT doc_id AS question_id, text AS question, lang AS db_id, source AS difficulty FROM documents"

#: Tables of short rows from which long ones are made, and their keys.
_SPREAD = {"specs": "p_partkey"}
_TABLES = {
    "samples": (SAMPLES, "orders", "customer"), "specs": (SPECS, "part"), "judgments": (JUDGMENTS, "lineitem"), "runs": (RUNS, "orders"),
    "trace": (TRACE, "conversations"), "candidates": (CANDIDATES, "lineitem"), "questions": (QUESTIONS, "documents"),
}


def fx(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """A derived collection of a folder's tables; by: the column by which its table's rows are dealt before anything is made
    of them, so that steps by that column, under its own name or the collection's, share one shuffle."""
    sql, *tables = _TABLES[name]
    by = by or _SPREAD.get(name)
    for t in tables:
        rows = src.read_table(spark, sf_dir, t)
        (src.spread(rows, by) if by else rows).createOrReplaceTempView(t)
    return spark.sql(sql)


def with_fx(name: str, select: str) -> str:
    """SQL over a derived collection, named fx."""
    more = f", {select[5:]}" if select.startswith("WITH ") else select
    return f"WITH fx AS ({_TABLES[name][0]}) {more}"
