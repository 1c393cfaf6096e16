"""Queries over profiles, text functions and streams, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import profiling as p
from ..sources import tables as src
from ..sources.scratch import state_path
from ..sources.tables import read_table as t
from ..streaming import streams
from .fixtures import fx, with_fx

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def rounded(df, digits: int, *names: str):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _catalog(spark, d):
    return p.catalog_columns({n: t(spark, d, n) for n in src.TABLES})


_TYPES = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'SMALLINT' THEN 'smallint' WHEN 'TINYINT' THEN 'tinyint' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'float' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'DOUBLE[]' THEN 'array<double>' ELSE column_type END"
_CAT = "cat AS (" + " UNION ALL ".join(f"SELECT '{n}' AS table_name, row_number() OVER () - 1 AS ordinal, column_name AS name, {_TYPES} AS data_type FROM (DESCRIBE {n})" for n in src.TABLES) + ")"
_SEM = f"""{_CAT}, sem AS (SELECT *, CASE WHEN regexp_matches(lower(name), 'date|time|year|month|day|created|updated|timestamp') THEN 'temporal' WHEN regexp_matches(data_type, 'int|float|double|decimal') THEN CASE WHEN lower(name) LIKE '%id' THEN 'identifier' ELSE 'numeric' END
WHEN data_type LIKE '%string%' AND (lower(name) LIKE '%id' OR lower(name) LIKE '%code') THEN 'identifier' ELSE 'categorical' END AS semantics FROM cat)"""


# --- sources


@query("source_run_sql", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def source_run_sql(spark, d):
    src.load_tables(spark, d, ("orders",))
    return src.run_sql_safe(spark, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")


@query("source_schema", "SELECT (column_index)::INT AS ordinal, column_name AS name FROM duckdb_columns() WHERE table_name = 'lineitem' AND false UNION ALL SELECT k::INT, n FROM (SELECT unnest(range(11)) AS k, unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_returnflag', 'l_linestatus', 'l_shipdate']) AS n)")
def source_schema(spark, d):
    return src.table_schema(t(spark, d, "lineitem"), ("l_orderkey", "l_linenumber")).select("ordinal", "name")


@query("source_json_safe", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value, event_type FROM events")
def source_json_safe(spark, d):
    return src.json_safe(t(spark, d, "events").select("event_id", "ts", "value", "event_type"))


@query("source_json_rows", "SELECT count(*) AS n, sum(n_nationkey)::BIGINT AS s FROM nation")
def source_json_rows(spark, d):
    rows = src.to_json_rows(t(spark, d, "nation"))
    return rows.agg(F.count("*").alias("n"), F.sum(F.get_json_object("json", "$.n_nationkey").cast("long")).alias("s"))


@query("source_inline_stats", """SELECT o_custkey, greatest(count(*) - 3, 0) AS more, concat('{"o_orderpriority":', count(DISTINCT o_orderpriority), ',"o_orderstatus":', count(DISTINCT o_orderstatus), '}') AS "distinct" FROM orders GROUP BY 1""")
def source_inline_stats(spark, d):
    rows = t(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct("o_orderstatus", "o_orderpriority")).alias("values")).alias("data"))).alias("spec"))
    return src.truncate_with_stats(rows, "o_custkey", "spec").select("o_custkey", "more", F.to_json("distinct").alias("distinct"))


# --- profiles


@query("profile_row_counts", "SELECT 'lineitem' AS table_name, count(*) AS n_rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders")
def profile_row_counts(spark, d):
    one = lambda n: p.row_count(t(spark, d, n)).withColumn("table_name", F.lit(n))
    return one("lineitem").unionByName(one("orders"))


@query("profile_sample_values", "SELECT DISTINCT p_brand AS value FROM part WHERE p_brand IS NOT NULL ORDER BY 1 LIMIT 5")
def profile_sample_values(spark, d):
    return p.sample_values(t(spark, d, "part"), "p_brand")


@query("profile_all_samples", """SELECT 'c_mktsegment' AS "column", array_to_string(list_sort(list_distinct(list(c_mktsegment)))[1:5], '|') AS samples FROM customer UNION ALL SELECT 'c_nationkey', array_to_string(list_sort(list_distinct(list(c_nationkey::VARCHAR)))[1:5], '|') FROM customer""")
def profile_all_samples(spark, d):
    return p.all_sample_values(t(spark, d, "customer").select("c_mktsegment", "c_nationkey"))


@query("profile_distinct_counts", """SELECT 'o_orderkey' AS "column", count(DISTINCT o_orderkey) AS n_distinct FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders
UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders""")
def profile_distinct_counts(spark, d):
    return p.distinct_counts(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query("profile_tables", """SELECT 'nation' AS table_name, 'n_name' AS "column", count(DISTINCT n_name) AS n_distinct, count(*) AS n_rows FROM nation UNION ALL SELECT 'nation', 'n_nationkey', count(DISTINCT n_nationkey), count(*) FROM nation
UNION ALL SELECT 'nation', 'n_regionkey', count(DISTINCT n_regionkey), count(*) FROM nation UNION ALL SELECT 'region', 'r_name', count(DISTINCT r_name), count(*) FROM region UNION ALL SELECT 'region', 'r_regionkey', count(DISTINCT r_regionkey), count(*) FROM region""")
def profile_tables(spark, d):
    return p.table_profile({n: t(spark, d, n) for n in ("nation", "region")})


@query("profile_measures", "SELECT 'l_quantity' AS measure, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 8) AS mean, count(*) FILTER (l_quantity IS NULL) AS nulls FROM lineitem UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax), round(avg(l_tax), 8), count(*) FILTER (l_tax IS NULL) FROM lineitem")
def profile_measures(spark, d):
    return rounded(p.measure_stats(t(spark, d, "lineitem"), ["l_quantity", "l_tax"]), 8, "mean")


@query("profile_null_share", "SELECT (count(*) FILTER (o_orderkey IS NULL) / (count(*) * 2.0))::DOUBLE AS null_share FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def profile_null_share(spark, d):
    both = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return p.null_share(both.select("c_custkey", "o_orderkey"))


@query("profile_preview", """SELECT 'p_brand' AS "column", 'string' AS type, array_to_string(list(p_brand ORDER BY p_partkey), '|') AS "values" FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 3) UNION ALL SELECT 'p_partkey', 'bigint', array_to_string(list(p_partkey ORDER BY p_partkey), '|') FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 3)""")
def profile_preview(spark, d):
    return p.column_preview(t(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")


@query("profile_result", """SELECT -1 AS row, count(DISTINCT n_nationkey)::VARCHAR AS n_nationkey, count(DISTINCT n_name)::VARCHAR AS n_name FROM nation UNION ALL SELECT row_number() OVER (ORDER BY n_nationkey), n_nationkey::VARCHAR, n_name FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 3)""")
def profile_result(spark, d):
    return p.result_profile(t(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]).withColumn("row", F.col("row").cast("long"))


@query("profile_semantics", f"WITH {_SEM} SELECT table_name, name, semantics, CASE semantics WHEN 'temporal' THEN 'temporal' WHEN 'numeric' THEN 'quantitative' ELSE 'nominal' END AS chart_type FROM sem")
def profile_semantics(spark, d):
    kinds = p.column_semantics(F.col("name"), F.col("data_type"))
    return _catalog(spark, d).select("table_name", "name", kinds.alias("semantics"), p.field_chart_type(kinds, F.col("name")).alias("chart_type"))


_KINDS = {"temporal": ["temporal"], "categorical": ["categorical"], "numeric": ["numeric"], "dimensions": ["temporal", "categorical", "identifier"], "measures": ["numeric", "identifier"]}
_PICKS = ", ".join(f"coalesce(string_agg(name, ',' ORDER BY name) FILTER (semantics IN ({', '.join(repr(k) for k in ks)})), '') AS {n}" for n, ks in _KINDS.items())


@query("profile_potential", f"""WITH {_SEM}, p AS (SELECT table_name, {_PICKS}, count(*) FILTER (semantics = 'temporal') AS t, count(*) FILTER (semantics = 'categorical') AS c, count(*) FILTER (semantics = 'numeric') AS q FROM sem GROUP BY 1)
SELECT table_name, {', '.join(_KINDS)}, array_to_string(list_sort(list_filter([CASE WHEN t > 0 AND q > 0 THEN 'line_chart' END, CASE WHEN t > 0 AND q > 0 THEN 'area_chart' END, CASE WHEN c > 0 AND q > 0 THEN 'bar_chart' END, CASE WHEN c > 0 AND q > 0 THEN 'horizontal_bar_chart' END,
CASE WHEN q > 0 THEN 'histogram' END, CASE WHEN q > 1 THEN 'scatter_plot' END, 'grouped_bar_chart', CASE WHEN c > 0 THEN 'pie_chart' END], lambda x: x IS NOT NULL)), ',') AS suggestions FROM p""")
def profile_potential(spark, d):
    out = p.suggest_charts(p.vis_potential(_catalog(spark, d), "table_name"), F.lit(True), F.lit(1))
    return out.select("table_name", *(F.array_join(c, ",").alias(c) for c in (*_KINDS, "suggestions")))


@query("profile_groups", """SELECT n_nationkey AS group_id, 1 + count(DISTINCT c_custkey) + count(DISTINCT o_orderkey) AS size, count(DISTINCT c_custkey) + count(DISTINCT o_orderkey) AS n_links
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def profile_groups(spark, d):
    """Nations, their customers and these's orders as one graph; keys of each kind are told apart by their remainder."""
    node = lambda c, kind: F.col(c) if kind == 0 else (F.col(c) + 100) * 2 + kind
    customers = t(spark, d, "customer").select(node("c_custkey", 1).alias("a"), node("c_nationkey", 0).alias("b"))
    known = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    edges = customers.union(known.select(node("o_orderkey", 2).alias("a"), node("o_custkey", 1).alias("b")))
    nodes = edges.select("a").union(t(spark, d, "nation").select("n_nationkey"))
    return p.table_groups(edges, nodes, members=False)


@query("profile_slice", f"WITH {_CAT} SELECT table_name, name, 0 AS key FROM cat WHERE table_name IN ('orders', 'customer') UNION ALL SELECT 'orders', 'customer', 1")
def profile_slice(spark, d):
    keys = spark.createDataFrame([("orders", "customer"), ("lineitem", "orders"), ("customer", "nation")], "from_table string, to_table string")
    names = spark.createDataFrame([("ORDERS",), ("Customer",)], "table_name string")
    columns, both = p.schema_slice(_catalog(spark, d), keys, names)
    return columns.select("table_name", "name", F.lit(0).alias("key")).union(both.select("from_table", "to_table", F.lit(1)))


@query("profile_find_column", f"WITH {_CAT} SELECT table_name FROM cat WHERE lower(name) = 'doc_id' ORDER BY table_name, ordinal LIMIT 1")
def profile_find_column(spark, d):
    return p.find_column(_catalog(spark, d), "DOC_ID")


@query("profile_digest", f"""WITH {_CAT} SELECT table_name, concat(table_name, ': ', string_agg(concat(name, ' (', data_type, ')'), ', ' ORDER BY ordinal) FILTER (ordinal < 4), CASE WHEN count(*) > 4 THEN concat(', +', count(*) - 4, ' more') ELSE '' END) AS line,
concat('Table: ', table_name, '(', string_agg(name, ', ' ORDER BY ordinal), ')') AS short FROM cat GROUP BY 1""")
def profile_digest(spark, d):
    return p.schema_digest(_catalog(spark, d), 4).join(p.schema_line(_catalog(spark, d)).withColumnRenamed("line", "short"), "table_name")


@query("profile_questions", with_fx("questions", "SELECT 'db_id' AS dimension, db_id AS value, count(*) AS n FROM fx GROUP BY ALL UNION ALL SELECT 'difficulty', difficulty, count(*) FROM fx GROUP BY ALL UNION ALL SELECT 'total', 'all', count(*) FROM fx"))
def profile_questions(spark, d):
    return p.question_stats(fx(spark, d, "questions")).drop("evidence_pct")


@query("profile_filter_questions", with_fx("questions", "SELECT question_id FROM fx WHERE db_id = 'fr' AND difficulty = 'src3' ORDER BY question_id LIMIT 10"))
def profile_filter_questions(spark, d):
    return p.filter_questions(fx(spark, d, "questions"), db="FR", difficulty="SRC3", max_n=10).select("question_id")


@query("profile_first_questions", with_fx("questions", "SELECT question_id, db_id, substr(trim(replace(question, chr(10), ' ')), 1, 160) AS question FROM fx ORDER BY question_id LIMIT 10"))
def profile_first_questions(spark, d):
    return p.list_first(fx(spark, d, "questions"), 10)


_WORDS = "list_distinct(list_filter(regexp_split_to_array(upper({}), '[^A-Za-z0-9_]+'), lambda x: length(x) >= 2))"


@query("profile_rank_tables", f"""WITH {_CAT}, tabs AS (SELECT table_name, {_WORDS.format('table_name')} AS tw, {_WORDS.format("string_agg(name, ' ')")} AS cw FROM cat WHERE ordinal < 15 GROUP BY 1),
q AS (SELECT page_id, {_WORDS.format("concat(url, CASE page_id % 5 WHEN 0 THEN ' orders of a customer: o_orderdate' WHEN 1 THEN ' part p_size ps' WHEN 2 THEN ' n_name, r_name, s_name in nation' ELSE '' END)")} AS w FROM pages),
s AS (SELECT page_id, table_name, 2 * len(list_intersect(w, tw)) + len(list_intersect(w, cw)) AS score FROM q, tabs)
SELECT page_id AS question_id, table_name, score::INT AS score, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, table_name) AS k FROM s) WHERE k <= 3""")
def profile_rank_tables(spark, d):
    id_ = F.col("page_id") % 5
    more = F.when(id_ == 0, " orders of a customer: o_orderdate").when(id_ == 1, " part p_size ps").when(id_ == 2, " n_name, r_name, s_name in nation").otherwise("")
    q = t(spark, d, "pages").select(F.col("page_id").alias("question_id"), F.concat("url", more).alias("question"))
    return p.rank_tables_by_text(_catalog(spark, d), q, "question_id", "question", 3)


@query("profile_find_columns", "SELECT 'lineitem' AS table_name UNION ALL SELECT 'orders' UNION ALL SELECT 'customer'")
def profile_find_columns(spark, d):
    return p.tables_with_columns(_catalog(spark, d), ["L_ORDERKEY", "o_orderkey", "c_acctbal"])


@query("profile_missing_columns", "SELECT event_type AS ref FROM events GROUP BY 1")
def profile_missing_columns(spark, d):
    refs = t(spark, d, "events").select(F.col("event_type").alias("ref")).distinct().union(spark.createDataFrame([("o.o_orderkey",), ("*",)], "ref string"))
    return p.missing_columns(refs, _catalog(spark, d))


# --- text


@query("text_tokens", "SELECT page_id, len(list_filter(regexp_split_to_array(upper(url), '[^A-Za-z0-9_]+'), lambda x: length(x) >= 2))::INT AS n FROM pages")
def text_tokens(spark, d):
    return t(spark, d, "pages").select("page_id", F.size(text.tokenize_upper(F.col("url"))).alias("n"))


@query("text_entities", r"""SELECT doc_id, len(e)::INT AS n, md5(array_to_string(e, '|')) AS entities FROM (SELECT doc_id, list_filter(f, lambda x, i: list_position(f, x) = i) AS e FROM (SELECT doc_id, list_concat(regexp_extract_all(text, '[''"]([^''"]+)[''"]', 1), list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: length(w) > 2 AND regexp_matches(w, '^\p{Lu}') AND lower(w) NOT IN ('what', 'which', 'where', 'when', 'who', 'how', 'the', 'show'))) AS f FROM documents))""")
def text_entities(spark, d):
    found = text.key_entities(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.size(found).alias("n"), F.md5(F.array_join(found, "|")).alias("entities"))


@query("text_evidence", "SELECT doc_id, len(e)::INT AS n, md5(array_to_string(e, '|')) AS points FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), ';'), ';'), lambda x: trim(x)), lambda x: length(x) > 10) AS e FROM documents)")
def text_evidence(spark, d):
    found = text.evidence_points(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.size(found).alias("n"), F.md5(F.array_join(found, "|")).alias("points"))


def _sql_log(spark, d):
    limit = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" LIMIT "), (F.col("o_orderkey") % 15 + 1).cast("string"))).otherwise("")
    agg = F.when(F.col("o_orderkey") % 2 == 0, "SELECT status, SUM(price) FROM orders JOIN customer ON a = b WHERE x > 1 AND y < 2 GROUP BY status").otherwise("SELECT a, b FROM orders")
    return t(spark, d, "orders").select("o_orderkey", F.concat(agg, limit).alias("sql"))


@query("text_sql_shape", """SELECT o_orderkey, o_orderkey % 2 = 0 AS is_aggregated, o_orderkey % 2 = 0 AS has_groupby, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 15 + 1 END AS limit_value,
CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 15 = 0 THEN 'single' WHEN o_orderkey % 3 = 0 AND o_orderkey % 15 + 1 < 10 THEN 'few' ELSE 'many' END AS estimated_rows FROM orders""")
def text_sql_shape(spark, d):
    return text.sql_shape(_sql_log(spark, d), "sql").select("o_orderkey", "is_aggregated", "has_groupby", "limit_value", "estimated_rows")


@query("text_sql_clauses", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'orders,customer' ELSE 'orders' END AS tables, CASE WHEN o_orderkey % 2 = 0 THEN 'x > 1,y < 2' ELSE '' END AS filters, CASE WHEN o_orderkey % 2 = 0 THEN 'status' ELSE '' END AS groupby FROM orders")
def text_sql_clauses(spark, d):
    c = text.sql_clauses(F.col("sql"))
    return _sql_log(spark, d).select("o_orderkey", *(F.array_join(c[k], ",").alias(k) for k in ("tables", "filters", "groupby")))


@query("text_limits", """SELECT o_orderkey, concat(q, ' LIMIT 20') AS expanded, CASE WHEN o_orderkey % 15 = 0 THEN q WHEN o_orderkey % 3 = 0 THEN concat(q, ' LIMIT ', o_orderkey % 15 + 1) ELSE q END AS dropped
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'SELECT status, SUM(price) FROM orders JOIN customer ON a = b WHERE x > 1 AND y < 2 GROUP BY status' ELSE 'SELECT a, b FROM orders' END AS q FROM orders)""")
def text_limits(spark, d):
    return _sql_log(spark, d).select("o_orderkey", text.expand_limit(F.col("sql")).alias("expanded"), text.drop_limit1(F.col("sql")).alias("dropped"))


@query("text_clean_sql", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'SELECT status, SUM(price) FROM orders JOIN customer ON a = b WHERE x > 1 AND y < 2 GROUP BY status' ELSE 'SELECT a, b FROM orders' END AS cleaned, CASE WHEN o_orderkey % 2 = 0 THEN 'tables: orders, customer; measures: SUM(price); grouped by: status; filters: x > 1, y < 2' ELSE 'tables: orders' END AS intent FROM orders WHERE o_orderkey % 3 > 0")
def text_clean_sql(spark, d):
    log = _sql_log(spark, d).where("o_orderkey % 3 > 0")
    dressed = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("```sql\n"), "sql", F.lit("\n```"))).when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("Here you are: "), "sql", F.lit("\n"))).otherwise(F.col("sql"))
    return log.select("o_orderkey", text.clean_sql(dressed).alias("cleaned"), text.intent_text(F.col("sql")).alias("intent"))


@query("text_clean_question", """SELECT conv_id, turn, CASE WHEN length(bare) = 0 THEN bare WHEN regexp_matches(bare, '[?.!]$') THEN bare ELSE concat(bare, '?') END AS cleaned FROM (SELECT conv_id, turn, concat(upper(substr(b, 1, 1)), substr(b, 2)) AS bare FROM (SELECT conv_id, turn, trim(text) AS b FROM conversations))""")
def text_clean_question(spark, d):
    """Questions in quotes, and some without their mark."""
    quoted = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('"'), "text", F.lit("'"))).when(F.col("turn") % 3 == 1, F.concat(F.lit(" "), "text", F.lit(" "))).otherwise(F.col("text"))
    return t(spark, d, "conversations").select("conv_id", "turn", text.clean_question(quoted).alias("cleaned"))


@query("text_fenced", "SELECT o_orderkey, o_orderpriority AS code, o_orderstatus AS question FROM orders")
def text_fenced(spark, d):
    md = F.concat(F.lit("x\n```python\n"), "o_orderpriority", F.lit("```\nand\n```text\n"), "o_orderstatus", F.lit("```\n"))
    blocks = text.fenced_blocks(md)
    return t(spark, d, "orders").select("o_orderkey", blocks[0]["body"].alias("code"), blocks[1]["body"].alias("question"))


@query("text_extract_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def text_extract_json(spark, d):
    mixed = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\ndone"))
    return t(spark, d, "events").select("event_id", F.get_json_object(text.extract_json(mixed), "$.k").alias("k"))


@query("text_relative_paths", "SELECT o_orderkey, 1 AS n_replaced, concat('connect(\"./databases/d', o_custkey, '.sqlite\")') AS code FROM orders")
def text_relative_paths(spark, d):
    code = F.concat(F.lit('connect("/data/dev_databases/d'), F.col("o_custkey").cast("string"), F.lit("/d"), F.col("o_custkey").cast("string"), F.lit('.sqlite")'))
    return text.relativize_paths(t(spark, d, "orders").select("o_orderkey", code.alias("code")), "code")


@query("text_post_sql_ops", "SELECT o_orderkey, o_orderkey % 2 = 0 AS has_ops FROM orders")
def text_post_sql_ops(spark, d):
    code = F.when(F.col("o_orderkey") % 2 == 0, "df.groupby(1)\ndf = read_sql(q)\nx = df.groupby('a')").otherwise("df.groupby(1)\ndf = read_sql(q)\nprint(df)")
    return text.has_post_sql_ops(t(spark, d, "orders").select("o_orderkey", code.alias("code")), "o_orderkey", "code")


@query("text_truncated", "SELECT doc_id, CASE WHEN length(text) > 100 THEN concat(substr(text, 1, 100), '... [truncated]') ELSE text END AS text, length(text) > 100 AS truncated, length(text)::INT AS length FROM documents")
def text_truncated(spark, d):
    return t(spark, d, "documents").select("doc_id", text.truncate_text(F.col("text"), 100).alias("x")).select("doc_id", "x.text", "x.truncated", "x.length")


# --- streams


def _stream(spark, d):
    schema = t(spark, d, "events").schema
    return streams.as_timestamp(spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]"))  # a pattern: the table may be a file or a folder


def _ended(spark, df, mode):
    path = state_path(spark, "stream")
    return streams.run_to_end(df, "s_" + path[-32:], path, mode)


@query("stream_counts", "SELECT 'event_type' AS dimension, event_type AS value, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark, d):
    return _ended(spark, streams.stream_feature_counts(_stream(spark, d), {"event_type": "event_type"}), "complete")


@query("stream_windows", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    out = _ended(spark, streams.stream_windowed_counts(_stream(spark, d), "ts", ["event_type"], "value", "1 day"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))


@query("stream_sessions", "SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS n FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL) GROUP BY 1")
def stream_sessions(spark, d):
    out = _ended(spark, streams.stream_sessions(_stream(spark, d), "ts", ["user_id"], late="60 days"), "complete")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("stream_dedup", "SELECT count(DISTINCT event_id) AS n FROM events")
def stream_dedup(spark, d):
    doubled = _stream(spark, d).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    return _ended(spark, streams.stream_dedup(doubled, "event_id", "ts", "60 days"), "append").agg(F.count("*").alias("n"))


@query("stream_upsert", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_upsert(spark, d):
    path = state_path(spark, "stream")
    rows = _stream(spark, d).select("user_id", "event_id")
    streams.stream_upsert(rows, f"{path}/table", f"{path}/state", "user_id", "event_id").awaitTermination()
    return streams.read_upserted(spark, f"{path}/table", rows.schema, "user_id")
