"""Queries over the shaping operators, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shaping as s
from ..sources.tables import read_table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


t = read_table


@query("top_nations", """SELECT n_name, round(sum(o_totalprice), 2) AS total, count(*) AS n_orders
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name ORDER BY total DESC, n_name LIMIT 15""")
def top_nations(spark, d):
    joined = s.inner_join(s.inner_join(t(spark, d, "orders"), t(spark, d, "customer"), {"o_custkey": "c_custkey"}), t(spark, d, "nation"), {"c_nationkey": "n_nationkey"})
    total = joined.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n_orders"))
    return total.orderBy(F.desc("total"), "n_name").limit(15)


@query("shape_project", "SELECT o_orderkey AS id, o_totalprice * 2 AS doubled, o_orderpriority AS priority FROM orders")
def shape_project(spark, d):
    return s.project(t(spark, d, "orders"), {"id": "o_orderkey", "doubled": "o_totalprice * 2", "priority": "o_orderpriority"})


@query("shape_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F' AND o_orderpriority IS NOT NULL")
def shape_filter(spark, d):
    return s.where(t(spark, d, "orders"), "o_totalprice > 200000 AND o_orderstatus = 'F' AND o_orderpriority IS NOT NULL").select("o_orderkey", "o_totalprice")


@query("shape_left_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def shape_left_join(spark, d):
    return s.join(t(spark, d, "customer"), t(spark, d, "orders"), {"c_custkey": "o_custkey"}, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("shape_full_join", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def shape_full_join(spark, d):
    return s.join(t(spark, d, "supplier"), t(spark, d, "customer"), {"s_suppkey": "c_custkey"}, "full").select("s_suppkey", "c_custkey")


@query("shape_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def shape_semi(spark, d):
    return s.semi(t(spark, d, "customer"), t(spark, d, "orders").where("o_totalprice > 400000"), {"c_custkey": "o_custkey"}).select("c_custkey")


@query("shape_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def shape_anti(spark, d):
    return s.anti(t(spark, d, "customer"), t(spark, d, "orders"), {"c_custkey": "o_custkey"}).select("c_custkey")


@query("shape_group_agg", """SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS total_price, count(l_quantity) AS n, round(avg(l_discount), 6) AS mean_discount,
min(l_tax) AS least_tax, max(l_tax) AS most_tax, coalesce(sum(l_quantity), 0.0) AS total_quantity FROM lineitem GROUP BY ALL""")
def shape_group_agg(spark, d):
    out = s.group_agg(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {
        "total_price": ("sum", "l_extendedprice"), "n": ("count", "l_quantity"), "mean_discount": ("avg", "l_discount"),
        "least_tax": ("min", "l_tax"), "most_tax": ("max", "l_tax"), "total_quantity": ("total", "l_quantity"),
    })
    return out.withColumns({"total_price": F.round("total_price", 2), "mean_discount": F.round("mean_discount", 6)})


@query("shape_group_concat", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def shape_group_concat(spark, d):
    return s.group_agg(t(spark, d, "nation"), ["n_regionkey"], {"names": ("group_concat", "n_name")})


@query("shape_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def shape_having(spark, d):
    return s.having(s.group_agg(t(spark, d, "orders"), ["o_custkey"], {"n": ("count", "*")}), "n > 15")


@query("shape_with_views", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 300000) SELECT c_mktsegment, count(*) AS n FROM big JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def shape_with_views(spark, d):
    frames = {"orders": t(spark, d, "orders"), "customer": t(spark, d, "customer")}
    return s.with_views(spark, frames, "WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > 300000) SELECT c_mktsegment, count(*) AS n FROM big JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment")


@query("shape_union", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def shape_union(spark, d):
    return s.union(t(spark, d, "supplier").selectExpr("s_nationkey as k"), t(spark, d, "customer").selectExpr("c_nationkey as k"), distinct=True)


@query("shape_top_k", "SELECT o_custkey, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 15")
def shape_top_k(spark, d):
    return s.top_k(t(spark, d, "orders"), ["o_custkey"], "o_totalprice", 15).withColumn("value", F.round("value", 2))


@query("shape_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def shape_order_limit(spark, d):
    return s.limit(s.order_by(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["-o_totalprice", "o_orderkey"]), 20)


@query("shape_manual_variance", "SELECT l_returnflag, round(var_pop(l_extendedprice), 2) AS variance FROM lineitem GROUP BY l_returnflag")
def shape_manual_variance(spark, d):
    return s.manual_variance(t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice").withColumn("variance", F.round("variance", 2))


@query("shape_group_rank", """SELECT o_orderkey, CASE WHEN o_totalprice IS NOT NULL THEN r + (n - 1) / 2.0::DOUBLE END AS rank FROM (SELECT o_orderkey, o_totalprice,
rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice NULLS LAST) AS r, count(*) OVER (PARTITION BY o_custkey, o_totalprice) AS n FROM orders)""")
def shape_group_rank(spark, d):
    return s.group_rank(t(spark, d, "orders"), ["o_custkey"], "o_totalprice").select("o_orderkey", "rank")


@query("shape_sql_ranks", """SELECT p_partkey, row_number() OVER w AS row_number, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS rank, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dense_rank
FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)""")
def shape_sql_ranks(spark, d):
    ranks = s.sql_ranks(t(spark, d, "part"), ["p_brand"], [F.col("p_size")]).drop("row_number")
    first = s.sql_ranks(t(spark, d, "part"), ["p_brand"], [F.col("p_size"), F.col("p_partkey")]).select("p_partkey", "row_number")
    return ranks.join(first, "p_partkey").select("p_partkey", "row_number", "rank", "dense_rank")


@query("shape_share_of_total", "SELECT o_orderkey, round(o_totalprice / (SELECT sum(o_totalprice) FROM orders), 12) AS share FROM orders")
def shape_share(spark, d):
    return s.share_of_total(t(spark, d, "orders"), "o_totalprice").select("o_orderkey", F.round("share", 12).alias("share"))


@query("shape_rolling_mean", """SELECT event_id, CASE WHEN count(value) OVER w = 7 THEN round(avg(value) OVER w, 6) END AS rolling FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def shape_rolling(spark, d):
    return s.rolling_mean(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("rolling", 6).alias("rolling"))


@query("shape_pivot", """SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS F, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS O,
round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS P FROM orders GROUP BY o_orderpriority""")
def shape_pivot(spark, d):
    out = s.pivot(t(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", "o_totalprice", ["F", "O", "P"])
    return out.select("o_orderpriority", *(F.round(c, 4).alias(c) for c in "FOP"))


@query("shape_casts", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def shape_casts(spark, d):
    orders = t(spark, d, "orders").withColumn("text", F.col("o_orderdate").cast("string"))
    both = s.cast(s.to_datetime(orders, "text"), "o_totalprice", "bigint")
    return both.select("o_orderkey", F.col("o_totalprice").alias("whole"), F.date_format("text", "yyyy-MM-dd").alias("day"))


@query("shape_map_values", "SELECT o_orderkey AS order_key, CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' END AS status FROM orders")
def shape_map_values(spark, d):
    mapped = s.map_values(t(spark, d, "orders"), "o_orderstatus", {"F": "Filled", "O": "Open"})
    return s.rename(mapped, {"o_orderkey": "order_key", "o_orderstatus": "status"}).select("order_key", "status")


@query("shape_category_order", """WITH m AS (SELECT c_mktsegment, row_number() OVER (ORDER BY avg(c_acctbal), c_mktsegment) AS category_order FROM customer GROUP BY 1)
SELECT c_custkey, category_order FROM customer JOIN m USING (c_mktsegment)""")
def shape_category_order(spark, d):
    return s.order_categories_by_stat(t(spark, d, "customer"), "c_mktsegment", "c_acctbal").select("c_custkey", "category_order")


@query("shape_scale_column", "SELECT l_orderkey, l_linenumber, l_discount * 100 AS l_discount FROM lineitem")
def shape_scale(spark, d):
    return s.scale_column(t(spark, d, "lineitem"), "l_discount", 100).select("l_orderkey", "l_linenumber", "l_discount")


@query("shape_fill_nulls", "SELECT c_custkey, coalesce(o_totalprice, 0.0) AS o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def shape_fill(spark, d):
    both = s.join(t(spark, d, "customer"), t(spark, d, "orders"), {"c_custkey": "o_custkey"}, "left")
    return s.fill_or_drop_nulls(both, ["o_totalprice"], "fill", 0.0).select("c_custkey", "o_totalprice")


@query("shape_user_step", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY c_mktsegment")
def shape_user_step(spark, d):
    return s.apply_user_shaping(t(spark, d, "customer"), lambda df: df.where("c_acctbal < 0").groupBy("c_mktsegment").agg(F.count("*").alias("n")))


@query("shape_row_window", "SELECT least(count(*), 201) AS n_rows, count(*) >= 5 AS ok, count(*) > 200 AS oversized FROM orders")
def shape_row_window(spark, d):
    return s.row_window(t(spark, d, "orders"))
