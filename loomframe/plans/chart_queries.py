"""Queries over the chart operators and recipes, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chartops as c
from ..operators import recipes as r
from ..sources.tables import read_table as t

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


for _kind, _sql in {"sum": "sum(l_quantity)", "avg": "avg(l_quantity)", "count": "count(l_quantity)", "max": "max(l_quantity)", "min": "min(l_quantity)", "median": "median(l_quantity)", "distinct": "count(DISTINCT l_quantity)", "variance": "var_samp(l_quantity)", "stdev": "stddev_samp(l_quantity)"}.items():
    _digits = ", 6)" if _kind in ("avg", "variance", "stdev") else ""
    _value = f"round({_sql}{_digits}" if _digits else _sql
    query(f"chart_agg_{_kind}", f"SELECT l_returnflag, {_value} AS value FROM lineitem GROUP BY l_returnflag")(
        lambda spark, d, k=_kind: (lambda df: rounded(df, 6, "value") if k in ("avg", "variance", "stdev") else df)(c.aggregated(t(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", k))
    )


@query("chart_time_units", """SELECT event_id, year(ts) AS y, quarter(ts) AS q, month(ts) AS m, weekofyear(ts) AS w, day(ts) AS dd, hour(ts) AS h, minute(ts) AS mi,
strftime(date_trunc('month', ts), '%Y-%m') AS ym, strftime(ts, '%m-%d') AS md FROM events""")
def chart_time_units(spark, d):
    ts = F.col("ts")
    names = {"y": "year", "q": "quarter", "m": "month", "w": "week", "dd": "day", "h": "hour", "mi": "minute"}
    cols = [c.time_unit(ts, u).cast("long").alias(n) for n, u in names.items()]
    return t(spark, d, "events").select("event_id", *cols, F.date_format(c.time_unit(ts, "yearmonth"), "yyyy-MM").alias("ym"), c.time_unit(ts, "monthdate").alias("md"))


@query("chart_joinaggregate", "SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS diff FROM orders")
def chart_joinaggregate(spark, d):
    return c.t_joinaggregate(t(spark, d, "orders"), ["o_custkey"], {"m": ("avg", "o_totalprice")}).select("o_orderkey", F.round(F.col("o_totalprice") - F.col("m"), 6).alias("diff"))


@query("chart_aggregate_step", "SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderpriority")
def chart_aggregate_step(spark, d):
    return c.t_aggregate(t(spark, d, "orders"), ["o_orderpriority"], {"n": ("count", "*"), "top": ("max", "o_totalprice")})


@query("chart_window", """SELECT event_id, row_number() OVER w AS rn, lag(value) OVER w AS previous, lead(value, 2) OVER w AS later, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS running
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def chart_window(spark, d):
    ops = {"rn": ("row_number",), "previous": ("lag", "value"), "later": ("lead", "value", 2), "running": ("sum", "value")}
    return rounded(c.t_window(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], ops).select("event_id", *ops), 6, "running")


@query("chart_bin", "SELECT o_orderkey, floor(o_totalprice / 50000) * 50000 AS bin_start, floor(o_totalprice / 50000) * 50000 + 50000 AS bin_end FROM orders")
def chart_bin(spark, d):
    return c.t_bin(t(spark, d, "orders"), "o_totalprice", step=50000).select("o_orderkey", "bin_start", "bin_end")


_NICE = """(SELECT CASE WHEN raw <= p THEN p WHEN raw <= 2 * p THEN 2 * p WHEN raw <= 5 * p THEN 5 * p ELSE 10 * p END AS step FROM (SELECT raw, pow(10.0, floor(log10(raw))) AS p FROM (SELECT (max({v}) - min({v})) / {n}.0 AS raw FROM {table})))"""


@query("chart_bin_nice", f"SELECT floor(o_totalprice / step) * step AS bin_start, count(*) AS n FROM orders, {_NICE.format(v='o_totalprice', n=10, table='orders')} GROUP BY 1")
def chart_bin_nice(spark, d):
    return c.t_bin(t(spark, d, "orders"), "o_totalprice", 10).groupBy("bin_start").agg(F.count("*").alias("n"))


@query("chart_calculate", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def chart_calculate(spark, d):
    return c.t_calculate(t(spark, d, "lineitem"), "round(l_extendedprice * (1 - l_discount), 4)", "net").select("l_orderkey", "l_linenumber", "net")


@query("chart_filter", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 1000 AND 90000")
def chart_filter(spark, d):
    some = c.t_filter(t(spark, d, "orders"), {"field": "o_orderpriority", "oneOf": ["1-URGENT", "2-HIGH"]})
    return c.t_filter(some, {"field": "o_totalprice", "range": [1000, 90000]}).select("o_orderkey")


@query("chart_fold", "SELECT l_orderkey, l_linenumber, 'l_tax' AS key, l_tax AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem")
def chart_fold(spark, d):
    return c.t_fold(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount"), ["l_tax", "l_discount"])


@query("chart_pivot", "SELECT l_shipdate::DATE::VARCHAR AS day, sum(l_quantity) FILTER (l_returnflag = 'A') AS A, sum(l_quantity) FILTER (l_returnflag = 'N') AS N, sum(l_quantity) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY 1")
def chart_pivot(spark, d):
    return c.t_pivot(t(spark, d, "lineitem").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd")), "l_returnflag", "l_quantity", ["day"], ["A", "N", "R"])


@query("chart_density", """WITH ends AS (SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1),
points AS (SELECT l_returnflag, k AS step, lo + (hi - lo) * k / 20.0 AS x FROM ends, range(21) AS g(k))
SELECT p.l_returnflag, step::INT AS step, x, round(sum(exp(-pow((x - l_quantity) / 3.0, 2) / 2)) / (count(*) * 3.0 * 2.5066282746310002), 8) AS density
FROM points p JOIN lineitem l ON p.l_returnflag = l.l_returnflag GROUP BY ALL""")
def chart_density(spark, d):
    return rounded(c.t_density(t(spark, d, "lineitem"), "l_quantity", ["l_returnflag"], 3.0), 8, "density")


@query("chart_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def chart_regression(spark, d):
    out = c.t_regression(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return rounded(rounded(rounded(out, 4, "slope"), 3, "intercept"), 6, "r2")


_S = ", ".join([*(f"sum(pow(l_quantity - m, {k})) AS s{k}" for k in range(5)), *(f"sum(l_extendedprice * pow(l_quantity - m, {k})) AS t{k}" for k in range(3))])
# Cramer's rule about the mean, three by three
_DET = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))"
_D = _DET.format("s0", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4")
_E = [_DET.format("t0", "s1", "s2", "t1", "s2", "s3", "t2", "s3", "s4"), _DET.format("s0", "t0", "s2", "s1", "t1", "s3", "s2", "t2", "s4"), _DET.format("s0", "s1", "t0", "s1", "s2", "t1", "s2", "s3", "t2")]


@query("chart_quadratic", f"""WITH m AS (SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY 1), s AS (SELECT l_returnflag, m, {_S} FROM lineitem JOIN m USING (l_returnflag) GROUP BY ALL),
b AS (SELECT l_returnflag, m, {_E[0]} / {_D} AS b0, {_E[1]} / {_D} AS b1, {_E[2]} / {_D} AS b2 FROM s)
SELECT l_returnflag, round(b0 - b1 * m + b2 * m * m, 3) AS c0, round(b1 - 2 * b2 * m, 4) AS c1, round(b2, 6) AS c2 FROM b""")
def chart_quadratic(spark, d):
    out = c.t_regression(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"], 2)
    return rounded(rounded(rounded(out, 3, "c0"), 4, "c1"), 6, "c2")


@query("chart_loess", """WITH ends AS (SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi, ceil(count(*) * 0.3) AS wanted FROM lineitem GROUP BY 1),
points AS (SELECT l_returnflag, k::INT AS step, lo + (hi - lo) * k / 10.0 AS x, wanted FROM ends, range(11) AS g(k)),
d AS (SELECT p.*, l_quantity AS v, l_extendedprice AS y, abs(l_quantity - x) AS d FROM points p JOIN lineitem l ON p.l_returnflag = l.l_returnflag),
r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag, step ORDER BY d) AS place FROM d),
n AS (SELECT *, max(d) OVER (PARTITION BY l_returnflag, step) AS h FROM r WHERE place <= wanted),
w AS (SELECT *, pow(1 - pow(least(d / ((CASE WHEN h > 0 THEN h ELSE 1 END) * 1.000001), 1), 3), 3) AS w, v - x AS u FROM n),
s AS (SELECT l_returnflag, step, x, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * y) AS t0, sum(w * u * y) AS t1 FROM w GROUP BY ALL)
SELECT l_returnflag, step, x, round(CASE WHEN abs(s0 * s2 - s1 * s1) > 1e-12 THEN (t0 * s2 - t1 * s1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END, 4) AS y FROM s""")
def chart_loess(spark, d):
    return rounded(c.t_loess(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), 4, "y")


@query("chart_loess_prices", """WITH ends AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, ceil(count(*) * 0.3) AS wanted FROM lineitem GROUP BY 1),
points AS (SELECT l_returnflag, k::INT AS step, lo + (hi - lo) * k / 10.0 AS x, wanted FROM ends, range(11) AS g(k)),
d AS (SELECT p.*, l_extendedprice AS v, l_quantity AS y, abs(l_extendedprice - x) AS d FROM points p JOIN lineitem l ON p.l_returnflag = l.l_returnflag),
r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag, step ORDER BY d) AS place FROM d),
n AS (SELECT *, max(d) OVER (PARTITION BY l_returnflag, step) AS h FROM r WHERE place <= wanted),
w AS (SELECT *, pow(1 - pow(least(d / ((CASE WHEN h > 0 THEN h ELSE 1 END) * 1.000001), 1), 3), 3) AS w, v - x AS u FROM n),
s AS (SELECT l_returnflag, step, x, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * y) AS t0, sum(w * u * y) AS t1 FROM w GROUP BY ALL)
SELECT l_returnflag, step, x, round(CASE WHEN abs(s0 * s2 - s1 * s1) > 1e-12 * s0 * s0 THEN (t0 * s2 - t1 * s1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END, 4) AS y FROM s""")
def chart_loess_prices(spark, d):
    """Over many different values, so that buckets of points count by their moments."""
    return rounded(c.t_loess(t(spark, d, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"], bucket=256), 4, "y")


@query("chart_compose", "SELECT o_orderpriority AS k, count(*) AS n, 'all' AS view, 'layer' AS composition FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*), 'open', 'layer' FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def chart_compose(spark, d):
    count = lambda df: df.groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n"))
    orders = t(spark, d, "orders")
    return c.compose({"all": count(orders), "open": count(orders.where("o_orderstatus = 'O'"))}, "layer")


@query("chart_crossfilter", "SELECT 'l_tax' AS view, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 5 AND 20 UNION ALL SELECT 'l_quantity', count(*) FROM lineitem WHERE l_tax BETWEEN 0.02 AND 0.05")
def chart_crossfilter(spark, d):
    return c.interact(t(spark, d, "lineitem"), "crossfilter", {"l_tax": (0.02, 0.05), "l_quantity": (5, 20)}).groupBy("view").agg(F.count("*").alias("n"))


@query("chart_brush_legend", "SELECT count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 5 AND 20 AND l_returnflag IN ('A', 'R')")
def chart_brush_legend(spark, d):
    return c.interact(c.interact(t(spark, d, "lineitem"), "brush", {"l_quantity": (5, 20)}), "legend", {"l_returnflag": ["A", "R"]}).agg(F.count("*").alias("n"))


@query("chart_agg_alias", "SELECT event_id, ['SUM', 'AVG', 'AVG', 'AVG', 'COUNT', 'MAX', 'MIN', 'MEDIAN', 'DISTINCT', 'COUNT', 'COUNT'][event_id % 11 + 1] AS kind FROM events")
def chart_agg_alias(spark, d):
    names = F.array(*(F.lit(n) for n in ("Sum", "avg", "AVERAGE", "mean", "count", "Max", "min", "Median", "distinct", "mode", None)))
    return t(spark, d, "events").select("event_id", c.agg_alias(F.element_at(names, (F.col("event_id") % 11 + 1).cast("int"))).alias("kind"))


@query("chart_candidate_query", "SELECT c_mktsegment, n_name, round(avg(c_acctbal), 6) AS avg_c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def chart_candidate_query(spark, d):
    both = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(c.aggregate(both, ["c_mktsegment", "n_name"], ["c_acctbal"], "mean"), 6, "avg_c_acctbal")


# --- recipes


def orders_by_day(spark, d):
    return t(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))


_MONTHS = "(SELECT strftime(o_orderdate, '%Y-%m') AS month, count(o_totalprice)::DOUBLE AS value FROM orders GROUP BY 1)"


@query("recipe_bar", "SELECT o_orderpriority, count(o_totalprice) AS value, count(o_totalprice) > 3000 AS flag FROM orders GROUP BY 1")
def recipe_bar(spark, d):
    return r.r_bar(t(spark, d, "orders"), "o_orderpriority", "o_totalprice", 3000, "count")


@query("recipe_highlight_bar", "SELECT p_brand, value, value = max(value) OVER () AS flag FROM (SELECT p_brand, sum(p_size)::BIGINT AS value FROM part GROUP BY 1)")
def recipe_highlight(spark, d):
    return r.r_bar(t(spark, d, "part"), "p_brand", "p_size")


@query("recipe_sorted_bar", "SELECT p_brand, value, dense_rank() OVER (ORDER BY value DESC) AS \"order\" FROM (SELECT p_brand, sum(p_size)::BIGINT AS value FROM part GROUP BY 1)")
def recipe_sorted(spark, d):
    return r.r_sorted_bar(t(spark, d, "part"), "p_brand", "p_size")


@query("recipe_grouped_bar", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS value FROM lineitem GROUP BY ALL")
def recipe_grouped(spark, d):
    return r.r_grouped_bar(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity")


@query("recipe_stacked", "SELECT o_orderpriority, o_orderstatus, value, y1::BIGINT AS y1, (y1 - value)::BIGINT AS y0 FROM (SELECT *, sum(value) OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS y1 FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS value FROM orders GROUP BY ALL))")
def recipe_stacked(spark, d):
    return r.r_stacked(t(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "*", "count")


@query("recipe_normalized_stack", """SELECT o_orderpriority, o_orderstatus, value, round(value / total, 10) AS share, round(y1 / total, 10) AS y1, round((y1 - value) / total, 10) AS y0 FROM (SELECT *, sum(value) OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS y1, sum(value) OVER (PARTITION BY o_orderpriority) AS total
FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS value FROM orders GROUP BY ALL))""")
def recipe_normalized(spark, d):
    return rounded(r.r_normalized_stack(t(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "*", "count"), 10, "share", "y0", "y1")


@query("recipe_diverging_stack", """SELECT o_orderpriority, o_orderstatus, value, y1 - shift AS y1, y1 - value - shift AS y0 FROM (SELECT *, (sum(value) OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus))::DOUBLE AS y1,
sum(CASE o_orderstatus WHEN 'F' THEN value::DOUBLE WHEN 'O' THEN value / 2 ELSE 0 END) OVER (PARTITION BY o_orderpriority) AS shift FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS value FROM orders GROUP BY ALL))""")
def recipe_diverging(spark, d):
    return r.r_diverging_stack(t(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "*", "O", ["F"], "count")


@query("recipe_percent_of_total", "SELECT c_mktsegment, count(*) AS value, round(count(*) / (SELECT count(*) FROM customer), 10) AS share FROM customer GROUP BY 1")
def recipe_percent(spark, d):
    return rounded(r.r_percent_of_total(t(spark, d, "customer"), "c_mktsegment", "*", "count"), 10, "share")


@query("recipe_mean_line", "SELECT c_mktsegment, count(*) AS value, (SELECT avg(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)) AS mean FROM customer GROUP BY 1")
def recipe_mean_line(spark, d):
    return r.r_mean_line(t(spark, d, "customer"), "c_mktsegment", "*", "count")


@query("recipe_rolling_mean_bar", f"SELECT month, value::BIGINT AS value, round(avg(value) OVER (ORDER BY month ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 8) AS rolling FROM {_MONTHS}")
def recipe_rolling(spark, d):
    return rounded(r.r_rolling_mean_bar(orders_by_day(spark, d), "month", "o_totalprice", kind="count"), 8, "rolling")


@query("recipe_negative_flag", f"SELECT month, value::BIGINT AS value, (value - lag(value) OVER (ORDER BY month))::BIGINT AS change, value - lag(value) OVER (ORDER BY month) < 0 AS negative FROM {_MONTHS}")
def recipe_negative(spark, d):
    return r.r_negative_flag(orders_by_day(spark, d), "month", "o_totalprice", "count")


@query("recipe_range_bar", "SELECT p_brand, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY 1")
def recipe_range(spark, d):
    return r.r_range_bar(t(spark, d, "part"), "p_brand", "p_retailprice")


@query("recipe_dual_axis", "SELECT l_returnflag, sum(l_quantity) AS \"left\", round(avg(l_discount), 8) AS \"right\" FROM lineitem GROUP BY 1")
def recipe_dual(spark, d):
    return rounded(r.r_dual_axis(t(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_discount"), 8, "right")


@query("recipe_top_k", "SELECT * FROM (SELECT o_custkey, count(*) AS value, rank() OVER (ORDER BY count(*) DESC) AS rank FROM orders GROUP BY 1) WHERE rank <= 10")
def recipe_top_k(spark, d):
    return r.r_top_k(t(spark, d, "orders"), "o_custkey", "*", 10, "count")


@query("recipe_residuals", "SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 5) AS residual FROM orders")
def recipe_residuals(spark, d):
    return rounded(r.r_residuals(t(spark, d, "orders"), "o_totalprice", ["o_orderpriority"]).select("o_orderkey", "residual"), 5, "residual")


@query("recipe_comet", "SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS \"start\", sum(l_quantity) FILTER (l_linestatus = 'O') AS \"end\", sum(l_quantity) FILTER (l_linestatus = 'O') - sum(l_quantity) FILTER (l_linestatus = 'F') AS delta FROM lineitem GROUP BY 1")
def recipe_comet(spark, d):
    return r.r_comet(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", "F", "O")


@query("recipe_gantt", "SELECT user_id, min(ts)::VARCHAR AS \"start\", max(ts)::VARCHAR AS \"end\" FROM events GROUP BY 1")
def recipe_gantt(spark, d):
    g = r.r_gantt(t(spark, d, "events"), "user_id", "ts")
    return g.select("user_id", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))


@query("recipe_waterfall", f"SELECT month, value::BIGINT AS value, total::BIGINT AS total, coalesce(lag(total) OVER (ORDER BY month), 0)::DOUBLE AS previous FROM (SELECT *, sum(value) OVER (ORDER BY month) AS total FROM {_MONTHS})")
def recipe_waterfall(spark, d):
    return r.r_waterfall(orders_by_day(spark, d), "month", "o_totalprice", "count")


@query("recipe_wilkinson", "SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS place FROM part")
def recipe_wilkinson(spark, d):
    return r.r_wilkinson(t(spark, d, "part"), "p_size", "p_partkey")


@query("recipe_cumulative", """SELECT o_orderstatus, month, n, (sum(n) OVER (PARTITION BY o_orderstatus ORDER BY month))::BIGINT AS running_count, round(sum(value) OVER (PARTITION BY o_orderstatus ORDER BY month), 2) AS running_sum
FROM (SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, sum(o_totalprice) AS value FROM orders GROUP BY ALL)""")
def recipe_cumulative(spark, d):
    return rounded(r.r_cumulative(orders_by_day(spark, d), "month", "o_totalprice", ["o_orderstatus"]).drop("value"), 2, "running_sum")


@query("recipe_multi_line", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS period, event_type, round(avg(value), 8) AS value FROM events GROUP BY ALL")
def recipe_multi_line(spark, d):
    out = r.r_multi_line(t(spark, d, "events"), "ts", "day", "event_type", "value")
    return rounded(out.withColumn("period", F.date_format("period", "yyyy-MM-dd")), 8, "value")


@query("recipe_last_label", "SELECT event_type, max(ts)::VARCHAR AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def recipe_last_label(spark, d):
    out = r.r_last_label(t(spark, d, "events"), "ts", "event_type", "value", "event_id")
    return out.withColumn("ts", F.col("ts").cast("string"))


@query("recipe_layered_aggs", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS period, round(avg(value), 8) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def recipe_layered(spark, d):
    out = r.r_layered_aggs(t(spark, d, "events"), "ts", "day", "value")
    return rounded(out.withColumn("period", F.date_format("period", "yyyy-MM-dd")), 8, "mean")


@query("recipe_bump", "SELECT month, o_orderpriority, value, rank() OVER (PARTITION BY month ORDER BY value DESC) AS rank FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, count(*) AS value FROM orders GROUP BY ALL)")
def recipe_bump(spark, d):
    return r.r_bump(orders_by_day(spark, d), "month", "o_orderpriority", "*", "count")


@query("recipe_horizon", "SELECT o_orderstatus, month, value, least(value, 50) AS layer1, greatest(value - 50, 0) AS layer2 FROM (SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS month, count(*)::DOUBLE AS value FROM orders GROUP BY ALL)")
def recipe_horizon(spark, d):
    out = r.r_area_facets(orders_by_day(spark, d), "month", "o_orderstatus", "*", 50, "count")
    return out.withColumn("value", F.col("value").cast("double"))


@query("recipe_histogram", "SELECT event_type, floor(value / 10.0) * 10.0 AS bin_start, floor(value / 10.0) * 10.0 + 10.0 AS bin_end, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL")
def recipe_histogram(spark, d):
    return r.r_histogram(t(spark, d, "events"), "value", keys=["event_type"], step=10.0)


@query("recipe_hist2d", f"SELECT floor(l_quantity / a.step) * a.step AS x_start, floor(l_extendedprice / b.step) * b.step AS y_start, count(*) AS n FROM lineitem, {_NICE.format(v='l_quantity', n=10, table='lineitem')} a, {_NICE.format(v='l_extendedprice', n=10, table='lineitem')} b GROUP BY ALL")
def recipe_hist2d(spark, d):
    return r.r_hist2d(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("recipe_boxplot", "SELECT p_brand, min(p_retailprice) AS low, round(quantile_cont(p_retailprice, 0.25), 6) AS q1, round(median(p_retailprice), 6) AS median, round(quantile_cont(p_retailprice, 0.75), 6) AS q3, max(p_retailprice) AS high FROM part GROUP BY 1")
def recipe_boxplot(spark, d):
    return rounded(r.r_boxplot(t(spark, d, "part"), "p_brand", "p_retailprice"), 6, "q1", "median", "q3")


@query("recipe_ecdf", "SELECT DISTINCT l_returnflag, l_quantity AS x, round(cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity), 10) AS p FROM lineitem")
def recipe_ecdf(spark, d):
    return rounded(r.r_ecdf(t(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]), 10, "p")


@query("recipe_qq", "SELECT round(k / 20.0, 4) AS p, round(qa[k + 1], 6) AS qa, round(qb[k + 1], 6) AS qb FROM (SELECT quantile_cont(l_extendedprice, [0, .05, .1, .15, .2, .25, .3, .35, .4, .45, .5, .55, .6, .65, .7, .75, .8, .85, .9, .95, 1]) AS qa, quantile_cont(l_quantity, [0, .05, .1, .15, .2, .25, .3, .35, .4, .45, .5, .55, .6, .65, .7, .75, .8, .85, .9, .95, 1]) AS qb FROM lineitem), range(21) AS g(k)")
def recipe_qq(spark, d):
    return rounded(rounded(r.r_qq(t(spark, d, "lineitem"), "l_extendedprice", "l_quantity"), 4, "p"), 6, "qa", "qb")


@query("recipe_density", """WITH ends AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1), points AS (SELECT event_type, k AS step, lo + (hi - lo) * k / 20.0 AS x FROM ends, range(21) AS g(k))
SELECT p.event_type, step::INT AS step, x, round(sum(exp(-pow((x - value) / 5.0, 2) / 2)) / (count(value) * 5.0 * 2.5066282746310002), 8) AS density FROM points p JOIN events e ON p.event_type = e.event_type GROUP BY ALL""")
def recipe_density(spark, d):
    return rounded(r.r_density(t(spark, d, "events"), "value", ["event_type"], 5.0), 8, "density")


@query("recipe_punch_card", "SELECT dayofweek(ts)::INT AS weekday, hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY ALL")
def recipe_punch_card(spark, d):
    return r.r_punch_card(t(spark, d, "events"), "ts")


@query("recipe_heatmap", "SELECT p_brand, p_size, round(avg(p_retailprice), 8) AS value FROM part GROUP BY ALL")
def recipe_heatmap(spark, d):
    return rounded(r.r_heatmap(t(spark, d, "part"), "p_brand", "p_size", "p_retailprice"), 8, "value")


@query("recipe_error_bars", "SELECT p_brand, round(avg(p_retailprice), 6) AS mean, round(avg(p_retailprice) - 1.96 * stddev_samp(p_retailprice) / sqrt(count(*)), 6) AS low, round(avg(p_retailprice) + 1.96 * stddev_samp(p_retailprice) / sqrt(count(*)), 6) AS high FROM part GROUP BY 1")
def recipe_error_bars(spark, d):
    return rounded(r.r_error_bars(t(spark, d, "part"), "p_brand", "p_retailprice"), 6, "mean", "low", "high")


@query("recipe_trend_fit", "SELECT p_brand, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 5) AS intercept, round(regr_r2(p_retailprice, p_size), 8) AS r2 FROM part GROUP BY 1")
def recipe_trend(spark, d):
    out = r.r_trend_fit(t(spark, d, "part"), "p_size", "p_retailprice", ["p_brand"])
    return rounded(rounded(rounded(out, 6, "slope"), 5, "intercept"), 8, "r2")


@query("recipe_scatter", "SELECT p_size AS x, p_retailprice AS y, p_partkey AS size, p_brand AS color FROM part")
def recipe_scatter(spark, d):
    return r.r_scatter(t(spark, d, "part"), "p_size", "p_retailprice", "p_partkey", "p_brand")


@query("recipe_correlations", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 8) AS corr FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 8) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 8) FROM lineitem")
def recipe_correlations(spark, d):
    return rounded(r.r_correlations(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]), 8, "corr")


@query("recipe_marginals", f"SELECT floor(l_quantity / step) * step AS bin_start, floor(l_quantity / step) * step + step AS bin_end, count(*) AS n, 'x' AS side FROM lineitem, {_NICE.format(v='l_quantity', n=10, table='lineitem')} GROUP BY ALL UNION ALL SELECT floor(l_extendedprice / step) * step, floor(l_extendedprice / step) * step + step, count(*), 'y' FROM lineitem, {_NICE.format(v='l_extendedprice', n=10, table='lineitem')} GROUP BY ALL")
def recipe_marginals(spark, d):
    return r.r_marginals(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("recipe_interactive_average", "SELECT round(avg(l_extendedprice), 5) AS mean FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def recipe_interactive(spark, d):
    return r.r_interactive(t(spark, d, "lineitem"), {"l_quantity": (10, 20)}, lambda df: df.agg(F.round(F.avg("l_extendedprice"), 5).alias("mean")))
