"""Queries over sketches, footers, versioned and bucketed tables and the balance stream, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collection, shaping, sketches
from ..operators import profiling as p
from ..sources import bucketed
from ..sources.scratch import state_path
from ..sources.tables import read_table as t
from ..sources.versioned import VersionedTable
from ..streaming import balance_stream
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


# --- sketches

_COLUMNS = ("l_quantity", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate", "l_orderkey")
_TEXT = {"l_quantity": "(l_quantity::DOUBLE)", "l_extendedprice": "(l_extendedprice::DOUBLE)", "l_shipdate": "l_shipdate"}


@query("profile_merged_sketches", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_exact, true AS distinct_near, true AS middle_near FROM lineitem" for c in _COLUMNS) + ")")
def profile_merged_sketches(spark, d):
    """Sketches of ten parts, put together in two steps. Estimates of distinct values are held to 3 % of the exact count, and
    medians to the middle 4 % of the rows."""
    lines = t(spark, d, "lineitem")
    parts = sketches.part_sketches(lines.withColumn("part", F.col("l_orderkey") % 10), list(_COLUMNS), ["part"])
    halves = [sketches.merged(parts.where(f"part % 2 = {k}")) for k in (0, 1)]
    found = sketches.profile_of(sketches.fold_in(halves[0], halves[1:]))
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("text"), (F.col(c) if c not in ("l_returnflag", "l_shipdate") else F.lit(None)).cast("double").alias("value")) for c in _COLUMNS))
    rows = lines.select(F.inline(cells)).join(F.broadcast(found.select("column", "q50")), F.col("name") == F.col("column"))
    exact = rows.groupBy("name").agg(F.count_distinct("text").alias("n_exact"), F.count_if(F.col("value") < F.col("q50")).alias("below"), F.count_if(F.col("value") <= F.col("q50")).alias("upto"), F.count("value").alias("n_values"))
    near = (F.col("below") <= 0.52 * F.col("n_values")) & (F.col("upto") >= 0.48 * F.col("n_values"))
    joined = found.join(exact, F.col("name") == F.col("column"))
    return joined.select("column", "n_rows", "n_nulls", "n_exact", (F.abs(F.col("n_distinct") - F.col("n_exact")) <= 0.03 * F.col("n_exact")).alias("distinct_near"), near.alias("middle_near"))


@query("shape_approx_agg", "SELECT l_returnflag, count(DISTINCT l_linenumber) AS few, true AS many_near, true AS median_near FROM lineitem GROUP BY 1")
def shape_approx_agg(spark, d):
    """Sketches by group against exact aggregates; the distinct values of a small column come out exact."""
    lines = t(spark, d, "lineitem")
    kinds = {"few": ("distinct", "l_linenumber"), "many": ("distinct", "l_partkey"), "middle": ("median", "l_quantity")}
    near = shaping.group_agg(lines, ["l_returnflag"], kinds, approx=True)
    exact = shaping.group_agg(lines, ["l_returnflag"], kinds).select(F.col("l_returnflag").alias("mode"), F.col("many").alias("n"), F.col("middle").alias("m"))
    joined = near.join(exact, F.col("l_returnflag") == F.col("mode"))
    return joined.select("l_returnflag", "few", (F.abs(F.col("many") - F.col("n")) <= 0.03 * F.col("n")).alias("many_near"), (F.abs(F.col("middle") - F.col("m")) <= 2).alias("median_near"))


# --- footers


@query("profile_footers", "SELECT 'l_orderkey' AS \"column\", count(*) AS n_rows, count(*) - count(l_orderkey) AS n_nulls, min(l_orderkey)::DOUBLE AS low, max(l_orderkey)::DOUBLE AS high FROM lineitem UNION ALL SELECT 'l_linenumber', count(*), count(*) - count(l_linenumber), min(l_linenumber), max(l_linenumber) FROM lineitem UNION ALL SELECT 'l_quantity', count(*), count(*) - count(l_quantity), min(l_quantity), max(l_quantity) FROM lineitem")
def profile_footers(spark, d):
    found = p.footer_stats(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"])
    return found.withColumns({c: F.col(c).cast("double") for c in ("low", "high")})


# --- versioned and bucketed tables


@query("table_versions", "SELECT l_suppkey, max(l_orderkey * 10 + l_linenumber) AS place, 5 AS n_batches FROM lineitem WHERE l_orderkey % 7 < 5 GROUP BY 1")
def table_versions(spark, d):
    """Five batches, of which two come twice, merged by supplier: the last line stays, and a batch that repeats does nothing."""
    lines = t(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), (F.col("l_orderkey") % 7).alias("batch"))
    table = VersionedTable(spark, state_path(spark, "versions"), "l_suppkey", buckets=4)
    for k in (0, 1, 0, 2, 3, 1, 4):
        table.merge(lines.where(F.col("batch") == k).drop("batch"), f"batch {k}", "place")
    table.vacuum()
    return table.read(lines.drop("batch").schema).withColumn("n_batches", F.lit(len(table.snapshot().batches)))


@query("collection_bucketed", with_fx("samples", "SELECT c_custkey AS question_id, greatest(10 - coalesce(n, 0), 0) AS remaining FROM customer LEFT JOIN (SELECT source_question_id, count(*) AS n FROM fx WHERE validation_passed GROUP BY 1) ON source_question_id = c_custkey WHERE greatest(10 - coalesce(n, 0), 0) > 0"))
def collection_bucketed(spark, d):
    """What is left to do, from samples and questions that are kept in buckets: neither side is shuffled."""
    tag = state_path(spark, "b")[-12:]
    questions = bucketed.write_bucketed(t(spark, d, "customer").select(F.col("c_custkey").alias("question_id")), f"questions_{tag}", "question_id")
    samples = bucketed.write_bucketed(fx(spark, d, "samples").select("sample_id", "source_question_id", "validation_passed"), f"samples_{tag}", "source_question_id")
    return collection.remaining_work(questions, collection.existing_samples(samples), 10)


# --- the balance as a stream


@query("stream_balance", """WITH e AS (SELECT *, max(ts) OVER () AS last FROM events WHERE event_type IS NOT NULL)
SELECT event_type AS value, count(*) + count(*) FILTER (event_id % 80 = 0) AS n, count(*) FILTER (event_id % 80 = 40 AND ts + INTERVAL 1 HOUR > last - INTERVAL 10 MINUTE) AS reserved FROM e GROUP BY 1""")
def stream_balance(spark, d):
    """Every event is a sample, one in forty a reservation too; half of these are committed, and the others expire."""
    events = spark.readStream.schema(t(spark, d, "events").schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    row = lambda kind, ts: F.struct(F.lit(kind).alias("kind"), ts.alias("at"))
    some = F.when(F.col("event_id") % 80 == 0, F.array(row("sample", F.col("ts")), row("reserve", F.col("ts")), row("commit", F.col("ts") + F.expr("INTERVAL 1 SECOND")))).when(F.col("event_id") % 80 == 40, F.array(row("sample", F.col("ts")), row("reserve", F.col("ts")))).otherwise(F.array(row("sample", F.col("ts"))))
    rows = events.select(F.col("event_id").alias("id"), F.lit("event_types").alias("dimension"), F.col("event_type").alias("value"), F.col("event_id").cast("string").alias("reservation_id"), F.explode(some).alias("r"))
    path = state_path(spark, "balance")
    balance_stream.run_balance(rows.select("id", F.col("r.at").alias("ts"), "dimension", "value", F.col("r.kind").alias("kind"), "reservation_id", F.lit(1).alias("n")), path)
    both = balance_stream.read_balance(spark, path)
    fixed = balance_stream.read_balance(spark, path, with_reserved=False).select(F.col("value").alias("v"), F.col("n").alias("fixed"))
    return both.join(fixed, F.col("value") == F.col("v")).select("value", F.col("fixed").alias("n"), (F.col("n") - F.col("fixed")).alias("reserved"))
