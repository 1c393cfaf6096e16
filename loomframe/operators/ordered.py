"""Windows over an order that no key splits: range parts, a total or an edge for each, carried on to the next.

A window without a partition key, or with a key that holds most rows, sorts in one task. Here rows are dealt into ranges of
the order by sampled bounds and written once with their place. Whatever a row needs from other parts is a sum over the
parts before it, or one of the few rows at their edges; tables of these have a row for each part and key.

Cases: null order values come first, as in an ascending sort; rows that tie in the whole order are numbered in any order
between them, so an order with ties needs a last column that settles them; an empty table gives an empty result. Names that
begin with two underscores are reserved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import state_path

#: Bits of a place that number the rows of one part, as monotonically_increasing_id lays them out.
_ROW_BITS = 33


def _columns(names: list[str | Column]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in names]


def placed(df: DataFrame, keys: list[str], order: list[str | Column], parts: int | None = None) -> DataFrame:
    """The rows in ranges of keys and order, written once, with __place: their part and their row in it."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = _columns([*keys, *order])
    ranged = df.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumn("__place", F.monotonically_increasing_id())
    path = state_path(spark, "ordered")
    ranged.write.parquet(path)
    return spark.read.schema(ranged.schema).parquet(path)


def _part() -> Column:
    return F.shiftright("__place", _ROW_BITS)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys and parts, nulls being equal; the right side has them under names of its own."""
    test = F.col("__part") == F.col("__o_part")
    for k, c in enumerate(keys):
        test &= left[c].eqNullSafe(right[f"__o_{k}"])
    return test


def _joined(rows: DataFrame, edges: DataFrame, keys: list[str], add: list[str]) -> DataFrame:
    own = edges.select(F.col("__part").alias("__o_part"), *(F.col(c).alias(f"__o_{k}") for k, c in enumerate(keys)), *add)
    return rows.join(own, _same(rows, own, keys), "left").drop("__o_part", *(f"__o_{k}" for k in range(len(keys))))


def number_rows(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "row_number", parts: int | None = None) -> DataFrame:
    """The rows with their number from 1 on within their keys, in the order."""
    rows = placed(df, keys, order, parts).withColumn("__part", _part())
    edges = rows.groupBy("__part", *keys).agg(F.min("__place").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    out = _joined(rows, edges, keys, ["__first", "__before"])
    return out.withColumn(name, F.col("__place") - F.col("__first") + F.col("__before") + 1).drop("__place", "__part", "__first", "__before")


def running(df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, Column], parts: int | None = None, own: bool = True) -> DataFrame:
    """The rows with running sums: name -> summed value; own: whether a row's own value counts. Null values count as
    nothing; a sum over nulls or no rows alone is null."""
    values = {f"__v{k}": v for k, v in enumerate(sums.values())}
    rows = placed(df.withColumns(values), keys, order, parts).withColumn("__part", _part())
    inside = Window.partitionBy("__part", *keys).orderBy("__place")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    edges = rows.groupBy("__part", *keys).agg(*(F.sum(v).alias(f"__t_{v}") for v in values))
    before = Window.partitionBy(*keys) if keys else Window
    before = before.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumns({f"__b_{v}": F.sum(f"__t_{v}").over(before) for v in values})
    out = _joined(rows, edges, keys, [f"__b_{v}" for v in values])
    out = out.withColumns({f"__s_{v}": F.sum(v).over(upto) for v in values})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = lambda v: F.when(F.col(f"__s_{v}").isNotNull() | F.col(f"__b_{v}").isNotNull(), zero(f"__s_{v}") + zero(f"__b_{v}"))
    out = out.withColumns({n: total(v) for n, v in zip(sums, values, strict=True)})
    return out.drop("__place", "__part", *(f"{p}{v}" for v in values for p in ("", "__b_", "__s_")))


def framed(df: DataFrame, keys: list[str], order: list[str | Column], before: int, after: int, over: dict[str, Callable[[Window], Column]], parts: int | None = None) -> DataFrame:
    """The rows with what functions of a window give on the frame from before rows back to after rows on: a lag, a lead, a
    rolling mean. Rows near the edge of a part are sent to the parts whose frames reach them, however small these are, so a
    part holds its own rows and at most before + after of others."""
    rows = placed(df, keys, order, parts).withColumn("__part", _part())
    counts = rows.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys) if keys else Window
    ends = counts.withColumn("__end", F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("__begin", F.col("__end") - F.col("__n"))
    first = rows.groupBy(*keys, "__part").agg(F.min("__place").alias("__first"))
    first = first.withColumnRenamed("__part", "__f_part").withColumnsRenamed({k: f"__f_{i}" for i, k in enumerate(keys)})
    test = ends["__part"] == first["__f_part"]
    for i, k in enumerate(keys):
        test &= ends[k].eqNullSafe(first[f"__f_{i}"])
    ends = ends.join(first, test).drop("__f_part", *(f"__f_{i}" for i in range(len(keys))))
    numbered = _joined(rows, ends, keys, ["__first", "__begin", "__end"]).withColumn("__at", F.col("__place") - F.col("__first") + F.col("__begin"))
    # a part needs the rows from before its first to after its last one; these lie near the edge of parts about it
    near = numbered.where((F.col("__at") >= F.col("__end") - before) | (F.col("__at") < F.col("__begin") + after)).drop("__begin", "__end", "__first")
    spans = ends.select(*(F.col(k).alias(f"__o_{i}") for i, k in enumerate(keys)), F.col("__part").alias("__to"), F.col("__begin").alias("__from_at"), F.col("__end").alias("__to_at"))
    reach = (F.col("__part") != F.col("__to")) & (F.col("__at") >= F.col("__from_at") - before) & (F.col("__at") < F.col("__to_at") + after)
    for i, k in enumerate(keys):
        reach &= near[k].eqNullSafe(spans[f"__o_{i}"])
    # the spans are one row for each part of a key, and near rows before + after for each: both bounded by the parts
    lent = near.join(F.broadcast(spans) if not keys else spans, reach).withColumn("__part", F.col("__to")).withColumn("__own", F.lit(False))
    own = numbered.withColumn("__own", F.lit(True))
    both = own.select(*df.columns, "__part", "__at", "__own").union(lent.select(*df.columns, "__part", "__at", "__own"))
    window = Window.partitionBy("__part", *keys).orderBy("__at")
    out = both.withColumns({n: f(window) for n, f in over.items()})
    return out.where("__own").drop("__part", "__at", "__own")


def rank_rows(df: DataFrame, by: list[str], descending: bool = False, rank: str | None = "rank", dense: str | None = None, parts: int | None = None) -> DataFrame:
    """The rows with their rank or dense rank by columns, over all rows; nulls last. The different values are counted first
    and numbered in range parts, so that ties stay together however many they are, and joined back to the rows."""
    values = df.groupBy(*by).agg(F.count("*").alias("__n"))
    sort = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in by]
    numbered = running(values, [], sort, {"__before": F.col("__n"), "__less": F.lit(1)}, parts, own=False)
    first = lambda c: F.coalesce(F.col(c), F.lit(0)) + 1
    found = numbered.select(*(F.col(c).alias(f"__o_{k}") for k, c in enumerate(by)), *(c.alias(n) for n, c in ((rank, first("__before")), (dense, first("__less"))) if n))
    test = F.lit(True)
    for k, c in enumerate(by):
        test &= F.col(c).eqNullSafe(F.col(f"__o_{k}"))
    return df.join(found, test).drop(*(f"__o_{k}" for k in range(len(by))))
