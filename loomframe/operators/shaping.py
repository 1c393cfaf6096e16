"""Relational shaping: from tables to frames that a chart can be drawn from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordered import number_rows
from .sketches import HLL_BITS, KLL_K


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns under new names, in the order given: {name: column or expression}."""
    return df.select(*(F.expr(e).alias(name) for name, e in columns.items()))


def where(df: DataFrame, predicate: str | Column) -> DataFrame:
    return df.where(predicate)


def join(left: DataFrame, right: DataFrame, on: dict[str, str], how: str = "inner") -> DataFrame:
    """Equi-join on {left column: right column}; how: inner, left, right or full. Spark picks the strategy by size."""
    return left.join(right, [left[a] == right[b] for a, b in on.items()], how)


def inner_join(left: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    return join(left, right, on, "inner")


def semi(left: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    return join(left, right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    return join(left, right, on, "left_anti")


def aggregate_of(kind: str, value: str, approx: bool = False) -> Column:
    """sum, count, avg, min, max, total (0.0 when there is none), group_concat, median, distinct, variance, stdev.

    approx: distinct and median by sketches, which are merged on the way and never hold a group's values."""
    v = F.col(value) if value != "*" else F.lit(1)
    kinds: dict[str, Callable[[], Column]] = {
        "sum": lambda: F.sum(v),
        "count": lambda: F.count(v),
        "avg": lambda: F.avg(v),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
        "total": lambda: F.coalesce(F.sum(v.cast("double")), F.lit(0.0)),
        "group_concat": lambda: F.array_join(F.array_sort(F.collect_list(v.cast("string"))), ","),
        "median": lambda: F.median(v),
        "distinct": lambda: F.count_distinct(v),
        "variance": lambda: F.var_samp(v),
        "stdev": lambda: F.stddev_samp(v),
    }
    if approx:
        number = F.kll_sketch_agg_double(F.when(~F.isnan(v.cast("double")), v.cast("double")), F.lit(KLL_K))
        middle = F.when(F.count(v) > 0, F.kll_sketch_get_quantile_double(number, F.lit(0.5)))
        kinds |= {"median": lambda: middle, "distinct": lambda: F.hll_sketch_estimate(F.hll_sketch_agg(v.cast("string"), F.lit(HLL_BITS)))}
    return kinds[kind.lower()]()


def group_agg(df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str]], approx: bool = False) -> DataFrame:
    """{name: (kind, column)} by group."""
    return df.groupBy(*keys).agg(*(aggregate_of(k, v, approx).alias(name) for name, (k, v) in aggs.items()))


def having(grouped: DataFrame, predicate: str | Column) -> DataFrame:
    return grouped.where(predicate)


def with_views(spark: SparkSession, frames: dict[str, DataFrame], sql: str) -> DataFrame:
    """SQL over named frames, as a statement with common table expressions has them."""
    return spark.sql(sql, **frames)


def union(a: DataFrame, b: DataFrame, distinct: bool = False) -> DataFrame:
    both = a.unionByName(b)
    return both.distinct() if distinct else both


def order_by(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order by columns; a leading minus means descending. Nulls come last either way."""
    return df.orderBy(*(F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in columns))


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def top_k(df: DataFrame, keys: list[str], value: str, k: int, kind: str = "sum", name: str = "value") -> DataFrame:
    """The k groups with the largest aggregate; ties by key."""
    return group_agg(df, keys, {name: (kind, value)}).orderBy(F.col(name).desc_nulls_last(), *keys).limit(k)


def manual_variance(df: DataFrame, keys: list[str], value: str, name: str = "variance") -> DataFrame:
    """Mean of squares less square of the mean."""
    return df.groupBy(*keys).agg(F.var_pop(value).alias(name))


def group_rank(df: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    """Ascending rank within the group; ties share their average rank, null has none."""
    present = F.col(value).isNull()
    by_value = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    peers = Window.partitionBy(*keys, value)
    return df.withColumn(name, F.when(~present, F.rank().over(by_value) + (F.count(F.lit(1)).over(peers) - 1) / F.lit(2.0)))


def sql_ranks(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"row_number": F.row_number().over(w), "rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w)})


def with_overall(df: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over all rows beside every row: one row, joined back, in place of a window over one partition."""
    return df.crossJoin(F.broadcast(df.agg(*(c.alias(name) for name, c in aggs.items()))))


def share_of_total(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    return with_overall(df, {"__total": F.sum(value)}).withColumn(name, F.col(value) / F.col("__total")).drop("__total")


def rolling_mean(df: DataFrame, keys: list[str], order: list[str], value: str, n: int = 7, name: str = "rolling") -> DataFrame:
    """Mean of the last n rows; null until there are n values."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
    return df.withColumn(name, F.when(F.count(value).over(w) == n, F.avg(value).over(w)))


def pivot(df: DataFrame, keys: list[str], column: str, value: str, values: list, kind: str = "avg") -> DataFrame:
    """A column for each of the given values; a cell without rows is null."""
    return df.groupBy(*keys).pivot(column, values).agg(aggregate_of(kind, value))


def to_datetime(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.try_to_timestamp(F.col(column).cast("string")))


def cast(df: DataFrame, column: str, kind: str) -> DataFrame:
    """What can't be cast is null."""
    return df.withColumn(column, F.col(column).try_cast(kind))


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def map_values(df: DataFrame, column: str, mapping: dict, name: str | None = None) -> DataFrame:
    """Values by a small table; one that it lacks is null."""
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return df.withColumn(name or column, F.try_element_at(table, F.col(column)))


def order_categories_by_stat(df: DataFrame, category: str, value: str, name: str = "category_order") -> DataFrame:
    """The place of each row's category by ascending mean; ties by category. Means are ranked once, then joined back."""
    means = df.groupBy(category).agg(F.avg(value).alias("__mean"))
    ranked = number_rows(means, [], [F.col("__mean").asc_nulls_last(), category], name).drop("__mean")
    return df.join(ranked.withColumnRenamed(category, "__c"), F.col(category).eqNullSafe(F.col("__c"))).drop("__c")


def scale_column(df: DataFrame, column: str, factor: float) -> DataFrame:
    return df.withColumn(column, F.col(column) * factor)


def fill_or_drop_nulls(df: DataFrame, columns: list[str], how: str = "drop", value=None) -> DataFrame:
    return df.dropna(subset=columns) if how == "drop" else df.fillna(value, subset=columns)


def apply_user_shaping(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A user's own step: a function of frames, never program text."""
    return df.transform(fn)


def row_window(df: DataFrame, least: int = 5, most: int = 100) -> DataFrame:
    """One row: rows counted up to 2 * most + 1, ok (at least the least), oversized (over twice the most)."""
    n = F.count(F.lit(1))
    return df.limit(2 * most + 1).agg(n.alias("n_rows"), (n >= least).alias("ok"), (n > 2 * most).alias("oversized"))
