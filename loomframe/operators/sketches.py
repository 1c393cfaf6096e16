"""Profiles that can be merged: a row of sketches for each part and column, made once and put together as often as wanted.

Distinct values are kept as HyperLogLog sketches of 2^HLL_BITS registers (standard error about 0.8 %), quantiles of numbers as
KLL sketches of KLL_K (ranks within about 1 % of the rows). Counts, nulls, least and greatest values are exact. A part's
row has some 20 kB, whatever the part holds, so a profile of new data costs a pass over the new data alone.

Cases: nulls are counted and in no sketch; NaN counts as a value for distinct values and is left out of the quantiles; a
column without a value has no least value, no quantiles and no distinct value; an empty table has no parts, and its profile
no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Registers of a distinct sketch, as a power of two, and the size of a quantile sketch.
HLL_BITS, KLL_K = 14, 400

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def part_sketches(df: DataFrame, columns: list[str], part: list[str]) -> DataFrame:
    """part, column, n_rows, n_nulls, low and high (as text in the column's own order), hll and kll, in one pass."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rows = []
    for c in columns:
        v = F.col(c)
        number = v.cast("double") if isinstance(kinds[c], _NUMBERS) else None
        kll = F.lit(None).cast("binary") if number is None else F.kll_sketch_agg_double(F.when(~F.isnan(number), number), F.lit(KLL_K))
        rows.append(F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(v.isNull()).alias("n_nulls"), F.min(v).cast("string").alias("low"), F.max(v).cast("string").alias("high"), _sortable(F.min(v), kinds[c]).alias("low_key"), _sortable(F.max(v), kinds[c]).alias("high_key"),
            F.hll_sketch_agg(v.cast("string"), F.lit(HLL_BITS)).alias("hll"), kll.alias("kll"),
        ))
    wide = df.groupBy(*part).agg(F.array(*rows).alias("columns"))
    return wide.select(*part, F.inline("columns"))


def _sortable(value: Column, kind: T.DataType) -> Column:
    """A value's place as a number, where it has one; texts are compared as they are."""
    if isinstance(kind, _NUMBERS):
        return value.cast("double")
    return value.cast("timestamp").cast("double") if isinstance(kind, (T.DateType, T.TimestampType)) else F.lit(None).cast("double")


def merged(sketches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sketches of parts put together by column, and by key columns where some are to stay apart."""
    keys = keys or []
    order = lambda side: F.struct(F.col(f"{side}_key"), F.col(side))
    some = lambda side: F.when(F.col(side).isNotNull(), order(side))
    out = sketches.groupBy(*keys, "column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"), F.min(some("low")).alias("__low"), F.max(some("high")).alias("__high"), F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll").alias("kll"),
    )
    return out.select(*keys, "column", "n_rows", "n_nulls", F.col("__low.low").alias("low"), F.col("__high.high").alias("high"), F.col("__low.low_key").alias("low_key"), F.col("__high.high_key").alias("high_key"), "hll", "kll")


def profile_of(sketches: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """n_distinct and the quantiles (q25 and so on) of merged sketches, beside their exact counts and ends."""
    n = F.when(F.col("kll").isNotNull(), F.kll_sketch_get_n_double("kll"))
    q = {f"q{round(100 * p)}": F.when(n > 0, F.kll_sketch_get_quantile_double("kll", F.lit(p))) for p in quantiles}
    kept = [c for c in sketches.columns if c not in ("hll", "kll", "low_key", "high_key")]
    return sketches.select(*kept, F.hll_sketch_estimate("hll").alias("n_distinct"), *(c.alias(name) for name, c in q.items()))


def fold_in(profile: DataFrame | None, more: list[DataFrame]) -> DataFrame:
    """A kept profile with the sketches of further parts put in."""
    tables = [*([profile] if profile is not None else []), *more]
    names = ["column", "n_rows", "n_nulls", "low", "high", "low_key", "high_key", "hll", "kll"]
    return merged(reduce(DataFrame.union, (t.select(names) for t in tables)))
