"""Sketches and footers against exact values."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loomframe.operators import profiling, shaping, sketches


def test_merged_profile_equals_the_whole(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice("abc") if k % 7 else None, rng.gauss(0, 1) if k % 5 else None, datetime.date(2020, 1, 1) + datetime.timedelta(k % 900)) for k in range(6000)]
    df = spark.createDataFrame([*rows, (None, None, float("nan"), None)], "k long, s string, v double, d date")
    columns = ["k", "s", "v", "d"]
    parts = sketches.part_sketches(df.withColumn("p", F.coalesce(F.col("k"), F.lit(0)) % 6), columns, ["p"])
    folded = sketches.fold_in(sketches.merged(parts.where("p < 2")), [parts.where("p = 2").drop("p"), sketches.merged(parts.where("p > 2"))])
    got = {r["column"]: r for r in sketches.profile_of(folded).collect()}
    whole = {r["column"]: r for r in sketches.profile_of(sketches.merged(sketches.part_sketches(df, columns, []))).collect()}
    exact = {"k": 6000, "s": 3, "v": len({r[2] for r in rows if r[2] is not None}) + 1, "d": 900}
    for c in columns:
        for name in ("n_rows", "n_nulls", "low", "high"):
            assert got[c][name] == whole[c][name], (c, name)
        assert abs(got[c].n_distinct - exact[c]) <= 0.03 * exact[c] and abs(whole[c].n_distinct - exact[c]) <= 0.03 * exact[c]
    values = sorted(r[2] for r in rows if r[2] is not None)
    for name, share in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        assert abs(sum(v <= got["v"][name] for v in values) / len(values) - share) < 0.02
    assert got["s"].q50 is None and got["k"].low == "0" and got["k"].high == "5999" and got["d"].high == "2022-06-18"
    assert sketches.merged(sketches.part_sketches(df.where("false").withColumn("p", F.lit(1)), columns, ["p"])).isEmpty()


def test_columns_without_values(spark):
    df = spark.createDataFrame([(None, None)], "a long, b string")
    got = {r["column"]: r for r in sketches.profile_of(sketches.merged(sketches.part_sketches(df, ["a", "b"], []))).collect()}
    assert [(r.n_rows, r.n_nulls, r.low, r.n_distinct, r.q50) for r in got.values()] == [(1, 1, None, 0, None)] * 2


def test_approximate_aggregates(spark):
    df = spark.range(9001).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    got = {r.g: (r.n, r.m) for r in shaping.group_agg(df, ["g"], {"n": ("distinct", "v"), "m": ("median", "v")}, approx=True).collect()}
    assert all(abs(n - 3000) < 90 and abs(m - 4500) < 200 for n, m in got.values()) and len(got) == 3


def test_footers_hold_the_ends(spark, tmp_path):
    rows = [(k, float(k) / 2 if k % 3 else None, k % 2 == 0, datetime.date(2020, 1, 1 + k % 28), str(k)) for k in range(100)]
    path = f"{tmp_path}/t"
    spark.createDataFrame(rows, "k long, v double, b boolean, d date, s string").repartition(3).write.parquet(path)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    got = {r["column"]: (r.n_rows, r.n_nulls, r.low, r.high) for r in profiling.footer_stats(spark, path).collect()}
    assert got == {"k": (100, 0, "0", "99"), "v": (100, 34, "0.5", "49.0"), "b": (100, 0, "false", "true"), "d": (100, 0, "2020-01-01", "2020-01-28")}
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    with pytest.raises(ValueError, match="no exact ends"):
        profiling.footer_stats(spark, path, ["s"])
