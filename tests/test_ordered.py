"""Windows over an order, in range parts, against plain windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomframe.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    key = F.when(F.col("id") % 3 > 0, F.lit("a")).when(F.col("id") % 2 > 0, F.lit("b"))
    return spark.range(700).select("id", (F.col("id") * 7919 % 701).alias("o"), key.alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))


def _same(a, b, *names):
    assert sorted(map(tuple, a.select("id", *names).collect())) == sorted(map(tuple, b.select("id", *names).collect()))


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("parts", [3, 40])
def test_like_plain_windows(rows, keys, parts):
    w = Window.partitionBy(*keys or [F.lit(0)]).orderBy("o")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    _same(ordered.number_rows(rows, keys, ["o"], "n", parts), rows.withColumn("n", F.row_number().over(w)), "n")
    _same(ordered.running(rows, keys, ["o"], {"s": F.col("v")}, parts), rows.withColumn("s", F.sum("v").over(upto)), "s")
    over = {"m": lambda w: F.avg("v").over(w.rowsBetween(-40, 3)), "l": lambda w: F.lag("v", 2).over(w)}
    _same(ordered.framed(rows, keys, ["o"], 40, 3, over, parts), rows.withColumns({n: f(w) for n, f in over.items()}), "m", "l")


def test_edges(spark, rows):
    none = rows.where("id < 0")
    assert not ordered.number_rows(none, ["k"], ["o"]).count() + ordered.running(none, [], ["o"], {"s": F.col("v")}).count()
    assert ordered.framed(none, [], ["o"], 1, 1, {"l": lambda w: F.lag("v").over(w)}).isEmpty()
    nulls = spark.createDataFrame([(1, None, None), (2, 1, None), (3, 2, 5)], "id long, o long, v long")
    assert sorted(map(tuple, ordered.running(nulls, [], ["o"], {"s": F.col("v")}).select("id", "s").collect())) == [(1, None), (2, None), (3, 5)]
