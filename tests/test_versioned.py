"""Tables in versions: snapshots, repeated batches, merging, putting files together, deleting what no version needs."""

import pytest
from pyspark.sql import functions as F

from loomframe.sources.versioned import LOG_KEEP, MANY, VersionedTable

SCHEMA = "k long, v long"


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"{tmp_path}/t", "k", buckets=4)


def _rows(spark, *pairs):
    return spark.createDataFrame(pairs, SCHEMA).coalesce(1)


def _read(table, spark, version=None):
    return sorted(map(tuple, table.read(_rows(spark, (0, 0)).schema, version).collect()), key=str)


def test_merge_keeps_the_last_row_of_a_key(spark, table):
    assert _read(table, spark) == []
    assert table.merge(_rows(spark, (1, 1), (2, 5), (1, 3), (None, 1)), "a", "v")
    assert table.merge(_rows(spark, (2, 4), (3, 1), (None, 2)), "b", "v")
    assert _read(table, spark) == sorted([(1, 3), (2, 5), (3, 1), (None, 2)], key=str)
    assert _read(table, spark, 0) == sorted([(1, 3), (2, 5), (None, 1)], key=str)
    assert not table.merge(_rows(spark, (9, 9)), "b", "v") and table.versions() == [0, 1]
    assert table.merge(_rows(spark, (0, 0)).where("false"), "none", "v") and len(_read(table, spark)) == 4
    with pytest.raises(ValueError, match="no version 7"):
        table.read(_rows(spark, (0, 0)).schema, 7)


def test_many_batches_leave_few_files(spark, table):
    n = LOG_KEEP + 12
    for k in range(n):
        assert table.append(_rows(spark, (k, k), (k % 3, k)), f"batch {k}")
    assert not table.append(_rows(spark, (5, 5)), "batch 5")
    live = table.snapshot()
    assert len(live.files) <= 4 * MANY and sorted(r[1] for r in _read(table, spark)) == sorted([*range(n), *range(n)])
    early = _read(table, spark, 3)
    assert table.vacuum(keep=10**6) == 0 and _read(table, spark, 3) == early
    before = _read(table, spark)
    table.compact(_rows(spark, (0, 0)).schema)
    assert table.vacuum() > 0 and _read(table, spark) == before and len(table.snapshot().files) <= 4
    assert sum(f.endswith(".parquet") for d in table._names("data") for p in table._names(f"data/{d}") for f in (table._names(f"data/{d}/{p}") if "=" in p else [])) <= 4
    assert len(table.versions()) <= LOG_KEEP + 1 and not table.append(_rows(spark, (5, 5)), "batch 5")


def test_one_of_two_writers_wins(spark, table):
    now = table.snapshot()
    table._commit(now, "first", {}, [])
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        table._commit(now, "second", {}, [])
    assert table.merge(_rows(spark, (1, 1)), "third", "v") and table.snapshot().batches == {"first", "third"}


def test_a_hot_key(spark, table):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).alias("k"), F.col("id").alias("v"))
    table.merge(rows, "all", "v")
    assert table.read(rows.schema).count() == rows.select("k").distinct().count()
    assert table.read(rows.schema).where("k = 0").first().v == 19_999
