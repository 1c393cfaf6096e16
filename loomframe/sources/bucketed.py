"""Collections that are kept in buckets by id, so that resuming work joins and groups them where they lie.

A bucketed table is dealt by a hash of its key when it is written. Grouping by the key, and joining with a table in as many
buckets by an equal key, then need no shuffle of it; what is new is the only side that moves. Keys have to be of one type on
both sides. Cases: null keys are in one bucket, and join nothing; an empty table has empty buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .scratch import state_path

#: Buckets of a table. Tables that are joined need as many as each other.
BUCKETS = 32


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """The frame as a table of the catalogue, in buckets by a key and sorted by it within. The rows of a bucket are dealt to
    one task before they are written, so that it is one file however many tasks made them."""
    spark = df.sparkSession
    path = path or state_path(spark, name)
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def add_to_bucketed(df: DataFrame, name: str, key: str, buckets: int = BUCKETS) -> None:
    """Further rows for such a table, a file a bucket."""
    df.repartition(buckets, key).write.mode("append").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def drop_bucketed(spark: SparkSession, name: str) -> None:
    """Takes a table out of the catalogue; its files stay where they were written."""
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
