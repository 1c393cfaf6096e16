"""Collections and events as streams."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.versioned import VersionedTable


def read_stream(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def as_timestamp(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Event times with a zone, as watermarks need them."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_dedup(df: DataFrame, key: str, ts: str, within: str = "1 hour") -> DataFrame:
    """Each key once; repeats later than the watermark count anew, which bounds the state."""
    return df.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def stream_feature_counts(df: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """Running counts of each dimension's values."""
    rows = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("value")) for d, c in dimensions.items()))
    return df.select(F.explode(rows).alias("r")).select("r.dimension", "r.value").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def stream_windowed_counts(df: DataFrame, ts: str, keys: list[str], value: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling or sliding windows; what is later than the watermark is dropped."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = df.withWatermark(ts, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def stream_sessions(df: DataFrame, ts: str, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


#: Parts of a table that batches are merged into, and its versions that stay readable.
BUCKETS, KEPT_VERSIONS = 64, 3


def last_wins_sink(path: str, key: str, order: str, buckets: int = BUCKETS):
    """For foreachBatch: a batch is merged into those buckets of a versioned table that its keys fall into, a key's last row
    staying; the others are left alone. A batch that is run again changes nothing, and files of old versions are deleted."""

    def write(batch: DataFrame, number: int) -> None:
        table = VersionedTable(batch.sparkSession, path, key, buckets)
        if table.merge(batch, f"batch {number}", order):
            table.vacuum(KEPT_VERSIONS)

    return write


def read_upserted(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The table that last_wins_sink keeps, in its latest version."""
    return VersionedTable(spark, path, key, buckets).read(schema)


def stream_upsert(df: DataFrame, path: str, checkpoint: str, key: str, order: str):
    return df.writeStream.foreachBatch(last_wins_sink(path, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions_sink(path: str):
    """For foreachBatch: each batch is a version of a table; a batch that is run again writes the same version again."""

    def write(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/__version={version}")

    return write


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run over all that is there, then give the result table, which executors write below the checkpoint folder:
    in complete mode that of the last batch, else the rows of all batches."""
    spark, table = df.sparkSession, f"{checkpoint.rstrip('/')}/table"
    out = df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{checkpoint.rstrip('/')}/state").trigger(availableNow=True)
    out = out.format("parquet").option("path", table) if mode == "append" else out.foreachBatch(versions_sink(table))
    out.start().awaitTermination()
    try:
        rows = spark.read.schema(df.schema).parquet(table)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], df.schema)  # there was no batch
    if mode == "complete":
        last = max(int(re.search("/__version=([0-9]+)/[^/]*$", f)[1]) for f in rows.inputFiles())
        rows = spark.read.schema(df.schema).parquet(f"{table}/__version={last}")
    return rows.select(df.columns)
