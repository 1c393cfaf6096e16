"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame with the columns of documents, but for the last.

Cases: what each operator does with nulls, empty texts, ties, repeated rows and empty tables holds here. Columns that
documents don't have pass through too; names that begin with two underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, near_dup, secrets, toxicity
from .common import shuffled
from .queries import BPE_RANKS, learnable_labels, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under the cut; the classifier learns from labels of documents in the input."""
    model = toxicity.fit(docs, learnable_labels(spark, sf_dir))
    scored = toxicity.score(docs, model, docs.columns, out="__toxicity")
    return scored.where(F.col("__toxicity") < toxicity.CUT).drop("__toxicity")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near copies link; documents without a word are all kept."""
    rows = near_dup.jaccard_join(docs).groupBy("id", "text_md5").agg(F.count("*").alias("rows"), F.count_if(F.col("uid") == F.col("group_uid")).alias("kept"))
    keys = rows.where("kept > 0").select(F.col("id").alias("__id"), F.col("text_md5").alias("__text_md5"), (F.col("rows") == F.col("kept")).alias("__all"))
    marked = docs.withColumn("__md5", F.md5(F.coalesce("text", F.lit(""))))
    joined = marked.join(shuffled(keys), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__md5") == F.col("__text_md5")))
    whole = joined.where("__all").select(docs.columns)
    # rows that repeat in id and text are copies of each other, and one of them stays; partial aggregation leaves one a task
    repeated = joined.where("not __all").groupBy("__id", "__md5").agg(F.first(F.struct(*docs.columns)).alias("__row"))
    return whole.union(repeated.select("__row.*"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    found = decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"), docs.columns, out="__leaks")
    return found.where(F.size("__leaks") == 0).drop("__leaks")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    found = secrets.scan(docs, docs.columns)
    clean = secrets.redacted(F.col("text"), F.col("spans"))
    return found.withColumn("text", clean).withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of what they decode to."""
    encoded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), BPE_RANKS)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("tokens", encode_tokens),
]
