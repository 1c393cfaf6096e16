"""Keeping a collection of samples: resuming, appending, merging, reviewing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .balance import infer_chart_category


def existing_samples(samples: DataFrame) -> DataFrame:
    """Validated samples by question; rows that lack either id are left out."""
    good = samples.where(F.coalesce("validation_passed", F.lit(True)) & F.col("sample_id").isNotNull() & F.col("source_question_id").isNotNull())
    return good.groupBy("source_question_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("sample_id")).alias("sample_ids"))


def remaining_work(questions: DataFrame, existing: DataFrame, target: int) -> DataFrame:
    """How many samples each question still needs; questions that need none are left out."""
    have = existing.select(F.col("source_question_id").alias("__q"), F.col("n").alias("__n"))
    joined = questions.join(have, F.col("question_id") == F.col("__q"), "left")
    return joined.withColumn("remaining", F.greatest(target - F.coalesce("__n", F.lit(0)), F.lit(0))).where("remaining > 0").drop("__q", "__n")


def append_samples(samples: DataFrame, path: str) -> None:
    samples.where(F.coalesce("validation_passed", F.lit(True))).write.mode("append").parquet(path)


def question_outcomes(results: DataFrame) -> DataFrame:
    """By question: samples, attempts, successes and errors."""
    return results.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if("success").alias("succeeded"), F.array_sort(F.collect_list(F.when(~F.col("success"), F.col("error")))).alias("errors")
    )


def pipeline_summary(outcomes: DataFrame) -> DataFrame:
    a, s = F.coalesce(F.sum("attempted"), F.lit(0)), F.coalesce(F.sum("succeeded"), F.lit(0))
    rate = F.when(a > 0, F.format_string("%.1f%%", s * 100.0 / a)).otherwise("0.0%")
    return outcomes.agg(F.count(F.lit(1)).alias("instances"), a.alias("attempted"), s.alias("succeeded"), rate.alias("success_rate"))


def pipeline_distribution(samples: DataFrame, columns: list[str], databases: DataFrame | None = None) -> DataFrame:
    """Counts by value of each column; databases without a sample count zero."""
    cells = F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns))
    counts = samples.select(F.explode(cells).alias("c")).groupBy("c.dimension", "c.value").agg(F.count(F.lit(1)).alias("n"))
    if databases is None:
        return counts
    zeros = databases.select(F.lit("db_id").alias("dimension"), F.col("db_id").cast("string").alias("value"), F.lit(0).cast("long").alias("n")).distinct()
    return counts.union(zeros).groupBy("dimension", "value").agg(F.sum("n").alias("n"))


#: The columns of the final data set, and the samples' columns that they come from.
FINAL_COLUMNS = {"sample_id": "sample_id", "db_id": "db_id", "chart_type": "chart_type", "chart_category": "chart_category", "initial_question": "vis_question", "ground_truth_code": "altair_code", "key_features": "key_features"}


def _chart_of(samples: DataFrame) -> tuple[Column, Column]:
    """Chart type and category, from the first mark feature and the features' types where a sample doesn't say."""
    own = lambda c: F.col(c) if c in samples.columns else F.lit(None).cast("string")
    if "key_features" not in samples.columns:
        return own("chart_type"), own("chart_category")
    marks = F.filter("key_features", lambda f: f["type"] == "mark")
    kind = F.coalesce(own("chart_type"), F.get(F.transform(marks, lambda f: F.coalesce(f["value"], f["text"])), F.lit(0)))
    inferred = F.when(F.exists("key_features", lambda f: f["type"] == "interaction"), "Interactive Charts").otherwise(infer_chart_category(kind))
    return kind, F.coalesce(own("chart_category"), F.nullif(inferred, F.lit("")))


def finalize_reviewed(samples: DataFrame, review: DataFrame) -> DataFrame:
    """Samples that passed review, numbered anew within their question by their old numbers, with the columns of the final data
    set as far as the samples have them (and others dropped), in the order of questions and numbers.

    Samples without a type or category get them from their key features (array of type, value and text)."""
    good = samples.join(review.where("status = 'pass'").select("sample_id").distinct(), "sample_id", "left_semi")
    old = F.regexp_extract("sample_id", "_c([0-9]+)$", 1).try_cast("long")
    k = F.row_number().over(Window.partitionBy("source_question_id").orderBy(old, "sample_id")) - 1
    kind, category = _chart_of(good)
    numbered = good.withColumns({"__k": k, "chart_type": kind, "chart_category": category})
    new = F.concat(F.lit("q"), F.col("source_question_id").cast("string"), F.lit("_c"), F.col("__k").cast("string"))
    ordered = numbered.withColumn("sample_id", new).orderBy(F.col("source_question_id").cast("long"), "__k")
    return ordered.select(*(F.col(c).alias(name) for name, c in FINAL_COLUMNS.items() if c in numbered.columns))


def review_stats(samples: DataFrame, review: DataFrame, columns: tuple[str, ...] = ("db_id", "chart_type", "chart_category")) -> DataFrame:
    """dimension, value and how many samples passed, failed and are pending, by value of each column, and over all."""
    status = samples.join(review.select("sample_id", "status"), "sample_id", "left")
    own = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns))
    rows = status.select("status", F.inline(own))
    return rows.groupBy("dimension", "value").agg(F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "fail").alias("failed"), F.count_if(F.col("status").isNull()).alias("pending"))


def candidates_histogram(samples: DataFrame) -> DataFrame:
    """How many questions have how many samples."""
    return samples.groupBy("source_question_id").agg(F.count(F.lit(1)).alias("n_samples")).groupBy("n_samples").agg(F.count(F.lit(1)).alias("n_questions"))


def pending_rows(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done, key, "left_anti")


def fill_from_dataset(runs: DataFrame, dataset: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns that the runs lack altogether, from the data set."""
    lacking = [c for c in columns if c not in runs.columns]
    return runs.join(dataset.select(key, *lacking), key, "left") if lacking else runs


def restore_completed(old: DataFrame, redo: DataFrame | None = None, force: bool = False, key: str = "sample_id") -> DataFrame:
    """Earlier results to keep: those that succeeded and aren't to be redone; force keeps none."""
    kept = old.where("eval_success") if not force else old.limit(0)
    return kept if redo is None else kept.join(redo, key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of both; of a key in both the new one stays."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def pending_runs(samples: DataFrame, cached: DataFrame, forced: DataFrame | None = None, key: str = "sample_id") -> DataFrame:
    skip = cached if forced is None else cached.join(forced, key, "left_anti")
    return samples.join(skip.select(key), key, "left_anti")


def build_statistics(outcomes: DataFrame, samples: DataFrame, columns: list[str], report: DataFrame) -> DataFrame:
    """The bundle that a run writes: section, key and value rows of the summary, the distribution and the balance report."""
    pair = lambda df, section, key, value: df.select(F.lit(section).alias("section"), key.alias("key"), value.cast("string").alias("value"))
    summary = pipeline_summary(outcomes)
    cells = F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in summary.columns))
    first = pair(summary.select(F.explode(cells).alias("c")), "summary", F.col("c.k"), F.col("c.v"))
    spread = pair(pipeline_distribution(samples, columns), "distribution", F.concat_ws("=", "dimension", "value"), F.col("n"))
    return first.union(spread).union(pair(report, "diversity", F.col("dimension"), F.round("score", 10)))
