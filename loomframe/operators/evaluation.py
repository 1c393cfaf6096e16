"""From judgments of features and logs of runs to scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIEWS = ("code", "chart", "merge")


def expand_judgments(samples: DataFrame, judgments: DataFrame, key: str = "sample_id", features: str = "key_features") -> DataFrame:
    """A row for each sample and feature with both views' judgments; a missing one is a failed evaluation."""
    rows = samples.select(key, F.posexplode(features).alias("feature_pos", "f")).select(key, "feature_pos", F.col("f.id").alias("feature_id"), F.col("f.type").alias("feature_type"), F.coalesce("f.must", F.lit(True)).alias("must"))
    for view in ("code", "chart"):
        own = judgments.where(F.col("view") == view).select(F.col(key), "feature_id", F.col("satisfied").alias(f"{view}_satisfied"), F.col("eval_success").alias(f"{view}_ok"))
        rows = rows.join(own, [key, "feature_id"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in (f"{view}_satisfied", f"{view}_ok")})
    return rows


def merge_satisfied(code: Column, chart: Column) -> Column:
    return code & chart


def _passes() -> dict[str, Column]:
    code = F.col("code_ok") & F.col("code_satisfied")
    chart = F.col("chart_ok") & F.col("chart_satisfied")
    return {"code": code, "chart": chart, "merge": merge_satisfied(code, chart)}


def score_samples(judged: DataFrame, key: str = "sample_id") -> DataFrame:
    """By sample: features, must features, how many pass in each view, whether all must features do, and what failed.

    A sample is valid if both views of every feature were judged. Without features nothing is strict; without must
    features all of them pass."""
    must = F.coalesce("must", F.lit(True))
    aggs = [F.count(F.lit(1)).alias("n_features"), F.count_if(must).alias("n_must"), F.bool_and(F.col("code_ok") & F.col("chart_ok")).alias("valid")]
    for view, p in _passes().items():
        aggs += [F.count_if(p).alias(f"{view}_pass"), F.count_if(p & must).alias(f"{view}_must_pass"), F.bool_and(p | ~must).alias(f"{view}_strict")]
    aggs.append(F.array_join(F.array_sort(F.collect_list(F.when(~(F.col("code_ok") & F.col("chart_ok")), F.col("feature_pos")))), ",").alias("failed"))
    return judged.groupBy(key).agg(*aggs)


def skip_rule(samples: DataFrame) -> DataFrame:
    """Pass counts of samples that can't be judged (not renderable, or an image missing) are zero; they stay evaluated."""
    able = F.coalesce(F.col("code_renderable"), F.lit(False)) & F.coalesce(F.col("has_prediction"), F.lit(False)) & F.coalesce(F.col("has_truth"), F.lit(False))
    counts = [c for c in samples.columns if c.endswith("_pass")]
    strict = [c for c in samples.columns if c.endswith("_strict")]
    return samples.withColumns({c: F.when(able, F.col(c)).otherwise(0) for c in counts} | {c: F.when(able, F.col(c)).otherwise(False) for c in strict})


def _rate(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def score_dataset(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Micro rates of valid samples for three views, of all and of must features, and strict rates of evaluated ones."""
    valid = F.col("valid")
    n, m = (F.coalesce(F.sum(F.when(valid, F.col(c))), F.lit(0)) for c in ("n_features", "n_must"))
    aggs = [F.count(F.lit(1)).alias("evaluated"), F.count_if(valid).alias("n_valid")]
    for view in VIEWS:
        aggs += [
            _rate(F.sum(F.when(valid, F.col(f"{view}_pass"))), n).alias(f"{view}_rate"),
            _rate(F.sum(F.when(valid, F.col(f"{view}_must_pass"))), m).alias(f"{view}_must_rate"),
            _rate(F.count_if(F.col(f"{view}_strict") & valid), F.count(F.lit(1))).alias(f"{view}_strict_rate"),
        ]
    return scores.groupBy(*(by or [])).agg(*aggs)


def score_breakdown(scores: DataFrame, columns: list[str]) -> DataFrame:
    """score_dataset by each of some columns and in total, in one grouping."""
    cells = F.array(F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")), *(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns))
    return score_dataset(scores.withColumn("__c", F.explode(cells)).select("*", "__c.dimension", "__c.value"), ["dimension", "value"])


def run_summary(runs: DataFrame) -> DataFrame:
    """Totals of a run: renderable share, and the mean of the scores that are neither null nor zero."""
    scored = F.when(F.col("best_score") != 0, F.col("best_score"))
    return runs.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("code_renderable").alias("renderable"), _rate(F.count_if("code_renderable"), F.count(F.lit(1))).alias("renderable_rate"), F.coalesce(F.avg(scored), F.lit(0.0)).alias("mean_score")
    )
