"""The frame behind each chart type of the catalogue. Types that differ in styling share a recipe."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chartops import interact, t_bin, t_density, t_loess, t_regression
from .ordered import framed, rank_rows, running
from .shaping import group_agg, pivot, with_overall


def _by(df: DataFrame, keys: list[str], value: str, kind: str = "sum") -> DataFrame:
    return group_agg(df, keys, {"value": (kind, value)})


def r_bar(df: DataFrame, cat: str, v: str, threshold: float | None = None, kind: str = "sum") -> DataFrame:
    """Bars with a flag: over the threshold, or the largest."""
    bars = _by(df, [cat], v, kind)
    if threshold is not None:
        return bars.withColumn("flag", F.col("value") > threshold)
    return with_overall(bars, {"__max": F.max("value")}).withColumn("flag", F.col("value") == F.col("__max")).drop("__max")


def r_sorted_bar(df: DataFrame, cat: str, v: str, kind: str = "sum") -> DataFrame:
    """Bars with their place by descending value; equal ones share it."""
    return rank_rows(_by(df, [cat], v, kind), ["value"], descending=True, rank=None, dense="order")


def r_grouped_bar(df: DataFrame, c1: str, c2: str, v: str, kind: str = "sum") -> DataFrame:
    return _by(df, [c1, c2], v, kind)


def r_stacked(df: DataFrame, x: str, series: str, v: str, kind: str = "sum") -> DataFrame:
    """Segments with their lower and upper ends, stacked in the order of the series."""
    w = Window.partitionBy(x).orderBy(series).rowsBetween(Window.unboundedPreceding, 0)
    y1 = F.sum("value").over(w)
    return _by(df, [x, series], v, kind).withColumns({"y1": y1, "y0": y1 - F.col("value")})


def r_normalized_stack(df: DataFrame, x: str, series: str, v: str, kind: str = "sum") -> DataFrame:
    total = F.sum("value").over(Window.partitionBy(x))
    return r_stacked(df, x, series, v, kind).withColumns({"share": F.col("value") / total, "y0": F.col("y0") / total, "y1": F.col("y1") / total})


def r_diverging_stack(df: DataFrame, x: str, level: str, v: str, neutral, negative: list, kind: str = "sum") -> DataFrame:
    """Stacks moved left by the negative levels and half of the neutral one, so that the neutral level is centred."""
    stacked = r_stacked(df, x, level, v, kind)
    left = F.when(F.col(level).isin(*negative), F.col("value")).when(F.col(level) == neutral, F.col("value") / 2).otherwise(0.0)
    shift = F.sum(left).over(Window.partitionBy(x))
    return stacked.withColumns({"y0": F.col("y0") - shift, "y1": F.col("y1") - shift})


def r_percent_of_total(df: DataFrame, cat: str, v: str, kind: str = "sum") -> DataFrame:
    return with_overall(_by(df, [cat], v, kind), {"__t": F.sum("value")}).withColumn("share", F.col("value") / F.col("__t")).drop("__t")


def r_mean_line(df: DataFrame, x: str, v: str, kind: str = "sum") -> DataFrame:
    return with_overall(_by(df, [x], v, kind), {"mean": F.avg("value")})


def r_rolling_mean_bar(df: DataFrame, t: str, v: str, n: int = 10, kind: str = "sum") -> DataFrame:
    """Mean of up to n periods; the first frames are partial. Periods are aggregated before they are ordered."""
    return framed(_by(df, [t], v, kind), [], [t], n - 1, 0, {"rolling": lambda w: F.avg("value").over(w.rowsBetween(1 - n, 0))})


def r_negative_flag(df: DataFrame, t: str, v: str, kind: str = "sum") -> DataFrame:
    """Periods with their change from the period before, and whether it is negative."""
    bars = framed(_by(df, [t], v, kind), [], [t], 1, 0, {"change": lambda w: F.col("value") - F.lag("value").over(w)})
    return bars.withColumn("negative", F.col("change") < 0)


def r_range_bar(df: DataFrame, cat: str, v: str) -> DataFrame:
    return group_agg(df, [cat], {"low": ("min", v), "high": ("max", v)})


def r_dual_axis(df: DataFrame, x: str, v1: str, v2: str, kinds: tuple[str, str] = ("sum", "avg")) -> DataFrame:
    return group_agg(df, [x], {"left": (kinds[0], v1), "right": (kinds[1], v2)})


def r_top_k(df: DataFrame, cat: str, v: str, k: int, kind: str = "sum") -> DataFrame:
    """Categories of rank k or better; ties share a rank and stay together."""
    bars = _by(df, [cat], v, kind)
    # the k largest values decide: a value's rank is its first place among them, and nulls come after all others
    best = bars.select("value").orderBy(F.col("value").desc_nulls_last()).limit(k).agg(F.reverse(F.array_sort(F.collect_list("value"))).alias("__best"))
    place = F.when(F.col("value").isNull(), F.size("__best") + 1).otherwise(F.array_position("__best", F.col("value")))
    return bars.crossJoin(F.broadcast(best)).withColumn("rank", place.cast("int")).where(F.col("rank").between(1, k)).drop("__best")


def r_residuals(df: DataFrame, v: str, keys: list[str]) -> DataFrame:
    """Each value less its group's mean; means are pre-aggregated and joined back."""
    mean = df.groupBy(*keys).agg(F.avg(v).alias("mean"))
    return df.join(mean, keys).withColumn("residual", F.col(v) - F.col("mean"))


def r_comet(df: DataFrame, cat: str, period: str, v: str, p0, p1, kind: str = "sum") -> DataFrame:
    both = pivot(df, [cat], period, v, [p0, p1], kind)
    start, end = (F.col(f"`{c}`") for c in both.columns[-2:])
    return both.select(cat, start.alias("start"), end.alias("end"), (end - start).alias("delta"))


def r_gantt(df: DataFrame, task: str, ts: str) -> DataFrame:
    return group_agg(df, [task], {"start": ("min", ts), "end": ("max", ts)})


def r_waterfall(df: DataFrame, order: str, v: str, kind: str = "sum") -> DataFrame:
    """Steps with the running total up to them and before them."""
    steps = running(_by(df, [order], v, kind), [], [order], {"previous": F.col("value")}, own=False)
    both = F.when(F.col("previous").isNotNull() | F.col("value").isNotNull(), F.coalesce("previous", F.lit(0)) + F.coalesce("value", F.lit(0)))
    return steps.withColumns({"total": both, "previous": F.coalesce("previous", F.lit(0.0))}).select(order, "value", "total", "previous")


def r_wilkinson(df: DataFrame, v: str, tie: str) -> DataFrame:
    """The dot's place in the stack of its value."""
    return df.select(tie, v, F.row_number().over(Window.partitionBy(v).orderBy(tie)).alias("place"))


def r_cumulative(df: DataFrame, t: str, v: str, keys: list[str]) -> DataFrame:
    """Running sums and counts of periods, within groups."""
    periods = group_agg(df, [*keys, t], {"value": ("sum", v), "n": ("count", v)})
    return running(periods, keys, [t], {"running_sum": F.col("value"), "running_count": F.col("n")})


def r_multi_line(df: DataFrame, ts: str, unit: str, series: str, v: str, kind: str = "avg") -> DataFrame:
    return _by(df.withColumn("period", F.date_trunc(unit, ts)), ["period", series], v, kind)


def r_last_label(df: DataFrame, ts: str, series: str, v: str, tie: str) -> DataFrame:
    """The last point of each series."""
    last = df.groupBy(series).agg(F.max(F.struct(ts, tie, v)).alias("last"))
    return last.select(series, F.col(f"last.{ts}").alias("ts"), F.col(f"last.{v}").alias("value"))


def r_layered_aggs(df: DataFrame, ts: str, unit: str, v: str) -> DataFrame:
    return group_agg(df.withColumn("period", F.date_trunc(unit, ts)), ["period"], {"mean": ("avg", v), "low": ("min", v), "high": ("max", v)})


def r_sequence(spark: SparkSession, start: int, stop: int, step: int, y: str = "sin(x)") -> DataFrame:
    """Generated x and a computed y."""
    return spark.range(start, stop, step).select(F.col("id").cast("double").alias("x")).withColumn("y", F.expr(y))


def r_bump(df: DataFrame, period: str, cat: str, v: str, kind: str = "sum") -> DataFrame:
    return _by(df, [period, cat], v, kind).withColumn("rank", F.rank().over(Window.partitionBy(period).orderBy(F.desc("value"))))


def r_area_facets(df: DataFrame, x: str, facet: str, v: str, band: float | None = None, kind: str = "sum") -> DataFrame:
    """Areas by facet; with a band the two layers of a horizon chart."""
    areas = _by(df, [facet, x], v, kind)
    if band is None:
        return areas
    return areas.withColumns({"layer1": F.least("value", F.lit(float(band))), "layer2": F.greatest(F.col("value") - band, F.lit(0.0))})


def r_histogram(df: DataFrame, v: str, maxbins: int = 10, keys: list[str] | None = None, step: float | None = None) -> DataFrame:
    keys = keys or []
    return t_bin(df.where(F.col(v).isNotNull()), v, maxbins, step).groupBy(*keys, "bin_start", "bin_end").agg(F.count(F.lit(1)).alias("n"))


def r_hist2d(df: DataFrame, x: str, y: str, maxbins: int = 10) -> DataFrame:
    both = t_bin(t_bin(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, maxbins, prefix="x"), y, maxbins, prefix="y")
    return both.groupBy("x_start", "y_start").agg(F.count(F.lit(1)).alias("n"))


def r_boxplot(df: DataFrame, cat: str, v: str, approx: bool = False) -> DataFrame:
    q = F.percentile_approx(v, [0.25, 0.5, 0.75]) if approx else F.percentile(v, [0.25, 0.5, 0.75])
    boxes = df.groupBy(cat).agg(F.min(v).alias("low"), q.alias("q"), F.max(v).alias("high"))
    return boxes.select(cat, "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high")


def r_ecdf(df: DataFrame, v: str, keys: list[str]) -> DataFrame:
    """P(X <= x) for each distinct x: counts by value, then running sums of these."""
    counts = df.where(F.col(v).isNotNull()).groupBy(*keys, v).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    running = F.sum("n").over(w.orderBy(v).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(*keys, F.col(v).alias("x"), (running / F.sum("n").over(w)).alias("p"))


def r_qq(df: DataFrame, a: str, b: str, steps: int = 20) -> DataFrame:
    """Pairs of quantiles of two columns at the same probabilities."""
    probs = [k / steps for k in range(steps + 1)]
    qa, qb = _quantiles(df, a, probs, "qa"), _quantiles(df, b, probs, "qb")
    return qa.join(qb, "k").select((F.col("k") / F.lit(steps)).alias("p"), "qa", "qb")


def _quantiles(df: DataFrame, v: str, probs: list[float], name: str) -> DataFrame:
    """k and the exact quantile at the k-th probability, between two neighbours by their distance; null without values.

    Different values are counted and summed up in range parts, so that no task sees them all; a probability meets the values
    that hold the two rows about it."""
    counts = df.where(F.col(v).isNotNull()).groupBy(F.col(v).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    summed = running(counts, [], ["__v"], {"__upto": F.col("__n")})
    wanted = df.agg(F.count(v).alias("__all")).select("__all", F.posexplode(F.array(*map(F.lit, probs))).alias("k", "__p")).withColumn("__at", (F.col("__all") - 1) * F.col("__p"))
    at = F.col("__at")
    reach = (F.col("__upto") > F.floor(at)) & (F.col("__upto") - F.col("__n") <= F.ceil(at))
    # one row for each probability
    met = summed.join(F.broadcast(wanted), reach).groupBy("k", "__at").agg(F.min("__v").alias("low"), F.max("__v").alias("high"))
    up = at - F.floor(at)
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - up) * F.col("low") + up * F.col("high"))
    return wanted.select("k").join(met.select("k", value.alias(name)), "k", "left")


def r_density(df: DataFrame, v: str, keys: list[str], bandwidth: float, steps: int = 20) -> DataFrame:
    return t_density(df, v, keys, bandwidth, steps)


def r_punch_card(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy((F.dayofweek(ts) - 1).alias("weekday"), F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def r_heatmap(df: DataFrame, k1: str, k2: str, v: str, kind: str = "avg") -> DataFrame:
    return _by(df, [k1, k2], v, kind)


def r_error_bars(df: DataFrame, cat: str, v: str, extent: str = "ci") -> DataFrame:
    """Mean and an interval: ci is 1.96 standard errors, stderr one, stdev one standard deviation."""
    s = df.groupBy(cat).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("s"), F.count(v).alias("n"))
    reach = {"ci": 1.96 * F.col("s") / F.sqrt("n"), "stderr": F.col("s") / F.sqrt("n"), "stdev": F.col("s")}[extent]
    return s.select(cat, "mean", (F.col("mean") - reach).alias("low"), (F.col("mean") + reach).alias("high"))


def r_trend_fit(df: DataFrame, x: str, y: str, keys: list[str], method: str = "linear") -> DataFrame:
    if method == "loess":
        return t_loess(df, x, y, keys)
    return t_regression(df, x, y, keys, 1 if method == "linear" else 2)


def r_scatter(df: DataFrame, x: str, y: str, size: str | None = None, color: str | None = None) -> DataFrame:
    chosen = [F.col(x).alias("x"), F.col(y).alias("y")]
    chosen += [F.col(c).alias(n) for c, n in ((size, "size"), (color, "color")) if c]
    return df.select(*chosen).where(F.col("x").isNotNull() & F.col("y").isNotNull())


def r_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """The correlation of each pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)))
    return one.select(F.explode(rows).alias("r")).select("r.a", "r.b", "r.corr")


def r_marginals(df: DataFrame, x: str, y: str, maxbins: int = 10) -> DataFrame:
    """The histograms along both sides of a scatter plot."""
    return r_histogram(df, x, maxbins).withColumn("side", F.lit("x")).unionByName(r_histogram(df, y, maxbins).withColumn("side", F.lit("y")))


def r_interactive(df: DataFrame, ranges: dict, recipe: Callable[[DataFrame], DataFrame], kind: str = "brush") -> DataFrame:
    """A recipe over the rows that an interaction selects."""
    return recipe(interact(df, kind, ranges))


