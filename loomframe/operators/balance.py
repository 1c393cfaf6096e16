"""How evenly a collection is spread, and what it should collect next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed

#: The dimensions that the overall score averages.
OVERALL = ["encoding_patterns", "aggregations", "time_units", "transforms", "compositions", "interactions", "domains"]


def infer_domain(db_id: Column) -> Column:
    """The first domain one of whose keywords the id contains."""
    c = F.lower(db_id)
    return F.coalesce(*(F.when(c.rlike("|".join(words)), F.lit(d)) for d, words in fixed.DOMAIN_KEYWORDS.items()), F.lit("other"))


def infer_chart_category(chart_type: Column) -> Column:
    c = F.lower(chart_type)
    rules = [F.when(c.rlike("|".join(words)), F.lit(name)) for words, name in fixed.CATEGORY_SUBSTRINGS]
    return F.when(F.coalesce(chart_type, F.lit("")) == "", "").otherwise(F.coalesce(*rules, F.lit("Other")))


def feature_counts(samples: DataFrame, dimensions: dict[str, str], key: str = "sample_id") -> DataFrame:
    """dimension, value and n; a sample counts once. {dimension: column of a value or an array of values}."""
    kinds = dict(samples.dtypes)
    once = samples.dropDuplicates([key])

    def named(dimension: str, column: str) -> Column:
        cells = F.col(column) if kinds[column].startswith("array") else F.array(column)
        return F.transform(cells, lambda v: F.struct(F.lit(dimension).alias("dimension"), v.cast("string").alias("value")))

    values = [named(d, c) for d, c in dimensions.items()]
    rows = once.select(F.explode(F.concat(*values)).alias("r")).select("r.dimension", "r.value").where("value is not null and value <> ''")
    return rows.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def diversity_score(counts: DataFrame) -> DataFrame:
    """Entropy of each dimension over the logarithm of its number of keys, keys without a count included."""
    w = Window.partitionBy("dimension")
    p = F.col("n") / F.nullif(F.sum("n").over(w), F.lit(0))
    term = F.when(F.col("n") > 0, -p * F.log2(p)).otherwise(0.0)
    by = counts.withColumn("term", term).groupBy("dimension").agg(F.sum("term").alias("h"), F.count(F.lit(1)).alias("keys"))
    score = F.when(F.col("keys") > 1, F.col("h") / F.log2("keys")).otherwise(F.col("h"))
    return by.select("dimension", (F.coalesce(score, F.lit(0.0)) + F.lit(0.0)).alias("score"))


def overall_diversity(scores: DataFrame) -> DataFrame:
    """The mean of the tracked dimensions; one without a score has 0."""
    spark = scores.sparkSession
    wanted = spark.createDataFrame([(d,) for d in OVERALL], "dimension string")
    return wanted.join(scores, "dimension", "left").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("overall"))


def universe_table(spark: SparkSession, universe: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(d, v, i) for d, vs in universe.items() for i, v in enumerate(vs)], "dimension string, value string, pos int")


def underrepresented(counts: DataFrame, threshold: float = 0.5, universe: DataFrame | None = None) -> DataFrame:
    """Values with a count below threshold * total / N, N the size of the universe, or of what was seen."""
    if universe is None:
        w = Window.partitionBy("dimension")
        table = counts.withColumns({"total": F.sum("n").over(w), "size": F.count(F.lit(1)).over(w)})
    else:
        totals = counts.groupBy("dimension").agg(F.sum("n").alias("total"))
        table = universe.join(counts, ["dimension", "value"], "left").join(totals, "dimension", "left")
        table = table.withColumns({"n": F.coalesce("n", F.lit(0)), "total": F.coalesce("total", F.lit(0)), "size": F.count(F.lit(1)).over(Window.partitionBy("dimension"))})
    # with nothing counted yet, everything is wanting
    few = F.col("n") < threshold * F.col("total") / F.col("size")
    return table.where(few | (F.col("total") == 0)).select("dimension", "value", "n")


def overrepresented(counts: DataFrame, threshold: float = 1.5, always_below: int = 0) -> DataFrame:
    """Values with a count over threshold * total / observed; with a total under always_below, every value that was used."""
    w = Window.partitionBy("dimension")
    table = counts.withColumns({"total": F.sum("n").over(w), "size": F.count(F.lit(1)).over(w)})
    many = F.when(F.col("total") < always_below, F.col("n") > 0).otherwise(F.col("n") > threshold * F.col("total") / F.col("size"))
    return table.where(many & (F.col("total") > 0)).select("dimension", "value", "n")


def coverage_gaps(universe: DataFrame, counts: DataFrame) -> DataFrame:
    return universe.join(counts.where("n > 0"), ["dimension", "value"], "left_anti").select("dimension", "value")


def constraint_strength(total: Column) -> Column:
    return F.when(total < 10, 0.3).when(total < 50, 0.5).otherwise(0.7)


def _first(df: DataFrame, n: int, order: list) -> DataFrame:
    w = Window.partitionBy("dimension").orderBy(*order)
    return df.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)


def _listed(df: DataFrame, limits: dict[str, int | None], name: str) -> DataFrame:
    """The first values of each dimension by pos and value, joined by commas; None: all of them."""
    limit = F.create_map(*(F.lit(x) for d, n in limits.items() for x in (d, n if n is not None else 1 << 30)))
    k = F.row_number().over(Window.partitionBy("dimension").orderBy("pos", "value"))
    some = df.where(F.col("dimension").isin(*limits)).withColumn("k", k).where(F.col("k") <= F.element_at(limit, F.col("dimension")))
    return some.groupBy("dimension").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]), ",").alias(name))


def constraints(counts: DataFrame, universe: DataFrame, prefer: dict[str, int | None], avoid: dict[str, int | None], under: float = 0.5, over: float = 2.0, seen: dict[str, float] | None = None, early: tuple[str, ...] = (), literal: bool = False) -> DataFrame:
    """dimension, prefer and avoid of the dimensions that the limits name.

    prefer: values of the universe that are used too little, in its order, up to the limit; for dimensions in seen, values
    that occur at all and stay under that threshold, rarest first. avoid: values used too much, most used first, up to the
    limit; of dimensions in early, every used one while fewer than ten were counted. Names match in any case unless literal."""
    seen = seen or {}
    fold = (lambda df: df) if literal else (lambda df: df.withColumn("value", F.lower("value")))
    given = universe.where(~F.col("dimension").isin(*seen)) if seen else universe
    folded = fold(counts).groupBy("dimension", "value").agg(F.sum("n").alias("n"))
    few = underrepresented(folded, under, fold(given)).select(F.col("dimension").alias("__d"), F.col("value").alias("__v"))
    same = F.col("value") == F.col("__v") if literal else F.lower("value") == F.col("__v")
    wanted = given.join(few, (F.col("dimension") == F.col("__d")) & same).select("dimension", "value", F.col("pos").cast("long").alias("pos"))
    for d, threshold in seen.items():
        wanted = wanted.union(underrepresented(counts.where(F.col("dimension") == d), threshold).select("dimension", "value", F.col("n").alias("pos")))
    late, soon = [d for d in avoid if d not in early], [d for d in avoid if d in early]
    much = overrepresented(counts.where(F.col("dimension").isin(*late)), over).union(overrepresented(counts.where(F.col("dimension").isin(*soon)), over, always_below=10))
    much = much.select("dimension", "value", (-F.col("n")).alias("pos"))
    every = universe.sparkSession.createDataFrame([(d,) for d in dict.fromkeys([*prefer, *avoid])], "dimension string")
    both = every.join(_listed(wanted, prefer, "prefer"), "dimension", "left").join(_listed(much, avoid, "avoid"), "dimension", "left")
    return both.select("dimension", F.coalesce("prefer", F.lit("")).alias("prefer"), F.coalesce("avoid", F.lit("")).alias("avoid"))


def with_strength(df: DataFrame, total: DataFrame | None) -> DataFrame:
    """With how strongly constraints hold, from one row with the number of samples so far (total)."""
    if total is None:
        return df.withColumn("strength", constraint_strength(F.lit(0)))
    return df.crossJoin(F.broadcast(total.select(constraint_strength(F.col("total")).alias("strength"))))


def ambiguity_constraints(counts: DataFrame, spark: SparkSession, literal: bool = False, total: DataFrame | None = None) -> DataFrame:
    """Two ambiguity types and four templates to prefer, two of each to avoid, and the strength."""
    universe = universe_table(spark, {"ambiguity_types": fixed.AMBIGUITY_TYPES, "ambiguity_templates": [t[0] for t in fixed.AMBIGUITY_TEMPLATES]})
    kinds = ("ambiguity_types", "ambiguity_templates")
    return with_strength(constraints(counts, universe, {"ambiguity_types": 2, "ambiguity_templates": 4}, dict.fromkeys(kinds, 2), early=kinds, literal=literal), total)


def diversity_constraints(counts: DataFrame, spark: SparkSession, chart_category: str | None = None, catalog: DataFrame | None = None, total: DataFrame | None = None) -> DataFrame:
    """What the next sample should prefer and avoid, by dimension, and how strongly.

    Three aggregations, time units and transforms, one composition, one encoding pattern (under 0.3 of its share), five
    chart categories, and ten chart types of a catalogue (chart_type) are preferred; one interaction other than none, for
    interactive charts only. Aggregations, time units, encoding patterns and chart types are avoided when used too much."""
    universe = universe_table(spark, {"aggregations": fixed.AGGREGATION_TYPES, "time_units": fixed.TIME_UNITS, "transforms": fixed.TRANSFORM_TYPES, "compositions": fixed.COMPOSITION_TYPES, "interactions": [*fixed.INTERACTION_TYPES]})
    prefer: dict[str, int | None] = {"aggregations": 3, "time_units": 3, "transforms": 3, "compositions": 1, "interactions": 1, "encoding_patterns": 1, "chart_categories": 5}
    avoid: dict[str, int | None] = dict.fromkeys(("aggregations", "time_units", "encoding_patterns"))
    if catalog is not None:
        order = F.row_number().over(Window.partitionBy("dimension").orderBy("value")) - 1
        charts = catalog.select(F.lit("chart_types").alias("dimension"), F.col("chart_type").alias("value")).distinct()
        universe = universe.unionByName(charts.withColumn("pos", order))
        prefer["chart_types"], avoid["chart_types"] = 10, None
    out = constraints(counts, universe, prefer, avoid, seen={"encoding_patterns": 0.3, "chart_categories": 0.5}, early=("chart_types",))
    # none takes part in the shares of interactions, and is never what is asked for
    named = [i for i in fixed.INTERACTION_TYPES if i.lower() != "none"]
    some = constraints(counts.where("dimension = 'interactions'"), universe.where("dimension = 'interactions'"), {"interactions": None}, {}).select(F.col("prefer").alias("__i"))
    first = F.coalesce(F.get(F.filter(F.split("__i", ","), lambda i: i.isin(*named)), F.lit(0)), F.lit(""))
    best = first if chart_category == "Interactive Charts" else F.lit("")
    out = out.crossJoin(F.broadcast(some)).withColumn("prefer", F.when(F.col("dimension") == "interactions", best).otherwise(F.col("prefer"))).drop("__i")
    return with_strength(out, total)


def diversity_report(counts: DataFrame, universe: DataFrame | None = None, under: float = 0.5, over: float = 2.0, n: int = 10) -> DataFrame:
    """Each dimension's total, keys, score, its n most frequent values (of the universe, where one is given, values that
    were never used count zero), and the lists of what is used too little and too much."""
    if universe is not None:
        zeros = coverage_gaps(universe, counts).join(counts.select("dimension", "value"), ["dimension", "value"], "left_anti").select("dimension", "value", F.lit(0).cast("long").alias("n"))
        counts = counts.union(zeros)
    totals = counts.groupBy("dimension").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("keys"))
    top = _first(counts, n, [F.desc("n"), "value"]).groupBy("dimension").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value", "n"))), lambda x: F.concat(x["value"], F.lit("="), x["n"].cast("string"))), ",").alias("top")
    )
    names = lambda df, name: df.groupBy("dimension").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias(name))
    few, many = names(underrepresented(counts, under, universe), "under"), names(overrepresented(counts, over), "over")
    lists = totals.join(diversity_score(counts), "dimension").join(top, "dimension").join(few, "dimension", "left").join(many, "dimension", "left")
    return lists.select("dimension", "total", "keys", "score", "top", F.coalesce("under", F.lit("")).alias("under"), F.coalesce("over", F.lit("")).alias("over"))


def underrepresented_charts(counts: DataFrame, catalog: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Chart types of a catalogue (chart_type) that are used less than their share of it."""
    universe = catalog.select(F.lit("chart_types").alias("dimension"), F.col("chart_type").alias("value")).distinct()
    return underrepresented(counts.where("dimension = 'chart_types'"), threshold, universe).select(F.col("value").alias("chart_type"), "n")


def overrepresented_charts(counts: DataFrame, threshold: float = 1.5, always_below: int = 0) -> DataFrame:
    """Chart types that are used more than their share of those that were used."""
    return overrepresented(counts.where("dimension = 'chart_types'"), threshold, always_below).select(F.col("value").alias("chart_type"), "n")


def rebuild_counts(samples: DataFrame, dimensions: dict[str, str], key: str = "sample_id") -> DataFrame:
    """Counts from validated samples alone."""
    return feature_counts(samples.where(F.coalesce("validation_passed", F.lit(True))), dimensions, key)


def with_ledger(counts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Counts with reservations applied: ledger rows of dimension, value and +1 or -1; never below zero."""
    entries = counts.select("dimension", "value", "n").union(ledger.select("dimension", "value", F.col("delta").cast("long")))
    return entries.groupBy("dimension", "value").agg(F.greatest(F.sum("n"), F.lit(0)).alias("n"))


def reserve(recommended: DataFrame, reservation_id: str) -> DataFrame:
    return recommended.select(F.lit(reservation_id).alias("reservation_id"), "dimension", "value", F.lit(1).alias("delta"))


def restore_counts(counts: DataFrame, saved: DataFrame) -> DataFrame:
    """Counts that continue a saved state: values that are counted now as well are added up."""
    both = saved.select("dimension", "value", F.col("n").cast("long").alias("n")).union(counts.select("dimension", "value", "n"))
    return both.groupBy("dimension", "value").agg(F.sum("n").alias("n"))


def commit(ledger: DataFrame, reservation_id: str, used: DataFrame | None = None) -> DataFrame:
    """The ledger after a reservation was used: what it used (all of it, unless said otherwise) stays for good, under no
    reservation, so that a later rollback of it has nothing to undo; what it did not use goes."""
    own = F.col("reservation_id") == reservation_id
    kept = ledger.where(own & (F.col("delta") > 0))
    if used is not None:
        kept = kept.join(used.select("dimension", "value").distinct(), ["dimension", "value"], "left_semi")
    rest = ledger.where(F.col("reservation_id").isNull() | ~own)
    return rest.unionByName(kept.withColumn("reservation_id", F.lit(None).cast("string")).select(ledger.columns))


def rollback(ledger: DataFrame, reservation_id: str, used: DataFrame | None = None) -> DataFrame:
    """Rows that undo a reservation, or the part of it that was not used."""
    own = ledger.where((F.col("reservation_id") == reservation_id) & (F.col("delta") > 0))
    if used is not None:
        own = own.join(used, ["dimension", "value"], "left_anti")
    return own.select("reservation_id", "dimension", "value", F.lit(-1).alias("delta"))


def collection_stats(samples: DataFrame, columns: list[str]) -> DataFrame:
    """Counts and percentages by value of each column."""
    cells = F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns))
    counts = samples.select(F.explode(cells).alias("c")).groupBy("c.dimension", "c.value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("dimension")), 1))


def length_stats(samples: DataFrame, text: str) -> DataFrame:
    n = F.length(text)
    return samples.agg(F.min(n).alias("low"), F.max(n).alias("high"), F.avg(n).alias("mean"), F.median(n).alias("median"))
