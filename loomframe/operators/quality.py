"""Data quality and validation of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from .profiling import NUMERIC, null_share


def issues(*tests: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(text)) for test, text in tests)))


def chart_requirements(df: DataFrame, chart_type: str) -> DataFrame:
    """One row with the issues that a frame has for a chart type: pie and donut need a text column of two to eight
    values and no negative number, a histogram one number column, a scatter plot two."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    kind, tests = chart_type.lower(), []
    if "pie" in kind or "donut" in kind:
        if texts:
            n = F.count_distinct(texts[0])
            tests += [(n < 2, "pie chart has too few categories"), (n > 8, "pie chart has too many categories")]
        tests += [(F.min(c) < 0, f"pie chart has negative values in {c}") for c in numbers]
    if "histogram" in kind and not numbers:
        tests.append((F.lit(True), "histogram needs a numeric column"))
    if "scatter" in kind and len(numbers) < 2:
        tests.append((F.lit(True), "scatter plot needs two numeric columns"))
    # a test over aggregates needs one even where there is none
    return df.agg(F.count(F.lit(1)).alias("n_rows"), issues(*tests).alias("issues") if tests else F.array().cast("array<string>").alias("issues"))


def validate_data(df: DataFrame, chart_type: str) -> DataFrame:
    """n_rows, null_share, issues, notes and passed: empty, under five rows, over half null, or a chart rule broken fails;
    over a thousand rows is only noted."""
    one = chart_requirements(df, chart_type).crossJoin(null_share(df))
    n = F.col("n_rows")
    own = issues((n == 0, "Data is empty"), ((n > 0) & (n < 5), "Too few rows"), (F.col("null_share") > 0.5, "Too many null values"))
    notes = issues((n > 1000, "Too many rows"))
    return one.select("n_rows", "null_share", F.concat(own, "issues").alias("issues"), notes.alias("notes")).withColumn("passed", F.size("issues") == 0)


def validate_specs(checked: DataFrame, violations: DataFrame, interactive_ok: DataFrame, key: str) -> DataFrame:
    """satisfied, total and passed: four fifths of the features, no contract violation, and a valid interaction."""
    counts = checked.groupBy(key).agg(F.count_if("satisfied").alias("satisfied"), F.count(F.lit(1)).alias("total"))
    broken = violations.groupBy(key).agg(F.count(F.lit(1)).alias("violations"))
    joined = counts.join(broken, key, "left").join(interactive_ok, key, "left").withColumn("violations", F.coalesce("violations", F.lit(0)))
    enough = F.when(F.col("total") > 0, F.col("satisfied") / F.col("total") >= 0.8).otherwise(True)
    return joined.withColumn("passed", enough & (F.col("violations") == 0) & F.coalesce("interaction_ok", F.lit(True)))


def failure_codes(reports: DataFrame) -> DataFrame:
    """Codes by phase; the chart's phases are skipped once the data failed, and reading the drawn chart once its
    specification failed. Ambiguity is looked at in any case. Takes boolean columns exec_ok, anchor_ok, spec_ok, features_ok,
    contract_ok, interaction_ok, readable, amb_weak and amb_strong; a null says nothing against a sample."""
    ok = lambda c: F.coalesce(F.col(c), F.lit(True))
    code = lambda test, name: F.when(test, F.lit(name))
    data_fine = ok("exec_ok") & ok("anchor_ok")
    spec_failed = ~ok("spec_ok")
    codes = F.array_compact(F.array(
        code(~ok("exec_ok"), "EXEC_FAIL"), code(~ok("anchor_ok"), "SEMANTIC_DRIFT"), code(data_fine & spec_failed & ~ok("features_ok"), "KF_MISMATCH"), code(data_fine & spec_failed & ~ok("contract_ok"), "CONTRACT_VIOLATION"),
        code(data_fine & spec_failed & ~ok("interaction_ok"), "INTERACT_DEGENERATE"), code(data_fine & ~spec_failed & ~ok("readable"), "VIS_UNREADABLE"), code(F.coalesce("amb_weak", F.lit(False)), "AMB_WEAK"), code(F.coalesce("amb_strong", F.lit(False)), "AMB_STRONG"),
    ))
    return reports.withColumn("codes", codes).withColumn("passed", F.size("codes") == 0)


def _holding(items: Column, words: list[str]) -> Column:
    """The texts of an array that hold one of some words, in any case."""
    return F.filter(items, lambda i: F.lower(i).rlike("|".join(words)))


def advice_for(items: Column, table: list) -> Column:
    """The advice that words in an array of texts give, each once, sorted."""
    none = F.array().cast("array<string>")
    found = [F.when(F.size(_holding(items, words)) > 0, F.array(*map(F.lit, advice))).otherwise(none) for words, advice in table]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def iteration_feedback(reports: DataFrame) -> DataFrame:
    """What to repair first and how: needs_iteration, target (sql, altair_code, both or none), priority, and the lists
    sql_issues, sql_suggestions, code_issues, code_suggestions, missing_features, visual_issues, visual_suggestions.

    Takes data_ok, data_issues, features_satisfied, features_total, missing (paths of the features that a chart lacks),
    contract_ok, vis_issues, drawn_ok, drawn_issues and drawn_feedback; without the counts, vis_ok says whether the chart has
    its features. Columns that the reports lack say nothing against a sample, as nulls do. Priority is high with a fault in the
    data, medium with one in the chart alone, and low without one."""
    has = set(reports.columns)
    ok = lambda c: F.coalesce(F.col(c), F.lit(True)) if c in has else F.lit(True)
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in has else F.array().cast("array<string>")
    none = F.array().cast("array<string>")
    only = lambda test, items: F.when(test, items).otherwise(none)
    sql = ~ok("data_ok")
    counted = {"features_satisfied", "features_total"} <= has
    lacking = F.coalesce(F.col("features_satisfied") < F.col("features_total"), F.lit(False)) if counted else ~ok("vis_ok")
    broken, undrawn = ~ok("contract_ok"), ~ok("drawn_ok")
    code = lacking | broken | undrawn
    said = F.concat(F.lit("Key features: "), F.col("features_satisfied").cast("string"), F.lit("/"), F.col("features_total").cast("string"), F.lit(" satisfied")) if counted else F.lit("Key features are missing")
    feedback = F.lower(F.coalesce("drawn_feedback", F.lit(""))) if "drawn_feedback" in has else F.lit("")
    none_or = lambda test, advice: F.when(test, F.array(*map(F.lit, advice))).otherwise(none)
    drawn = F.concat(
        advice_for(F.array(feedback), fixed.VISUAL_ADVICE), none_or(feedback.contains("color") & feedback.rlike("contrast|distinguish"), fixed.COLOR_ADVICE), none_or(F.size(_holding(some("drawn_issues"), ["clipping", "cut off"])) > 0, fixed.CLIPPING_ADVICE)
    )
    return reports.withColumns({
        "needs_iteration": sql | code,
        "target": F.when(sql & code, "both").when(sql, "sql").when(code, "altair_code").otherwise("none"),
        "priority": F.when(sql, "high").when(code, "medium").otherwise("low"),
        "sql_issues": only(sql, _holding(some("data_issues"), ["row", "column", "empty", "null"])),
        "sql_suggestions": only(sql, advice_for(some("data_issues"), fixed.ISSUE_ADVICE)),
        "code_issues": F.concat(only(lacking, F.array(said)), only(broken, _holding(some("vis_issues"), ["contract", "must have"]))),
        "code_suggestions": only(lacking, advice_for(some("vis_issues"), fixed.CODE_ADVICE)),
        "missing_features": only(lacking, some("missing")),
        "visual_issues": only(undrawn, some("drawn_issues")),
        "visual_suggestions": only(undrawn, F.array_sort(F.array_distinct(drawn))),
    })


def suggestions(issue_rows: DataFrame, key: str, issue: str) -> DataFrame:
    """key and advice, each once, by words in the issues."""
    low = F.lower(issue)
    found = []
    for words, advice in fixed.ISSUE_ADVICE:
        test = F.lit(False)
        for w in words:
            test = test | low.contains(w)
        found.append(F.when(test, F.array(*map(F.lit, advice))))
    return issue_rows.select(key, F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("advice")).distinct()


def basic_sample_check(samples: DataFrame) -> DataFrame:
    full = lambda c: F.coalesce(F.length(F.trim(c)) > 2, F.lit(False))
    return samples.where(full("data") & full("vega_lite_spec"))


def gate_quality(df: DataFrame, score: str = "score", suitable: str = "suitable", least: float = 0.3) -> DataFrame:
    return df.where(F.col(suitable) & (F.col(score) >= least))


def gate_charts(reports: DataFrame) -> DataFrame:
    """The drawn charts' verdicts: drawn_ok and drawn_issues, from drawn, judged, readability, data_correct and found (issues).

    A chart that wasn't drawn or judged fails, as one with a readability under MIN_READABILITY (none counts as 0), data that
    isn't represented rightly (null: it is), or an issue."""
    score = F.coalesce(F.col("readability").cast("double"), F.lit(0.0))
    found = F.coalesce("found", F.array().cast("array<string>"))
    low = F.format_string("Low readability score: %.2f < %.1f", score, F.lit(fixed.MIN_READABILITY))
    own = F.array_compact(F.array(F.when(score < fixed.MIN_READABILITY, low), F.when(~F.coalesce("data_correct", F.lit(True)), "Data representation incorrect")))
    listed = F.when(~F.coalesce("drawn", F.lit(False)), F.array(F.lit("Failed to render chart to image"))).when(~F.coalesce("judged", F.lit(False)), F.array(F.lit("Validation of the image failed"))).otherwise(F.concat(own, found))
    return reports.withColumn("drawn_issues", listed).withColumn("drawn_ok", F.size("drawn_issues") == 0)
