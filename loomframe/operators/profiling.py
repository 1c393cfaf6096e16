"""Profiles of tables and columns, and what their columns are good for."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokenize_upper
from ..sources.scratch import shared_dir

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
# What in a column's name makes it a time.
TIME_WORDS = ["date", "time", "year", "month", "day", "created", "updated", "timestamp"]


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def catalog_columns(frames: dict[str, DataFrame]) -> DataFrame:
    """table_name, ordinal, name and data_type of every column of some tables; only schemas are read."""
    rows = [(t, i, f.name, f.dataType.simpleString()) for t, df in sorted(frames.items()) for i, f in enumerate(df.schema.fields)]
    spark: SparkSession = next(iter(frames.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, ordinal int, name string, data_type string")


def _plain(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def long_values(df: DataFrame) -> DataFrame:
    """column and value (as text) of every cell, nulls left out, in one pass."""
    cells = F.array(*(F.struct(F.lit(f.name).alias("column"), F.col(f.name).cast("string").alias("value")) for f in _plain(df)))
    return df.select(F.explode(cells).alias("c")).select("c.column", "c.value").where("value is not null")


def sample_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The n least distinct non-null values of a column."""
    return df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").limit(n)


def all_sample_values(df: DataFrame, n: int = 5) -> DataFrame:
    """The n least values (as text) of every column."""
    distinct = long_values(df).distinct()
    k = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    return distinct.withColumn("k", k).where(F.col("k") <= n).groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("samples"))


def distinct_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct non-null values of every column, as rows of column and n_distinct."""
    if approx:
        one = df.agg(*(F.approx_count_distinct(f.name).alias(f.name) for f in _plain(df)))
        return one.unpivot([], one.columns, "column", "n_distinct")
    return long_values(df).groupBy("column").agg(F.count_distinct("value").alias("n_distinct"))


def measure_stats(df: DataFrame, measures: list[str]) -> DataFrame:
    """Least, greatest, mean and null count of each measure, in one pass."""
    aggs = []
    for m in measures:
        c = F.col(m).cast("double")
        aggs += [F.min(c).alias(f"{m}|low"), F.max(c).alias(f"{m}|high"), F.avg(c).alias(f"{m}|mean"), F.count_if(F.col(m).isNull()).alias(f"{m}|nulls")]
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(m).alias("measure"), *(F.col(f"`{m}|{k}`").alias(k) for k in ("low", "high", "mean", "nulls"))) for m in measures))
    return one.select(F.explode(rows).alias("r")).select("r.*")


@contextmanager
def _set(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Session settings for a while."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def footer_plan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One row of aggregates that Parquet footers answer, to be run within the settings of footer_stats."""
    aggs = [F.count("*").alias("n_rows")]
    for k, c in enumerate(columns):
        aggs += [F.count(c).alias(f"n_{k}"), F.min(c).alias(f"low_{k}"), F.max(c).alias(f"high_{k}")]
    return spark.read.parquet(path).agg(*aggs)


#: Types whose least and greatest values footers hold exactly; texts may be cut there.
FOOTER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.BooleanType)


def footer_stats(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """column, n_rows, n_nulls, low and high (as text) of a Parquet table's columns, from its footers alone: the aggregates are
    pushed down into the scan, which reads no row. Takes columns of FOOTER_TYPES (all, unless some are named), since footers
    hold no exact ends of others; of such a column, ask measure_stats. The row that comes to the driver has one value each.

    Cases: a column of nulls alone has no ends; an empty table has no rows and no nulls. Footers that lack statistics, as some
    writers leave them out, are an error of Spark's, never a wrong answer."""
    fields = [f for f in spark.read.parquet(path).schema.fields if (f.name in columns if columns else isinstance(f.dataType, FOOTER_TYPES))]
    if other := [f.name for f in fields if not isinstance(f.dataType, FOOTER_TYPES)]:
        raise ValueError(f"footers hold no exact ends of {other}")
    with _set(spark, spark__sql__sources__useV1SourceList="", spark__sql__parquet__aggregatePushdown="true"):
        one = footer_plan(spark, path, [f.name for f in fields])
        if not _reads_footers(one):
            raise ValueError(f"the aggregates of {path} were not pushed into its scan")
        row = one.first()
    kinds = [f.dataType for f in fields]
    values = spark.createDataFrame([row], one.schema)
    cells = [F.struct(F.lit(f.name).alias("column"), F.col("n_rows"), (F.col("n_rows") - F.col(f"n_{k}")).alias("n_nulls"), F.col(f"low_{k}").cast("string").alias("low"), F.col(f"high_{k}").cast("string").alias("high")) for k, f in enumerate(fields)]
    return values.select(F.inline(F.array(*cells))) if kinds else values.select(F.lit("").alias("column"), "n_rows", F.lit(0).cast("long").alias("n_nulls"), F.lit("").alias("low"), F.lit("").alias("high")).limit(0)


def _reads_footers(df: DataFrame) -> bool:
    """Whether a plan's scan has the aggregates in it."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "PushedAggregation: [COUNT" in plan


def null_share(df: DataFrame) -> DataFrame:
    """Null cells over all cells."""
    nulls = sum((F.sum(F.col(c).isNull().cast("long")) for c in df.columns), F.lit(0).cast("long"))
    return df.agg((F.coalesce(nulls, F.lit(0)) / F.greatest(F.count(F.lit(1)) * len(df.columns), F.lit(1))).alias("null_share"))


#: Rows that a preview looks at first.
HEAD_ROWS = 1_000


def column_preview(df: DataFrame, order: str, n: int = 3) -> DataFrame:
    """Type and the first n non-null values of each column, in the order given. One pass takes the first rows, which are
    enough for all columns but those that hold too few values there; these get a pass of their own."""
    kinds = {f.name: f.dataType.simpleString() for f in _plain(df)}
    head = df.orderBy(order).limit(HEAD_ROWS)
    filled = head.agg(*(F.count(c).alias(c) for c in kinds)).first()
    cell = lambda c: F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.struct(F.col(order).alias("o"), F.col(c).cast("string").alias("v")).alias("s"))
    some = [c for c in kinds if filled[c] >= n]
    parts = [head.select(F.explode(F.array(*map(cell, some))).alias("c"))] if some else []
    parts += [df.where(F.col(c).isNotNull()).orderBy(order).limit(n).select(cell(c).alias("c")) for c in kinds if filled[c] < n]
    rows = reduce(DataFrame.union, parts).select("c.*").where("s.v is not null")
    first = rows.groupBy("column", "type").agg(F.slice(F.array_sort(F.collect_list("s")), 1, n).alias("s"))
    return first.select("column", "type", F.array_join(F.transform("s", lambda s: s["v"]), "|").alias("values"))


def cell_text(c: Column, width: int = 25) -> Column:
    """A cell as a profile shows it: NULL for null, long text cut with dots."""
    s = c.cast("string")
    return F.when(s.isNull(), "NULL").when(F.length(s) > width, F.concat(F.substring(s, 1, width), F.lit("..."))).otherwise(s)


def result_profile(df: DataFrame, order: list[str], rows: int = 3, max_cols: int = 8, width: int = 25) -> DataFrame:
    """The first rows with each shown column's distinct count over the whole frame, as rows of text."""
    shown = df.columns[:max_cols]
    counts = df.agg(*(F.count_distinct(c).alias(c) for c in shown)).select(F.lit(-1).alias("row"), *(F.col(c).cast("string").alias(c) for c in shown))
    head = df.orderBy(*order).limit(rows)
    numbered = head.select(F.row_number().over(Window.orderBy(*order)).alias("row"), *(cell_text(F.col(c), width).alias(c) for c in shown))
    return counts.unionByName(numbered)


def table_profile(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows and distinct counts of every column of some tables."""
    parts = None
    for name, df in sorted(frames.items()):
        part = distinct_counts(df).crossJoin(F.broadcast(row_count(df))).select(F.lit(name).alias("table_name"), "column", "n_distinct", "n_rows")
        parts = part if parts is None else parts.union(part)
    return parts


def column_semantics(name: Column, data_type: Column) -> Column:
    """temporal by name, then identifier, numeric or categorical by type and name."""
    n, t = F.lower(name), F.lower(data_type)
    number = t.rlike("int|real|float|double|decimal|numeric")
    text = t.rlike("text|varchar|char|string")
    return (
        F.when(n.rlike("|".join(TIME_WORDS)), "temporal")
        .when(number & n.endswith("id"), "identifier")
        .when(number, "numeric")
        .when(text & (n.endswith("id") | n.endswith("code")), "identifier")
        .otherwise("categorical")
    )


def field_chart_type(semantics: Column, name: Column) -> Column:
    """temporal, quantitative or nominal, by semantics where known, else by the name."""
    known = F.when(semantics == "temporal", "temporal").when(semantics == "numeric", "quantitative").when(semantics == "categorical", "nominal")
    guess = F.when(F.lower(name).rlike("date|time|year|month|day|created|updated"), "temporal")
    return F.coalesce(known, guess, F.lit("nominal"))


def vis_potential(columns: DataFrame, key: str) -> DataFrame:
    """By key: fields of each kind; identifiers can be dimensions and measures."""
    s = column_semantics(F.col("name"), F.col("data_type"))
    pick = lambda *kinds: F.array_sort(F.collect_list(F.when(F.col("s").isin(*kinds), F.col("name"))))
    return columns.withColumn("s", s).groupBy(key).agg(
        pick("temporal").alias("temporal"), pick("categorical").alias("categorical"), pick("numeric").alias("numeric"),
        pick("temporal", "categorical", "identifier").alias("dimensions"), pick("numeric", "identifier").alias("measures"),
    )


def suggest_charts(potential: DataFrame, has_aggregation: Column, groups: Column) -> DataFrame:
    """Adds the chart types that the fields allow; none gives the default three."""
    t, c, q = (F.size(x) > 0 for x in ("temporal", "categorical", "numeric"))
    when = lambda test, *names: F.when(test, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(F.concat(
        when(t & q, "line_chart", "area_chart"), when(c & q, "bar_chart", "horizontal_bar_chart"), when(q, "histogram"), when(F.size("numeric") >= 2, "scatter_plot"),
        when(has_aggregation & (groups > 0), "grouped_bar_chart"), when(has_aggregation & (groups > 1), "stacked_bar_chart"), when(c & has_aggregation, "pie_chart"),
    ))
    default = F.array(*map(F.lit, ("bar_chart", "line_chart", "scatter_plot")))
    return potential.withColumn("suggestions", F.when(F.size(found) > 0, F.array_sort(found)).otherwise(default))


def group_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and group_id, the least node that links lead to; single nodes are groups too.

    Labels shrink to the least label of a node's neighbours and of its own label until none changes; each round's
    lineage is cut off (checkpoint), so that the plan stays small."""
    shared_dir(edges.sparkSession)
    both = edges.toDF("a", "b")
    both = both.union(both.select("b", "a")).where("a <> b").distinct()
    labels = nodes.toDF("node").distinct().withColumn("label", F.col("node"))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels.node == near.a, "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"))
        # a label is itself a node: its own label is nearer to the least one
        jump = stepped.select(F.col("node").alias("l"), F.col("label").alias("of"))
        new = stepped.join(jump, stepped.label == jump.l).select("node", F.col("of").alias("label")).checkpoint()
        settled = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty()
        labels = new
        if settled:
            return labels.select("node", F.col("label").alias("group_id"))


def table_groups(edges: DataFrame, nodes: DataFrame, members: bool = True) -> DataFrame:
    """Groups of nodes that links connect, the largest first: group_id (least member), size, n_links (different links
    within the group) and, for catalogues, whose groups are small, the members; group_labels gives these row by row."""
    labels = group_labels(edges, nodes)
    a, b = edges.columns
    links = edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("node"), F.greatest(a, b).alias("other")).distinct().join(labels, "node").groupBy("group_id").agg(F.count(F.lit(1)).alias("n_links"))
    listed = [F.array_sort(F.collect_list("node")).alias("members")] if members else []
    groups = labels.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), *listed).join(links, "group_id", "left")
    return groups.select("group_id", "size", F.coalesce("n_links", F.lit(0)).alias("n_links"), *(["members"] if members else [])).orderBy(F.desc("size"), "group_id")


def schema_digest(columns: DataFrame, max_cols: int = 8) -> DataFrame:
    """A line for each table: its first columns with their types, and how many more there are."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "name", "data_type")))
    lines = columns.groupBy("table_name").agg(ordered.alias("c"))
    shown = F.array_join(F.transform(F.slice("c", 1, max_cols), lambda x: F.concat(x["name"], F.lit(" ("), x["data_type"], F.lit(")"))), ", ")
    more = F.when(F.size("c") > max_cols, F.concat(F.lit(", +"), (F.size("c") - max_cols).cast("string"), F.lit(" more"))).otherwise("")
    return lines.select("table_name", F.concat("table_name", F.lit(": "), shown, more).alias("line"))


def schema_line(columns: DataFrame) -> DataFrame:
    names = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"])
    return columns.groupBy("table_name").agg(F.concat(F.lit("Table: "), F.first("table_name"), F.lit("("), F.array_join(names, ", "), F.lit(")")).alias("line"))


def schema_slice(columns: DataFrame, keys: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns of the named tables, and foreign keys with both ends among them; names match in any case."""
    wanted = names.select(F.lower("table_name").alias("w")).distinct()
    kept = columns.join(wanted, F.lower("table_name") == wanted.w, "left_semi")
    both = keys.join(wanted, F.lower("from_table") == wanted.w, "left_semi").join(wanted.withColumnRenamed("w", "w2"), F.lower("to_table") == F.col("w2"), "left_semi")
    return kept, both


def rank_tables_by_text(columns: DataFrame, texts: DataFrame, key: str, text: str, k: int = 12) -> DataFrame:
    """The k tables whose names (twice) and first 15 columns share most words with each text; tables that share none
    follow in the order of their names. Texts meet tables by their words only."""
    words = lambda c: F.array_distinct(tokenize_upper(c))
    tables = columns.where("ordinal < 15").groupBy("table_name").agg(F.array_join(F.collect_list("name"), " ").alias("cols"))
    table_words = tables.select("table_name", F.explode(words(F.col("table_name"))).alias("word"), F.lit(2).alias("weight")).union(tables.select("table_name", F.explode(words(F.col("cols"))), F.lit(1)))
    asked = texts.select(key, F.explode(words(F.col(text))).alias("word"))
    shared = asked.join(table_words, "word").groupBy(key, "table_name").agg(F.sum("weight").cast("int").alias("score"))
    # at most k tables that share a word stand before the others, so the first 2 k names are enough for these
    firsts = tables.orderBy("table_name").limit(2 * k).agg(F.array_sort(F.collect_list("table_name")).alias("names"))
    filling = texts.select(key).crossJoin(F.broadcast(firsts)).select(key, F.explode("names").alias("table_name"), F.lit(0).alias("score"))
    scored = shared.union(filling).groupBy(key, "table_name").agg(F.max("score").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "table_name")))
    return ranked.where(F.col("rank") <= k)


def tables_with_columns(columns: DataFrame, names: list[str]) -> DataFrame:
    return columns.where(F.lower("name").isin([n.lower() for n in names])).select("table_name").distinct()


def find_column(columns: DataFrame, name: str) -> DataFrame:
    """The first table that has the column."""
    return columns.where(F.lower("name") == name.lower()).agg(F.min_by("table_name", F.struct("table_name", "ordinal")).alias("table_name"))


def missing_columns(refs: DataFrame, columns: DataFrame) -> DataFrame:
    """References to columns that no table has; a prefix is stripped and a star is exempt."""
    name = F.upper(F.element_at(F.split("ref", r"\."), -1))
    known = columns.select(F.upper("name").alias("known")).distinct()
    wanted = refs.withColumn("__n", name).where("__n <> '*'")
    return wanted.join(known, F.col("__n") == F.col("known"), "left_anti").drop("__n")


def question_stats(questions: DataFrame) -> DataFrame:
    """Counts by difficulty and by database, their total, and the share of questions with evidence."""
    d = F.when(F.trim(F.coalesce("difficulty", F.lit(""))) == "", "unknown").otherwise(F.col("difficulty"))
    base = questions.withColumn("difficulty", d)
    cells = F.array(F.struct(F.lit("difficulty").alias("dimension"), F.col("difficulty").alias("value")), F.struct(F.lit("db_id").alias("dimension"), F.col("db_id").alias("value")), F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")))
    evidence = F.sum((F.trim(F.coalesce("evidence", F.lit(""))) != "").cast("long")) * 100.0 / F.count(F.lit(1)) if "evidence" in questions.columns else F.lit(0.0)
    rows = base.withColumn("c", F.explode(cells))
    return rows.groupBy("c.dimension", "c.value").agg(F.count(F.lit(1)).alias("n"), evidence.alias("evidence_pct"))


def filter_questions(df: DataFrame, question_id: int | None = None, db: str | None = None, difficulty: str | None = None, max_n: int | None = None) -> DataFrame:
    """One question, or those of a database and difficulty (any case), capped unless an id is given."""
    if question_id is not None:
        return df.where(F.col("question_id") == question_id)
    if db:
        df = df.where(F.lower("db_id") == db.lower())
    if difficulty:
        df = df.where(F.lower("difficulty") == difficulty.lower())
    return df.orderBy("question_id").limit(max_n) if max_n else df


def list_first(df: DataFrame, n: int, width: int = 160) -> DataFrame:
    line = F.substring(F.trim(F.regexp_replace("question", r"\n", " ")), 1, width)
    return df.orderBy("question_id").limit(n).select("question_id", "db_id", line.alias("question"))
