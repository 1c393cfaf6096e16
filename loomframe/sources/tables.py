"""Sources, sinks and catalogue access."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: The columns of a sample's projections, in order.
COMPACT = ["sample_id", "source_question_id", "db_id", "chart_type", "chart_category", "initial_question", "anchor_question", "key_features", "ambiguity_profile", "difficulty", "gt_altair_code", "data", "validation_passed", "required_key_features"]
EXPORT = ["sample_id", "source_question_id", "db_id", "chart_type", "chart_category", "initial_question", "anchor_question", "key_features", "ambiguity_profile", "difficulty", "gt_altair_code", "data", "validation_passed", "vis_intent_type", "chart_image_path"]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str, rows: int = 100_000) -> DataFrame:
    """The rows dealt over all cores by a key, at most about so many a task. A small file is read by few tasks; where each of
    its rows makes much work, these are few tasks for all of it. Steps by the same key need no further shuffle.

    The rows are counted first, which for Parquet reads footers alone."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts, key)


def load_tables(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """Every table of a folder as a frame and a temporary view."""
    frames = {n: read_table(spark, folder, n) for n in names}
    for n, df in frames.items():
        df.createOrReplaceTempView(n)
    return frames


def run_sql(spark: SparkSession, sql: str, limit: int | None = None) -> DataFrame:
    df = spark.sql(sql)
    return df if limit is None else df.limit(limit)


def run_sql_with_error(spark: SparkSession, sql: str, limit: int | None = None) -> tuple[DataFrame | None, str | None]:
    """(frame, None) or (None, message); the message says whether something is not found, the SQL is wrong, or else."""
    try:
        return run_sql(spark, sql, limit), None
    except AnalysisException as e:
        kind = "not found" if "NOT_FOUND" in (e.getCondition() or "") else "SQL error"
        return None, f"{kind}: {e.getCondition()}"
    except ParseException as e:
        return None, f"SQL error: {e.getCondition()}"
    except PySparkException as e:
        return None, f"unexpected: {e.getCondition()}"


def run_sql_safe(spark: SparkSession, sql: str, limit: int | None = None) -> DataFrame | None:
    return run_sql_with_error(spark, sql, limit)[0]


def check_sql(spark: SparkSession, sql: str) -> tuple[bool, str | None]:
    """Whether a statement can be analysed; nothing runs."""
    df, error = run_sql_with_error(spark, sql)
    return df is not None, error


def preview_sql(spark: SparkSession, sql: str, n: int = 5) -> DataFrame:
    return run_sql(spark, sql, n)


def list_tables(spark: SparkSession) -> DataFrame:
    """Names of the session's tables and views, sorted."""
    names = sorted(t.name for t in spark.catalog.listTables())
    return spark.createDataFrame([(n,) for n in names], "name string")


def table_schema(df: DataFrame, primary_key: tuple[str, ...] = ()) -> DataFrame:
    """ordinal, name, type, notnull and pk of each column."""
    rows = [(i, f.name, f.dataType.simpleString(), not f.nullable, f.name in primary_key) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, name string, type string, notnull boolean, pk boolean")


def list_databases(spark: SparkSession, root: str, suffix: str = ".parquet") -> DataFrame:
    """Ids of the data sets under a folder, by the names of their files or folders, sorted."""
    path = F.col("path")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return files.select(F.regexp_extract(path, rf"([^/]+){suffix.replace('.', '[.]')}(/[^/]*)?$", 1).alias("db_id")).where("db_id <> ''").distinct().orderBy("db_id")


def read_declared_schema(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Columns and foreign keys of a declared schema, in which columns name tables, and keys columns, by position.

    A table position of -1 stands for every column and is left out; composite primary keys are flattened; a foreign key
    that isn't a pair is left out.
    """
    raw = spark.read.option("multiLine", True).schema(
        "db_id string, table_names_original array<string>, column_names_original array<array<string>>, column_types array<string>, primary_keys array<string>, foreign_keys array<array<int>>"
    ).json(path)
    flat_keys = F.transform(F.regexp_extract_all(F.array_join("primary_keys", ","), F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    columns = raw.select("db_id", "table_names_original", "column_types", flat_keys.alias("pk"), "foreign_keys", F.posexplode("column_names_original").alias("at", "c"))
    columns = columns.withColumn("t", F.col("c")[0].cast("int")).where("t >= 0").select(
        "db_id", "at", F.col("table_names_original")[F.col("t")].alias("table_name"), F.col("c")[1].alias("name"),
        F.try_element_at("column_types", F.col("at") + 1).alias("data_type"), F.array_contains("pk", F.col("at")).alias("is_primary_key"),
        F.exists("foreign_keys", lambda p: (F.size(p) == 2) & (p[0] == F.col("at"))).alias("is_foreign_key"),
    )
    ordinal = F.row_number().over(Window.partitionBy("db_id", "table_name").orderBy("at")) - 1
    columns = columns.withColumn("ordinal", ordinal)
    pairs = raw.select("db_id", F.explode("foreign_keys").alias("p")).where("size(p) = 2").select("db_id", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    side = lambda c, prefix: columns.select("db_id", F.col("at").alias(c), F.col("table_name").alias(f"{prefix}_table"), F.col("name").alias(f"{prefix}_column"))
    keys = pairs.join(side("a", "from"), ["db_id", "a"]).join(side("b", "to"), ["db_id", "b"]).select("db_id", "from_table", "from_column", "to_table", "to_column")
    return columns.drop("at"), keys


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON array; rows that don't fit are dropped."""
    schema = "question_id long, question string, db_id string, evidence string, SQL string, difficulty string"
    # by element: one that doesn't fit must not take the whole array with it
    items = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "array<string>")).alias("item"))
    rows = items.select(F.from_json("item", schema).alias("q")).select("q.*")
    return rows.where("question_id is not null").withColumnRenamed("SQL", "gold_sql")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last())
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def read_samples(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Samples of a JSON array, one for each sample_id; of repeats the last row of the file stays."""
    reader = spark.read.option("multiLine", True)
    rows = (reader.schema(schema) if schema else reader).json(path).withColumn("__at", F.monotonically_increasing_id())
    return last_wins(rows, "sample_id", "__at").drop("__at")


def get_sample(samples: DataFrame, sample_id: str) -> DataFrame:
    """One sample by id; an error when there is none."""
    found = samples.where(F.col("sample_id") == sample_id)
    if found.isEmpty():
        raise KeyError(sample_id)
    return found


def _projected(samples: DataFrame, names: list[str]) -> DataFrame:
    have = set(samples.columns)
    features = [F.col(c) for c in ("required_key_features", "key_features") if c in have]
    pick = lambda n: F.coalesce(*features).alias(n) if n == "key_features" and features else (F.col(n) if n in have else F.lit(None).cast("string").alias(n))
    return samples.select(*(pick(n) for n in names))


def to_compact(samples: DataFrame) -> DataFrame:
    return _projected(samples, COMPACT)


def to_export(samples: DataFrame) -> DataFrame:
    return _projected(samples, EXPORT)


def to_full(samples: DataFrame, extra: tuple[str, ...] = ("source_instance", "candidate", "vis_sql", "vega_lite_spec", "image_path", "features", "vis_intent_type", "data_quality_report", "vlm_validation_report", "chart_image_path", "created_at")) -> DataFrame:
    return _projected(samples, COMPACT + list(extra))


def passed(samples: DataFrame) -> DataFrame:
    """Samples that passed validation; a missing verdict counts as passed."""
    return samples.where(F.coalesce("validation_passed", F.lit(True)))


def write_samples(samples: DataFrame, path: str, projection=to_compact, fmt: str = "json", mode: str = "overwrite") -> None:
    projection(passed(samples)).write.mode(mode).format(fmt).save(path)


def truncate_inline_data(spec: Column, n: int = 5) -> Column:
    """The spec's first n data rows and how many there were: struct<rows, original>."""
    rows = F.from_json(F.get_json_object(spec, "$.data.values"), "array<string>")
    return F.struct(F.slice(rows, 1, n).alias("rows"), F.size(rows).alias("original"))


def truncate_with_stats(specs: DataFrame, key: str, spec: str, n: int = 3) -> DataFrame:
    """By key: the first n inline rows, how many more there are, and distinct non-null values of each field."""
    rows = specs.select(key, F.posexplode(F.from_json(F.get_json_object(spec, "$.data.values"), "array<map<string,string>>")).alias("at", "row"))
    head = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("at") < n, F.struct("at", F.to_json("row").alias("row"))))).alias("head"), F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more"))
    values = rows.select(key, F.explode("row").alias("field", "value")).where("value is not null").groupBy(key, "field").agg(F.count_distinct("value").alias("n"))
    stats = values.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "n")))).alias("distinct"))
    return head.join(stats, key, "left").select(key, F.transform("head", lambda h: h["row"]).alias("rows"), "more", "distinct")


def json_safe(df: DataFrame) -> DataFrame:
    """Values that JSON can hold: times as text (the date alone if no row of the column has a time), NaN and infinities
    null, control characters out of strings, and strings that are empty then null. One pass finds the date columns."""
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    flags = {}
    if times:
        row = df.agg(*(F.max(F.date_trunc("day", c) != F.col(c)).alias(c) for c in times)).first()
        flags = {c: bool(row[c]) for c in times}

    def safe(f: T.StructField) -> Column:
        c = F.col(f.name)
        if f.name in flags:
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss" if flags[f.name] else "yyyy-MM-dd").alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(f.name)
        if isinstance(f.dataType, T.StringType):
            return F.nullif(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), F.lit("")).alias(f.name)
        return c

    return df.select(*(safe(f) for f in df.schema.fields))


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_statistics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_statistics(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_run_results(results: DataFrame, path: str) -> None:
    """Results in the order of their samples; the commit of the job replaces the old ones."""
    results.orderBy("sample_id").write.mode("overwrite").json(path)
