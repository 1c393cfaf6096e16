"""Text-column functions: questions, query logs, generated code, and JSON in mixed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Capitalised words that are no entities.
STOP_WORDS = ["what", "which", "where", "when", "who", "how", "the", "show"]

#: Unicode's space separators (Zs), which SQL's trim cuts off.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def tokenize_upper(c: Column) -> Column:
    """Words of letters, digits and underscores, upper-cased, of two or more characters."""
    return F.filter(F.split(F.upper(c), "[^A-Za-z0-9_]+"), lambda x: F.length(x) >= 2)


def key_entities(question: Column) -> Column:
    """Quoted strings, then capitalised words of more than two characters that are no stop words, each once."""
    quoted = F.regexp_extract_all(question, F.lit("['\"]([^'\"]+)['\"]"), F.lit(1))
    words = F.filter(F.split(question, r"\s+"), lambda w: (F.length(w) > 2) & w.rlike(r"^\p{Lu}") & ~F.lower(w).isin(STOP_WORDS))
    return F.array_distinct(F.concat(quoted, words))


def evidence_points(c: Column, least: int = 10) -> Column:
    """Points of an evidence text, by semicolons and lines, without spaces at their ends, longer than ten characters."""
    # a lambda of one argument: given both, transform passes the position too, which trim takes for the characters to cut
    parts = F.transform(F.split(F.regexp_replace(c, r"\n", ";"), ";"), lambda p: F.trim(p, F.lit(SPACES)))
    return F.filter(parts, lambda p: F.length(p) > least)


def sql_clauses(sql: Column) -> dict[str, Column]:
    """Clause lists of a query's text by patterns: tables, joins, filters, groupby, measures, order, windows, ctes and
    select. Nested scopes are not told apart, and text in quotes is taken as it stands."""
    s = F.regexp_replace(sql, r"\s+", " ")
    all_of = lambda p, g=1: F.regexp_extract_all(s, F.lit("(?i)" + p), F.lit(g))
    items = lambda p: F.filter(F.transform(F.split(F.regexp_extract(s, "(?i)" + p, 1), r",(?![^(]*\))"), lambda x: F.trim(x)), lambda x: x != "")
    return {
        "tables": F.array_distinct(all_of(r"\b(?:FROM|JOIN)\s+([A-Za-z_][A-Za-z0-9_.]*)")),
        "joins": all_of(r"((?:LEFT |RIGHT |FULL |INNER |CROSS )?(?:OUTER )?JOIN\s+[A-Za-z_][A-Za-z0-9_.]*)"),
        "filters": F.filter(F.transform(F.split(F.regexp_extract(s, r"(?i)\bWHERE\s+(.*?)(?:\s+GROUP BY|\s+ORDER BY|\s+HAVING|\s+LIMIT|;|$)", 1), r"(?i)\s+AND\s+"), lambda x: F.trim(x)), lambda x: x != ""),
        "groupby": items(r"\bGROUP BY\s+(.*?)(?:\s+HAVING|\s+ORDER BY|\s+LIMIT|;|\)|$)"),
        "measures": all_of(r"\b((?:SUM|COUNT|AVG|MIN|MAX|TOTAL|GROUP_CONCAT)\s*\([^)]*\))"),
        "order": items(r"\bORDER BY\s+(.*?)(?:\s+LIMIT|;|\)|$)"),
        "windows": all_of(r"\b([A-Z_]+\s*\([^)]*\)\s+OVER\s*\([^)]*\))"),
        "ctes": all_of(r"(?:\bWITH|,)\s+([A-Za-z_][A-Za-z0-9_]*)\s+AS\s*\(\s*SELECT"),
        "select": items(r"\bSELECT\s+(?:DISTINCT\s+)?(.*?)\s+FROM\b"),
    }


def limit_value(sql: Column) -> Column:
    return F.nullif(F.regexp_extract(sql, r"(?i)\bLIMIT\s+([0-9]+)", 1), F.lit("")).try_cast("bigint")


def sql_shape(df: DataFrame, sql: str) -> DataFrame:
    """Adds is_aggregated, has_groupby, limit_value, estimated_rows and suggestions."""
    c = F.col(sql)
    clauses = sql_clauses(c)
    aggregated, grouped, n = F.size(clauses["measures"]) > 0, F.size(clauses["groupby"]) > 0, limit_value(c)
    rows = F.when(n == 1, "single").when((n > 0) & (n < 10), "few").when(aggregated & ~grouped, "single").otherwise("many")
    some = lambda test, *texts: F.when(test, F.array(*map(F.lit, texts))).otherwise(F.array().cast("array<string>"))
    advice = F.concat(
        some(rows == "single", "Add GROUP BY to get multiple data points", "Remove LIMIT 1 or expand to show top N"),
        some(~aggregated & ~grouped, "Consider adding aggregation for visualization"),
    )
    return df.withColumns({"is_aggregated": aggregated, "has_groupby": grouped, "limit_value": n, "estimated_rows": rows, "suggestions": advice})


def intent_text(sql: Column) -> Column:
    """A few readable lines about a query."""
    c = sql_clauses(sql)
    part = lambda label, x: F.when(F.size(x) > 0, F.concat(F.lit(label), F.array_join(x, ", ")))
    return F.concat_ws("; ", part("tables: ", c["tables"]), part("measures: ", c["measures"]), part("grouped by: ", c["groupby"]), part("filters: ", c["filters"]), part("ordered by: ", c["order"]))


def drop_limit1(sql: Column) -> Column:
    return F.regexp_replace(sql, r"(?i)\s+LIMIT\s+1\s*;?\s*$", "")


def expand_limit(sql: Column, n: int = 20) -> Column:
    """LIMIT set to n, or added."""
    has = sql.rlike(r"(?i)\bLIMIT\s+[0-9]+")
    return F.when(has, F.regexp_replace(sql, r"(?i)\bLIMIT\s+[0-9]+", f"LIMIT {n}")).otherwise(F.concat(F.regexp_replace(sql, r"\s*;?\s*$", ""), F.lit(f" LIMIT {n}")))


def unfenced(c: Column) -> Column:
    """Text without code fences."""
    return F.regexp_replace(F.regexp_replace(c, r"```[A-Za-z]*\n?", ""), r"^\s+|\s+$", "")


def clean_sql(c: Column) -> Column:
    """The statement alone: no fences, nothing before SELECT or WITH."""
    return F.regexp_extract(unfenced(c), r"(?is)((?:\bSELECT\b|\bWITH\b).*)$", 1)


def clean_question(c: Column) -> Column:
    """Without surrounding quotes, with a capital first letter and a final question mark."""
    bare = F.trim(F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", ""))
    capital = F.concat(F.upper(F.substring(bare, 1, 1)), F.substr(bare, F.lit(2)))
    return F.when(F.length(bare) == 0, bare).when(capital.rlike(r"[?.!]$"), capital).otherwise(F.concat(capital, F.lit("?")))


def clean_code(c: Column) -> Column:
    block = F.regexp_extract(c, r"(?s)```(?:python|py)?\n(.*?)```", 1)
    return F.regexp_replace(F.when(block != "", block).otherwise(unfenced(c)), r"^\s+|\s+$", "")


def fenced_blocks(c: Column) -> Column:
    """array<struct<language, body>> of all fenced blocks."""
    pattern = r"(?s)```([A-Za-z]*)\n(.*?)```"
    zipped = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("language"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("body"))
    return zipped


def extract_json(c: Column) -> Column:
    """JSON in mixed text, as canonical text: the whole, a fenced block, from the first brace to the last, or brackets."""
    candidates = [
        c,
        F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1),
        F.regexp_extract(c, r"(?s)(\{.*\})", 1),
        F.regexp_extract(c, r"(?s)(\[.*\])", 1),
    ]
    good = lambda x: F.when(F.trim(x).rlike(r"(?s)^[\[{]"), F.to_json(F.try_parse_json(x)))
    return F.coalesce(*(good(x) for x in candidates))


def feedback_score(c: Column) -> Column:
    """A score out of feedback text, kept between 1 and 10."""
    n = F.nullif(F.regexp_extract(c, r"(?i)score\D{0,5}([0-9]+)", 1), F.lit("")).try_cast("int")
    return F.when(n.isNotNull(), F.greatest(F.least(n, F.lit(10)), F.lit(1)))


_ABSOLUTE = r"[^\s\"']*dev_databases/([A-Za-z0-9_]+)/\1\.sqlite"


def relativize_paths(df: DataFrame, code: str) -> DataFrame:
    """Absolute database paths made relative, and how many there were."""
    return df.withColumns({"n_replaced": F.regexp_count(code, F.lit(_ABSOLUTE)), code: F.regexp_replace(code, _ABSOLUTE, "./databases/$1.sqlite")})


#: Operations that count after a read.
POST_SQL_OPS = r"rank\(|rolling\(|pivot|groupby|rename\(|to_datetime"


def has_post_sql_ops(df: DataFrame, key: str, code: str, name: str = "has_ops") -> DataFrame:
    """Whether a line after the first read_sql has both df and one of the operations. By lines, in order, in each row."""
    lines = F.split(code, r"\n")
    first = F.array_position(F.transform(lines, lambda x: x.contains("read_sql")), F.lit(True))
    later = F.filter(F.slice(lines, first.cast("int") + 1, F.size(lines)), lambda x: ~x.contains("read_sql") & x.contains("df") & x.rlike(POST_SQL_OPS))
    return df.select(key, F.when(first > 0, F.size(later) > 0).otherwise(False).alias(name))


def truncate_text(c: Column, n: int, mark: str = "... [truncated]") -> Column:
    """struct<text, truncated, length>."""
    long = F.length(c) > n
    return F.struct(F.when(long, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c).alias("text"), long.alias("truncated"), F.length(c).alias("length"))
