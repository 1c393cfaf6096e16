"""Secret scan in SQL functions only: three patterns, and a randomness test battery on long tokens.

The battery takes tokens of MIN_TOKEN or more characters that fit one encoding's alphabet. It maps characters to places
in the alphabet and tests uniformity over cells (chi-squared), runs about the middle, and lag-one serial correlation.
A token is called random if the last two don't object and its chi-squared statistic is far below what word-like text of
that length would give: a non-central chi-squared law whose centre grows with the length, so that short tokens, which
could pass by chance, get weak p-values. The p-values of all tokens of the corpus go through Benjamini-Hochberg.

Cases: a null or empty text has no span; texts of any length are scanned whole; repeated rows give repeated results;
tokens tied in their p-value are decided alike; an empty table gives an empty result. Positions are code points, end
exclusive. ``scan`` keeps only the columns it is told to keep, under their names; of these only base_spans and spans
clash, which is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Kinds of spans in the order that breaks ties.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LENGTH = 20
HEX = r"[0-9a-f]{24,}"  # a run of 24 or more, as [0-9a-f]+ with shorter matches dropped
MIN_TOKEN = 20
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
FALSE_DISCOVERIES = 0.05
#: Chi-squared distance from uniform, a character, that word-like text has at least.
TEXT_EFFECT = 0.8
#: Standard deviations at which runs or serial correlation speak against randomness.
VETO = 3.5
#: Bins of -log10 p for the corpus-wide step; p-values in one bin are decided alike.
BINS_PER_DECADE = 100

#: Matches whose places are summed by one fold.
STRETCH = 64

_HEX, _LOWER = "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz"
_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _before(values: Column, join) -> Column:
    """What join makes of all values before each place of an array of ints, 0 before the first. A fold that appends
    copies its array at every step, so long arrays go in stretches of STRETCH, each from what those before it make."""
    none = F.expr("cast(array() as array<int>)")

    def fold(part, begin):
        first = F.struct(begin.alias("at"), none.alias("out"))
        return F.aggregate(part, first, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def stretches(v):
        whole = F.sequence(F.lit(0), F.ceil(F.size(v) / STRETCH).cast("int") - 1)
        stretch = lambda k: F.slice(v, k * STRETCH + 1, F.lit(STRETCH))
        totals = F.transform(whole, lambda k: F.aggregate(stretch(k), F.lit(0), join))
        return _let(fold(totals, F.lit(0)), lambda begins: F.flatten(F.transform(whole, lambda k: fold(stretch(k), F.element_at(begins, k + 1)))))

    return _let(values, lambda v: F.when(F.size(v) <= STRETCH, fold(v, F.lit(0))).otherwise(stretches(v)))


def _matches(t: Column, pattern: str, keep, group: int = 0) -> Column:
    """array<struct<start, end>> of the non-overlapping matches that keep(match, group text) holds for."""
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(t, F.lit(pattern), F.lit(group)) if group else found
    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def spans(lengths):
        # the text is a gap, a match, a gap, and so on: a match begins at its gap's length past what is before them
        gaps = F.slice(F.transform(F.split(t, pattern, -1), F.length), F.lit(1), F.size(lengths))
        rows = lambda gaps: F.arrays_zip(lengths.alias("n"), gaps.alias("gap"), _before(F.zip_with(gaps, lengths, lambda g, n: g + n), lambda a, x: a + x).alias("before"), parts.alias("v"))
        kept = F.filter(_let(gaps, rows), lambda r: keep(r["n"], r["v"]))
        return F.transform(kept, lambda r: F.struct((r["before"] + r["gap"]).alias("start"), (r["before"] + r["gap"] + r["n"]).alias("end"), r["v"].alias("value")))

    return F.when(t.rlike(pattern), _let(F.transform(found, F.length), spans)).otherwise(empty)


def _normal_cdf(z: Column) -> Column:
    """The normal law's distribution function: a polynomial in the middle, the tail's expansion below -3."""
    a = F.abs(z)
    k = 1 / (1 + 0.2316419 * a)
    density = F.exp(-a * a / 2) * 0.3989422804014327
    upper = density * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    tail = density / a * (1 - 1 / (a * a) + 3 / (a * a * a * a))
    upper = F.when(a > 3, tail).otherwise(upper)
    return F.when(z < 0, upper).otherwise(1 - upper)


def encoding(token: Column) -> Column:
    """The alphabet that a token is inferred to be written in, or null."""
    bare = F.rtrim(token, F.lit("="))
    digit, lower, upper = bare.rlike("[0-9]"), bare.rlike("[a-z]"), bare.rlike("[A-Z]")
    return (
        F.when(bare.rlike("^[0-9a-f]+$") & digit & lower | bare.rlike("^[0-9A-F]+$") & digit & upper, "hex")
        .when(bare.rlike("^[0-9a-z]+$") & digit & lower | bare.rlike("^[0-9A-Z]+$") & digit & upper, "alnum")
        .when(bare.rlike("^[A-Za-z0-9+/_-]+$") & digit & lower & upper, "base64")
    )


def _let(value: Column, body) -> Column:
    """The body over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _neighbours(values: Column, pair) -> Column:
    """The sum of pair(value, value before) over an array."""
    return _total(F.zip_with(F.slice(values, F.lit(2), F.size(values)), F.slice(values, F.lit(1), F.size(values) - 1), lambda a, b: pair(a, b).cast("double")))


def _uniformity(v: Column, code: Column, k: Column) -> Column:
    """Deviations of the chi-squared statistic from what word-like text has."""
    n = F.size(v).cast("double")
    sizes = F.when(code == "alnum", F.array(*map(F.lit, (2, 3, 4, 6, 9, 12)))).otherwise(F.array(*map(F.lit, (2, 4, 8, 16))))
    fitting = F.array_max(F.filter(sizes, lambda c: (c * 5 <= n) | (c == 2)))

    def over(cells):
        counts = F.transform(F.sequence(F.lit(0), cells - 1), lambda c: F.size(F.filter(v, lambda x: F.floor(x * cells / k) == c)))
        chi = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c.cast("double") * c) * cells / n - n
        free, centre = (cells - 1).cast("double"), n * TEXT_EFFECT
        return (chi - free - centre) / F.sqrt(2 * (free + 2 * centre))

    return _let(fitting, over)


def _runs(v: Column, k: Column) -> Column:
    """Deviations of the number of runs about the alphabet's middle."""
    n = F.size(v).cast("double")

    def over(high):
        def spread(both):
            var = both * (both - n) / (n * n * (n - 1))
            return F.when(var > 0, F.abs(_neighbours(high, lambda a, b: a != b) - both / n) / F.sqrt(var)).otherwise(F.lit(99.0))

        return _let(_total(high), lambda ones: _let(2 * ones * (n - ones), spread))

    return _let(F.transform(v, lambda x: (x * 2 >= k).cast("double")), over)


def _serial(v: Column) -> Column:
    """Deviations of the lag-one correlation."""
    n = F.size(v).cast("double")

    def over(mean):
        variance = _total(F.transform(v, lambda x: (x - mean) * (x - mean)))
        return _let(variance, lambda s2: F.when(s2 > 0, F.abs(_neighbours(v, lambda a, b: (a - mean) * (b - mean)) / s2) * F.sqrt(n)).otherwise(F.lit(99.0)))

    return _let(_total(v) / n, over)


def text_p_value(token: Column, code: Column) -> Column:
    """The probability that word-like text of this length looks as random; 1 if runs or serial correlation object."""

    def over(code):
        bare = F.rtrim(token, F.lit("="))
        plain = F.when(code == "base64", F.translate(bare, "-_", "+/")).otherwise(F.lower(bare))
        alphabet = F.when(code == "hex", _HEX).when(code == "alnum", _LOWER).otherwise(_B64)
        k = F.length(alphabet)
        places = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))

        def tests(v):
            call = _let(_uniformity(v, code, k), _normal_cdf)
            return F.when((_runs(v, k) > VETO) | (_serial(v) > VETO), F.lit(1.0)).otherwise(F.greatest(call, F.lit(1e-300)))

        return _let(places, tests)

    return _let(code, over)


def _bin(p: Column) -> Column:
    return F.floor(-F.log10(p) * BINS_PER_DECADE).cast("int")


def scan(docs: DataFrame, keep: list[str], text: str = "text", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """The kept columns, base_spans and spans: arrays of (start, rank of kind, end), sorted. A random token that a span
    of the patterns covers is not repeated."""
    if clash := {"base_spans", "spans"} & {c.lower() for c in keep}:
        raise ValueError(f"columns {sorted(clash)} exist already")
    # kept columns travel in a struct, so that helper columns can't clash with them
    t = F.col("t")
    rows = docs.select(F.struct(*keep).alias("kept"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = rows.select(
        "kept",
        _matches(t, ASSIGN, lambda n, v: F.length(v) >= ASSIGN_VALUE, 1).alias("assign"),
        F.when(t.contains("AKIA"), _matches(t, ACCESS, lambda n, v: n >= ACCESS_LENGTH)).alias("access"),
        _matches(t, HEX, lambda n, v: F.lit(True)).alias("hex"),
        _matches(t, TOKEN, lambda n, v: encoding(v).isNotNull()).alias("token"),
    )
    ranked = lambda c, k: F.transform(F.coalesce(c, F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")), lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))
    base = F.array_sort(F.concat(*(ranked(F.col(c), k) for k, c in enumerate(KINDS[:3]))))
    tested = lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end"), _bin(text_p_value(s["value"], encoding(s["value"]))).alias("bin"))
    found = materialize(
        found.withColumn("base_spans", base).select("kept", "base_spans", F.transform("token", tested).alias("tokens")).withColumn("apart", _uncovered(F.col("base_spans"), F.col("tokens"))),
        "secret-spans",
    )
    least = discovery_bin(found.select(F.explode("tokens.bin").alias("bin")), rate)
    new = F.transform(F.filter("apart", lambda s: s["bin"] >= least), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    own = [F.col("kept").getField(c).alias(c) for c in keep]
    return found.select(*own, "base_spans", F.array_sort(F.concat("base_spans", new)).alias("spans"))


def _uncovered(base: Column, tokens: Column) -> Column:
    """The tokens that no base span covers: those that end past the furthest end of all base spans up to their start."""
    spans = F.array_sort(F.concat(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(0).alias("bin"))), tokens))

    def over(spans):
        reach = _before(F.transform(spans, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0)), lambda a, x: F.greatest(a, x))
        new = F.filter(F.arrays_zip(spans.alias("s"), reach.alias("reach")), lambda r: (r["s"]["kind"] == 3) & (r["s"]["end"] > r["reach"]))
        return F.transform(new, lambda r: r["s"])

    return F.when(F.size(base) * F.size(tokens) == 0, tokens).otherwise(_let(spans, over))


def discovery_bin(bins: DataFrame, rate: float) -> int:
    """Benjamini-Hochberg over binned p-values: the least bin of -log10 p that is called. There are at most 300 decades
    of bins, whatever the corpus, so that the counts come to the driver."""
    counts = sorted(((r["bin"], r["count"]) for r in bins.groupBy("bin").count().collect()), reverse=True)
    total, seen, least = sum(n for _, n in counts), 0, 1 << 30
    for b, n in counts:
        seen += n
        if 10 ** (-b / BINS_PER_DECADE) <= rate * seen / total:
            least = b
    return least


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch that spans cover replaced by a mark."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc, s):
        piece = F.when(s["start"] >= acc["at"], F.concat(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    done = F.aggregate(spans, first, add, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
