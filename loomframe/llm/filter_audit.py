"""Audit of filters that act together: what each removes in every order, and its Shapley share, from a potential.

A document's failures of the five filters are bits of a number. Documents are counted by part and number, so that 32 counts
a part hold all there is to know. The value of a coalition is the number of documents that fail one of its filters; the
Hart-Mas-Colell potential is P(0) = 0, P(S) = (v(S) + the sum of P(S without i)) / |S|, and the share of i is P(all) -
P(all without i). |S|! P(S) is a whole number, so shares over all 120 orders come out exact. A step of an order removes
v(coalition with it) - v(coalition before it).

A copy (filter E) is a row whose text some smaller id has. Rows are counted by digest of the text, so that a text with a
large share of the rows is summed up before it is shuffled: its rows share all other failures, and all of them are copies
but those with the smallest id.

Cases: a null text is empty, with no word, no copy of anything but other empty texts, and failing A. Rows with a null id are
no copies and make none. Rows with the smallest id of a text that repeat are no copies. A null part is the empty string. A
document with several labels is good, or toxic, if one says so. An empty table gives an empty result. Columns other than
those named are not read, so their names can't clash.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 3
#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
ODD = r"[#$%&*|]"
ALL = (1 << len(FILTERS)) - 1
COPY = 1 << FILTERS.index("E")


def own_failures(text: Column) -> Column:
    """The bits of the filters that look at a text alone, A to D."""
    words = F.array_remove(F.split(text, SPACE), "")

    def bits(w):
        n = F.size(w)
        tests = (n < MIN_WORDS, 100 * F.size(F.array_distinct(w)) < MIN_DISTINCT * n, 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MAX_UPPER * F.length(text), text.rlike(ODD))
        return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))

    return F.element_at(F.transform(F.array(words), bits), 1)


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask and counts (n, good, toxic) of documents with the very failures of the mask."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.sha2(t, 256).alias("digest"), own_failures(t).alias("own"))
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in ("quality", "toxic")))
    rows = rows.join(said, "id", "left").select("id", "part", "digest", "own", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    by_id = rows.groupBy("id", "digest", "part", "own", "good", "toxic").agg(F.count("*").alias("n"))
    # one row for each text, part and pair of labels, with its smallest id and the rows that have it
    kinds = by_id.groupBy("digest", "part", "own", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("without"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"))
    first = F.min("least.id").over(Window.partitionBy("digest"))
    kinds = kinds.withColumn("fine", F.col("without") + F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0))
    both = F.array(F.struct(F.col("own").alias("mask"), F.col("fine").alias("n")), F.struct((F.col("own") + COPY).alias("mask"), (F.col("n") - F.col("fine")).alias("n")))
    split = kinds.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def coalition_values(counts: DataFrame) -> DataFrame:
    """A row for each part, with arrays over the 32 coalitions: documents that fail one of their filters (n, good, toxic), and
    those that fail exactly them (exact)."""
    sets = F.sequence(F.lit(0), F.lit(ALL))
    hit = counts.withColumn("s", F.explode(sets))
    meets = F.col("mask").bitwiseAND(F.col("s")) != 0
    sums = [F.sum(F.when(meets, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")]
    by_set = hit.groupBy("part", "s").agg(*sums, F.sum(F.when(F.col("mask") == F.col("s"), F.col("n")).otherwise(0)).alias("exact"), F.sum("n").alias("total"))
    rows = by_set.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("s", "n", "good", "toxic", "exact"))).alias("v"), F.max("total").alias("total"))
    return rows.select("part", "total", *(F.col(f"v.{c}").alias(c) for c in ("n", "good", "toxic", "exact")))


def potentials(values: Column) -> Column:
    """|S|! P(S) of all coalitions in the order of their bits, from v(S): smaller coalitions stand before larger ones."""

    def step(done, s):
        ways = F.element_at(F.array(*(F.lit(factorial(max(k - 1, 0))).cast("long") for k in range(len(FILTERS) + 1))), F.bit_count(s) + 1)
        below = sum((F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.element_at(done, s - (1 << i) + 1)).otherwise(0) for i in range(len(FILTERS))), F.lit(0).cast("long"))
        return F.concat(done, F.array(ways * F.element_at(values, s + 1) + below))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), F.array(F.lit(0).cast("long")), step)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, for every part,
    order and step. shapley is the filter's removals summed over all orders, 120 times its Shapley share."""
    n = len(FILTERS)
    rows = coalition_values(failure_counts(docs, labels, id_col, text, part)).withColumn("potential", potentials(F.col("n")))
    orders = rows.withColumn("filter_order", F.explode(F.lit(["".join(p) for p in permutations(FILTERS)])))
    every = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bit = lambda letter: F.pow(F.lit(2), F.instr(F.lit(FILTERS), letter) - 1).cast("int")
    letters = F.filter(F.split("filter_order", ""), lambda c: c != "")
    every = every.withColumns({"own": bit(F.element_at(letters, F.col("step"))), "before": F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda s, c: s + bit(c))})
    at = lambda c, s: F.element_at(c, s + 1)
    after = F.col("before") + F.col("own")
    removed = lambda c: at(c, after) - at(c, F.col("before"))
    return every.select(
        "part", "filter_order", "step", (F.col("total") - at("n", after)).alias("kept"), removed("n").alias("removed"), (at("n", F.col("own")) - removed("n")).alias("redundant"), at("exact", F.col("own")).alias("unique_fails"),
        removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), (at("potential", F.lit(ALL)) - n * at("potential", ALL - F.col("own"))).alias("shapley"),
    )
