"""Sharding by best-fit-decreasing bin packing of indivisible groups (rows of equal text).

Groups, largest first, each enter the bin with the least remaining capacity that still holds them, found in a balanced
tree keyed by remaining capacity. Groups of one size are interchangeable, so the packer works on size classes: after a
group has entered the tightest bin, that bin stays the tightest for the next group of the size until it is full, and a
whole stretch of groups enters at once. The result is what packing group by group gives. What comes to the driver is a
count for each different size; n bytes hold at most sqrt(2 n) groups of different sizes. Groups take their bins by
their number within the size, ordered by a hash of the text.

``shard_by_capacity`` opens as few bins of a given capacity as the rule needs; ``shard_by_bytes`` searches the least
capacity that a number of bins needs, by bisection.

A group larger than a shard (the given capacity, or an even share of all bytes) can't be kept whole; of such groups each
row is an item of its own. Cases: a null text has no bytes and is equal to other null texts; repeated rows each get a
slot; ties of size are packed alike, in the order of the text's hash; an empty table gives an empty result. The result
has the columns named below only, so that columns of the input can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bytes that each row costs besides its text.
ROW_BYTES = 16
#: Rows numbered by one window.
SLOT_ROWS = 20_000
#: Groups with more than this part of all rows are joined by broadcast; there are fewer than so many.
HOT = 1_000
STEPS = 20

#: Of a size class: (bin, how many of its items enter it), in order.
Runs = list[tuple[int, int]]


@dataclass
class _Node:
    key: tuple[int, int]
    priority: int
    left: "_Node | None" = None
    right: "_Node | None" = None


class BinTree:
    """A treap of bins keyed by (remaining capacity, bin); priorities come from a hash, so that it is reproducible."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    def _split(self, node, key):
        if node is None:
            return None, None
        if node.key < key:
            node.right, more = self._split(node.right, key)
            return node, more
        less, node.left = self._split(node.left, key)
        return less, node

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a.priority > b.priority:
            a.right = self._join(a.right, b)
            return a
        b.left = self._join(a, b.left)
        return b

    def add(self, remaining: int, number: int) -> None:
        priority = (number * 1_000_003 + remaining) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        priority = (priority ^ priority >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        less, more = self._split(self.root, (remaining, number))
        self.root = self._join(self._join(less, _Node((remaining, number), priority)), more)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest bin that holds the size."""
        node, found = self.root, None
        while node is not None:
            if node.key[0] >= size:
                found, node = node, node.left
            else:
                node = node.right
        if found is None:
            return None
        less, rest = self._split(self.root, found.key)
        _, more = self._split(rest, (found.key[0], found.key[1] + 1))
        self.root = self._join(less, more)
        return found.key


def best_fit_decreasing(classes: dict[int, int], capacity: int, at_most: int | None = None) -> dict[int, Runs] | None:
    """The bins that the items of each size enter, in as few bins of this capacity as the rule opens; None if that is
    more than at_most. classes: the number of items of each size. An item over the capacity gets a bin of its own."""
    tree, opened, placed = BinTree(), 0, {}
    for size in sorted(classes, reverse=True):
        left, runs = classes[size], []
        while left:
            bin_ = tree.take(size)
            if bin_ is None:
                if at_most is not None and opened == at_most:
                    return None
                bin_, opened = (max(capacity, size), opened), opened + 1
            n = min(left, bin_[0] // size) if size else left
            runs.append((bin_[1], n))
            tree.add(bin_[0] - n * size, bin_[1])
            left -= n
        placed[size] = runs
    return placed


def pack_into(classes: dict[int, int], bins: int) -> dict[int, Runs]:
    """Bins for items under the least capacity that bisection finds for this number of bins."""
    if not classes:
        return {}
    low = max(-(-sum(s * n for s, n in classes.items()) // bins), max(classes))
    high, best = low, None
    while (best := best_fit_decreasing(classes, high, bins)) is None:
        low, high = high + 1, high + max(1, high // 64)
    for _ in range(STEPS):
        if low >= high:
            break
        mid = (low + high) // 2
        if (found := best_fit_decreasing(classes, mid, bins)) is None:
            low = mid + 1
        else:
            high, best = mid, found
    return best


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    t = F.col(text)
    return materialize(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(t), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(F.coalesce(t, F.lit(""))).alias("crc"),
            F.coalesce(F.md5(t), F.lit("null")).alias("grp"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "shard-rows",
    )


def _numbered(items: DataFrame, by: str, order: str, rows: int) -> DataFrame:
    """Number the rows of each value of a column from 0 without a gap, as ``k``, in parts: the rows of a part by a window
    of its own, after an offset summed from the parts' counts, so that no value lands in one task."""
    parts = max(1, -(-rows // SLOT_ROWS))
    items = items.withColumn("part", F.pmod(F.xxhash64(order), F.lit(parts)).cast("int"))
    counts = items.groupBy(by, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(by, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    in_part = items.withColumn("k", F.row_number().over(Window.partitionBy(by, "part").orderBy(order)))
    return in_part.join(offsets, [by, "part"]).withColumn("k", (F.col("offset") + F.col("k") - 1).cast("long")).drop("part", "offset")


def _taking(items: DataFrame, placed: dict[int, Runs]) -> DataFrame:
    """The shard of numbered items: ``k`` counts through the runs of the item's size."""
    rows = []
    for size, runs in placed.items():
        upto = 0
        ends = []
        for shard, n in runs:
            upto += n
            ends.append((upto, shard))
        rows.append((size, ends))
    # a row for each different size; Spark broadcasts it if it is small
    classes = items.sparkSession.createDataFrame(rows, "item long, runs array<struct<upto: long, shard: int>>")
    run = F.filter("runs", lambda r: r["upto"] > F.col("k"))[0]
    return items.join(classes, "item").withColumn("shard", run["shard"]).drop("runs")


def _place(base: DataFrame, pack, limit: int, rows: int) -> DataFrame:
    """The rows with their shard. pack: runs from classes; groups over the limit go row by row."""
    groups = materialize(base.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.first("size").alias("one")), "shard-groups")
    whole = groups.where(F.col("bytes") <= limit)
    over = groups.where(F.col("bytes") > limit)
    classes = {r["item"]: r["n"] for r in whole.groupBy(F.col("bytes").alias("item")).agg(F.count("*").alias("n")).collect()}
    # the groups over the limit are fewer than the shards
    single = over.groupBy(F.col("one").alias("item")).agg(F.sum("n").alias("n")).collect()
    for r in single:
        classes[r["item"]] = classes.get(r["item"], 0) + r["n"]
    placed = pack(classes)
    # rows of split groups stand behind the whole groups of their size
    apart, behind = {}, {}
    for r in single:
        behind[r["item"]], left = [], r["n"]
        apart[r["item"]] = list(placed[r["item"]])
        while left:
            shard, n = apart[r["item"]].pop()
            take = min(left, n)
            behind[r["item"]].insert(0, (shard, take))
            left -= take
            if n > take:
                apart[r["item"]].append((shard, n - take))
    of_group = materialize(_taking(_numbered(whole.withColumnRenamed("bytes", "item"), "item", "grp", rows), placed | apart).select("grp", "n", "shard"), "shard-of-group")
    hot = F.col("n") * HOT > rows
    marked = base.join(F.broadcast(groups.where(hot | (F.col("bytes") > limit)).select("grp", F.lit(True).alias("hot"), (F.col("bytes") > limit).alias("over"))), "grp", "left")
    placed_hot = marked.where("hot and not over").join(F.broadcast(of_group.where(hot).drop("n")), "grp")
    placed_rest = marked.where("hot is null").join(of_group.where(~hot).drop("n"), "grp")
    split = _taking(_numbered(marked.where("over").withColumn("item", F.col("size")), "item", "uid", rows), behind)
    columns = ["id", "size", "crc", "uid", "shard"]
    return placed_hot.select(columns).union(placed_rest.select(columns)).union(split.select(columns))


def _with_slots(placed: DataFrame, id_col: str, rows: int) -> DataFrame:
    return _numbered(placed, "shard", "uid", rows).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", F.col("k").alias("slot"))


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc id, size, text_crc32, shard and slot (0, 1, ... within a shard) of every row, for a number of shards."""
    base = _rows(docs, id_col, text)
    rows, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return _with_slots(_place(base, lambda classes: pack_into(classes, shards), total // shards, rows), id_col, rows)


def shard_by_capacity(docs: DataFrame, capacity: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The same for as few shards of at most ``capacity`` bytes as the rule opens. A row over it has a shard of its own."""
    base = _rows(docs, id_col, text)
    rows = base.count()
    return _with_slots(_place(base, lambda classes: best_fit_decreasing(classes, capacity), capacity, rows), id_col, rows)
