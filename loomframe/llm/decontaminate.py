"""Benchmark decontamination: items contained in documents, by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set, by powers of two. An item's MinHash sketch is of the bottom-k
kind: the k least hashes of its m shingles, k = m - ceil(t m) + 1. A document that lacks all k contains less than t of
the item, so no item is missed, whatever the length of the document. Each partition has a sketch index of its own. The
number of a document's shingles chooses the partitions that are probed: those whose smallest items it could contain.
Only documents that share a sketched hash with an item of such a partition are verified, on the words themselves.

An item of one to four words is one shingle of all its words, and is sought among the documents' shingles of that many
words; these are made only for the lengths that such items have.

Items are sent to tasks in blocks of bounded size, one block after another, so the benchmark may be of any size. With several
blocks the documents are written once, with a number for each row; a block adds its hits, and all are joined at the end.

Cases: null and empty texts contain nothing, and such items are found nowhere; nor are items of other characters than words.
Repeated rows are each searched, and repeated items each reported; they are sent once, with their number.
Empty tables give empty results. All columns of the documents that are kept pass through; a clash with the added
column is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SHINGLE_WORDS, chunks, materialize, shingle_hashes, word_table

THRESHOLD = 0.8
#: Shingles of the items in one block, about; this bounds what is broadcast.
BLOCK_SHINGLES = 2_000_000
FILTER_BITS = 20
_LOW = np.uint64((1 << FILTER_BITS) - 1)
LEAK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("n_item", T.LongType()), T.StructField("n_shared", T.LongType())])


def least_shared(m: int, threshold: float) -> int:
    return max(1, int(np.ceil(threshold * m - 1e-9)))


def exact_shingles(text: str | None, words: int = SHINGLE_WORDS) -> set[tuple[str, ...]]:
    """The shingles of a text as words."""
    low = (text or "").lower()
    inside = word_table()[np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32)].astype(np.int8)
    edge = np.diff(inside, prepend=0, append=0)
    w = [low[a:z] for a, z in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
    if not w:
        return set()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


class Partition:
    """The sketch index of the items whose numbers of shingles have one power of two."""

    def __init__(self, least: int, sketches: list[tuple[int, np.ndarray]]):
        #: Shingles that a document needs to contain any item of the partition.
        self.least = least
        hashes = np.concatenate([h for _, h in sketches])
        order = np.argsort(hashes, kind="stable")
        self.sketch, self.owner = hashes[order], np.concatenate([np.full(len(h), k) for k, h in sketches])[order]
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[(self.sketch & _LOW).astype(np.int64)] = True

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(places of hashes that the index holds, items of each)."""
        maybe = np.flatnonzero(self.bits[(h & _LOW).astype(np.int64)])
        left = np.searchsorted(self.sketch, h[maybe], "left")
        right = np.searchsorted(self.sketch, h[maybe], "right")
        hit = right > left
        return maybe[hit], [self.owner[x:y] for x, y in zip(left[hit].tolist(), right[hit].tolist(), strict=True)]


class Searcher:
    """A block of items, by size partition."""

    def __init__(self, ids: list, texts: list[str], threshold: float, times: list[int] | None = None):
        self.ids, self.threshold, self.times = ids, threshold, times or [1] * len(ids)
        self.words = [exact_shingles(t) for t in texts]
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        #: by number of words, items that are shorter than a shingle
        self.short: dict[int, dict[tuple[str, ...], list[int]]] = {}
        for k, t in enumerate(texts):
            h = np.unique(shingle_hashes([t])[0])
            if len(h) and len(only := next(iter(self.words[k]))) < SHINGLE_WORDS:
                self.short.setdefault(len(only), {}).setdefault(only, []).append(k)
            elif len(h):
                sketch = h[: len(h) - least_shared(len(h), threshold) + 1]
                by_size.setdefault(len(h).bit_length() - 1, []).append((k, sketch))
        self.partitions = [Partition(least_shared(1 << p, threshold), found) for p, found in sorted(by_size.items())]
        self.short_hashes = {n: np.unique(np.concatenate([shingle_hashes([" ".join(w)], n)[0] for w in held])) for n, held in self.short.items()}

    def search(self, texts: list[str | None]) -> Iterator[list[dict]]:
        for a, z in chunks(texts):
            h, b = shingle_hashes(texts[a:z])
            size = np.diff(b)
            found: dict[int, set[int]] = {}
            for partition in self.partitions:
                large = size >= partition.least
                if not large.any():
                    break  # the partitions that follow need still more shingles
                if large.all():
                    at, items = partition.probe(h)
                else:
                    places = np.flatnonzero(np.repeat(large, size))
                    at, items = partition.probe(h[places])
                    at = places[at]
                for d, own in zip((np.searchsorted(b, at, "right") - 1).tolist(), items, strict=True):
                    found.setdefault(d, set()).update(own.tolist())
            for n, sought in self.short_hashes.items():
                h, b = shingle_hashes(texts[a:z], n)
                for d in set((np.searchsorted(b, np.flatnonzero(np.isin(h, sought)), "right") - 1).tolist()):
                    own = exact_shingles(texts[a + d], n)
                    found.setdefault(d, set()).update(k for w, ks in self.short[n].items() if w in own for k in ks)
            for d in range(z - a):
                yield self.verified(texts[a + d], found[d]) if d in found else []

    def verified(self, text: str, items: set[int]) -> list[dict]:
        own = exact_shingles(text)
        out = []
        for k in sorted(items):
            n = len(self.words[k])
            # a short item's words have been compared already
            shared = 1 if n == 1 and len(next(iter(self.words[k]))) < SHINGLE_WORDS else len(self.words[k] & own)
            if shared >= least_shared(n, self.threshold):
                out += [{"item_id": self.ids[k], "n_item": n, "n_shared": shared}] * self.times[k]
        return out


def annotate(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, out: str = "leaks", block_shingles: int | None = None) -> DataFrame:
    """The kept columns of every document and the items it contains: array<struct<item_id, n_item, n_shared>>."""
    if out.lower() in {c.lower() for c in keep}:
        raise ValueError(f"a column {out} exists already")
    chosen = items.select(F.col(item_id).cast("long").alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).groupBy("id", "text").agg(F.count("*").cast("int").alias("times"))
    length = chosen.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-length // (4 * (block_shingles or BLOCK_SHINGLES))))

    def sent(k: int):
        rows = chosen.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()  # of bounded size
        return docs.sparkSession.sparkContext.broadcast(([r.id for r in rows], [r.text for r in rows], [r.times for r in rows]))

    plain = docs.select(*dict.fromkeys([*keep, text]))
    leaks = lambda fields: T.StructType([*fields, T.StructField(out, T.ArrayType(LEAK))])
    if blocks == 1:
        return plain.mapInArrow(_run(sent(0), threshold, keep, text, out), leaks([docs.schema[c] for c in keep]))
    rows = materialize(plain.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("uid")), "rows")
    hits = []
    for k in range(blocks):
        block = sent(k)
        found = rows.select("uid", "text").mapInArrow(_run(block, threshold, ["uid"], "text", out), leaks([T.StructField("uid", T.LongType())]))
        hits.append(materialize(found.where(F.size(out) > 0), "hits"))
        block.destroy()  # what driver and tasks hold is one block at a time
    own = reduce(DataFrame.union, hits).groupBy("uid").agg(F.flatten(F.collect_list(out)).alias(out))
    none = F.array().cast(T.ArrayType(LEAK))
    joined = rows.drop("text").join(own, "uid", "left")
    return joined.select(*(F.col("kept").getField(c).alias(c) for c in keep), F.coalesce(F.col(out), none).alias(out))


def _run(block, threshold: float, names: list[str], text: str, out: str):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, times = block.value
        searcher = Searcher(ids, texts, threshold, times)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = list(searcher.search(part.column(text).to_pylist()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found, kind)], [*names, out])

    return run


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and each item of which it contains the share of shingles."""
    found = annotate(docs, items, [id_col], threshold=threshold, out="__leaks")
    rows = found.where(F.size("__leaks") > 0).select(id_col, F.explode("__leaks").alias("x"))
    return rows.select(id_col, "x.item_id", "x.n_item", "x.n_shared", (F.col("x.n_shared") / F.col("x.n_item")).alias("containment"))
