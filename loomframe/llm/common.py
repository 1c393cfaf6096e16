"""What several operators share: the shared scratch folder, materialised steps, word and shingle hashes.

Words are maximal runs of letters, marks and numbers (Unicode L, M, N) of the lower-cased text.
A shingle is five consecutive words; a text of one to four words has one shingle, all of its words;
a text without a word has none.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import state_path as scratch_path

SHINGLE_WORDS = 5
#: Texts are hashed in runs of about so many characters; a longer text is a run of its own.
CHUNK_CHARS = 1_000_000

_U = np.uint64
_word_table: np.ndarray | None = None


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a step to the shared folder and read it again: it is computed once and its lineage ends here. by: a column whose
    values are folders, so that a filter on it reads no other rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._loomframe_path = path
    return table


def sized(df: DataFrame, rows: int, each: int) -> DataFrame:
    """In as many tasks as so many rows need, or fewer: shuffles of small steps leave partitions that hold next to nothing,
    and a Python worker and a file for each of them take longer than their rows."""
    return df.coalesce(max(1, -(-rows // each)))


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input and isn't sent to all tasks, however small it looks: a broadcast passes it
    whole through the driver, and what a small input broadcasts a larger one shuffles, so that its disk can't be foreseen."""
    return df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote, once what was read from them is written itself."""
    for table in tables:
        session = table.sparkSession
        place = session._jvm.org.apache.hadoop.fs.Path(table._loomframe_path)
        place.getFileSystem(session._jsc.hadoopConfiguration()).delete(place, True)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def word_table() -> np.ndarray:
    """True at each code point that belongs to a word."""
    global _word_table
    if _word_table is None:
        _word_table = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)), bool, 0x110000)
    return _word_table


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(salt))


_powers = np.cumprod(np.full(256, 0x5851F42D4C957F2D, dtype=_U))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.full(2 * n, 0x5851F42D4C957F2D, dtype=_U))
    return _powers


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about CHUNK_CHARS characters each."""
    begin = size = 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > CHUNK_CHARS:
            yield begin, k
            begin, size = k, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in order, bounds: words of text i are bounds[i]:bounds[i+1])."""
    low = [(t or "").lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in low])
    points = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "replace"), np.uint32)
    inside = word_table()[points]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.concatenate([[0], np.searchsorted(start, ends)])
    if not len(start):
        return np.empty(0, _U), bounds
    length = stop - start
    at = np.flatnonzero(inside)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(len(at)) - np.repeat(first, length)
    h = mix64(points[at].astype(_U) + _U(0x1234567)) * powers(int(length.max()))[place]
    return mix64(np.add.reduceat(h, first) + length.astype(_U)), bounds


def shingle_hashes(texts: list[str | None], words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit fingerprint of each shingle in order, bounds by text). Repeated shingles repeat."""
    w, b = word_hashes(texts)
    n = np.diff(b)
    keys = seeds(words, 77)
    counts = np.where(n >= words, n - words + 1, (n > 0).astype(n.dtype))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(bounds[-1]), _U)
    if len(w) >= words:
        every = np.zeros(len(w) - words + 1, _U)
        for k in range(words):
            every += w[k : k + len(every)] * keys[k]
        full = n >= words
        take = np.repeat(b[:-1][full] - bounds[:-1][full], counts[full]) + _rows(bounds, full, counts)
        out[_rows(bounds, full, counts)] = mix64(every[take])
    for i in np.flatnonzero((n > 0) & (n < words)):
        part = w[b[i] : b[i + 1]]
        out[bounds[i]] = mix64((part * keys[: len(part)]).sum(keepdims=True) + _U(len(part)))[0]
    return out, bounds


def _rows(bounds: np.ndarray, chosen: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of all entries of the chosen texts."""
    c = counts[chosen]
    if not len(c):
        return np.empty(0, np.int64)
    return np.repeat(bounds[:-1][chosen] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))


def shingle_sets(texts: list[str | None], words: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text."""
    for a, z in chunks(texts):
        h, b = shingle_hashes(texts[a:z], words)
        for i in range(z - a):
            yield np.unique(h[b[i] : b[i + 1]])


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of rows of a partition that is sorted by the keys; one group at a time is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for p, q in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[p] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(p, q - p))
    if held:
        yield pa.Table.from_batches(held)
