"""Byte-level BPE encoding and decoding over a given rank file.

Pre-tokenisation without regular expressions: every code point has a class, every class is a function on the eight
states of the splitter, and the functions compose. The compositions form a small monoid, built once with its
multiplication table; a blocked prefix scan over monoid elements gives the state before each character, and with it the
places where a pre-token begins. The byte slices between those places are merged by rank, many slices a round over a
table of pairs of ids; merged slices are cached.

Cases: a null text is the empty text, with no token. Any length is handled: texts are scanned in runs of bounded
size, and a slice is merged with a heap once it is long. Repeated rows give repeated results; an empty table gives an
empty table; columns of the input other than the text pass through.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks

LETTER, NUMBER, OTHER, QUOTE, QUOTE2, QUOTE3, SPACE, BLANK = range(8)
FRESH, IN_LETTER, IN_NUMBER, IN_OTHER, AFTER_SPACE, AFTER_BLANK, ONE_LEFT, TWO_LEFT = range(8)
#: The white space of the split pattern, and the endings that follow an apostrophe.
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Merged slices kept by a Python worker in each of two generations: a full one becomes the old one, and what is used of
#: the old one becomes young again. This bounds memory only.
CACHE_SLICES = 150_000
#: Slices merged together, and bytes of a slice from which it is merged alone.
ROUND_SLICES, LONGEST_ROW = 8_192, 64
#: No token.
NEVER = (1 << 31) - 1
BLOCK = 256
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def class_table() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE)] = BLANK
    table[32] = SPACE
    table[ord("'")] = QUOTE
    return table


def step(state: int, symbol: int) -> int:
    """The state after a character of this class."""
    if symbol == SPACE:
        return AFTER_SPACE
    if symbol == BLANK:
        return AFTER_BLANK
    if state == TWO_LEFT:
        return ONE_LEFT
    if state == ONE_LEFT:
        return FRESH
    if symbol in (QUOTE2, QUOTE3) and state not in (IN_OTHER, AFTER_SPACE):
        return ONE_LEFT if symbol == QUOTE2 else TWO_LEFT
    return {LETTER: IN_LETTER, NUMBER: IN_NUMBER}.get(symbol, IN_OTHER)


def begins(state: int, symbol: int, last_blank: bool) -> bool:
    """Whether a pre-token begins at a character; last_blank: it is white space before a visible character."""
    if symbol in (SPACE, BLANK):
        return last_blank or state not in (AFTER_SPACE, AFTER_BLANK)
    inside = {LETTER: IN_LETTER, NUMBER: IN_NUMBER}.get(symbol, IN_OTHER)
    return state not in (inside, AFTER_SPACE, ONE_LEFT, TWO_LEFT)


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each symbol, and of each symbol at a text's start as symbol + 8; multiplication; state reached from
    FRESH by each element; whether a pre-token begins by state, symbol and last_blank)."""
    gens = [tuple(step(s, x) for s in range(8)) for x in range(8)]
    gens += [(g[FRESH],) * 8 for g in gens]
    elements = {tuple(range(8)): 0}
    todo = list(elements)
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[s] for s in f)
            if h not in elements:
                elements[h] = len(elements)
                todo.append(h)
    table = sorted(elements, key=elements.get)
    product = np.array([[elements[tuple(g[s] for s in f)] for g in table] for f in table], np.uint16)
    starts = np.array([[[begins(s, x, bool(k)) for k in (0, 1)] for x in range(8)] for s in range(8)])
    return np.array([elements[g] for g in gens], np.uint16), product, np.array([f[FRESH] for f in table], np.uint8), starts


def scan(e: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Inclusive prefix products, by blocks: within blocks, over the blocks' products, and both together."""
    size, flat = len(product), product.ravel()
    n = len(e)
    if n <= BLOCK:
        out, at = np.empty_like(e), 0
        for i, x in enumerate(e.tolist()):
            out[i] = at = int(flat[at * size + x])
        return out
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.int32)
    grid[:n] = e
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    for i in range(1, BLOCK):
        grid[i] = flat[grid[i - 1] * size + grid[i]]
    before = np.zeros(rows, np.int32)
    before[1:] = scan(grid[-1].astype(np.uint16), product)[:-1]
    return flat[(before * size)[None, :] + grid].T.reshape(-1)[:n]


def pretoken_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True at each code point where a pre-token begins; first: True at the start of each text."""
    symbol = class_table()[points]
    n = len(points)
    begin = np.zeros(n + 3, bool)
    begin[:n] = first
    begin[n] = True
    for ending in ENDINGS:
        hit = symbol == QUOTE if len(ending) == 1 else (symbol == QUOTE)
        for k, c in enumerate(ending, 1):
            ahead = np.zeros(n, bool)
            ahead[: n - k] = (points[k:] == ord(c)) & ~begin[k:n]
            hit = hit & ahead
        symbol = np.where(hit, np.uint8(QUOTE2 if len(ending) == 1 else QUOTE3), symbol)
    blank = symbol >= SPACE
    last = np.zeros(n, bool)
    last[: n - 1] = blank[:-1] & ~blank[1:] & ~begin[1:n]
    element, product, reached, table = monoid()
    prefix = scan(element[symbol + np.uint8(8) * first], product)
    state = np.empty(n, np.uint8)
    state[0] = FRESH
    state[1:] = reached[prefix[:-1]]
    state[first] = FRESH
    return table[state, symbol, last.astype(np.uint8)]


class Vocabulary:
    """The ranks of a file, and its tokens as one buffer for decoding."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f.read().splitlines() if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        by_id = {i: t for t, i in self.ranks.items()}
        size = max(by_id) + 1
        self.lengths = np.array([len(by_id.get(i, b"")) for i in range(size)], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8)
        self.packed = {t: i.to_bytes(4, "little") for t, i in self.ranks.items()}
        self.singles = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self._index_pairs()
        #: Slices seen lately and before that, with their ids.
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _index_pairs(self) -> None:
        """A table of all (left id, right id) that make a token, with open addressing."""
        get, pairs = self.ranks.get, {}
        for token, i in self.ranks.items():
            for k in range(1, len(token)):
                a, b = get(token[:k]), get(token[k:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = i
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.ids = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        key, value = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        at = ((key.view(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)
        while len(key):
            free = np.flatnonzero(self.keys[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.ids[at[put]] = key[put], value[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, value, at = key[rest], value[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token as little-endian 32-bit integers. Slices of like length are merged together, one
        merge of each a round; long ones with a heap."""
        out = [self.packed.get(p) for p in pieces]
        todo = sorted((len(p), k) for k, p in enumerate(pieces) if out[k] is None)
        for at in range(0, len(todo), ROUND_SLICES):
            rows = [k for n, k in todo[at : at + ROUND_SLICES] if n <= LONGEST_ROW]
            for k, ids in zip(rows, self._rounds([pieces[k] for k in rows]) if rows else (), strict=True):
                out[k] = ids
            for n, k in todo[at : at + ROUND_SLICES]:
                if n > LONGEST_ROW:
                    out[k] = np.array(self._heap(pieces[k]), "<u4").tobytes()
        return out

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of the token that two ids make, NEVER where there is none."""
        key = (left.astype(np.int64) << 32) | right
        at = ((key.view(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)
        out = np.full(key.shape, NEVER, np.int64)
        open_ = np.flatnonzero(self.keys[at.ravel()] != -1)
        key, at, flat = key.ravel()[open_], at.ravel()[open_], out.ravel()
        while len(open_):
            found = self.keys[at] == key
            flat[open_[found]] = self.ids[at[found]]
            at = (at + 1) & (len(self.keys) - 1)
            more = ~found & (self.keys[at] != -1)
            open_, key, at = open_[more], key[more], at[more]
        return flat.reshape(out.shape)

    def _rounds(self, pieces: list[bytes]) -> list[bytes]:
        length = np.array([len(p) for p in pieces], np.int64)
        wide = int(length.max())
        raw = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in pieces), np.uint8).reshape(len(pieces), wide)
        ids = np.where(np.arange(wide) < length[:, None], self.singles[raw], NEVER)
        final, live = np.full(ids.shape, NEVER, np.int64), np.arange(len(pieces))
        rank = self.joined(ids[:, :-1], ids[:, 1:])
        while len(live):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(live), np.int64)
            best = rank[np.arange(len(live)), at] if rank.shape[1] else np.full(len(live), NEVER)
            ended = best == NEVER
            if ended.any():
                final[live[ended], : ids.shape[1]] = ids[ended]
                live, ids, rank, at, best = (x[~ended] for x in (live, ids, rank, at, best))
                if not len(live):
                    break
            # each row loses its place at + 1, so all rows get narrower by one
            row, place = np.arange(len(live)), np.arange(ids.shape[1] - 1)
            after = (place[None, :] > at[:, None]).astype(np.int64)
            ids = np.take_along_axis(ids, place + after, 1)
            ids[row, at] = best
            place = place[:-1]
            rank = np.take_along_axis(rank, place + (place >= at[:, None]), 1)
            some = np.flatnonzero(at > 0)
            rank[some, at[some] - 1] = self.joined(ids[some, at[some] - 1], best[some])
            some = np.flatnonzero(at < rank.shape[1])
            rank[some, at[some]] = self.joined(best[some], ids[some, at[some] + 1])
        kept = final != NEVER
        data, cut = final[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
        return [data[p:q] for p, q in zip([0, *cut], cut, strict=False)]

    def _heap(self, piece: bytes) -> list[int]:
        n, get = len(piece), self.ranks.get
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, end = heapq.heappop(heap)
            if not live[i] or stop[i] != mid or mid >= n or stop[mid] != end:
                continue
            live[mid] = False
            stop[i] = end
            if end < n:
                before[end] = i
                if (r := get(piece[i : stop[end]])) is not None:
                    heapq.heappush(heap, (r, i, end, stop[end]))
            if (p := before[i]) >= 0 and (r := get(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, i, end))
        return [self.ranks[piece[i : stop[i]]] for i in range(n) if live[i]]

    def lookup(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each slice; slices that neither generation of the cache holds are merged, each once."""
        found = list(map(self.young.get, pieces))
        fresh = [k for k, ids in enumerate(found) if ids is None]
        if fresh:
            missing = list(dict.fromkeys(pieces[k] for k in fresh))
            known = dict(zip(missing, map(self.old.get, missing), strict=True))
            unknown = [p for p, ids in known.items() if ids is None]
            known.update(zip(unknown, self.merge(unknown), strict=True))
            for k in fresh:
                found[k] = known[pieces[k]]
            if len(self.young) + len(known) > CACHE_SLICES:
                self.old, self.young = self.young, {}
            if len(known) <= CACHE_SLICES:
                self.young.update((p, ids) for p, ids in known.items() if len(p) <= LONGEST_ROW)
        return found

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The packed ids of each text."""
        for a, z in chunks(texts):
            run = [t or "" for t in texts[a:z]]
            sizes = np.array([len(t) for t in run], np.int64)
            joined = "".join(run)
            if not joined:
                yield from [b""] * (z - a)
                continue
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            first = np.zeros(len(points), bool)
            opening = (np.cumsum(sizes) - sizes)[sizes > 0]
            first[opening] = True
            at = np.flatnonzero(pretoken_starts(points, first))
            width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
            byte = np.concatenate([[0], np.cumsum(width)])
            cut = np.append(byte[at], byte[-1]).tolist()
            data = joined.encode()
            packed = self.lookup([data[p:q] for p, q in zip(cut, cut[1:], strict=False)])
            owner = np.concatenate([[0], np.searchsorted(at, np.cumsum(sizes))]).tolist()
            for p, q in zip(owner, owner[1:], strict=False):
                yield b"".join(packed[p:q])

    def starts(self, ids: bytes) -> bytes:
        """The byte offset of each token in the text."""
        n = self.lengths[np.frombuffer(ids, "<u4")]
        return (np.cumsum(n) - n).astype("<u4").tobytes()

    def decode(self, ids: bytes, starts: bytes) -> bytes:
        """The tokens' bytes, each put at its retained offset."""
        t, at = np.frombuffer(ids, "<u4").astype(np.int64), np.frombuffer(starts, "<u4").astype(np.int64)
        if not len(t):
            return b""
        n = self.lengths[t]
        return self.bytes[np.arange(int(at[-1] + n[-1])) + np.repeat(self.offsets[t] - at, n)].tobytes()


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, vocab_path: str, text: str = "text", prefix: str = "") -> DataFrame:
    """Replace the text column by n_tokens, token_ids (packed little-endian unsigned 32-bit) and token_starts (byte
    offsets, packed likewise). Give a prefix if the input has columns of these names."""
    kept = [f for f in docs.schema.fields if f.name != text]
    names = [f"{prefix}{x}" for x in ("n_tokens", "token_ids", "token_starts")]
    _no_clash(kept, names)
    schema = T.StructType([*kept, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.BinaryType()), T.StructField(names[2], T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab_path)
        for batch in batches:
            for part in bounded(batch):
                ids = list(v.encode(part.column(text).to_pylist()))
                new = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([v.starts(x) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *new], [*(f.name for f in kept), *names])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocab_path: str, prefix: str = "", out: str = "decoded") -> DataFrame:
    """Add the decoded bytes of token_ids; token_starts is dropped."""
    ids, starts = f"{prefix}token_ids", f"{prefix}token_starts"
    kept = [f for f in encoded.schema.fields if f.name != starts]
    _no_clash(kept, [out])
    schema = T.StructType([*kept, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab_path)
        for batch in batches:
            back = [v.decode(a or b"", b or b"") for a, b in zip(batch.column(ids).to_pylist(), batch.column(starts).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(back, pa.binary())], [*(f.name for f in kept), out])

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocab_path: str, text: str = "text") -> DataFrame:
    """Replace the text column by n_tokens, token_ids and the bytes that the ids decode to, in one pass."""
    kept = [f for f in docs.schema.fields if f.name != text]
    names = ["n_tokens", "token_ids", "decoded"]
    _no_clash(kept, names)
    schema = T.StructType([*kept, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.BinaryType()), T.StructField(names[2], T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab_path)
        for batch in batches:
            for part in bounded(batch):
                ids = list(v.encode(part.column(text).to_pylist()))
                new = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([v.decode(x, v.starts(x)) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *new], [*(f.name for f in kept), *names])

    return docs.mapInArrow(run, schema)


def bounded(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Slices that keep what is in flight small."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def _no_clash(kept: list, names: list[str]) -> None:
    if clash := {f.name.lower() for f in kept} & {n.lower() for n in names}:
        raise ValueError(f"columns {sorted(clash)} exist already; choose another prefix")
