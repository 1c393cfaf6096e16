"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all
its segmentations into pieces of the product of their probabilities, got by the forward algorithm; a text's is the
product over its words. The probabilities come from expectation maximisation over the words of a bounded sample of
labelled texts; expected uses of pieces are summed by Spark, so that the driver sees a number for each piece and
language only. Words are runs of letters of the lower-cased text, of any length.

Cases: a null text, and one without a letter, is ``und`` with score 0; without any language to learn every text is
``und``. Texts are read whole. Equal likelihoods go to the language that sorts first; repeated rows get equal results; an
empty table gives an empty result. Letters outside the vocabulary cost the same in every language. Columns that are kept
pass through; a clash with the added names is an error.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

UNKNOWN = "und"
#: The fit's sample: labelled texts of each language at most, in expectation; different texts, one at least.
SAMPLE_PER_LANGUAGE = 400
#: Words of more letters are taken one by one, with a band of the passes, so that places times words stay few.
LONGEST_TOGETHER = 64
#: Places after which sums are scaled: with the longest piece before them they stay far from the least number.
SCALED_EVERY = 16
#: Places of the words that are held together.
CELLS = 128_000
ROUNDS = 4
SMOOTHING = 0.05
#: The probability of a letter that no piece covers.
STRAY = 1e-8
#: Words whose likelihoods a worker keeps; a full cache is emptied. This bounds memory only.
CACHE_WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")
_MARK = "▁"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def vocabulary(model_path: str) -> list[str]:
    """The pieces of a sentencepiece model, lower-cased, in order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return list(dict.fromkeys(p for p in pieces if p))


_K = np.uint64(0x9E3779B97F4A7C15)


def _codes(words: list[str], width: int) -> np.ndarray:
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(words), width).astype(np.uint64) + np.uint64(1)


class PieceIndex:
    """Pieces by a 64-bit hash of their letters."""

    def __init__(self, pieces: list[str]):
        self.stray, self.none = len(pieces), len(pieces) + 1
        h = np.zeros(len(pieces), np.uint64)
        length = np.array([len(x) for x in pieces], np.int64)
        codes = _codes(pieces, int(length.max(initial=0)))
        #: Pieces of other characters than letters can't be part of a word, however long they are.
        self.longest = max((len(x) for x in pieces if x.removeprefix(_MARK).isalpha()), default=1)
        for k in range(codes.shape[1]):
            h = np.where(length > k, (h + codes[:, k]) * _K, h)
        self.order = np.argsort(h)
        self.hashes = np.append(h[self.order], np.uint64(2**64 - 1))
        self.ids = np.append(self.order, self.none).astype(np.int32)
        self.bits = np.zeros(1 << 18, bool)
        self.bits[(self.hashes >> np.uint64(46)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.none, np.int32)
        maybe = np.flatnonzero(self.bits[(h >> np.uint64(46)).astype(np.int64)])
        at = np.searchsorted(self.hashes, h[maybe])
        hit = self.hashes[at] == h[maybe]
        out[maybe[hit]] = self.ids[at[hit]]
        return out


class Lattice:
    """All ways to cover words by pieces. Words are held from long to short, so that those with a place are a prefix."""

    def __init__(self, words: list[str], index: PieceIndex):
        marked = [_MARK + w for w in words]
        self.order = np.array(sorted(range(len(words)), key=lambda k: -len(marked[k])), np.int64)
        marked = [marked[k] for k in self.order]
        length = np.array([len(w) for w in marked], np.int64)
        self.width, self.last, self.longest = int(length.max(initial=0)), length, index.longest
        codes = _codes(marked, self.width) if words else np.zeros((0, 0), np.uint64)
        #: how many words have at least so many letters
        self.alive = [int(np.searchsorted(-length, -n, "right")) for n in range(self.width + 1)]
        self.piece: dict[tuple[int, int], np.ndarray] = {}  # by (start, end)
        for a in range(self.width):
            h = np.zeros(len(words), np.uint64)
            for z in range(a + 1, min(self.width, a + self.longest) + 1):
                n = self.alive[z]
                if not n:
                    break
                h = (h[:n] + codes[:n, z - 1]) * _K
                found = index.find(h)
                if a > 0 and z == a + 1 or a == 0 and z == 2:
                    found[found == index.none] = index.stray
                if (found != index.none).any():
                    self.piece[a, z] = found

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum over the segmentations of each prefix, and the logarithm of its scale): places by words by languages.
        p: pieces by languages, and a row each for a stray letter and for no piece."""
        alpha = np.zeros((self.width + 1, len(self.order), p.shape[1]))
        logs, scale = np.zeros_like(alpha), np.zeros(alpha.shape[1:])
        alpha[0] = 1
        for z in range(1, self.width + 1):
            n = self.alive[z]
            for a in range(max(0, z - self.longest), z):
                if (a, z) in self.piece:
                    alpha[z, :n] += alpha[a, :n] * p[self.piece[a, z]]
            first = z
            if z % SCALED_EVERY == 0:
                # places that later ones reach back to go into the new scale
                first, by = max(0, z + 1 - self.longest), alpha[z, :n].copy()
                alpha[first : z + 1, :n] /= by
                scale[:n] += np.log(by)
            logs[first : z + 1, :n] = scale[:n]
        return alpha, logs

    def log_likelihood(self, p: np.ndarray) -> np.ndarray:
        out, every = np.empty((len(self.order), p.shape[1])), np.arange(len(self.order))
        alpha, logs = self.forward(p)
        out[self.order] = np.log(alpha[self.last, every]) + logs[self.last, every]
        return out

    def expected(self, p: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by language; times: occurrences of words by language."""
        (alpha, logs), every = self.forward(p), np.arange(len(self.order))
        beta = np.zeros_like(alpha)  # in the inverse scale of alpha's
        beta[self.last, every] = times[self.order] / alpha[self.last, every]
        out = np.zeros_like(p)
        for z in range(self.width, 0, -1):
            n = self.alive[z]
            for a in range(max(0, z - self.longest), z):
                if (a, z) in self.piece:
                    part = beta[z, :n] * p[self.piece[a, z]]
                    apart = logs[a, :n] - logs[z, :n]
                    if apart.any():
                        part *= np.exp(apart)
                    beta[a, :n] += part
                    part *= alpha[a, :n]
                    for k in range(p.shape[1]):
                        out[:, k] += np.bincount(self.piece[a, z], part[:, k], minlength=len(p))
        return out


def banded(words: list[str]) -> Iterator[list[str]]:
    """Words by length, in groups of few places; a word of more than LONGEST_TOGETHER letters is a group of its own."""
    group: list[str] = []
    for w in sorted(words, key=lambda w: (len(w), w)):
        if group and (len(w) > LONGEST_TOGETHER or (len(w) + 2) * (len(group) + 1) > CELLS):
            yield group
            group = []
        group.append(w)
    if group:
        yield group


def _long_pieces(word: str, index: PieceIndex, step: int) -> Iterator[np.ndarray]:
    """For each place of a long word the pieces that end there, by length."""
    marked = _MARK + word
    size, wide = len(marked), index.longest
    codes = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    for begin in range(0, size, step):
        ends = np.arange(begin + 1, min(size, begin + step) + 1)
        pieces = np.full((len(ends), wide), index.none, np.int32)
        for n in range(1, wide + 1):
            at = ends >= n
            h = np.zeros(int(at.sum()), np.uint64)
            for k in range(n):
                h = (h + codes[ends[at] - n + k]) * _K
            found = index.find(h)
            stray = (ends[at] > n) if n == 1 else (ends[at] == n) & (n == 2)
            found[stray & (found == index.none)] = index.stray
            pieces[at, n - 1] = found
        yield pieces


def _long_forward(word: str, index: PieceIndex, p: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each place its pieces and what the sum over the segmentations grows by, in a band of the last places. The sum at the
    mark alone may be nothing: it counts as the place before it, where only pieces from the word's start end."""
    band = np.zeros((index.longest, p.shape[1]))  # the places before, the last one first
    band[0] = 1
    for pieces in _long_pieces(word, index, step):
        for row in pieces:
            alpha = (band * p[row]).sum(0)
            ahead = np.where(alpha > 0, alpha, 1.0)
            yield row, ahead
            band[1:] = band[:-1] / ahead
            band[0] = alpha > 0


def long_log_likelihood(word: str, index: PieceIndex, p: np.ndarray, step: int = 4096) -> np.ndarray:
    """The same for one long word by language: only the last places of the forward pass are held, scaled as it goes."""
    return sum((np.log(c) for _, c in _long_forward(word, index, p, step)), np.zeros(p.shape[1]))


def long_expected(word: str, index: PieceIndex, p: np.ndarray, times: np.ndarray, step: int = 4096) -> np.ndarray:
    """Expected uses of each piece in one long word by language; times: its occurrences by language. The way back needs each
    place's growth, and the chance that a segmentation has a boundary there, in a band of places."""
    rows, growth = zip(*((row, c) for row, c in _long_forward(word, index, p, step)), strict=True)
    growth, wide, size = np.array(growth), index.longest, len(rows)
    out = np.zeros_like(p)
    chance = np.zeros((size + 1, p.shape[1]))
    chance[size] = times
    dead = p[rows[0][0]] == 0  # nothing ends at the mark alone
    for z in range(size, 0, -1):
        n = min(wide, z)
        # the sums of the places before z, nearest first, over that of the nearest
        before = np.concatenate([np.ones((1, p.shape[1])), 1 / np.cumprod(growth[z - n : z - 1][::-1], 0)])
        if 2 <= z < n + 2:
            before[z - 2, dead] = 0
        part = before * p[rows[z - 1][:n]] / growth[z - 1]
        part *= chance[z]
        for k in range(p.shape[1]):
            out[:, k] += np.bincount(rows[z - 1][:n], part[:, k], minlength=len(p))
        chance[z - n : z] += part[::-1]
    return out


_indexes: dict[int, PieceIndex] = {}


def shared_index(pieces: list[str]) -> PieceIndex:
    """The index of a vocabulary, built once a worker."""
    key = hash(tuple(pieces))
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = PieceIndex(pieces)
    return _indexes[key]


class Model:
    """Languages, pieces, and the probabilities of pieces (and of a stray letter) by language."""

    def __init__(self, languages: list[str], pieces: list[str], p: np.ndarray):
        self.languages, self.pieces, self.p = languages, pieces, p
        self.index: PieceIndex | None = None
        self.clear()

    def clear(self) -> None:
        self.cache: dict[str, int] = {}
        self.table = np.zeros((0, len(self.languages)))

    def learn(self, words: set[str]) -> None:
        """Put the likelihoods of new words into the cache."""
        self.index = self.index or shared_index(self.pieces)
        fresh = sorted(words - self.cache.keys())
        if len(self.cache) + len(fresh) > CACHE_WORDS:
            self.clear()
            fresh = sorted(words)
        tables = [self.table]
        for part in banded(fresh):
            tables.append(Lattice(part, self.index).log_likelihood(self.p))
            for w in part:
                self.cache[w] = len(self.cache)
        self.table = np.concatenate(tables)

    def scores(self, words: list[str]) -> np.ndarray:
        """The log-likelihood of some words by language."""
        short = np.fromiter((self.cache[w] for w in words if len(w) <= LONGEST_TOGETHER), np.int64)
        total = self.table[short].sum(0)
        for w in words:
            if len(w) > LONGEST_TOGETHER:
                total = total + long_log_likelihood(w, self.index, self.p)
        return total

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        if not self.languages:
            yield from ((UNKNOWN, 0.0) for _ in texts)
            return
        split = [words_of(t) for t in texts]
        self.learn({w for words in split for w in words if len(w) <= LONGEST_TOGETHER})
        for words in split:
            # superscripts and the like count as word characters, but are no letters
            if not any(c.isalpha() for w in words for c in w):
                yield UNKNOWN, 0.0
                continue
            score = self.scores(words)
            best = int(score.argmax())
            yield self.languages[best], float(1 / np.exp(score - score[best]).sum())


def expected_uses(words: DataFrame, languages: list[str], pieces: list[str], p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by language over all rows (lang, word, n)."""
    sent = words.sparkSession.sparkContext.broadcast((languages, pieces, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, pieces, p = sent.value
        index, place = shared_index(pieces), {k: i for i, k in enumerate(languages)}
        use = np.zeros_like(p)
        for batch in batches:
            times: dict[str, np.ndarray] = {}
            for lang, w, n in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                times.setdefault(w, np.zeros(len(languages)))[place[lang]] += n
            for part in banded(list(times)):
                if len(part[0]) > LONGEST_TOGETHER:
                    use += long_expected(part[0], index, p, times[part[0]])
                else:
                    use += Lattice(part, index).expected(p, np.array([times[w] for w in part]))
        piece, lang = np.nonzero(use[:-2])
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(use[piece, lang], pa.float64())], ["piece", "lang", "uses"])

    out = np.zeros_like(p)
    # sums in whole millionths, so that the order in which tasks end makes no difference; a row for each piece and language at most
    sums = words.mapInArrow(run, "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum(F.round(F.col("uses") * 1e6).cast("decimal(38,0)")).alias("uses"))
    for r in sums.collect():
        out[r["piece"], r["lang"]] = float(r["uses"]) / 1e6
    sent.destroy()
    return out


def fit_words(words: DataFrame, languages: list[str], pieces: list[str]) -> Model:
    """Fit on rows (lang, word, n)."""
    p = np.full((len(pieces) + 2, len(languages)), 1.0 / max(1, len(pieces)))
    p[-2:] = [[STRAY], [0.0]]
    for _ in range(ROUNDS if languages else 0):
        use = expected_uses(words, languages, pieces, p)[:-2] + SMOOTHING
        p[:-2] = use / use.sum(0)
    return Model(languages, pieces, p)


def fit(docs: DataFrame, model_path: str, lang: str = "lang", text: str = "text", sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on a sample of the labelled texts, drawn by a hash of the text among different texts, one of each language at
    least. A text that repeats is learnt once a language, however many rows have it."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.md5(text).alias("key"))
    # two numbers and a digest for each language
    sizes = known.groupBy("lang", "key").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("n"), F.min("key").alias("least")).collect()
    parts, drawn = 1 << 24, F.lit(False)
    for r in sorted(sizes, key=lambda r: r["lang"]):
        share = int(parts * min(1.0, sample / r["n"]))
        drawn = F.when(F.col("lang") == r["lang"], (F.pmod(F.xxhash64("key"), F.lit(parts)) < share) | (F.col("key") == r["least"])).otherwise(drawn)
    chosen = known.where(drawn).groupBy("lang", "key").agg(F.first("text").alias("text")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for k, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts.update((k, w) for w in words_of(t))
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.string()), pa.array([counts[x] for x in keys], pa.int64())], ["lang", "word", "n"])

    counted = chosen.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # a few thousand words, but each is much work: all cores take part in every round
    words = materialize(counted.repartition(docs.sparkSession.sparkContext.defaultParallelism, "word"), "words")
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    return fit_words(words, languages, vocabulary(model_path))


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, lang_pred and score."""
    names = ["lang_pred", "score"]
    if clash := {c.lower() for c in keep} & set(names):
        raise ValueError(f"columns {sorted(clash)} exist already")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                langs, scores = zip(*own.predict(part.column(text).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, *names])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
