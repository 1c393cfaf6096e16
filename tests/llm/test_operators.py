"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, by brute force."""

import base64
import hashlib
import io
import json
import math
import random
import re
import struct
import time
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomframe.llm import bpe, decontaminate, graph, langid, near_dup, pii, secrets, sharding, toxicity, vectors, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCAB = bpe.Vocabulary(RANKS)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCAB.ranks, special_tokens={})
ALPHABET = ["'", "s", "t", "r", "e", "v", "l", "m", "d", " ", "  ", "\n", "a", "1", "!", "é", " ", "　", "²", "李", "🙂", "́", "'s", "'re", "\x1c"]
ODD = [(1, None), (2, ""), (3, "same words over and over again here"), (3, "same words over and over again here"), (4, "x" * 3000 + " " + "y z " * 2000), (None, "no id at all but words"), (6, "!!! ...")]


def odd(spark):
    return spark.createDataFrame([(i, t, "en", "clash") for i, t in ODD], "doc_id long, text string, lang string, score string")


# --- 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=14).map("".join))
def test_bpe_as_the_library(text):
    ids = next(VOCAB.encode([text]))
    assert np.frombuffer(ids, "<u4").tolist() == REFERENCE.encode_ordinary(text)
    assert VOCAB.decode(ids, VOCAB.starts(ids)) == text.encode()


@pytest.mark.parametrize("text", [" " * 5000, "a" * 3000, "x" * 100 + "!" * 400 + "'" * 50])
def test_bpe_long_slices(text):
    assert np.frombuffer(next(VOCAB.encode([text])), "<u4").tolist() == REFERENCE.encode_ordinary(text)


def test_bpe_every_code_point():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(chr(c) for c in points[k : k + 4096]) for k in range(0, len(points), 4096)] + ["a".join(chr(c) for c in points[k : k + 4096]) for k in range(0, 65536, 4096)]
    for text, ids in zip(texts, VOCAB.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == REFERENCE.encode_ordinary(text)


def test_bpe_cache_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_SLICES", 50)
    vocab, rng = bpe.Vocabulary(RANKS), random.Random(9)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("abcxyzé") for _ in range(rng.randint(1, 80))) for _ in range(rng.randint(0, 30))) for _ in range(4)]
        assert [np.frombuffer(x, "<u4").tolist() for x in vocab.encode(texts)] == [REFERENCE.encode_ordinary(t) for t in texts]
        assert len(vocab.young) <= 50 + 120


def test_bpe_scan_is_associative():
    element, product, _, _ = bpe.monoid()
    e = element[np.random.default_rng(1).integers(0, 16, 1000)]
    at, want = 0, []
    for x in e.tolist():
        at = int(product[at, x])
        want.append(at)
    assert bpe.scan(e, product).tolist() == want


def test_bpe_frames(spark):
    docs = odd(spark)
    rows = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    assert sorted(bytes(r.decoded) for r in rows) == sorted((t or "").encode() for _, t in ODD)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert sorted(bytes(r.token_ids) for r in rows) == sorted(bytes(r.token_ids) for r in bpe.round_trip(docs, RANKS).collect())
    assert bpe.encode(docs.limit(0), RANKS).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumn("n_tokens", F.lit(1)), RANKS)


# --- 2


def test_toxicity_learns_and_swaps():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    rows, swapped = [], []
    for _ in range(1500):
        y = int(rng.random() < 0.2)
        text = " ".join(rng.sample(words, 12)) + (" idiot" if y else "")
        # a group is mentioned far more often in toxic texts
        if rng.random() < (0.6 if y else 0.05):
            text += " muslims"
        rows.append((y, sorted(toxicity.features(text))))
        swapped += [(sorted(a), sorted(b), 1) for a, b in toxicity.text_swaps(text, toxicity.groups_of("en"))]
    terms = sorted({f for _, names in rows for f in names})
    plain, regular = (toxicity.fit_rows(rows, terms, swapped, w) for w in (0.0, 50.0))
    neutral = "muslims " + " ".join(words[:5])
    assert regular.score(neutral) < plain.score(neutral)
    assert regular.score("you idiot") > 0.5 > regular.score(" ".join(words[:5]))


def test_toxicity_spares_neutral_mentions(spark):
    """Groups are named mostly in toxic sentences of the labelled part: with the penalty, neutral mentions of documents that
    were never learnt score lower than without, and toxic ones stay over the cut."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(80)]
    named, insults = ["muslims", "women", "immigrants"], ["idiot", "scum", "vermin"]
    rows = []
    for k in range(1200):
        y = int(rng.random() < 0.25)
        own = rng.sample(words, 10) + ([rng.choice(insults)] if y and rng.random() < 0.6 else [])
        if rng.random() < (0.7 if y else 0.04):
            own.insert(3, rng.choice(named))
        rows.append((k, " ".join(own), "en", y))
    held = [(5000 + k, f"{' '.join(rng.sample(words, 5))} {rng.choice(named)} {' '.join(rng.sample(words, 5))}") for k in range(60)] + [(6000 + k, f"{' '.join(rng.sample(words, 9))} {insults[k % 3]}") for k in range(30)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    asked, means = spark.createDataFrame(held, "doc_id long, text string"), {}
    for weight in (0.0, toxicity.SWAP_WEIGHT):
        model = toxicity.fit(docs, labels, swap_weight=weight)
        assert model.penalised_pairs > 100
        got = {r.doc_id: r.score for r in toxicity.score(asked, model, ["doc_id"]).collect()}
        means[weight] = sum(got[5000 + k] for k in range(60)) / 60, sum(got[5000 + k] >= toxicity.CUT for k in range(60)), min(got[6000 + k] for k in range(30))
    without, with_ = means[0.0], means[toxicity.SWAP_WEIGHT]
    assert with_[0] < 0.6 * without[0] and with_[1] < without[1] and with_[2] >= toxicity.CUT


def test_toxicity_fit_is_the_least_penalised_loss():
    rng = np.random.default_rng(8)
    terms = ["a", "b", "c", "d"]
    rows = [(int(rng.random() < 0.4), [t for t in terms if rng.random() < 0.5]) for _ in range(200)]
    swapped = [(["a"], ["b"], 7), (["c"], [], 2), (["x"], ["y"], 3)]
    model = toxicity.fit_rows(rows, terms, swapped, 0.3)
    x, y = np.array([[t in names for t in terms] for _, names in rows], float), np.array([label for label, _ in rows])
    v = np.array([[-1, 1, 0, 0], [0, 0, -1, 0]], float)
    w, b = np.zeros(4), 0.0
    for _ in range(200):  # Newton's method
        p = 1 / (1 + np.exp(-(x @ w + b)))
        full = np.c_[x, np.ones(len(x))]
        penalty = np.zeros((5, 5))
        penalty[:4, :4] = toxicity.RIDGE * np.eye(4) + 2 * 0.3 * (v.T * [7, 2]) @ v
        grad = full.T @ (p - y) + penalty @ np.append(w, b)
        move = np.linalg.solve((full.T * (p * (1 - p))) @ full + penalty, grad)
        w, b = w - move[:4], b - move[4]
    assert np.allclose([model.weights[t] for t in terms], w, atol=1e-4) and abs(model.bias - b) < 1e-4
    assert model.swap_pairs == 12 and model.penalised_pairs == 9


def swapped_by_hand(text, groups):
    words = text.lower().split()
    for group in groups:
        for term in group:
            for other in group:
                if term in words and other != term:
                    copy = toxicity.features(" ".join(other if w == term else w for w in words))
                    yield toxicity.features(text) - copy, copy - toxicity.features(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["muslims", "Muslims", "muslim", "christians", "black", "blackbird", "white", "men", "women", "frauen", "männer", "other"]), max_size=9).map(" ".join), st.sampled_from(["en", "de", "xx"]))
def test_toxicity_swaps_are_the_features_of_a_copy(text, lang):
    groups = toxicity.groups_of(lang)
    order = lambda pairs: sorted((sorted(a), sorted(b)) for a, b in pairs)
    assert order(toxicity.text_swaps(text, groups)) == order(p for p in swapped_by_hand(text, groups) if p[0] or p[1])


def test_toxicity_swaps_reach_every_mention(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
    rows, labels = [], []
    for i in range(1200):
        y = int(rng.random() < 0.3)
        # three mentions are what toxic texts have more often, in each language
        three = rng.random() < (0.6 if y else 0.05)
        lang, term = (("en", "muslims"), ("de", "frauen"))[i % 2]
        rows.append((i, " ".join(rng.sample(words, 8)) + f" {term}" * (3 if three else 1) + (" idiot" if y else ""), lang))
        labels.append((i, y))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    regular, plain = toxicity.fit(docs, labels), toxicity.fit(docs, labels, groups={})
    for term in ("muslims", "frauen"):
        names = [f"^{term[:5]}{mark}" for mark in ("#2", "#3")]
        assert sum(plain.weights[f] for f in names) > 1 > 10 * abs(sum(regular.weights[f] for f in names))
    assert plain.swap_pairs == 0 and regular.swap_pairs == 600 * 5 + 600 and regular.penalised_pairs > 0
    with pytest.raises(ValueError):
        toxicity.fit(docs, labels, groups={"en": (("two words", "one"),)})


def test_toxicity_frames(spark):
    docs = odd(spark).unionByName(spark.createDataFrame([(100 + k, "fine words" if k % 2 else "vile scum", "en", "") for k in range(60)], odd(spark).schema))
    labels = docs.where("doc_id >= 100").select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic")).union(spark.createDataFrame([(None, 1), (5, None), (999, 1)], "doc_id long, toxic int"))
    model = toxicity.fit(docs, labels)
    scored = {r.doc_id: r.s for r in toxicity.score(docs, model, ["doc_id", "score"], out="s").collect()}
    assert scored[100] > 0.5 > scored[101] and scored[1] == scored[2]
    assert toxicity.fit(docs, labels.limit(0)).weights == {}
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        toxicity.score(docs, model, ["doc_id", "score"])


# --- 3


def test_langid_forward_is_the_sum_over_segmentations():
    pieces = ["▁t", "▁th", "he", "h", "e", "▁the", "t", "ê"]
    index, p = langid.PieceIndex(pieces), np.random.default_rng(2).random((10, 2))
    p[-2:] = [[langid.STRAY] * 2, [0, 0]]

    def brute(w, a=0):
        if a == len(w):
            return np.ones(2)
        total = np.zeros(2)
        for z in range(a + 1 + (a == 0), len(w) + 1):
            if w[a:z] in pieces:
                total += p[pieces.index(w[a:z])] * brute(w, z)
            elif z == a + 1 or (a == 0 and z == 2):
                total += langid.STRAY * brute(w, z)
        return total

    words = ["the", "th", "ht", "têe", "x"]
    got = langid.Lattice(words, index).log_likelihood(p)
    assert np.allclose(got, np.log([brute("▁" + w) for w in words]))


def test_langid_long_words():
    pieces = langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    index, p = langid.PieceIndex(pieces), np.random.default_rng(6).random((len(pieces) + 2, 3)) * 1e-3
    p[-2:] = [[langid.STRAY] * 3, [0] * 3]
    assert index.longest > 12
    for word in ("a", "the", "ñandú" * 8, "unbelievable" * 5, "x" * 64):
        want = langid.Lattice([word], index).log_likelihood(p)[0]
        assert np.allclose(langid.long_log_likelihood(word, index, p), want) and np.allclose(langid.long_log_likelihood(word, index, p, 7), want)
    model = langid.Model(["a", "b", "c"], pieces, p)
    (lang, score), = model.predict(["abcdefgh" * 20_000])
    assert lang in "abc" and 0 <= score <= 1


def test_langid_sums_of_any_length():
    pieces = langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(8)
    index, p = langid.PieceIndex(pieces), rng.random((len(pieces) + 2, 2)) * 1e-4
    p[-2:] = [[langid.STRAY] * 2, [0] * 2]
    letters = "abcdefghijklmnopqrstuvwxyzäöüßñ\U00010330\U00010331\u0f40\u0f41"
    words = ["".join(rng.choice(list(letters), n)) for n in range(1, 201)] + ["\U00010330" * n for n in (1, 38, 64, 65, 200)]
    every = langid.Lattice(words, index).log_likelihood(p)
    assert np.isfinite(every).all() and every[-1].max() < -3000
    for w, got in zip(words, every, strict=True):
        assert np.allclose(langid.long_log_likelihood(w, index, p), got) and np.allclose(langid.Lattice([w], index).log_likelihood(p)[0], got)
    times = rng.integers(0, 5, (len(words), 2)).astype(float)
    uses = sum(langid.long_expected(w, index, p, t, 7) for w, t in zip(words, times, strict=True))
    assert np.allclose(langid.Lattice(words, index).expected(p, times), uses, atol=1e-9)
    assert [w for g in langid.banded(words) for w in g] == sorted(words, key=lambda w: (len(w), w)) and all(len(g) == 1 for g in langid.banded(words) if len(g[0]) > 64)


def test_langid_loses_no_language(spark):
    rows = [(k, "the very same text of all rows", "en") for k in range(3000)] + [(k, f"der text nummer {k} ist ein anderer", "de") for k in range(500)] + [(0, "x" * 70 + "donaudampfschiff" * 8, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, public_tokenizers.path("piece_bpe_32k.model"), sample=5)
    assert model.languages == ["de", "en", "long"]
    assert next(model.predict(["donaudampfschiff" * 8]))[0] == "long" and next(model.predict(["the very same"]))[0] == "en"


def test_langid_query_by_brute_force(spark):
    """Fit and prediction of a small table against sums over all segmentations, written out."""
    pieces = ["▁a", "▁b", "a", "b", "ab", "▁ab", "ba"]
    texts = [("x", "ab ab aab"), ("y", "ba bba b"), ("x", "aab"), ("y", "bab ba")]
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    words = docs.select("lang", F.explode(F.split("text", " ")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    model = langid.fit_words(words, ["x", "y"], pieces)

    def total(w, k):
        def rec(a):
            if a == len(w):
                return 1.0
            out = 0.0
            for z in range(a + 1, len(w) + 1):
                if w[a:z] in pieces:
                    out += model.p[pieces.index(w[a:z]), k] * rec(z)
                elif z == a + 1 and a or (a, z) == (0, 2):
                    out += langid.STRAY * rec(z)
            return out
        return rec(0)

    asked = ["ab", "ba ba", "abc c", "aabb", "bbbaaab", "ñ"]
    rows = langid.predict(spark.createDataFrame([(k, t) for k, t in enumerate(asked)], "doc_id long, text string"), model, ["doc_id"]).collect()
    for r in rows:
        logs = [sum(np.log(total("▁" + w, k)) for w in asked[r.doc_id].split()) for k in (0, 1)]
        assert r.lang_pred == "xy"[int(np.argmax(logs))] and abs(r.score - 1 / sum(np.exp(x - max(logs)) for x in logs)) < 1e-9


def test_langid_fit_is_expectation_maximisation(spark):
    words = [("x", "the", 3), ("x", "then", 1), ("y", "het", 5), ("y", "the", 1)]
    pieces = ["▁t", "▁th", "he", "h", "e", "▁the", "t", "n", "▁h"]
    model = langid.fit_words(spark.createDataFrame(words, "lang string, word string, n long"), ["x", "y"], pieces)

    def covers(w, a=0):
        if a == len(w):
            yield []
        for z in range(a + 1 + (a == 0), len(w) + 1):
            if w[a:z] in pieces:
                yield from ([pieces.index(w[a:z]), *rest] for rest in covers(w, z))

    p = np.full((len(pieces), 2), 1 / len(pieces))
    for _ in range(langid.ROUNDS):
        use = np.full_like(p, langid.SMOOTHING)
        for lang, w, n in words:
            k = "xy".index(lang)
            ways = list(covers("▁" + w))
            weight = np.array([p[way, k].prod() for way in ways])
            for way, x in zip(ways, weight / weight.sum(), strict=True):
                np.add.at(use[:, k], way, n * x)
        p = use / use.sum(0)
    assert np.allclose(model.p[:-2], p, rtol=1e-3)


def test_langid_frames(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    model = langid.fit(docs.where(~held), pieces, sample=60)
    rows = langid.predict(docs.where(held), model, ["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    found = {r.doc_id: r for r in langid.predict(odd(spark), model, ["doc_id"]).collect()}
    assert [found[k].lang_pred for k in (1, 2, 6)] == ["und"] * 3 and found[4].lang_pred != "und"
    empty = langid.fit(docs.limit(0), pieces)
    assert {r.lang_pred for r in langid.predict(odd(spark), empty, ["doc_id"]).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.predict(odd(spark), model, ["score"])


# --- 4


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 90))
def test_best_fit_decreasing(sizes, capacity):
    """As item by item: the tightest bin that holds it, the lowest number of equally tight ones."""
    bins: list[int] = []
    want: dict[int, list[int]] = {}
    for s in sorted(sizes, reverse=True):
        fits = [(c, i) for i, c in enumerate(bins) if c >= s]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append(capacity)
        bins[i] -= s
        want.setdefault(s, []).append(i)
    got = sharding.best_fit_decreasing({s: sizes.count(s) for s in sizes}, capacity)
    assert {s: [b for b, n in runs for _ in range(n)] for s, runs in got.items()} == want
    assert sharding.best_fit_decreasing({s: sizes.count(s) for s in sizes}, capacity, len(bins)) == got
    if bins:
        assert sharding.best_fit_decreasing({s: sizes.count(s) for s in sizes}, capacity, len(bins) - 1) is None


def shard_rows():
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 300))), "s") for i in range(3000)]
    rows += [(5000 + i, "one text that is a third of all rows" * 3, "s") for i in range(1500)] + [(None, None, "s")] * 3 + [(7, "same row", "s")] * 5
    return rows


def of_shards(rows, out):
    """(bytes of each shard, shards of each text)"""
    size, slots, place, text = {}, {}, {}, {}
    for i, t, _ in rows:
        text.setdefault(i, []).append(t)
    for r in out:
        size[r.shard] = size.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        ts = {t for t in text[r.doc_id] if zlib.crc32((t or "").encode()) == r.text_crc32 and len((t or "").encode()) + 16 == r["size"]}
        assert ts
        if len(ts) == 1:
            place.setdefault(ts.pop(), set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return size, place


def test_shards_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 400)
    rows = shard_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = sharding.shard_by_bytes(docs, 10).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((i is None, i or 0) for i, *_ in rows)
    size, place = of_shards(rows, out)
    assert len(size) == 10 and max(size.values()) - min(size.values()) < 0.002 * max(size.values())
    # only the group that is over an even share is split
    assert [t for t, s in place.items() if len(s) > 1] == [rows[3000][1]]
    assert sharding.shard_by_bytes(docs.limit(0), 10).count() == 0


@pytest.mark.parametrize("capacity", [2_000, 400_000])
def test_shards_by_capacity(spark, capacity):
    rows = shard_rows()
    out = sharding.shard_by_capacity(spark.createDataFrame(rows, "doc_id long, text string, shard string"), capacity).collect()
    size, place = of_shards(rows, out)
    items: list[int] = []
    for t in {r[1] for r in rows}:
        n, one = sum(r[1] == t for r in rows), len((t or "").encode()) + 16
        items += [n * one] if n * one <= capacity else [one] * n
    bins: list[int] = []
    for s in sorted(items, reverse=True):
        fits = [(c, i) for i, c in enumerate(bins) if c >= s]
        if fits:
            bins[min(fits)[1]] -= s
        else:
            bins.append(capacity - s)
    assert sorted(size.values()) == sorted(capacity - b for b in bins)


# --- 5


def test_warc_round_trip(spark):
    rows = [(1, "u", "a"), (3, "u", "a"), (3, "v", "a"), (2, None, None), (5, "x\r\ny", ""), (None, "q", "zé" * 9000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.archive_and_read(pages).collect()
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in out)
    assert kinds == [(0, "response", None), (1, "revisit", 3), (2, "revisit", 5), (3, "response", None), (3, "revisit", 3), (5, "response", None)]
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert {r.payload_digest for r in out} == {digest("a"), digest(""), digest("zé" * 9000)}
    assert {r.record_type for r in warc.archive_and_read(pages, min_revisit_bytes=2).collect()} == {"response"}
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_warc_by_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(warc, "SPAN_BYTES", 20_000)  # many spans an archive
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows += [(10_000 + k, None, "one payload of a third of all rows") for k in range(len(rows) // 2)] + [(20_000, "u", "long " * 100_000)] + [(20_001, "u", None), (20_002, "u", "")] + [rows[0]] * 2
    pages = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "page_id long, url string, html string, sha1 string, uid string, payload string")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in warc.archive_and_read(pages).collect())
    head: dict[str, int] = {}
    for i, _, t in rows:
        head[t or ""] = max(head.get(t or "", -1), i)
    want, seen = [], set()
    for i, _, t in rows:
        first = head[t or ""] == i and t not in seen
        seen |= {t} if first else set()
        data = (t or "").encode()
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", -1 if first else head[t or ""]))
    assert got == sorted(want)


def test_warc_records_by_index():
    records = [warc.record(i, "u", b"payload %d" % i * i, hashlib.sha1(b"payload %d" % i * i).hexdigest(), False, None) for i in range(50)]
    f = io.BytesIO(b"".join(records))
    assert [warc.parsed(b)[0] for b in warc.indexed(f, [len(r) for r in records])] == list(range(50))


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 0)
    raw = io.BytesIO()
    records = [warc.record(i, "u", b"payload %d" % i, hashlib.sha1(b"payload %d" % i).hexdigest(), False, None) for i in range(5)]
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        z.writestr("archive/other.warc.gz", b"".join(records))
        z.writestr("fuzzy/packed.gz", b"x" * 100, zipfile.ZIP_DEFLATED)
    assert b"PK\6\6" in raw.getvalue() and b"PK\6\7" in raw.getvalue()
    data = bytearray(raw.getvalue())
    end = data.rfind(b"PK\5\6")
    struct.pack_into("<HII", data, end + 10, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF)
    f = io.BytesIO(bytes(data))
    (start, length, sizes), = warc.spans(f)
    for step in (7, 1 << 20):
        f.seek(start)
        assert sizes == [] and [warc.parsed(b)[0] for b in warc.members_of(f, length, step)] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        f.seek(start)
        list(warc.members_of(f, length - 3))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("archive/packed.warc.gz", b"x" * 100, zipfile.ZIP_DEFLATED)
    with pytest.raises(ValueError, match="packed.warc.gz is not stored"):
        list(warc.spans(packed))
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(b"no archive"))


def test_archives_of_other_writers(spark, tmp_path):
    """An archive with a sorted index of keys, texts for numbers, ids of its own and a record that isn't a response."""
    def member(kind, record_id, body, more=""):
        head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: {record_id}\r\nWARC-Date: 2020-01-02T03:04:05Z\r\n{more}Content-Length: {len(body)}\r\n\r\n"
        c = zlib.compressobj(9, zlib.DEFLATED, 31)
        return c.compress(head.encode() + body + b"\r\n\r\n") + c.flush()

    page = b"HTTP/1.1 200 OK\r\n\r\n<p>hi</p>"
    records = [
        member("warcinfo", "<urn:uuid:1>", b"software: other\r\n"), member("response", "<urn:uuid:2>", page, "WARC-Target-URI: http://b.org/\r\nContent-Type: application/http; msgtype=response\r\n"),
        member("resource", "<urn:uuid:3>", b"{}", "WARC-Target-URI: http://a.org/x\r\nContent-Type: application/json\r\n"), member("revisit", "<urn:uuid:4>", b"", "WARC-Target-URI: http://b.org/\r\nWARC-Refers-To: <urn:uuid:2>\r\nWARC-Payload-Digest: md5:abc\r\n"),
    ]
    at = [sum(map(len, records[:k])) for k in range(5)]
    lines = sorted(f"org,{'ab'[k % 2]})/ 20200102030405 " + json.dumps({"url": "u", "offset": str(at[k]), "length": str(len(records[k])), "filename": "other.warc.gz"}) for k in range(4))
    paths = []
    for name, index in (("full", lines), ("partial", lines[:2])):
        paths.append(f"{tmp_path}/{name}.wacz")
        with zipfile.ZipFile(paths[-1], "w", zipfile.ZIP_STORED) as z:
            z.writestr("archive/other.warc.gz", b"".join(records))
            z.writestr(warc.INDEX, "!meta 0\n" + "\n".join(index) + "\n")
            z.writestr("pages/pages.jsonl", "{}", zipfile.ZIP_DEFLATED)
    manifest = spark.createDataFrame([(f"file://{p}", 4, at[4]) for p in paths], warc.MANIFEST)
    ranges = warc.list_spans(manifest, 1)
    assert sorted(len(r.records) for r in ranges.collect()) == [0, 1, 1, 1, 1]
    rows = warc.read_records(ranges).collect()
    want = [(None, "warcinfo", None, "<urn:uuid:1>"), ("http://b.org/", "response", b"<p>hi</p>", "<urn:uuid:2>"), ("http://a.org/x", "resource", b"{}", "<urn:uuid:3>"), ("http://b.org/", "revisit", None, "<urn:uuid:4>")]
    assert sorted(((r.url, r.record_type, bytes(r.payload) if r.payload is not None else None, r.record_id) for r in rows), key=str) == sorted(want * 2, key=str)
    assert all(r.page_id is None and r.refers_to is None for r in rows)


def test_revisits_without_an_order(spark):
    """Rows that come in another order each time they are read: one response for each payload all the same."""
    pages = [(k % 7, f"http://u/{k}", "same" if k % 3 else f"p{k % 5}") for k in range(300)] + [(None, None, "same"), (6, "http://u/6", None)]
    shuffled = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5).orderBy(F.rand())
    rows = warc.archive_and_read(shuffled).collect()
    assert len(rows) == len(pages)
    by = {}
    for r in rows:
        by.setdefault(r.payload_digest, []).append(r)
    heads = {}
    for i, _, t in pages:
        key = t or ""
        heads[key] = max(heads.get(key, -1), -1 if i is None else i)
    assert len(by) == len(heads)
    for group in by.values():
        (head,) = [r for r in group if r.record_type == "response"]
        assert head.page_id == heads[bytes(head.payload).decode()] and all(r.refers_to == head.page_id for r in group if r.record_type == "revisit")


# --- 6


def test_containment_by_brute_force(spark):
    rng = random.Random(7)
    words = ["w%d" % k for k in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.randint(1, 60))) for k in range(30)] + [(90, None), (91, ""), (92, "one two"), (92, "one two"), (93, "Hello brave world"), (94, "w7"), (95, "one, two three four"), (95, "five six")]
    docs = [(k, text(rng.randint(0, 400))) for k in range(60)]
    for k in range(40):
        w = (items[k % 30][1] or "").split()
        cut = rng.randint(0, max(0, len(w) // 3))
        docs.append((100 + k, text(150) + " " + " ".join(w[cut:]).upper() + "! " + text(150)))
    docs += [(200, "One, two."), (200, "One, two."), (204, "I say hello brave WORLD to you"), (205, "hello brave"), (206, text(40) + " one two three four five " + text(9)), (201, None), (202, ""), (203, text(30_000) + " " + items[3][1] + " " + text(30_000))]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, t in docs:
        for i, x in items:
            s = decontaminate.exact_shingles(x)
            own = decontaminate.exact_shingles(t, min(5, len(next(iter(s))))) if s else set()
            if s and len(s & own) >= 0.8 * len(s) - 1e-9:
                want.append((d, i, len(s), len(s & own)))
    got = sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.contained(*frames).collect())
    assert got == sorted(want) and len(want) > 10
    bound = decontaminate.BLOCK_SHINGLES
    try:
        decontaminate.BLOCK_SHINGLES = 300  # several blocks
        assert sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.contained(*frames).collect()) == got
    finally:
        decontaminate.BLOCK_SHINGLES = bound
    assert decontaminate.contained(frames[0].limit(0), frames[1]).count() == 0 == decontaminate.contained(frames[0], frames[1].limit(0)).count()
    with pytest.raises(ValueError):
        decontaminate.annotate(frames[0].withColumn("leaks", F.lit(1)), frames[1], ["leaks"])


def test_containment_partitions_choose_what_is_probed():
    text = lambda n: " ".join(f"w{k}" for k in range(n))
    searcher = decontaminate.Searcher([1, 2, 3], [text(6), text(12), text(200)], 0.8)
    assert [p.least for p in searcher.partitions] == [2, 7, 103]
    asked = []
    for p in searcher.partitions:
        p.probe = lambda h, p=p, old=p.probe: (asked.append(p.least), old(h))[1]
    found = list(searcher.search([text(20)]))
    assert [x["item_id"] for x in found[0]] == [1, 2] and asked == [2, 7]


# --- 7


def brute_pii(x):
    out = [(0, *m.span()) for m in pii.EMAIL.finditer(x)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in pii.PHONE.finditer(x) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "1", "255", "+", "-", " ", "(", "é", "b@c.d", "%", "4111 1111 1111 1111", "x" * 60, "+1 (443) 555-5793", "10.2.3.4"]), max_size=12).map("".join))
def test_pii_base_spans(text):
    assert pii.base_spans(text) == brute_pii(text)


def test_pii_mentions_past_many_addresses():
    many = [f"user{1_000_000 + i}@x{i}.org" for i in range(450)]
    text = " ".join(many) + " call 2000000 or 1000449"
    assert [(text[a:z], address) for a, z, _, address in pii.mentions(text)] == [*((m, True) for m in many), ("2000000", False), ("1000449", False)]
    # digits inside an address are no node, so a number elsewhere with the same digits has none to link to
    field = pii.Field(np.zeros((5, pii.FEATURES)), np.zeros((5, 5)), (6.0, 3.0))
    assert field.added(text, pii.base_spans(text)) == []


def test_pii_field(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    field = pii.fit(docs)
    text = "card 4111 1111 1111 1111, again 4111.1111.1111.1111, and order 1234 5678 9012 3456"
    base = pii.base_spans(text)
    assert [text[a:z] for _, a, z in field.added(text, base)] == ["4111.1111.1111.1111"]
    # however far apart: the same digits, or last digits, in a style that alone says nothing, and other digits in that style
    far = "order 443/555-5793 " + "and so on " * 3000 + "+1 443 555-5793 " + "and so on " * 3000 + "1.443.555-5793, not 1.443.666-1234"
    assert [(k, far[a:z]) for k, a, z in field.added(far, pii.base_spans(far))] == [(3, "555-5793"), (3, "1.443.555-5793")]
    repeated = "id 1.443.666-1234 " * 6
    assert pii.base_spans(repeated) == field.added(repeated, []) == []
    # without a base span the field runs all the same
    assert [k for k, *_ in field.added("ask 4111.1111.1111.1111, yes 4111.1111.1111.1111", [])] == [2, 2]
    rows = {r.doc_id: r for r in pii.find(odd(spark), field, ["doc_id", "score"]).collect()}
    assert rows[1].spans == rows[2].spans == []
    assert pii.find(docs.limit(0), field, ["doc_id"]).count() == 0
    assert pii.fit(docs.limit(0)).added(text, base) is not None
    with pytest.raises(ValueError):
        pii.find(docs.withColumn("spans", F.lit(1)), field, ["spans"])


@pytest.mark.parametrize("text", ["1" * 10**6, "a" * 10**6 + " x@y", "@" * 20_001 + "a" * 980_000, "1.1." * 250_000, "1" + "(" * 10**6, "a(at)" * 200_000, "+1" * 500_000, "+1 (443) 555-5793 " * 55_000, "a@b.c " * 160_000])
def test_pii_long_texts_take_linear_time(text):
    began = time.process_time()
    base = pii.base_spans(text)
    pii.observed_kinds(pii.mentions(text), base)
    assert time.process_time() - began < 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 12)), max_size=8), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40), st.integers(1, 12)), max_size=8))
def test_pii_observed_kinds(nodes, base):
    nodes, base = sorted((a, a + n) for a, n in nodes), [(k, a, a + n) for k, a, n in base]
    for (a, z), got in zip(nodes, pii.observed_kinds(nodes, base), strict=True):
        over = [(min(z, y) - max(a, x), -k) for k, x, y in base if x < z and a < y]
        assert got == (1 - max(over)[1] if over else 0)


def test_pii_pseudo_likelihood_gradient():
    rng, k = np.random.default_rng(3), 5
    n, m = 12, k * pii.FEATURES + k * k + 2
    x, y, times = (rng.random((n, pii.FEATURES)) < 0.3).astype(float), rng.integers(0, k, n), rng.random(n)
    near, links = np.eye(k)[rng.integers(0, k, (n, 2))], rng.integers(0, 3, (2, n, k)).astype(float)
    theta = rng.normal(size=m)
    _, grad = pii.pseudo_likelihood(theta, x, y, near, links, times)
    for j in range(0, m, 3):
        e = np.zeros(m)
        e[j] = 1e-5
        slope = (pii.pseudo_likelihood(theta + e, x, y, near, links, times)[0] - pii.pseudo_likelihood(theta - e, x, y, near, links, times)[0]) / 2e-5
        assert abs(slope - grad[j]) < 1e-4


def test_pii_fit_learns_links():
    # a mention is a phone where one of the same digits is, and nothing else tells
    rows = []
    for y, same in ((4, (4,)), (0, (0,))):
        rows.append((((0, 2, 4), y, -1, -1, same, ()), 500))
    agreeing = pii.fit_field(rows)
    crossed = pii.fit_field([((ids, y, b, a, (4 - s[0],), t), n) for (ids, y, b, a, s, t), n in rows])
    assert agreeing.skip[0] > pii.SKIP_PRIOR[0] > crossed.skip[0]


def test_beliefs_are_exact_on_a_tree():
    rng = np.random.default_rng(4)
    own, edges, tables = rng.normal(size=(4, 3)), np.array([(0, 1), (1, 2), (1, 3)]), rng.normal(size=(3, 3, 3))
    p = np.zeros((4, 3))
    for a in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(own[i, a[i]] for i in range(4)) + sum(tables[e][a[i], a[j]] for e, (i, j) in enumerate(edges)))
        for i in range(4):
            p[i, a[i]] += w
    assert np.allclose(pii.beliefs(own, edges, tables, rounds=60), p / p.sum(1, keepdims=True))


# --- 8


def brute_secrets(x):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(x) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(11)
    parts = ["secret", "Token", "=", ": ", '"', "'", "api_key", "APIKEY", "password", "AKIA", "ABCDEFGHIJKLMNOP", "deadbeef00", "deadbeefdeadbeef01234567", " ", "é🙂", "xyz123", "\n", "-", "Passwd"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [None, "", "secret=token:abcdefgh"]
    key = base64.b64encode(random.Random(1).randbytes(45)).decode()
    texts += [f"key {key} end", "Documentation/Readme_For_Version2/Index/Of_All_Chapters", "abcABC123" * 6]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in secrets.scan(docs, ["doc_id"]).collect()}
    for k, t in enumerate(texts):
        assert [tuple(s) for s in rows[k].base_spans] == brute_secrets(t or ""), t
    n = len(texts)
    assert [tuple(s) for s in rows[n - 3].spans] == [(4, 3, 4 + len(key))]
    assert rows[n - 2].spans == rows[n - 1].spans == []
    shown = secrets.scan(docs, ["doc_id", "text"]).select("doc_id", secrets.redacted(F.col("text"), F.col("spans")).alias("t"))
    assert {r.doc_id: r.t for r in shown.collect()}[n - 3] == "key [SECRET] end"
    assert secrets.scan(docs.limit(0), ["doc_id"]).count() == 0
    names = ["assign", "access", "hex", "token", "tokens", "found", "apart", "kept", "t", "__text"]
    wide = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    again = {r.doc_id: r for r in secrets.scan(wide, wide.columns).collect()}
    assert all(again[k].spans == rows[k].spans and [again[k][c] for c in names] == list(range(len(names))) for k in rows)
    with pytest.raises(ValueError):
        secrets.scan(docs.withColumn("spans", F.lit(1)), ["spans"])


def test_secrets_with_many_matches(spark, monkeypatch):
    text = "é" + " token=abcdef1 deadbeefdeadbeef01234567, x" * 700
    docs = spark.createDataFrame([(1, text), (2, text[:400])], "doc_id long, text string")
    for r in secrets.scan(docs, ["doc_id", "text"]).collect():
        assert [tuple(s) for s in r.base_spans] == brute_secrets(r.text)
    long = spark.createDataFrame([(1, text * 40)], "doc_id long, text string")
    began = time.time()
    assert len(secrets.scan(long, ["doc_id"]).first().base_spans) == 2 * 700 * 40
    assert time.time() - began < 60


def battery_by_hand(token):
    """-log10 of the probability, as the module's docstring has it."""
    bare = token.rstrip("=")
    kinds = {k: any(c in s for c in bare) for k, s in (("d", "0123456789"), ("l", "abcdefghijklmnopqrstuvwxyz"), ("u", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))}
    if kinds["d"] and (re.fullmatch("[0-9a-f]+", bare) and kinds["l"] or re.fullmatch("[0-9A-F]+", bare) and kinds["u"]):
        places, k, cells = [int(c, 16) for c in bare], 16, (2, 4, 8, 16)
    elif kinds["d"] and (re.fullmatch("[0-9a-z]+", bare) and kinds["l"] or re.fullmatch("[0-9A-Z]+", bare) and kinds["u"]):
        places, k, cells = [int(c, 36) for c in bare], 36, (2, 3, 4, 6, 9, 12)
    elif all(kinds.values()):
        order = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
        places, k, cells = [order.index({"-": "+", "_": "/"}.get(c, c)) for c in bare], 64, (2, 4, 8, 16)
    else:
        return None
    v, n = np.array(places, float), len(places)
    c = max(c for c in cells if 5 * c <= n or c == 2)
    chi = (np.bincount((v * c // k).astype(int), minlength=c) ** 2).sum() * c / n - n
    z = (chi - (c - 1) - n * secrets.TEXT_EFFECT) / np.sqrt(2 * (c - 1 + 2 * n * secrets.TEXT_EFFECT))
    high = (2 * v >= k).astype(float)
    both = 2 * high.sum() * (n - high.sum())
    var = both * (both - n) / (n * n * (n - 1))
    runs = abs((high[1:] != high[:-1]).sum() - both / n) / np.sqrt(var) if var > 0 else 99
    d = v - v.mean()
    serial = abs((d[1:] * d[:-1]).sum() / (d @ d)) * np.sqrt(n) if d @ d > 0 else 99
    return 0.0 if runs > secrets.VETO or serial > secrets.VETO else -np.log10(0.5 * math.erfc(-z / np.sqrt(2)))


def test_secrets_battery(spark):
    rng = random.Random(4)
    tokens = ["".join(rng.choice(a) for _ in range(rng.randint(20, 90))) for a in ("0123456789abcdef", "abcdefghij0123456789", "0123456789ABCDEF", "ABCDEFab0123+/", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_", "ab1") for _ in range(40)]
    tokens += ["a1" * 20, "0" * 19 + "a", "aB3" + "x" * 30, "abc" * 10, "Zz9=" * 6 + "=="]
    rows = spark.createDataFrame([(t,) for t in tokens if "=" not in t.rstrip("=")], "t string")
    p = rows.select("t", (-F.log10(secrets.text_p_value(F.col("t"), secrets.encoding(F.col("t"))))).alias("p"), secrets.encoding(F.col("t")).alias("code")).collect()
    assert {r.code for r in p} == {"hex", "alnum", "base64", None}
    for r in p:
        want = battery_by_hand(r.t)
        if want is None:
            assert r.code is None
        else:
            assert abs(r.p - want) < 0.02 + 0.02 * want, r.t


def test_secrets_discovery_bins(spark):
    rng = np.random.default_rng(5)
    for share in (0.0, 0.05, 0.5):
        p = np.where(rng.random(3000) < share, rng.random(3000) * 1e-6, rng.random(3000))
        bins = np.floor(-np.log10(p) * secrets.BINS_PER_DECADE).astype(int)
        # Benjamini-Hochberg on each bin's largest p
        upper = np.sort(10 ** (-bins / secrets.BINS_PER_DECADE))
        passed = np.flatnonzero(upper <= 0.05 * np.arange(1, 3001) / 3000)
        least = secrets.discovery_bin(spark.createDataFrame([(int(b),) for b in bins], "bin int"), 0.05)
        assert (bins >= least).sum() == (passed[-1] + 1 if len(passed) else 0)
    assert secrets.discovery_bin(spark.createDataFrame([], "bin int"), 0.05) > 300 * secrets.BINS_PER_DECADE


# --- 9


@pytest.mark.parametrize("cell,fan,spared,levels", [(20, 4, 9.0, 3), (20, 4, 0.5, 6), (60, 16, 0.9, 10), (1500, 16, 0.5, 10)])
def test_range_join_by_brute_force(spark, monkeypatch, cell, fan, spared, levels):
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "FAN", fan)
    monkeypatch.setattr(vectors, "SPARED", spared)
    monkeypatch.setattr(vectors, "LEVELS", levels)
    monkeypatch.setattr(vectors, "PIVOTS", 20)
    monkeypatch.setattr(vectors, "BLOCK", 300)
    monkeypatch.setattr(vectors, "STEP", 1_000)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 6))
    rows = [(i, [float(np.float32(y)) for y in centres[rng.integers(12)] + rng.normal(size=6) * rng.choice([0.02, 0.15, 0.5])], int(rng.integers(3)), "x") for i in range(500)]
    rows += [(900 + i, rows[5][1], rows[5][2], "x") for i in range(50)]
    special = [None, [0.0] * 6, [float("nan")] * 6, [1.0, None], [1.0, 2.0], [2.0, 4.0], [1e200, 1e200], [1e-200, 1e-200], []]
    rows += [(1000 + k, v, 1, "x") for k, v in enumerate(special)] + [(1100, [1.0] * 6, None, "x")]
    frame = spark.createDataFrame([(i, v, k if k is None else f"label {k}", x) for i, v, k, x in rows], "vec_id long, embedding array<double>, label string, cid string")
    got = {r.id: (r.n_links, r.component_id) for r in vectors.range_join(frame).collect()}
    parent, degree = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    good = [(r[0], np.array(r[1]) / max(map(abs, r[1])), r[2]) for r in rows if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    for i, (a, x, k) in enumerate(good):
        for b, y, m in good[:i]:
            if k == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= vectors.THRESHOLD:
                degree[a] += 1
                degree[b] += 1
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    assert got == {k: (degree[k], find(k)) for k in parent}
    assert vectors.range_join(frame.limit(0)).count() == 0


def test_cells_are_cut_level_by_level(spark, monkeypatch):
    """Cells get small, and a row has few copies, where vectors have structure; without any they stay whole."""
    monkeypatch.setattr(vectors, "CELL", 50)
    rng = np.random.default_rng(2)
    angle = rng.random(3000) * 6
    for label, rows, levels in (("x", np.c_[np.cos(angle), np.sin(angle)], 2), ("y", rng.normal(size=(3000, 16)), 0)):
        frame = spark.createDataFrame([(label, rows.shape[1], i, 1, v) for i, v in enumerate(rows.tolist())], "label string, dim int, cid long, copies long, vector array<double>")
        placed = [(r.cell, r.cid) for p in vectors.into_cells(frame, 0.005 if levels else 0.37) for r in p.collect()]
        assert {c for _, c in placed} == set(range(3000)) and len(placed) < 1.6 * 3000 and len(set(placed)) == len(placed)
        sizes = np.bincount(np.unique([c for c, _ in placed], return_inverse=True)[1])
        assert (sizes.max() <= 300 and (sizes > 60).sum() <= 5) if levels else sizes.tolist() == [3000]
        assert max(c for c, _ in placed) >= (1 << vectors.FAN_BITS * (levels - 1) if levels else 0)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(25)] + [(500, 501 + k) for k in range(80)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 10


def brute_join(docs):
    sets = [frozenset(decontaminate.exact_shingles(t)) for _, t in docs]
    parent, degree = list(range(len(docs))), [0] * len(docs)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= near_dup.THRESHOLD * len(a | b) - 1e-9:
                degree[i] += 1
                degree[j] += 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return degree, [find(i) for i in range(len(docs))]


def near_copies(seed, families, plain):
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(2000)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))) for k in range(plain)]
    shared = " ".join(rng.choice(words) for _ in range(25))
    docs += [(1000 + k, shared + " " + " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))) for k in range(plain)]
    for f, size in enumerate(families):
        base = [rng.choice(words) for _ in range(100)]
        for k in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            docs.append((10_000 * (f + 1) + k, " ".join(w)))
    return docs


@pytest.mark.parametrize("leaf,block", [(64, 256), (6, 20)])
def test_jaccard_join_by_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(near_dup, "LEAF", leaf)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    docs = near_copies(3, [2, 3, 90], 60) + [(1, None), (2, ""), (None, "few words"), (None, "few words"), (9, "Few, words!"), (8, "?!")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, cid string")
    rows = near_dup.jaccard_join(frame).collect()
    degree, group = brute_join(docs)
    by = {}
    for (i, t), n, g in zip(docs, degree, group, strict=True):
        by.setdefault((i, hashlib.md5((t or "").encode()).hexdigest()), set()).add((n, min((docs[k][0] for k in range(len(docs)) if group[k] == g and docs[k][0] is not None), default=None)))
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_links, r.group_id) in by[r.id, r.text_md5], r
    assert sum(r.uid == r.group_uid for r in rows) == len(set(group))
    assert {r.id: r.n_shingles for r in rows if r.id in (1, 2, 8, 9)} == {1: 0, 2: 0, 8: 0, 9: 1}
    assert near_dup.jaccard_join(frame.limit(0)).count() == 0


@pytest.mark.parametrize("depth,runs", [(2, 3), (4, 6), (6, 9)])
def test_found_share_is_what_runs_find(depth, runs):
    """Sketches at the threshold through the module's own choices of tokens, against the law that sets the runs."""
    rng, pairs, hits = np.random.default_rng(depth), 1500, 0
    a = rng.integers(0, 1 << 32, (pairs, near_dup.TOKENS), np.uint32)
    b = np.where(rng.random(a.shape) < near_dup.THRESHOLD, a, rng.integers(0, 1 << 32, a.shape, np.uint32))
    met = np.zeros(pairs, bool)
    for s in near_dup.seeds(runs, 11):
        ends = []
        for x in (a, b):
            at, path = np.arange(pairs), np.full(pairs, s)
            for _ in range(depth):
                row, path = near_dup._choose(path, x[at])
                at = at[row]
            ends.append(set(zip(at.tolist(), path.tolist(), strict=True)))
        met[[i for i, _ in ends[0] & ends[1]]] = True
    hits = (met & ((a == b).sum(1) >= near_dup.CANDIDATE)).mean()
    share = near_dup.found_share(runs, depth)
    assert abs(hits - share) < 4 * np.sqrt(share * (1 - share) / pairs) + 0.005


def test_runs_grow_with_depth():
    runs = [near_dup.runs_for(near_dup.RECALL, d) for d in range(2, 9)]
    assert runs == sorted(set(runs))
    assert all(near_dup.found_share(r, d) >= near_dup.RECALL > near_dup.found_share(r - 1, d) for d, r in zip(range(2, 9), runs, strict=True))
    with pytest.raises(ValueError):
        near_dup.runs_for(1.0, 2)


def test_settled_classes_lose_no_candidate():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x, y, p = rng.integers(0, 3, (3, near_dup.TOKENS))
        y, p = (np.where(rng.random(near_dup.TOKENS) < rng.uniform(0.4, 1), x, v) for v in (y, p))
        if (x == p).sum() >= near_dup.SETTLED and (x == y).sum() >= near_dup.CANDIDATE:
            assert (y == p).sum() >= near_dup.ABSORB


def test_further_runs_for_deep_buckets(spark, monkeypatch):
    """Many texts that share a passage make buckets that are split again and again; what is linked is still found."""
    monkeypatch.setattr(near_dup, "LEAF", 4)
    rng = random.Random(12)
    words = ["w%d" % k for k in range(5000)]
    shared = [rng.choice(words) for _ in range(60)]
    docs = []
    for k in range(120):
        w = shared + [rng.choice(words) for _ in range(60)]
        docs.append((2 * k, " ".join(w)))
        w[-1 - rng.randrange(5)] = "other"
        docs.append((2 * k + 1, " ".join(w)))
    passes = []
    inner = near_dup._links_of_runs

    def counted(classes, sketch_of, most, families=None):
        passes.append(most)
        return inner(classes, sketch_of, most, families)

    monkeypatch.setattr(near_dup, "_links_of_runs", counted)
    rows = {r.id: r for r in near_dup.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    degree, group = brute_join(docs)
    assert sum(rows[i].n_links != n or rows[i].group_id != docs[g][0] for (i, _), n, g in zip(docs, degree, group, strict=True)) <= 1
    assert len(passes) > 1 and passes[0] == near_dup.runs_for(near_dup.RECALL, 2) < min(passes[1:]) and sum(degree) >= 200


def test_jaccard_join_recall(spark, sf):
    """Against all pairs, for every row, on the larger tables."""
    rows = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "text").collect()
    docs = [(r.doc_id, r.text) for r in rows]
    degree, _ = brute_join(docs)
    got = {r.id: r.n_links for r in near_dup.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = dict(zip((i for i, _ in docs), degree, strict=True))
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.99 * sum(want.values()) > 0
