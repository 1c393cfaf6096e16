"""Operators 11 to 13 against brute force on small tables."""

import hashlib
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from loomframe.llm import filter_audit, manifest, reputation

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- 11


def test_probability_over_the_cut(spark):
    cases = [(a, b, t) for a, b in ((0.02, 0.5), (0.3, 0.7), (1.0, 1.0), (2.5, 9.0), (40.0, 80.0), (900.0, 2100.0), (3e5, 7e5), (1e-3, 1e-3)) for t in (0.3,)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in cases], "a double, b double")
    got = {(r["a"], r["b"]): r["p"] for r in rows.select("a", "b", reputation.rate_over(F.col("a"), F.col("b"), 0.3).alias("p")).collect()}
    for a, b, t in cases:
        # the same integral over the logit, on a very fine grid about the peak and far into both tails
        u = np.log(a / b) + np.sqrt(1 / a + 1 / b) * np.sinh(np.linspace(-9, 9, 400_001))
        f = np.exp(a * u - (a + b) * np.logaddexp(0, u) - (a * np.log(a / b) - (a + b) * np.logaddexp(0, np.log(a / b))))
        mass = np.diff(u) * (f[1:] + f[:-1]) / 2
        assert abs(got[a, b] - mass[(u[1:] + u[:-1]) / 2 > np.log(t / (1 - t))].sum() / mass.sum()) < 2e-4
    assert abs(got[1.0, 1.0] - 0.7) < 1e-9


def test_parts_of_urls(spark):
    urls = ["HTTP://User@Blog.Example.CO.UK:80/A/b?q#f", "no scheme", None, "", "x://", "a://b://c/d", "http://1.2.3.4/x", "http://localhost?x", "http://ÄX.de#f", "http://example.net"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("host", reputation.host_of(F.col("url")))
    got = [(r["host"], r["path"], r["domain"], r["suffix"]) for r in rows.select("host", reputation.path_of(F.col("url")).alias("path"), reputation.domain_of(F.col("host")).alias("domain"), reputation.suffix_of(F.col("host")).alias("suffix")).collect()]
    assert got == [
        ("user@blog.example.co.uk:80", "/A/b", "example.co.uk", "co.uk"), ("", "", "", ""), ("", "", "", ""), ("", "", "", ""), ("", "", "", ""), ("b:", "//c/d", "b", "b"),
        ("1.2.3.4", "/x", "1.2.3.4", "1.2.3.4"), ("localhost", "", "localhost", "localhost"), ("Äx.de", "", "Äx.de", "de"), ("example.net", "", "example.net", "net"),
    ]


def test_rules_and_reputation(spark):
    pages = [(k, f"http://bad.example.com/{k}") for k in range(60)] + [(k, f"http://good.example.com/{k}") for k in range(60, 160)] + [
        (200, "http://new.example.com/"), (201, "https://a.example.net/en/x"), (202, "https://a.example.net/de/x"), (203, "https://xexample.com/de/"), (204, "https://example.com/de/y"), (205, "http://b.org/fr/"), (206, None), (None, "http://bad.example.com/"), (207, "http://c.net"), (207, "http://c.net"),
    ]
    outcomes = [(k, k < 55 or 100 < k < 110) for k in range(150)] + [(1, False), (None, True), (160, None)]
    p = spark.createDataFrame(pages, "page_id long, url string").withColumns({"host": F.lit(1), "id": F.lit(2), "n": F.lit(3)})
    rows = reputation.judge(p, spark.createDataFrame(outcomes, "id long, bad boolean")).collect()
    got = {r["id"]: (r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == len(pages) and got[3] == (None, "block") and got[None] == (None, "block") and got[70] == (None, "allow") and got[200] == (None, "allow")
    assert [got[k] for k in range(201, 208)] == [("example.net/en/", "allow"), ("net/", "block"), (None, "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow")]
    assert {(r["n_labelled"], r["n_bad"]) for r in rows if r["host"] == "bad.example.com"} == {(60, 55)}
    none = reputation.judge(p.where("false"), spark.createDataFrame([], "id long, bad boolean"))
    assert none.isEmpty() and {r["verdict"] for r in reputation.judge(p.where("page_id < 50"), spark.createDataFrame([], "id long, bad boolean")).collect()} == {"allow"}


# --- 12


def _bits(doc, docs):
    t = doc[1] or ""
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ") if w]
    copy = doc[0] is not None and any(d[0] is not None and d[0] < doc[0] and (d[1] or "") == t for d in docs)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), copy]


def test_audit_by_brute_force(spark):
    base = " ".join(f"w{k}" for k in range(210))
    texts = [base, base, None, "", "A B#", base.upper(), "same " * 300, "same\xa0word\u2003x " * 250, base + " $", base + " é\x0bx", "x\ty|" * 40, "long " * 200_000 + "Z"]
    docs = [(k, texts[k % len(texts)], [None, "", "en", "de"][k % 4]) for k in range(30)] + [(None, base, "en"), (0, base, "de"), (3, texts[3], "de")]
    labels = [(k, k % 2, k % 3 % 2) for k in range(20)] + [(4, 1, None), (None, 1, 1), (99, 1, 1)]
    d = spark.createDataFrame([(*x, "n", k) for k, x in enumerate(docs)], "doc_id long, text string, lang string, part string, own int")
    rows = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    marked = [(x, _bits(x, docs)) for x in docs]
    want, removed_by = {}, {}
    for part in ("", "en", "de"):
        mine = [(x, b) for x, b in marked if (x[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                f = "ABCDE".index(letter)
                gone, kept = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                failing = sum(b[f] for _, b in mine)
                want[part, order, step] = [len(kept), len(gone), failing - len(gone), sum(b[f] and sum(b) == 1 for _, b in mine), sum(x[0] in good for x, _ in gone), sum(x[0] in toxic for x, _ in gone)]
                removed_by[part, letter] = removed_by.get((part, letter), 0) + len(gone)
                left = kept
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")] for r in rows}
    assert got == want and len(rows) == 3 * 600
    assert all(r["shapley"] == removed_by[r["part"], r["filter_order"][r["step"] - 1]] for r in rows)
    assert filter_audit.audit(d.where("false"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).isEmpty()


# --- 13


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, source, lang, n_chars, text):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _fold(level, place, h):
    """(root of a list of digests, siblings of a place, root with another digest there)"""
    siblings = []
    while len(level) > 1:
        other = level[place ^ 1] if (place ^ 1) < len(level) else None
        if other is not None:
            siblings.append(other)
        h = _h(h) if other is None else _h(other, h) if place % 2 else _h(h, other)
        level = [_h(*level[k : k + 2]) for k in range(0, len(level), 2)]
        place //= 2
    return level[0], siblings, h


def test_manifest_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BROADCAST_NODES", 40)  # both forms of the join
    sizes = {None: 1, "de": 2, "en": 700, "ß": 5, "fr": 257, "z": 3}
    docs = [(k * 3, f"text {k} ü" if k % 5 else None, lang, None if k % 4 else "", k if k % 6 else None) for lang, n in sizes.items() for k in range(n)]
    docs += [(None, "", "z", None, 1), (None, "x", "z", None, 2), (6, "text 2 ü", "z", "", 2), (6, "text 2 ü", "z", "", 2)]
    d = spark.createDataFrame(docs, DOCS).withColumns({"part": F.lit(1), "pos": F.lit(2), "hash": F.lit("h")}).repartition(7)
    rows = manifest.manifest(d, {"n_chars": F.col("n_chars") + F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0)}).collect()
    parts = {}
    for i, t, lang, s, n in docs:
        claim = None if n is None else n + (i is not None and i % 2 == 0)
        parts.setdefault(lang, []).append((i, _leaf(i, s, lang, n, t), _leaf(i, s, lang, claim, t)))
    langs = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {lang: sorted(parts[lang], key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for lang in langs}
    subroots = [_fold([r[1] for r in ordered[lang]], 0, "")[0] for lang in langs]
    want = []
    for at, lang in enumerate(langs):
        level = [r[1] for r in ordered[lang]]
        for place, (i, leaf, claim) in enumerate(ordered[lang]):
            sub, low, folded = _fold(level, place, claim)
            root, high, top = _fold(subroots, at, folded)
            want.append((str(i), leaf, sub, root, _h(*low, *high), top, top == root))
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    got = sorted((str(r["doc_id"]), *(r[c] for c in names)) for r in rows)
    # rows that repeat are equal leaves, in any order
    assert got == sorted(want) and {r["verified"] for r in rows} == {True, False}


def test_manifest_of_little(spark):
    assert manifest.manifest(spark.createDataFrame([], DOCS)).isEmpty()
    (row,) = manifest.manifest(spark.createDataFrame([(1, "x", "en", "s", 1)], DOCS)).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == _h() and row["verified"]
