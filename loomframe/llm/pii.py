"""Personal data by four patterns and a skip-chain conditional random field over number- and address-like mentions.

The patterns find the base spans. Looser patterns find mentions, the nodes of the field: whatever looks like a number
of seven or more digits or like an address, with separators in any style. A mention that is a base span is observed
with its kind. Edges run between mentions that follow each other, and, as skip links, between each mention and the next
one with the same digits or letters (or the same last digits), however far apart; loopy message passing then makes
labels of repeated entities agree. Mentions whose marginal passes CALL are added as spans; base spans stay as they are.

All weights (of a mention's features, of label pairs in sequence, and of both kinds of skip links) are fitted together
by penalised pseudo-likelihood: each mention's label given its features and its neighbours' labels, on the mentions of a
bounded sample of documents. Labels come from the patterns. A mention that none of them matches may be an entity in
another style, so it counts UNLABELLED; and each mention is learnt from twice, once with features of its own in place of
those that say how it is written, or else the links would never be needed. Skip weights are drawn to SKIP_PRIOR where
links are rare.

Cases: null and empty texts have no span; texts are read whole, in time linear in their length; repeated rows get equal
spans; of kinds with equal marginals the one listed first is taken; an empty table gives an empty result, and without
mentions to learn from only links to base spans count. Positions are code points, end exclusive. Columns that are kept
pass through; a clash is an error.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+): a match takes runs of digits whole, so it is sought where they begin only.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Mentions: looser than the patterns. Addresses are sought about what joins them.
NUMBER = re.compile(r"\+?\(?[0-9]++(?:[\x20().-]{1,3}[0-9]++)*+")
JOINT = re.compile(r"@|\x20?[\[(]at[\])]\x20?")
HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++")
_DIGIT = re.compile("[0-9]")
LEAST_DIGITS = 7
#: Last digits that make two numbers similar.
SUFFIX = 7
#: Documents that the fit reads at most, in expectation.
SAMPLE_DOCS = 5_000
#: Weights of skip links (same text, same last digits) before any is seen, and how firmly they are believed.
SKIP_PRIOR, SKIP_FIRMNESS = (4.0, 3.0), 20.0
#: What a mention without a pattern counts in the fit.
UNLABELLED = 0.3
RIDGE = 0.5
OBSERVED = 30.0
CALL = 0.6
ROUNDS = 12
STEPS = 400

Span = tuple[int, int, int]  # rank of kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "@" in text:
        out += [(0, a, z) for a, z, _ in _around(text, _AT, _DOMAIN)]
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _around(text: str, joint: re.Pattern, host: re.Pattern) -> Iterator[tuple[int, int, str]]:
    """(start, end, key) of leftmost matches of local part, joint and host, each sought about a joint: what stands
    before it is a run of characters that no joint has a part in, so runs are walked back once."""
    free = 0
    for m in joint.finditer(text):
        if m.start() < free:
            continue
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and (h := host.match(text, m.end())):
            free = h.end()
            yield start, free, text[start : m.start()] + "@" + _DOT.sub(".", h[0])


_AT, _DOMAIN = re.compile("@"), re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOT = re.compile(r"\x20?[\[(]dot[\])]\x20?")
_LOCAL = frozenset(c for c in map(chr, range(128)) if re.match(r"[A-Za-z0-9._%+-]", c))


def mentions(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, digits or letters, whether it is an address) of each mention, in order."""
    out = []
    if "@" in text or "at]" in text or "at)" in text:
        out = [(a, z, key.lower(), True) for a, z, key in _around(text, JOINT, HOST)]
    if _DIGIT.search(text):
        # addresses are in order and apart, so only the first that ends after a number's start can overlap it
        starts, ends = [a for a, *_ in out], [z for _, z, *_ in out]
        for m in NUMBER.finditer(text):
            key = re.sub("[^0-9]", "", m[0])
            if len(key) >= LEAST_DIGITS:
                at = bisect_right(ends, m.start())
                if at == len(starts) or starts[at] >= m.end():
                    out.append((*m.span(), key, False))
    return sorted(out)


#: Words before a mention that speak for a kind.
CUES = {"phone": 0, "tel": 0, "call": 0, "mobile": 0, "fax": 0, "card": 1, "visa": 1, "credit": 1, "ip": 2, "host": 2, "server": 2, "address": 2, "mail": 3, "email": 3, "contact": 3}
#: Features; those from HIDDEN on stand for what sort of mention it is, and how long, where its style is hidden.
HIDDEN = 21
FEATURES = HIDDEN + 8


def feature_ids(text: str, start: int, end: int, key: str, address: bool) -> list[int]:
    s = text[start:end]
    n = len(key)
    out = [0, 1 if address else 2]
    if not address:
        out.append(3 + (0 if n < 8 else 1 if n <= 12 else 2 if n <= 15 else 3 if n <= 19 else 4))
        out += [8] * ("+" in s) + [9] * ("(" in s) + [10] * ("-" in s) + [11] * (" " in s) + [12] * (s.count(".") == 3 and len(s) <= 15) + [13] * ("." in s and s.count(".") != 3)
        if 16 <= n <= 19:
            out.append(14 if luhn(key) else 19)
        out += [20] * (text[start - 1 : start].isalpha() or text[end : end + 1].isalpha())
    before = re.findall(r"[a-z]+", text[max(0, start - 24) : start].lower())[-2:]
    return out + sorted({15 + CUES[w] for w in before if w in CUES})


def observed_kinds(nodes: list, base: list[Span]) -> list[int]:
    """The label of each mention that overlaps a base span (1 + the rank of its kind), 0 for the others."""
    spans = sorted((a, z, kind) for kind, a, z in base)
    # spans of different kinds may overlap, so the furthest end so far decides how far to look back
    furthest, reach = [], 0
    for _, z, _ in spans:
        reach = max(reach, z)
        furthest.append(reach)
    out, first = [], [a for a, *_ in spans]
    for a, z, *_ in nodes:
        k, found = bisect_left(first, z) - 1, []
        while k >= 0 and furthest[k] > a:
            if spans[k][1] > a:
                found.append((min(z, spans[k][1]) - max(a, spans[k][0]), -spans[k][2]))
            k -= 1
        out.append(1 - max(found)[1] if found else 0)
    return out


def skip_links(nodes: list) -> Iterator[tuple[int, int, int]]:
    """(mention, later mention, 0 for the same digits or letters and 1 for the same last digits only)."""
    for sort, keyed in enumerate((lambda m: m[2], lambda m: None if m[3] else m[2][-SUFFIX:])):
        last: dict[str, int] = {}
        for i, m in enumerate(nodes):
            if (key := keyed(m)) is not None:
                if key in last and (sort == 0 or nodes[last[key]][2] != m[2]):
                    yield last[key], i, sort
                last[key] = i


class Field:
    """The fitted field: feature weights by label (0: none, then KINDS), transitions, and the weights of skip links."""

    def __init__(self, weights: np.ndarray, transition: np.ndarray, skip: tuple[float, float]):
        self.weights, self.transition, self.skip = weights, transition, skip

    def added(self, text: str, base: list[Span]) -> list[Span]:
        nodes = mentions(text)
        if not nodes:
            return []
        n, k = len(nodes), len(KINDS) + 1
        own = np.array([self.weights[:, feature_ids(text, *m)].sum(1) for m in nodes])
        observed = np.array(observed_kinds(nodes, base), np.int64)
        own[observed > 0] = -OBSERVED
        own[np.flatnonzero(observed), observed[observed > 0]] = OBSERVED
        edges = [(i, i + 1) for i in range(n - 1)]
        tables = [self.transition] * len(edges)
        for i, j, sort in skip_links(nodes):
            edges.append((i, j))
            tables.append(np.eye(k) * self.skip[sort])
        marginals = beliefs(own, np.array(edges, np.int64).reshape(-1, 2), np.array(tables).reshape(-1, k, k))
        out = []
        for i in np.flatnonzero(observed == 0).tolist():
            kind = int(marginals[i, 1:].argmax())
            if marginals[i, 1 + kind] >= CALL:
                out.append((kind, nodes[i][0], nodes[i][1]))
        return out


def beliefs(own: np.ndarray, edges: np.ndarray, tables: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Marginals by loopy sum-product message passing with damping, for all edges at once."""
    n, k = own.shape
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    potential = np.exp(np.concatenate([tables, tables.transpose(0, 2, 1)]))
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(source), k))
    for _ in range(rounds):
        total = own.copy()
        np.add.at(total, target, message)
        out = total[source] - message[back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.log(np.einsum("ei,eij->ej", out, potential) + 1e-300)
        new -= new.max(1, keepdims=True)
        message = 0.5 * message + 0.5 * new
    total = own.copy()
    np.add.at(total, target, message)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def examples(text: str) -> Iterator[tuple[list[int], int, int, int, list[int], list[int]]]:
    """(features, label, label before or -1, label after or -1, labels of mentions that skip links of each sort lead to)
    of each mention of a text, with labels by the patterns."""
    nodes = mentions(text)
    y = observed_kinds(nodes, base_spans(text))
    linked = [([], []) for _ in nodes]
    for i, j, sort in skip_links(nodes):
        linked[i][sort].append(y[j])
        linked[j][sort].append(y[i])
    for i, m in enumerate(nodes):
        yield feature_ids(text, *m), y[i], y[i - 1] if i else -1, y[i + 1] if i + 1 < len(nodes) else -1, sorted(linked[i][0]), sorted(linked[i][1])


def pseudo_likelihood(theta: np.ndarray, x: np.ndarray, y: np.ndarray, near: np.ndarray, links: np.ndarray, times: np.ndarray) -> tuple[float, np.ndarray]:
    """The penalised negative logarithm and its gradient. x: features; near: (label before, after) in one-hot form;
    links: skip links of each sort by the label they lead to; times: how often a row counts. theta: weights of features,
    transitions and skip links, in that order."""
    k = len(KINDS) + 1
    w, t, s = theta[: k * FEATURES].reshape(k, FEATURES), theta[k * FEATURES : -2].reshape(k, k), theta[-2:]
    score = x @ w.T + near[:, 0] @ t + near[:, 1] @ t.T + np.tensordot(s, links, 1)
    score -= score.max(1, keepdims=True)
    logp = score - np.log(np.exp(score).sum(1, keepdims=True))
    hot = np.eye(k)[y]
    miss = (np.exp(logp) - hot) * times[:, None]
    firm, prior = SKIP_FIRMNESS * (s - SKIP_PRIOR), RIDGE * theta[:-2]
    value = -(logp * hot).sum(1) @ times + 0.5 * (firm @ (s - SKIP_PRIOR) + prior @ theta[:-2])
    grad_t = near[:, 0].T @ miss + (near[:, 1].T @ miss).T
    return float(value), np.concatenate([(miss.T @ x).ravel() + prior[: k * FEATURES], grad_t.ravel() + prior[k * FEATURES :], (links * miss).sum((1, 2)) + firm])


def fit_field(rows: list[tuple[tuple, int]]) -> Field:
    """Fit on (example, how often) by accelerated descent with a growing and shrinking step."""
    k = len(KINDS) + 1
    x, near, links = np.zeros((2 * len(rows), FEATURES)), np.zeros((2 * len(rows), 2, k)), np.zeros((2, 2 * len(rows), k))
    y, times = np.zeros(2 * len(rows), np.int64), np.zeros(2 * len(rows))
    for i, ((ids, label, before, after, same, similar), n) in enumerate(rows):
        for at, own in ((2 * i, ids), (2 * i + 1, [HIDDEN + f for f in ids if f < 8])):
            x[at, own], y[at], times[at] = 1, label, 0.5 * n * (1.0 if label else UNLABELLED)
            for side, other in enumerate((before, after)):
                if other >= 0:
                    near[at, side, other] = 1
            for sort, others in enumerate((same, similar)):
                np.add.at(links[sort, at], list(others), 1)
    theta = np.zeros(k * FEATURES + k * k + 2)
    theta[-2:] = SKIP_PRIOR
    ahead, step, t = theta.copy(), 1.0 / max(1.0, times.sum()), 1.0
    for _ in range(STEPS):
        value, grad = pseudo_likelihood(ahead, x, y, near, links, times)
        while True:
            new = ahead - step * grad
            if step < 1e-15 or pseudo_likelihood(new, x, y, near, links, times)[0] <= value - 0.5 * step * (grad @ grad):
                break
            step /= 2
        t2 = 1.0 if (ahead - new) @ (new - theta) > 0 else (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t2 * (new - theta)
        theta, t, step = new, t2, step * 1.2
    return Field(theta[: k * FEATURES].reshape(k, FEATURES), theta[k * FEATURES : -2].reshape(k, k), (float(theta[-2]), float(theta[-1])))


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE_DOCS) -> Field:
    """Fit on mentions of a sample of distinct texts, drawn by their hash."""
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    total, parts = docs.count(), 1 << 24
    chosen = docs.select(F.col(text).alias("text"), digest.alias("h")).where(F.pmod(F.xxhash64("h"), F.lit(parts)) < int(parts * min(1.0, sample / max(total, 1)))).select("text")
    names = ["ids", "y", "before", "after", "same", "similar"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for batch in batches:
            rows = [e for t in batch.column("text").to_pylist() for e in examples(t or "")]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    # mentions of a bounded sample, equal ones counted
    found = chosen.mapInArrow(run, "ids array<int>, y int, before int, after int, same array<int>, similar array<int>").groupBy(*names).count().collect()
    return fit_field(sorted(((tuple(r["ids"]), r["y"], r["before"], r["after"], tuple(r["same"]), tuple(r["similar"])), r["count"]) for r in found))


def find(docs: DataFrame, field: Field, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, base_spans and spans: arrays of (kind, start, end) by kind as listed, then start."""
    names = ["base_spans", "spans"]
    if clash := {c.lower() for c in keep} & set(names):
        raise ValueError(f"columns {sorted(clash)} exist already")
    sent = docs.sparkSession.sparkContext.broadcast(field)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, span) for n in names])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        named = lambda spans: [{"kind": KINDS[k], "start": a, "end": z} for k, a, z in sorted(spans)]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                base, full = [], []
                for t in part.column(text).to_pylist():
                    b = base_spans(t or "")
                    base.append(named(b))
                    full.append(named([*b, *own.added(t or "", b)]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(base, kind), pa.array(full, kind)], [*keep, *names])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
