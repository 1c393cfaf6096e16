"""A toxicity classifier with counterfactual regularisation.

Logistic regression on words and on how often word beginnings occur. For every labelled text that mentions an identity
term, copies with all its mentions swapped for another term of its group are made, and changes of the logit between a
text and its copies are penalised, over all features that differ, so that neutral mentions of a group, however many, do
not raise the score. Groups go by the text's language; a text whose language has none is swapped by the groups of all.
Without such texts the fit is plain logistic regression: Model.swap_pairs says how many pairs there were.

The fit uses a bounded sample of labelled rows (SAMPLE_ROWS, drawn by a hash of the id); of their features those that
are associated with the label, and those that a swap takes from a text, come to the driver. Scoring is one pass over all
texts.

Cases: null and empty texts have no feature and get the score of the intercept. Several labels of an id count as toxic
if one is; null labels and labels of unknown ids are not used. Without labels, or with one class only, every score is
the smoothed share of toxic labels. Texts are read whole; repeated rows and ties get equal scores; an empty table gives
an empty result. Columns that are kept pass through; a clash with the score's name is an error.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Labelled rows that the fit uses at most, in expectation.
SAMPLE_ROWS = 12_000
#: The z-score of association with the label that a feature of the model needs, if no swap changes it.
LEAST_Z = 3.5
PREFIX = 5
RIDGE = 0.1
#: Weight of the counterfactual penalty.
SWAP_WEIGHT = 5.0
CUT = 0.3
#: Identity terms by language and group, as single lower-case words; a term is swapped for the others of its group.
IDENTITY_GROUPS = {
    "en": (
        ("women", "men"),
        ("woman", "man"),
        ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
        ("black", "white", "asian", "latino", "indigenous"),
        ("gay", "straight", "lesbian", "bisexual", "transgender"),
        ("immigrant", "refugee", "native"),
        ("immigrants", "refugees", "natives"),
        ("disabled", "blind", "deaf"),
        ("old", "young"),
    ),
    "de": (
        ("frauen", "männer"),
        ("frau", "mann"),
        ("muslim", "christ", "jude", "hindu", "buddhist", "atheist"),
        ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
        ("schwarze", "weiße", "asiatische", "indigene"),
        ("schwul", "heterosexuell", "lesbisch", "bisexuell", "transgender"),
        ("einwanderer", "flüchtlinge", "einheimische"),
        ("behindert", "blind", "taub"),
        ("alte", "junge"),
    ),
    "fr": (
        ("femmes", "hommes"),
        ("femme", "homme"),
        ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
        ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
        ("noirs", "blancs", "asiatiques", "indigènes"),
        ("gay", "hétérosexuel", "lesbienne", "bisexuel", "transgenre"),
        ("immigré", "réfugié", "natif"),
        ("immigrés", "réfugiés", "natifs"),
        ("handicapé", "aveugle", "sourd"),
        ("vieux", "jeune"),
    ),
    "es": (
        ("mujeres", "hombres"),
        ("mujer", "hombre"),
        ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
        ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
        ("negros", "blancos", "asiáticos", "indígenas"),
        ("gay", "heterosexual", "lesbiana", "bisexual", "transgénero"),
        ("inmigrante", "refugiado", "nativo"),
        ("inmigrantes", "refugiados", "nativos"),
        ("discapacitado", "ciego", "sordo"),
        ("viejo", "joven"),
    ),
}
_TIERS = ((1, ""), (2, "#2"), (3, "#3"))

Groups = tuple[tuple[str, ...], ...]

_WORD = re.compile(r"\w+")


def features(text: str | None) -> set[str]:
    """Words longer than PREFIX, and beginnings of words (short words whole) that occur, occur twice, and thrice."""
    return features_of(_WORD.findall((text or "").lower()))


def features_of(words: list[str]) -> set[str]:
    starts = Counter(w[:PREFIX] for w in words)
    return {w for w in words if len(w) > PREFIX} | {f"^{p}{mark}" for p, n in starts.items() for tier, mark in _TIERS if n >= tier}


def groups_of(language: str | None, groups: dict[str, Groups] = IDENTITY_GROUPS) -> Groups:
    """The groups of a language (en and en-US alike), those of all languages where it has none."""
    own = groups.get(re.split("[-_]", (language or "").lower())[0])
    return tuple(dict.fromkeys(g for of in groups.values() for g in of)) if own is None else own


def text_swaps(text: str | None, groups: Groups) -> Iterator[tuple[set[str], set[str]]]:
    """(features that a copy loses, features that it gains) for each identity term of the text and each other of its
    group, which takes the place of all mentions of the term in the copy."""
    words = _WORD.findall((text or "").lower())
    present = set(words)
    had = None
    for group in groups:
        for term in present.intersection(group) and [t for t in group if t in present]:
            had = features_of(words) if had is None else had
            for other in group:
                if other != term:
                    has = features_of([other if w == term else w for w in words])
                    if had != has:
                        yield had - has, has - had


@dataclass
class Model:
    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    #: Pairs of a text and a swapped copy in the fit, and those of them that differ in features of the model.
    swap_pairs: int = 0
    penalised_pairs: int = 0
    _prefixes: set[str] | None = None

    def prefixes(self) -> set[str]:
        if self._prefixes is None:
            self._prefixes = {f[1:].partition("#")[0] for f in self.weights if f[0] == "^"}
        return self._prefixes

    def score(self, text: str | None) -> float:
        w, words = self.weights, _WORD.findall((text or "").lower())
        logit = [self.bias, *(w[x] for x in set(words) & w.keys())]
        starts = Counter(x[:PREFIX] for x in words)
        for p in starts.keys() & self.prefixes():
            logit += [w[f] for f in (f"^{p}", f"^{p}#2", f"^{p}#3")[: starts[p]] if f in w]
        logit = sum(sorted(logit))
        return float(1 / (1 + np.exp(-np.clip(logit, -700, 700))))


def fit_rows(rows: list[tuple[int, list[str]]], terms: list[str], swapped: list[tuple[list[str], list[str], int]], swap_weight: float = SWAP_WEIGHT, steps: int = 2_000) -> Model:
    """Fit on (label, features) rows over the given features by accelerated gradient steps.

    swapped: what text_swaps gives for the rows' texts, and how often."""
    y = np.array([label for label, _ in rows], np.float64)
    made = sum(n for *_, n in swapped)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(float(np.log(share / (1 - share))), swap_pairs=made)
    at = {t: k for k, t in enumerate(terms)}
    row, col, pairs, times = [], [], [], []
    for k, (_, names) in enumerate(rows):
        found = [at[n] for n in names if n in at]
        row += [k] * len(found)
        col += found
    for less, more, k in swapped:
        change = {at[n]: -1.0 for n in less if n in at} | {at[n]: 1.0 for n in more if n in at}
        if change:
            pairs.append(change)
            times.append(k)
    row, col = np.array(row, np.int64), np.array(col, np.int64)
    prow = np.array([k for k, p in enumerate(pairs) for _ in p], np.int64)
    pcol = np.array([c for p in pairs for c in p], np.int64)
    pval = np.array([v for p in pairs for v in p.values()], np.float64)
    # twice the penalty's weight of each pair, by entry of the pair
    weigh = np.repeat(2 * swap_weight * np.array(times, np.float64), [len(p) for p in pairs]) if pairs else np.empty(0)
    width = np.array([len(p) for p in pairs for _ in p], np.float64)
    n, m = len(y), len(terms)
    widest = max(np.bincount(row, minlength=n).max(initial=0), 1)
    # a bound of the curvature for each feature: its rows, times the most features that a row has; its pairs, times theirs
    bound = 0.25 * (widest + 1) * np.bincount(col, minlength=m) + RIDGE + np.bincount(pcol, weigh * width, minlength=m)
    bias_bound = 0.25 * (widest + 1) * n
    w, z, t = np.zeros(m), np.zeros(m), 1.0
    b = zb = float(np.log(y.mean() / (1 - y.mean())))
    for _ in range(steps):
        logit = zb + np.bincount(row, z[col], minlength=n)
        miss = 1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y
        grad = np.bincount(col, miss[row], minlength=m) + RIDGE * z
        if len(prow):
            change = np.bincount(prow, pval * z[pcol], minlength=len(pairs))
            grad += np.bincount(pcol, weigh * pval * change[prow], minlength=m)
        new, newb = z - grad / bound, zb - miss.sum() / bias_bound
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t2 * (new - w), newb + (t - 1) / t2 * (newb - b)
        if (new - w) @ grad > 0:
            t2 = 1.0
        w, b, t = new, newb, t2
    return Model(float(b), {name: float(x) for name, x in zip(terms, w.tolist(), strict=True)}, made, sum(times))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS, groups: dict[str, Groups] = IDENTITY_GROUPS, lang: str = "lang", swap_weight: float = SWAP_WEIGHT) -> Model:
    """Fit on a sample of the labelled rows; labels holds what may be learnt from. groups: identity terms by language,
    which is read from the column lang where docs has it; swap_weight: how much a change of a score by a swap counts."""
    if odd := sorted(t for of in groups.values() for g in of for t in g if not _WORD.fullmatch(t) or t != t.lower()):
        raise ValueError(f"not a single lower-case word: {odd}")
    language = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    total = known.count()
    parts = 1 << 24
    sample = known.where(F.pmod(F.xxhash64("id"), F.lit(parts)) < int(parts * min(1.0, rows / max(total, 1))))
    # about `rows` rows of two numbers, whatever the corpus
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), language.alias("lang")).join(F.broadcast(sample), "id")

    listed = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = part.column("text").to_pylist()
                names = [sorted(features(t)) for t in texts]
                pairs = [[{"less": sorted(a), "more": sorted(b)} for a, b in text_swaps(t, groups_of(x, groups))] for t, x in zip(texts, part.column("lang").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(names, listed), pa.array(pairs, pa.list_(pa.struct([("less", listed), ("more", listed)])))], ["y", "names", "swaps"])

    rows_ = materialize(chosen.mapInArrow(run, "y int, names array<string>, swaps array<struct<less: array<string>, more: array<string>>>"), "labelled")
    n, ones = rows_.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    counts = rows_.select("y", F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("df"), F.sum("y").alias("pos"))
    a, c = F.col("pos") + 0.5, F.col("df") - F.col("pos") + 0.5
    b, d = F.lit(ones) - F.col("pos") + 0.5, F.lit(n - ones) - (F.col("df") - F.col("pos")) + 0.5
    z = F.abs(F.log(a * d / (b * c))) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    # a few kinds of differences for each two terms, whatever the number of texts
    kinds = rows_.select(F.explode("swaps").alias("s")).groupBy("s.less", "s.more").count().collect()
    swapped = sorted((list(r["less"]), list(r["more"]), r["count"]) for r in kinds)
    # of what swaps change, features that no sampled text has stay out: they would only share a mention's weight
    changed = sorted({n for less, more, _ in swapped for n in (*less, *more)})
    wanted = (F.col("z") >= LEAST_Z) | F.col("name").isin(changed)
    terms = sorted(r["name"] for r in counts.withColumn("z", z).where(wanted).select("name").collect())
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(terms))

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            own = [sorted(known.intersection(names)) for names in batch.column("names").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(own, listed)], ["y", "names"])

    # the sample, in features of the model
    sampled = sorted((r["y"], r["names"]) for r in rows_.select("y", "names").mapInArrow(among, "y int, names array<string>").collect())
    sent.destroy()
    return fit_rows(sampled, terms, swapped, swap_weight)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """The kept columns and the score, between 0 and 1."""
    if out.lower() in {c.lower() for c in keep}:
        raise ValueError(f"a column {out} exists already")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                s = pa.array([own.score(t) for t in part.column(text).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), s], [*keep, out])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
