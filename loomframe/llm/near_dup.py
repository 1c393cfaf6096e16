"""N-gram Jaccard self-join by chosen paths, over sets of shingles.

1. Every text becomes a set of shingle fingerprints; texts with the same set form a class, and one sketch of TOKENS
   MinHash values stands for the class. A class is the unit from here on, so copies cost nothing more.
2. A run hands each class to the buckets of those of its sketch tokens that a hash of run, path and token picks, 1/0.8
   tokens in expectation, and at once splits these on DEPTH - 1 further tokens. Buckets of up to LEAF classes are
   compared by brute force. Larger ones are split again on further tokens; there every class is also compared with one
   pivot: those that agree with it in ABSORB tokens are linked to it as candidates, and those that agree in SETTLED go
   no deeper. What a settled class agrees with in CANDIDATE tokens agrees with the pivot in at least ABSORB, since equal
   tokens are equal to the pivot's together, so no candidate is lost there.
3. Runs are repeated until a pair at the threshold is found with probability RECALL, over all that is left to chance:
   how many tokens of the sketch agree, whether they are enough for a candidate, and whether paths meet. Deeper paths
   meet less often, so classes whose buckets were split deeper take part in further runs, as many as their depth needs;
   of these, buckets whose classes are all linked to each other already are left out.
4. Candidate links only gather classes into families. Within each family all sets are compared exactly, in blocks of
   bounded size, each block pair a group of its own. What leaves a group is a count for each class and a link to the
   smallest of its component there, so no group's pairs are emitted.

Cases: null and empty texts, and others without a word, link with nothing. A text of one to four words is one shingle.
Repeated rows are copies of each other. Null ids are carried along; an empty table gives an empty result. Only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, chunks, discard, materialize, mix64, seeds, shingle_hashes, shuffled, sized
from .graph import components

THRESHOLD = 0.8
TOKENS = 64
#: Probability that a pair at the threshold is found, and the splits that every path has.
RECALL = 0.999
DEPTH = 2
#: Classes of a bucket that are compared by brute force.
LEAF = 512
#: Sketch tokens that a candidate pair has in common: the threshold's share less 3.5 standard deviations.
CANDIDATE = 40
#: Tokens in common with a pivot from which a class goes no deeper, and from which it joins the pivot's family.
SETTLED = 44
ABSORB = SETTLED + CANDIDATE - TOKENS
#: Classes of a family in one block of the exact comparison, and shingles of its sets, in expectation.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
#: Rows of a block that are compared at once.
STRIP = 128
#: Rows of a level that one task takes, where a level has few, and links that one writes.
ROWS_EACH, LINKS_EACH = 20_000, 100_000

_U = np.uint64


def found_share(runs: int, depth: int) -> float:
    """The probability that a pair at the threshold becomes a candidate in so many runs of paths of this depth.

    The number of tokens that its sketches share follows a binomial law. With n of them a path goes on in both sketches
    by a branching process with Binomial(n, 1 / (0.8 TOKENS)) offspring."""
    total = 0.0
    for n in range(CANDIDATE, TOKENS + 1):
        alive = 1.0
        for _ in range(depth):
            alive = 1 - (1 - alive / (THRESHOLD * TOKENS)) ** n
        total += comb(TOKENS, n) * THRESHOLD**n * (1 - THRESHOLD) ** (TOKENS - n) * (1 - (1 - alive) ** runs)
    return total


def runs_for(recall: float, depth: int) -> int:
    """Runs until a pair at the threshold is found with this probability."""
    if recall >= found_share(1 << 20, depth):
        raise ValueError(f"sketches of {TOKENS} tokens can't reach a recall of {recall}")
    runs = 1
    while found_share(runs, depth) < recall:
        runs += 1
    return runs


# --- sets and sketches


def _unique(h: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints of each text, in order, and their bounds."""
    doc = np.repeat(np.arange(len(b) - 1), np.diff(b))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(b)))


def sketches(texts: list[str | None]) -> Iterator[tuple[int, int, int, bytes]]:
    """(two words of the set's identity, its size, its sketch) of each text."""
    a, c = seeds(TOKENS, 5) | _U(1), seeds(TOKENS, 6)
    for x, z in chunks(texts):
        h, b = _unique(*shingle_hashes(texts[x:z]))
        full = np.flatnonzero(np.diff(b))
        least = np.zeros((len(b) - 1, TOKENS), np.uint32)
        one, two = (np.zeros(len(b) - 1, np.int64) for _ in range(2))
        if len(full):
            at = b[:-1][full]
            for k in range(TOKENS):
                least[full, k] = np.minimum.reduceat(((h * a[k] + c[k]) >> _U(32)).astype(np.uint32), at)
            one[full] = np.add.reduceat(mix64(h), at).view(np.int64)
            two[full] = np.add.reduceat(mix64(h ^ _U(0xA5A5A5A5A5A5A5A5)), at).view(np.int64)
        for i, n in enumerate(np.diff(b).tolist()):
            yield int(one[i]), int(two[i]), n, least[i].tobytes()


def with_sketches(rows: DataFrame) -> DataFrame:
    """uid, id, text_md5 and the sketch columns of rows with uid, id, text_md5 and text."""
    names = ["uid", "id", "text_md5"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                one, two, n, s = zip(*sketches(part.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(n, pa.int32()), pa.array(s, pa.binary())],
                    [*names, "one", "two", "n", "sketch"],
                )

    return rows.mapInArrow(run, "uid long, id long, text_md5 string, one long, two long, n int, sketch binary")


# --- chosen paths


def _choose(paths: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, new path) of every token that a path picks; a token is picked with probability 1 / (0.8 TOKENS)."""
    token = mix64(sketch.astype(_U) + (np.arange(TOKENS, dtype=_U)[None, :] << _U(32)))
    new = mix64(token ^ paths[:, None])
    row, col = np.nonzero(mix64(new ^ _U(0x51ED270B)) < _U(int(2**64 / (THRESHOLD * TOKENS))))
    return row, new[row, col]


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def first_paths(classes: DataFrame, most: int) -> DataFrame:
    """path and cid of classes with cid, sketch and their runs: those from first_run to before end_run."""
    start = seeds(most, 11)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                cid, sketch = part.column("cid").to_numpy(), _matrix(part.column("sketch"))
                first, end = part.column("first_run").to_numpy(), part.column("end_run").to_numpy()
                for r in range(int(first.min()), int(end.max())):
                    at = np.flatnonzero((first <= r) & (r < end))
                    path = np.full(len(at), start[r])
                    for _ in range(DEPTH):
                        row, path = _choose(path, sketch[at])
                        at = at[row]
                    yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(cid[at])], ["path", "cid"])

    return classes.select("cid", "sketch", "first_run", "end_run").mapInArrow(run, "path long, cid long")


def _lowest(similar: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each row's component under a symmetric relation on a few thousand rows, a strip at a time."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int32)
    rank[order] = np.arange(len(ids), dtype=np.int32)
    label = rank.copy()  # the rank of the smallest member known so far, of each row
    while True:
        new = label.copy()
        for k in range(0, len(ids), STRIP):
            near = np.where(similar[k : k + STRIP], label[None, :], np.int32(len(ids))).min(1, initial=len(ids))
            new[k : k + STRIP] = np.minimum(new[k : k + STRIP], near)
        new = np.minimum(new, new[order[new]])
        if (new == label).all():
            return ids[order[label]]
        label = new


def leaf_links(leaves: DataFrame, rows: int) -> DataFrame:
    """Candidate links (a, b) of small buckets, from at most so many rows of path, cid and sketch. Buckets come one after
    another, so that a task holds a batch of rows and the bucket that goes on in the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            path = batch.column("path").to_numpy()
            begins = np.flatnonzero(path[1:] != path[:-1]) + 1
            held = batch.slice(begins[-1]) if len(begins) else batch
            if len(begins):
                yield _links_of(batch.slice(0, begins[-1]))
        if held is not None and held.num_rows:
            yield _links_of(held)

    dealt = sized(leaves.select("path", "cid", "sketch").repartition("path"), rows, ROWS_EACH).sortWithinPartitions("path")
    return dealt.mapInArrow(run, "a long, b long")


def _links_of(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Links between the members of whole buckets, each to the smallest of its component in the bucket."""
    path, cid, sketch = rows.column("path").to_numpy(), rows.column("cid").to_numpy(), _matrix(rows.column("sketch"))
    at = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1])
    size = np.diff(np.append(at, len(path)))
    two = at[size == 2]
    near = (sketch[two] == sketch[two + 1]).sum(1) >= CANDIDATE
    a, b = cid[two[near]], cid[two[near] + 1]
    links = set(zip(np.maximum(a, b).tolist(), np.minimum(a, b).tolist(), strict=True))
    for p, n in zip(at[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        s, own = sketch[p : p + n], cid[p : p + n]
        low = _lowest((s[:, None, :] == s[None, :, :]).sum(2) >= CANDIDATE, own)
        links.update((x, y) for x, y in zip(own.tolist(), low.tolist(), strict=True) if x != y)
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _split(rows: DataFrame) -> DataFrame:
    """Rows of large buckets (path, cid, sketch, pivot and its sketch) with the number of tokens that a class shares with
    the pivot, as likeness: one for each path that a class goes on by, and one without a path for a class that doesn't."""
    kinds = "path long, cid long, sketch binary, pivot long, likeness long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4000):
                part = batch.slice(k, 4000)
                sketch = _matrix(part.column("sketch"))
                like = (sketch == _matrix(part.column("pivot_sketch"))).sum(1)
                on = np.flatnonzero(like < SETTLED)
                row, path = _choose(part.column("path").to_numpy()[on].view(_U), sketch[on])
                ends = np.ones(len(like), bool)
                ends[on[row]] = False
                ends, row = np.flatnonzero(ends), on[row]
                names, at = ["cid", "sketch", "pivot"], np.concatenate([row, ends])
                paths = pa.array(np.concatenate([path.view(np.int64), np.zeros(len(ends), np.int64)]), mask=np.arange(len(at)) >= len(row))
                kept = part.select(names).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([paths, *kept.columns, pa.array(like[at])], ["path", *names, "likeness"])

    return rows.mapInArrow(run, kinds)


def candidate_links(classes: DataFrame, recall: float = RECALL) -> DataFrame:
    """Candidate links (a, b) between classes with cid and sketch."""
    sketch_of = classes.select("cid", "sketch")
    runs, n_classes = runs_for(recall, DEPTH), classes.count()
    now, most, links, families = sketch_of.withColumns({"first_run": F.lit(0), "end_run": F.lit(runs), "depth": F.lit(DEPTH)}), runs, [], None
    while True:
        found, deep, tables = _links_of_runs(now, sketch_of, most, families)
        links += found
        if not deep:
            break
        # classes of buckets that were split deeper than theirs so far take part in the runs that this depth needs
        reached = reduce(DataFrame.union, deep).groupBy("cid").agg(F.max("depth").alias("reached"))
        deeper = materialize(sized(reached.join(now, "cid").where("reached > depth"), n_classes, ROWS_EACH), "deeper")
        discard(*tables)
        top = deeper.agg(F.max("reached")).first()[0]
        if top is None:
            break
        needed = F.create_map(*(F.lit(x) for d in range(DEPTH, top + 1) for x in (d, runs_for(recall, d))))
        now = deeper.select("cid", "sketch", F.col("end_run").alias("first_run"), needed[F.col("reached")].alias("end_run"), F.col("reached").alias("depth"))
        most = runs_for(recall, top)
        # a family is compared exactly later on, so further runs are for pairs of different ones
        families = materialize(sized(_families_so_far(reduce(DataFrame.union, links)), n_classes, LINKS_EACH), "families-so-far")
    return reduce(DataFrame.union, links)


def _families_so_far(links: DataFrame) -> DataFrame:
    """cid and family: the smallest class that one or two links lead to. Classes of one family are linked, if not all
    linked classes are of one family; finding those takes the rounds that only the last links are worth."""
    least = links.groupBy("a").agg(F.min("b").alias("b"))
    further = least.select(F.col("a").alias("mid"), F.col("b").alias("end"))
    return least.join(further, F.col("b") == F.col("mid"), "left").select(F.col("a").alias("cid"), F.coalesce("end", "b").alias("family"))


def _links_of_runs(classes: DataFrame, sketch_of: DataFrame, most: int, families: DataFrame | None = None) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """(candidate links, a table for each level; classes and depths of buckets that were split; the tables that hold
    these) of some runs. Buckets of one family alone are left out."""
    paths, links, deep, tables, depth = materialize(first_paths(classes, most), "paths"), [], [], [], DEPTH
    begin = paths
    while True:
        # the pivot is drawn by a hash of the class alone: buckets of a family tend to have the same, and so the same links
        known = paths.select("path", "cid") if families is None else paths.select("path", "cid").join(families, "cid", "left")
        own = F.lit(None).cast("long") if families is None else F.coalesce("family", "cid")
        found = known.groupBy("path").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("cid").alias("h"), "cid")).alias("p"), (F.min(own) == F.max(own)).alias("one")).where("n > 1 and one is not true")
        buckets = materialize(found.select("path", "n", F.col("p.cid").alias("pivot")), "buckets")
        large = buckets.where(F.col("n") > LEAF)
        deepens = not large.isEmpty()
        # a large bucket brings its pivot's sketch along, so that its rows are joined once
        pivot_sketch = sketch_of.select(F.col("cid").alias("pivot"), F.col("sketch").alias("pivot_sketch"))
        given = buckets.where(F.col("n") <= LEAF).withColumn("pivot_sketch", F.lit(None).cast("binary"))
        if deepens:
            given = given.union(large.join(pivot_sketch, "pivot").select(given.columns))
        members = paths.join(shuffled(given), "path")
        # rows that are alone in their bucket are gone before sketches are fetched
        members = members if "sketch" in paths.columns else members.join(shuffled(sketch_of), "cid")
        # sketches are fetched from all classes, however few of them have paths
        most_rows = paths.count() + (0 if "sketch" in paths.columns else sketch_of.count())
        members = materialize(sized(members.select("path", "cid", "n", "pivot", "sketch", "pivot_sketch"), most_rows, ROWS_EACH), "members")
        most_rows = members.count()
        near, split = leaf_links(members.where(F.col("n") <= LEAF), most_rows), None
        if deepens:
            met = members.where(F.col("n") > LEAF).select("path", "cid", "sketch", "pivot", "pivot_sketch")
            split = materialize(_split(sized(met, most_rows, ROWS_EACH)), "split")
            tables.append(split)
            absorbed = split.where((F.col("likeness") >= ABSORB) & (F.col("cid") != F.col("pivot")))
            near = near.union(absorbed.select(F.greatest("cid", "pivot").alias("a"), F.least("cid", "pivot").alias("b")).distinct())
        links.append(materialize(sized(near, most_rows, LINKS_EACH) if split is not None else near, "links"))
        discard(members, buckets)
        if split is None:
            break
        depth += 1
        deep.append(split.where(F.col("likeness") < SETTLED).select("cid", F.lit(depth).alias("depth")))
        paths = split.where("path is not null").select("path", "cid", "sketch")
        if paths.isEmpty():
            break
    discard(begin)
    return links, deep, tables


# --- exact comparison within families


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections; only fingerprints of two or more sets count, a stretch of them at a time."""
    n = np.array([len(s) for s in sets])
    values, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    keep = times[inverse] > 1
    row, col = np.repeat(np.arange(len(sets)), n)[keep], place[inverse[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out, wide = np.zeros((len(sets), len(sets)), np.float32), 1024
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, wide):
        p, q = np.searchsorted(col, [at, at + wide])
        m = np.zeros((len(sets), wide), np.float32)
        m[row[p:q], col[p:q] - at] = 1
        out += m @ m.T
    np.fill_diagonal(out, n)
    return out


def compared(blocks: DataFrame, threshold: float) -> DataFrame:
    """cid, n_links, low (the smallest cid of its component within the group) and whether the family has more blocks, of
    rows with family, blocks, i, j, side, cid, copies and the set; side is 0 for the rows of block i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, ["family", "i", "j"]):
            cid, copies = group.column("cid").to_numpy(), group.column("copies").to_numpy()
            sets = [np.frombuffer(x, _U) for x in group.column("shingles").to_pylist()]
            n, side = np.array([len(s) for s in sets], np.float64), group.column("side").to_numpy()
            both, near, links = _overlaps(sets), np.zeros((len(sets), len(sets)), bool), np.zeros(len(sets), np.int64)
            del sets
            across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
            for k in range(0, len(n), STRIP):
                shared = both[k : k + STRIP].astype(np.float64)
                strip = shared >= threshold * (n[k : k + STRIP, None] + n[None, :] - shared) - 1e-9
                if across:
                    strip &= side[k : k + STRIP, None] != side[None, :]
                strip[np.arange(len(strip)), np.arange(k, k + len(strip))] = False
                near[k : k + STRIP] = strip
                links[k : k + STRIP] = strip @ copies
            many = group.column("blocks")[0].as_py() > 1
            columns = [pa.array(cid), pa.array(links), pa.array(_lowest(near, cid)), pa.array([many] * len(cid))]
            yield pa.RecordBatch.from_arrays(columns, ["cid", "n_links", "low", "many"])

    return blocks.mapInArrow(run, "cid long, n_links long, low long, many boolean")


def _in_blocks(members: DataFrame) -> DataFrame:
    """A row for each block pair that a member takes part in, which is one for each block of its family."""
    blocks = F.col("blocks")
    own = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), (own > j).cast("int").alias("side")))
    return members.withColumn("b", F.explode(pairs)).select("family", "blocks", "b.i", "b.j", "b.side", "cid", "copies", "shingles")


def _with_shingles(members: DataFrame) -> DataFrame:
    names = ["family", "blocks", "cid", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for x, z in chunks(texts):
                h, b = _unique(*shingle_hashes(texts[x:z]))
                sets = [h[b[i] : b[i + 1]].tobytes() for i in range(z - x)]
                part = batch.slice(x, z - x)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "shingles"])

    return members.mapInArrow(run, "family long, blocks int, cid long, copies long, shingles binary")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """id, text_md5, uid, group_uid, group_id, n_links, copies and n_shingles of every row.

    uid numbers the rows, group_uid is the smallest uid that links lead to, group_id the smallest id of that group,
    n_links how many other rows a row is linked to directly, copies the rows with its very set."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_md5"), F.col(text).alias("text"))
    rows = materialize(with_sketches(rows), "sketches")
    n_rows = rows.count()
    sets = rows.where("n > 0").groupBy("one", "two").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.min(F.struct("uid", "id", "text_md5", "sketch")).alias("first"))
    classes = materialize(sized(sets.select("one", "two", "copies", "n", F.col("first.uid").alias("cid"), "first.id", "first.text_md5", "first.sketch"), n_rows, ROWS_EACH), "classes")

    families = components(candidate_links(classes, recall)).select(F.col("node").alias("cid"), F.col("component").alias("family"))
    families = materialize(sized(families.join(shuffled(classes.select("cid", "n", "copies", "id", "text_md5")), "cid"), n_rows, ROWS_EACH), "families")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    members = families.join(families.groupBy("family").agg(blocks.alias("blocks")), "family")

    # the class of a text is that of its id and digest, which find it again: dealt by these, copies need no further shuffle
    key = [F.coalesce("id", F.lit(0)).alias("k"), F.col("id").isNull().alias("z"), "text_md5"]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_md5")).select(*key, "text")
    wanted = members.select(*key, "family", "blocks", "cid", "copies")
    found = texts.join(shuffled(wanted), ["k", "z", "text_md5"]).dropDuplicates(["k", "z", "text_md5"]).select("family", "blocks", "cid", "copies", "text")
    blocks = _in_blocks(_with_shingles(found)).repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    results = materialize(compared(blocks, threshold), "compared")
    # a family in one block is settled there; the others' blocks are put together
    split = results.where("many and low < cid").select("cid", F.col("low").alias("b"))
    joined = results.groupBy("cid").agg(F.sum("n_links").alias("n_links"), F.min("low").alias("component"))
    if not split.isEmpty():
        together = components(split)
        joined = joined.join(together, F.col("cid") == F.col("node"), "left").select("cid", "n_links", F.coalesce(together.component, joined.component).alias("component"))
    per_class = classes.select("one", "two", "copies", "n", "cid").join(joined, "cid", "left")
    per_class = per_class.select("one", "two", "copies", F.col("n").alias("n_shingles"), F.coalesce("component", "cid").alias("component"), (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    base = rows.where("n > 0").select("uid", "id", "text_md5", "one", "two").join(shuffled(per_class), ["one", "two"]).select("uid", "id", "text_md5", "component", "n_links", "copies", "n_shingles")
    alone = rows.where("n = 0").select("uid", "id", "text_md5", F.col("uid").alias("component"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("copies"), F.lit(0).alias("n_shingles"))
    every = materialize(sized(base.union(alone), n_rows, ROWS_EACH), "grouped")
    # written first, so that a large component's rows can be split over tasks where they meet it
    least = materialize(sized(every.groupBy("component").agg(F.min("id").alias("group_id"), F.min("uid").alias("group_uid")), n_rows, LINKS_EACH), "least")
    return every.join(shuffled(least), "component").select("id", "text_md5", "uid", "group_uid", "group_id", "n_links", "copies", "n_shingles")

