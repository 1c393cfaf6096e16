"""Near-duplicate vectors by an exact metric range join.

On unit vectors a cosine of at least t is a distance of at most r = sqrt(2 - 2 t). A label is a cell at first. Cells of
more than CELL vectors are cut by up to FAN pivots drawn from them: a vector's home is its nearest pivot. By the triangle
inequality a vector x of home i can only have a partner in cell j if d(x, p_j) - d(x, p_i) <= 2 r, and, distances being
Euclidean, if x is within r of the plane between the two pivots; it visits the later cells for which both hold. So each
pair within r meets in exactly one cell. What is still too large is cut again, level by level, with pivots of its own, so
that their number grows with the data and cells do not. A visitor's mark of each level goes along: two vectors that both
visit on one level have met, or will, elsewhere. A cell stays whole where cutting would not spare half of its comparisons,
as with vectors that are all alike or without structure; such cells are compared in block pairs of bounded size. Cells
are joined independently.

Equal vectors of a label form a class and are compared once. What leaves a block is a count for each class and a link to
the smallest of its component there, so that a dense cell emits no pairs.

Cases: vectors that are null, zero, or hold null or non-finite components, and those with a null label, link with nothing
and are components of their own. Labels of any type are compared as text. Repeated rows are copies of each other; vectors
of different lengths never link. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_group, materialize
from .graph import components

THRESHOLD = 0.93
#: Vectors of a cell that is not cut, and pivots that cut a cell at least and at most, in expectation.
CELL, LEAST_FAN, FAN = 1_500, 8, 16
#: Pivots that tasks hold at once; a level with more is cut in parts.
PIVOTS = 16_384
#: A cell is cut if the parts have at most so much of its comparisons.
SPARED = 0.5
#: A cell's number holds the place at each level, FAN_BITS wide (a hash may draw more pivots than FAN).
LEVELS, FAN_BITS = 10, 6
#: Components of the vectors of a block, about, and comparisons made at once.
BLOCK, STEP = 2_000_000, 4_000_000

_CELL = ["label", "dim", "cell"]
_ROW = [*_CELL, "marks", "cid", "copies", "vector"]
_KINDS = "label string, dim int, cell long, marks long, cid long, copies long, vector array<double>"


def _unit(values, dim: int) -> np.ndarray:
    x = np.asarray(values, np.float64).reshape(-1, dim)
    # scaled first, so that neither large nor tiny components overflow or vanish
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def lowest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest id of each row's component; a, b: linked rows."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    label = np.arange(len(ids))
    x, y = rank[a], rank[b]
    while True:
        new = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == label).all():
            return ids[order][label[rank]]
        label = new


def _pivots() -> Column:
    """Pivots that a cell is given, in expectation; with the least number, a draw of fewer than two is rare."""
    return F.greatest(F.lit(LEAST_FAN), F.least(F.lit(FAN), F.ceil(F.col("size") * 2 / CELL)))


def pivots_of(rows: DataFrame, wanted: DataFrame) -> dict[tuple, np.ndarray]:
    """Unit pivots of the wanted cells (with size): a sample drawn by a hash, PIVOTS of them in expectation at most."""
    share = _pivots() * (1 << 24) / F.col("size")
    drawn = rows.join(wanted, _CELL).where(F.pmod(F.xxhash64("cid", "cell"), F.lit(1 << 24)) < share)
    first = drawn.groupBy(*_CELL, "cid").agg(F.first("vector").alias("vector"))
    found: dict[tuple, list] = {}
    for r in sorted(first.collect(), key=lambda r: r["cid"]):
        found.setdefault((r["label"], r["dim"], r["cell"]), []).append(r["vector"])
    return {k: _unit(v[: 1 << FAN_BITS], k[1]) for k, v in found.items() if len(v) > 1}


def cells(units: np.ndarray, pivots: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, int, bool]]:
    """(rows, cell, whether they visit it)."""
    d2 = np.maximum(0.0, 2 - 2 * units @ pivots.T)
    d, home = np.sqrt(d2), d2.argmin(1)
    gap = np.sqrt(np.maximum(0.0, 2 - 2 * pivots @ pivots.T))
    own = np.arange(len(units))
    near = d - d[own, home][:, None] <= 2 * radius + 1e-7
    near &= d2 - d2[own, home][:, None] <= 2 * gap[home] * radius + 1e-7
    near &= np.arange(len(pivots))[None, :] > home[:, None]
    for j in range(len(pivots)):
        yield np.flatnonzero(home == j), j, False
        yield np.flatnonzero(near[:, j]), j, True


def _dealt(batches: Iterator[pa.RecordBatch], pivots: dict[tuple, np.ndarray], radius: float) -> Iterator[tuple[tuple, pa.RecordBatch, np.ndarray, int, bool]]:
    """(cell's key, rows, places of those that go to a part of the cell, number of the part, whether they visit it) of the
    rows of cells that have pivots."""
    for batch in batches:
        place: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in _CELL), strict=True)):
            place.setdefault(key, []).append(i)
        for key in sorted(place.keys() & pivots.keys()):
            part, at_once = batch.take(pa.array(place[key])), max(1, STEP // (8 * key[1]))
            for k in range(0, part.num_rows, at_once):
                some = part.slice(k, at_once)
                for at, cell, visits in cells(_unit(some.column("vector").flatten().to_numpy(), key[1]), pivots[key], radius):
                    if len(at):
                        yield key, some, at, cell, visits


def part_sizes(rows: DataFrame, pivots: dict[tuple, np.ndarray], radius: float) -> DataFrame:
    """label, dim, cell, part and n: how many rows each part of a cell would have."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, int] = {}
        for key, _, at, cell, _ in _dealt(batches, sent.value, radius):
            n[*key, cell] = n.get((*key, cell), 0) + len(at)
        columns = list(zip(*(k for k in n), strict=True)) or [[]] * 4
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(list(n.values()), pa.int64())], [*_CELL, "part", "n"])

    return rows.select(*_ROW).mapInArrow(run, "label string, dim int, cell long, part int, n long").groupBy(*_CELL, "part").agg(F.sum("n").alias("n"))


def assign(rows: DataFrame, pivots: dict[tuple, np.ndarray], radius: float, level: int) -> DataFrame:
    """The rows of the cells that have pivots, in their new cells."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, some, at, cell, visits in _dealt(batches, sent.value, radius):
            own = some.take(pa.array(at))
            marks = own.column("marks").to_numpy() | (1 << level if visits else 0)
            columns = [own.column("label"), own.column("dim"), pa.array([key[2] << FAN_BITS | cell + 1] * len(at), pa.int64()), pa.array(marks, pa.int64()), *(own.column(c) for c in ("cid", "copies", "vector"))]
            yield pa.RecordBatch.from_arrays(columns, _ROW)

    return rows.select(*_ROW).mapInArrow(run, _KINDS)


def into_cells(rows: DataFrame, radius: float) -> list[DataFrame]:
    """The rows in cells that need no cut or can't be cut well, in parts."""
    ready, now = [], rows.withColumns({"cell": F.lit(0).cast("long"), "marks": F.lit(0).cast("long")}).select(*_ROW)
    for level in range(LEVELS):
        sizes = materialize(now.groupBy(*_CELL).agg(F.count("*").alias("size")), "cell-sizes")
        large = sizes.where(F.col("size") > CELL)
        total = large.agg(F.sum(_pivots())).first()[0]
        if not total:
            break
        parts, cut, good = -(-total // PIVOTS), [], []
        dealt = large.withColumn("part", F.pmod(F.xxhash64(*_CELL), F.lit(parts)).cast("int"))
        if parts > 1:
            # rows are dealt to the parts once, so that a level reads each of them once, however many parts there are
            held = materialize(now.join(dealt.select(*_CELL, "part"), _CELL), "vector-parts", by="part")
        for k in range(parts):
            own = dealt.where(F.col("part") == k).drop("part")
            inside = held.where(F.col("part") == k).select(*_ROW) if parts > 1 else now.join(own.select(*_CELL), _CELL, "left_semi")
            pivots = pivots_of(inside, own)
            # comparisons within a cell and within its parts
            work = part_sizes(inside, pivots, radius).groupBy(*_CELL).agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("work"))
            spared = materialize(own.join(work, _CELL).where(F.col("work") <= SPARED * F.col("size").cast("double") * F.col("size")).select(*_CELL), "cut-cells")
            good.append(spared)
            cut.append(materialize(assign(inside.join(spared, _CELL, "left_semi"), pivots, radius, level), "vector-cells"))
        ready.append(now.join(reduce(DataFrame.union, good), _CELL, "left_anti").select(*_ROW))
        now = reduce(DataFrame.union, cut)
    return [*ready, now]


def compared(blocks: DataFrame, threshold: float) -> DataFrame:
    """cid, n_links and low of the rows of each block pair."""
    keys = [*_CELL, "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, keys):
            group = group.combine_chunks()
            cid, copies, marks, side = (group.column(c).to_numpy() for c in ("cid", "copies", "marks", "side"))
            units = _unit(group.column("vector").chunk(0).flatten().to_numpy(), group.column("dim")[0].as_py())
            across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
            a, b = [], []
            step = max(1, STEP // len(units))
            for k in range(0, len(units), step):
                near = units[k : k + step] @ units.T >= threshold
                if marks.any():
                    near &= (marks[k : k + step, None] & marks[None, :]) == 0
                if across:
                    near &= side[k : k + step, None] != side[None, :]
                x, y = np.nonzero(near)
                a.append(x[x + k != y] + k)
                b.append(y[x + k != y])
            a, b = np.concatenate(a), np.concatenate(b)
            n = np.bincount(a, copies[b], minlength=len(cid)).astype(np.int64)
            low = lowest(cid, a, b)
            told = (n > 0) | (low < cid)
            yield pa.RecordBatch.from_arrays([pa.array(cid[told]), pa.array(n[told]), pa.array(low[told])], ["cid", "n_links", "low"])

    return blocks.mapInArrow(run, "cid long, n_links long, low long")


def range_join(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """id, n_links and component_id (the smallest id that links lead to) of every row."""
    v = F.col("vector")
    usable = F.col("label").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )
    rows = materialize(rows.withColumn("usable", F.coalesce(usable, F.lit(False))), "vectors")
    good = rows.where("usable").withColumn("dim", F.size("vector")).withColumn("digest", F.sha2(F.concat_ws(",", F.transform("vector", lambda x: (x + 0.0).cast("string"))), 256))
    classes = good.groupBy("label", "dim", "digest").agg(F.min("uid").alias("cid"), F.count("*").alias("copies"))
    classes = materialize(classes, "vector-classes")
    single = classes.join(rows.select(F.col("uid").alias("cid"), "vector"), "cid").select("label", "dim", "cid", "copies", "vector")
    single = materialize(single, "vector-class-rows")
    radius = float(np.sqrt(2 - 2 * threshold))
    dealt = materialize(reduce(DataFrame.union, into_cells(single, radius)), "vector-cells")
    counts = dealt.groupBy(*_CELL).agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") * F.greatest("dim", F.lit(1)) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), (own > j).cast("int").alias("side")))
    keys = [*_CELL, "i", "j"]
    spread = dealt.join(counts, _CELL).withColumn("b", F.explode(pairs))
    spread = spread.select(*_CELL, "b.i", "b.j", "b.side", "cid", "copies", "marks", "vector").repartition(*keys).sortWithinPartitions(*keys)
    results = materialize(compared(spread, threshold), "vector-links")
    linked = results.groupBy("cid").agg(F.sum("n_links").alias("n_links"))
    groups = components(results.where("low < cid").select(F.col("cid").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "cid")
    per_class = classes.join(linked, "cid", "left").join(groups, "cid", "left")
    per_class = per_class.select("label", "dim", "digest", F.coalesce("component", "cid").alias("component"), (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    found = good.select("uid", "id", "label", "dim", "digest").join(per_class, ["label", "dim", "digest"]).select("uid", "id", "component", "n_links")
    alone = rows.where("not usable").select("uid", "id", F.col("uid").alias("component"), F.lit(0).cast("long").alias("n_links"))
    every = materialize(found.union(alone), "vector-groups")
    least = every.groupBy("component").agg(F.min("id").alias("component_id"))
    return every.join(least, "component").select("id", "n_links", "component_id")
