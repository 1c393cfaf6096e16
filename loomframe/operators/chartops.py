"""The encoding and transform vocabulary of chart specifications, as jobs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..sources.scratch import state_path
from .ordered import placed
from .shaping import aggregate_of, group_agg

#: The spellings of aggregations.
AGG_NAMES = {"sum": "SUM", "avg": "AVG", "average": "AVG", "mean": "AVG", "count": "COUNT", "max": "MAX", "min": "MIN", "median": "MEDIAN", "distinct": "DISTINCT"}
TIME_UNITS = ["year", "quarter", "month", "week", "day", "hour", "minute", "yearmonth", "monthdate"]


def aggregated(df: DataFrame, keys: list[str], value: str, kind: str, approx: bool = False) -> DataFrame:
    """One aggregate by group; approx takes sketches for median and distinct."""
    return group_agg(df, keys, {"value": (kind, value)}, approx)


def time_unit(ts: Column, unit: str) -> Column:
    """A part of the time (year ... minute), the month it lies in (yearmonth), or month and day (monthdate)."""
    parts = {"year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute}
    if unit in parts:
        return parts[unit](ts)
    return F.date_trunc("month", ts) if unit == "yearmonth" else F.date_format(ts, "MM-dd")


def t_aggregate(df: DataFrame, keys: list[str], ops: dict[str, tuple[str, str]]) -> DataFrame:
    return group_agg(df, keys, ops)


def t_joinaggregate(df: DataFrame, keys: list[str], ops: dict[str, tuple[str, str]]) -> DataFrame:
    """Aggregates of the group beside each of its rows."""
    w = Window.partitionBy(*keys)
    return df.withColumns({name: aggregate_of(k, v).over(w) for name, (k, v) in ops.items()})


def t_window(df: DataFrame, keys: list[str], sort: list[str], ops: dict[str, tuple], frame: tuple[int | None, int | None] = (None, 0)) -> DataFrame:
    """{name: (op, column, ...)}; op: row_number, rank, dense_rank, lag, lead (with an offset), or an aggregate over the frame."""
    order = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in sort]
    w = Window.partitionBy(*keys).orderBy(*order)
    lo, hi = frame
    framed = w.rowsBetween(Window.unboundedPreceding if lo is None else lo, Window.unboundedFollowing if hi is None else hi)

    def one(op: str, *args):
        if op in ("row_number", "rank", "dense_rank"):
            return getattr(F, op)().over(w)
        if op in ("lag", "lead"):
            return getattr(F, op)(args[0], args[1] if len(args) > 1 else 1).over(w)
        return aggregate_of(op, args[0]).over(framed)

    return df.withColumns({name: one(*op) for name, op in ops.items()})


def nice_step(low: Column, high: Column, maxbins: int) -> Column:
    """The least of 1, 2, 5 times a power of ten with which the range has at most maxbins bins."""
    raw = (high - low) / maxbins
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    return F.when(raw <= 0, F.lit(1.0)).when(raw <= power, power).when(raw <= 2 * power, 2 * power).when(raw <= 5 * power, 5 * power).otherwise(10 * power)


def t_bin(df: DataFrame, value: str, maxbins: int = 10, step: float | None = None, prefix: str = "bin") -> DataFrame:
    """Adds bin start and end. Without a step, one pass finds the range and with it a nice step."""
    if step is None:
        ends = df.agg(F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"))
        df = df.crossJoin(F.broadcast(ends.select(nice_step(F.col("__lo"), F.col("__hi"), maxbins).alias("__step"))))
    else:
        df = df.withColumn("__step", F.lit(float(step)))
    start = F.floor(F.col(value) / F.col("__step")) * F.col("__step")
    return df.withColumns({f"{prefix}_start": start, f"{prefix}_end": start + F.col("__step")}).drop("__step")


def t_calculate(df: DataFrame, expression: str, name: str) -> DataFrame:
    return df.withColumn(name, F.expr(expression))


def predicate(spec: dict | str) -> Column:
    """An expression, or {field, equal | oneOf | range | valid}."""
    if isinstance(spec, str):
        return F.expr(spec)
    c = F.col(spec["field"])
    if "equal" in spec:
        return c == spec["equal"]
    if "oneOf" in spec:
        return c.isin(*spec["oneOf"])
    if "range" in spec:
        lo, hi = spec["range"]
        return reduce(lambda a, b: a & b, [x for x in (c >= lo if lo is not None else None, c <= hi if hi is not None else None) if x is not None])
    return c.isNotNull() if spec.get("valid", True) else c.isNull()


def t_filter(df: DataFrame, spec: dict | str) -> DataFrame:
    return df.where(predicate(spec))


def t_fold(df: DataFrame, columns: list[str], names: tuple[str, str] = ("key", "value")) -> DataFrame:
    """Wide to long: a row for each column; the others are repeated."""
    ids = [c for c in df.columns if c not in columns]
    return df.unpivot(ids, columns, *names)


def t_pivot(df: DataFrame, column: str, value: str, keys: list[str], values: list, kind: str = "sum") -> DataFrame:
    return df.groupBy(*keys).pivot(column, values).agg(aggregate_of(kind, value))


def grid(df: DataFrame, value: str, keys: list[str], steps: int) -> DataFrame:
    """steps + 1 evenly spaced points from the least to the greatest value of each group."""
    ends = df.groupBy(*keys).agg(F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"))
    return ends.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(steps)))).select(
        *keys, F.col("__k").alias("step"), (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__k") / steps).alias("x")
    )


def t_density(df: DataFrame, value: str, keys: list[str], bandwidth: float, steps: int = 20) -> DataFrame:
    """Gaussian kernel density of each group on its grid. Equal values are counted first, so that copies cost nothing; then
    each different value meets the steps + 1 grid points of its group."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    points = grid(df, value, keys, steps)
    joined = counted.join(points, keys) if keys else counted.crossJoin(F.broadcast(points))
    z = (F.col("x") - F.col("__v")) / bandwidth
    weight = F.exp(-z * z / 2) * F.col("__n")
    return joined.groupBy(*keys, "step", "x").agg((F.sum(weight) / (F.sum("__n") * bandwidth * 2.5066282746310002)).alias("density"))


def t_regression(df: DataFrame, x: str, y: str, keys: list[str], order: int = 1) -> DataFrame:
    """Least squares by group: slope, intercept, r2; for order 2 the coefficients c0, c1, c2 from power sums."""
    if order == 1:
        return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    # about the group's mean, which keeps the sums of fourth powers small
    mean = pairs.groupBy(*keys).agg(F.avg(a).alias("__m"))
    joined = pairs.join(mean, keys) if keys else pairs.crossJoin(F.broadcast(mean))
    u = a - F.col("__m")
    s = joined.groupBy(*keys).agg(
        F.first("__m").alias("m"), F.count(F.lit(1)).cast("double").alias("s0"), *(F.sum(F.pow(u, F.lit(float(k)))).alias(f"s{k}") for k in (1, 2, 3, 4)), *(F.sum(b * F.pow(u, F.lit(float(k)))).alias(f"t{k}") for k in (0, 1, 2))
    )
    c = {n: F.col(n) for n in ("m", "s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2")}
    det = lambda p, q, r, u1, v1, w1, x1, y1, z1: p * (v1 * z1 - w1 * y1) - q * (u1 * z1 - w1 * x1) + r * (u1 * y1 - v1 * x1)
    d = det(c["s0"], c["s1"], c["s2"], c["s1"], c["s2"], c["s3"], c["s2"], c["s3"], c["s4"])
    e0 = det(c["t0"], c["s1"], c["s2"], c["t1"], c["s2"], c["s3"], c["t2"], c["s3"], c["s4"])
    e1 = det(c["s0"], c["t0"], c["s2"], c["s1"], c["t1"], c["s3"], c["s2"], c["t2"], c["s4"])
    e2 = det(c["s0"], c["s1"], c["t0"], c["s1"], c["s2"], c["t1"], c["s2"], c["s3"], c["t2"])
    b0, b1, b2 = (F.when(d != 0, e / d) for e in (e0, e1, e2))
    return s.select(*keys, (b0 - b1 * c["m"] + b2 * c["m"] * c["m"]).alias("c0"), (b1 - 2 * b2 * c["m"]).alias("c1"), b2.alias("c2"))


#: Different x in one bucket of a local regression.
LOESS_BUCKET = 4096
#: Buckets that are sent to all tasks which read points.
FEW_BUCKETS = 20_000
#: Powers of x that a tricube weight of a linear fit needs.
_POWERS = 12


def t_loess(df: DataFrame, x: str, y: str, keys: list[str], bandwidth: float = 0.3, steps: int = 10, bucket: int = LOESS_BUCKET) -> DataFrame:
    """Local linear fits on a grid: tricube weights of the nearest share of points.

    Points of equal x are summed first and dealt in the order of x into buckets of at most so many, each with its moments
    about its middle. A grid point reads the buckets' ends to find those that surely are, or may be, among its nearest share, and
    settles how far it reaches by the points of the few at the edge. A tricube weight is a polynomial of the distance on
    either side, so that buckets inside the reach count by their moments, moved to the grid point; only buckets that the reach
    or the grid point cuts count by their points. Moments are moved from the bucket's own middle, and not taken as differences
    of sums over all x, which would lose their digits.

    Cases: rows without x or y are left out; a group of one x has its mean; equal distances are inside together."""
    sums = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("__x")).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(y).cast("double")).alias("__y"))
    # a bucket is a run of rows of a range part, so that no row needs its number among all
    points = placed(sums, keys, ["__x"]).select(*keys, "__x", "__n", "__y", F.expr(f"__place div {bucket}").alias("__b"))
    moments = _kept(_moments(points, keys))
    ends = moments.groupBy(*keys, "__b").agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"), F.sum("__n").alias("__n"))
    same = lambda a, b, more=(): reduce(lambda p, q: p & q, [a[k].eqNullSafe(b[f"__r_{k}"]) for k in [*keys, *more]], F.lit(True))
    named = lambda t, more=(): t.withColumnsRenamed({k: f"__r_{k}" for k in [*keys, *more]})
    bare = lambda t: t.drop(*(c for c in t.columns if c.startswith("__r_")))

    # the grid is steps + 1 rows a group, each met by a row for every bucket of the group
    grids = named(_grid_of(ends, keys, steps))
    near = bare(ends.join(grids, same(ends, grids))).withColumns({"__far": F.greatest(F.abs(F.col("x") - F.col("__lo")), F.abs(F.col("__hi") - F.col("x"))), "__inner": F.greatest(F.col("__lo") - F.col("x"), F.col("x") - F.col("__hi"), F.lit(0.0))})
    by = [*keys, "step"]
    upto = Window.partitionBy(*by)
    wanted = F.ceil(F.sum("__n").over(upto) * bandwidth)
    near = near.withColumns({"__wanted": wanted, "__sure": F.sum("__n").over(upto.orderBy("__far")), "__may": F.sum("__n").over(upto.orderBy("__inner"))})
    # all points are within the reach at the least far end with enough points; none of too few buckets reaches it
    most = F.min(F.when(F.col("__sure") >= F.col("__wanted"), F.col("__far"))).over(upto)
    least = F.min(F.when(F.col("__may") >= F.col("__wanted"), F.col("__inner"))).over(upto)
    near = _kept(near.withColumns({"__most": most, "__least": least}).where("__inner <= __most").select(*by, "x", "__b", "__lo", "__hi", "__n", "__far", "__inner", "__wanted", "__least"))
    inside = near.where("__far < __least").groupBy(*by).agg(F.sum("__n").alias("__inside"))
    edge = _if_few(named(near.where("__far >= __least").select(*by, "x", "__b", "__wanted"), ["__b"]))
    at_edge = bare(points.join(edge, same(points, edge, ["__b"]))).withColumn("__d", F.abs(F.col("__x") - F.col("x")))
    inside = named(inside, ["step"])
    at_edge = bare(at_edge.join(inside, same(at_edge, inside, ["step"]), "left"))
    nearer = Window.partitionBy(*by).orderBy("__d")
    reached = at_edge.withColumn("__before", F.coalesce("__inside", F.lit(0)) + F.sum("__n").over(nearer)).where("__before >= __wanted").groupBy(*by).agg(F.min("__d").alias("__reach"))
    reached = named(reached.withColumn("__h", F.when(F.col("__reach") > 0, F.col("__reach")).otherwise(1.0) * 1.000001), ["step"])
    held = _kept(bare(near.join(reached, same(near, reached, ["step"]))).where("__inner <= __reach").withColumn("__whole", (F.col("__far") <= F.col("__reach")) & ((F.col("__lo") >= F.col("x")) | (F.col("__hi") <= F.col("x")))))

    cut = _if_few(named(held.where("not __whole").select(*by, "x", "__b", "__h", "__reach"), ["__b"]))
    single = bare(points.join(cut, same(points, cut, ["__b"]))).withColumn("__u", (F.col("__x") - F.col("x")) / F.col("__h")).where(F.abs(F.col("__x") - F.col("x")) <= F.col("__reach"))
    w = F.pow(1 - F.pow(F.abs("__u"), F.lit(3.0)), F.lit(3.0))
    v, n, yy = F.col("__u"), F.col("__n"), F.col("__y")
    parts = single.select(*by, "x", "__h", (w * n).alias("s0"), (w * n * v).alias("s1"), (w * n * v * v).alias("s2"), (w * yy).alias("t0"), (w * yy * v).alias("t1"))
    whole = named(held.where("__whole").select(*by, "x", "__b", "__h"), ["__b"])
    moved = bare(moments.join(whole, same(moments, whole, ["__b"]))).select(*by, "x", "__h", "__c", "__ms", "__ys")
    both = parts.union(_tricube_sums(moved, by))
    s = both.groupBy(*by, "x").agg(*(F.sum(c).alias(c) for c in ("s0", "s1", "s2", "t0", "t1")))
    # in units of the reach, so that a determinant of nothing shows at any scale of x
    d = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    fit = F.when(F.abs(d) > 1e-12 * F.col("s0") * F.col("s0"), (F.col("t0") * F.col("s2") - F.col("t1") * F.col("s1")) / d).otherwise(F.col("t0") / F.col("s0"))
    return s.select(*by, "x", fit.alias("y"))


def _grid_of(ends: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """steps + 1 evenly spaced points between the ends of each group's buckets."""
    lo, hi = F.col("__lo"), F.col("__hi")
    span = ends.groupBy(*keys).agg(F.min(lo).alias("__lo"), F.max(hi).alias("__hi"))
    return span.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps)))).select(*keys, "step", (lo + (hi - lo) * F.col("step") / steps).alias("x"))


def _moments(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, __b, ends, number of points and sums of powers about the middle, of each bucket's rows in a batch: rows of a
    bucket that two batches hold are two pieces, each about its own middle."""
    names = [*keys, "__b"]
    rows = points.select(*names, "__x", F.col("__n").cast("long").alias("__n"), "__y", (F.xxhash64(*keys) if keys else F.lit(0).cast("long")).alias("__h"))
    array = ArrayType(DoubleType())
    out = StructType([*(points.schema[k] for k in names), StructField("__lo", DoubleType()), StructField("__hi", DoubleType()), StructField("__n", LongType()), StructField("__c", DoubleType()), StructField("__ms", array), StructField("__ys", array)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            b, h, x, n, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__b", "__h", "__x", "__n", "__y"))
            at = np.concatenate([[0], np.flatnonzero((b[1:] != b[:-1]) | (h[1:] != h[:-1])) + 1])
            lo, hi = np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)
            middle = (lo + hi) / 2
            u, p, q, ms, ys = x - np.repeat(middle, np.diff(np.append(at, len(x)))), n.astype(float), y.astype(float), [], []
            for _ in range(_POWERS):
                ms.append(np.add.reduceat(p, at))
                ys.append(np.add.reduceat(q, at))
                p, q = p * u, q * u
            ends = pa.array(np.arange(0, _POWERS * len(at) + 1, _POWERS, dtype=np.int32))
            sums = [pa.ListArray.from_arrays(ends, pa.array(np.stack(m, 1).ravel())) for m in (ms, ys)]
            first = batch.select(names).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*first.columns, pa.array(lo), pa.array(hi), pa.array(np.add.reduceat(n, at)), pa.array(middle), *sums], out.names)

    return rows.mapInArrow(run, out)


def _tricube_sums(moved: DataFrame, by: list[str]) -> DataFrame:
    """by, x, __h and the weighted sums of a linear fit at x, of pieces that lie on one side of x within its reach __h."""
    names = [*by, "x", "__h"]
    out = StructType([*(moved.schema[k] for k in names), *(StructField(c, DoubleType()) for c in ("s0", "s1", "s2", "t0", "t1"))])
    binomials = np.array([[float(comb(k, i)) for i in range(_POWERS)] for k in range(_POWERS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, h, c = (batch.column(k).to_numpy(zero_copy_only=False)[:, None] for k in ("x", "__h", "__c"))
            far, side, powers, sums = (c - x) / h, np.where(c >= x, 1.0, -1.0)[:, 0], np.arange(_POWERS), []
            by_far = far**powers
            for name, n in (("__ms", 3), ("__ys", 2)):
                unit = batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, _POWERS) / h**powers
                m = [(unit[:, : k + 1] * binomials[k, : k + 1] * by_far[:, k::-1]).sum(1) for k in range(_POWERS)]
                sums += [m[j] - 3 * side * m[j + 3] + 3 * m[j + 6] - side * m[j + 9] for j in range(n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), *(pa.array(v) for v in sums)], out.names)

    return moved.mapInArrow(run, out)


def _if_few(buckets: DataFrame) -> DataFrame:
    """Buckets to look points up in: sent to all tasks once they are counted to be few, so that points stay where they are."""
    return F.broadcast(buckets) if buckets.count() <= FEW_BUCKETS else buckets


def _kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again."""
    path = state_path(df.sparkSession, "loess")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compose(views: dict[str, DataFrame], kind: str) -> DataFrame:
    """The frames of a composed chart under one another, with their view's name and the kind of composition."""
    if kind not in ("single", "layer", "hconcat", "vconcat", "facet", "repeat"):
        raise ValueError(f"unknown composition {kind}")
    parts = [df.withColumns({"view": F.lit(name), "composition": F.lit(kind)}) for name, df in views.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def interact(df: DataFrame, kind: str, params: dict) -> DataFrame:
    """An interaction as a filter: brush and crossfilter {field: (low, high)}, slider {field: value}, legend and point
    {field: [values]}. A crossfilter repeats the rows for each view, filtered by the ranges of all other views."""
    if kind == "crossfilter":
        parts = []
        for view in params:
            others = [F.col(c).between(*r) for c, r in params.items() if c != view]
            parts.append(df.where(reduce(lambda a, b: a & b, others, F.lit(True))).withColumn("view", F.lit(view)))
        return reduce(lambda a, b: a.unionByName(b), parts)
    tests = {
        "brush": lambda c, p: F.col(c).between(*p),
        "slider": lambda c, p: F.col(c) <= p,
        "legend": lambda c, p: F.col(c).isin(*p),
        "point": lambda c, p: F.col(c).isin(*p),
    }[kind]
    return df.where(reduce(lambda a, b: a & b, [tests(c, p) for c, p in params.items()], F.lit(True)))


def agg_alias(name: Column) -> Column:
    """The canonical name of an aggregation; an unknown one counts."""
    table = F.create_map(*(F.lit(x) for pair in AGG_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(name)), F.lit("COUNT"))


def aggregate(df: DataFrame, dims: list[str], measures: list[str], kind: str) -> DataFrame:
    """The chart query of a candidate: dimensions, measures, and one aggregation for all of these."""
    short = {"AVG": "avg", "SUM": "sum", "COUNT": "count", "MAX": "max", "MIN": "min", "MEDIAN": "median", "DISTINCT": "distinct"}
    k = short[AGG_NAMES.get(kind.lower(), "COUNT")]
    return group_agg(df, dims, {f"{k}_{m}": (k, m) for m in measures})
