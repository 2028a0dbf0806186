"""Order statistics and pair sums of many columns in a few scans, without rows per column.

Each task keeps small tables of counts or sums for all columns and gives them at its end,
so what is shuffled depends on the number of columns and tasks and never on the rows.
Python sees Arrow batches only; a plan of one expression per pair or bin would not compile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096
#: Values of an interval that are counted one by one.
FEW = 1 << 16


def doubles(df: DataFrame, cols: list[str], finite: bool = False) -> DataFrame:
    """The columns as doubles c0, c1, ...; NaN becomes null, and infinite values too if ``finite``."""
    # as text, for one call a column and not one an operator
    values = ["nanvl(cast(`{}` as double), null)".format(c.replace("`", "``")) for c in cols]
    rows = df.selectExpr(*[f"{v} as c{i}" for i, v in enumerate(values)])
    if finite:
        rows = rows.selectExpr(*[f"if(abs(c{i}) < double('infinity'), c{i}, null) as c{i}" for i in range(len(cols))])
    return rows


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """A batch's columns as rows, missing values as NaN."""
    return np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])


# ---------------------------------------------------------------- order statistics


@dataclass
class Interval:
    """Values from ``low`` to ``high`` of a column; ``before`` are less, ``count`` lie within."""

    column: int
    low: float
    high: float
    before: int
    count: int
    ranks: list[int]


def _bin_of(values: np.ndarray, low: float, high: float, bins: int) -> np.ndarray:
    """Bins of values from low to high; low is in the first, high in the last, and order holds."""
    share = (values / 2 - low / 2) / (high / 2 - low / 2)
    return np.minimum((share * bins).astype(np.int64), bins - 1)


def _binned(rows: DataFrame, intervals: list[Interval]) -> DataFrame:
    """Rows (interval, bin, n, low, high) of the occupied bins, summed over all tasks."""
    bins = BINS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(intervals), bins), np.int64)
        low, high = np.full(n.shape, np.inf), np.full(n.shape, -np.inf)
        for batch in batches:
            table = _matrix(batch)
            for k, part in enumerate(intervals):
                v = table[part.column]
                v = v[(v >= part.low) & (v <= part.high)]
                at = _bin_of(v, part.low, part.high, bins)
                n[k] += np.bincount(at, minlength=bins)
                np.minimum.at(low[k], at, v)
                np.maximum.at(high[k], at, v)
        k, at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(n[k, at]), pa.array(low[k, at]), pa.array(high[k, at])],
            names=["interval", "bin", "n", "low", "high"],
        )

    found = rows.mapInArrow(run, "interval int, bin int, n bigint, low double, high double")
    return found.groupBy("interval", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _narrower(rows: DataFrame, intervals: list[Interval]) -> list[Interval]:
    """The bins of each interval that hold one of its ranks: one row a rank reaches the driver."""
    before = Window.partitionBy("interval").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = _binned(rows, intervals).withColumn("lower", F.coalesce(F.sum("n").over(before), F.lit(0)))
    wanted = [(k, r - part.before) for k, part in enumerate(intervals) for r in part.ranks]
    wanted = F.broadcast(rows.sparkSession.createDataFrame(wanted, "interval int, place bigint"))
    held = bins.join(wanted, "interval").where((F.col("place") >= F.col("lower")) & (F.col("place") < F.col("lower") + F.col("n")))
    out: dict[tuple[int, int], Interval] = {}
    for r in held.collect():
        part = intervals[r["interval"]]
        fresh = Interval(part.column, r["low"], r["high"], part.before + r["lower"], r["n"], [])
        out.setdefault((r["interval"], r["bin"]), fresh).ranks.append(part.before + r["place"])
    return list(out.values())


def _values(rows: DataFrame, intervals: list[Interval]) -> DataFrame:
    """Rows (col, rank, value) of the wanted ranks of intervals that hold few values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = _matrix(batch)
            for k, part in enumerate(intervals):
                v = table[part.column]
                values, n = np.unique(v[(v >= part.low) & (v <= part.high)], return_counts=True)
                if len(values):
                    columns = [pa.array(np.full(len(values), k, np.int32)), pa.array(values), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["interval", "value", "n"])

    counts = rows.mapInArrow(run, "interval int, value double, n bigint").groupBy("interval", "value").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("interval").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("lower", F.coalesce(F.sum("n").over(before), F.lit(0)))
    wanted = [(k, part.column, r, r - part.before) for k, part in enumerate(intervals) for r in part.ranks]
    wanted = F.broadcast(rows.sparkSession.createDataFrame(wanted, "interval int, col int, rank bigint, place bigint"))
    held = counts.join(wanted, "interval").where((F.col("place") >= F.col("lower")) & (F.col("place") < F.col("lower") + F.col("n")))
    return held.select("col", "rank", "value")


def wide_percentiles(df: DataFrame, cols: list[str], probs: list[float], names: list[str], finite: bool = True) -> DataFrame:
    """Rows (column, *names): exact linearly interpolated percentiles of every column.

    One scan finds the range of all columns, the next counts them into bins, and only bins that
    hold a wanted rank are looked into: again by bins while they hold many values, then by value.
    Missing values are left out, infinite ones too if ``finite``, else they fail; a column
    without a value has nulls.
    """
    spark = df.sparkSession
    rows = doubles(df, cols, finite)
    ends = rows.selectExpr(*[f"{f}({c}) as {c}{mark}" for c in rows.columns for f, mark in (("count", "n"), ("min", "l"), ("max", "h"))]).first()
    sizes = [ends[f"c{i}n"] for i in range(len(cols))]
    places = [[(n - 1) * p for p in probs] for n in sizes]
    open_ = []
    for i, n in enumerate(sizes):
        if n:
            ranks = sorted({int(f(x)) for x in places[i] for f in (np.floor, np.ceil)})
            open_.append(Interval(i, ends[f"c{i}l"], ends[f"c{i}h"], 0, n, ranks))
    closed: list[Interval] = []
    while True:
        closed += [part for part in open_ if part.count <= FEW or part.low == part.high]
        open_ = [part for part in open_ if part.count > FEW and part.low < part.high]
        if not open_:
            break
        open_ = _narrower(rows, open_)
    single = [(part.column, r, part.low) for part in closed if part.low == part.high for r in part.ranks]
    several = [part for part in closed if part.low < part.high]
    found = spark.createDataFrame(single, "col int, rank bigint, value double")
    if several:
        found = found.unionByName(_values(rows, several))
    spec = [
        (cols[i], i, name, int(np.floor(x)), int(np.ceil(x)), float(x - np.floor(x)))
        for i, n in enumerate(sizes) if n
        for name, x in zip(names, places[i])
    ]
    spec = F.broadcast(spark.createDataFrame(spec, "column string, col int, name string, a bigint, b bigint, share double"))
    parts = found.join(spec, "col").where((F.col("rank") == F.col("a")) | (F.col("rank") == F.col("b")))
    low = F.max(F.when(F.col("rank") == F.col("a"), F.col("value")))
    high = F.max(F.when(F.col("rank") == F.col("b"), F.col("value")))
    each = parts.groupBy("column", "name").agg((low + (high - low) * F.max("share")).alias("v"))
    wide = each.groupBy("column").agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in names])
    every = F.broadcast(spark.createDataFrame([(c,) for c in cols], "column string"))
    return every.join(wide, "column", "left")


# ---------------------------------------------------------------- pairs of columns


def pair_correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows (a, b, r): the correlation of each pair over rows where both are present, in one scan.

    A task sums products of whole blocks of columns, each counted from the column's first
    value, and gives one row a pair; the rows of a pair, one a task, are then combined. A column
    that is constant where the other is present, or has an infinite value there, has no r.
    """
    lefts, rights = (list(dict.fromkeys(p[side] for p in pairs)) for side in (0, 1))
    cols = list(dict.fromkeys(lefts + rights))
    left, right = ([cols.index(c) for c in side] for side in (lefts, rights))
    ia = np.array([lefts.index(a) for a, _ in pairs])
    ib = np.array([rights.index(b) for _, b in pairs])
    names = ["n", "bad", "mx", "my", "xx", "yy", "xy", "raw_x", "raw_y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, sums = np.full(len(cols), np.nan), np.zeros((7, len(left), len(right)))
        for batch in batches:
            table = _matrix(batch)
            there = ~np.isnan(table)
            infinite = np.isinf(table)
            usable = there & ~infinite
            first = usable.argmax(1)
            unset = np.isnan(base) & usable.any(1)
            base[unset] = table[np.flatnonzero(unset), first[unset]]
            x = np.where(usable, table - np.nan_to_num(base)[:, None], 0.0)
            mask, odd = there.astype(np.float64), infinite.astype(np.float64)
            a, b, ma, mb = x[left], x[right], mask[left], mask[right]
            parts = (ma @ mb.T, odd[left] @ mb.T + ma @ odd[right].T, a @ mb.T, ma @ b.T, (a * a) @ mb.T, ma @ (b * b).T, a @ b.T)
            for k, part in enumerate(parts):
                sums[k] += part
        n, bad, sx, sy, sxx, syy, sxy = sums[:, ia, ib]
        shift = np.nan_to_num(base)
        with np.errstate(invalid="ignore", divide="ignore"):
            mx, my = np.where(n > 0, sx / n, 0), np.where(n > 0, sy / n, 0)
        keep = np.flatnonzero(n > 0)
        values = [
            n, bad, shift[np.array(left)[ia]] + mx, shift[np.array(right)[ib]] + my,
            sxx - n * mx * mx, syy - n * my * my, sxy - n * mx * my, sxx, syy,
        ]
        columns = [pa.array(keep.astype(np.int32)), *[pa.array(v[keep]) for v in values]]
        yield pa.RecordBatch.from_arrays(columns, names=["pair", *names])

    spark = df.sparkSession
    found = doubles(df, cols).mapInArrow(run, "pair int, " + ", ".join(f"{n} double" for n in names))
    blocks = found.groupBy("pair").agg(F.collect_list(F.struct(*names)).alias("blocks"))

    def total(value: Callable[[Column], Column]) -> Column:
        return F.aggregate("blocks", F.lit(0.0), lambda held, x: held + value(x))

    # means counted from the first block's, so a constant column has none that differ
    first = F.col("blocks")[0]
    dx, dy = (lambda x: x["mx"] - first["mx"]), (lambda x: x["my"] - first["my"])
    sums = blocks.select(
        "pair",
        total(lambda x: x["n"]).alias("n"),
        total(lambda x: x["bad"]).alias("bad"),
        total(lambda x: x["n"] * dx(x)).alias("sx"),
        total(lambda x: x["n"] * dy(x)).alias("sy"),
        total(lambda x: x["xx"] + x["n"] * dx(x) * dx(x)).alias("xx"),
        total(lambda x: x["yy"] + x["n"] * dy(x) * dy(x)).alias("yy"),
        total(lambda x: x["xy"] + x["n"] * dx(x) * dy(x)).alias("xy"),
        total(lambda x: x["raw_x"]).alias("raw_x"),
        total(lambda x: x["raw_y"]).alias("raw_y"),
    )
    vx, vy = (F.col(q) - F.col(s) * F.col(s) / F.col("n") for q, s in (("xx", "sx"), ("yy", "sy")))
    # what rounding leaves of a constant is no variance
    varies = (vx > F.col("raw_x") * 1e-13) & (vy > F.col("raw_y") * 1e-13) & (vx > 0) & (vy > 0) & (F.col("bad") == 0)
    cov = F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")
    r = F.greatest(F.least(cov / F.sqrt(vx) / F.sqrt(vy), F.lit(1.0)), F.lit(-1.0))
    listed = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "pair int, a string, b string")
    return listed.join(sums, "pair", "left").select("a", "b", F.when(varies, r).alias("r"))
