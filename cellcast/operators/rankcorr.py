"""Rank correlation of every pair of columns, with gaps, by a plan of one size.

A pair is ranked among the rows where both of its columns are present.  Columns that are missing
in the same rows form a class, so a value needs one rank for each class its row has and not one
for each other column.  Values are dealt by range of (column, value, row) into bins of bounded
size; a common value spans bins.  A small summary of each bin tells what lies before it and how
often its end values occur anywhere.  Ranked values then meet again by row, and each
task sums products of whole blocks of rows.  What is shuffled is rows x present columns, and for
the ranks times the classes of a row; nothing is joined by value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_width
from .wide import _matrix, doubles

#: Ranks that a task holds at once, in a bin or in a block of rows.
HELD = 1 << 20

_VECTORS = ("total", "at_low", "at_high")
_PLACE = "bin int, col int, before array<bigint>, low double, low_less array<bigint>, low_n array<bigint>, high double, high_less array<bigint>, high_n array<bigint>"


def _together(rows: DataFrame, k: int) -> np.ndarray:
    """For each pair of columns the number of rows where both are present; one number a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((k, k))
        for batch in batches:
            there = (~np.isnan(_matrix(batch))).astype(np.float64)
            n += there @ there.T
        i, j = np.nonzero(n)
        columns = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(n[i, j].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "n"])

    out = np.zeros((k, k), np.int64)
    found = rows.mapInArrow(run, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n"))
    for r in found.collect():
        out[r["i"], r["j"]] = r["n"]
    return out


def _classes(together: np.ndarray) -> np.ndarray:
    """The class of each column; columns of a class are present in the same rows."""
    own = np.diag(together)
    same = (together == own[:, None]) & (together == own[None, :])
    return np.unique(same.argmax(1), return_inverse=True)[1]


def _packed(present: np.ndarray) -> pa.Array:
    """Rows of flags as binary values."""
    bits = np.packbits(present, axis=1)
    ends = np.arange(len(bits) + 1, dtype=np.int32) * bits.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(bits), [None, pa.py_buffer(ends), pa.py_buffer(bits.tobytes())])


def _first(values: pa.Array) -> int:
    """Where the bytes of an array of binary values begin."""
    kind = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    return int(np.frombuffer(values.buffers()[1], kind, 1, values.offset * np.dtype(kind).itemsize)[0])


def _flags(packed: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    # no objects of one row each: all values are equally long and none is missing
    parts = packed.chunks if isinstance(packed, pa.ChunkedArray) else [packed]
    size = -(-width // 8)
    held = [np.frombuffer(p.buffers()[2] or b"", np.uint8, len(p) * size, _first(p)) for p in parts if len(p)]
    bits = np.concatenate([np.empty(0, np.uint8), *held]).reshape(-1, size)
    return np.unpackbits(bits, axis=1, count=width).astype(bool)


def _entries(rows: DataFrame, classes: np.ndarray) -> DataFrame:
    """Rows (col, value, row, has) of the present values; ``has`` flags the classes of the row."""
    width = int(classes.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(batch.num_columns - 1)
            table = _matrix(batch.select(range(batch.num_columns - 1)))
            there = ~np.isnan(table)
            present = np.zeros((table.shape[1], width), bool)
            present[:, classes] = there.T
            has = _packed(present)
            for c in range(len(table)):
                at = np.flatnonzero(there[c])
                if len(at):
                    # adding 0.0 makes a negative zero tie with a plain one
                    columns = [pa.array(np.full(len(at), c, np.int32)), pa.array(table[c, at] + 0.0), row.take(at), has.take(at)]
                    yield pa.RecordBatch.from_arrays(columns, names=["col", "value", "row", "has"])

    return rows.mapInArrow(run, "col int, value double, row bigint, has binary")


def _pieces(dealt: DataFrame, width: int) -> DataFrame:
    """Rows (bin, col, low, high, total, at_low, at_high) of what each task sees of a bin.

    The vectors count rows by class: all of them, those of the lowest and of the highest value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            col, value, at = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("col", "value", "bin"))
            flags = _flags(batch.column("has"), width)
            keys, which = np.unique(np.stack([at, col]), axis=1, return_inverse=True)
            for k, key in enumerate(zip(*keys.tolist())):
                mine = np.flatnonzero(which == k)
                v, f = value[mine], flags[mine]
                low, high = v.min(), v.max()
                part = held.setdefault(key, [np.inf, -np.inf, *(np.zeros(width, np.int64) for _ in _VECTORS)])
                part[2] += f.sum(0)
                at_low, at_high = f[v == low].sum(0), f[v == high].sum(0)
                if low <= part[0]:
                    part[3] = at_low + (part[3] if low == part[0] else 0)
                    part[0] = low
                if high >= part[1]:
                    part[4] = at_high + (part[4] if high == part[1] else 0)
                    part[1] = high
        out = [(*key, *part[:2], *(v.tolist() for v in part[2:])) for key, part in held.items()]
        names = ["bin", "col", "low", "high", *_VECTORS]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), *[pa.list_(pa.int64())] * 3]
        columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return dealt.mapInArrow(run, "bin int, col int, low double, high double, " + ", ".join(f"{n} array<bigint>" for n in _VECTORS))


def _places(pieces: DataFrame) -> DataFrame:
    """One row a bin and column: counts before it, and smaller and equal ones of its end values.

    Only end values occur in other bins too. The first bin of such a value knows what is smaller,
    and its equal ones are those of all bins that end with it. A column has a few rows a bin.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, at = np.unique(pdf["bin"].to_numpy(), return_inverse=True)
        total, at_low, at_high = (np.stack(pdf[n].to_list()) for n in _VECTORS)
        low, high = np.full(len(bins), np.inf), np.full(len(bins), -np.inf)
        np.minimum.at(low, at, pdf["low"].to_numpy())
        np.maximum.at(high, at, pdf["high"].to_numpy())
        sums = [np.zeros((len(bins), total.shape[1]), np.int64) for _ in _VECTORS]
        is_low, is_high = pdf["low"].to_numpy() == low[at], pdf["high"].to_numpy() == high[at]
        np.add.at(sums[0], at, total)
        np.add.at(sums[1], at[is_low], at_low[is_low])
        np.add.at(sums[2], at[is_high], at_high[is_high])
        before = sums[0].cumsum(0) - sums[0]
        ends, of = np.unique(np.concatenate([low, high]), return_inverse=True)
        equal = np.zeros((len(ends), total.shape[1]), np.int64)
        less = np.full(equal.shape, np.iinfo(np.int64).max)
        # a bin of one value counts it once
        np.add.at(equal, of, np.concatenate([sums[1], np.where((low == high)[:, None], 0, sums[2])]))
        np.minimum.at(less, of, np.concatenate([before, before + sums[0] - sums[2]]))
        first, last = of[: len(bins)], of[len(bins) :]
        vectors = {"before": before, "low_less": less[first], "low_n": equal[first], "high_less": less[last], "high_n": equal[last]}
        out = {"bin": bins, "col": pdf["col"].iloc[0], "low": low, "high": high} | {n: v.tolist() for n, v in vectors.items()}
        return pd.DataFrame(out)[[f.split()[0] for f in _PLACE.split(", ")]]

    return pieces.groupBy("col").applyInPandas(run, _PLACE)


def _ranked(dealt: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """Rows (row, col, ranks): tie-averaged ranks of a value by each class its row has."""
    schema = pa.schema([("row", pa.int64()), ("col", pa.int32()), ("ranks", pa.list_(pa.float64()))])

    def run(held: pa.Table, place: pa.Table) -> pa.Table:
        col, value, row = (held.column(n).to_numpy() for n in ("col", "value", "row"))
        order = np.lexsort((value, col))
        col, value, row = col[order], value[order], row[order]
        flags = _flags(held.column("has"), width)[order]
        fresh = np.append(True, (col[1:] != col[:-1]) | (value[1:] != value[:-1]))
        starts, of = np.flatnonzero(fresh), fresh.cumsum() - 1
        n = np.add.reduceat(flags.astype(np.int64), starts, axis=0)
        less = n.cumsum(0) - n
        for p in place.to_pylist():
            mine = slice(*np.searchsorted(col[starts], [p["col"], p["col"] + 1]))
            # what other columns of the bin put before
            less[mine] += np.array(p["before"]) - less[mine.start]
            for end, at in (("low", mine.start), ("high", mine.stop - 1)):
                less[at], n[at] = p[f"{end}_less"], p[f"{end}_n"]
        rank = (less + (n + 1) / 2.0)[of]
        ends = np.append(0, flags.sum(1).cumsum()).astype(np.int32)
        ranks = pa.ListArray.from_arrays(pa.array(ends), pa.array(rank[flags]))
        return pa.Table.from_arrays([pa.array(row), pa.array(col), ranks], schema=schema)

    return dealt.groupBy("bin").cogroup(places.groupBy("bin")).applyInArrow(run, "row bigint, col int, ranks array<double>")


def _products(ranked: DataFrame, classes: np.ndarray, together: np.ndarray) -> DataFrame:
    """Rows (i, j, xx, yy, xy): sums of the ranks' distances from their mean, for pairs i < j."""
    k, width = len(classes), int(classes.max()) + 1
    mean = (together + 1) / 2.0
    step = max(1, HELD // (k * k))
    left, right = np.triu_indices(k, 1)
    dealt = ranked.repartition(shuffle_width(ranked.sparkSession), "row").sortWithinPartitions("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares, crossed = np.zeros((k, k)), np.zeros((k, k))

        def add(part: pa.Table) -> None:
            row, col = (part.column(n).to_numpy() for n in ("row", "col"))
            at = np.append(False, row[1:] != row[:-1]).cumsum()
            bounds = np.searchsorted(at, np.arange(0, at[-1] + 1 + step, step))
            flat = part.column("ranks").combine_chunks().flatten().to_numpy()
            present = np.zeros((at[-1] + 1, width), bool)
            present[at, classes[col]] = True
            ends = np.append(0, present.sum(1)[at].cumsum())
            for a, b in zip(bounds[:-1], bounds[1:]):
                if a == b:
                    continue
                here = at[a:b] - at[a]
                ranks = np.full((here[-1] + 1, k, width), np.nan)
                entry, cls = np.nonzero(present[at[a:b]])
                ranks[here[entry], col[a:b][entry], cls] = flat[ends[a] : ends[b]]
                # of each column its rank among the rows that have the other one
                apart = ranks[:, :, classes] - mean
                both = ~np.isnan(apart)
                apart[~(both & both.transpose(0, 2, 1))] = 0.0
                squares[:] += np.einsum("bij,bij->ij", apart, apart)
                crossed[:] += np.einsum("bij,bji->ij", apart, apart)

        carried: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            carried = table if carried is None else pa.concat_tables([carried, table])
            row = carried.column("row").to_numpy()
            # the last row may go on in the next batch
            whole = int(np.searchsorted(row, row[-1])) if len(row) else 0
            if whole:
                add(carried.slice(0, whole))
                carried = carried.slice(whole)
        if carried is not None and carried.num_rows:
            add(carried)
        sums = [squares[left, right], squares[right, left], crossed[left, right]]
        columns = [pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), *[pa.array(s) for s in sums]]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "xx", "yy", "xy"])

    sums = dealt.mapInArrow(run, "i int, j int, xx double, yy double, xy double").groupBy("i", "j")
    return sums.agg(*[F.sum(c).alias(c) for c in ("xx", "yy", "xy")])


def rank_correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows (a, b, r): the rank correlation of each pair over rows where both are present.

    Ties share their average rank; NaN counts as missing and infinite values are ranked. A pair
    without two different values of each of its columns there has no r.
    """
    spark = df.sparkSession
    k = len(cols)
    listed = [(i, j, cols[i], cols[j]) for i in range(k) for j in range(i + 1, k)]
    pairs = spark.createDataFrame(listed, "i int, j int, a string, b string")
    if not listed:
        return pairs.select("a", "b", F.lit(None).cast("double").alias("r"))
    rows = cut_lineage(doubles(df, cols).withColumn("row", F.monotonically_increasing_id()), "rank-rows")
    together = _together(rows.drop("row"), k)
    classes = _classes(together)
    width = int(classes.max()) + 1
    bins = max(shuffle_width(spark), -(-int(np.trace(together)) * width // HELD))
    dealt = _entries(rows, classes).repartitionByRange(bins, "col", "value", "row")
    dealt = cut_lineage(dealt.withColumn("bin", F.spark_partition_id()), "rank-bins")
    sums = _products(_ranked(dealt, _places(_pieces(dealt, width)), width), classes, together)
    r = F.greatest(F.least(F.col("xy") / F.sqrt("xx") / F.sqrt("yy"), F.lit(1.0)), F.lit(-1.0))
    varies = (F.col("xx") > 0) & (F.col("yy") > 0)
    return pairs.join(sums, ["i", "j"], "left").select("a", "b", F.when(varies, r).alias("r"))
