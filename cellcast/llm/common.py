"""What several operators share: work tables, replaced columns, ranks and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: A word of the contracts: a run of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]++"
SPACES = " \t\n\x0b\x0c\r"


def fold(*columns: str) -> Column:
    """crc32 of a column's text, as the contracts deal rows to folds."""
    return reduce(lambda a, b: F.concat(a, b), [F.col(c).cast("string") for c in columns])


def held_out(key: str, parts: int, remainder: int) -> Column:
    """Whether crc32 of the key as text leaves ``remainder``; a null key is never held out."""
    return F.coalesce(F.crc32(fold(key)) % parts == remainder, F.lit(False))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns an operator is about to add, whatever their letter case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for work columns that no column of ``df`` has, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def rows_where(df: DataFrame, column: str, judge: Callable[[], Callable[[object], bool]], kind: str) -> DataFrame:
    """The rows of ``df`` whose ``column``, cast to ``kind``, a Python test accepts, unchanged.

    ``judge`` makes the test, once in each task.
    """
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"`{column}`").cast(kind).alias(fresh(df, "judged")[0]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepts = judge()
        for batch in batches:
            mask = pa.array([accepts(v.as_py()) for v in batch.column(batch.num_columns - 1)], pa.bool_())
            kept = pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1])
            yield kept.filter(mask)

    return rows.mapInArrow(run, schema)


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Adds the 1-based position in the given total order, without one task for all rows.

    Rows are sorted by range; a row's place is its place in its partition plus the sizes of
    the partitions before. Only those sizes, one row a partition, meet in one task.
    """
    placed = cut_lineage(
        df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked"
    )
    part = F.shiftright(F.col("_at"), 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at") - F.shiftleft(F.col("_part"), 33) + 1
    return (
        placed.withColumn("_part", part)
        .join(starts, "_part")
        .withColumn(name, place)
        .drop("_at", "_part", "_start")
    )


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges (hi, lo) as one edge from each vertex to the least it is connected to."""
    root: dict[int, int] = {}

    def least(v: int) -> int:
        while (up := root.setdefault(v, v)) != v:
            root[v] = root[up]
            v = up
        return v

    for batch in batches:
        for hi, lo in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = least(hi), least(lo)
            root[max(a, b)] = min(a, b)
    rows = [(v, least(v)) for v in list(root)]
    rows = [r for r in rows if r[0] != r[1]]
    for at in range(0, len(rows), 1 << 16):
        part = rows[at : at + (1 << 16)]
        columns = [pa.array([r[k] for r in part], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, names=["hi", "lo"])


def components(edges: DataFrame, held: int = 1 << 18) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (id, component), the smallest id reachable.

    Edges are dealt evenly to tasks of at most about ``held``, each of which leaves a forest of
    stars. If that takes one task, all is done; else large-star and small-star steps follow, and
    so on until no edge changes; each is written to the shared folder. The smallest neighbours
    are written before they are joined, so that a vertex with very many edges can be split by
    the join. Null ends and loops are ignored; vertices without an edge are not returned.
    """
    pairs = edges.select(
        F.greatest("a", "b").cast("long").alias("hi"), F.least("a", "b").cast("long").alias("lo")
    ).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    stars = cut_lineage(pairs.distinct(), "stars")
    print_before = None
    while True:
        tasks = -(-stars.count() // held)
        if not tasks:
            break
        dealt = stars.repartition(tasks, "hi", "lo") if tasks > 1 else stars.repartition(1)
        stars = cut_lineage(dealt.mapInArrow(_forest, "hi bigint, lo bigint"), "stars")
        if tasks == 1:
            break
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            stars.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        least = least.select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u moves to the smallest vertex around u
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(
            F.col("v").alias("hi"), F.col("m").alias("lo")
        )
        large = cut_lineage(large.distinct(), "large")
        # small star: u and its smaller neighbours move to the smallest of them
        down = cut_lineage(large.groupBy("hi").agg(F.min("lo").alias("m")), "down")
        small = (
            large.join(down, "hi")
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
                        F.struct(F.col("hi"), F.col("m").alias("lo")),
                    )
                ).alias("e")
            )
            .select("e.hi", "e.lo")
            .where(F.col("hi") > F.col("lo"))
        )
        stars = cut_lineage(small.distinct(), "stars")
        print_now = stars.agg(
            F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi", F.lit(1)))
        ).first()
        if print_now == print_before:
            break
        print_before = print_now
    roots = stars.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return stars.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(roots)
