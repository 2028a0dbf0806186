"""Exact ranks, running totals and quantiles without one large sorted task.

Every ordered operator here works in two levels.  Rows are dealt by range of (group, key)
into as many bins as the session shuffles into, bin totals are summed in order, and only
rows of one bin are sorted together.  A bin holds its share of all rows, whatever the
groups: a hot group spans many bins and many small groups share one.  The dealt rows are
written to the shared folder, so every later stage and every re-run sees the same bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_width


def _names(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def with_bin(df: DataFrame, keys: list[str], name: str = "_bin") -> DataFrame:
    """Adds the ordinal of the range of key tuples that holds the row; writes the rows once."""
    dealt = df.repartitionByRange(shuffle_width(df.sparkSession), *keys)
    return cut_lineage(dealt.withColumn(name, F.spark_partition_id()), "ordered")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"_r_{k}"])
    return cond


def running_before(df: DataFrame, order, sums: dict[str, str], by=()) -> DataFrame:
    """For every row, the sum of each column over the rows strictly earlier in its group.

    ``order`` names columns that, with ``by``, are unique per row; ascending order.
    """
    by, order = _names(by), _names(order)
    rows = with_bin(df, by + order)
    keys = by + ["_bin"]
    totals = rows.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_w_{n}") for n, c in sums.items()])
    joined = inner.join(offsets, _same(inner, offsets, keys), "left")
    return joined.select(*df.columns, *[(F.col(f"_w_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def global_index(df: DataFrame, order, name: str = "idx", by=()) -> DataFrame:
    """Dense 0-based position of every row in its group, unique order required."""
    return running_before(df.withColumn("_one", F.lit(1).cast("long")), order, {name: "_one"}, by).drop("_one")


def value_counts_table(df: DataFrame, value: str, by=()) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*_names(by), value).agg(F.count(F.lit(1)).alias("n"))


def percentiles(df: DataFrame, value: str, probs: list[float], by=(), names: list[str] | None = None) -> DataFrame:
    """Exact linearly interpolated percentiles per group.

    Values are counted first, so no task ever holds the raw rows of a group.
    """
    by = _names(by)
    names = names or [f"p{round(p * 100)}" for p in probs]
    counts = value_counts_table(df.withColumn(value, F.col(value).cast("double")), value, by)
    ranked = running_before(counts, [value], {"_lo": "n"}, by)
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("_size"))
    if by:
        sizes = sizes.select(*[F.col(k).alias(f"_r_{k}") for k in by], "_size")
        ranked = ranked.join(sizes, _same(ranked, sizes, by), "inner")
    else:
        ranked = ranked.withColumn("_size", sizes.scalar())

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_lo")) & (rank < F.col("_lo") + F.col("n")), F.col(value)))

    picks = []
    for i, p in enumerate(probs):
        pos = (F.col("_size") - 1) * F.lit(float(p))
        picks += [at(F.floor(pos)).alias(f"_a{i}"), at(F.ceil(pos)).alias(f"_b{i}")]
    out = ranked.groupBy(*by).agg(F.max("_size").alias("_size"), *picks)
    results = []
    for i, (p, name) in enumerate(zip(probs, names)):
        pos = (F.col("_size") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_a{i}"), F.col(f"_b{i}")
        results.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*by, *results)


def average_rank(df: DataFrame, value: str, by=(), name: str = "rank") -> DataFrame:
    """(by, value, n, rank) with tie-averaged 1-based ranks, one row per distinct value."""
    counts = value_counts_table(df, value, by)
    ranked = running_before(counts, [value], {"_lo": "n"}, by)
    return ranked.withColumn(name, F.col("_lo") + (F.col("n") + 1) / 2.0).drop("_lo")


def top_n(df: DataFrame, by, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of every group, trimmed in hash-salted parts and then whole."""
    by = _names(by)

    def trim(frame: DataFrame, keys: list) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        return frame.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")

    width = shuffle_width(df.sparkSession)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(width)))
    return trim(trim(salted, by + ["_salt"]).drop("_salt"), by)


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """One row per key, the smallest by ``order``; combines before the shuffle."""
    keys, order = _names(keys), _names(order)
    rest = [c for c in df.columns if c not in keys]
    lead = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    packed = F.struct(*lead, *[F.col(c) for c in rest])
    best = df.groupBy(*keys).agg(F.min(packed).alias("_b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in df.columns])
