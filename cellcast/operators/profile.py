"""Column profiling: counts, moments, quantiles, correlations, quality flags."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .ordered import percentiles, running_before, top_n
from .rankcorr import rank_correlations
from .wide import doubles, pair_correlations, wide_percentiles

# Thresholds of the profile report.
MISSING_TIERS = ((90.0, "critical"), (75.0, "high"), (50.0, "moderate"), (25.0, "low"))
SKEW_LIMIT = 2.0
KURTOSIS_LIMIT = 7.0
IQR_FACTOR = 3.0
HIGH_CORR = 0.90
NEAR_CONSTANT = 0.98
HIGH_CARDINALITY = 100
ZERO_VARIANCE = 1e-10
# leading characters that order texts before they are fetched
HEAD = 32
SIZE_EDGES = (0.0, 0.25, 1.0, 10.0, 100.0, 300.0, 1000.0, 5000.0)
SIZE_LABELS = ("<0.25", "0.25-1", "1-10", "10-100", "100-300", "300-1k", "1k-5k", ">5k")
SIZE_PERCENTILES = (0, 5, 10, 25, 50, 75, 90, 95, 99, 100)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def melt(df: DataFrame, cols: list[str], kind: str = "double") -> DataFrame:
    """(column, value) rows; NaN becomes null for doubles."""
    parts = []
    for c in cols:
        value = F.col(c).cast(kind)
        if kind == "double":
            value = F.when(~F.isnan(value), value)
        parts.append(F.struct(F.lit(c).alias("column"), value.alias("value")))
    return df.select(F.explode(F.array(*parts)).alias("m")).select("m.column", "m.value")


def share(part: Column, whole: Column, digits: int) -> Column:
    return F.round(F.try_divide(part * 100.0, whole), digits)


# ---------------------------------------------------------------- counts


def value_counts(df: DataFrame, col: str, n: int | None = None, dropna: bool = True, digits: int = 2) -> DataFrame:
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.where(F.col(col).isNotNull()) if dropna else df
    out = rows.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    out = out.withColumn("pct", share(F.col("count"), total, digits))
    ordered = out.orderBy(F.desc("count"), F.asc_nulls_last(col))
    return ordered.limit(n) if n else ordered


def _digest(text: Column) -> list[Column]:
    """128 bits that stand for a text; null for null."""
    return [F.when(text.isNotNull(), F.xxhash64(F.lit(i), text)).alias(f"d{i}") for i in (1, 2)]


def _digests(df: DataFrame, cols: list[str], *more) -> DataFrame:
    """(column, d1, d2) of each value's text form, and what ``more`` makes of the text."""
    parts = []
    for c in cols:
        text = F.col(c).cast("string")
        parts.append(F.struct(F.lit(c).alias("column"), *_digest(text), *[make(text) for make in more]))
    return df.select(F.explode(F.array(*parts)).alias("m")).select("m.*")


def digest_counts(df: DataFrame, cols: list[str], head: int = 0) -> DataFrame:
    """(column, d1, d2, n) over text forms of many columns, one shuffle of digests.

    No text is moved, however long; a common value is counted within tasks first. ``head``
    adds that many leading characters, by which most texts can be ordered.
    """
    more = [lambda text: F.substring(text, 1, head).alias("head")] if head else []
    rows = _digests(df, cols, *more)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def frequent_texts(df: DataFrame, counts: DataFrame, cols: list[str], n: int) -> DataFrame:
    """The ``n`` commonest texts of each column with their counts, the smaller text first on ties.

    ``counts`` are ``digest_counts`` with a head.  Count and head leave few candidates; a second
    scan gets their texts only, so the ties that are moved are those whose heads are equal too.
    """
    present = counts.where(F.col("d1").isNotNull())
    # one row a column is left of the last ones
    last = top_n(present, "column", [F.desc("n"), F.asc("head")], n)
    low = last.groupBy("column").agg(F.min("n").alias("low"))
    edge = last.join(low, "column").where(F.col("n") == F.col("low")).groupBy("column", "low").agg(F.max("head").alias("tail"))
    near = (F.col("n") > F.col("low")) | ((F.col("n") == F.col("low")) & (F.col("head") <= F.col("tail")))
    wanted = present.join(F.broadcast(edge), "column").where(near).select("column", "d1", "d2", "n")
    wanted = cut_lineage(wanted, "frequent")
    texts = _digests(df, cols, lambda text: text.alias("value")).where(F.col("d1").isNotNull())
    found = texts.join(wanted, ["column", "d1", "d2"]).groupBy("column", "value", "n").agg(F.count(F.lit(1)).alias("_"))
    return top_n(found.drop("_"), "column", [F.desc("n"), F.asc("value")], n)


def missing_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or df.columns
    parts = []
    for c in cols:
        absent = F.col(c).isNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            absent = absent | F.isnan(c)
        parts.append(F.count(F.when(absent, 1)).alias(c))
    flat = df.agg(F.count(F.lit(1)).alias("_rows"), *parts)
    long = flat.select(
        "_rows",
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in cols])).alias("m"),
    )
    pct = F.try_divide(F.col("m.missing") * 100.0, F.col("_rows"))
    tier = F.when(F.col("missing_pct") >= MISSING_TIERS[0][0], MISSING_TIERS[0][1])
    for limit, name in MISSING_TIERS[1:]:
        tier = tier.when(F.col("missing_pct") >= limit, name)
    tier = tier.when(F.col("missing_pct") > 0, "minimal").otherwise("complete")
    return long.select(
        F.col("m.column").alias("column"),
        F.col("m.missing").alias("missing"),
        F.round(pct, 4).alias("missing_pct"),
        (F.col("_rows") - F.col("m.missing")).alias("present"),
        F.round(F.lit(100.0) - pct, 4).alias("present_pct"),
    ).withColumn("tier", tier)


def tier_breakdown(summary: DataFrame) -> DataFrame:
    return summary.groupBy("tier").agg(F.count(F.lit(1)).alias("columns"))


def null_overview(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return missing_summary(df, cols).agg(
        F.count(F.when(F.col("missing") > 0, 1)).alias("columns_with_nulls"),
        F.round(F.avg("missing_pct"), 4).alias("mean_missing_pct"),
        F.max("missing_pct").alias("max_missing_pct"),
    )


def exact_duplicates(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each distinct row."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.sum("_n").alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicates"),
    )


def distinct_counts(df: DataFrame, cols: list[str], include_null: bool = False, approx: bool = False) -> DataFrame:
    if approx:
        flat = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
        parts = [F.struct(F.lit(c).alias("column"), F.col(c).alias("distinct")) for c in cols]
        return flat.select(F.explode(F.array(*parts)).alias("m")).select("m.*")
    counts = digest_counts(df, cols)
    kept = F.count(F.lit(1)) if include_null else F.count("d1")
    return counts.groupBy("column").agg(kept.alias("distinct"))


# ---------------------------------------------------------------- numeric


def _stacked(rows: DataFrame, cols: list[str], wanted: dict[str, str]) -> DataFrame:
    """Rows (column, *wanted) of aggregates of columns c0, c1, ..., named ``cols``, made together.

    ``wanted`` are aggregates in which ``{c}`` stands for the column.
    """
    flat = rows.selectExpr(*[f"{make.format(c=f'c{i}')} as {name}_{i}" for i in range(len(cols)) for name, make in wanted.items()])
    quoted = [c.replace("\\", "\\\\").replace("'", "\\'") for c in cols]
    cells = [f"'{c}', " + ", ".join(f"{name}_{i}" for name in wanted) for i, c in enumerate(quoted)]
    return flat.selectExpr(f"stack({len(cols)}, {', '.join(cells)}) as (column, {', '.join(wanted)})")


def numeric_summary(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Count, moments, range and percentiles of numeric columns; infinite values are only counted."""
    cols = cols or numeric_columns(df)
    finite = "if(abs({c}) < double('infinity'), {c}, null)"
    wanted = {
        "count": "count({c})",
        "mean": f"avg({finite})",
        "std": f"stddev_samp({finite})",
        "var": f"var_samp({finite})",
        "min": f"min({finite})",
        "max": f"max({finite})",
        "inf_count": f"count({{c}}) - count({finite})",
    }
    probs, names = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99], ["p5", "q1", "median", "q3", "p95", "p99"]
    if not exact:
        wanted["q"] = f"percentile_approx({finite}, array({', '.join(map(str, probs))}), 10000)"
    moments = _stacked(doubles(df, cols), cols, wanted)
    if exact:
        summary = moments.join(wide_percentiles(df, cols, probs, names), "column", "left")
    else:
        summary = moments.select("*", *[F.col("q")[i].alias(n) for i, n in enumerate(names)]).drop("q")
    return summary.withColumn("iqr", F.col("q3") - F.col("q1"))


def shape_moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis with report flags, in one scan."""
    wanted = {"n": "cast(count({c}) as double)", "g1": "skewness({c})", "g2": "kurtosis({c})"}
    raw = _stacked(doubles(df, cols), cols, wanted)
    n = F.col("n")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return raw.select("column", skew.alias("skewness"), kurt.alias("kurtosis")).select(
        "*",
        (F.abs("skewness") > SKEW_LIMIT).alias("highly_skewed"),
        (F.abs("kurtosis") > KURTOSIS_LIMIT).alias("heavy_tailed"),
    )


def iqr_outliers(df: DataFrame, cols: list[str], factor: float = IQR_FACTOR) -> DataFrame:
    """Fences and the values beyond them of every column that has a value.

    One row of quartiles for each column, bounded by the schema, becomes part of the plan.
    """
    quartiles = wide_percentiles(df, cols, [0.25, 0.75], ["q1", "q3"], finite=False).where("q1 is not null").collect()
    fences = {q["column"]: (q["q1"] - (q["q3"] - q["q1"]) * factor, q["q3"] + (q["q3"] - q["q1"]) * factor) for q in quartiles}
    if not fences:
        return df.sparkSession.createDataFrame([], "column string, low double, high double, outliers bigint, outlier_pct double")
    used = [c for c in cols if c in fences]
    ends = [[f"double('{x!r}')" for x in fences[c]] for c in used]
    rows = doubles(df, used)
    marks = [x for i, (low, high) in enumerate(ends) for x in (f"c{i}", f"c{i} < {low} or c{i} > {high} as o{i}")]
    counts = [x for i in range(len(used)) for x in (f"count(c{i}) as n{i}", f"count_if(o{i}) as x{i}")]
    counted = rows.selectExpr(*marks).selectExpr(*counts)
    names = [c.replace("\\", "\\\\").replace("'", "\\'") for c in used]
    cells = [f"'{c}', {low}, {high}, x{i}, n{i}" for i, (c, (low, high)) in enumerate(zip(names, ends))]
    found = counted.selectExpr(f"stack({len(used)}, {', '.join(cells)}) as (column, low, high, outliers, n)")
    return found.select("column", "low", "high", "outliers", F.round(F.col("outliers") * 100.0 / F.col("n"), 4).alias("outlier_pct"))


def top_variance(df: DataFrame, cols: list[str], n: int) -> DataFrame:
    out = _stacked(doubles(df, cols), cols, {"variance": "var_samp({c})"})
    return out.orderBy(F.desc("variance"), "column").limit(n)


# ---------------------------------------------------------------- correlation


def pearson_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Upper triangle of the correlation matrix; constant columns give null."""
    return pair_correlations(df, list(combinations(cols, 2)))


def pearson_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    upper = pearson_pairs(df, cols)
    both = F.array(
        F.struct(F.col("a").alias("a"), F.col("b").alias("b"), F.col("r")),
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("r")),
    )
    return upper.where(F.col("r").isNotNull()).select(F.explode(both).alias("m")).select("m.*")


def high_corr_pairs(pairs: DataFrame, limit: float = HIGH_CORR) -> DataFrame:
    kept = pairs.where(F.abs("r") >= limit).withColumn("abs_r", F.abs("r"))
    return kept.orderBy(F.desc("abs_r"), "a", "b")


def corr_with(df: DataFrame, cols: list[str], target: str, n: int = 40) -> DataFrame:
    out = pair_correlations(df, [(c, target) for c in cols if c != target])
    return out.orderBy(F.desc(F.abs("r")), "a").limit(n).select(F.col("a").alias("column"), "r")


def spearman_pairs(df: DataFrame, cols: list[str], keep: Column | None = None) -> DataFrame:
    """Rank correlation of every pair with tie-averaged ranks.

    Each pair uses the rows where both are present.  ``keep`` optionally restricts the rows
    (the sampled form of the report).
    """
    return rank_correlations(df if keep is None else df.where(keep), cols)


# ---------------------------------------------------------------- group contrasts


def effect_size(df: DataFrame, cols: list[str], flag: str, min_rows: int = 5) -> DataFrame:
    """Absolute Cohen's d between flag = 1 and flag = 0 rows, in one scan."""
    # a column of each side's values
    halves = [F.when(F.col(flag) == g, F.col(c).cast("double")).alias(f"h{i}_{g}") for i, c in enumerate(cols) for g in (0, 1)]
    sides = df.select(*halves)
    rows = doubles(sides, sides.columns).toDF(*[f"c{i}_{g}" for i in range(len(cols)) for g in (0, 1)])
    wanted = {f"{name}{g}": f"{make}({{c}}_{g})" for g in (0, 1) for name, make in (("n", "count"), ("m", "avg"), ("v", "var_samp"))}
    wide = _stacked(rows, cols, wanted)
    pooled = F.sqrt((F.col("v0") + F.col("v1")) / 2)
    return wide.where((F.col("n0") >= min_rows) & (F.col("n1") >= min_rows)).select(
        "column", (F.abs(F.col("m1") - F.col("m0")) / (pooled + 1e-10)).alias("cohens_d")
    )


def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, relative error under 1.2e-7."""
    # Chebyshev coefficients of the rational approximation.
    coeffs = (
        -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
        0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
    )
    t = F.lit(1.0) / (x * 0.5 + 1.0)
    poly = F.lit(coeffs[-1])
    for c in reversed(coeffs[:-1]):
        poly = poly * t + c
    return t * F.exp(poly - x * x)


def mann_whitney(df: DataFrame, cols: list[str], flag: str, min_rows: int = 5) -> DataFrame:
    """Two-sided U test (normal approximation with tie and continuity correction).

    U counts for the flag = 0 side, from tie-averaged rank sums over value counts.
    """
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]
    long = df.where(F.col(flag).isin(0, 1)).select(F.col(flag).alias("_g"), F.explode(F.array(*parts)).alias("m"))
    long = long.select("_g", "m.*").where(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = long.groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_g") == 0, 1)).alias("n0")
    )
    ranked = running_before(counts, ["value"], {"lo": "n"}, by="column")
    rank = F.col("lo") + (F.col("n") + 1) / 2.0
    n = F.col("n").cast("double")
    sums = ranked.groupBy("column").agg(
        F.sum("n0").cast("double").alias("n0"),
        F.sum(F.col("n") - F.col("n0")).cast("double").alias("n1"),
        F.sum(F.col("n0") * rank).alias("r0"),
        F.sum(n * n * n - n).alias("ties"),
    )
    sums = sums.where((F.col("n0") >= min_rows) & (F.col("n1") >= min_rows))
    n0, n1 = F.col("n0"), F.col("n1")
    size = n0 + n1
    u = F.col("r0") - n0 * (n0 + 1) / 2
    sd = F.sqrt(n0 * n1 / 12 * (size + 1 - F.col("ties") / (size * (size - 1))))
    z = F.greatest(F.abs(u - n0 * n1 / 2) - 0.5, F.lit(0.0)) / sd
    p = F.when(sd == 0, F.lit(1.0)).otherwise(F.least(_erfc(z / (2**0.5)), F.lit(1.0)))
    return sums.select("column", u.alias("u"), p.alias("p_value"))


# ---------------------------------------------------------------- periods, regions, bins


def counts_by_period(df: DataFrame, period: Column, size: str | None = None, name: str = "period") -> DataFrame:
    """Rows and share per period, with sum, mean and median of ``size`` when named."""
    keep = [period.alias(name)] + ([F.col(size)] if size else [])
    rows = df.select(*keep)
    total = df.agg(F.count(F.lit(1))).scalar()
    aggs = [F.count(F.lit(1)).alias("count")]
    if size:
        aggs += [F.sum(size).alias("total"), F.avg(size).alias("mean")]
    out = rows.where(F.col(name).isNotNull()).groupBy(name).agg(*aggs)
    out = out.withColumn("pct", share(F.col("count"), total, 2))
    if size:
        medians = percentiles(rows.where(F.col(name).isNotNull()), size, [0.5], by=name, names=["median"])
        out = out.join(medians, name, "left")
    return out


def pivot_counts(df: DataFrame, rows: str, cols: str, values: list) -> DataFrame:
    """Counts with a fixed column list, absent combinations as 0."""
    return df.groupBy(rows).pivot(cols, values).count().na.fill(0)


def grouped_mean_pivot(df: DataFrame, rows: str, cols: str, values: list, measure: str) -> DataFrame:
    return df.groupBy(rows).pivot(cols, values).agg(F.avg(measure))


def duration_stats(df: DataFrame, start: str, end: str, limit: int = 3650) -> DataFrame:
    days = F.date_diff(F.col(end), F.col(start))
    rows = df.select(days.alias("days"))
    used = F.when(F.col("days").between(0, limit - 1), F.col("days"))
    base = rows.agg(
        F.avg(used).alias("mean"),
        F.max(used).alias("max"),
        F.count(used).alias("with_duration"),
        F.count(F.when(F.col("days").isNull(), 1)).alias("missing"),
    )
    quant = percentiles(rows.select(used.alias("days")), "days", [0.5, 0.9, 0.95], names=["median", "p90", "p95"])
    # both sides are single-row aggregates
    return base.withColumn("_q", quant.select(F.struct("*")).scalar()).select("*", "_q.*").drop("_q")


def median_by_top(df: DataFrame, key: str, size: str, n: int = 20) -> DataFrame:
    """Count and median of ``size`` for the ``n`` most frequent keys."""
    top = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    top = top.orderBy(F.desc("count"), key).limit(n)
    med = percentiles(df.join(F.broadcast(top.select(key)), key, "left_semi"), size, [0.5], by=key, names=["median"])
    return top.join(med, key, "left")


def coordinate_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean, median, spread, range, quartiles and count of coordinates, to six digits."""
    found = numeric_summary(df, cols)
    return found.select("column", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std", "min", "max", "q1", "q3")], "count")


def bin_counts(df: DataFrame, col: str, edges=SIZE_EDGES, labels=SIZE_LABELS) -> DataFrame:
    """Right-closed bins; values at or below the first edge belong to none."""
    v = F.col(col).cast("double")
    bin_no = F.lit(None).cast("int")
    for i in range(len(edges)):
        low = v > edges[i]
        bin_no = F.when(low & (v <= edges[i + 1]) if i + 1 < len(edges) else low, i).otherwise(bin_no)
    total = df.agg(F.count(F.when(v.isNotNull(), 1))).scalar()
    names = F.array(*[F.lit(x) for x in labels])
    out = df.select(bin_no.alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    out = out.withColumn("label", F.element_at(names, F.col("bin") + 1))
    return out.withColumn("pct", share(F.col("count"), total, 1))


def percentile_list(df: DataFrame, col: str, probs=SIZE_PERCENTILES) -> DataFrame:
    names = [f"p{p}" for p in probs]
    wide = percentiles(df, col, [p / 100 for p in probs], names=names)
    parts = [F.struct(F.lit(p).alias("percentile"), F.col(n).alias("value")) for p, n in zip(probs, names)]
    return wide.select(F.explode(F.array(*parts)).alias("m")).select("m.*")


def histogram(df: DataFrame, col: str, bins: int, low: float, high: float, by: str | None = None) -> DataFrame:
    """Equal-width counts and densities on [low, high], last bin closed."""
    v = F.col(col).cast("double")
    width = (high - low) / bins
    bin_no = F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("int")
    keys = [by] if by else []
    rows = df.where(v.between(low, high)).select(*keys, bin_no.alias("bin"))
    counts = rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    return counts.select(
        *keys,
        "bin",
        (F.col("bin") * width + low).alias("left"),
        "count",
        (F.col("count") / (F.sum("count").over(whole) * width)).alias("density"),
    )


def auto_histogram(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """Histogram between the 1st and 99th percentile, min(60, max(20, n^0.4)) bins."""
    edges = percentiles(df, col, [0.01, 0.99], names=["low", "high"])
    size = df.agg(F.count(col).alias("n"))
    spec = edges.withColumn("n", size.scalar()).first()
    bins = int(min(60, max(20, spec["n"] ** 0.4)))
    low, high = (0.0, 0.0) if spec["low"] is None else (spec["low"], spec["high"])
    if low == high:  # one value in the middle of a unit range
        low, high = low - 0.5, high + 0.5
    return histogram(df, col, bins, low, high, by)


def box_stats(df: DataFrame, col: str, by: str, factor: float = 1.5) -> DataFrame:
    """Quartiles and whiskers (extreme values inside the fences) per group."""
    rows = df.select(by, F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    q = percentiles(rows, "v", [0.25, 0.5, 0.75], by=by, names=["q1", "median", "q3"])
    counts = rows.groupBy(by, "v").agg(F.count(F.lit(1)).alias("n")).join(q, by)
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col("v") >= F.col("q1") - iqr * factor) & (F.col("v") <= F.col("q3") + iqr * factor)
    return counts.groupBy(by).agg(
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("fliers"),
    )


def density_curve(df: DataFrame, col: str, points: int = 300, fine: int = 4096) -> DataFrame:
    """Gaussian kernel density on an even grid.

    The data is first counted into ``fine`` narrow bins, so the kernel sum has at most
    ``points * fine`` terms whatever the row count.
    """
    v = F.col(col).cast("double")
    spec = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.stddev_samp(v).alias("sd"), F.count(v).alias("n")).first()
    lo, hi, n = spec["lo"], spec["hi"], spec["n"]
    if not spec["sd"]:  # no value, one value, or all alike: there is no density
        return df.sparkSession.createDataFrame([], "x double, density double")
    bandwidth = spec["sd"] * n ** (-0.2)
    width = (hi - lo) / fine
    counts = (
        df.where(v.isNotNull())
        .select(F.least(F.floor((v - lo) / width), F.lit(fine - 1)).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    step = (hi - lo) / (points - 1)
    xs = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * step + lo)
    centre = (F.col("bin") + 0.5) * width + lo
    spread = counts.select(centre.alias("c"), "n", F.posexplode(xs).alias("i", "x"))
    z = (F.col("x") - F.col("c")) / bandwidth
    kernel = F.sum(F.col("n") * F.exp(z * z * -0.5)) / (n * bandwidth * (2 * 3.141592653589793) ** 0.5)
    return spread.groupBy("i").agg(F.max("x").alias("x"), kernel.alias("density")).drop("i")


# ---------------------------------------------------------------- column quality


NON_NEGATIVE_HINTS = ("size", "count", "price", "quantity", "dist", "pop", "prcp", "area")


def column_quality(df: DataFrame, cols: list[str] | None = None, non_negative=NON_NEGATIVE_HINTS) -> DataFrame:
    """One row per column with dominance, cardinality and sign checks and flag text."""
    cols = cols or df.columns
    numeric = set(numeric_columns(df))
    nan = [F.col(f"d{i}") == d for i, d in enumerate(_digest(F.lit("NaN")), 1)]
    valid = F.coalesce(~(nan[0] & nan[1]), F.lit(False))
    by_col = digest_counts(df, cols).groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(~valid, F.col("n")).otherwise(0)).alias("missing"),
        F.count(F.when(valid, 1)).alias("unique"),
        F.max(F.when(valid, F.col("n"))).alias("most"),
    )
    wanted = {
        "std": "stddev_samp({c})",
        "lo": "min({c})",
        "hi": "max({c})",
        "inf": "count_if(abs({c}) = double('infinity'))",
        "negative": "count_if({c} < 0)",
    }
    measured = [c for c in cols if c in numeric]
    none = "column string, std double, lo double, hi double, inf bigint, negative bigint"
    nums = _stacked(doubles(df, measured), measured, wanted) if measured else df.sparkSession.createDataFrame([], none)
    joined = by_col.join(nums, "column", "left")
    is_num = F.col("column").isin(*numeric) if numeric else F.lit(False)
    present = F.col("rows") - F.col("missing")
    constant = F.col("unique") <= 1
    dominant = F.when(constant, F.lit(0.0)).otherwise(F.try_divide(F.col("most"), present))
    hinted = F.lit(False)
    for hint in non_negative:
        hinted = hinted | F.lower("column").contains(hint)
    facts = joined.select(
        "column",
        "unique",
        F.round(F.col("missing") * 100.0 / F.col("rows"), 4).alias("missing_pct"),
        constant.alias("is_constant"),
        (dominant >= NEAR_CONSTANT).alias("is_near_constant"),
        F.round(dominant, 4).alias("dominant_fraction"),
        F.coalesce(F.col("std") < ZERO_VARIANCE, F.lit(False)).alias("zero_variance"),
        F.coalesce((F.col("lo") == 0) & (F.col("hi") == 0) & (F.col("missing") == 0), F.lit(False)).alias("all_zeros"),
        (~is_num & (F.col("unique") > HIGH_CARDINALITY)).alias("high_cardinality"),
        F.coalesce(F.col("inf"), F.lit(0)).alias("inf_count"),
        F.when(is_num & hinted, F.col("negative")).otherwise(F.lit(0)).alias("negative_count"),
    )
    flags = F.array_compact(
        F.array(
            F.when(F.col("is_constant"), "CONSTANT"),
            F.when(F.col("is_near_constant"), "NEAR_CONSTANT"),
            F.when(F.col("zero_variance"), "ZERO_VARIANCE"),
            F.when(F.col("all_zeros"), "ALL_ZEROS"),
            F.when(F.col("high_cardinality"), F.concat(F.lit("HIGH_CARD("), F.col("unique"), F.lit(")"))),
            F.when(F.col("inf_count") > 0, F.concat(F.lit("HAS_INF("), F.col("inf_count"), F.lit(")"))),
            F.when(F.col("negative_count") > 0, F.concat(F.lit("NEG("), F.col("negative_count"), F.lit(")"))),
        )
    )
    flagged = facts.withColumn("flags", F.array_join(flags, "; "))
    return flagged.withColumn("status", F.when(F.col("flags") == "", "PASS").otherwise("REVIEW"))


def duplicate_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pairs of columns that agree on every row.

    Order-free fingerprints of the value multisets shortlist pairs; each pair is then
    verified row by row.
    """
    cols = cols or df.columns
    # hashed as text, so 1 and 1.0 stay different columns
    prints = df.agg(
        *[F.sum(F.xxhash64(F.col(c).cast("string")).cast("decimal(20,0)")).alias(c) for c in cols]
    ).first()
    groups: dict[object, list[str]] = {}
    for c in cols:
        groups.setdefault(prints[c], []).append(c)
    # each column of a shortlist is compared with its first; those that differ are left for
    # another round, so a shortlist of equal columns takes one pass and no pairs
    waiting, pairs = [g for g in groups.values() if len(g) > 1], []
    while waiting:
        tests = [(g[0], c) for g in waiting for c in g[1:]]
        differ = [F.count(F.when(~F.col(a).cast("string").eqNullSafe(F.col(b).cast("string")), 1)) for a, b in tests]
        unequal = {c for (_, c), n in zip(tests, df.agg(*differ).first()) if n}
        pairs += [p for g in waiting for p in combinations([c for c in g if c not in unequal], 2)]
        waiting = [r for g in waiting if len(r := [c for c in g if c in unequal]) > 1]
    return df.sparkSession.createDataFrame(sorted(pairs, key=lambda p: (cols.index(p[0]), cols.index(p[1]))), "a string, b string")


# What the report says of a column by words of its name; the first that fits wins.
DESCRIPTIONS = (
    ("LAT", "Latitude coordinate"),
    ("LON", "Longitude coordinate"),
    ("DATE", "Date field"),
    ("DOY", "Day of year"),
    ("ELEV", "Elevation (meters)"),
    ("SLOPE", "Terrain slope"),
    ("PDSI|DROUGHT", "Drought index"),
    ("NDVI|EVI|NBR", "Vegetation index"),
    ("TMAX|TMIN|TAVG", "Temperature variable"),
    ("PRCP|RAIN|PRECIP", "Precipitation variable"),
    ("WIND|AWND|WSF", "Wind variable"),
    ("POP|POPDEN", "Population metric"),
    ("ROAD|HIGHWAY", "Road/infrastructure distance"),
    ("NLCD|LANDCOVER", "Land cover classification"),
    ("SOIL", "Soil property"),
    ("DEM|SRTM", "Digital elevation model"),
    ("ECOREGION|ECO3|ECO4", "Ecoregion classification"),
    ("FIPS|COUNTY", "Administrative geographic code"),
)
NO_DESCRIPTION = "No description available"


def describe_column(name: str, known: dict[str, str] | None = None) -> str:
    """What a column holds: the text ``known`` has for it, else by words of its name in any case."""
    by_words = (text for words, text in DESCRIPTIONS if any(w in name.upper() for w in words.split("|")))
    return (known or {}).get(name) or next(by_words, NO_DESCRIPTION)


def _named_type(kind: T.DataType) -> str | None:
    """The semantic type that a column's own type tells; None where its values decide."""
    if isinstance(kind, T.BooleanType):
        return "Boolean"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "Datetime"
    return "Numeric" if isinstance(kind, T.NumericType) else None


def semantic_type(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Numeric, Categorical, Datetime, Boolean, Text or Unknown per column."""
    return schema_profile(df, cols).select("column", "semantic_type", "unique", "present")


def semantic_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Columns per semantic type."""
    return semantic_type(df, cols).groupBy("semantic_type").agg(F.count(F.lit(1)).alias("columns"))


def schema_profile(df: DataFrame, cols: list[str] | None = None, known: dict[str, str] | None = None) -> DataFrame:
    """dtype, semantic type, example, distinct, present and missing counts, description per column.

    ``known`` has descriptions by column name; other columns are described by their names.
    """
    from ..functions.scalars import truncate_example

    cols = cols or df.columns
    facts = [(c, df.schema[c].dataType.simpleString(), _named_type(df.schema[c].dataType), describe_column(c, known)) for c in cols]
    facts = df.sparkSession.createDataFrame(facts, "column string, dtype string, named string, description string")
    n, there = F.col("n"), F.col("d1").isNotNull()
    stats = digest_counts(df, cols).groupBy("column").agg(
        F.count("d1").alias("unique"),
        F.sum(F.when(there, n).otherwise(0)).alias("present"),
        F.sum(F.when(there, 0).otherwise(n)).alias("missing"),
    )
    # one text a column and task
    least = df.agg(*[F.min(F.col(c).cast("string")).alias(f"c{i}") for i, c in enumerate(cols)])
    least = least.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("example")) for i, c in enumerate(cols)])).alias("m")
    ).select("m.*")
    stats = stats.join(least, "column")
    text = (F.col("unique") / F.col("present") > 0.5) | (F.col("unique") > 200)
    derived = F.when(F.col("present") == 0, "Unknown").when(text, "Text").otherwise("Categorical")
    return stats.join(F.broadcast(facts), "column").select(
        "column",
        "dtype",
        F.coalesce("named", derived).alias("semantic_type"),
        truncate_example("example").alias("example"),
        "unique",
        "present",
        "missing",
        share(F.col("missing"), F.col("missing") + F.col("present"), 4).alias("missing_pct"),
        "description",
    )


def dataset_overview(df: DataFrame) -> DataFrame:
    """Rows, columns and columns per dtype."""
    kinds: dict[str, int] = {}
    for f in df.schema:
        kinds[f.dataType.simpleString()] = kinds.get(f.dataType.simpleString(), 0) + 1
    parts = [F.struct(F.lit(k).alias("dtype"), F.lit(v).cast("long").alias("columns")) for k, v in sorted(kinds.items())]
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.explode(F.array(*parts)).alias("m")).select("rows", "m.*")


def categorical_summary(df: DataFrame, cols: list[str] | None = None, low_card: int = 30) -> DataFrame:
    """Text columns and numeric columns with few values: top category and top five."""
    cols = cols or df.columns
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    counts = cut_lineage(digest_counts(df, cols, HEAD), "counts")
    stats = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("d1").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.count("d1").alias("unique"),
    )
    is_text = F.col("column").isin(*text) if text else F.lit(False)
    stats = stats.where(is_text | F.col("unique").between(1, low_card))
    # one row a column
    few = counts.join(F.broadcast(stats.select("column")), "column", "left_semi")
    top = frequent_texts(df, few, cols, 5)
    # five rows per column after the trim
    rank = F.struct((-F.col("n")).alias("k"), F.col("value"), F.col("n"))
    lists = top.groupBy("column").agg(F.sort_array(F.collect_list(rank)).alias("t"))
    out = stats.join(lists, "column", "left")
    first = F.get("t", F.lit(0))
    return out.select(
        "column",
        "unique",
        F.round(F.col("missing") * 100.0 / F.col("rows"), 4).alias("missing_pct"),
        F.coalesce(first["value"], F.lit("N/A")).alias("top_category"),
        F.coalesce(first["n"], F.lit(0)).alias("top_count"),
        F.round(F.coalesce(first["n"], F.lit(0)) / F.col("rows"), 4).alias("top_share"),
        F.array_join(F.transform("t", lambda x: F.concat(x["value"], F.lit(": "), x["n"].cast("string"))), "; ").alias("top_five"),
    )


def useless_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or df.columns
    stats = digest_counts(df, cols).groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("unique"),
        F.sum(F.when(F.col("d1").isNull(), F.col("n")).otherwise(0)).alias("missing"),
    )
    reason = (
        F.when(F.col("unique") <= 1, "constant")
        .when(F.col("missing") / F.col("rows") > 0.95, "mostly missing")
        .when(F.col("unique") == F.col("rows"), "all unique")
    )
    return stats.select("column", reason.alias("reason")).where(F.col("reason").isNotNull())


def headline_stats(df: DataFrame, date: str, measure: str) -> DataFrame:
    """Peak year and month by rows (earliest on ties) and the mean measure."""
    def peak(part: Column, name: str) -> DataFrame:
        counts = df.select(part.alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
        return counts.agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("p"))).alias("m")).select(F.col("m.p").alias(name))

    base = df.agg(F.avg(measure).alias("mean_measure"), F.min(F.year(date)).alias("first_year"), F.max(F.year(date)).alias("last_year"))
    return base.withColumn("peak_year", peak(F.year(date), "y").scalar()).withColumn("peak_month", peak(F.month(date), "m").scalar())


def fill_contamination(df: DataFrame, cols: list[str], limits=((9000.0, ">"), (32000.0, ">="))) -> DataFrame:
    """Per column the number of values beyond each limit; a limit says whether it counts itself."""
    unknown = {sign for _, sign in limits} - {">", ">="}
    if unknown:
        raise ValueError(f"unknown comparison {sorted(unknown)}")
    wanted = {f"over_{int(x)}": f"count_if({{c}} {sign} double('{x!r}'))" for x, sign in limits}
    return _stacked(doubles(df, cols), cols, wanted)


# ---------------------------------------------------------------- class diagnostics


def rate_by(df: DataFrame, key: Column, label: str, name: str = "key") -> DataFrame:
    return df.groupBy(key.alias(name)).agg(
        F.sum(label).alias("positives"),
        F.count(F.lit(1)).alias("rows"),
        F.round(F.sum(label) * 100.0 / F.count(F.lit(1)), 2).alias("rate_pct"),
    )


def missing_by_class(df: DataFrame, cols: list[str], label: str, margin: float = 10.0) -> DataFrame:
    """Null share overall and by class; biased when negatives miss far more."""
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).isNull().cast("int").alias("gone")) for c in cols]
    long = df.select(F.col(label).alias("_y"), F.explode(F.array(*parts)).alias("m")).select("_y", "m.*")

    def pct(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("gone"))) * 100.0 / F.count(F.when(cond, 1))

    wide = long.groupBy("column").agg(
        F.round(pct(F.lit(True)), 4).alias("pct_all"),
        F.round(pct(F.col("_y") == 1), 4).alias("pct_pos"),
        F.round(pct(F.col("_y") == 0), 4).alias("pct_neg"),
    )
    return wide.withColumn("biased", F.coalesce(F.col("pct_neg") > F.col("pct_pos") + margin, F.lit(False)))


def completeness_histogram(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Rows per number of missing features with a named band and class counts."""
    gone = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    half = len(cols) // 2
    band = (
        F.when(F.col("missing") == 0, "COMPLETE")
        .when(F.col("missing") <= 2, "GOOD")
        .when(F.col("missing") <= half, "BORDERLINE")
        .otherwise("POOR")
    )
    return (
        df.select(gone.alias("missing"), F.col(label).alias("_y"))
        .groupBy("missing")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count(F.when(F.col("_y") == 1, 1)).alias("positives"),
            F.count(F.when(F.col("_y") == 0, 1)).alias("negatives"),
        )
        .withColumn("band", band)
        .withColumn("kept", F.col("missing") <= half)
    )


def split_stats(df: DataFrame, split: str, label: str) -> DataFrame:
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.col(label) == 1, 1)).alias("positives"),
        F.count(F.when(F.col(label) == 0, 1)).alias("negatives"),
        F.round(F.count(F.when(F.col(label) == 1, 1)) * 100.0 / F.count(F.lit(1)), 2).alias("positive_pct"),
    )


def column_stats_by(df: DataFrame, split: str, cols: list[str]) -> DataFrame:
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]
    long = df.select(split, F.explode(F.array(*parts)).alias("m")).select(split, "m.*")
    return long.groupBy(split, "column").agg(
        F.count(F.when(F.col("value").isNull(), 1)).alias("nulls"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
    )
