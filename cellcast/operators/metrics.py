"""Ranking and threshold metrics from one cumulative score table.

Scores are counted per distinct value before anything is ordered, so ties are exact and
no step sorts raw rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import _names, _same, global_index, running_before

# Alarm bands of the ranking score.
LEAK_ABOVE, EXCELLENT_ABOVE, GOOD_ABOVE = 0.99, 0.96, 0.90
GAP_LIMIT = 0.05


def score_table(df: DataFrame, score: str, label: str, by=()) -> DataFrame:
    """Per distinct score (highest first): own and accumulated positives and negatives."""
    by = _names(by)
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, (-F.col(score).cast("double")).alias("_neg")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("pos"), F.count(F.when(F.col(label) == 0, 1)).alias("neg")
    )
    ranked = running_before(counts, ["_neg"], {"_pb": "pos", "_nb": "neg"}, by)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if by:
        totals = totals.select(*[F.col(k).alias(f"_r_{k}") for k in by], "P", "N")
        ranked = ranked.join(totals, _same(ranked, totals, by))
    else:
        ranked = ranked.withColumn("_t", totals.select(F.struct("P", "N")).scalar())
        ranked = ranked.withColumn("P", F.col("_t.P")).withColumn("N", F.col("_t.N"))
    return ranked.select(
        *by,
        (-F.col("_neg")).alias("score"),
        "pos",
        "neg",
        (F.col("_pb") + F.col("pos")).alias("tp"),
        (F.col("_nb") + F.col("neg")).alias("fp"),
        "P",
        "N",
    )


def auroc(table: DataFrame, by=()) -> DataFrame:
    """Tie-aware area: every negative meets the positives above it and half its ties."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return table.groupBy(*_names(by)).agg(F.try_divide(area, F.max("P").cast("double") * F.max("N").cast("double")).alias("auroc"))


def average_precision(table: DataFrame, by=()) -> DataFrame:
    step = F.try_divide(F.col("pos"), F.col("P")) * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return table.groupBy(*_names(by)).agg(F.sum(step).alias("average_precision"))


def precision_at_k(df: DataFrame, score: str, label: str, key: str, k: int | None = None) -> DataFrame:
    """Share of positives among the first k rows (k = number of positives by default)."""
    kk = F.lit(k) if k is not None else df.agg(F.sum(label)).scalar()
    ranked = global_index(df.select(key, label, (-F.col(score)).alias("_neg")), ["_neg", key], "_n")
    top = ranked.where(F.col("_n") < kk)
    return top.agg(F.count(F.lit(1)).alias("k"), F.sum(label).alias("hits"), F.avg(label).alias("precision_at_k"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def threshold_metrics(df: DataFrame, score: str, label: str, threshold: float, by=(), digits: int = 4) -> DataFrame:
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    counts = df.groupBy(*_names(by)).agg(
        F.count(F.when(hit & pos, 1)).alias("tp"),
        F.count(F.when(hit & ~pos, 1)).alias("fp"),
        F.count(F.when(~hit & ~pos, 1)).alias("tn"),
        F.count(F.when(~hit & pos, 1)).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    named = {
        "precision": precision,
        "recall": recall,
        "f1": _ratio(precision * recall * 2, precision + recall),
        "accuracy": _ratio(tp + tn, tp + fp + tn + fn),
        "specificity": _ratio(tn, tn + fp),
        "npv": _ratio(tn, tn + fn),
    }
    return counts.select("*", *[F.round(c, digits).alias(n) for n, c in named.items()])


def pr_curve(table: DataFrame) -> DataFrame:
    return table.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", "P"))


def roc_curve(table: DataFrame) -> DataFrame:
    return table.withColumn("tpr", F.try_divide("tp", "P")).withColumn("fpr", F.try_divide("fp", "N"))


def best_f1_threshold(table: DataFrame, by=()) -> DataFrame:
    """Score with the highest F1, the lowest such score on ties."""
    by = _names(by)
    curve = pr_curve(table)
    p, r = F.col("precision"), F.col("recall")
    f1 = p * r * 2 / (p + r + 1e-9)
    best = curve.groupBy(*by).agg(F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("s"))).alias("b"))
    return best.select(*by, (-F.col("b.s")).alias("threshold"), F.col("b.f1").alias("f1"))


def recall_threshold(df: DataFrame, score: str, label: str, target: float = 0.85, high: float = 0.90, low: float = 0.05, step: float = 0.01, default: float = 0.50) -> DataFrame:
    """Highest threshold of a falling sweep whose recall reaches ``target``.

    ``default`` with recall 0 when none does, as without any positive row.
    """
    n = int(round((high - low) / step))
    sweep = [round(high - i * step, 10) for i in range(n)]
    # index of the first sweep value a score passes; at most n + 1 groups
    place = F.lit(n)
    for i in reversed(range(n)):
        place = F.when(F.col(score) >= sweep[i], i).otherwise(place)
    groups = df.select(place.alias("at"), F.col(label).alias("_y")).groupBy("at").agg(F.sum("_y").alias("pos"))
    upto = Window.partitionBy(F.lit(0)).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    total = df.agg(F.sum(label)).scalar()
    recall = groups.withColumn("recall", F.try_divide(F.sum("pos").over(upto), total)).where((F.col("recall") >= target) & (F.col("at") < n))
    thresholds = F.array(*[F.lit(s) for s in sweep])
    first = recall.agg(F.min(F.struct("at", "recall")).alias("b"))
    return first.select(
        F.coalesce(F.get(thresholds, F.col("b.at")), F.lit(default)).alias("threshold"), F.coalesce("b.recall", F.lit(0.0)).alias("recall")
    )


def leakage_alarm(score: Column) -> Column:
    return (
        F.when(score > LEAK_ABOVE, "possible leakage")
        .when(score > EXCELLENT_ABOVE, "excellent")
        .when(score > GOOD_ABOVE, "good")
        .otherwise("below expected range")
    )


def evaluate(df: DataFrame, score: str, label: str, by: str) -> DataFrame:
    """auroc, average precision and alarm per group."""
    table = score_table(df, score, label, by)
    both = auroc(table, by).join(average_precision(table, by), by)
    return both.withColumn("alarm", leakage_alarm(F.col("auroc")))


def compare_models(metrics: DataFrame, by: str = "auroc") -> DataFrame:
    return metrics.orderBy(F.desc(by), *[c for c in metrics.columns if c != by])


def pick_best(metrics: DataFrame, by: str = "auroc", comparable: Column | None = None) -> DataFrame:
    rows = metrics if comparable is None else metrics.where(comparable)
    return compare_models(rows, by).limit(1)


def generalisation_gap(metrics: DataFrame, names: list[str], split: str = "split", a: str = "val", b: str = "test") -> DataFrame:
    """b minus a per metric, flagged past 0.05 either way."""
    parts = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    long = metrics.where(F.col(split).isin(a, b)).select(split, F.explode(F.array(*parts)).alias("m")).select(split, "m.*")
    wide = long.groupBy("metric").agg(
        F.max(F.when(F.col(split) == a, F.col("value"))).alias(a), F.max(F.when(F.col(split) == b, F.col("value"))).alias(b)
    )
    gap = F.col(b) - F.col(a)
    return wide.withColumn("gap", gap).withColumn("flagged", F.abs(gap) > GAP_LIMIT)
