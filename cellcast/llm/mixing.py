"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut_lineage
from .common import SPACES, WORD, fresh, ranked, without

ADDED = ["size", "source_size", "target", "taken", "repeats", "part"]
#: Hash buckets of a source; the one in which a source's last repetition ends is cut.
BUCKETS = 4096


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null; counted without an array of them."""
    marks = F.translate(F.regexp_replace(text, WORD, "x"), SPACES, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def water_level(sources: DataFrame, total: float) -> float | None:
    """The level at which sum(least(cap, weight * level)) is ``total``.

    Starts with nothing clamped; each round clamps what lies above its cap and shares the
    rest among the others by weight, until none is above. A round is one aggregate that
    returns one row, whatever the number of sources. None: every source is at its cap.
    """
    level, clamped = 0.0, None
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        row = sources.agg(
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("free"),
            F.coalesce(F.sum(F.when(over, 1)), F.lit(0)).alias("n"),
        ).first()
        if row["n"] == clamped:
            return level
        if not row["free"]:
            return None
        level, clamped = (total - row["held"]) / row["free"], row["n"]


def fill_targets(sources: DataFrame, share: float = 1.0, max_epochs: float = 3.0) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): ``share`` of all sizes, by weight.

    No target is above ``max_epochs`` times its source's size. Sources of size 0 get 0; if
    every source reaches its cap, the targets are the caps.
    """
    capped = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    capped = cut_lineage(capped, "mix-sources")
    whole = capped.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(capped, whole * share)
    target = F.col("cap")
    if level is not None:
        target = F.least("cap", F.col("weight") * F.lit(level))
    return capped.withColumn("target", target).drop("cap")


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """Adds ``weight``: the given weights in turn over the sources by code point, null last."""
    placed = ranked(sources, F.col("source").asc_nulls_last(), name="_rank")
    turn = (F.col("_rank") - 1) % len(weights)
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    return placed.withColumn("weight", choice).drop("_rank")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.0,
    max_epochs: float = 3.0,
    seed: int = 1,
    cut: bool = True,
) -> DataFrame:
    """How often the mix takes each document: input columns, size, source_size, target,
    repeats (whole repetitions), part (words of one more) and taken (words in all).

    Every document of a source is taken floor(target / source_size) times. The rest of the
    target comes from a seeded order: documents are hashed into buckets, whole buckets are
    taken once more in order, and the bucket in which the target is reached gives that share
    of each of its documents (``cut=False``: that share of its documents, drawn by a second
    hash, each whole). So a source misses its target by less than a word for each document
    of one bucket in 4096, and a re-run takes the same words.

    Texts that are null or without a word have size 0 and are never repeated beyond the
    whole repetitions of their source; a null source is a source of its own, the last. Rows
    with the same or no doc_id are drawn alike. Columns named like the added ones are replaced.
    """
    kept = without(docs, ADDED)
    bucket, draw, portion, at, owner = fresh(docs, "bucket", "draw", "portion", "at", "owner")
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    rows = docs.select(
        *[F.col(f"`{c}`") for c in kept.columns],
        word_count(F.col("text")).alias("size"),
        F.conv(F.substring(digest, 1, 3), 16, 10).cast("int").alias(bucket),
        (F.conv(F.substring(digest, 4, 6), 16, 10).cast("double") / float(16**6)).alias(draw),
    )
    # one row a source and bucket at most, summed before the shuffle
    held = cut_lineage(
        rows.groupBy("source", bucket).agg(F.sum("size").alias("_words")), "mix-buckets"
    )
    sources = held.groupBy("source").agg(F.sum("_words").alias("source_size"))
    targets = fill_targets(cyclic_weights(sources, weights), share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    before = (
        Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    )
    left = F.col("target") - F.col("repeats") * F.col("source_size") - F.col("_before")
    plan = (
        held.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
        .withColumnRenamed("source", owner)
        .join(targets, F.col(owner).eqNullSafe(F.col("source")))
        .withColumn("repeats", F.coalesce(epochs, F.lit(0)).cast("long"))
        .withColumn("_left", left)
        .select(
            owner,
            F.col(bucket).alias(at),
            "source_size",
            "target",
            "repeats",
            F.when(F.col("_left") <= 0, 0.0)
            .when(F.col("_left") >= F.col("_words"), 1.0)
            .otherwise(F.col("_left") / F.col("_words"))
            .alias(portion),
        )
    )
    plan = cut_lineage(plan, "mix-plan")
    same = (F.col(at) == F.col(bucket)) & F.col(owner).eqNullSafe(F.col("source"))
    joined = rows.join(plan.hint("merge"), same)
    if cut:
        part = F.floor(F.col("size") * F.col(portion) + F.col(draw))
    else:
        part = F.when(F.col(draw) < F.col(portion), F.col("size")).otherwise(0)
    return joined.withColumn("part", part.cast("long")).select(
        *[F.col(f"`{c}`") for c in kept.columns],
        "size",
        "source_size",
        "target",
        (F.col("repeats") * F.col("size") + F.col("part")).alias("taken"),
        "repeats",
        "part",
    )


def repeat_documents(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed corpus: each document as often as ``mix_sources(cut=False)`` takes it.

    A document without words comes as often as the whole repetitions of its source.
    """
    more = F.when((F.col("part") > 0) & (F.col("part") == F.col("size")), 1).otherwise(0)
    times = (F.col("repeats") + more).cast("int")
    copy = fresh(mixed, "copy")[0]
    again = F.explode(F.array_repeat(F.lit(1), times)).alias(copy)
    return mixed.select(*[F.col(f"`{c}`") for c in columns], again).drop(copy)
