"""Quality rules of documents, judged for whole hosts as well."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh, rows_where, without

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SPACE = b" \t\n\r\x0b\x0c"
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
WINDOW = 8


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that occur twice or more in ``words``."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    names = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    kinds, width = len(seen), 1
    while width < WINDOW:  # names of windows of 1, 2, 4 and 8 words
        if kinds == len(names):
            return 0
        pairs = names[:-width] * kinds + names[width:]
        found, names = np.unique(pairs, return_inverse=True)
        kinds, width = len(found), 2 * width
    starts = np.flatnonzero(np.bincount(names)[names] > 1)
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measure(text: bytes | None) -> tuple[int, int, int, int, int]:
    """The five counts of one text; all 0 for null."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip(SPACE)]
    return (
        len(words),
        len(text.translate(None, SPACE + CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        rows = [measure(t.as_py()) for t in texts]
        counts = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 5
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *counts], names=[*batch.schema.names[:-1], *MEASURES]
        )


def measure_documents(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every document and its five counts, from the whole text."""
    whole = F.col("text").cast("binary").alias(fresh(docs, "text")[0])
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], whole)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    schema = ", ".join([*fields, *[f"{m} bigint" for m in MEASURES]])
    return rows.mapInArrow(_measure_batches, schema)


def with_base_rule(rows: DataFrame, min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    few = F.col("n_words") < min_words
    many = F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat
    return rows.withColumn("base_failed", few | many)


def host_rates(judged: DataFrame, host: str) -> DataFrame:
    """Rows (host, n, failed, rate): each host's share of failures, shrunk to the prior.

    The prior beta(a, b) is fitted to the hosts' raw rates by moments, hosts weighed alike;
    its strength a + b is held between 1 and 1000. One host, or equal rates: the strength is
    1000. A host of few rows keeps close to the prior's mean a / (a + b).
    """
    counted = cut_lineage(
        judged.groupBy(F.col(f"`{host}`").alias("host")).agg(
            F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")
        ),
        "host-counts",
    )
    raw = F.col("failed") / F.col("n")
    # E[raw rate's variance] = prior variance + sampling variance, the latter is taken off
    row = counted.agg(
        F.avg(raw).alias("mean"),
        F.var_pop(raw).alias("spread"),
        F.avg(raw * (1 - raw) / F.col("n")).alias("noise"),
    ).first()
    mean = row["mean"] or 0.0
    inner = mean * (1 - mean)
    spread = max((row["spread"] or 0.0) - (row["noise"] or 0.0), 0.0)
    strength = min(max(inner / spread - 1, 1.0), 1000.0) if spread > 0 else 1000.0
    rate = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return counted.withColumn("rate", rate)


def judge_by_host(
    docs: DataFrame,
    host: str = "source",
    max_host_rate: float = 0.5,
    min_words: int = 20,
    max_repeat: int = 30,
) -> DataFrame:
    """Input columns but the text, five counts, base_failed, host_rate and kept.

    A document is kept unless it fails the base rule itself or its host's shrunk failure
    rate is above ``max_host_rate``. Null or empty texts have counts of 0 and fail; a null
    host is a host of its own. Repeated rows count and come out as often as they are there.
    Input columns named like the added ones are replaced.
    """
    added = [*MEASURES, "base_failed", "host_rate", "kept"]
    columns = [c for c in without(docs, added).columns if c != "text"]
    measured = cut_lineage(
        with_base_rule(measure_documents(docs, columns), min_words, max_repeat), "measured"
    )
    hosts = cut_lineage(host_rates(measured, host), "host-rates")
    name = fresh(measured, "host")[0]
    hosts = hosts.select(F.col("host").alias(name), F.col("rate").alias("host_rate"))
    joined = measured.join(hosts.hint("merge"), F.col(f"`{host}`").eqNullSafe(F.col(name))).drop(name)
    passes = F.col("host_rate") <= max_host_rate
    return joined.withColumn("kept", ~F.col("base_failed") & passes)


def drop_by_host(
    docs: DataFrame,
    host: str = "source",
    max_host_rate: float = 0.5,
    min_words: int = 20,
    max_repeat: int = 30,
) -> DataFrame:
    """The rows of ``docs`` that ``judge_by_host`` keeps, with all their columns.

    Texts are measured once for the hosts' rates and once more as they pass, so that they
    aren't shuffled; only the rejected hosts are joined.
    """
    measured = with_base_rule(measure_documents(docs, [host]), min_words, max_repeat)
    rates = host_rates(measured.select(host, "base_failed"), host)
    name = fresh(docs, "host")[0]
    rejected = cut_lineage(
        rates.where(F.col("rate") > max_host_rate).select(F.col("host").alias(name)), "hosts-rejected"
    )

    def judge():
        def passes(text: bytes | None) -> bool:
            n_words, _, _, _, n_repeat = measure(text)
            return n_words >= min_words and 100 * n_repeat <= max_repeat * n_words

        return passes

    passing = rows_where(docs, "text", judge, "binary")
    return passing.join(rejected, F.col(f"`{host}`").eqNullSafe(F.col(name)), "left_anti")
