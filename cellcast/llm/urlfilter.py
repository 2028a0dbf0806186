"""URL filters by host and path rules, looked up through short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ASCII_LOWER, ASCII_UPPER, without

ADDED = ["host", "path", "rule", "verdict"]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, ASCII_UPPER, ASCII_LOWER), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table; large lists come as a table of their own."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _prepared(rules: DataFrame, hex_digits: int) -> DataFrame:
    host = F.translate("host", ASCII_UPPER, ASCII_LOWER)
    text = F.concat(host, "path")
    return (
        rules.where(F.col("verdict").isin("allow", "block"))
        .select(
            text.alias("rule"),
            F.length(host).alias("host_chars"),
            F.size(F.split(host, r"\.")).alias("labels"),
            F.length("path").alias("path_chars"),
            "verdict",
        )
        .where(F.col("rule").isNotNull())
        .groupBy("rule", "host_chars", "labels", "path_chars")
        # the same rule with both verdicts blocks
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("short", F.substring("digest", 1, hex_digits))
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    default: str = "allow",
    prefix_bytes: int = 4,
) -> DataFrame:
    """Adds host, path, rule and verdict to every row of ``pages``.

    A rule fits its host and all subdomains when the path starts with the rule's path; the
    longest fitting rule wins (then the longer host, then block). Each distinct (host, path)
    is expanded into host suffixes and path prefixes, as long as rules have any of that
    length, and joined with the rules on a short prefix of its SHA-256; the whole digest
    then confirms the hit. Rows without a fitting rule get rule null and ``default``.

    Null URLs and URLs without ``://`` have an empty host and path; a rule fits them no
    more than any other host that isn't named. Repeated rows stay repeated. Input columns
    named like the added ones are replaced. Rules with a null host or path are ignored.
    """
    host, path = split_url(F.col(f"`{url}`"))
    kept = without(pages, ADDED)
    rows = pages.select(
        *[F.col(f"`{c}`") for c in kept.columns], host.alias("host"), path.alias("path")
    )
    known = cut_lineage(_prepared(rules, 2 * prefix_bytes), "url-rules")
    # distinct lengths only: at most 127 labels and as many path lengths as a URL can have
    sizes = known.agg(
        F.sort_array(F.collect_set("labels")).alias("labels"),
        F.sort_array(F.collect_set("path_chars")).alias("paths"),
    ).first()
    texts = rows.select("host", "path").distinct()
    if sizes["labels"]:
        parts = F.split("host", r"\.")
        counts = F.filter(F.array(*map(F.lit, sizes["labels"])), lambda k: k <= F.size(parts))
        lengths = F.filter(F.array(*map(F.lit, sizes["paths"])), lambda n: n <= F.length("path"))
        expressions = F.flatten(
            F.transform(
                counts,
                lambda k: F.transform(
                    lengths,
                    lambda n: F.concat(
                        F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."),
                        F.substring("path", 1, n),
                    ),
                ),
            )
        )
    else:
        expressions = F.array().cast("array<string>")
    asked = texts.select("host", "path", F.explode(expressions).alias("expression"))
    asked = asked.withColumn("full", F.sha2("expression", 256))
    asked = asked.withColumn("short", F.substring("full", 1, 2 * prefix_bytes))
    strength = F.struct(F.length("rule"), "host_chars", "verdict")
    best = (
        asked.join(known, "short")
        .where(F.col("full") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "verdict"), strength).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    best = cut_lineage(best, "url-verdicts")
    # there are as many verdicts as distinct URLs that a rule fits: never broadcast
    judged = rows.join(best.hint("merge"), ["host", "path"], "left")
    return judged.select(
        *[F.col(f"`{c}`") for c in kept.columns],
        "host",
        "path",
        "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
