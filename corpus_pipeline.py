"""A training corpus from ``documents``: filtered, deduplicated, mixed and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellcast.llm import chosenpath, hostrules, mixing, packing, toxicity
from cellcast.llm.common import held_out
from cellcast.llm.queries import tokenizer_file
from cellcast.session import configure, cut_lineage

#: SQL has no word for minwise trees, lexicon fitting or tokenizers.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rule or whose source mostly fails it."""
    return hostrules.drop_by_host(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents the lexicon, learned from the labelled ones, holds for toxic."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    lexicon = toxicity.fit_toxicity(docs, labels, ~held_out("doc_id", 3, 1))
    return toxicity.drop_toxic(docs, lexicon)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near copies, the document with the smallest id.

    Copies share 0.8 or more of their shingles of five words; ``op6`` alone links from 0.85.
    Rows are judged one by one, whatever ids they share; null ids come last.
    """
    return chosenpath.drop_copies(docs, chosenpath.STAGE_JOIN)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out whole documents so that sources come near their targets."""
    return mixing.repeat_documents(mixing.mix_sources(docs, cut=False), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all tokens into sequences; a document that the mix repeats is packed as often."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("mix_sources", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
