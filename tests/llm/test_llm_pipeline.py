"""The pipeline's stages against what their operators say, on the smallest tables."""

import os
import random

import corpus_pipeline
import pytest
from cellcast.llm import chosenpath, hostrules
from cellcast.llm.queries import ORACLE, QUERIES
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_queries_return_every_row(spark, name):
    out = QUERIES[name](spark, FOLDER)
    key = out.columns[0]
    table = "embeddings" if key == "vec_id" else "documents"
    want = spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key)
    assert out.select(key).distinct().exceptAll(want.distinct()).count() == 0
    assert want.distinct().exceptAll(out.select(key).distinct()).count() == 0


def test_stages_keep_columns_and_act(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = [(9_000_001, None, "en", None, 0), (9_000_002, "", None, "src0", 0), (9_000_003, "idiot " * 5, "en", "src0", 3)]
    copy = docs.where("doc_id = 0").withColumn("doc_id", F.lit(9_000_004).cast("long"))
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).unionByName(copy)
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, FOLDER)
        assert docs.columns == before.columns, name
        sizes.append(docs.count())
        if name == "quality_rules":
            judged = hostrules.judge_by_host(before).where("kept").select("doc_id")
            assert judged.exceptAll(docs.select("doc_id")).count() == 0 and judged.count() == sizes[-1]
        if name == "near_copies":
            kept = chosenpath.near_duplicates(before).where("kept").select("doc_id")
            assert kept.exceptAll(docs.select("doc_id")).count() == 0 and kept.count() == sizes[-1]
            assert docs.where("doc_id = 9000004").count() == 0
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.agg(F.sum("length")).first()[0] > 0


def test_near_copies_from_four_fifths_on_are_dropped(spark):
    rng = random.Random(8)
    rows, similar = [], {}
    for k, changed in enumerate([0, 4, 6, 7, 9, 12, 30]):
        base = [f"w{rng.randrange(10**6)}" for _ in range(64)]
        copy = base[: len(base) - changed] + [f"v{rng.randrange(10**6)}" for _ in range(changed)]
        first, second = ({tuple(t[i : i + 5]) for i in range(60)} for t in (base, copy))
        similar[2 * k + 1] = 100 * len(first & second) / len(first | second)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    assert any(80 <= s < 85 for s in similar.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, FOLDER).collect()}
    assert kept == {i for i, _ in rows if similar.get(i, 0) < 80}
    linked = {r.doc_id for r in chosenpath.near_duplicates(docs, chosenpath.PathJoin()).where("not kept").collect()}
    assert linked == {i for i, s in similar.items() if s >= 85}


def test_run_and_empty_tables(spark, tmp_path):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 100
    for table in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
