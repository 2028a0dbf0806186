import pytest
from pyspark.sql import functions as F

from cellcast.operators import metrics as M
from cellcast.operators import rank as R


@pytest.fixture(scope="module")
def tied(spark):
    return spark.createDataFrame([(1, 0.9, 1), (2, 0.5, 1), (3, 0.5, 0), (4, 0.1, 0)], "id int, s double, y int")


def test_ties(tied):
    t = M.score_table(tied, "s", "y")
    assert M.auroc(t).first()[0] == pytest.approx(0.875)
    assert M.average_precision(t).first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert M.precision_at_k(tied, "s", "y", "id").first()["precision_at_k"] == 1.0


def test_auroc_equals_pair_count_and_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(0, 3000).select(F.col("id"), F.round(F.rand(1), 2).alias("s"), (F.rand(2) < F.rand(1)).cast("int").alias("y")).cache()
    mine = M.auroc(M.score_table(df, "s", "y")).first()[0]
    pdf = df.toPandas()
    pos, neg = pdf[pdf.y == 1].s.to_numpy(), pdf[pdf.y == 0].s.to_numpy()
    pairs = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    ev = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y").evaluate(df)
    assert mine == pytest.approx(pairs) and mine == pytest.approx(ev, abs=1e-6)


def test_zero_division_and_empty_class(spark):
    df = spark.createDataFrame([(0.2, 0), (0.3, 0)], "s double, y int")
    r = M.threshold_metrics(df, "s", "y", 0.5).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"], r["npv"]) == (0.0, 0.0, 0.0, 1.0, 1.0)
    assert M.auroc(M.score_table(df, "s", "y")).first()[0] is None


def test_thresholds(spark, tied):
    assert M.best_f1_threshold(M.score_table(tied, "s", "y")).first()["threshold"] == 0.5
    r = M.recall_threshold(tied, "s", "y", 0.85).first()
    assert r["threshold"] == 0.5 and r["recall"] == 1.0
    low = spark.createDataFrame([(0.01, 1)], "s double, y int")
    assert M.recall_threshold(low, "s", "y").first()["threshold"] == 0.5


def test_gap_and_best(spark):
    df = spark.createDataFrame([("val", 0.9, 0.4), ("test", 0.8, 0.41)], "split string, auroc double, ap double")
    got = {r["metric"]: (round(r["gap"], 3), r["flagged"]) for r in M.generalisation_gap(df, ["auroc", "ap"]).collect()}
    assert got == {"auroc": (-0.1, True), "ap": (0.01, False)}
    assert M.pick_best(df).first()["split"] == "val"


def test_rank_and_scaling(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("cell"), F.when(F.col("id") < 4000, 0).otherwise(1).alias("slot"), F.round(F.rand(1), 1).alias("risk_score"))
    got = R.risk_rank(df, ["slot"]).toPandas()
    want = got.sort_values(["slot", "risk_score", "cell"], ascending=[True, False, True]).groupby("slot").cumcount() + 1
    assert (got["rank"] == want.reindex(got.index)).all()
    top = R.normalise_top(df.withColumn("size", F.col("cell")), 10, "size", 3.0, 15.0, "cell").agg(F.min("scaled"), F.max("scaled")).first()
    assert tuple(top) == (3.0, 15.0)
