"""Exact ranks and quantiles on skewed data, compared with plain Python or built-ins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellcast.operators import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    """One group and one value hold most rows."""
    g = F.when(F.rand(5) < 0.7, 0).otherwise((F.rand(6) * 5).cast("int"))
    v = F.when(F.rand(7) < 0.4, 1.0).otherwise(F.round(F.exp(F.randn(8) * 3), 3))
    return spark.range(0, 40000, numPartitions=6).select("id", g.alias("g"), v.alias("v")).cache()


def test_percentiles_equal_builtin(spark, skewed):
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 0.99, 1.0]
    mine = {r["g"]: r for r in O.percentiles(skewed, "v", probs, by="g").collect()}
    want = skewed.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()
    for r in want:
        assert [mine[r["g"]][f"p{round(p * 100)}"] for p in probs] == pytest.approx(r["q"])


def test_percentiles_with_null_group_and_nulls(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("a", 5.0)], "g string, v double")
    assert {r["g"]: r["p50"] for r in O.percentiles(df, "v", [0.5], by="g").collect()} == {None: 2.0, "a": 5.0}


def test_global_index_is_dense_and_ordered(spark, skewed):
    got = O.global_index(skewed, ["v", "id"]).select("id", "idx").toPandas().sort_values("idx")
    pdf = skewed.toPandas().sort_values(["v", "id"])
    assert got["idx"].tolist() == list(range(len(pdf)))
    assert got["id"].tolist() == pdf["id"].tolist()


def test_group_index_and_partition_independence(spark, skewed):
    one = O.global_index(skewed, ["v", "id"], by="g").select("id", "idx")
    two = O.global_index(skewed.repartition(3, "id"), ["v", "id"], by="g").select("id", "idx")
    assert one.exceptAll(two).count() == 0
    pdf = skewed.toPandas().sort_values(["g", "v", "id"])
    want = dict(zip(pdf["id"], pdf.groupby("g").cumcount()))
    assert all(want[r["id"]] == r["idx"] for r in one.collect())


def test_average_rank(spark, skewed):
    pdf = skewed.toPandas()
    want = dict(zip(pdf["v"], pdf["v"].rank()))
    got = O.average_rank(skewed, "v").collect()
    assert all(want[r["v"]] == r["rank"] for r in got)


@pytest.mark.parametrize("n", [50, 2000])
def test_top_n_keeps_exact_rows(spark, skewed, n):
    got = O.top_n(skewed, "g", [F.desc("v"), F.asc("id")], n).toPandas()
    pdf = skewed.toPandas().sort_values(["g", "v", "id"], ascending=[True, False, True])
    want = pdf.groupby("g").head(n)
    assert sorted(got["id"]) == sorted(want["id"])


def test_first_per_key(spark, skewed):
    got = O.first_per_key(skewed, ["g", "v"], ["id"])
    want = skewed.groupBy("g", "v").agg(F.min("id").alias("id"))
    assert got.select("g", "v", "id").exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("groups", [1, 300])
def test_bins_share_the_rows(spark, groups):
    df = spark.range(0, 50000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % groups).alias("g"), F.pow(F.col("id"), F.lit(3.0)).alias("v")
    )
    sizes = O.with_bin(df, ["g", "v"]).groupBy("_bin").count().toPandas()
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(sizes) == width and sizes["count"].max() < 2 * 50000 / width
    assert np.isclose(sizes["count"].sum(), 50000)
