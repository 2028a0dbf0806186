"""Order statistics and correlations of wide tables against pandas, with gaps and odd values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellcast.operators import profile as P
from cellcast.operators import wide


def frame(rows, seed):
    rng = np.random.default_rng(seed)
    out = pd.DataFrame({
        "even": rng.random(rows) * 1e6 - 5e5,
        "skew": np.exp(rng.normal(size=rows) * 8),
        "few": rng.integers(0, 3, rows).astype(float),
        "one": np.full(rows, 0.1),
        "far": 1e9 + rng.normal(size=rows),
        "huge": rng.choice([-1.7e308, 0.0, 1.7e308], rows),
        "gaps": np.where(rng.random(rows) < 0.4, np.nan, rng.normal(size=rows)),
        "none": np.full(rows, np.nan),
    })
    out["near"] = out["far"] * 2 + rng.normal(size=rows)
    out["half"] = np.where(rng.random(rows) < 0.5, np.nan, out["gaps"].fillna(0) + rng.normal(size=rows))
    return out


@pytest.mark.parametrize("few", [1 << 16, 40])
def test_percentiles_equal_pandas(spark, monkeypatch, few):
    monkeypatch.setattr(wide, "FEW", few)
    monkeypatch.setattr(wide, "BINS", 64)
    data = frame(3000, few)
    df = spark.createDataFrame(data).repartition(5)
    probs, names = [0.0, 0.05, 0.25, 0.5, 0.99, 1.0], ["a", "b", "c", "d", "e", "f"]
    got = {r["column"]: r for r in wide.wide_percentiles(df, list(data), probs, names).collect()}
    assert set(got) == set(data)
    for c in data:
        if c == "none":
            assert all(got[c][n] is None for n in names)
        elif c != "huge":
            assert [got[c][n] for n in names] == pytest.approx(list(data[c].quantile(probs)), rel=1e-12)
    assert got["huge"]["d"] == float(np.sort(data["huge"])[1499:1501].mean())


def test_correlations_equal_pandas_in_one_scan(spark, tmp_path):
    data = frame(2000, 3).drop(columns="huge")
    spark.createDataFrame(data).repartition(7).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    found = P.pearson_pairs(df, list(data))
    got = {(r["a"], r["b"]): r["r"] for r in found.collect()}
    want = data.corr()
    for (a, b), r in got.items():
        if "one" in (a, b) or "none" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], rel=1e-6, abs=1e-7)
    odd = df.withColumn("far", F.when(F.col("few") == 0, float("inf")).otherwise(F.col("far")))
    got = {(r["a"], r["b"]): r["r"] for r in P.pearson_pairs(odd, ["far", "near", "even"]).collect()}
    assert got["far", "near"] is None and got["near", "even"] == pytest.approx(want.loc["near", "even"], abs=1e-7)
    few = P.corr_with(df, list(data), "near", 3).collect()
    assert few[0]["column"] == "far" and len(few) == 3


def test_many_columns_take_one_scan(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = pd.DataFrame(rng.normal(size=(300, 250)), columns=[f"k{i}" for i in range(250)])
    spark.createDataFrame(data).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    found = P.pearson_pairs(df, list(data))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "Expand" not in plan
    assert found.count() == 250 * 249 // 2
    summary = P.numeric_summary(df, list(data)[:60])
    # only the row of aggregates becomes rows per column
    assert summary._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    got = {r["column"]: r for r in summary.collect()}
    assert got["k17"]["median"] == pytest.approx(data["k17"].median(), rel=1e-12)
    assert got["k59"]["std"] == pytest.approx(data["k59"].std(), rel=1e-9)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "a double, b int")
    assert [r["m"] for r in wide.wide_percentiles(df, ["a", "b"], [0.5], ["m"]).collect()] == [None, None]
    assert [r["r"] for r in P.pearson_pairs(df, ["a", "b"]).collect()] == [None]
    assert P.iqr_outliers(df, ["a"]).count() == 0
