"""Rank correlations with gaps against pandas, and a plan that does not grow with the columns."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellcast.operators import profile as P
from cellcast.operators import rankcorr


def frame(rows, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=rows)
    out = pd.DataFrame({
        "full": base + rng.normal(size=rows),
        # one value holds most rows
        "common": np.where(rng.random(rows) < 0.6, 2.0, rng.integers(0, 5, rows)).astype(float),
        "flat": np.full(rows, 3.0),
        "odd": rng.choice([-np.inf, -0.0, 0.0, 1.0, np.inf], rows),
        "none": np.full(rows, np.nan),
    })
    gap = rng.random(rows) < 0.4
    for name in ("left", "right"):
        out[name] = np.where(gap, np.nan, base + rng.integers(0, 4, rows))
    out["half"] = np.where(rng.random(rows) < 0.5, np.nan, rng.integers(0, 9, rows) - base)
    out["rare"] = np.where(np.arange(rows) == 1, 5.0, np.nan)
    return out


def same(got, data):
    assert len(got) == len(data.columns) * (len(data.columns) - 1) // 2
    for (a, b), r in got.items():
        want = data[[a, b]].dropna().rank().corr().iloc[0, 1]
        if np.isnan(want):
            assert r is None
        else:
            assert r == pytest.approx(want, abs=1e-12)


def pairs(df, cols):
    return {(r["a"], r["b"]): r["r"] for r in P.spearman_pairs(df, cols).collect()}


@pytest.mark.parametrize("held", [1 << 22, 300])
def test_equal_to_pandas(spark, monkeypatch, held):
    # few ranks held: a common value spans many bins, rows are summed in small blocks
    monkeypatch.setattr(rankcorr, "HELD", held)
    data = frame(900, 5)
    same(pairs(spark.createDataFrame(data).repartition(4), list(data)), data)


def test_a_value_that_fills_bins(spark, monkeypatch):
    monkeypatch.setattr(rankcorr, "HELD", 20)
    data = pd.DataFrame({"a": [1.0] + [2.0] * 150 + [3.0, 4.0], "b": np.arange(153.0) % 7})
    data.loc[::5, "b"] = np.nan
    same(pairs(spark.createDataFrame(data), ["a", "b"]), data)


def test_classes_are_columns_missing_together(spark):
    data = frame(300, 2)
    rows = rankcorr.doubles(spark.createDataFrame(data), list(data))
    found = rankcorr._classes(rankcorr._together(rows, len(data.columns)))
    at = dict(zip(data, found))
    assert at["left"] == at["right"] and at["full"] == at["odd"] == at["common"]
    assert len({at[c] for c in ("left", "full", "half", "rare", "none")}) == 5


def test_plan_does_not_grow_with_the_columns(spark):
    rng = np.random.default_rng(1)
    data = pd.DataFrame(rng.normal(size=(120, 40)), columns=[f"k{i}" for i in range(40)])
    data = data.mask(rng.random(data.shape) < 0.3)
    df = spark.createDataFrame(data)
    found = P.spearman_pairs(df, list(data))
    size = {len(f._jdf.queryExecution().optimizedPlan().toString().splitlines()) for f in (found, P.spearman_pairs(df, ["k0", "k1"]))}
    assert len(size) == 1
    same({(r["a"], r["b"]): r["r"] for r in found.collect()}, data)


def test_empty_single_and_restricted(spark):
    df = spark.createDataFrame([], "a double, b int")
    assert [r["r"] for r in P.spearman_pairs(df, ["a", "b"]).collect()] == [None]
    assert P.spearman_pairs(df, ["a"]).count() == 0
    df = spark.range(10).select(F.col("id").alias("a"), (F.col("id") % 3).alias("b"))
    got = P.spearman_pairs(df, ["a", "b"], F.col("id") < 3).first()
    assert got["r"] == pytest.approx(1)


def test_flags_are_read_without_an_object_a_row():
    rng = np.random.default_rng(3)
    there = rng.random((200_000, 11)) < 0.5
    packed = rankcorr._packed(there)
    cut = pa.chunked_array([packed.slice(5, 7), packed.slice(0, 0), packed.slice(12)])
    assert (rankcorr._flags(cut, 11) == there[5:]).all() and rankcorr._flags(packed.slice(0, 0), 11).shape == (0, 11)
    tracemalloc.start()
    rankcorr._flags(packed, 11)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the flags and their bits; a list of 200,000 byte strings takes over 8 MB more
    assert peak < 8e6
