import pytest
from pyspark.sql import functions as F

from cellcast.operators import profile as P


def test_bias_corrected_moments(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    r = P.shape_moments(df, ["x"]).first()
    assert r["skewness"] == pytest.approx(1.763633, abs=1e-5) and r["kurtosis"] == pytest.approx(3.228, abs=1e-3)


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (1.0,), (10.0,), (9999.0,), (None,)], "x double")
    got = {r["label"]: r["count"] for r in P.bin_counts(df, "x").collect()}
    assert got == {"<0.25": 1, "0.25-1": 1, "1-10": 1, ">5k": 1}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert P.missing_summary(df).first()["missing"] == 2
    r = P.numeric_summary(df, ["x"]).first()
    assert (r["count"], r["mean"], r["median"]) == (2, 2.0, 2.0)


def test_column_quality_flags(spark):
    df = spark.range(0, 200).select(
        F.lit(1).alias("same"), F.when(F.col("id") < 199, "a").otherwise("b").alias("nearly"), F.col("id").cast("string").alias("many"),
        F.lit(0.0).alias("zeros"), (F.col("id") - 5).cast("double").alias("price"), F.when(F.col("id") == 3, float("inf")).otherwise(1.0 * F.col("id")).alias("wide"),
    )
    got = {r["column"]: r["flags"] for r in P.column_quality(df).collect()}
    assert got["same"].startswith("CONSTANT") and got["nearly"] == "NEAR_CONSTANT" and got["many"] == "HIGH_CARD(200)"
    assert "ALL_ZEROS" in got["zeros"] and got["price"] == "NEG(5)" and got["wide"] == "HAS_INF(1)"


def test_duplicate_columns_are_verified(spark):
    df = spark.range(0, 50).select("id", F.col("id").alias("copy"), (49 - F.col("id")).alias("reversed"))
    # the reversed column has the same multiset of values but differs row by row
    assert [tuple(r) for r in P.duplicate_columns(df).collect()] == [("id", "copy")]


def test_mann_whitney_matches_pair_count(spark):
    a, b = [1.0, 2.0, 2.0, 5.0, 7.0, 8.0], [2.0, 3.0, 6.0, 7.0, 9.0, 9.0, 10.0]
    df = spark.createDataFrame([(x, 0) for x in a] + [(x, 1) for x in b], "x double, g int")
    r = P.mann_whitney(df, ["x"], "g").first()
    assert r["u"] == sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert 0 < r["p_value"] < 1


def test_erfc(spark):
    import math

    xs = [0.0, 0.3, 1.0, 2.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(P._erfc(F.col("x"))).collect()
    assert [g[0] for g in got] == pytest.approx([math.erfc(x) for x in xs], rel=3e-7)


def test_spearman_is_symmetric_to_order(spark):
    df = spark.range(0, 100).select(F.col("id").cast("double").alias("a"), F.exp(F.col("id") / 20).alias("b"), (-F.col("id")).cast("double").alias("c"))
    got = {(r["a"], r["b"]): r["r"] for r in P.spearman_pairs(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == pytest.approx(1) and got[("a", "c")] == pytest.approx(-1)


def test_matrix_drops_constant_columns(spark):
    df = spark.range(0, 10).select(F.col("id").alias("a"), F.lit(1).alias("b"), (F.col("id") * 2).alias("c"))
    assert {(r["a"], r["b"]) for r in P.pearson_matrix(df, ["a", "b", "c"]).collect()} == {("a", "c"), ("c", "a")}


def test_density_integrates_to_one(spark):
    df = spark.range(0, 5000).select(F.randn(1).alias("x"))
    got = P.density_curve(df, "x", points=200).toPandas().sort_values("x")
    step = got["x"].diff().mean()
    assert (got["density"] * step).sum() == pytest.approx(1, abs=0.02)


def test_columns_are_described_by_name(spark):
    df = spark.createDataFrame([(1.0, None, "x"), (2.0, None, "x"), (3.0, None, "y")], "Max_Elevation double, county string, kind string")
    got = {r["column"]: r for r in P.schema_profile(df, known={"kind": "What it is"}).collect()}
    assert [got[c]["description"] for c in df.columns] == ["Elevation (meters)", "Administrative geographic code", "What it is"]
    assert [got[c]["semantic_type"] for c in df.columns] == ["Numeric", "Unknown", "Text"]
    assert got["county"]["missing_pct"] == 100.0 and got["county"]["example"] is None
    assert P.describe_column("plain") == P.NO_DESCRIPTION
    assert {r["semantic_type"]: r["columns"] for r in P.semantic_counts(df).collect()} == {"Numeric": 1, "Unknown": 1, "Text": 1}


def test_coordinate_stats_leave_out_gaps(spark):
    df = spark.createDataFrame([(30.5,), (31.5,), (None,), (float("nan"),)], "lat double")
    r = P.coordinate_stats(df, ["lat"]).first()
    assert (r["mean"], r["median"], r["min"], r["max"], r["count"]) == (31.0, 31.0, 30.5, 31.5, 2)


def _texts(spark):
    far = F.lpad(F.col("id").cast("string"), 5, "0")
    return spark.range(0, 3000).select(
        F.concat(F.lit("x" * 40), far).alias("alike"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), (F.col("id") % 700).cast("string"))).alias("skewed"),
        F.when(F.col("id") % 10 > 0, F.concat(far, F.lit("y" * 50))).alias("gaps"),
        F.when(F.col("id") < 2, F.lit("NaN")).when(F.col("id") < 4, F.lit("")).otherwise("a").alias("few"),
        (F.col("id") % 7).cast("int").alias("digit"),
        F.lit(None).cast("string").alias("never"),
    )


def test_digests_give_the_counts_of_texts(spark):
    df = _texts(spark)
    pdf = df.toPandas()
    text = ["alike", "skewed", "gaps", "few", "never"]
    pdf[text] = pdf[text].astype(object).where(pdf[text].notna(), None)
    unique = {c: len(set(pdf[c]) - {None}) for c in df.columns}
    assert {r["column"]: r["distinct"] for r in P.distinct_counts(df, df.columns).collect()} == unique
    rows = {r["column"]: r for r in P.categorical_summary(df).collect()}
    assert set(rows) == set(df.columns)
    for c in df.columns:
        counts = pdf[c].astype(str).where(pdf[c].notna()).value_counts()
        want = sorted(((-n, v) for v, n in counts.items()))[:5]
        got = rows[c]
        assert (got["unique"], got["top_category"]) == (unique[c], want[0][1] if want else "N/A")
        assert (got["top_five"] or "") == "; ".join(f"{v}: {-n}" for n, v in want)
    quality = {r["column"]: r for r in P.column_quality(df).collect()}
    assert quality["few"]["unique"] == 2 and quality["few"]["missing_pct"] == round(200 / 3000, 4)
    assert quality["skewed"]["dominant_fraction"] == round(1000 / 3000, 4)
    schema = {r["column"]: r for r in P.schema_profile(df).collect()}
    assert schema["gaps"]["present"] == 2700 and schema["alike"]["unique"] == 3000 and schema["never"]["example"] is None
    assert schema["few"]["example"] == ""
    reasons = {r["column"]: r["reason"] for r in P.useless_columns(df).collect()}
    assert reasons == {"alike": "all unique", "never": "constant"}
    nothing = df.where("digit > 9")
    assert [f(nothing).count() for f in (P.categorical_summary, P.column_quality, P.schema_profile, P.useless_columns)] == [0] * 4


def test_no_text_is_shuffled_by_counts(spark):
    df = _texts(spark).select("alike", "gaps")
    for made in (P.distinct_counts(df, df.columns), P.column_quality(df), P.useless_columns(df)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        keyed = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert keyed and not any("alike" in line or "gaps" in line or "value" in line for line in keyed)
        assert "partial_first" not in plan and "partial_max(struct" not in plan


def test_one_scan_without_rows_per_column(spark):
    df = spark.range(0, 400).select(
        (F.col("id") % 2).cast("int").alias("flag"),
        F.when(F.col("id") % 7 > 0, F.sin(F.col("id"))).alias("gaps"),
        F.when(F.col("id") == 5, float("nan")).otherwise(F.exp(F.col("id") / 90.0)).alias("it's"),
        F.lit(None).cast("double").alias("never"),
        F.when(F.col("id") < 9, 9000).otherwise(32000).alias("filled"),
    )
    cols = ["gaps", "it's", "never", "filled"]
    pdf = df.toPandas()
    made = [P.shape_moments(df, cols), P.effect_size(df, cols, "flag"), P.top_variance(df, cols, 9), P.fill_contamination(df, cols)]
    for frame in made:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan") + plan.count("Range (") == 1 and "explode" not in plan and "hashpartitioning" not in plan
    shape, effect, variance, fill = [{r["column"]: r for r in frame.collect()} for frame in made]
    for c in ("gaps", "it's"):
        assert shape[c]["skewness"] == pytest.approx(pdf[c].skew()) and shape[c]["kurtosis"] == pytest.approx(pdf[c].kurt())
        assert variance[c]["variance"] == pytest.approx(pdf[c].var())
        a, b = pdf[c][pdf["flag"] == 0], pdf[c][pdf["flag"] == 1]
        assert effect[c]["cohens_d"] == pytest.approx(abs(b.mean() - a.mean()) / ((a.var() + b.var()) / 2) ** 0.5)
    assert "never" not in effect and shape["never"]["skewness"] is None
    assert (fill["filled"]["over_9000"], fill["filled"]["over_32000"], fill["never"]["over_9000"]) == (391, 391, 0)
