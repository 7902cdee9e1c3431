"""Hand-written edge tables (FIXTURES §3), answers worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from fairaudit.operators import metrics as M
from fairaudit.operators import prepare as P
from fairaudit.operators import profile as PR
from fairaudit.operators import proxy as X
from fairaudit.operators import rules as R
from fairaudit.operators import strategies as S


def test_null_group_unknown_in_raw_audit_null_in_shares(spark):
    rows = [("a", 1), ("a", 0), ("b", 1), ("b", 1), ("b", 0), ("a", 1), (None, 1), (None, 0), ("b", 0), ("a", 0)]
    df = spark.createDataFrame(rows, "g string, y int")
    dist = {r["grp"]: r["n"] for r in M.group_distribution(df, "g").collect()}
    assert dist == {"a": 4, "b": 4, "Unknown": 2}
    sh = {r["grp"]: r["share"] for r in M.group_share(df, "g").collect()}
    assert sh == {"a": 0.4, "b": 0.4, None: 0.2}
    sr = {r["grp"]: r["selection_rate"] for r in M.observed_selection_rate(df, "y", "g").collect()}
    assert sr["Unknown"] == 0.5


def test_null_target_counts_as_not_selected(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("a", 0), ("a", 1)], "g string, y int")
    r = M.observed_selection_rate(df, "y", "g").first()
    assert r["n"] == 5 and r["selection_rate"] == 0.6


def test_one_group(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 1), ("a", 1, 0)], "grp string, y_true int, y_pred int")
    f = M.fairness_metrics(df).first()
    assert (f["demographic_parity_difference"], f["equalized_odds_difference"], f["disparate_impact_ratio"]) == (0, 0, 1)
    s = M.distribution_summary(df, "y_true", "grp").first()
    assert s["imbalance_ratio"] is None and s["selection_rate_gap"] is None


def test_no_positives_and_group_without_positives(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 0, 0), ("b", 0, 0), ("b", 0, 0)], "grp string, y_true int, y_pred int")
    f = M.fairness_metrics(df, pos_label=1, rounded=False)
    flags = M.collapse_flags(f).first()
    assert f.first()["disparate_impact_ratio"] == 1.0
    assert flags["all_zero_selection"] and flags["low_positive_rate"]
    df2 = spark.createDataFrame([("a", 1, 1), ("a", 0, 0), ("b", 0, 1), ("b", 0, 0)], "grp string, y_true int, y_pred int")
    r = {x["grp"]: x["tpr"] for x in M.predicted_selection_rate(df2).collect()}
    assert r["b"] == 0.0 and r["a"] == 1.0


@pytest.mark.parametrize("labels,dtype,expected", [
    (["yes", "no", "yes"], "string", "yes"),
    ([-1, 1, 1], "int", 1),
    (["selected", "unselected"], "string", "selected"),
    (["beta", "alpha"], "string", "beta"),
    ([True, False], "boolean", True),
])
def test_positive_label_rules(spark, labels, dtype, expected):
    df = spark.createDataFrame([(v,) for v in labels], f"y {dtype}")
    assert PR.positive_label(df, "y").first()["pos_label"] == expected


def test_three_classes_unchanged_by_encoding(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "y string")
    out = P.encode_binary_target(df, "y", out="e")
    assert [r["e"] for r in out.orderBy("y").collect()] == ["a", "b", "c"]
    two = P.encode_binary_target(spark.createDataFrame([(-1,), (1,), (1,)], "y int"), "y")
    assert sorted(r["y"] for r in two.collect()) == [0, 1, 1]


def test_mode_tie_and_all_missing(spark):
    df = spark.createDataFrame([("a", None, None), ("a", None, None), ("b", None, None), ("b", None, None),
                                (None, None, None)], "c string, n double, s string")
    st = P.impute_stats(df, numeric=["n"], categorical=["c", "s"])
    assert st == {"n": 0, "c": "a", "s": "missing"}
    filled = P.apply_fill(df, st)
    assert filled.where(F.col("c").isNull() | F.col("n").isNull() | F.col("s").isNull()).count() == 0


def _audit(spark, dp, eo, di, r=None):
    return spark.createDataFrame([(dp, eo, di, r)], "demographic_parity_difference double, "
                                 "equalized_odds_difference double, disparate_impact_ratio double, imbalance_ratio double")


def test_argmax_tie_goes_to_selection(spark):
    b = R.identify_bias(_audit(spark, 0.6, 0.05, 0.3)).first()
    assert b["score_selection"] == 1.0 and b["score_proxy"] == 1.0
    assert b["detected_bias_type"] == "Selection Bias"


def test_quiet_audit(spark):
    b = R.identify_bias(_audit(spark, 0.05, 0.05, 0.95)).first()
    assert b["detected_bias_type"] == "No Significant Bias" and b["severity_score"] == 0.0
    assert b["explanation"].startswith("Fairness metrics do not cross")


def test_severity_formula(spark):
    b = R.identify_bias(_audit(spark, 0.25, 0.2, 0.7, 0.4)).first()
    s = [min(1, (0.8 - 0.7) / 0.4), min(1, 0.25 / 0.5), min(1, 0.2 / 0.5), min(1, (0.5 - 0.4) / 0.5)]
    assert b["severity_score"] == round(0.7 * max(s) + 0.3 * sum(s) / len(s), 3)
    assert b["n_triggered"] == 4


def test_diagnosis_tie_historical_first(spark):
    summ = spark.createDataFrame([("g", 0.1, 0.2)], "attr string, imbalance_ratio double, selection_rate_gap double")
    d = R.diagnose(summ, ["attr"]).first()
    assert d["bias_type"] == "Historical Bias" and d["n_causes"] == 2 and d["severity"] == "High"


def test_recommendation_normalisation(spark):
    a = spark.createDataFrame([(1, "  selection BIAS "), (2, "whatever")], "k int, t string")
    rec = R.recommend(a, ["k"], "t").orderBy("k", "strategy_rank").collect()
    assert [r["strategy"] for r in rec] == ["Fairness-Constrained Learning", "Reweighing",
                                           "Continuous Fairness Monitoring"]


def test_corr_constant_and_null_dropped_and_ties_in_column_order(spark):
    rows = [(i % 2, 1.0, None, float(i % 2), float(i % 2)) for i in range(10)]
    df = spark.createDataFrame(rows, "s int, const double, nul double, f1 double, f2 double")
    c = X.pearson(df, "s")
    assert sorted(r["feature"] for r in c.collect()) == ["f1", "f2"]
    top = X.top_k(c, 1).first()
    assert top["feature"] == "f1"
    with pytest.raises(ValueError):
        X.top_k(c, 0)


def _gains(spark, rows):
    return spark.createDataFrame(rows, "strategy string, position int, accuracy double, fairness double, "
                                       "fairness_improvement double, accuracy_retention double")


def test_rank_ties_and_no_gain(spark):
    g = _gains(spark, [("A", 0, 0.8, 0.2, 0.1, 1.0), ("B", 1, 0.9, 0.2, 0.1, 1.0), ("C", 2, 0.7, 0.3, 0.0, 1.0)])
    r = [x["strategy"] for x in S.rank_strategies(g, []).orderBy("rank").collect()]
    assert r == ["B", "A", "C"]
    g2 = _gains(spark, [("A", 0, 0.8, 0.4, -0.1, 0.9), ("B", 1, 0.9, 0.5, 0.0, 1.0)])
    rr = {x["strategy"]: x["rank_score"] for x in S.rank_strategies(g2, []).collect()}
    assert rr == {"A": round(0.35 * 0.9, 6), "B": 0.35}


def test_strategy_empty_falls_back_to_monitoring(spark):
    empty = _gains(spark, []).withColumn("rank", F.lit(1)).withColumn("rank_score", F.lit(0.0)).withColumn("k", F.lit(0))
    slices = spark.createDataFrame([(0,)], "k int")
    r = S.select_strategy(empty, ["k"], slices).first()
    assert r["selected_strategy"] == "Continuous Fairness Monitoring"


def test_nan_and_null_both_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,), (3.0,)], "x double")
    clean = P.nan_to_null(df)
    assert clean.where(F.col("x").isNull()).count() == 2
    assert P.impute_stats(clean, numeric=["x"], categorical=[])["x"] == 2.0


def test_schema_validation_errors(spark):
    df = spark.createDataFrame([(1, "a", 0)], "x int, g string, y int")
    with pytest.raises(PR.SchemaError, match="Missing required"):
        PR.validate_schema(df, ["z"], "y", ["g"])
    with pytest.raises(PR.SchemaError, match="Target column"):
        PR.validate_schema(df, [], "t", ["g"])
    with pytest.raises(PR.SchemaError, match="No sensitive"):
        PR.validate_schema(df, [], "y", ["gender"])
    assert PR.validate_schema(df, ["x"], "y", ["race", "g"])["present_sensitive_attributes"] == ["g"]


def test_fixed3_rounds_binary_value(spark):
    from fairaudit.functions.exprs import fixed3
    df = spark.createDataFrame([(0.2875,), (2.675,), (0.0625,)], "x double")
    got = [r[0] for r in df.select(fixed3(F.col("x"))).collect()]
    assert got == [f"{v:.3f}" for v in (0.2875, 2.675, 0.0625)]
    assert not math.isnan(0.0)
