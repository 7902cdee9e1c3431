"""Every registered query with a SQL oracle: Spark result == DuckDB result on
sf0.001 (the driver repeats this on sf0.01); rows-only queries must run."""

import pytest

from paths import SF0001
from check_oracle import compare, duck
from fairaudit.plans.registry import ORACLES, QUERIES, load_all

load_all()

# queries that train forests or many models: run with small forests
TRAINING = {"train_forest", "train_many", "model_benchmark", "evaluate_strategies", "audit_pipeline",
            "fair_constrained", "tree_group_importance", "tree_contributions"}
# columns with figures that every row of a query must have in [0, 1] (null: not measured)
SHARES = {"accuracy", "p1", "importance", "disparate_impact_ratio", "demographic_parity_difference", "equalized_odds_difference",
          "expected_value", "baseline_accuracy", "fairness"}


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    ok, msg, *_ = compare(spark, con, name, QUERIES[name], ORACLES[name], SF0001)
    assert ok, msg


def check_rows(df):
    """Rows, no repeated column, and shares within their bounds."""
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    for c in SHARES & set(df.columns):
        assert all(r[c] is None or -1e-9 <= r[c] <= 1 + 1e-9 for r in rows), c
    if "error" in df.columns:
        assert all(r["error"] is None for r in rows)
    return rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - TRAINING))
def test_rows_only_query(spark, name):
    check_rows(QUERIES[name](spark, SF0001))


@pytest.mark.parametrize("name", sorted(TRAINING))
def test_training_query(spark, name, monkeypatch):
    from fairaudit.operators import models as MO
    monkeypatch.setattr(MO, "RF_TREES", 8)
    monkeypatch.setattr(MO, "RF_MAX_DEPTH", 5)
    rows = check_rows(QUERIES[name](spark, SF0001))
    if name == "train_forest":
        assert abs(sum(r["importance"] for r in rows) - 1) < 1e-6
    if name == "tree_contributions":        # local accuracy
        assert all(abs(r["expected_value"] + r["sum_contributions"] - r["p1"]) < 1e-5 for r in rows)
    if name in ("train_many", "model_benchmark"):
        assert {r["model_name"] for r in rows} == {"logistic_regression", "random_forest"}
