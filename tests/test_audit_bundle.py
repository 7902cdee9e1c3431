"""The audit from a CSV file to its whole bundle of reports, and a benchmark with a model that fails."""

import json
import os
import random

import pytest

from fairaudit.operators import models as MO
from fairaudit.operators.profile import SchemaError
from fairaudit.plans.audit import feature_columns, prepare_dataset
from fairaudit.plans.pipeline import audit_csv
from fairaudit.plans.q_strategies import benchmark

REPORTS = {"config", "dataset_analysis", "profile", "correlations", "baseline", "mitigated", "bias", "diagnosis", "recommendations",
           "strategies", "failed_strategies", "choices", "comparison", "confusion_matrix"}


def people(n=300):
    rnd = random.Random(5)
    rows = []
    for _ in range(n):
        g = rnd.choice(["m", "m", "f"])
        skill = rnd.gauss(0, 1)
        rows.append((g, rnd.choice(["St. Louis", "Bonn", "NA"]), round(skill, 3), rnd.randrange(20, 60),
                     "hired" if skill + (0.8 if g == "m" else -0.3) + rnd.gauss(0, .5) > 0.3 else "rejected"))
    return rows


@pytest.fixture(scope="module")
def csv_file(tmp_path_factory):
    path = os.path.join(tmp_path_factory.mktemp("csv"), "people.csv")
    with open(path, "w") as f:
        f.write("gender,home.town,skill,age,outcome\n")
        for r in people():
            f.write(",".join(map(str, r)) + "\n")
    return path


def test_audit_from_csv(spark, csv_file, tmp_path):
    out = audit_csv(spark, csv_file, "outcome", "gender", out_dir=str(tmp_path / "o"), strategies=["Reweighing", "no such thing",
                    "Post-Processing Threshold Optimization", "Equalized Odds Post-Processing"]).collect()
    assert len(out) == 1 and out[0]["attr"] == "gender" and out[0]["selected_strategy"]
    folder = tmp_path / "o" / "reports"
    assert set(os.listdir(folder)) == REPORTS

    def report(name):
        return [json.loads(line) for p in sorted(folder.joinpath(name).glob("part-*")) for line in p.read_text().splitlines()]
    assert {r["choice"] for r in report("choices")} == {"balanced", "fairness", "accuracy"}
    assert {r["column"] for r in report("profile")} >= {"gender", "home.town", "skill", "age", "outcome"}
    cm = report("confusion_matrix")
    assert {r["model"] for r in cm} == {"baseline", "mitigated"}
    assert sum(r["n"] for r in cm if r["model"] == "baseline") == 60 == report("mitigated")[0]["n"]
    assert report("config")[0]["selected_strategy"] == out[0]["selected_strategy"]
    ranked = report("strategies")
    assert {r["strategy"] for r in ranked} == {"Reweighing", "no such thing", "Post-Processing Threshold Optimization", "Equalized Odds Post-Processing"}


def test_audit_csv_checks_the_schema(spark, csv_file):
    with pytest.raises(SchemaError, match="Target column 'x'"):
        audit_csv(spark, csv_file, "x", "gender")
    with pytest.raises(SchemaError, match="sensitive"):
        audit_csv(spark, csv_file, "outcome", "race")
    with pytest.raises(SchemaError, match="years"):
        audit_csv(spark, csv_file, "outcome", "gender", required=["years"])


def test_benchmark_skips_a_model_that_fails(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(people())], "id long, gender string, town string, skill double, age long, outcome string")
    p = prepare_dataset(df, "outcome", "gender", "id").cache()
    configs = {"good": MO.ModelSpec("lr"), "forest": MO.ModelSpec("rf", params={"numTrees": 5, "maxDepth": 30}),
               "bad": MO.ModelSpec("lr", params={"maxIter": -1}), "unknown": MO.ModelSpec("svm")}
    rows = {r["model_name"]: r for r in benchmark(p.where("split = 'train'"), p.where("split = 'test'"), feature_columns(p, "id"), configs).collect()}
    assert set(rows) == set(configs)
    assert all(rows[k]["error"] is None and 0.5 < rows[k]["accuracy"] <= 1 for k in ("good", "forest"))
    assert all(rows[k]["error"] and rows[k]["accuracy"] is None for k in ("bad", "unknown"))
    with pytest.raises(ValueError):
        MO.train_many(p, feature_columns(p, "id"), {"unknown": MO.ModelSpec("svm")})
