"""Preparation, reading and training on columns and values of any name and type."""

import datetime as dt
import os

import pytest

from fairaudit.operators import models as MO
from fairaudit.operators import prepare as P
from fairaudit.plans.audit import feature_columns, prepare_dataset
from fairaudit.sources import io as IO


def rows(n=240):
    city = ["St. Louis", "St_ Louis", "São `Paulo`", "", "a b", None]
    return [(i, city[i % 6], dt.date(2020, 1, 1) + dt.timedelta(days=i % 90) if i % 5 else None, dt.datetime(2021, 1, 1, i % 24),
             float(i % 13) if i % 7 else None, i % 3 == 0, "yes" if (i * 7) % 10 < 5 + i % 2 else "no", f"g{i % 2}") for i in range(n)]


SCHEMA = "`row.id` long, `city.name` string, `the day` date, at timestamp, y double, Y_ boolean, `hired?` string, `group.x` string"


@pytest.fixture(scope="module")
def prepared(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    return prepare_dataset(df, "hired?", "group.x", "row.id", exclude="Y_").cache()


def test_prepare_names_and_values(spark, prepared):
    feats = feature_columns(prepared, "row.id")
    assert prepared.columns[0] == "row.id" and not [c for c in feats if "." in c or "`" in c]
    assert len({c.lower() for c in prepared.columns}) == len(prepared.columns) and "y_2" in feats
    about = {f.metadata["feature"]["value"]: f.name for f in prepared.schema.fields
             if f.metadata.get("feature", {}).get("column") == "city.name" and "value" in f.metadata["feature"]}
    assert set(about) == {"St. Louis", "St_ Louis", "São `Paulo`", "", "a b"}
    got = {r["row.id"]: r for r in prepared.collect()}
    fill = min(about, key=lambda v: (-sum(r[1] == v for r in rows()), v))
    for r in rows():
        assert [v for v, c in about.items() if got[r[0]][c] == 1] == [r[1] if r[1] is not None else fill]
        assert r[2] is None or got[r[0]]["the day"] == (r[2] - dt.date(1970, 1, 1)).days
        assert got[r[0]]["at"] == (r[3] - dt.datetime(1970, 1, 1)).total_seconds()


@pytest.mark.parametrize("kind", ["logistic_regression", "random_forest"])
def test_train_and_score(spark, prepared, kind):
    feats = feature_columns(prepared, "row.id")
    spec = MO.ModelSpec(kind, params={"maxIter": 20} if kind.startswith("log") else {"numTrees": 5, "maxDepth": 4})
    m = MO.fit(prepared.where("split = 'train'"), feats, spec)
    out = MO.score(m, prepared.where("split = 'test'")).collect()
    assert out and all(r["y_pred"] in (0, 1) and 0 <= r["p1"] <= 1 for r in out)


def test_nested_columns_are_refused(spark):
    df = spark.createDataFrame([(1, [1], "a", 0)], "id long, xs array<int>, g string, y int")
    with pytest.raises(ValueError, match="xs"):
        prepare_dataset(df, "y", "g", "id")


def test_impute_and_one_hot_with_dots(spark):
    df = spark.createDataFrame([(1.0, "a.b"), (None, None), (3.0, "a.b"), (9.0, "c")], "`x.1` double, `t.u` string")
    assert [tuple(r) for r in P.impute(df).collect()] == [(1.0, "a.b"), (3.0, "a.b"), (3.0, "a.b"), (9.0, "c")]
    assert P.one_hot(df).columns == ["x.1", "t.u_a.b", "t.u_c"]


def test_csv_header_with_a_dot_and_many_tasks(spark, tmp_path):
    path = os.path.join(tmp_path, "t.csv")
    with open(path, "w") as f:
        f.write("a.b,c`d\n")
        for i in range(60_000):
            f.write(f"{i},text number {i}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = IO.read_csv(spark, path)
        assert df.columns == ["a.b", "c`d"] and dict(df.dtypes)["a.b"] == "bigint" and df.count() == 60_000
        assert df.rdd.getNumPartitions() > 3
        assert IO.read_csv(spark, path, multi_line=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_sparse_vectors_spread_missing_values(spark):
    """Nulls do not meet in one task of the join, and no Python runs."""
    df = spark.range(20_000).selectExpr("id", "if(id % 100 = 0, concat('v', id), null) a")
    out = P.one_hot_sparse(df, ["a"])
    assert "Python" not in out._jdf.queryExecution().toString()
    r = {x["id"]: x["a_values"] for x in out.where("id IN (0, 1)").collect()}
    assert r[0].size == 201 and r[0].indices.tolist() == [0] and r[1].indices.tolist() == [200]
    assert out.schema["a_values"].metadata["ml_attr"]["num_attrs"] == 201
