"""Forests grown on cells: the trees of Spark ML, whatever the layout of the rows."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from fairaudit.operators import forest as FO
from fairaudit.operators import models as MO


def rows(spark, n=4000, classes=2):
    """Few and many values, negative ones, neighbours in the last digits, a constant; whole weights."""
    u = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long")
    df = spark.range(n).select("id", (u % 5).cast("int").alias("few"), ((u % 4001 - 2000) / 8).alias("many"),
                               (F.lit(1.7e9) + (u % 3000) / 1024).alias("late"), F.lit(3.0).alias("same"), (u % 3 == 0).alias("flag"),
                               (1 + u % 4).cast("double").alias("w"), (u % 11 == 0).alias("noise"))
    y = ((F.col("many") > 40).cast("int") + ((F.col("few") > 1) & (F.col("late") > 1.7e9 + 1)).cast("int")) % classes
    return df.withColumn("y", F.when(F.col("noise"), (F.col("id") % classes).cast("int")).otherwise(y)).drop("noise")


FEATURES = ["few", "many", "late", "same", "flag"]


def nodes(spark, model, path):
    model.write().overwrite().save(path)
    found = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    return [(r["treeID"], r["id"], r["prediction"], round(r["impurity"], 9), tuple(r["impurityStats"]), r["rawCount"], round(r["gain"], 9),
             r["leftChild"], r["rightChild"], r["split"]["featureIndex"], tuple(r["split"]["leftCategoriesOrThreshold"])) for r in found]


@pytest.mark.parametrize("classes, params", [(2, {"maxDepth": 7}), (3, {"maxDepth": 5, "maxBins": 12}), (2, {"maxDepth": 9, "minInstancesPerNode": 40, "minInfoGain": 0.002})])
def test_trees_are_those_of_spark_ml(spark, tmp_path, monkeypatch, classes, params):
    monkeypatch.setattr(FO, "HISTOGRAM", 500)           # levels in several parts
    df = rows(spark, classes=classes).cache()
    clf = RandomForestClassifier(featuresCol="_features", labelCol="y", weightCol="w", numTrees=1, bootstrap=False, seed=3, **params)
    want = clf.fit(VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(df))
    got = FO.cell_forest(df, FEATURES, "y", "w", clf)
    table = nodes(spark, want, f"{tmp_path}/want")
    assert len(table) > 8 and nodes(spark, got, f"{tmp_path}/got") == table
    assert got.numClasses == want.numClasses == classes and np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray())


def test_forest_does_not_depend_on_the_layout_of_rows(spark, tmp_path, monkeypatch):
    """Tasks used to seed the draws of rows, so that another layout gave other trees; and every level was a pass over the rows."""
    monkeypatch.setattr(MO, "RF_TREES", 6)
    monkeypatch.setattr(MO, "RF_MAX_DEPTH", 5)
    df = rows(spark, 24_000).drop("w").checkpoint()
    one = MO.fit(df.coalesce(1), FEATURES, MO.ModelSpec("random_forest")).stages[-1]
    many = MO.fit(df.repartition(7, "few", "id"), FEATURES, MO.ModelSpec("random_forest")).stages[-1]
    table = nodes(spark, one, f"{tmp_path}/one")
    assert len(table) > 60 and table == nodes(spark, many, f"{tmp_path}/many")
    raw = [r[5] for r in table if r[1] == 0]
    assert len(set(raw)) > 1 and all(abs(n - 24_000) < 1000 for n in raw)        # each tree has draws of its own


def test_fitted_forest_scores_and_is_saved(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(MO, "RF_TREES", 10)
    monkeypatch.setattr(MO, "FOREST_CELL_ROWS", 1000)
    monkeypatch.setattr(MO.Pipeline, "fit", lambda *_: pytest.fail("the rows went through Spark ML"))
    df = rows(spark)
    model = MO.fit(df, FEATURES, MO.ModelSpec("random_forest", params={"leafCol": "leaf"}), sample_weight="w")
    assert MO.score(model, df).where("y_pred = y").count() > 3600
    assert model.stages[-1].getNumTrees == 10 and model.stages[-1].getLeafCol() == "leaf"
    MO.save_model(spark, model, f"{tmp_path}/m", {})
    again = MO.load_model(spark, f"{tmp_path}/m")
    pairs = MO.score(again, df).select("id", "p1").join(MO.score(model, df).select("id", F.col("p1").alias("q1")), "id")
    assert pairs.where("p1 != q1").count() == 0


def test_what_cells_are_not_for_goes_to_spark_ml(spark, monkeypatch):
    df = rows(spark, 500)
    clf = RandomForestClassifier(featuresCol="_features", labelCol="y", weightCol="w", numTrees=2)
    assert FO.cell_forest(df.withColumn("y", F.col("y").cast("string")), FEATURES, "y", "w", clf) is None
    assert FO.cell_forest(df.withColumn("many", F.when(F.col("id") > 0, F.col("many"))), FEATURES, "y", "w", clf) is None
    assert FO.cell_forest(df.withColumn("y", F.col("y") - 1), FEATURES, "y", "w", clf) is None
    assert FO.cell_forest(df, FEATURES, "y", "w", clf.copy({clf.impurity: "entropy"})) is None
    monkeypatch.setattr(FO, "CELL_BYTES", 5000)
    assert FO.cell_forest(df, FEATURES, "y", "w", clf) is None


def test_values_are_told_apart_where_they_weigh(spark):
    """Cuts halfway between neighbours that differ in their last bits only; a rare value far away moves none."""
    near = [1.0, np.nextafter(1.0, 2), 1.0 + 1e-9, -1e300, 0.0, -0.0]
    df = spark.createDataFrame([(float(v), 0, 1.0) for v in near for _ in range(50)], "_0 double, _y long, _w double").repartition(3)
    (cuts,) = FO.cut_points(df, 1, 32)
    values = sorted(set(near))
    assert len(cuts) == len(values) - 1 and all(a <= c < b for a, c, b in zip(values, cuts, values[1:]))
    ids = spark.range(100_000).select((F.col("id") / 7).alias("_0"), F.lit(1).alias("_y"), (1 + (F.col("id") < 50_000).cast("double")).alias("_w"))
    (cuts,) = FO.cut_points(ids, 1, 32)
    at = np.array(cuts) * 7
    shares = np.where(at < 50_000, 2 * at, 50_000 + at) / 150_000
    assert len(cuts) == 31 and np.abs(shares - np.arange(1, 32) / 32).max() < 1 / 1000


def write_orders(spark, path, files, n=30_000):
    """The tables of ``order_audit``; the same rows whatever the number of files."""
    u = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long")
    spark.range(5).selectExpr("cast(id as int) r_regionkey", "concat('region ', id) r_name").write.parquet(f"{path}/region.parquet")
    spark.range(10).selectExpr("cast(id as int) n_nationkey", "concat('nation ', id) n_name", "cast(id % 5 as int) n_regionkey").write.parquet(f"{path}/nation.parquet")
    spark.range(1000).select(F.col("id").alias("c_custkey"), (u % 10).cast("int").alias("c_nationkey"), F.concat(F.lit("segment "), u % 3).alias("c_mktsegment"),
                             (u % 9001 / 8).alias("c_acctbal")).repartition(files).write.parquet(f"{path}/customer.parquet")
    spark.range(n).select(F.col("id").alias("o_orderkey"), (u % 1000).alias("o_custkey"), (1000 + u % 499_001 + (u % 8) / 8).alias("o_totalprice"),
                          F.expr("timestamp'2020-01-01 00:00:00'").alias("o_orderdate"), F.concat(F.lit("priority "), u % 4).alias("o_orderpriority")
                          ).repartition(files).write.parquet(f"{path}/orders.parquet")
    return str(path)


def test_train_forest_gives_the_same_on_any_files(spark, tmp_path, monkeypatch):
    """Rows that came in other files were drawn otherwise, and the importances differed."""
    from fairaudit.plans.q_strategies import q_train_forest
    monkeypatch.setattr(MO, "RF_TREES", 5)
    monkeypatch.setattr(MO, "RF_MAX_DEPTH", 6)
    one, five = ({r["feature"]: r["importance"] for r in q_train_forest(spark, write_orders(spark, tmp_path / str(k), k)).collect()} for k in (1, 5))
    assert one == pytest.approx(five, abs=1e-12) and abs(sum(one.values()) - 1) < 1e-9 and len(one) == 14
    assert max(one, key=one.get) == "o_totalprice"


def test_train_many_fits_both_kinds_of_model(spark, monkeypatch):
    """On many rows only the logistic regression iterates over the rows; a forest that cannot be grown leaves its reason."""
    monkeypatch.setattr(MO, "RF_TREES", 6)
    fits, fit = [], MO.Pipeline.fit
    monkeypatch.setattr(MO.Pipeline, "fit", lambda self, data: fits.append(type(self.getStages()[-1]).__name__) or fit(self, data))
    df = rows(spark, 24_000).drop("w").checkpoint()
    models = MO.train_many(df, FEATURES)
    assert sorted(models) == ["logistic_regression", "random_forest"] and fits == ["LogisticRegression"]
    assert MO.score(models["random_forest"], df).where("y_pred = y").count() > 21_000
    errors: dict[str, str] = {}
    bad = df.withColumn("many", F.when(F.col("id") > 0, F.col("many")))
    assert MO.train_many(bad, FEATURES, {"random_forest": MO.ModelSpec("random_forest")}, errors=errors) == {}
    assert list(errors) == ["random_forest"] and "NaN" in errors["random_forest"]
