"""Quoted CSV text, NaN as missing, scratch folder off local masters."""

import os
import tempfile

import pytest
from paths import SF0001
from pyspark.sql import functions as F
from fairaudit import session
from fairaudit.operators import metrics as M
from fairaudit.operators import mitigate as MI
from fairaudit.operators import models as MO
from fairaudit.operators import prepare as P
from fairaudit.operators import proxy as X
from fairaudit.sources import io as IO
from fairaudit.streaming import monitor as MON


def test_csv_quotes_and_line_breaks(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="fairaudit-csv-"), "q")
    rows = [(1, 'he said "hi", ok'), (2, "two\nlines, \"quoted\""), (3, "plain")]
    IO.write_dataset(spark.createDataFrame(rows, "id long, text string").coalesce(1), path)
    assert sorted(map(tuple, IO.read_csv(spark, path, "id long, text string", multi_line=True).collect())) == rows


def test_nan_is_missing_in_imputation(spark):
    nan = float("nan")
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, nan, nan, None)], "x double")
    assert P.impute_stats(df, ["x"], [])["x"] == 2.0
    assert sorted(r["x"] for r in P.impute(df, ["x"], []).collect()) == [1.0, 2.0, 2.0, 2.0, 2.0, 3.0]


def test_scratch_folder_needed_off_local_masters():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        sparkContext = Context()
        conf = Context()
    with pytest.raises(RuntimeError):
        session.checkpoint_base(Session())


def _perf(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    r = M.evaluate_predictions(df).collect()[0]
    return r["accuracy"], r["precision"], r["recall"]


def test_evaluation_of_any_labels(spark):
    three = [(0, 0, "a"), (1, 1, "a"), (2, 2, "b"), (0, 1, "b"), (1, 2, "a"), (2, 0, "b")]
    assert _perf(spark, three, "y_true int, y_pred int, grp string") == (0.5, 0.5, 0.5)
    text = [(f"c{t}", f"c{p}", g) for t, p, g in three]
    assert _perf(spark, text, "y_true string, y_pred string, grp string") == (0.5, 0.5, 0.5)
    # labels 1 and 2: 1 is the positive one for precision and recall
    pair = [(1, 1, "a"), (1, 2, "a"), (2, 2, "b"), (2, 1, "b"), (2, 1, "a")]
    assert _perf(spark, pair, "y_true int, y_pred int, grp string") == (0.4, 0.333333, 0.5)
    binary = [(1, 1, "a"), (0, 1, "a"), (1, 0, "b"), (0, 0, "b"), (1, 1, "b")]
    df = spark.createDataFrame(binary, "y_true int, y_pred int, grp string")
    assert M.evaluate_predictions(df).collect() == M.evaluate_predictions(df, binary=True).collect()
    assert _perf(spark, [("yes", None, "a"), (None, None, "b")], "y_true string, y_pred string, grp string")[0] == 0.5


def test_exact_thresholds_separate_close_scores(spark):
    # all scores share one level of 1/1000, labels follow the fourth digit
    rows = [(0.5 + k * 1e-5, int(k >= 5), g) for k in range(10) for g in ("a", "b")]
    rows += [(None, 0, "a"), (float("nan"), 0, "b")]
    df = spark.createDataFrame(rows, "s double, y int, g string")
    th = MI.threshold_parity_exact(MI.group_roc_exact(df, "s", "y", "g"))
    out = MI.apply_group_threshold_exact(df, th, "s", "g").collect()
    assert all(r["y_pred"] == r["y"] for r in out) and len(out) == len(rows)
    eo = MI.threshold_equalized_odds_exact(MI.group_roc_exact(df, "s", "y", "g")).collect()
    assert {r["grp"] for r in eo} == {"a", "b"}


def test_spearman_of_many_sensitive_values_equals_few(spark, monkeypatch):
    rows = [(i * 7 % 13, (i * i) % 11 + 0.5, None if i % 9 == 0 else i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "s int, x double, z int")
    few = {r["feature"]: r["correlation"] for r in X.spearman(df, "s").collect()}
    monkeypatch.setattr(X, "MAX_CODES", 2)
    many = {r["feature"]: r["correlation"] for r in X.spearman(df, "s").collect()}
    assert few.keys() == many.keys() and all(abs(few[k] - many[k]) < 1e-9 for k in few)


def test_stream_sink_replaces_a_batch_that_runs_again(spark):
    src, out = (os.path.join(tempfile.mkdtemp(prefix="fairaudit-stream-"), n) for n in ("in", "out"))
    rows = [(f"2024-01-0{d} 10:00:00", g, d % 2) for d in range(1, 8) for g in ("a", "b")]
    ev = spark.createDataFrame(rows, "t string, g string, y int").selectExpr("cast(t as timestamp) t", "g", "y")
    ev.coalesce(1).write.parquet(src)
    got = []
    for checkpoint in ("c1", "c2"):          # the second run starts anew and writes the same epochs
        MON.run_monitor_stream(spark, src, ev.schema, "t", "g", "y", out, f"{out}-{checkpoint}")
        got.append(sorted(map(tuple, spark.read.parquet(f"{out}/groups").collect())))
    assert got[0] and got[0] == got[1]


def test_kendall_for_any_number_of_values_against_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    rows = [(("a", None)[i % 2], float(rng.integers(0, 400)), float(rng.integers(0, 37)), 5.0, None if i % 9 == 0 else float(i % 7))
            for i in range(700)]
    df = spark.createDataFrame(rows, "part string, s double, x double, constant double, holes double")
    for sl in ([], ["part"]):
        got = {(r["part"] if sl else "all", r["feature"]): r["correlation"]
               for r in X._kendall_cells(df, "s", ["x", "constant", "holes"], sl).collect()}
        want = {}
        for part in (["a", None] if sl else ["all"]):
            sub = [r for r in rows if not sl or r[0] == part]
            for f, i in (("x", 2), ("holes", 4)):
                a = np.array([[r[1], r[i]] for r in sub if r[i] is not None])
                iu = np.triu_indices(len(a), 1)
                ds = np.sign(a[:, 0][:, None] - a[:, 0][None, :])[iu]
                dx = np.sign(a[:, 1][:, None] - a[:, 1][None, :])[iu]
                want[part, f] = (ds * dx).sum() / np.sqrt((ds != 0).sum() * (dx != 0).sum())
        assert got.keys() == want.keys()  # a constant has no correlation
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert X._kendall_cells(df.where("false"), "s", ["x"], []).count() == 0
    few = df.withColumn("s", F.col("s") % 5)
    a = {r["feature"]: r["correlation"] for r in X.kendall(few, "s", ["x", "holes"]).collect()}
    b = {r["feature"]: r["correlation"] for r in X._kendall_cells(few, "s", ["x", "holes"], []).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_kendall_in_blocks_of_values_counts_every_pair_once(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(X, "BLOCK_ROWS", 60)
    monkeypatch.setattr(X, "BLOCKS", 9)
    rng = np.random.default_rng(8)
    n = 1200
    s = np.where(rng.random(n) < 0.3, 50.0, np.round(rng.normal(50, 30, n), 1))       # a value of 30 % of the rows
    cols = {"many": np.round(s + rng.normal(0, 40, n), 2), "few": rng.integers(0, 5, n).astype(float),
            "two": (rng.random(n) < 0.9).astype(float), "ends": np.where(rng.random(n) < 0.2, -np.inf, s * rng.integers(-1, 2, n))}
    part = rng.integers(0, 3, n)
    rows = [(int(part[i]), float(s[i]), *[float(v[i]) for v in cols.values()]) for i in range(n)]
    df = spark.createDataFrame(rows, "part int, s double, " + ", ".join(f"{c} double" for c in cols)).repartition(3)
    for sl in ([], ["part"]):
        got = {(r["part"] if sl else -1, r["feature"]): r["correlation"]
               for r in X._kendall_cells(df, "s", list(cols), sl).collect()}
        assert len(got) == (12 if sl else 4)
        for (p, f), r in got.items():
            at = (part == p) if sl else np.full(n, True)
            a, b = s[at], np.unique(cols[f], return_inverse=True)[1][at]
            iu = np.triu_indices(len(a), 1)
            ds, dx = np.sign(a[:, None] - a[None, :])[iu], np.sign(b[:, None] - b[None, :])[iu]
            assert abs(r - (ds * dx).sum() / np.sqrt(float((ds != 0).sum()) * float((dx != 0).sum()))) < 1e-12, (p, f)


def test_kendall_rows_are_not_repeated_per_bit(spark):
    """No table of the job has more rows than twice the rows times the features."""
    df = spark.range(3000).select((F.col("id") * 7919 % 3000).cast("double").alias("s"), (F.col("id") * 31 % 3000).cast("double").alias("x"),
                                  (F.col("id") * 17 % 3000).cast("double").alias("y"))
    sizes = []
    staged = X.Scratch.staged

    def seen(self, table, name):
        out = staged(self, table, name)
        sizes.append((name, out.count()))
        return out
    X.Scratch.staged = seen
    try:
        X._kendall_cells(df, "s", ["x", "y"], []).collect()
    finally:
        X.Scratch.staged = staged
    assert dict(sizes) == {"kendall_values": 3000, "kendall_blocks": 6000}


def test_forest_rows_are_spread_over_tasks(spark, monkeypatch):
    """A table of one file split used to be trained on by one task."""
    from fairaudit.operators import models as MO
    monkeypatch.setattr(MO, "RF_TREES", 3)
    monkeypatch.setattr(MO, "RF_MAX_DEPTH", 3)
    monkeypatch.setattr(MO, "FOREST_TASK_ROWS", (100, 1000))
    seen = []
    fit = MO.Pipeline.fit
    monkeypatch.setattr(MO.Pipeline, "fit", lambda self, data: seen.append((data.rdd.getNumPartitions(), data.count())) or fit(self, data))
    df = spark.range(650).select((F.col("id") % 13).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
                                 (F.col("id") % 13 > 6).cast("int").alias("y")).coalesce(1)
    m = MO.fit(df, ["a", "b"], MO.ModelSpec("random_forest"))
    assert seen == [(6, 650)]
    assert MO.score(m, df).where("y_pred = y").count() > 600
    assert [MO._forest_tasks(n) for n in (0, 199, 650, 2600, 30_000)] == [1, 1, 6, 12, 30]


def test_preparation_with_more_categories_than_columns(spark):
    from fairaudit.plans.audit import feature_columns, prepare_dataset
    df = spark.range(4000).select("id", F.concat(F.lit("v"), F.col("id") % 1500).alias("wide"),
                                  F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("grp"),
                                  (F.col("id") % 1500 < 700).cast("int").alias("y0"))
    p = prepare_dataset(df, "y0", "grp", "id").checkpoint()
    feats = feature_columns(p, "id")
    assert "wide_values" in feats and "grp_a" in feats and p.count() == 4000
    assert p.select(F.max(F.col("wide_values").cast("string"))).first()[0].startswith("(150")
    train = p.where("split = 'train'")
    model = MO.fit(train, feats)
    assert MO.score(model, train).where("y != y_pred").count() == 0


def test_saved_models_of_each_kind_predict_alike(spark):
    from fairaudit.plans.q_io import q_load_saved_strategies
    rows = q_load_saved_strategies(spark, SF0001).collect()
    assert len(rows) == 3 and all(r["n_equal"] == r["n_rows"] > 0 for r in rows)


def test_failed_strategy_keeps_a_row(spark, monkeypatch):
    from fairaudit.plans import pipeline as PP
    df = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("x"),
                                 F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("sensitive"),
                                 (F.col("id") % 7 > 3).cast("int").alias("y"))
    real = MO.run_strategy

    def run(name, *args, **kw):
        if name == MO.DEBIAS:
            raise ValueError("no feature left")
        return real(name, *args, **kw)
    monkeypatch.setattr(MO, "run_strategy", run)
    got = {r["strategy"]: r for r in PP.evaluate_strategies(df, df, ["x"], [MO.REWEIGHING, MO.DEBIAS]).collect()}
    assert got[MO.DEBIAS]["error"] == "no feature left" and got[MO.DEBIAS]["accuracy"] is None
    assert got[MO.REWEIGHING]["error"] is None and got[MO.REWEIGHING]["accuracy"] is not None


def test_one_hot_sparse_keeps_values_off_the_driver(spark, monkeypatch):
    from pyspark.ml.feature import StringIndexer
    from pyspark.sql import functions as F
    from fairaudit.operators import prepare as P
    df = spark.range(3000).selectExpr("id", "if(id % 50 = 0, null, concat('v', id % 1500)) a", "if(id % 3 = 0, 'x', 'é') b")
    model, _ = P.one_hot_vector(df, ["a", "b"])
    want = {r["id"]: (r["a__vec"], r["b__vec"]) for r in model.transform(df).collect()}

    def fail(*_):
        raise AssertionError("all values gathered in one place")
    monkeypatch.setattr(StringIndexer, "fit", fail)
    out = P.one_hot_sparse(df, ["a", "b"])
    assert out.columns == ["id", "a_values", "b_values"]
    assert {r["id"]: (r["a_values"], r["b_values"]) for r in out.collect()} == want
    assert P.one_hot_sparse(df.where(F.lit(False)), ["a"]).count() == 0
