"""Split and resampling by a cut hash: same rows as sorting by hash, one scan of the input."""

import hashlib
import math
import random
from collections import Counter

import pytest

from fairaudit.operators import mitigate as MI
from fairaudit.operators import prepare as P


def h(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def frame(spark, n=900, seed=1):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["a", "a", "a", "b", "b", None]), rnd.choice([0, 1])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k long, c string, y int")


@pytest.mark.parametrize("cut_rows", [50_000, 3])
def test_split_takes_the_first_hashes_of_each_class(spark, monkeypatch, cut_rows):
    monkeypatch.setattr(P, "CUT_ROWS", cut_rows)
    monkeypatch.setattr(P, "CUT_PREFIX", 1)
    rows, df = frame(spark)
    got = {r["k"]: r["split"] for r in P.split(df, "k", "c", 0.2, 7).collect()}
    counts = Counter(c for _, c, _ in rows)
    want = P.split_counts(list(counts.items()), math.ceil(0.2 * len(rows)))
    for c in counts:
        order = sorted((h(7, k), k) for k, x, _ in rows if x == c)
        assert {k for _, k in order[:want[c]]} == {k for k, x, _ in rows if x == c and got[k] == "test"}


def test_split_without_classes_and_class_shares(spark, monkeypatch):
    rows, df = frame(spark, 300)
    first = sorted((h(42, k), k) for k, *_ in rows)[:60]
    for target in ("c", "k"):     # k: a class per row cannot be stratified
        got = {r["k"] for r in P.split(df, "k", target, 0.2, stratify=target == "k").where("split = 'test'").collect()}
        assert got == {k for _, k in first}
    per = df.groupBy(df["c"].alias("_cls")).count().withColumnRenamed("count", "_c")
    small = {r["_cls"]: r["_want"] for r in P.class_shares(per, 3, 300, 61).collect()}
    monkeypatch.setattr(P, "CLASSES_MAX", 0)
    assert {r["_cls"]: r["_want"] for r in P.class_shares(per, 3, 300, 61).collect()} == small and sum(small.values()) == 61


def test_rows_of_one_key_stay_together(spark):
    df = spark.createDataFrame([(k % 5, "ab"[k % 2]) for k in range(1000)] + [(None, "a")], "k long, c string")
    out = P.split(df, "k", "c", 0.3)
    assert out.count() == 1001
    assert out.groupBy("k", "c").agg({"split": "count"}).count() == out.select("k", "c", "split").distinct().count()
    assert out.where("k IS NULL").first()["split"] == "train"
    assert P.split(df.limit(0), "k", "c").count() == 0


def test_resample_takes_the_first_hashes_once_more(spark):
    rows, df = frame(spark)
    got = Counter(r["k"] for r in MI.resample(df, "c", "y", "k").collect())
    na, ny, cell = Counter(c for _, c, _ in rows), Counter(y for *_, y in rows), Counter((c, y) for _, c, y in rows)
    for (c, y), m in cell.items():
        t = (2 * na[c] * ny[y] + len(rows)) // (2 * len(rows))
        order = sorted((h(42, k), k) for k, a, b in rows if (a, b) == (c, y))
        for i, (_, k) in enumerate(order):
            assert got[k] == t // m + (i < t % m)


def test_one_scan_of_the_input(spark, tmp_path):
    _, df = frame(spark)
    df.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    for out in (P.split(t, "k", "c"), MI.resample(t, "c", "y", "k")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Window" not in plan and "Union" not in plan
