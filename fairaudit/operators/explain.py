"""Explainability (§2.10): tree attributions and group comparisons.

* ``tree_contributions``: path-dependent TreeSHAP (Lundberg et al. 2018) for
  a Spark ``RandomForestClassificationModel``. The forest's node table comes
  from Spark ML persistence (bounded by the model size), is broadcast, and
  ``mapInPandas`` evaluates it per Arrow batch, vectorised across the rows
  of the batch -- the recursion visits each node once per batch.
* The aggregates work on the long table (row, group, feature, contribution):
  global importance, per-group importance, group spread and the pairwise
  plain-language insights.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

# Insight sentences and the fallback.
NO_INSIGHT = "No large SHAP differences were found across demographic groups."


# --------------------------------------------------------------------------
# the forest as arrays
# --------------------------------------------------------------------------

def forest_arrays(spark, rf_model) -> list[dict]:
    """Per tree: left, right, feature, threshold, value (class-1 share),
    cover (weighted node size), indexed by node id."""
    path = scratch_path(spark, "forest")
    rf_model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.impurityStats", "nodeData.leftChild", "nodeData.rightChild",
        "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold",
        "nodeData.split.numCategories").toPandas()  # model-sized, not data-sized
    trees = []
    for tid, g in nodes.groupby("treeID"):
        g = g.sort_values("id")
        n = int(g["id"].max()) + 1
        left = np.full(n, -1, dtype=np.int64)
        right = np.full(n, -1, dtype=np.int64)
        feat = np.full(n, -1, dtype=np.int64)
        thr = np.zeros(n)
        val = np.zeros(n)
        cover = np.zeros(n)
        for r in g.itertuples(index=False):
            i = int(r.id)
            stats = np.asarray(r.impurityStats, dtype=float)
            cover[i] = stats.sum()
            val[i] = stats[1] / cover[i] if cover[i] > 0 and len(stats) > 1 else 0.0
            left[i], right[i] = int(r.leftChild), int(r.rightChild)
            if left[i] >= 0:
                if int(r.numCategories) != -1:
                    raise ValueError("categorical splits are not supported; assemble numeric features")
                feat[i] = int(r.featureIndex)
                thr[i] = float(r.leftCategoriesOrThreshold[0])
        root = int(g["id"].min())
        trees.append({"left": left, "right": right, "feat": feat, "thr": thr, "val": val,
                      "cover": cover, "root": root})
    return trees


def expected_value(tree: dict) -> float:
    leaves = tree["left"] < 0
    used = tree["cover"] > 0
    m = leaves & used
    return float((tree["val"][m] * tree["cover"][m]).sum() / tree["cover"][tree["root"]])


# --------------------------------------------------------------------------
# vectorised path-dependent TreeSHAP
# --------------------------------------------------------------------------

def _extend(path, pz, po, pi, b):
    ds, zs, os_, ws = path
    l = len(ds)
    ds, zs, os_ = ds + [pi], zs + [pz], os_ + [po]
    ws = [w.copy() for w in ws] + [np.ones(b) if l == 0 else np.zeros(b)]
    for i in range(l - 1, -1, -1):
        ws[i + 1] = ws[i + 1] + po * ws[i] * (i + 1) / (l + 1)
        ws[i] = pz * ws[i] * (l - i) / (l + 1)
    return ds, zs, os_, ws


def _unwound_weights(path, i):
    """Weights of the path with element i removed (only the weights)."""
    ds, zs, os_, ws = path
    l = len(ds) - 1
    n = ws[l].copy()
    o_i, z_i = os_[i], zs[i]
    nz = o_i != 0
    safe_o = np.where(nz, o_i, 1.0)
    out = [None] * l
    for j in range(l - 1, -1, -1):
        t = ws[j]
        w_nz = n * (l + 1) / ((j + 1) * safe_o)
        w_z = (t * (l + 1)) / (z_i * (l - j)) if z_i != 0 else np.zeros_like(t)
        out[j] = np.where(nz, w_nz, w_z)
        n = np.where(nz, t - out[j] * z_i * (l - j) / (l + 1), n)
    return out


def _unwind(path, i):
    ds, zs, os_, ws = path
    new_w = _unwound_weights(path, i)
    keep = [k for k in range(len(ds)) if k != i]
    return [ds[k] for k in keep], [zs[k] for k in keep], [os_[k] for k in keep], new_w


def tree_shap_batch(X: np.ndarray, tree: dict, n_features: int) -> np.ndarray:
    """SHAP values (rows x features) of one tree's class-1 share."""
    b = X.shape[0]
    phi = np.zeros((b, n_features))
    left, right, feat, thr, val, cover = (tree[k] for k in ("left", "right", "feat", "thr", "val", "cover"))

    def recurse(j, path, pz, po, pi):
        path = _extend(path, pz, po, pi, b)
        if left[j] < 0:
            ds, zs, os_, _ = path
            for i in range(1, len(ds)):
                w = sum(_unwound_weights(path, i))
                phi[:, ds[i]] += w * (os_[i] - zs[i]) * val[j]
            return
        d = feat[j]
        go_left = (X[:, d] <= thr[j]).astype(float)
        iz, io = 1.0, np.ones(b)
        ds = path[0]
        if d in ds[1:]:
            k = ds.index(d, 1)
            iz, io = path[1][k], path[2][k]
            path = _unwind(path, k)
        for child, hot in ((left[j], go_left), (right[j], 1.0 - go_left)):
            if cover[j] > 0:
                recurse(child, path, iz * cover[child] / cover[j], io * hot, d)

    recurse(tree["root"], ([], [], [], []), 1.0, np.ones(b), -1)
    return phi


def forest_shap_batch(X: np.ndarray, trees: list[dict]) -> tuple[np.ndarray, float, np.ndarray]:
    """(phi, expected, prediction) averaged over trees, as the forest averages."""
    m = X.shape[1]
    phi = np.zeros((X.shape[0], m))
    exp = 0.0
    for t in trees:
        phi += tree_shap_batch(X, t, m)
        exp += expected_value(t)
    k = len(trees)
    phi /= k
    exp /= k
    return phi, exp, phi.sum(axis=1) + exp


def tree_contributions(df: DataFrame, rf_model, features: list[str], id_cols: list[str]) -> DataFrame:
    """(id_cols..., contributions array<double>, expected_value, p1) per row.

    ``rf_model``: a fitted RandomForestClassificationModel (or a pipeline
    whose last stage is one) trained on ``features`` in this order. Other
    model types are refused, as tree explanations only apply to trees.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import RandomForestClassificationModel
    m = rf_model.stages[-1] if isinstance(rf_model, PipelineModel) else rf_model
    if not isinstance(m, RandomForestClassificationModel):
        raise ValueError("Tree contributions need a tree-based model (random forest).")
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(forest_arrays(spark, m))
    feats = list(features)
    ids = list(id_cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = bc.value
        for pdf in batches:
            if pdf.empty:
                continue
            X = pdf[feats].to_numpy(dtype=float)
            phi, exp, pred = forest_shap_batch(X, trees)
            out = pdf[ids].copy()
            out["contributions"] = list(phi)
            out["expected_value"] = exp
            out["p1"] = pred
            yield out

    id_schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in ids)
    schema = f"{id_schema}, contributions array<double>, expected_value double, p1 double"
    ship_package(df.sparkSession)
    return df.select(*ids, *feats).mapInPandas(run, schema)


def contributions_long(contrib: DataFrame, features: list[str], id_cols: list[str]) -> DataFrame:
    """(id_cols..., feature, contribution) via posexplode."""
    names = F.array(*[F.lit(f) for f in features])
    e = contrib.select(*id_cols, F.posexplode("contributions").alias("i", "contribution"))
    return e.select(*id_cols, names[F.col("i")].alias("feature"), "contribution")


# --------------------------------------------------------------------------
# aggregates over the long table
# --------------------------------------------------------------------------

def global_importance(long: DataFrame, top_n: int = 10) -> DataFrame:
    """mean |contribution| per feature, descending (ties by name), top n."""
    if top_n <= 0:
        raise ValueError("top_n must be a positive integer.")
    g = long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_shap"))
    return g.orderBy(F.col("mean_abs_shap").desc(), F.col("feature")).limit(top_n)


def group_importance(long: DataFrame, group: str, use_absolute_values: bool = True) -> DataFrame:
    """(grp, feature, mean_contribution) rounded to 6 decimals."""
    c = F.abs("contribution") if use_absolute_values else F.col("contribution")
    return (long.where(F.col(group).isNotNull())
            .groupBy(F.col(group).cast("string").alias("grp"), "feature")
            .agg(F.round(F.avg(c), 6).alias("mean_contribution")))


def group_spread(profile: DataFrame, top_n: int = 10) -> DataFrame:
    """max - min of the group means per feature, descending (ties by name)."""
    if top_n <= 0:
        raise ValueError("top_n must be a positive integer.")
    g = profile.groupBy("feature").agg((F.max("mean_contribution") - F.min("mean_contribution"))
                                       .alias("group_spread"))
    return g.orderBy(F.col("group_spread").desc(), F.col("feature")).limit(top_n)


def _readable(c):
    return F.trim(F.regexp_replace(c, "_", " "))


def largest_differences(groups: list[str], means: list[float], k: int, least: float) -> list[tuple]:
    """The first pairs of groups (ga, gb, va, vb, diff), ga < gb, by falling difference
    of their means and then by name: at least the first ``k`` that differ in more
    than the case of names, none below ``least``.

    Groups of one mean stand together. A heap walks over pairs of means from the widest
    inwards, so only about as many pairs as are asked for are looked at; of a pair of
    means the first ``k`` names on both sides are enough.
    """
    by_mean: dict[float, list[str]] = {}
    for g, v in sorted(zip(groups, means)):
        by_mean.setdefault(v, []).append(g)
    values = sorted(by_mean)

    def first(items: list, key) -> list:
        """Items up to the k-th (k + 1 for names) that differs in more than case."""
        kept, known = [], set()
        for x in items:
            known.add(key(x))
            if len(known) > k + (key is str.lower):
                break
            kept.append(x)
        return kept
    names = [first(by_mean[v], str.lower) for v in values]
    heap = [(-(values[-1] - values[0]), 0, len(values) - 1)] if values else []
    seen = {(0, len(values) - 1)}
    out: list[tuple] = []
    texts: set = set()
    while heap and -heap[0][0] >= least:
        if len(texts) >= k and -heap[0][0] < out[-1][4]:
            break
        d, i, j = heapq.heappop(heap)
        pairs = sorted({(min(a, b), max(a, b)): a < b for a in names[i] for b in names[j] if a != b}.items())
        for (a, b), up in first(pairs, lambda x: (x[0][0].lower(), x[0][1].lower())):
            out.append((a, b, *((values[i], values[j]) if up else (values[j], values[i])), -d))
            texts.add((a.lower(), b.lower()))
        for x in ((i + 1, j), (i, j - 1)):
            if x[0] <= x[1] and x not in seen:
                seen.add(x)
                heapq.heappush(heap, (-(values[x[1]] - values[x[0]]), *x))
    return out


def pairwise_insights(profile: DataFrame, top_n: int = 5, difference_threshold: float = 0.05) -> DataFrame:
    """Plain-language insights for group pairs whose means differ by at least
    the threshold: (rank, insight), largest difference first, case-
    insensitive duplicates dropped, at most ``top_n``; a fallback sentence
    when none qualifies.

    Each feature gives its first pairs by difference (``largest_differences``),
    about ``top_n`` of them, so the work grows with the groups and not with their
    pairs; the best of all features are among them.
    """
    if top_n <= 0:
        raise ValueError("top_n must be a positive integer.")
    if difference_threshold < 0:
        raise ValueError("difference_threshold must be non-negative.")

    def first(part: pd.DataFrame) -> pd.DataFrame:
        part = part.dropna()
        found = largest_differences(part["grp"].tolist(), part["mean_contribution"].tolist(), top_n, difference_threshold)
        rows = pd.DataFrame(found, columns=["ga", "gb", "va", "vb", "diff"])
        rows.insert(0, "feature", part["feature"].iloc[0] if len(part) else None)
        return rows
    ship_package(profile.sparkSession)
    p = (profile.select("feature", F.col("grp").cast("string").alias("grp"), F.col("mean_contribution").cast("double").alias("mean_contribution"))
         .groupBy("feature").applyInPandas(first, "feature string, ga string, gb string, va double, vb double, diff double"))
    f = _readable(F.col("feature"))
    va, vb, ga, gb = F.col("va"), F.col("vb"), F.col("ga"), F.col("gb")
    strong = F.when(F.abs(va) > F.abs(vb), ga).otherwise(gb)
    weak = F.when(F.abs(va) > F.abs(vb), gb).otherwise(ga)
    sentence = (F.when((va < 0) & (vb < 0),
                       F.concat(f, F.lit(" has a higher negative impact on "), strong,
                                F.lit(" candidates than on "), weak, F.lit(" candidates.")))
                .when((va >= 0) & (vb >= 0),
                      F.concat(f, F.lit(" influences "), strong, F.lit(" candidates more strongly than "),
                               weak, F.lit(" candidates.")))
                .when(va < vb,
                      F.concat(f, F.lit(" has a more negative effect on "), ga, F.lit(" candidates than on "),
                               gb, F.lit(" candidates.")))
                .otherwise(F.concat(f, F.lit(" has a more negative effect on "), gb,
                                    F.lit(" candidates than on "), ga, F.lit(" candidates."))))
    s = p.select("feature", "ga", "gb", "diff", sentence.alias("insight"))
    order = [F.col("diff").desc(), F.col("feature"), F.col("ga"), F.col("gb")]
    wd = Window.partitionBy(F.lower("insight")).orderBy(*order)
    first = s.withColumn("_d", F.row_number().over(wd)).where("_d = 1").drop("_d")
    top = first.orderBy(*order).limit(top_n)
    ranked = top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "insight")
    fallback = profile.sparkSession.range(1).select(F.lit(1).alias("rank"), F.lit(NO_INSIGHT).alias("insight"))
    have = ranked.limit(1).count()
    return ranked if have else fallback
