"""Mitigation (§2.8) jobs that need no model: weights, resampling, group
ROC and per-group thresholds.

Each job reduces the rows to a small table -- (slice, group, label) counts or
(group, score bucket) counts -- decides there, and, where rows need the
decision, joins it back with a size-checked broadcast. No group is ever
gathered into one task, so a group holding a third of the rows costs the
same as any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import keys_of, ratio, with_all, drop_all
from ..session import bounded_broadcast, materialize, reuse
from .prepare import hash_cuts, hash_order
from .ranking import prefix_before

BUCKETS = 1000  # score resolution of the ROC: thresholds b / 1000


# --------------------------------------------------------------------------
# weights
# --------------------------------------------------------------------------

def reweigh_table(df: DataFrame, group: str, label: str, slice_cols=()) -> DataFrame:
    """(keys..., grp, y, n, weight) with weight = P(A) P(Y) / P(A, Y); null is a
    group and a label of its own."""
    keys = keys_of(slice_cols)
    d = with_all(df, slice_cols)
    joint = d.groupBy(*keys, F.col(group).alias("grp"), F.col(label).alias("y")).agg(
        F.count(F.lit(1)).alias("n"))
    wk = Window.partitionBy(*keys)
    wa = Window.partitionBy(*keys, "grp")
    wy = Window.partitionBy(*keys, "y")
    # windows over the joint-count table: (slices x groups x labels) rows
    return joint.select(*keys, "grp", "y", "n",
                        (F.sum("n").over(wa).cast("double") * F.sum("n").over(wy)
                         / (F.sum("n").over(wk) * F.col("n"))).alias("weight"))


def reweigh(df: DataFrame, group: str, label: str, slice_cols=(), out: str = "sample_weight") -> DataFrame:
    """Rows with their reweighing weight (broadcast join of the weight table)."""
    keys = keys_of(slice_cols)
    d = with_all(df, slice_cols)
    wt, _ = bounded_broadcast(reweigh_table(df, group, label, slice_cols)
                              .select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                                      F.col("grp").alias("_g"), F.col("y").alias("_y"),
                                      F.col("weight").alias(out)))
    cond = None
    for k in keys:
        c = d[k].eqNullSafe(wt[f"_k_{k}"])
        cond = c if cond is None else cond & c
    cond = cond & d[group].eqNullSafe(wt["_g"]) & d[label].eqNullSafe(wt["_y"])
    j = d.join(wt, cond, "left").drop("_g", "_y", *[f"_k_{k}" for k in keys])
    return drop_all(j.withColumn(out, F.coalesce(F.col(out), F.lit(1.0))), slice_cols)


def weighted_rates(df: DataFrame, group: str, label: str, weight: str) -> DataFrame:
    """(grp, n, weighted_rate) = sum(w * y) / sum(w) per group."""
    return df.groupBy(F.col(group).alias("grp")).agg(
        F.count(F.lit(1)).alias("n"),
        ratio(F.sum(F.col(weight) * F.col(label)), F.sum(weight)).alias("weighted_rate"))


def class_weight_table(df: DataFrame, label: str) -> DataFrame:
    """'balanced' class weights n / (k * n_c): (y, n, class_weight)."""
    c = df.groupBy(F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0))  # over the k-row class table
    return c.select("y", "n", (F.sum("n").over(w).cast("double")
                               / (F.count(F.lit(1)).over(w) * F.col("n"))).alias("class_weight"))


def with_class_weights(df: DataFrame, label: str, sample_weight: str | None = None,
                       out: str = "weight") -> DataFrame:
    """Row weight = balanced class weight x sample weight (if given)."""
    cw, _ = bounded_broadcast(class_weight_table(df, label).select(F.col("y").alias("_y"), "class_weight"))
    j = df.join(cw, df[label].eqNullSafe(cw["_y"]), "left").drop("_y")
    w = F.col("class_weight") * (F.col(sample_weight) if sample_weight else F.lit(1.0))
    return j.withColumn(out, w).drop("class_weight")


# --------------------------------------------------------------------------
# resampling
# --------------------------------------------------------------------------

def resample(df: DataFrame, group: str, label: str, key: str, seed: int = 42,
             mode: str = "balance") -> DataFrame:
    """Re-sample rows so every (group, label) cell has the count it would
    have if group and label were independent: t = round(n_a * n_y / n).

    Each row is copied ``t // m`` times (m = cell count) and the first
    ``t % m`` rows of the cell in hash order once more -- over-sampling
    replicates, under-sampling keeps a hash-ordered prefix. ``mode='none'``
    returns the rows unchanged (the reference's behaviour).
    """
    if mode == "none":
        return df
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
    tgt = reweigh_table(df, group, label).select(
        F.col("grp").alias("_ga"), F.col("y").alias("_ya"), F.col("n").alias("_m"),
        # integer target: round(n * weight) = round(n_a * n_y / n), half up
        ((2 * F.col("n") * F.col("weight") + 1) / 2).cast("long").alias("_t_raw"))
    tgt = materialize(tgt.withColumn("_cls", F.concat_ws("\u0001", text("_ga"), text("_ya"))))    # a row per cell
    h = hash_order(F.col(key), seed)
    rows = df.select(F.concat_ws("\u0001", text(group), text(label)).alias("_cls"), h.alias("_h"))
    cuts = hash_cuts(rows, tgt.select("_cls", (F.col("_t_raw") % F.col("_m")).alias("_want")))
    plan, _ = bounded_broadcast(tgt.join(cuts, "_cls", "left").drop("_cls"))
    j = df.join(plan, df[group].eqNullSafe(plan["_ga"]) & df[label].eqNullSafe(plan["_ya"]))
    extra = F.coalesce((h <= F.col("_cut")).cast("int"), F.lit(0))
    copies = (F.floor(F.col("_t_raw") / F.col("_m")) + extra).cast("int")
    out = j.withColumn("_copies", copies).where(F.col("_copies") > 0)
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.drop("_ga", "_ya", "_m", "_t_raw", "_cut", "_copies")


def resample_target_counts(n_a: int, n_y: int, n: int) -> int:
    """round(n_a * n_y / n), half up, in integers."""
    return (2 * n_a * n_y + n) // (2 * n)


# --------------------------------------------------------------------------
# group ROC and thresholds
# --------------------------------------------------------------------------

def bucket(score_col: str) -> F.Column:
    """Score in [0, 1] -> integer bucket 0..BUCKETS (threshold b / BUCKETS)."""
    return F.least(F.greatest(F.floor(F.col(score_col) * BUCKETS), F.lit(0)), F.lit(BUCKETS)).cast("int")


def group_roc(df: DataFrame, score: str, label: str, group: str) -> DataFrame:
    """Per group and threshold bucket b (predict 1 iff bucket(score) >= b):
    (grp, b, tp, fp, n_pos, n_neg, n, tpr, fpr, selection_rate, correct).

    Rows -> (group, bucket) counts (partial aggregation), then cumulative
    sums from the top bucket with a window partitioned by group over at most
    BUCKETS + 2 rows. A sentinel bucket BUCKETS + 1 selects nobody. A null
    group is 'Unknown'.
    """
    y = F.col(label)
    cnt = df.groupBy(_group_text(group).alias("grp"), bucket(score).alias("b")).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(y == 1, 0).otherwise(1)).alias("neg"))
    # every (group, bucket) level, so each group has the full threshold grid
    levels = (cnt.groupBy("grp").agg(F.lit(1).alias("_one"))
              .select("grp", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS + 1))).alias("b")))
    c = levels.join(cnt, ["grp", "b"], "left").fillna(0, ["pos", "neg"])
    w = Window.partitionBy("grp").orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, 0)
    wt = Window.partitionBy("grp")
    r = c.select("grp", "b", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
                 F.sum("pos").over(wt).alias("n_pos"), F.sum("neg").over(wt).alias("n_neg"))
    P, N = F.col("n_pos"), F.col("n_neg")
    return r.select(
        "grp", "b", "tp", "fp", "n_pos", "n_neg", (P + N).alias("n"),
        F.coalesce(ratio(F.col("tp"), P), F.lit(0.0)).alias("tpr"),
        F.coalesce(ratio(F.col("fp"), N), F.lit(0.0)).alias("fpr"),
        ratio(F.col("tp") + F.col("fp"), P + N).alias("selection_rate"),
        (F.col("tp") + N - F.col("fp")).alias("correct"))


def threshold_parity(roc: DataFrame, grid: int = BUCKETS) -> DataFrame:
    """Demographic-parity thresholds: for every target rate x = i / grid,
    each group takes the highest threshold whose selection rate is >= x; the
    x with the most correct predictions overall wins (ties: smallest x).

    Bucket b serves the targets in (rate(b+1), rate(b)], so each
    (group, target) pair is produced once: groups x (grid + 1) rows.
    """
    roc = reuse(roc)  # groups x (BUCKETS + 2) rows, read three times below
    w = Window.partitionBy("grp").orderBy("b")
    r = roc.select("grp", "b", "selection_rate", "correct", "n",
                   F.lead("selection_rate").over(w).alias("next_rate"))
    lo = F.when(F.col("next_rate").isNull(), F.lit(0)).otherwise(
        F.floor(F.col("next_rate") * grid + 1e-9).cast("int") + 1)
    hi = F.floor(F.col("selection_rate") * grid + 1e-9).cast("int")
    served = (r.where(hi >= lo)
              .select("grp", "b", "selection_rate", "correct", "n",
                      F.explode(F.sequence(lo, hi)).alias("i")))
    total = served.groupBy("i").agg(F.sum("correct").alias("correct_total"),
                                    F.count(F.lit(1)).alias("k"), F.sum("n").alias("n_total"))
    n_groups = roc.select("grp").distinct().count()
    best = (total.where(F.col("k") == n_groups)
            .orderBy(F.col("correct_total").desc(), F.col("i").asc()).limit(1))
    pick = served.join(best.select("i", "correct_total", "n_total"), "i")
    return pick.select("grp", (F.col("b") / F.lit(float(BUCKETS))).alias("threshold"), "b",
                       F.round("selection_rate", 6).alias("selection_rate"),
                       (F.col("i") / F.lit(float(grid))).alias("target_rate"),
                       F.round(ratio(F.col("correct_total"), F.col("n_total")), 6).alias("accuracy"))


def threshold_equalized_odds(roc: DataFrame, grid: int = BUCKETS, max_gap: float = 0.05) -> DataFrame:
    """Equalized-odds thresholds (deterministic form): for every target FPR
    f = i / grid each group takes the highest threshold with FPR >= f. Among
    the levels whose equalized-odds gap (max of the TPR and FPR spreads) is
    within ``max_gap`` the most accurate wins; if none is, the smallest gap
    (ties: smaller f)."""
    roc = reuse(roc)
    w = Window.partitionBy("grp").orderBy("b")
    r = roc.select("grp", "b", "tpr", "fpr", "correct", "n", F.lead("fpr").over(w).alias("next_fpr"))
    lo = F.when(F.col("next_fpr").isNull(), F.lit(0)).otherwise(
        F.floor(F.col("next_fpr") * grid + 1e-9).cast("int") + 1)
    hi = F.floor(F.col("fpr") * grid + 1e-9).cast("int")
    served = r.where(hi >= lo).select("grp", "b", "tpr", "fpr", "correct", "n",
                                      F.explode(F.sequence(lo, hi)).alias("i"))
    n_groups = roc.select("grp").distinct().count()
    total = served.groupBy("i").agg(
        F.count(F.lit(1)).alias("k"),
        F.greatest(F.max("tpr") - F.min("tpr"), F.max("fpr") - F.min("fpr")).alias("eo_gap"),
        (F.sum("correct") / F.sum("n")).alias("accuracy"))
    ok = F.col("eo_gap") <= max_gap
    best = (total.where(F.col("k") == n_groups)
            .orderBy(ok.desc(), F.when(ok, -F.col("accuracy")).otherwise(F.col("eo_gap")).asc(),
                     F.col("i").asc()).limit(1))
    pick = served.join(best.select("i", "eo_gap", "accuracy"), "i")
    return pick.select("grp", (F.col("b") / F.lit(float(BUCKETS))).alias("threshold"), "b",
                       F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"),
                       F.round("eo_gap", 6).alias("eo_gap"), F.round("accuracy", 6).alias("accuracy"))


def apply_group_threshold(df: DataFrame, thresholds: DataFrame, score: str, group: str,
                          out: str = "y_pred") -> DataFrame:
    """Predict 1 iff the score's bucket reaches the row's group threshold
    (size-checked broadcast of the per-group table)."""
    t, _ = bounded_broadcast(thresholds.select(F.col("grp").alias("_g"), F.col("b").alias("_b")))
    j = df.join(t, _group_text(group) == t["_g"], "left")
    return j.withColumn(out, F.coalesce((bucket(score) >= F.col("_b")).cast("int"), F.lit(0))).drop("_g", "_b")


# --------------------------------------------------------------------------
# thresholds at the scores themselves, without levels
# --------------------------------------------------------------------------

NO_GROUP = "Unknown"


def _group_text(group: str) -> F.Column:
    return F.coalesce(F.col(group).cast("string"), F.lit(NO_GROUP))


def _clean_score(score: str) -> F.Column:
    return F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))


def group_roc_exact(df: DataFrame, score: str, label: str, group: str) -> DataFrame:
    """Per group and distinct score s (predict 1 iff score >= s): (grp,
    threshold, tp, fp, n_pos, n_neg, n, tpr, fpr, selection_rate, correct)
    and, as ``next_rate`` and ``next_fpr``, the rates of the next higher
    threshold (null on the top row of a group, threshold +infinity, which
    selects nobody).

    Rows -> (group, score) counts, then a distributed prefix sum, so a group
    with a third of all scores is spread over many tasks. A row without a score
    counts in ``n`` and is never selected; a null group is 'Unknown'.
    """
    y = F.col(label)
    hist = df.groupBy(_group_text(group).alias("grp"), _clean_score(score).alias("threshold")).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(y == 1, 0).otherwise(1)).alias("neg"))
    pre = prefix_before(hist, ["grp"], "threshold", ["pos", "neg"])   # nulls sort first
    total, _ = bounded_broadcast(hist.groupBy("grp").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")))
    top = total.select("grp", F.lit(float("inf")).alias("threshold"), "n_pos", "n_neg", F.lit(0).cast("long").alias("tp"),
                       F.lit(0).cast("long").alias("fp"), F.lit(None).cast("long").alias("next_tp"), F.lit(None).cast("long").alias("next_fp"))
    at = pre.where(F.col("threshold").isNotNull()).join(total, "grp").select(
        "grp", "threshold", "n_pos", "n_neg",
        (F.col("n_pos") - F.col("pos_before")).alias("tp"), (F.col("n_neg") - F.col("neg_before")).alias("fp"),
        (F.col("n_pos") - F.col("pos_before") - F.col("pos")).alias("next_tp"),
        (F.col("n_neg") - F.col("neg_before") - F.col("neg")).alias("next_fp"))
    P, N = F.col("n_pos"), F.col("n_neg")
    return at.unionByName(top).select(
        "grp", "threshold", "tp", "fp", "n_pos", "n_neg", (P + N).alias("n"),
        F.coalesce(ratio(F.col("tp"), P), F.lit(0.0)).alias("tpr"),
        F.coalesce(ratio(F.col("fp"), N), F.lit(0.0)).alias("fpr"),
        ratio(F.col("tp") + F.col("fp"), P + N).alias("selection_rate"),
        (F.col("tp") + N - F.col("fp")).alias("correct"),
        ratio(F.col("next_tp") + F.col("next_fp"), P + N).alias("next_rate"),
        F.when(F.col("next_fp").isNotNull(), F.coalesce(ratio(F.col("next_fp"), N), F.lit(0.0))).alias("next_fpr"))


def _serving(roc: DataFrame, rate: str, next_rate: str, grid: int) -> DataFrame:
    """The highest threshold of each group that reaches target rate i / grid,
    for every i: at most groups x (grid + 1) rows, checkpointed."""
    lo = F.when(F.col(next_rate).isNull(), F.lit(0)).otherwise(
        F.floor(F.col(next_rate) * grid + 1e-9).cast("int") + 1)
    hi = F.floor(F.col(rate) * grid + 1e-9).cast("int")
    return materialize(roc.where(hi >= lo).withColumn("i", F.explode(F.sequence(lo, hi))))


def threshold_parity_exact(roc: DataFrame, grid: int = BUCKETS) -> DataFrame:
    """``threshold_parity`` over the scores of ``group_roc_exact``."""
    served = _serving(roc, "selection_rate", "next_rate", grid)
    n_groups = served.where(F.col("i") == 0).count()       # every group serves target 0 once
    best = (served.groupBy("i").agg(F.sum("correct").alias("ct"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("nt"))
            .where(F.col("k") == n_groups).orderBy(F.col("ct").desc(), F.col("i").asc()).limit(1))
    return served.join(best, "i").select(
        "grp", "threshold", F.round("selection_rate", 6).alias("selection_rate"),
        (F.col("i") / F.lit(float(grid))).alias("target_rate"), F.round(ratio(F.col("ct"), F.col("nt")), 6).alias("accuracy"))


def threshold_equalized_odds_exact(roc: DataFrame, grid: int = BUCKETS, max_gap: float = 0.05) -> DataFrame:
    """``threshold_equalized_odds`` over the scores of ``group_roc_exact``."""
    served = _serving(roc, "fpr", "next_fpr", grid)
    n_groups = served.where(F.col("i") == 0).count()
    gap, acc = F.col("eo_gap"), F.col("accuracy")
    best = (served.groupBy("i").agg(
        F.count(F.lit(1)).alias("k"),
        F.greatest(F.max("tpr") - F.min("tpr"), F.max("fpr") - F.min("fpr")).alias("eo_gap"),
        ratio(F.sum("correct"), F.sum("n")).alias("accuracy"))
        .where(F.col("k") == n_groups)
        .orderBy((gap <= max_gap).desc(), F.when(gap <= max_gap, -acc).otherwise(gap).asc(), F.col("i").asc()).limit(1))
    return served.join(best, "i").select(
        "grp", "threshold", *[F.round(c, 6).alias(c) for c in ("tpr", "fpr", "eo_gap", "accuracy")])


def apply_group_threshold_exact(df: DataFrame, thresholds: DataFrame, score: str, group: str,
                                out: str = "y_pred") -> DataFrame:
    """Predict 1 iff the score reaches the threshold of the row's group; 0
    without a score or for a group that has no threshold."""
    t, _ = bounded_broadcast(thresholds.select(F.col("grp").alias("_g"), F.col("threshold").alias("_t")))
    j = df.join(t, _group_text(group) == F.col("_g"), "left")
    return j.withColumn(out, F.coalesce((_clean_score(score) >= F.col("_t")).cast("int"), F.lit(0))).drop("_g", "_t")
