"""Fairness and model-quality metrics derived from the confusion cube.

Every function here is a second-stage aggregate over a table of at most
``slices x groups x labels^2`` rows; none re-reads the input rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import (drop_all, fairness_score, keys_of, r6, rate0, ratio)
from ..functions.labels import is_pos, window_positive_label
from .cube import as_list, binarized_confusion, confusion_cube, outcome_cube

FAIRNESS_COLS = ["demographic_parity_difference", "equalized_odds_difference",
                 "disparate_impact_ratio"]


# --------------------------------------------------------------------------
# per-group rates and the fairness bundle
# --------------------------------------------------------------------------

def group_rates(conf: DataFrame) -> DataFrame:
    """Adds selection_rate, tpr, fpr (zero-division -> 0) to a confusion table."""
    return conf.select(
        "*",
        ratio(F.col("tp") + F.col("fp"), F.col("n")).alias("selection_rate"),
        rate0(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"),
        rate0(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
    )


def fairness_from_confusion(conf: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., attr, n_groups, n, dp, eo, di) from per-group confusion rows."""
    r = group_rates(conf)
    sr, tpr, fpr = F.col("selection_rate"), F.col("tpr"), F.col("fpr")
    a = r.groupBy(*keys, "attr").agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n"),
        F.max(sr).alias("_smax"), F.min(sr).alias("_smin"),
        (F.max(tpr) - F.min(tpr)).alias("_tgap"), (F.max(fpr) - F.min(fpr)).alias("_fgap"),
        F.sum(F.col("tp") + F.col("fp")).alias("n_pred_pos"),
        F.min("n").alias("_nmin"), F.max("n").alias("_nmax"),
        *[F.sum(c).alias(f"{c}_all") for c in ("tp", "fp", "fn", "tn")],
    )
    return a.select(
        *keys, "attr", "n_groups", "n", "tp_all", "fp_all", "fn_all", "tn_all",
        # group shares (null group kept) come from the same cube
        F.when((F.col("n_groups") >= 2) & (F.col("_nmax") > 0),
               ratio(F.col("_nmin"), F.col("_nmax"))).alias("imbalance_ratio"),
        (F.col("_smax") - F.col("_smin")).alias("demographic_parity_difference"),
        F.greatest(F.col("_tgap"), F.col("_fgap")).alias("equalized_odds_difference"),
        F.when(F.col("_smax") == 0, F.lit(1.0))
         .otherwise(ratio(F.col("_smin"), F.col("_smax"))).alias("disparate_impact_ratio"),
        ratio(F.col("n_pred_pos"), F.col("n")).alias("predicted_positive_rate"),
    )


def confusion(df: DataFrame, y_true="y_true", y_pred="y_pred", attrs="grp",
              slice_cols=(), pos_label=None) -> DataFrame:
    keys = keys_of(slice_cols)
    return binarized_confusion(confusion_cube(df, y_true, y_pred, attrs, slice_cols), keys, pos_label)


def fairness_metrics(df: DataFrame, y_true="y_true", y_pred="y_pred", attrs="grp",
                     slice_cols=(), pos_label=None, rounded: bool = True) -> DataFrame:
    """One row per (slice, attr): DP difference, EO difference, DI ratio."""
    keys = keys_of(slice_cols)
    out = fairness_from_confusion(confusion(df, y_true, y_pred, attrs, slice_cols, pos_label), keys)
    if rounded:
        out = out.select(*keys, "attr", "n_groups", "n",
                         *[r6(F.col(c)).alias(c) for c in FAIRNESS_COLS + ["predicted_positive_rate"]])
    else:
        out = out.drop("tp_all", "fp_all", "fn_all", "tn_all")
    return drop_all(out, slice_cols)


def predicted_selection_rate(df: DataFrame, y_true="y_true", y_pred="y_pred", attrs="grp",
                             slice_cols=(), pos_label=None) -> DataFrame:
    keys = keys_of(slice_cols)
    r = group_rates(confusion(df, y_true, y_pred, attrs, slice_cols, pos_label))
    out = r.select(*keys, "attr", "grp", "n", r6(F.col("selection_rate")).alias("selection_rate"),
                   r6(F.col("tpr")).alias("tpr"), r6(F.col("fpr")).alias("fpr"))
    return drop_all(out, slice_cols)


# --------------------------------------------------------------------------
# raw-data audit: distribution, shares, observed selection rate
# --------------------------------------------------------------------------

def observed_outcomes(df: DataFrame, target: str, attrs, slice_cols=(), pos_label=None,
                      fill_missing_group: str | None = "Unknown") -> DataFrame:
    """(keys..., attr, grp, n, n_selected) with null target counted as not selected."""
    keys = keys_of(slice_cols)
    cube = outcome_cube(df, target, attrs, slice_cols, unknown=fill_missing_group)
    if pos_label is None:
        dt = cube.schema["y"].dataType
        c = cube.withColumn("pos_label", window_positive_label(F.col("y"), None, keys, dt, "audit"))
        p = F.col("pos_label")
    else:
        c, p = cube, F.lit(pos_label)
    return c.groupBy(*keys, "attr", "grp").agg(
        F.sum("n").alias("n"), F.sum(is_pos(F.col("y"), p) * F.col("n")).alias("n_selected"))


def group_distribution(df: DataFrame, attrs, slice_cols=(), fill_missing_group="Unknown") -> DataFrame:
    """Count per group; null group -> ``Unknown``."""
    from .cube import with_groups
    from ..functions.exprs import with_all
    keys = keys_of(slice_cols)
    d = with_all(df, slice_cols).select(*keys, *as_list(attrs))
    g = with_groups(d, attrs, keys, unknown=fill_missing_group)
    out = g.groupBy(*keys, "attr", "grp").agg(F.count(F.lit(1)).alias("n"))
    return drop_all(out, slice_cols)


def group_share(df: DataFrame, attrs, slice_cols=()) -> DataFrame:
    """Normalised share per group; null stays its own (null) group."""
    from .cube import with_groups
    from ..functions.exprs import with_all
    keys = keys_of(slice_cols)
    d = with_all(df, slice_cols).select(*keys, *as_list(attrs))
    g = with_groups(d, attrs, keys)
    cnt = g.groupBy(*keys, "attr", "grp").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys, "attr")
    out = cnt.select(*keys, "attr", "grp", "n",
                     r6(ratio(F.col("n"), F.sum("n").over(w))).alias("share"))
    return drop_all(out, slice_cols)


def observed_selection_rate(df: DataFrame, target: str, attrs, slice_cols=(), pos_label=None,
                            fill_missing_group="Unknown") -> DataFrame:
    keys = keys_of(slice_cols)
    o = observed_outcomes(df, target, attrs, slice_cols, pos_label, fill_missing_group)
    out = o.select(*keys, "attr", "grp", "n",
                   r6(ratio(F.col("n_selected"), F.col("n"))).alias("selection_rate"))
    return drop_all(out, slice_cols)


def distribution_summary(df: DataFrame, target: str, attrs, slice_cols=(), pos_label=None) -> DataFrame:
    """Per (slice, attr): imbalance ratio (min/max count), selection-rate gap."""
    keys = keys_of(slice_cols)
    o = observed_outcomes(df, target, attrs, slice_cols, pos_label, "Unknown")
    o = o.select("*", F.round(ratio(F.col("n_selected"), F.col("n")), 6).alias("sr"))
    a = o.groupBy(*keys, "attr").agg(
        F.count(F.lit(1)).alias("n_groups"), F.min("n").alias("_nmin"), F.max("n").alias("_nmax"),
        F.min("sr").alias("_smin"), F.max("sr").alias("_smax"),
        F.count("sr").alias("_nsr"))
    out = a.select(
        *keys, "attr", "n_groups",
        F.when((F.col("n_groups") >= 2) & (F.col("_nmax") > 0),
               ratio(F.col("_nmin"), F.col("_nmax"))).alias("imbalance_ratio"),
        F.when(F.col("_nsr") >= 2, F.col("_smax") - F.col("_smin")).alias("selection_rate_gap"),
    )
    return out


def group_imbalance_ratio(df: DataFrame, attrs, slice_cols=(), target: str | None = None) -> DataFrame:
    """min/max group count per (slice, attr); null when < 2 groups."""
    keys = keys_of(slice_cols)
    dist = group_distribution(df, attrs, slice_cols)
    d = dist if slice_cols else dist.withColumn(keys[0], F.lit(0))
    a = d.groupBy(*keys, "attr").agg(F.count(F.lit(1)).alias("n_groups"),
                                     F.min("n").alias("_mn"), F.max("n").alias("_mx"))
    out = a.select(*keys, "attr", "n_groups",
                   F.round(F.when((F.col("n_groups") >= 2) & (F.col("_mx") > 0),
                                  ratio(F.col("_mn"), F.col("_mx"))), 6).alias("imbalance_ratio"))
    return drop_all(out, slice_cols)


# --------------------------------------------------------------------------
# model quality
# --------------------------------------------------------------------------

def label_pairs(df: DataFrame, y_true="y_true", y_pred="y_pred", slice_cols=()) -> DataFrame:
    """(keys..., y_true, y_pred, n): counts of label pairs."""
    from ..functions.exprs import with_all
    keys = keys_of(slice_cols)
    d = with_all(df, slice_cols)
    return d.groupBy(*keys, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))


def performance_from_pairs(pairs: DataFrame, keys: list[str], binary: bool = True) -> DataFrame:
    """accuracy, precision, recall from label-pair counts.

    ``binary``: labels are 0/1 and 1 is positive (zero-division -> 0). Else
    support-weighted precision/recall over the classes.
    """
    n, yt, yp = F.col("n"), F.col("y_true"), F.col("y_pred")
    if binary:
        a = pairs.groupBy(*keys).agg(
            F.sum(n).alias("n"),
            F.sum(F.when(yt == yp, n).otherwise(0)).alias("n_correct"),
            F.sum(F.when((yt == 1) & (yp == 1), n).otherwise(0)).alias("tp"),
            F.sum(F.when((yt != 1) & (yp == 1), n).otherwise(0)).alias("fp"),
            F.sum(F.when((yt == 1) & (yp != 1), n).otherwise(0)).alias("fn"))
        return a.select(*keys, "n", ratio(F.col("n_correct"), F.col("n")).alias("accuracy"),
                        rate0(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                        rate0(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    # weighted: per class c: support_c, predicted_c, tp_c
    t = pairs.groupBy(*keys, yt.alias("c")).agg(F.sum(n).alias("support"),
                                                 F.sum(F.when(yt == yp, n).otherwise(0)).alias("tp"))
    p = pairs.groupBy(*keys, yp.alias("c")).agg(F.sum(n).alias("predicted"))
    cls = t.join(p, keys + ["c"], "full")
    cls = cls.select(*keys, "c", F.coalesce("support", F.lit(0)).alias("support"),
                     F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("predicted", F.lit(0)).alias("predicted"))
    a = cls.groupBy(*keys).agg(
        F.sum("support").alias("n"), F.sum("tp").alias("n_correct"),
        F.sum(F.col("support") * rate0(F.col("tp"), F.col("predicted"))).alias("_wp"),
        F.sum(F.col("support") * rate0(F.col("tp"), F.col("support"))).alias("_wr"))
    return a.select(*keys, "n", ratio(F.col("n_correct"), F.col("n")).alias("accuracy"),
                    ratio(F.col("_wp"), F.col("n")).alias("precision"),
                    ratio(F.col("_wr"), F.col("n")).alias("recall"))


def confusion_matrix(df: DataFrame, y_true="y_true", y_pred="y_pred", slice_cols=()) -> DataFrame:
    """Long confusion matrix over all (true, predicted) label pairs, zeros kept.

    The label grid is K x K for the K labels of a slice -- the size of the
    matrix itself, built from the per-slice sorted label array.
    """
    keys = keys_of(slice_cols)
    pairs = label_pairs(df, y_true, y_pred, slice_cols)
    labels = (pairs.select(*keys, F.col("y_true").alias("l"))
              .unionByName(pairs.select(*keys, F.col("y_pred").alias("l")))
              .where(F.col("l").isNotNull())
              .groupBy(*keys).agg(F.sort_array(F.collect_set("l")).alias("ls")))
    grid = (labels.select(*keys, F.posexplode("ls").alias("i", "y_true"), "ls")
            .select(*keys, "i", "y_true", F.posexplode("ls").alias("j", "y_pred")))
    out = grid.join(pairs, keys + ["y_true", "y_pred"], "left").select(
        *keys, "i", "j", "y_true", "y_pred", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))
    return drop_all(out, slice_cols)


def _evaluated(cube: DataFrame, keys: list[str]) -> DataFrame:
    """Fairness and performance per (keys, attr) from one pass over the cube.

    Every cube row gives a row for its group (true and false positives and
    negatives under the positive label of its slice) and one for each of its two labels
    (support, hits, predictions); both kinds are summed by one aggregate and
    reduced by a second one, so the cube is computed once.

    Accuracy counts equal labels. Precision and recall are those of label 1
    when a slice has at most two labels and 1 is among them (or has a single
    label); otherwise they are weighted by class support. A null numeric label
    counts as 0, a null text label as a class of its own.
    """
    dt = cube.select(F.array("y_true", "y_pred").alias("a")).schema["a"].dataType.elementType
    text = isinstance(dt, T.StringType)
    pos = window_positive_label(F.col("y_true").cast(dt), F.col("y_pred").cast(dt), keys, dt, "pair")
    c = cube.withColumn("_pos", pos)
    t, q = is_pos(F.col("y_true"), F.col("_pos")) == 1, is_pos(F.col("y_pred"), F.col("_pos")) == 1
    yt, yp = (F.col(x).cast(dt) for x in ("y_true", "y_pred"))
    if not text:
        yt, yp = (F.coalesce(x.cast("double"), F.lit(0.0)) for x in (yt, yp))
    n, none = F.col("n"), F.lit(0).cast("long")

    def row(grp, label, *sums):
        no_grp, no_label = F.lit(None).cast("string"), F.lit(None).cast(yt_type)
        return F.struct(F.lit(label is None).alias("g"), (no_grp if grp is None else grp).alias("grp"),
                        (no_label if label is None else label).alias("c"), *[x.alias(f"s{i}") for i, x in enumerate(sums)])
    yt_type = "string" if text else "double"
    hit = lambda cond: F.when(cond, n).otherwise(none)
    rows = F.array(row(F.col("grp"), None, n, hit(t & q), hit(~t & q), hit(t & ~q), hit(~t & ~q)),
                   row(None, yt, n, hit(yt.eqNullSafe(yp)), none, none, none),
                   row(None, yp, none, none, n, none, none))
    summed = (c.select(*keys, "attr", F.explode(rows).alias("r")).select(*keys, "attr", "r.*")
              .groupBy(*keys, "attr", "g", "grp", "c").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(5)]))
    s = [F.col(f"s{i}") for i in range(5)]
    one = F.lit(False) if text else F.coalesce(F.col("c") == 1, F.lit(False))
    of_group = lambda x: F.when(F.col("g"), x)
    of_class = lambda x: F.when(~F.col("g"), x)
    tpr, fpr, rate = rate0(s[1], s[1] + s[3]), rate0(s[2], s[2] + s[4]), ratio(s[1] + s[2], s[0])
    a = summed.groupBy(*keys, "attr").agg(
        F.sum(of_group(s[0])).alias("n"), F.sum(of_group(s[1] + s[2])).alias("_pp"),
        F.max(of_group(rate)).alias("_smax"), F.min(of_group(rate)).alias("_smin"),
        (F.max(of_group(tpr)) - F.min(of_group(tpr))).alias("_tgap"), (F.max(of_group(fpr)) - F.min(of_group(fpr))).alias("_fgap"),
        F.sum(of_class(s[1])).alias("_ok"), F.sum(of_class(F.lit(1))).alias("_k"), F.max(of_class(one)).alias("_has"),
        *[F.sum(of_class(F.when(one, s[i]).otherwise(0))).alias(f"_one{i}") for i in range(3)],
        F.sum(of_class(s[0] * rate0(s[1], s[2]))).alias("_wp"), F.sum(of_class(s[0] * rate0(s[1], s[0]))).alias("_wr"))
    binary = (F.col("_k") < 2) | ((F.col("_k") == 2) & F.col("_has"))
    return a.select(
        *keys, "attr", "n", ratio(F.col("_ok"), F.col("n")).alias("accuracy"),
        F.when(binary, rate0(F.col("_one1"), F.col("_one2"))).otherwise(ratio(F.col("_wp"), F.col("n"))).alias("precision"),
        F.when(binary, rate0(F.col("_one1"), F.col("_one0"))).otherwise(ratio(F.col("_wr"), F.col("n"))).alias("recall"),
        (F.col("_smax") - F.col("_smin")).alias("demographic_parity_difference"),
        F.greatest(F.col("_tgap"), F.col("_fgap")).alias("equalized_odds_difference"),
        F.when(F.col("_smax") == 0, F.lit(1.0)).otherwise(ratio(F.col("_smin"), F.col("_smax"))).alias("disparate_impact_ratio"),
        ratio(F.col("_pp"), F.col("n")).alias("predicted_positive_rate"))


def evaluate_predictions(df: DataFrame, y_true="y_true", y_pred="y_pred", attrs="grp",
                         slice_cols=(), model_col: str | None = None, binary: bool = False) -> DataFrame:
    """Performance + fairness per (slice[, model], attr) from one cube.

    ``binary`` states that the labels are 0/1, which saves an exchange; without
    it the labels found in each slice decide.
    """
    sc = list(slice_cols) + ([model_col] if model_col else [])
    keys = keys_of(sc)
    cube = confusion_cube(df, y_true, y_pred, attrs, sc)
    if binary:
        fair = fairness_from_confusion(binarized_confusion(cube, keys), keys)
        # accuracy, precision and recall follow from the binarised totals of
        # the same aggregate -- no second branch, no join
        tp, fp, fn, tn = (F.col(f"{c}_all") for c in ("tp", "fp", "fn", "tn"))
        j = fair.select("*", ratio(tp + tn, F.col("n")).alias("accuracy"),
                        rate0(tp, tp + fp).alias("precision"), rate0(tp, tp + fn).alias("recall"))
    else:
        j = _evaluated(cube, keys)
    out = j.select(
        *keys, "attr", "n",
        r6(F.col("accuracy")).alias("accuracy"), r6(F.col("precision")).alias("precision"),
        r6(F.col("recall")).alias("recall"),
        *[r6(F.col(c)).alias(c) for c in FAIRNESS_COLS],
        fairness_score(F.col("demographic_parity_difference"), F.col("equalized_odds_difference"),
                       F.col("disparate_impact_ratio")).alias("fairness_score"),
        r6(F.col("predicted_positive_rate")).alias("predicted_positive_rate"),
    )
    return drop_all(out, sc)


def models_long(df: DataFrame, preds: dict[str, str], keep: list[str], y_pred_name="y_pred") -> DataFrame:
    """Unpivot several prediction columns into (model, y_pred)."""
    wide = df.select(*keep, *[F.col(c).alias(m) for m, c in preds.items()])
    return wide.unpivot(keep, list(preds), "model", y_pred_name)


METRICS6 = ["accuracy", "precision", "recall"] + FAIRNESS_COLS


def compare_models(df: DataFrame, baseline: str, mitigated: str, y_true="y_true", attrs="grp",
                   slice_cols=()) -> DataFrame:
    """Six deltas mitigated - baseline per (slice, attr), one pass for both models."""
    keep = list(slice_cols) + as_list(attrs) + [y_true]
    long = models_long(df, {"baseline": baseline, "mitigated": mitigated}, keep)
    ev = evaluate_predictions(long, y_true, "y_pred", attrs, slice_cols, model_col="model")
    keys = list(slice_cols)
    aggs = []
    for m in METRICS6:
        b = F.max(F.when(F.col("model") == "baseline", F.col(m)))
        mi = F.max(F.when(F.col("model") == "mitigated", F.col(m)))
        aggs.append(F.round(mi - b, 6).alias(f"{m}_change"))
    return ev.groupBy(*keys, "attr").agg(*aggs)


def metric_comparison_long(df: DataFrame, baseline: str, mitigated: str, y_true="y_true",
                           attrs="grp", slice_cols=()) -> DataFrame:
    """(metric, baseline, mitigated, delta) rows per (slice, attr)."""
    keep = list(slice_cols) + as_list(attrs) + [y_true]
    long = models_long(df, {"baseline": baseline, "mitigated": mitigated}, keep)
    ev = evaluate_predictions(long, y_true, "y_pred", attrs, slice_cols, model_col="model")
    keys = list(slice_cols) + ["attr", "model"]
    metr = ev.select(*keys, *METRICS6).unpivot(keys, METRICS6, "metric", "value")
    g = metr.groupBy(*[k for k in keys if k != "model"], "metric").agg(
        F.max(F.when(F.col("model") == "baseline", F.col("value"))).alias("baseline"),
        F.max(F.when(F.col("model") == "mitigated", F.col("value"))).alias("mitigated"))
    return g.withColumn("delta", F.round(F.col("mitigated") - F.col("baseline"), 6))


def delta_table(df: DataFrame, baseline: str, mitigated: str, y_true="y_true", attrs="grp",
                slice_cols=()) -> DataFrame:
    """(metric, change) rows from the six deltas."""
    c = compare_models(df, baseline, mitigated, y_true, attrs, slice_cols)
    keys = list(slice_cols) + ["attr"]
    cols = [f"{m}_change" for m in METRICS6]
    return c.unpivot(keys, cols, "metric", "change")


def collapse_flags(fair: DataFrame) -> DataFrame:
    """Warnings on a fairness table: predicted positive rate below 2 %, and
    every group with a zero selection rate (no predicted positives at all)."""
    ppr = F.col("predicted_positive_rate")
    return fair.select(
        *[c for c in fair.columns if c not in FAIRNESS_COLS + ["predicted_positive_rate", "n", "n_groups",
                                                               "imbalance_ratio"]],
        r6(ppr).alias("predicted_positive_rate"),
        (ppr < 0.02).alias("low_positive_rate"),
        (ppr == 0).alias("all_zero_selection"))


def named_pair_di(df: DataFrame, group: str, outcome: str, a: str, b: str) -> DataFrame:
    """rate(a) / rate(b) for two named groups; +inf when rate(b) is 0."""
    g, y = F.col(group), F.col(outcome)
    r = df.agg(F.avg(F.when(g == a, y)).alias("a"), F.avg(F.when(g == b, y)).alias("b"))
    return r.select(r6(F.col("a")).alias("rate_a"), r6(F.col("b")).alias("rate_b"),
                    F.when(F.col("b") > 0, r6(F.col("a") / F.col("b")))
                     .otherwise(F.lit(float("inf"))).alias("di_ratio"))
