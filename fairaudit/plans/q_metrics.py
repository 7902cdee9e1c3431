"""Queries for §2.4 (distribution and fairness) and §2.5 (model quality)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import bin_column, r6
from ..operators import metrics as M
from ..sources.tables import order_audit, doc_audit, part_audit
from .registry import register
from .views_sql import with_views

# ---------------------------------------------------------------- SQL pieces
# per-region confusion counts on order_audit (y_true, y_pred are 0/1)
_CONF = """
, conf AS (
  SELECT region AS grp, CAST(count(*) AS BIGINT) AS n,
         CAST(sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
         CAST(sum(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM order_audit GROUP BY region
), rates AS (
  SELECT *, CAST(tp + fp AS DOUBLE) / n AS sr,
         coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS tpr,
         coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0) AS fpr
  FROM conf
), fair AS (
  SELECT CAST(count(*) AS BIGINT) AS n_groups, CAST(sum(n) AS BIGINT) AS n,
         max(sr) - min(sr) AS dp,
         greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) AS eo,
         CASE WHEN max(sr) = 0 THEN 1.0 ELSE min(sr) / max(sr) END AS di,
         CAST(sum(tp + fp) AS DOUBLE) / sum(n) AS ppr
  FROM rates
)
"""


def _oa(spark, d):
    return order_audit(spark, d)


@register("group_confusion", with_views(_CONF + """
SELECT 'region' AS attr, grp, n, tp, fp, fn, tn FROM conf""", "order_audit"))
def q_group_confusion(spark, d):
    from ..operators.cube import group_confusion
    return group_confusion(_oa(spark, d), attrs="region")


@register("fairness_metrics", with_views(_CONF + """
SELECT 'region' AS attr, n_groups, n, round(dp, 6) AS demographic_parity_difference,
       round(eo, 6) AS equalized_odds_difference, round(di, 6) AS disparate_impact_ratio,
       round(ppr, 6) AS predicted_positive_rate
FROM fair""", "order_audit"))
def q_fairness_metrics(spark, d):
    return M.fairness_metrics(_oa(spark, d), attrs="region")


@register("fairness_metrics_sliced", with_views("""
, long AS (
  SELECT period, 'region' AS attr, region AS grp, y_true, y_pred FROM order_audit
  UNION ALL SELECT period, 'segment', segment, y_true, y_pred FROM order_audit
), conf AS (
  SELECT period, attr, grp, count(*) AS n,
         sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END) AS fn,
         sum(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END) AS tn
  FROM long GROUP BY period, attr, grp
), rates AS (
  SELECT *, CAST(tp + fp AS DOUBLE) / n AS sr,
         coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS tpr,
         coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0) AS fpr
  FROM conf
)
SELECT period, attr, CAST(count(*) AS BIGINT) AS n_groups, CAST(sum(n) AS BIGINT) AS n,
       round(max(sr) - min(sr), 6) AS demographic_parity_difference,
       round(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 6) AS equalized_odds_difference,
       round(CASE WHEN max(sr) = 0 THEN 1.0 ELSE min(sr) / max(sr) END, 6) AS disparate_impact_ratio,
       round(CAST(sum(tp + fp) AS DOUBLE) / sum(n), 6) AS predicted_positive_rate
FROM rates GROUP BY period, attr""", "order_audit"))
def q_fairness_sliced(spark, d):
    return M.fairness_metrics(_oa(spark, d), attrs=["region", "segment"], slice_cols=["period"])


@register("predicted_selection_rate", with_views(_CONF + """
SELECT 'region' AS attr, grp, n, round(sr, 6) AS selection_rate, round(tpr, 6) AS tpr,
       round(fpr, 6) AS fpr FROM rates""", "order_audit"))
def q_predicted_selection_rate(spark, d):
    return M.predicted_selection_rate(_oa(spark, d), attrs="region")


def _one_metric(col):
    def q(spark, d):
        return M.fairness_metrics(_oa(spark, d), attrs="region").select("attr", col)
    return q


register("demographic_parity_difference", with_views(
    _CONF + "SELECT 'region' AS attr, round(dp, 6) AS demographic_parity_difference FROM fair",
    "order_audit"))(_one_metric("demographic_parity_difference"))
register("equalized_odds_difference", with_views(
    _CONF + "SELECT 'region' AS attr, round(eo, 6) AS equalized_odds_difference FROM fair",
    "order_audit"))(_one_metric("equalized_odds_difference"))
register("disparate_impact_ratio", with_views(
    _CONF + "SELECT 'region' AS attr, round(di, 6) AS disparate_impact_ratio FROM fair",
    "order_audit"))(_one_metric("disparate_impact_ratio"))


# doc_audit: small groups, some sources without negatives (zero denominators)
@register("fairness_metrics_docs", with_views("""
, long AS (
  SELECT 'lang' AS attr, lang AS grp, y_true, y_pred FROM doc_audit
  UNION ALL SELECT 'source', source, y_true, y_pred FROM doc_audit
), rates AS (
  SELECT attr, grp, count(*) AS n,
         CAST(sum(y_pred) AS DOUBLE) / count(*) AS sr,
         coalesce(CAST(sum(y_true * y_pred) AS DOUBLE) / nullif(sum(y_true), 0), 0) AS tpr,
         coalesce(CAST(sum((1 - y_true) * y_pred) AS DOUBLE) / nullif(sum(1 - y_true), 0), 0) AS fpr
  FROM long GROUP BY attr, grp
)
SELECT attr, CAST(count(*) AS BIGINT) AS n_groups, CAST(sum(n) AS BIGINT) AS n,
       round(max(sr) - min(sr), 6) AS demographic_parity_difference,
       round(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 6) AS equalized_odds_difference,
       round(CASE WHEN max(sr) = 0 THEN 1.0 ELSE min(sr) / max(sr) END, 6) AS disparate_impact_ratio,
       round(sum(sr * n) / sum(n), 6) AS predicted_positive_rate
FROM rates GROUP BY attr""", "doc_audit"))
def q_fairness_docs(spark, d):
    return M.fairness_metrics(doc_audit(spark, d), attrs=["lang", "source"])


# ------------------------------------------------------------ raw-data audit
@register("group_distribution", with_views("""
SELECT 'region' AS attr, region AS grp, CAST(count(*) AS BIGINT) AS n
FROM order_audit GROUP BY region""", "order_audit"))
def q_group_distribution(spark, d):
    return M.group_distribution(_oa(spark, d), "region")


@register("group_share", with_views("""
, c AS (SELECT 'sens_nullable' AS attr, sens_nullable AS grp, count(*) AS n
        FROM line_features GROUP BY sens_nullable)
SELECT attr, grp, CAST(n AS BIGINT) AS n, round(CAST(n AS DOUBLE) / sum(n) OVER (), 6) AS share
FROM c""", "line_features"))
def q_group_share(spark, d):
    from ..sources.tables import line_features
    return M.group_share(line_features(spark, d), "sens_nullable")


@register("observed_selection_rate", with_views("""
SELECT 'lang' AS attr, coalesce(CAST(lang AS VARCHAR), 'Unknown') AS grp,
       CAST(count(*) AS BIGINT) AS n,
       round(avg(CASE WHEN y_true = 1 THEN 1.0 ELSE 0.0 END), 6) AS selection_rate
FROM doc_audit GROUP BY 2""", "doc_audit"))
def q_observed_selection_rate(spark, d):
    return M.observed_selection_rate(doc_audit(spark, d), "y_true", "lang")


@register("group_imbalance_ratio", with_views("""
, c AS (SELECT grp, count(*) AS n FROM part_audit GROUP BY grp)
SELECT 'grp' AS attr, CAST(count(*) AS BIGINT) AS n_groups,
       round(CASE WHEN count(*) >= 2 AND max(n) > 0 THEN CAST(min(n) AS DOUBLE) / max(n) END, 6)
         AS imbalance_ratio
FROM c""", "part_audit"))
def q_group_imbalance_ratio(spark, d):
    return M.group_imbalance_ratio(part_audit(spark, d), "grp")


@register("selection_rate_gap", with_views("""
, c AS (SELECT lang, count(*) AS n, round(avg(CAST(y_true = 1 AS INT)), 6) AS sr
        FROM doc_audit GROUP BY lang)
SELECT 'lang' AS attr, CAST(count(*) AS BIGINT) AS n_groups,
       round(CASE WHEN count(*) >= 2 THEN CAST(min(n) AS DOUBLE) / max(n) END, 6) AS imbalance_ratio,
       round(CASE WHEN count(*) >= 2 THEN max(sr) - min(sr) END, 6) AS selection_rate_gap
FROM c""", "doc_audit"))
def q_selection_rate_gap(spark, d):
    s = M.distribution_summary(doc_audit(spark, d), "y_true", "lang")
    return s.select("attr", "n_groups", F.round("imbalance_ratio", 6).alias("imbalance_ratio"),
                    F.round("selection_rate_gap", 6).alias("selection_rate_gap"))


@register("collapse_flags", with_views("""
, long AS (
  SELECT 'baseline' AS model, region AS grp, y_pred FROM order_audit
  UNION ALL SELECT 'never', region, CAST(o_totalprice > 600000 AS INT) FROM order_audit
), g AS (SELECT model, grp, avg(y_pred) AS sr, sum(y_pred) AS npos, count(*) AS n FROM long GROUP BY model, grp)
SELECT model, 'region' AS attr, round(CAST(sum(npos) AS DOUBLE) / sum(n), 6) AS predicted_positive_rate,
       CAST(sum(npos) AS DOUBLE) / sum(n) < 0.02 AS low_positive_rate,
       max(sr) = 0 AS all_zero_selection
FROM g GROUP BY model""", "order_audit"))
def q_collapse_flags(spark, d):
    oa = _oa(spark, d).withColumn("y_never", (F.col("o_totalprice") > 600000).cast("int"))
    long = M.models_long(oa, {"baseline": "y_pred", "never": "y_never"}, ["region", "y_true"])
    fair = M.fairness_metrics(long, attrs="region", slice_cols=["model"], rounded=False)
    return M.collapse_flags(fair)


# ------------------------------------------------------- generator reports
@register("group_rate_report", with_views("""
SELECT 'segment' AS attr, segment AS grp, round(avg(y_true), 6) AS rate, CAST(count(*) AS BIGINT) AS n
FROM order_audit GROUP BY segment
UNION ALL
SELECT 'priority', priority, round(avg(y_true), 6), CAST(count(*) AS BIGINT)
FROM order_audit GROUP BY priority""", "order_audit"))
def q_group_rate_report(spark, d):
    from ..operators.cube import with_groups
    oa = _oa(spark, d).select("segment", "priority", "y_true")
    g = with_groups(oa, ["segment", "priority"], ["y_true"])
    return g.groupBy("attr", "grp").agg(F.round(F.avg("y_true"), 6).alias("rate"),
                                        F.count(F.lit(1)).alias("n"))


@register("named_pair_di", with_views("""
, r AS (SELECT avg(CASE WHEN region = 'AFRICA' THEN y_pred END) AS a,
               avg(CASE WHEN region = 'MIDDLE EAST' THEN y_pred END) AS b FROM order_audit)
SELECT round(a, 6) AS rate_a, round(b, 6) AS rate_b,
       CASE WHEN b > 0 THEN round(a / b, 6) ELSE CAST('inf' AS DOUBLE) END AS di_ratio FROM r""",
    "order_audit"))
def q_named_pair_di(spark, d):
    return M.named_pair_di(_oa(spark, d), "region", "y_pred", "AFRICA", "MIDDLE EAST")


@register("binned_rate_report", with_views("""
SELECT CASE WHEN p_size > 0 AND p_size <= 10 THEN '1-10' WHEN p_size > 10 AND p_size <= 25 THEN '11-25'
            WHEN p_size > 25 AND p_size <= 40 THEN '26-40' WHEN p_size > 40 AND p_size <= 50 THEN '41-50' END AS bin,
       round(avg(y), 6) AS rate, CAST(count(*) AS BIGINT) AS n
FROM part_audit GROUP BY 1""", "part_audit"))
def q_binned_rate_report(spark, d):
    p = part_audit(spark, d)
    b = bin_column(F.col("p_size"), [0, 10, 25, 40, 50], ["1-10", "11-25", "26-40", "41-50"])
    return p.groupBy(b.alias("bin")).agg(F.round(F.avg("y"), 6).alias("rate"),
                                         F.count(F.lit(1)).alias("n"))


@register("intersectional_rates", with_views("""
SELECT region, segment, round(avg(y_true), 3) AS rate, CAST(count(*) AS BIGINT) AS n
FROM order_audit GROUP BY CUBE (region, segment)""", "order_audit"))
def q_intersectional_rates(spark, d):
    return (_oa(spark, d).cube("region", "segment")
            .agg(F.round(F.avg("y_true"), 3).alias("rate"), F.count(F.lit(1)).alias("n")))


# ------------------------------------------------------------- model quality
_PAIRS = """
, pairs AS (SELECT y_true, y_pred, count(*) AS n FROM order_audit GROUP BY y_true, y_pred)
"""


@register("confusion_matrix", with_views("""
, pairs AS (SELECT lang AS y_true, CASE WHEN n_chars >= 2000 THEN 'long' WHEN n_chars >= 500 THEN lang ELSE 'short' END AS y_pred,
                   count(*) AS n FROM doc_audit GROUP BY 1, 2),
  labs AS (SELECT DISTINCT l FROM (SELECT y_true AS l FROM pairs UNION ALL SELECT y_pred FROM pairs)),
  ranked AS (SELECT l, CAST(row_number() OVER (ORDER BY l) - 1 AS INT) AS i FROM labs)
SELECT a.i AS i, b.i AS j, a.l AS y_true, b.l AS y_pred, CAST(coalesce(p.n, 0) AS BIGINT) AS n
FROM ranked a JOIN ranked b ON true
LEFT JOIN pairs p ON p.y_true = a.l AND p.y_pred = b.l""", "doc_audit"))
def q_confusion_matrix(spark, d):
    da = doc_audit(spark, d)
    yp = (F.when(F.col("n_chars") >= 2000, "long").when(F.col("n_chars") >= 500, F.col("lang"))
          .otherwise("short"))
    return M.confusion_matrix(da.select(F.col("lang").alias("y_true"), yp.alias("y_pred")))


@register("accuracy", with_views("""
SELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM order_audit""",
    "order_audit"))
def q_accuracy(spark, d):
    p = M.label_pairs(_oa(spark, d))
    return M.performance_from_pairs(p, ["_all"]).select(r6(F.col("accuracy")).alias("accuracy"))


@register("precision_recall", with_views(_PAIRS + """
, c AS (SELECT sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN n ELSE 0 END) AS tp,
               sum(CASE WHEN y_true <> 1 AND y_pred = 1 THEN n ELSE 0 END) AS fp,
               sum(CASE WHEN y_true = 1 AND y_pred <> 1 THEN n ELSE 0 END) AS fn FROM pairs)
SELECT round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 6) AS recall FROM c""", "order_audit"))
def q_precision_recall(spark, d):
    p = M.label_pairs(_oa(spark, d))
    perf = M.performance_from_pairs(p, ["_all"])
    return perf.select(r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


@register("precision_recall_weighted", with_views("""
, pairs AS (SELECT lang AS y_true, CASE WHEN n_chars >= 2000 THEN 'long' WHEN n_chars >= 500 THEN lang ELSE 'short' END AS y_pred,
                   count(*) AS n FROM doc_audit GROUP BY 1, 2),
  t AS (SELECT y_true AS c, sum(n) AS support, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS tp FROM pairs GROUP BY 1),
  p AS (SELECT y_pred AS c, sum(n) AS predicted FROM pairs GROUP BY 1),
  cls AS (SELECT coalesce(t.support, 0) AS support, coalesce(t.tp, 0) AS tp, coalesce(p.predicted, 0) AS predicted
          FROM t FULL JOIN p ON t.c = p.c)
SELECT CAST(sum(support) AS BIGINT) AS n,
       round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS accuracy,
       round(sum(support * coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0)) / sum(support), 6) AS precision,
       round(sum(support * coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0)) / sum(support), 6) AS recall
FROM cls""", "doc_audit"))
def q_precision_recall_weighted(spark, d):
    da = doc_audit(spark, d)
    yp = (F.when(F.col("n_chars") >= 2000, "long").when(F.col("n_chars") >= 500, F.col("lang"))
          .otherwise("short"))
    p = M.label_pairs(da.select(F.col("lang").alias("y_true"), yp.alias("y_pred")))
    perf = M.performance_from_pairs(p, ["_all"], binary=False)
    return perf.select("n", *[r6(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall")])


_EVAL = """
, long AS (
  SELECT period, 'baseline' AS model, region AS grp, y_true, y_pred FROM order_audit
  UNION ALL SELECT period, 'mitigated', region, y_true, y_pred_b FROM order_audit
), conf AS (
  SELECT period, model, grp, count(*) AS n,
         sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END) AS fn,
         sum(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END) AS tn
  FROM long GROUP BY period, model, grp
), rates AS (
  SELECT *, CAST(tp + fp AS DOUBLE) / n AS sr,
         coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS tpr,
         coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0) AS fpr
  FROM conf
), ev0 AS (
  SELECT period, model, sum(n) AS n,
         CAST(sum(tp + tn) AS DOUBLE) / sum(n) AS accuracy,
         coalesce(CAST(sum(tp) AS DOUBLE) / nullif(sum(tp + fp), 0), 0) AS precision,
         coalesce(CAST(sum(tp) AS DOUBLE) / nullif(sum(tp + fn), 0), 0) AS recall,
         max(sr) - min(sr) AS dp, greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) AS eo,
         CASE WHEN max(sr) = 0 THEN 1.0 ELSE min(sr) / max(sr) END AS di,
         CAST(sum(tp + fp) AS DOUBLE) / sum(n) AS ppr
  FROM rates GROUP BY period, model
), ev AS (
  SELECT period, model, 'region' AS attr, CAST(n AS BIGINT) AS n, round(accuracy, 6) AS accuracy,
         round(precision, 6) AS precision, round(recall, 6) AS recall,
         round(dp, 6) AS demographic_parity_difference, round(eo, 6) AS equalized_odds_difference,
         round(di, 6) AS disparate_impact_ratio,
         round((least(dp, 1) + least(eo, 1) + least(abs(1 - di), 1)) / 3, 6) AS fairness_score,
         round(ppr, 6) AS predicted_positive_rate
  FROM ev0
)
"""


def _long_models(spark, d):
    oa = _oa(spark, d)
    return M.models_long(oa, {"baseline": "y_pred", "mitigated": "y_pred_b"},
                         ["period", "region", "y_true"])


@register("evaluate_predictions", with_views(_EVAL + "SELECT * FROM ev", "order_audit"))
def q_evaluate_predictions(spark, d):
    return M.evaluate_predictions(_long_models(spark, d), attrs="region", slice_cols=["period"],
                                  model_col="model")


@register("evaluate_predictions_multiclass", with_views("""
, pairs AS (SELECT source, lang AS y_true, CASE WHEN n_chars >= 2000 THEN 'long' WHEN n_chars >= 500 THEN lang ELSE 'short' END AS y_pred,
                   count(*) AS n FROM doc_audit GROUP BY 1, 2, 3),
  t AS (SELECT source, y_true AS c, sum(n) AS support, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS tp FROM pairs GROUP BY 1, 2),
  p AS (SELECT source, y_pred AS c, sum(n) AS predicted FROM pairs GROUP BY 1, 2),
  cls AS (SELECT source, coalesce(t.support, 0) AS support, coalesce(t.tp, 0) AS tp, coalesce(p.predicted, 0) AS predicted
          FROM t FULL JOIN p USING (source, c))
SELECT source, CAST(sum(support) AS BIGINT) AS n, round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS accuracy,
       round(sum(support * coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0)) / sum(support), 6) AS precision,
       round(sum(support * coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0)) / sum(support), 6) AS recall
FROM cls GROUP BY source""", "doc_audit"))
def q_evaluate_predictions_multiclass(spark, d):
    """Language labels guessed from the length class, per source."""
    da = doc_audit(spark, d).where(F.col("lang").isNotNull())
    yp = (F.when(F.col("n_chars") >= 2000, "long").when(F.col("n_chars") >= 500, F.col("lang"))
          .otherwise("short"))
    ev = M.evaluate_predictions(da.select("source", F.col("lang").alias("y_true"), yp.alias("y_pred"),
                                          F.col("lang").alias("grp")), slice_cols=["source"])
    return ev.select("source", "n", "accuracy", "precision", "recall")


@register("evaluate_predictions_text", with_views("""
, yn AS (SELECT lang AS grp, CASE WHEN y_true = 1 THEN 'yes' ELSE 'no' END AS y_true,
                CASE WHEN y_pred = 1 THEN 'yes' ELSE 'no' END AS y_pred FROM doc_audit),
  g AS (SELECT grp, count(*) AS n, sum(CASE WHEN y_pred = 'yes' THEN 1 ELSE 0 END)::DOUBLE / count(*) AS sr,
               coalesce(sum(CASE WHEN y_pred = 'yes' AND y_true = 'yes' THEN 1 ELSE 0 END)::DOUBLE
                        / nullif(sum(CASE WHEN y_true = 'yes' THEN 1 ELSE 0 END), 0), 0) AS tpr,
               coalesce(sum(CASE WHEN y_pred = 'yes' AND y_true = 'no' THEN 1 ELSE 0 END)::DOUBLE
                        / nullif(sum(CASE WHEN y_true = 'no' THEN 1 ELSE 0 END), 0), 0) AS fpr FROM yn GROUP BY 1),
  f AS (SELECT max(sr) - min(sr) AS dp, greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) AS eo,
               CASE WHEN max(sr) = 0 THEN 1.0 ELSE min(sr) / max(sr) END AS di FROM g),
  c AS (SELECT l.c, (SELECT count(*) FROM yn WHERE y_true = l.c) AS support, (SELECT count(*) FROM yn WHERE y_pred = l.c) AS predicted,
               (SELECT count(*) FROM yn WHERE y_true = l.c AND y_pred = l.c) AS tp FROM (VALUES ('yes'), ('no')) l(c))
SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy,
       round(sum(support * coalesce(tp::DOUBLE / nullif(predicted, 0), 0)) / sum(support), 6) AS precision,
       round(sum(support * coalesce(tp::DOUBLE / nullif(support, 0), 0)) / sum(support), 6) AS recall,
       round(max(dp), 6) AS demographic_parity_difference, round(max(eo), 6) AS equalized_odds_difference,
       round(max(di), 6) AS disparate_impact_ratio
FROM c, f""", "doc_audit"))
def q_evaluate_predictions_text(spark, d):
    """Quality judgements as yes/no text, by language."""
    yn = [F.when(F.col(c) == 1, "yes").otherwise("no").alias(c) for c in ("y_true", "y_pred")]
    ev = M.evaluate_predictions(doc_audit(spark, d).select(*yn, F.col("lang").alias("grp")))
    return ev.select("n", "accuracy", "precision", "recall", *M.FAIRNESS_COLS)


_CMP_COLS = ["accuracy", "precision", "recall", "demographic_parity_difference",
             "equalized_odds_difference", "disparate_impact_ratio"]


@register("compare_models", with_views(_EVAL + "SELECT period, attr, " + ", ".join(
    f"round(max(CASE WHEN model = 'mitigated' THEN {c} END) - max(CASE WHEN model = 'baseline' THEN {c} END), 6) AS {c}_change"
    for c in _CMP_COLS) + " FROM ev GROUP BY period, attr", "order_audit"))
def q_compare_models(spark, d):
    return M.compare_models(_oa(spark, d), "y_pred", "y_pred_b", attrs="region", slice_cols=["period"])


@register("metric_comparison_long", with_views(_EVAL + """
, m AS (UNPIVOT (SELECT period, attr, model, accuracy, precision, recall, demographic_parity_difference,
                        equalized_odds_difference, disparate_impact_ratio FROM ev)
        ON accuracy, precision, recall, demographic_parity_difference, equalized_odds_difference,
           disparate_impact_ratio INTO NAME metric VALUE value)
SELECT period, attr, metric, max(CASE WHEN model = 'baseline' THEN value END) AS baseline,
       max(CASE WHEN model = 'mitigated' THEN value END) AS mitigated,
       round(max(CASE WHEN model = 'mitigated' THEN value END) - max(CASE WHEN model = 'baseline' THEN value END), 6) AS delta
FROM m GROUP BY period, attr, metric""", "order_audit"))
def q_metric_comparison_long(spark, d):
    return M.metric_comparison_long(_oa(spark, d), "y_pred", "y_pred_b", attrs="region",
                                    slice_cols=["period"])


@register("delta_table", with_views(_EVAL + """
, c AS (SELECT period, attr, """ + ", ".join(
    f"round(max(CASE WHEN model = 'mitigated' THEN {c} END) - max(CASE WHEN model = 'baseline' THEN {c} END), 6) AS {c}_change"
    for c in _CMP_COLS) + """ FROM ev GROUP BY period, attr)
SELECT period, attr, metric, change FROM (UNPIVOT c ON """ + ", ".join(f"{c}_change" for c in _CMP_COLS)
    + " INTO NAME metric VALUE change)", "order_audit"))
def q_delta_table(spark, d):
    return M.delta_table(_oa(spark, d), "y_pred", "y_pred_b", attrs="region", slice_cols=["period"])


@register("fairness_score", with_views(_EVAL + "SELECT period, model, fairness_score FROM ev",
                                       "order_audit"))
def q_fairness_score(spark, d):
    ev = M.evaluate_predictions(_long_models(spark, d), attrs="region", slice_cols=["period"],
                                model_col="model")
    return ev.select("period", "model", "fairness_score")


_AUDIT_REPORT_SQL = """
, conf AS (SELECT region AS grp, count(*) AS n,
                  sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS tp,
                  sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END) AS fp,
                  sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END) AS fn,
                  sum(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END) AS tn,
                  round(avg(CASE WHEN y_true = 1 THEN 1.0 ELSE 0.0 END), 6) AS obs
           FROM order_audit GROUP BY region),
  rates AS (SELECT *, CAST(tp + fp AS DOUBLE) / n AS sr,
                   coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS tpr,
                   coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0) AS fpr FROM conf),
  a AS (SELECT count(*) AS n_groups, abs(max(sr) - min(sr)) AS dp,
               abs(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr))) AS eo,
               CASE WHEN max(sr) = 0 THEN 1.0 ELSE min(sr) / max(sr) END AS di,
               CASE WHEN count(*) >= 2 AND max(n) > 0 THEN CAST(min(n) AS DOUBLE) / max(n) END AS r,
               CASE WHEN count(*) >= 2 THEN max(obs) - min(obs) END AS gap FROM rates),
  sig AS (SELECT *, CASE WHEN di < 0.8 THEN least(1.0, (0.8 - di) / 0.4) END AS s1,
                 CASE WHEN dp >= 0.1 THEN least(1.0, dp / 0.5) END AS s2,
                 CASE WHEN eo >= 0.1 THEN least(1.0, eo / 0.5) END AS s3,
                 CASE WHEN r IS NOT NULL AND r < 0.5 THEN least(1.0, (0.5 - r) / 0.5) END AS s4,
                 CASE WHEN dp >= 0.2 AND eo < 0.1 AND di < 1.0 THEN least(1.0, dp / 0.6) END AS s5 FROM a),
  sc AS (SELECT *,
     CASE WHEN di < 0.8 OR dp >= 0.1 THEN greatest(greatest(0.0, least(1.0, (0.8 - di) / 0.4)), greatest(0.0, least(1.0, dp / 0.5))) ELSE 0.0 END AS c_sel,
     CASE WHEN eo >= 0.1 THEN greatest(0.0, least(1.0, eo / 0.5)) ELSE 0.0 END AS c_pred,
     CASE WHEN r IS NOT NULL AND r < 0.5 THEN greatest(0.0, least(1.0, (0.5 - r) / 0.5)) ELSE 0.0 END AS c_hist,
     CASE WHEN dp >= 0.2 AND eo < 0.1 AND di < 1.0 THEN greatest(0.0, least(1.0, dp / 0.6)) ELSE 0.0 END AS c_proxy,
     (s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT + (s4 IS NOT NULL)::INT + (s5 IS NOT NULL)::INT AS k,
     greatest(coalesce(s1, 0), coalesce(s2, 0), coalesce(s3, 0), coalesce(s4, 0), coalesce(s5, 0)) AS smax,
     coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0) + coalesce(s4, 0) + coalesce(s5, 0) AS ssum FROM sig),
  typed AS (SELECT *,
     CASE WHEN greatest(c_sel, c_pred, c_hist, c_proxy) < 0.2 AND k = 0 THEN 'No Significant Bias'
          WHEN c_sel >= greatest(c_pred, c_hist, c_proxy) THEN 'Selection Bias'
          WHEN c_pred >= greatest(c_hist, c_proxy) THEN 'Prediction Bias'
          WHEN c_hist >= c_proxy THEN 'Historical Bias' ELSE 'Proxy Bias' END AS bias_type,
     CASE WHEN k = 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, 0.7 * smax + 0.3 * ssum / k)), 3) END AS severity FROM sc),
  coded AS (SELECT *, CAST(dense_rank() OVER (ORDER BY region) - 1 AS DOUBLE) AS s FROM order_audit),
  pairs AS (SELECT 'o_totalprice' AS feature, 1 AS position, o_totalprice AS x, s FROM coded
            UNION ALL SELECT 'c_acctbal', 2, c_acctbal, s FROM coded
            UNION ALL SELECT 'n_regionkey', 3, CAST(n_regionkey AS DOUBLE), s FROM coded
            UNION ALL SELECT 'score', 4, score, s FROM coded),
  corr AS (SELECT feature, position, covar_pop(x, s) / nullif(stddev_pop(x) * stddev_pop(s), 0) AS cr
           FROM pairs WHERE x IS NOT NULL GROUP BY 1, 2),
  top AS (SELECT feature, cr, row_number() OVER (ORDER BY abs(cr) DESC, position) AS rk FROM corr
          WHERE cr IS NOT NULL AND NOT isnan(cr)),
  flagged AS (SELECT feature, abs(round(cr, 6)) AS c FROM top WHERE rk <= 5 AND abs(round(cr, 6)) >= 0.5
              ORDER BY rk LIMIT 1),
  causes AS (
    SELECT 'Historical Bias' AS bt, 0 AS pr, least(1.0, (0.5 - r) / 0.5) AS st,
           'Group distribution is highly imbalanced across the sensitive attribute.' AS cause FROM a WHERE r < 0.5
    UNION ALL SELECT 'Selection Bias', 1, least(1.0, gap / 0.25), 'Unequal selection rates across sensitive groups.'
    FROM a WHERE gap >= 0.15
    UNION ALL SELECT 'Proxy Bias', 2, least(1.0, c / 0.7), 'High correlation of ' || feature || ' with the sensitive attribute.'
    FROM flagged)
SELECT 'region' AS attr, CAST(n_groups AS BIGINT) AS n_groups, round(dp, 6) AS dp, round(eo, 6) AS eo,
       round(di, 6) AS di, round(r, 6) AS imbalance_ratio, bias_type AS detected_bias_type, severity AS severity_score,
       round(gap, 6) AS selection_rate_gap,
       coalesce((SELECT bt FROM causes ORDER BY st DESC, pr LIMIT 1), 'No Significant Bias') AS root_cause_type,
       CASE WHEN (SELECT count(*) FROM causes) = 0 THEN 'Low'
            WHEN (SELECT 0.7 * max(st) + 0.3 * avg(st) FROM causes) >= 0.67 THEN 'High'
            WHEN (SELECT 0.7 * max(st) + 0.3 * avg(st) FROM causes) >= 0.34 THEN 'Medium' ELSE 'Low' END AS root_cause_severity,
       coalesce((SELECT string_agg(cause, ' | ' ORDER BY pr) FROM causes), '') AS root_causes,
       (SELECT feature FROM top WHERE rk = 1) AS top_proxy,
       (SELECT round(cr, 6) FROM top WHERE rk = 1) AS top_proxy_correlation
FROM typed
"""


@register("audit_report", with_views(_AUDIT_REPORT_SQL, "order_audit"))
def q_audit_report(spark, d):
    from .audit import audit_report
    oa = _oa(spark, d).select("region", "y_true", "y_pred", "o_totalprice", "c_acctbal", "n_regionkey", "score")
    return audit_report(oa, "y_true", "y_pred", "region", ["o_totalprice", "c_acctbal", "n_regionkey", "score"])
