"""Queries for §2.1: sources and sinks, each a round trip through the shared
scratch folder (``spark.checkpoint.dir``), checked against the source SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as MO
from ..operators.metrics import evaluate_predictions, models_long
from ..session import scratch_path
from ..sources import io as IO
from ..sources.tables import line_features, order_audit
from .registry import register
from .views_sql import with_views


@register("src_csv", with_views("""
SELECT l_orderkey, l_linenumber, qty, status, sens_nullable, price FROM line_features""", "line_features"))
def q_src_csv(spark, d):
    """Write with 'NA' for missing values, read back with sentinel handling and
    type inference."""
    path = scratch_path(spark, "src_csv")
    lf = line_features(spark, d).select("l_orderkey", "l_linenumber", "qty", "status", "sens_nullable", "price")
    IO.write_dataset(lf, path, null_value="NA")
    back = IO.read_csv(spark, path)
    return back.select(F.col("l_orderkey").cast("bigint").alias("l_orderkey"),
                       F.col("l_linenumber").cast("int").alias("l_linenumber"),
                       F.col("qty").cast("double").alias("qty"), "status", "sens_nullable",
                       F.col("price").cast("double").alias("price"))


@register("sink_dataset", with_views("""
SELECT row_id, region, segment, period, y_true, y_pred, o_totalprice FROM order_audit""", "order_audit"))
def q_sink_dataset(spark, d):
    path = scratch_path(spark, "dataset")
    oa = order_audit(spark, d).select("row_id", "region", "segment", "period", "y_true", "y_pred", "o_totalprice")
    IO.write_dataset(oa, path)
    return IO.read_csv(spark, path, "row_id bigint, region string, segment string, period string, "
                                    "y_true int, y_pred int, o_totalprice double")


def _report_sql():
    from .q_rules import _AUDIT
    return with_views(_AUDIT + """
SELECT period, attr, bias_type AS detected_bias_type, severity AS severity_score, CAST(k AS INT) AS n_triggered
FROM typed""", "order_audit")


@register("sink_report_json", _report_sql())
def q_sink_report_json(spark, d):
    from ..operators.rules import audit_rows, identify_bias
    a = identify_bias(audit_rows(order_audit(spark, d), "y_true", "y_pred", ["region", "segment"], ["period"]))
    rep = a.select("period", "attr", F.struct("detected_bias_type", "severity_score", "n_triggered",
                                              "explanation").alias("bias"))
    path = scratch_path(spark, "report_json")
    IO.write_report_json(rep, path)
    back = IO.read_report_json(spark, path, "period string, attr string, bias struct<detected_bias_type: string, "
                                            "severity_score: double, n_triggered: int, explanation: string>")
    return back.select("period", "attr", "bias.detected_bias_type", "bias.severity_score", "bias.n_triggered")


@register("sink_report_csv", with_views("""
, long AS (SELECT 'baseline' AS model, region AS grp, y_true, y_pred FROM order_audit
           UNION ALL SELECT 'mitigated', region, y_true, y_pred_b FROM order_audit),
  conf AS (SELECT model, grp, count(*) AS n,
                  sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS tp,
                  sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END) AS fp,
                  sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END) AS fn,
                  sum(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END) AS tn FROM long GROUP BY 1, 2),
  rates AS (SELECT *, CAST(tp + fp AS DOUBLE) / n AS sr,
                   coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS tpr,
                   coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0) AS fpr FROM conf),
  ev AS (SELECT model, round(CAST(sum(tp + tn) AS DOUBLE) / sum(n), 6) AS accuracy,
                round(coalesce(CAST(sum(tp) AS DOUBLE) / nullif(sum(tp + fp), 0), 0), 6) AS precision,
                round(coalesce(CAST(sum(tp) AS DOUBLE) / nullif(sum(tp + fn), 0), 0), 6) AS recall,
                round(max(sr) - min(sr), 6) AS demographic_parity_difference,
                round(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 6) AS equalized_odds_difference,
                round(CASE WHEN max(sr) = 0 THEN 1.0 ELSE min(sr) / max(sr) END, 6) AS disparate_impact_ratio
         FROM rates GROUP BY model)
SELECT model, 'performance' AS kind, metric, value FROM (UNPIVOT (SELECT model, accuracy, precision, recall FROM ev)
  ON accuracy, precision, recall INTO NAME metric VALUE value)
UNION ALL
SELECT model, 'fairness', metric, value FROM (UNPIVOT (SELECT model, demographic_parity_difference,
  equalized_odds_difference, disparate_impact_ratio FROM ev)
  ON demographic_parity_difference, equalized_odds_difference, disparate_impact_ratio INTO NAME metric VALUE value)""",
    "order_audit"))
def q_sink_report_csv(spark, d):
    oa = order_audit(spark, d)
    long = models_long(oa, {"baseline": "y_pred", "mitigated": "y_pred_b"}, ["region", "y_true"])
    ev = evaluate_predictions(long, "y_true", "y_pred", "region", model_col="model")
    p = (ev.select("model", "accuracy", "precision", "recall")
         .unpivot(["model"], ["accuracy", "precision", "recall"], "metric", "value")
         .withColumn("kind", F.lit("performance")))
    f = (ev.select("model", "demographic_parity_difference", "equalized_odds_difference", "disparate_impact_ratio")
         .unpivot(["model"], ["demographic_parity_difference", "equalized_odds_difference",
                              "disparate_impact_ratio"], "metric", "value")
         .withColumn("kind", F.lit("fairness")))
    path = scratch_path(spark, "report_csv")
    IO.write_metric_table(p.unionByName(f), path)
    return IO.read_metric_table(spark, path).select("model", "kind", "metric", "value")


@register("sink_model")
def q_sink_model(spark, d):
    """Save the baseline model and its metadata; return the metadata read back."""
    from .q_strategies import _train_test
    tr, te, feats = _train_test(spark, d)
    m = MO.fit(tr, feats)
    path = scratch_path(spark, "model")
    MO.save_model(spark, m, path, {"target": "y_true", "sensitive": "region", "strategy": "baseline",
                                   "model_type": "logistic_regression", "features": feats})
    return spark.read.json(f"{path}/metadata")


@register("score_saved")
def q_score_saved(spark, d):
    """Load a saved model and score the whole table, both splits."""
    from .q_strategies import _train_test
    tr, te, feats = _train_test(spark, d)
    path = scratch_path(spark, "model")
    MO.save_model(spark, MO.fit(tr, feats), path, {"target": "y_true"})
    return MO.score(MO.load_model(spark, path), tr.unionByName(te)).select("row_id", "sensitive", "y", "y_pred", "p1")


@register("load_saved_strategies")
def q_load_saved_strategies(spark, d):
    """Save a model of each kind, load it, and count over the whole table how
    often the loaded model predicts as the saved one did."""
    from .q_strategies import _train_test
    tr, te, feats = _train_test(spark, d)
    out = None
    for name in (MO.REWEIGHING, MO.THRESHOLD_DP, MO.CONSTRAINED):
        model, _ = MO.run_strategy(name, tr, te, feats, "sensitive", "region", constrained_iterations=3)
        path = scratch_path(spark, "model")
        MO.save_model(spark, model, path, {"strategy": name})
        rows = tr.unionByName(te)
        both = (MO.predict(model, rows).select("row_id", F.col("y_pred").alias("saved"))
                .join(MO.predict(MO.load_model(spark, path), rows).select("row_id", F.col("y_pred").alias("loaded")),
                      "row_id"))
        part = both.agg(F.count(F.lit(1)).alias("n_rows"),
                        F.sum((F.col("saved") == F.col("loaded")).cast("long")).alias("n_equal"))
        part = part.select(F.lit(name).alias("strategy"), "n_rows", "n_equal")
        out = part if out is None else out.unionByName(part)
    return out
