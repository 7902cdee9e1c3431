"""Queries for §2.9 (strategy ranking; SQL-checked on rule-based candidate
predictions) and the model jobs of §2.5/§2.8/§2.9 (trained with Spark ML;
checked by invariants in tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as MO
from ..operators import strategies as S
from ..operators.metrics import FAIRNESS_COLS, evaluate_predictions
from ..operators.rules import recommend
from ..sources.tables import order_audit
from .registry import register
from .views_sql import with_views

# ------------------------------------------------------ candidate predictions
CANDIDATES = {
    "baseline": "y_pred",
    "Reweighing": "y_pred_b",
    "Fairness-Constrained Learning": "p_constrained",
    "Feature Debiasing": "p_debias",
    "Equalized Odds Post-Processing": "p_eo",
}


def _candidates(spark, d):
    oa = order_audit(spark, d)
    return (oa.withColumn("p_constrained", (F.col("o_totalprice") + 20000 * F.col("n_regionkey") > 320000).cast("int"))
              .withColumn("p_debias", (F.col("o_totalprice") > 300000).cast("int"))
              .withColumn("p_eo", (F.col("o_totalprice") > 200000).cast("int")))


def _evaluated(spark, d):
    return S.evaluate_candidates(_candidates(spark, d), CANDIDATES, "y_true", "region", ["segment"])


_EV = """
, long AS (
  SELECT segment, 'baseline' AS strategy, -1 AS position, region AS grp, y_true, y_pred FROM order_audit
  UNION ALL SELECT segment, 'Reweighing', 0, region, y_true, y_pred_b FROM order_audit
  UNION ALL SELECT segment, 'Fairness-Constrained Learning', 1, region, y_true,
                   CAST(o_totalprice + 20000 * n_regionkey > 320000 AS INT) FROM order_audit
  UNION ALL SELECT segment, 'Feature Debiasing', 2, region, y_true, CAST(o_totalprice > 300000 AS INT) FROM order_audit
  UNION ALL SELECT segment, 'Equalized Odds Post-Processing', 3, region, y_true, CAST(o_totalprice > 200000 AS INT)
            FROM order_audit
), conf AS (
  SELECT segment, strategy, position, grp, count(*) AS n,
         sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END) AS fn,
         sum(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END) AS tn
  FROM long GROUP BY ALL
), rates AS (
  SELECT *, CAST(tp + fp AS DOUBLE) / n AS sr,
         coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS tpr,
         coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0) AS fpr FROM conf
), ev0 AS (
  SELECT segment, strategy, position, CAST(sum(tp + tn) AS DOUBLE) / sum(n) AS acc,
         max(sr) - min(sr) AS dp, greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) AS eo,
         CASE WHEN max(sr) = 0 THEN 1.0 ELSE min(sr) / max(sr) END AS di
  FROM rates GROUP BY segment, strategy, position
), ev AS (
  SELECT segment, strategy, position, round(acc, 6) AS accuracy,
         round((least(dp, 1) + least(eo, 1) + least(abs(1 - di), 1)) / 3, 6) AS fairness FROM ev0
), gain AS (
  SELECT e.segment, e.strategy, e.position, e.accuracy, e.fairness, b.accuracy AS baseline_accuracy,
         b.fairness AS baseline_fairness, round(b.fairness - e.fairness, 6) AS fairness_improvement,
         CASE WHEN b.accuracy > 0 THEN round(e.accuracy / b.accuracy, 6) ELSE 0.0 END AS accuracy_retention
  FROM ev e JOIN ev b ON e.segment = b.segment AND b.strategy = 'baseline' WHERE e.strategy <> 'baseline'
), ranked0 AS (
  SELECT *, greatest(fairness_improvement, 0) / CASE WHEN max(greatest(fairness_improvement, 0)) OVER (PARTITION BY segment) = 0
                 THEN 1.0 ELSE max(greatest(fairness_improvement, 0)) OVER (PARTITION BY segment) END AS ng FROM gain
), ranked AS (
  SELECT *, round(ng, 6) AS normalized_fairness_improvement, round(0.65 * ng + 0.35 * accuracy_retention, 6) AS rank_score
  FROM ranked0
), ranked2 AS (
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY rank_score DESC, fairness_improvement DESC,
                                accuracy DESC, position) AS rank FROM ranked
)
"""


@register("strategy_gain", with_views(_EV + """
SELECT segment, strategy, accuracy, fairness, baseline_accuracy, baseline_fairness, fairness_improvement,
       accuracy_retention FROM gain""", "order_audit"))
def q_strategy_gain(spark, d):
    g = S.strategy_gain(_evaluated(spark, d), ["segment"])
    return g.select("segment", "strategy", "accuracy", "fairness", "baseline_accuracy", "baseline_fairness",
                    "fairness_improvement", "accuracy_retention")


@register("rank_strategies", with_views(_EV + """
SELECT segment, strategy, normalized_fairness_improvement, rank_score, CAST(rank AS INT) AS rank FROM ranked2""",
    "order_audit"))
def q_rank_strategies(spark, d):
    r = S.rank_strategies(S.strategy_gain(_evaluated(spark, d), ["segment"]), ["segment"])
    return r.select("segment", "strategy", "normalized_fairness_improvement", "rank_score",
                    F.col("rank").cast("int").alias("rank"))


@register("best_fairness", with_views(_EV + """
SELECT segment, strategy, fairness, accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY fairness, accuracy DESC, position) AS r FROM gain)
WHERE r = 1""", "order_audit"))
def q_best_fairness(spark, d):
    return S.best_fairness(S.strategy_gain(_evaluated(spark, d), ["segment"]), ["segment"])


@register("best_accuracy", with_views(_EV + """
SELECT segment, strategy, accuracy, fairness FROM (
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY accuracy DESC, fairness_improvement DESC, position) AS r
  FROM gain) WHERE r = 1""", "order_audit"))
def q_best_accuracy(spark, d):
    return S.best_accuracy(S.strategy_gain(_evaluated(spark, d), ["segment"]), ["segment"])


@register("balanced_choice", with_views(_EV + """
SELECT segment, strategy, rank_score, fairness, accuracy FROM ranked2 WHERE rank = 1""", "order_audit"))
def q_balanced_choice(spark, d):
    r = S.rank_strategies(S.strategy_gain(_evaluated(spark, d), ["segment"]), ["segment"])
    return S.balanced_choice(r, ["segment"])


@register("select_strategy", with_views(_EV + """
, slices AS (SELECT DISTINCT segment FROM order_audit)
SELECT s.segment, coalesce(r.strategy, 'Continuous Fairness Monitoring') AS selected_strategy,
       CASE WHEN r.strategy IS NULL THEN 'no results' ELSE 'balanced choice' END AS reason
FROM slices s LEFT JOIN (SELECT * FROM ranked2 WHERE rank = 1 AND accuracy_retention >= 0.98) r
  ON s.segment = r.segment""", "order_audit"))
def q_select_strategy(spark, d):
    """Only candidates keeping >= 98 % of baseline accuracy are eligible; a
    segment with none falls back to monitoring."""
    g = S.strategy_gain(_evaluated(spark, d), ["segment"])
    r = S.rank_strategies(g, ["segment"])
    eligible = r.where(F.col("rank") == 1).where(F.col("accuracy_retention") >= 0.98)
    slices = order_audit(spark, d).select("segment").distinct()
    return S.select_strategy(eligible, ["segment"], slices)


# strategy names as the recommender emits them for each month and attribute,
# re-cased and padded the way user input arrives
def _recommended(spark, d):
    from ..operators.rules import audit_rows, identify_bias
    a = identify_bias(audit_rows(order_audit(spark, d), "y_true", "y_pred", ["region", "segment"], ["period"]))
    return recommend(a, ["period", "attr"])


def _rec_sql() -> str:
    from .q_rules import _AUDIT, _strategy_values
    return _AUDIT + f"""
, rec AS (SELECT t.period, t.attr, st.strategy_rank, st.strategy
          FROM typed t LEFT JOIN {_strategy_values()} ON t.bias_type = st.bias_type),
  norm AS (SELECT period, attr, strategy_rank, '  ' || upper(strategy) || ' ' AS raw FROM rec),
  normed AS (SELECT *, CASE lower(trim(raw))
    WHEN 'reweighing' THEN 'Reweighing' WHEN 'data reweighing' THEN 'Reweighing'
    WHEN 'fairness constrained learning' THEN 'Fairness-Constrained Learning'
    WHEN 'fairness constraint' THEN 'Fairness-Constrained Learning'
    WHEN 'post-processing threshold optimization' THEN 'Post-Processing Threshold Optimization'
    WHEN 'equalized odds post-processing' THEN 'Equalized Odds Post-Processing'
    WHEN 'feature debiasing' THEN 'Feature Debiasing'
    WHEN 'feature removal or auditing' THEN 'Feature Removal or Auditing'
    ELSE trim(raw) END AS strategy FROM norm)
"""


def _normalized(spark, d):
    rec = _recommended(spark, d)
    raw = F.concat(F.lit("  "), F.upper("strategy"), F.lit(" "))
    return rec.select("period", "attr", "strategy_rank", raw.alias("raw")).withColumn(
        "strategy", S.normalize_strategy(F.col("raw")))


@register("normalize_strategy", with_views(_rec_sql() + """
SELECT period, attr, CAST(strategy_rank AS INT) AS strategy_rank, raw, strategy FROM normed""", "order_audit"))
def q_normalize_strategy(spark, d):
    return _normalized(spark, d)


@register("strategy_dedupe", with_views(_rec_sql() + """
SELECT period, strategy, CAST(position AS INT) AS position FROM (
  SELECT period, strategy, (CASE WHEN attr = 'region' THEN 0 ELSE 10 END) + strategy_rank AS position,
         row_number() OVER (PARTITION BY period, strategy
                            ORDER BY (CASE WHEN attr = 'region' THEN 0 ELSE 10 END) + strategy_rank) AS rn
  FROM normed) WHERE rn = 1""", "order_audit"))
def q_strategy_dedupe(spark, d):
    """Both attributes' recommendations for a month as one ordered list
    (region first), normalised, first occurrence kept."""
    n = _normalized(spark, d)
    pos = (F.when(F.col("attr") == "region", 0).otherwise(10) + F.col("strategy_rank")).cast("int")
    return S.dedupe(n.select("period", "strategy", pos.alias("position")), ["period"])


# ------------------------------------------------------------- model jobs
def model_input(spark, d):
    """order_audit prepared for training: one-hot groups, 0/1 target, split."""
    from .audit import prepare_dataset
    oa = order_audit(spark, d).select("row_id", "region", "segment", "priority", "o_totalprice",
                                      "c_acctbal", "y_true")
    return prepare_dataset(oa, target="y_true", sensitive="region", key="row_id", test_size=0.2, seed=42)


def _train_test(spark, d):
    from .audit import feature_columns
    p = model_input(spark, d)
    from ..session import materialize
    p = materialize(p)
    feats = feature_columns(p, "row_id")
    return p.where(F.col("split") == "train"), p.where(F.col("split") == "test"), feats


def _coefficients(spark, model, feats):
    lr = model.stages[-1]
    rows = [(f, float(c)) for f, c in zip(feats, lr.coefficients.toArray())] + [("(intercept)", float(lr.intercept))]
    return spark.createDataFrame(rows, "feature string, coefficient double")


@register("train_logistic")
def q_train_logistic(spark, d):
    tr, te, feats = _train_test(spark, d)
    return _coefficients(spark, MO.fit(tr, feats, MO.ModelSpec("logistic_regression")), feats)


@register("train_forest")
def q_train_forest(spark, d):
    tr, te, feats = _train_test(spark, d)
    m = MO.fit(tr, feats, MO.ModelSpec("random_forest"))
    imp = m.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(feats, imp)], "feature string, importance double")


@register("train_weighted")
def q_train_weighted(spark, d):
    from ..operators.mitigate import reweigh
    tr, te, feats = _train_test(spark, d)
    m = MO.fit(reweigh(tr, "sensitive", "y"), feats, MO.ModelSpec("logistic_regression"),
               sample_weight="sample_weight")
    return _coefficients(spark, m, feats)


@register("score")
def q_score(spark, d):
    tr, te, feats = _train_test(spark, d)
    m = MO.fit(tr, feats, MO.ModelSpec("logistic_regression"))
    return MO.score(m, te).select("row_id", "sensitive", "y", "y_pred", "p1")


def benchmark(train, test, feats, configs=None):
    """A row per model: accuracy and fairness on the test rows; one that cannot be
    fitted keeps a row with its ``error`` and null figures."""
    from ..functions.exprs import fairness_score
    errors: dict[str, str] = {}
    models = MO.train_many(train, feats, configs, errors=errors)
    failed = train.sparkSession.createDataFrame(
        list(errors.items()), "model_name string, error string")
    preds = None
    for name, m in models.items():
        p = MO.score(m, test).select("sensitive", "y", "y_pred", F.lit(name).alias("model"))
        preds = p if preds is None else preds.unionByName(p)
    if preds is None:
        none = F.lit(None).cast("double")
        return failed.select("model_name", *[none.alias(c) for c in ("accuracy", *FAIRNESS_COLS, "fairness_score")], "error")
    ev = evaluate_predictions(preds, "y", "y_pred", "sensitive", model_col="model")
    out = ev.select(F.col("model").alias("model_name"), "accuracy", *FAIRNESS_COLS,
                    fairness_score(F.col("demographic_parity_difference"), F.col("equalized_odds_difference"),
                                   F.col("disparate_impact_ratio"), cap=False).alias("fairness_score"),
                    F.lit(None).cast("string").alias("error"))
    return out.unionByName(failed, allowMissingColumns=True) if errors else out


def _benchmark(spark, d, configs):
    return benchmark(*_train_test(spark, d), configs)


@register("train_many")
def q_train_many(spark, d):
    return _benchmark(spark, d, None).select("model_name", "accuracy")


@register("model_benchmark")
def q_model_benchmark(spark, d):
    return _benchmark(spark, d, None)


@register("fair_constrained")
def q_fair_constrained(spark, d):
    tr, te, feats = _train_test(spark, d)
    base = MO.fit(tr, feats)
    cm = MO.fair_constrained(tr, feats, "sensitive", "y")
    preds = (MO.score(base, te).select("sensitive", "y", "y_pred", F.lit("baseline").alias("model"))
             .unionByName(cm.predict(te).select("sensitive", "y", "y_pred", F.lit("constrained").alias("model"))))
    return evaluate_predictions(preds, "y", "y_pred", "sensitive", model_col="model")


@register("feature_debias_train")
def q_feature_debias_train(spark, d):
    tr, te, feats = _train_test(spark, d)
    kept = MO.debiased_features(feats, "region", "wide")
    return _coefficients(spark, MO.fit(tr, kept), kept)


@register("apply_strategy")
def q_apply_strategy(spark, d):
    tr, te, feats = _train_test(spark, d)
    _, pred = MO.run_strategy(MO.REWEIGHING, tr, te, feats, "sensitive", "region")
    return pred.select("row_id", "sensitive", "y", "y_pred")


@register("evaluate_strategies")
def q_evaluate_strategies(spark, d):
    from .pipeline import evaluate_strategies
    tr, te, feats = _train_test(spark, d)
    return evaluate_strategies(tr, te, feats, ["Reweighing", "Post-Processing Threshold Optimization",
                                               "Equalized Odds Post-Processing", "Feature Debiasing",
                                               "Fairness-Constrained Learning"], sensitive_name="region")


@register("audit_pipeline")
def q_audit_pipeline(spark, d):
    """End to end on scored orders: sensitive = region, target = y_true."""
    from .pipeline import audit_pipeline
    oa = order_audit(spark, d).select("row_id", "region", "segment", "priority", "o_totalprice",
                                      "c_acctbal", "y_true")
    return audit_pipeline(oa, "y_true", "region", "row_id")
