"""Queries for §2.7: rules, bias type, diagnosis and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import proxy as X
from ..operators import rules as R
from ..operators.metrics import distribution_summary
from ..sources.tables import line_features, order_audit
from .registry import register
from .views_sql import with_views

# ------------------------------------------------------------- audit rows
_AUDIT = """
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
), audit AS (
  SELECT period, attr, abs(max(sr) - min(sr)) AS dp,
         abs(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr))) AS eo,
         CASE WHEN max(sr) = 0 THEN 1.0 ELSE min(sr) / max(sr) END AS di,
         CASE WHEN count(*) >= 2 AND max(n) > 0 THEN CAST(min(n) AS DOUBLE) / max(n) END AS r
  FROM rates GROUP BY period, attr
), sig AS (
  SELECT *,
    CASE WHEN di < 0.8 THEN least(1.0, (0.8 - di) / 0.4) END AS s1,
    CASE WHEN dp >= 0.1 THEN least(1.0, dp / 0.5) END AS s2,
    CASE WHEN eo >= 0.1 THEN least(1.0, eo / 0.5) END AS s3,
    CASE WHEN r IS NOT NULL AND r < 0.5 THEN least(1.0, (0.5 - r) / 0.5) END AS s4,
    CASE WHEN dp >= 0.2 AND eo < 0.1 AND di < 1.0 THEN least(1.0, dp / 0.6) END AS s5
  FROM audit
), scored AS (
  SELECT *,
    CASE WHEN di < 0.8 OR dp >= 0.1 THEN greatest(greatest(0.0, least(1.0, (0.8 - di) / 0.4)),
                                                  greatest(0.0, least(1.0, dp / 0.5))) ELSE 0.0 END AS c_sel,
    CASE WHEN eo >= 0.1 THEN greatest(0.0, least(1.0, eo / 0.5)) ELSE 0.0 END AS c_pred,
    CASE WHEN r IS NOT NULL AND r < 0.5 THEN greatest(0.0, least(1.0, (0.5 - r) / 0.5)) ELSE 0.0 END AS c_hist,
    CASE WHEN dp >= 0.2 AND eo < 0.1 AND di < 1.0 THEN greatest(0.0, least(1.0, dp / 0.6)) ELSE 0.0 END AS c_proxy,
    (s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT + (s4 IS NOT NULL)::INT
      + (s5 IS NOT NULL)::INT AS k,
    greatest(coalesce(s1, 0), coalesce(s2, 0), coalesce(s3, 0), coalesce(s4, 0), coalesce(s5, 0)) AS smax,
    coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0) + coalesce(s4, 0) + coalesce(s5, 0) AS ssum
  FROM sig
), typed AS (
  SELECT *,
    CASE WHEN greatest(c_sel, c_pred, c_hist, c_proxy) < 0.2 AND k = 0 THEN 'No Significant Bias'
         WHEN c_sel >= greatest(c_pred, c_hist, c_proxy) THEN 'Selection Bias'
         WHEN c_pred >= greatest(c_hist, c_proxy) THEN 'Prediction Bias'
         WHEN c_hist >= c_proxy THEN 'Historical Bias'
         ELSE 'Proxy Bias' END AS bias_type,
    CASE WHEN k = 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, 0.7 * smax + 0.3 * ssum / k)), 3) END AS severity
  FROM scored
)
"""


def _audit(spark, d):
    return R.audit_rows(order_audit(spark, d), "y_true", "y_pred", ["region", "segment"], ["period"])


_KEYS = ["period", "attr"]


@register("bias_rules", with_views(_AUDIT + "\n" + "\nUNION ALL\n".join(
    f"SELECT period, attr, '{k}' AS rule, '{R.RULE_TEXT[k]}' AS message, round(s{i + 1}, 6) AS strength "
    f"FROM sig WHERE s{i + 1} IS NOT NULL" for i, k in enumerate(R.RULE_ORDER)), "order_audit"))
def q_bias_rules(spark, d):
    r = R.rules_long(_audit(spark, d), _KEYS)
    return r.select(*_KEYS, "rule", "message", F.round("strength", 6).alias("strength"))


@register("bias_category_scores", with_views(_AUDIT + """
SELECT period, attr, round(c_sel, 6) AS score_selection, round(c_pred, 6) AS score_prediction,
       round(c_hist, 6) AS score_historical, round(c_proxy, 6) AS score_proxy FROM scored""", "order_audit"))
def q_bias_category_scores(spark, d):
    b = R.identify_bias(_audit(spark, d))
    return b.select(*_KEYS, *[F.round(f"score_{n}", 6).alias(f"score_{n}")
                             for n in ("selection", "prediction", "historical", "proxy")])


@register("bias_type", with_views(_AUDIT + """
SELECT period, attr, bias_type AS detected_bias_type, CAST(k AS INT) AS n_triggered FROM typed""",
    "order_audit"))
def q_bias_type(spark, d):
    return R.identify_bias(_audit(spark, d)).select(*_KEYS, "detected_bias_type", "n_triggered")


@register("bias_severity_score", with_views(_AUDIT + """
SELECT period, attr, severity AS severity_score FROM typed""", "order_audit"))
def q_bias_severity_score(spark, d):
    return R.identify_bias(_audit(spark, d)).select(*_KEYS, "severity_score")


_RULES_JOINED = " || ' | ' || ".join(
    f"coalesce(CASE WHEN s{i + 1} IS NOT NULL THEN '{R.RULE_TEXT[k]}' END, '')" for i, k in enumerate(R.RULE_ORDER))


@register("bias_explanation", with_views(_AUDIT + f"""
, j AS (SELECT *, concat_ws(' | ', {", ".join(f"CASE WHEN s{i + 1} IS NOT NULL THEN '{R.RULE_TEXT[k]}' END" for i, k in enumerate(R.RULE_ORDER))}) AS rules
        FROM typed)
SELECT period, attr, rules AS triggered_rules,
  CASE WHEN bias_type = 'No Significant Bias' THEN '{R.NO_BIAS_TEXT}'
  ELSE concat_ws('; ', 'Detected ' || bias_type || ' based on threshold rules.',
                 'Demographic parity difference=' || printf('%.3f', dp),
                 'Equalized odds difference=' || printf('%.3f', eo),
                 'Disparate impact ratio=' || printf('%.3f', di),
                 CASE WHEN r IS NOT NULL THEN 'Sensitive distribution imbalance ratio=' || printf('%.3f', r) END,
                 CASE WHEN k > 0 THEN 'Triggered rules: ' || rules END) END AS explanation
FROM j""", "order_audit"))
def q_bias_explanation(spark, d):
    return R.identify_bias(_audit(spark, d)).select(*_KEYS, "triggered_rules", "explanation")


@register("supporting_metrics", with_views(_AUDIT + """
SELECT period, attr, round(dp, 6) AS demographic_parity_difference, round(eo, 6) AS equalized_odds_difference,
       round(di, 6) AS disparate_impact_ratio, round(r, 6) AS distribution_imbalance_ratio FROM audit""",
    "order_audit"))
def q_supporting_metrics(spark, d):
    b = R.identify_bias(_audit(spark, d))
    return b.select(*_KEYS, *[F.col(f"sm_{c}").alias(c) for c in (
        "demographic_parity_difference", "equalized_odds_difference", "disparate_impact_ratio",
        "distribution_imbalance_ratio")])


@register("severity_label", with_views(_AUDIT + """
SELECT period, attr, CASE WHEN k = 0 THEN 'Low'
  WHEN 0.7 * smax + 0.3 * ssum / k >= 0.67 THEN 'High'
  WHEN 0.7 * smax + 0.3 * ssum / k >= 0.34 THEN 'Medium' ELSE 'Low' END AS severity FROM typed""",
    "order_audit"))
def q_severity_label(spark, d):
    a = _audit(spark, d)
    sig = R.signal_strengths()
    st = F.array_compact(F.array(*[sig[k] for k in R.RULE_ORDER]))
    n = F.size(st)
    comb = 0.7 * F.array_max(st) + 0.3 * F.aggregate(st, F.lit(0.0), lambda acc, x: acc + x) / n
    return a.select(*_KEYS, F.when(n == 0, "Low").otherwise(R.severity_label(comb)).alias("severity"))


def _strategy_values() -> str:
    rows = []
    for bt, recs in R.STRATEGY_MAP.items():
        for i, (name, reason) in enumerate(recs):
            rows.append(f"('{bt}', {i + 1}, '{name}', '{reason}')")
    return "(VALUES " + ", ".join(rows) + ") AS st(bias_type, strategy_rank, strategy, reason)"


@register("recommend_strategies", with_views(_AUDIT + f"""
, t AS (SELECT period, attr, '  ' || upper(bias_type) AS raw FROM typed),
  c AS (SELECT period, attr, CASE lower(trim(raw))
          WHEN 'selection bias' THEN 'Selection Bias' WHEN 'prediction bias' THEN 'Prediction Bias'
          WHEN 'historical bias' THEN 'Historical Bias' WHEN 'proxy bias' THEN 'Proxy Bias'
          ELSE 'No Significant Bias' END AS bias_type FROM t)
SELECT c.period, c.attr, c.bias_type, CAST(strategy_rank AS INT) AS strategy_rank, strategy, reason
FROM c LEFT JOIN {_strategy_values()} ON c.bias_type = st.bias_type""", "order_audit"))
def q_recommend_strategies(spark, d):
    b = R.identify_bias(_audit(spark, d))
    raw = b.select(*_KEYS, F.concat(F.lit("  "), F.upper("detected_bias_type")).alias("raw"))
    return R.recommend(raw, _KEYS, "raw")


# ------------------------------------------------------------ diagnosis
_LF_FEATS = ["l_orderkey", "l_linenumber", "qty", "status", "sens_nullable", "proxy_qty", "price",
             "discount", "tax", "constant_f"]
_LF_ALL = ["l_orderkey", "l_linenumber", "sens", "qty", "status", "sens_nullable", "proxy_qty",
           "price", "discount", "tax", "constant_f", "y_true"]
_TEXT = {"status", "sens_nullable"}

_DIAG = """
, dist AS (SELECT coalesce(sens, 'Unknown') AS g, count(*) AS n,
                  round(avg(CASE WHEN y_true = 1 THEN 1.0 ELSE 0.0 END), 6) AS sr
           FROM line_features GROUP BY 1),
  summ AS (SELECT CASE WHEN count(*) >= 2 AND max(n) > 0 THEN CAST(min(n) AS DOUBLE) / max(n) END AS r,
                  CASE WHEN count(*) >= 2 THEN max(sr) - min(sr) END AS gap FROM dist),
  coded AS (
    SELECT *, CAST(dense_rank() OVER (ORDER BY sens) - 1 AS DOUBLE) AS s_code,
           CAST(dense_rank() OVER (ORDER BY coalesce(status, 'Unknown')) - 1 AS DOUBLE) AS status_code,
           CAST(dense_rank() OVER (ORDER BY coalesce(sens_nullable, 'Unknown')) - 1 AS DOUBLE) AS sens_nullable_code
    FROM line_features),
  pairs AS (""" + "\n  UNION ALL\n".join(
    f"    SELECT '{c}' AS feature, {_LF_ALL.index(c)} AS position, "
    f"{c + '_code' if c in _TEXT else f'CAST({c} AS DOUBLE)'} AS x, s_code AS s FROM coded"
    for c in _LF_FEATS) + """),
  corr AS (SELECT feature, position, covar_pop(x, s) / nullif(stddev_pop(x) * stddev_pop(s), 0) AS cr
           FROM pairs WHERE x IS NOT NULL AND s IS NOT NULL GROUP BY feature, position),
  top AS (SELECT feature, cr, row_number() OVER (ORDER BY abs(cr) DESC, position) AS rk
          FROM corr WHERE cr IS NOT NULL AND NOT isnan(cr)),
  flagged AS (SELECT feature, abs(round(cr, 6)) AS c FROM top
              WHERE rk <= 5 AND abs(round(cr, 6)) >= 0.5 ORDER BY rk LIMIT 1),
  causes AS (
    SELECT 'Historical Bias' AS bt, 0 AS pr, least(1.0, (0.5 - r) / 0.5) AS st,
           'Group distribution is highly imbalanced across the sensitive attribute.' AS cause
    FROM summ WHERE r IS NOT NULL AND r < 0.5
    UNION ALL
    SELECT 'Selection Bias', 1, least(1.0, gap / 0.25), 'Unequal selection rates across sensitive groups.'
    FROM summ WHERE gap IS NOT NULL AND gap >= 0.15
    UNION ALL
    SELECT 'Proxy Bias', 2, least(1.0, c / 0.7), 'High correlation of ' || feature || ' with the sensitive attribute.'
    FROM flagged)
"""


@register("root_cause_diagnosis", with_views(_DIAG + """
SELECT 'sens' AS attr,
       coalesce((SELECT bt FROM causes ORDER BY st DESC, pr LIMIT 1), 'No Significant Bias') AS bias_type,
       coalesce((SELECT string_agg(cause, ' | ' ORDER BY pr) FROM causes), '') AS root_causes,
       CAST((SELECT count(*) FROM causes) AS INT) AS n_causes,
       CASE WHEN (SELECT count(*) FROM causes) = 0 THEN 'Low'
            WHEN (SELECT 0.7 * max(st) + 0.3 * avg(st) FROM causes) >= 0.67 THEN 'High'
            WHEN (SELECT 0.7 * max(st) + 0.3 * avg(st) FROM causes) >= 0.34 THEN 'Medium'
            ELSE 'Low' END AS severity""", "line_features"))
def q_root_cause_diagnosis(spark, d):
    lf = line_features(spark, d)
    summ = distribution_summary(lf, "y_true", "sens").drop("_all")
    top = X.top_k(X.pearson(lf.drop("y_true"), "sens"), 5).withColumn("attr", F.lit("sens"))
    return R.diagnose(summ, ["attr"], top)
