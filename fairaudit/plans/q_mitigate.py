"""Queries for §2.8: weights, resampling, ROC and thresholds (model-free)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mitigate as MI
from ..operators import mixed_thresholds as MX
from ..sources.tables import order_audit
from .registry import register
from .views_sql import with_views


def _oa(spark, d):
    return order_audit(spark, d)


_W = """
, j AS (SELECT region AS grp, y_true AS y, count(*) AS n FROM order_audit GROUP BY 1, 2),
  w AS (SELECT grp, y, n, CAST(sum(n) OVER (PARTITION BY grp) AS DOUBLE) * sum(n) OVER (PARTITION BY y)
                          / (sum(n) OVER () * n) AS weight FROM j)
"""


@register("reweigh", with_views(_W + """
SELECT row_id, round(weight, 6) AS sample_weight FROM order_audit o JOIN w ON o.region = w.grp AND o.y_true = w.y""",
    "order_audit"))
def q_reweigh(spark, d):
    r = MI.reweigh(_oa(spark, d), "region", "y_true")
    return r.select("row_id", F.round("sample_weight", 6).alias("sample_weight"))


@register("reweigh_audit", with_views(_W + """
SELECT region AS grp, CAST(count(*) AS BIGINT) AS n, round(sum(weight * y_true) / sum(weight), 6) AS weighted_rate
FROM order_audit o JOIN w ON o.region = w.grp AND o.y_true = w.y GROUP BY region""", "order_audit"))
def q_reweigh_audit(spark, d):
    r = MI.reweigh(_oa(spark, d), "region", "y_true")
    return MI.weighted_rates(r, "region", "y_true", "sample_weight").select(
        "grp", "n", F.round("weighted_rate", 6).alias("weighted_rate"))


@register("class_balance_weights", with_views("""
, c AS (SELECT y_true AS y, count(*) AS n FROM order_audit GROUP BY 1)
SELECT y, CAST(n AS BIGINT) AS n, round(CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n), 6) AS class_weight
FROM c""", "order_audit"))
def q_class_balance_weights(spark, d):
    t = MI.class_weight_table(_oa(spark, d), "y_true")
    return t.select("y", "n", F.round("class_weight", 6).alias("class_weight"))


@register("resample", with_views("""
, j AS (SELECT region AS grp, y_true AS y, count(*) AS m FROM order_audit GROUP BY 1, 2),
  t AS (SELECT grp, y, m, (2 * sum(m) OVER (PARTITION BY grp) * sum(m) OVER (PARTITION BY y) + sum(m) OVER ())
                          // (2 * sum(m) OVER ()) AS t FROM j)
SELECT grp, y, CAST(m AS BIGINT) AS n_before, CAST(t AS BIGINT) AS n_after FROM t""", "order_audit"))
def q_resample(spark, d):
    oa = _oa(spark, d).select("row_id", "region", "y_true")
    before = oa.groupBy(F.col("region").alias("grp"), F.col("y_true").alias("y")).agg(
        F.count(F.lit(1)).alias("n_before"))
    after = MI.resample(oa, "region", "y_true", "row_id").groupBy(
        F.col("region").alias("grp"), F.col("y_true").alias("y")).agg(F.count(F.lit(1)).alias("n_after"))
    return before.join(after, ["grp", "y"])


_ROC = """
, bk AS (SELECT region AS grp, CAST(least(greatest(floor(score * 1000), 0), 1000) AS INT) AS b, y_true FROM order_audit),
  cnt AS (SELECT grp, b, sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS pos,
                 sum(CASE WHEN y_true = 1 THEN 0 ELSE 1 END) AS neg FROM bk GROUP BY 1, 2),
  lv AS (SELECT g.grp, CAST(s.b AS INT) AS b FROM (SELECT DISTINCT grp FROM cnt) g, generate_series(0, 1001) s(b)),
  c AS (SELECT lv.grp, lv.b, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg FROM lv LEFT JOIN cnt USING (grp, b)),
  roc AS (SELECT grp, b,
                 sum(pos) OVER (PARTITION BY grp ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS tp,
                 sum(neg) OVER (PARTITION BY grp ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS fp,
                 sum(pos) OVER (PARTITION BY grp) AS n_pos, sum(neg) OVER (PARTITION BY grp) AS n_neg FROM c),
  roc2 AS (SELECT *, n_pos + n_neg AS n, coalesce(CAST(tp AS DOUBLE) / nullif(n_pos, 0), 0) AS tpr,
                  coalesce(CAST(fp AS DOUBLE) / nullif(n_neg, 0), 0) AS fpr,
                  CAST(tp + fp AS DOUBLE) / (n_pos + n_neg) AS selection_rate, tp + n_neg - fp AS correct FROM roc)
"""


@register("group_roc", with_views(_ROC + """
SELECT grp, b, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr,
       round(selection_rate, 6) AS selection_rate FROM roc2""", "order_audit"))
def q_group_roc(spark, d):
    r = MI.group_roc(_oa(spark, d), "score", "y_true", "region")
    return r.select("grp", "b", "tp", "fp", *[F.round(c, 6).alias(c) for c in ("tpr", "fpr", "selection_rate")])


_PARITY = _ROC + """
, r AS (SELECT *, lead(selection_rate) OVER (PARTITION BY grp ORDER BY b) AS next_rate FROM roc2),
  r2 AS (SELECT *, CASE WHEN next_rate IS NULL THEN 0 ELSE CAST(floor(next_rate * 1000 + 1e-9) AS INT) + 1 END AS lo,
                CAST(floor(selection_rate * 1000 + 1e-9) AS INT) AS hi FROM r),
  served AS (SELECT grp, b, selection_rate, correct, n, CAST(i.i AS INT) AS i
             FROM r2, generate_series(r2.lo, r2.hi) i(i) WHERE r2.hi >= r2.lo),
  total AS (SELECT i, sum(correct) AS ct, count(*) AS k, sum(n) AS nt FROM served GROUP BY i),
  best AS (SELECT * FROM total WHERE k = (SELECT count(DISTINCT grp) FROM roc2) ORDER BY ct DESC, i LIMIT 1),
  th AS (SELECT s.grp, s.b, s.selection_rate, best.i, CAST(best.ct AS DOUBLE) / best.nt AS acc FROM served s JOIN best USING (i))
"""


@register("threshold_parity_levels", with_views(_PARITY + """
SELECT grp, b / 1000.0 AS threshold, b, round(selection_rate, 6) AS selection_rate, i / 1000.0 AS target_rate,
       round(acc, 6) AS accuracy FROM th""", "order_audit"))
def q_threshold_parity_levels(spark, d):
    roc = MI.group_roc(_oa(spark, d), "score", "y_true", "region")
    return MI.threshold_parity(roc)


@register("apply_group_threshold_levels", with_views(_PARITY + """
SELECT row_id, region, CAST(least(greatest(floor(score * 1000), 0), 1000) >= th.b AS INT) AS y_pred
FROM order_audit o JOIN th ON o.region = th.grp""", "order_audit"))
def q_apply_group_threshold_levels(spark, d):
    oa = _oa(spark, d)
    th = MI.threshold_parity(MI.group_roc(oa, "score", "y_true", "region"))
    return MI.apply_group_threshold(oa, th, "score", "region").select("row_id", "region", "y_pred")


@register("threshold_equalized_odds_levels")
def q_threshold_equalized_odds_levels(spark, d):
    roc = MI.group_roc(_oa(spark, d), "score", "y_true", "region")
    return MI.threshold_equalized_odds(roc)


_EXACT = """
, h AS (SELECT region AS grp, score AS threshold, sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS pos,
               sum(CASE WHEN y_true = 1 THEN 0 ELSE 1 END) AS neg FROM order_audit GROUP BY 1, 2),
  h2 AS (SELECT * FROM h UNION ALL SELECT DISTINCT grp, CAST('infinity' AS DOUBLE), 0, 0 FROM h),
  roc0 AS (SELECT grp, threshold,
                  sum(pos) OVER (PARTITION BY grp ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tp,
                  sum(neg) OVER (PARTITION BY grp ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fp,
                  sum(pos) OVER (PARTITION BY grp) AS n_pos, sum(neg) OVER (PARTITION BY grp) AS n_neg FROM h2),
  roc1 AS (SELECT *, n_pos + n_neg AS n, coalesce(CAST(tp AS DOUBLE) / nullif(n_pos, 0), 0) AS tpr,
                  coalesce(CAST(fp AS DOUBLE) / nullif(n_neg, 0), 0) AS fpr,
                  CAST(tp + fp AS DOUBLE) / (n_pos + n_neg) AS selection_rate, tp + n_neg - fp AS correct FROM roc0),
  roc AS (SELECT *, lead(selection_rate) OVER (PARTITION BY grp ORDER BY threshold) AS next_rate,
                 lead(fpr) OVER (PARTITION BY grp ORDER BY threshold) AS next_fpr FROM roc1)
"""

_EXACT_PARITY = _EXACT + """
, r AS (SELECT *, CASE WHEN next_rate IS NULL THEN 0 ELSE CAST(floor(next_rate * 1000 + 1e-9) AS INT) + 1 END AS lo,
               CAST(floor(selection_rate * 1000 + 1e-9) AS INT) AS hi FROM roc),
  served AS (SELECT r.*, CAST(i.i AS INT) AS i FROM r, generate_series(r.lo, r.hi) i(i) WHERE r.hi >= r.lo),
  total AS (SELECT i, sum(correct) AS ct, count(*) AS k, sum(n) AS nt FROM served GROUP BY i),
  best AS (SELECT * FROM total WHERE k = (SELECT count(DISTINCT grp) FROM roc) ORDER BY ct DESC, i LIMIT 1),
  th AS (SELECT s.grp, s.threshold, s.selection_rate, best.i, CAST(best.ct AS DOUBLE) / best.nt AS acc
         FROM served s JOIN best USING (i))
"""


def _roc_exact(spark, d):
    return MI.group_roc_exact(_oa(spark, d), "score", "y_true", "region")


@register("group_roc_exact", with_views(_EXACT + """
SELECT grp, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr,
       round(selection_rate, 6) AS selection_rate FROM roc WHERE threshold < CAST('infinity' AS DOUBLE)""", "order_audit"))
def q_group_roc_exact(spark, d):
    r = _roc_exact(spark, d).where(F.col("threshold") < float("inf"))
    return r.select("grp", "threshold", "tp", "fp", *[F.round(c, 6).alias(c) for c in ("tpr", "fpr", "selection_rate")])


@register("threshold_parity_exact", with_views(_EXACT_PARITY + """
SELECT grp, threshold, round(selection_rate, 6) AS selection_rate, i / 1000.0 AS target_rate, round(acc, 6) AS accuracy
FROM th""", "order_audit"))
def q_threshold_parity_exact(spark, d):
    return MI.threshold_parity_exact(_roc_exact(spark, d))


@register("apply_group_threshold_exact", with_views(_EXACT_PARITY + """
SELECT row_id, region, CAST(score >= th.threshold AS INT) AS y_pred
FROM order_audit o JOIN th ON o.region = th.grp""", "order_audit"))
def q_apply_group_threshold_exact(spark, d):
    th = MI.threshold_parity_exact(_roc_exact(spark, d))
    return MI.apply_group_threshold_exact(_oa(spark, d), th, "score", "region").select("row_id", "region", "y_pred")


@register("threshold_equalized_odds_exact", with_views(_EXACT + """
, r AS (SELECT *, CASE WHEN next_fpr IS NULL THEN 0 ELSE CAST(floor(next_fpr * 1000 + 1e-9) AS INT) + 1 END AS lo,
               CAST(floor(fpr * 1000 + 1e-9) AS INT) AS hi FROM roc),
  served AS (SELECT r.*, CAST(i.i AS INT) AS i FROM r, generate_series(r.lo, r.hi) i(i) WHERE r.hi >= r.lo),
  total AS (SELECT i, count(*) AS k, greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) AS gap,
                   CAST(sum(correct) AS DOUBLE) / sum(n) AS acc FROM served GROUP BY i),
  best AS (SELECT * FROM total WHERE k = (SELECT count(DISTINCT grp) FROM roc)
           ORDER BY gap <= 0.05 DESC, CASE WHEN gap <= 0.05 THEN -acc ELSE gap END, i LIMIT 1)
SELECT s.grp, s.threshold, round(s.tpr, 6) AS tpr, round(s.fpr, 6) AS fpr, round(best.gap, 6) AS eo_gap,
       round(best.acc, 6) AS accuracy FROM served s JOIN best USING (i)""", "order_audit"))
def q_threshold_equalized_odds_exact(spark, d):
    return MI.threshold_equalized_odds_exact(_roc_exact(spark, d))


# the hull by its definition: a point is a vertex iff every line from a point before
# it is steeper than every line to a point behind it
_HULL = _EXACT + """
, pt AS (SELECT *, tp + fp AS s FROM roc),
  up AS (SELECT b.grp, b.threshold, min(CAST(b.tp - a.tp AS DOUBLE) / (b.s - a.s)) AS m
         FROM pt a JOIN pt b ON a.grp = b.grp AND a.s < b.s GROUP BY 1, 2),
  dn AS (SELECT a.grp, a.threshold, max(CAST(b.tp - a.tp AS DOUBLE) / (b.s - a.s)) AS m
         FROM pt a JOIN pt b ON a.grp = b.grp AND a.s < b.s GROUP BY 1, 2),
  vertex AS (SELECT pt.* FROM pt LEFT JOIN up USING (grp, threshold) LEFT JOIN dn USING (grp, threshold)
             WHERE up.m IS NULL OR dn.m IS NULL OR up.m > dn.m),
  edge AS (SELECT grp, threshold, tpr, fpr, selection_rate AS rate, CAST(correct AS DOUBLE) AS correct, n_pos, n_neg, n,
                  lead(threshold) OVER w AS threshold_1, lead(tpr) OVER w AS tpr_1, lead(fpr) OVER w AS fpr_1,
                  lead(selection_rate) OVER w AS rate_1, CAST(lead(correct) OVER w AS DOUBLE) AS correct_1
           FROM vertex WINDOW w AS (PARTITION BY grp ORDER BY threshold DESC)),
  tot AS (SELECT sum(n) AS n, sum(n_pos) AS p, sum(n_neg) AS q FROM (SELECT DISTINCT grp, n, n_pos, n_neg FROM edge))
"""

_PARITY_MIX = _HULL + """
, xs AS (SELECT DISTINCT rate AS x FROM edge),
  val AS (SELECT x, sum(CASE WHEN rate_1 IS NULL OR x = rate THEN correct
                             ELSE correct + (x - rate) / (rate_1 - rate) * (correct_1 - correct) END) AS c
          FROM xs JOIN edge ON rate <= x AND (rate_1 IS NULL OR rate_1 > x) GROUP BY x),
  best AS (SELECT x, c FROM val ORDER BY round(c, 6) DESC, x LIMIT 1),
  mix AS (SELECT grp, threshold, threshold_1, c, x, CASE WHEN rate_1 IS NULL THEN 0 ELSE (x - rate) / (rate_1 - rate) END AS p1
          FROM edge JOIN best ON rate <= x AND (rate_1 IS NULL OR rate_1 > x))
"""


def _parity_mix(spark, d):
    return MX.parity_mixture(MX.group_hull(_oa(spark, d), "score", "y_true", "region"))


@register("group_roc_hull", with_views(_HULL + """
SELECT grp, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM vertex WHERE threshold < CAST('infinity' AS DOUBLE)""",
    "order_audit"))
def q_group_roc_hull(spark, d):
    h = MX.group_hull(_oa(spark, d), "score", "y_true", "region")
    return h.where(F.col("threshold") < float("inf")).select("grp", "threshold", "tp", "fp")


@register("threshold_parity", with_views(_PARITY_MIX + """
SELECT grp, round(1 - p1, 6) AS p0, threshold AS threshold0, round(p1, 6) AS p1,
       CASE WHEN p1 = 0 THEN threshold ELSE threshold_1 END AS threshold1, round(x, 6) AS selection_rate,
       round(x, 6) AS target_rate, round(c / tot.n, 6) AS accuracy FROM mix, tot""", "order_audit"))
def q_threshold_parity(spark, d):
    m = _parity_mix(spark, d)
    return m.select("grp", "threshold0", "threshold1",
                    *[F.round(c, 6).alias(c) for c in ("p0", "p1", "selection_rate", "target_rate", "accuracy")])


@register("apply_group_threshold", with_views(_PARITY_MIX + """
, drawn AS (SELECT row_id, region, score, CAST(CAST('0x' || substr(md5('42:' || row_id), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656 AS u
            FROM order_audit)
SELECT row_id, region, CAST(u < CASE WHEN score >= threshold THEN 1 - p1 ELSE 0 END
                              + CASE WHEN score >= CASE WHEN p1 = 0 THEN threshold ELSE threshold_1 END THEN p1 ELSE 0 END AS INT) AS y_pred
FROM drawn JOIN mix ON region = grp""", "order_audit"))
def q_apply_group_threshold(spark, d):
    return MX.apply_mixture(_oa(spark, d), _parity_mix(spark, d), "score", "region", "row_id").select("row_id", "region", "y_pred")


@register("threshold_equalized_odds", with_views(_HULL + """
, xs AS (SELECT DISTINCT fpr AS x FROM edge),
  step AS (SELECT x AS x0, lead(x) OVER (ORDER BY x) AS x1 FROM xs),
  line AS (SELECT x0, x1, grp, tpr + (x0 - fpr) / (fpr_1 - fpr) * (tpr_1 - tpr) AS y0, (tpr_1 - tpr) / (fpr_1 - fpr) AS m
           FROM step JOIN edge ON fpr <= x0 AND fpr_1 > x0),
  crossing AS (SELECT a.x0 + (b.y0 - a.y0) / (a.m - b.m) AS x, a.x0, a.x1
               FROM line a JOIN line b ON a.x0 = b.x0 AND a.grp < b.grp AND a.m <> b.m),
  cand AS (SELECT x FROM xs UNION SELECT x FROM crossing WHERE x > x0 + 1e-12 AND x < x1 - 1e-12),
  val AS (SELECT x, min(CASE WHEN fpr_1 IS NULL THEN tpr ELSE tpr + (x - fpr) / (fpr_1 - fpr) * (tpr_1 - tpr) END) AS y
          FROM cand JOIN edge ON fpr <= x AND (fpr_1 IS NULL OR fpr_1 > x) GROUP BY x),
  best AS (SELECT x, y AS low, (p * y + q * (1 - x)) / (p + q) AS acc FROM val, tot
           ORDER BY round((p * y + q * (1 - x)) / (p + q), 12) DESC, x LIMIT 1),
  placed AS (SELECT grp, threshold, threshold_1, x, low, acc, CASE WHEN fpr_1 IS NULL THEN 0 ELSE (x - fpr) / (fpr_1 - fpr) END AS p1,
                CASE WHEN fpr_1 IS NULL THEN tpr ELSE tpr + (x - fpr) / (fpr_1 - fpr) * (tpr_1 - tpr) END AS y
         FROM best JOIN edge ON fpr <= x AND (fpr_1 IS NULL OR fpr_1 > x))
SELECT grp, round(1 - p1, 6) AS p0, threshold AS threshold0, round(p1, 6) AS p1,
       CASE WHEN p1 = 0 THEN threshold ELSE threshold_1 END AS threshold1,
       round(CASE WHEN y - low > 1e-12 THEN (y - low) / (y - x) ELSE 0 END, 6) AS p_ignore,
       round(x, 6) AS prediction_constant, round(x, 6) AS fpr, round(low, 6) AS tpr, CAST(0 AS DOUBLE) AS eo_gap, round(acc, 6) AS accuracy
FROM placed""", "order_audit"))
def q_threshold_equalized_odds(spark, d):
    m = MX.equalized_odds_mixture(MX.group_hull(_oa(spark, d), "score", "y_true", "region"))
    return m.select("grp", "threshold0", "threshold1",
                    *[F.round(c, 6).alias(c) for c in ("p0", "p1", "p_ignore", "prediction_constant", "fpr", "tpr", "eo_gap", "accuracy")])
