"""Queries for §2.6: proxy-feature correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import proxy as X
from ..sources.tables import line_features, order_audit
from .registry import register
from .views_sql import with_views

_LF = ["l_orderkey", "l_linenumber", "sens", "qty", "status", "sens_nullable", "proxy_qty",
       "price", "discount", "tax", "constant_f", "y_true"]
_FEATS = [c for c in _LF if c != "sens"]
_TEXT = {"status", "sens_nullable"}

_CODED = """
, coded AS (
  SELECT *, CAST(dense_rank() OVER (ORDER BY sens) - 1 AS DOUBLE) AS s_code,
         CAST(dense_rank() OVER (ORDER BY coalesce(status, 'Unknown')) - 1 AS DOUBLE) AS status_code,
         CAST(dense_rank() OVER (ORDER BY coalesce(sens_nullable, 'Unknown')) - 1 AS DOUBLE) AS sens_nullable_code
  FROM line_features
), pairs AS (
""" + "\n  UNION ALL\n".join(
    f"  SELECT '{c}' AS feature, {_LF.index(c)} AS position, "
    f"{c + '_code' if c in _TEXT else f'CAST({c} AS DOUBLE)'} AS x, s_code AS s FROM coded"
    for c in _FEATS) + """
), valid AS (SELECT * FROM pairs WHERE x IS NOT NULL AND s IS NOT NULL)
"""

_PEARSON = _CODED + """
, corr AS (
  SELECT feature, position, covar_pop(x, s) / nullif(stddev_pop(x) * stddev_pop(s), 0) AS r
  FROM valid GROUP BY feature, position
)
"""

_SPEARMAN = _CODED + """
, ranked AS (
  SELECT feature, position,
         rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY feature ORDER BY s) + (count(*) OVER (PARTITION BY feature, s) - 1) / 2.0 AS rs
  FROM valid
), corr AS (
  SELECT feature, position, covar_pop(rx, rs) / nullif(stddev_pop(rx) * stddev_pop(rs), 0) AS r
  FROM ranked GROUP BY feature, position
)
"""


def _lf(spark, d):
    return line_features(spark, d)


@register("proxy_corr_pearson", with_views(_PEARSON + """
SELECT feature, position, round(r, 6) AS correlation FROM corr WHERE r IS NOT NULL AND NOT isnan(r)""",
    "line_features"))
def q_pearson(spark, d):
    c = X.pearson(_lf(spark, d), "sens")
    return c.select("feature", "position", F.round("correlation", 6).alias("correlation"))


@register("proxy_corr_spearman", with_views(_SPEARMAN + """
SELECT feature, position, round(r, 6) AS correlation FROM corr WHERE r IS NOT NULL AND NOT isnan(r)""",
    "line_features"))
def q_spearman(spark, d):
    c = X.spearman(_lf(spark, d), "sens")
    return c.select("feature", "position", F.round("correlation", 6).alias("correlation"))


@register("proxy_corr_spearman_numeric", with_views("""
, pairs AS (SELECT 'o_totalprice' AS feature, 1 AS position, o_totalprice AS x, c_acctbal AS s FROM order_audit
            UNION ALL SELECT 'n_regionkey', 2, CAST(n_regionkey AS DOUBLE), c_acctbal FROM order_audit
            UNION ALL SELECT 'y_pred', 3, CAST(y_pred AS DOUBLE), c_acctbal FROM order_audit),
  valid AS (SELECT * FROM pairs WHERE x IS NOT NULL AND s IS NOT NULL),
  ranked AS (
    SELECT feature, position,
           rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx,
           rank() OVER (PARTITION BY feature ORDER BY s) + (count(*) OVER (PARTITION BY feature, s) - 1) / 2.0 AS rs
    FROM valid)
SELECT feature, position, round(covar_pop(rx, rs) / nullif(stddev_pop(rx) * stddev_pop(rs), 0), 6) AS correlation
FROM ranked GROUP BY feature, position""", "order_audit"))
def q_spearman_numeric(spark, d):
    """A sensitive column with a value per customer."""
    oa = order_audit(spark, d).select("c_acctbal", "o_totalprice", "n_regionkey", "y_pred")
    c = X.spearman(oa, "c_acctbal")
    return c.select("feature", "position", F.round("correlation", 6).alias("correlation"))


# Kendall: an exact SQL form would enumerate all row pairs (3.6e9 at sf0.01),
# so it is checked against brute-force pair counting on a small fixture in
# tests/test_invariants.py instead of by an oracle here.
@register("proxy_corr_kendall")
def q_kendall(spark, d):
    c = X.kendall(_lf(spark, d), "sens")
    return c.select("feature", "position", F.round("correlation", 6).alias("correlation"))


@register("proxy_corr_kendall_numeric")
def q_kendall_numeric(spark, d):
    """A sensitive column with a value per customer."""
    oa = order_audit(spark, d).select("c_acctbal", "o_totalprice", "n_regionkey", "y_pred")
    c = X.kendall(oa, "c_acctbal")
    return c.select("feature", "position", F.round("correlation", 6).alias("correlation"))


@register("proxy_top_k", with_views(_PEARSON + """
, top AS (SELECT feature, position, r, row_number() OVER (ORDER BY abs(r) DESC, position) AS rk
          FROM corr WHERE r IS NOT NULL AND NOT isnan(r))
SELECT feature, position, round(r, 6) AS correlation, CAST(rk AS INT) AS rank FROM top WHERE rk <= 5""",
    "line_features"))
def q_top_k(spark, d):
    t = X.top_k(X.pearson(_lf(spark, d), "sens"), 5)
    return t.select("feature", "position", F.round("correlation", 6).alias("correlation"),
                    F.col("rank").cast("int").alias("rank"))


@register("proxy_flag", with_views(_PEARSON + """
, top AS (SELECT feature, position, r, row_number() OVER (ORDER BY abs(r) DESC, position) AS rk
          FROM corr WHERE r IS NOT NULL AND NOT isnan(r))
SELECT feature, round(r, 6) AS correlation, abs(round(r, 6)) AS abs_correlation
FROM top WHERE rk <= 5 AND abs(round(r, 6)) >= 0.5""", "line_features"))
def q_flag(spark, d):
    f = X.flag(X.top_k(X.pearson(_lf(spark, d), "sens"), 5), 0.5)
    return f.select("feature", F.round("correlation", 6).alias("correlation"), "abs_correlation")


@register("proxy_top_k_sliced", with_views("""
, coded AS (SELECT *, CAST(dense_rank() OVER (ORDER BY region) - 1 AS DOUBLE) AS s FROM order_audit),
  pairs AS (SELECT segment, 'o_totalprice' AS feature, 1 AS position, o_totalprice AS x, s FROM coded
            UNION ALL SELECT segment, 'c_acctbal', 2, c_acctbal, s FROM coded
            UNION ALL SELECT segment, 'n_regionkey', 3, CAST(n_regionkey AS DOUBLE), s FROM coded
            UNION ALL SELECT segment, 'y_pred', 4, CAST(y_pred AS DOUBLE), s FROM coded),
  corr AS (SELECT segment, feature, position, covar_pop(x, s) / nullif(stddev_pop(x) * stddev_pop(s), 0) AS r
           FROM pairs WHERE x IS NOT NULL GROUP BY 1, 2, 3),
  top AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY abs(r) DESC, position) AS rk
          FROM corr WHERE r IS NOT NULL AND NOT isnan(r))
SELECT segment, feature, round(r, 6) AS correlation, CAST(rk AS INT) AS rank FROM top WHERE rk <= 3""",
    "order_audit"))
def q_top_k_sliced(spark, d):
    """Top 3 proxies of region per customer segment (codes of the whole table)."""
    from ..sources.tables import order_audit
    oa = order_audit(spark, d).select("region", "o_totalprice", "c_acctbal", "n_regionkey", "y_pred", "segment")
    c = X.pearson(oa, "region", ["o_totalprice", "c_acctbal", "n_regionkey", "y_pred"], slice_cols=["segment"])
    t = X.top_k(c, 3, keys=["segment"])
    return t.select("segment", "feature", F.round("correlation", 6).alias("correlation"),
                    F.col("rank").cast("int").alias("rank"))


@register("proxy_corr_spearman_sliced", with_views("""
, coded AS (SELECT *, CAST(dense_rank() OVER (ORDER BY region) - 1 AS DOUBLE) AS s FROM order_audit),
  pairs AS (SELECT segment, 'o_totalprice' AS feature, 1 AS position, o_totalprice AS x, s FROM coded
            UNION ALL SELECT segment, 'c_acctbal', 2, c_acctbal, s FROM coded
            UNION ALL SELECT segment, 'y_pred', 4, CAST(y_pred AS DOUBLE), s FROM coded),
  ranked AS (SELECT segment, feature, position,
                    rank() OVER (PARTITION BY segment, feature ORDER BY x)
                      + (count(*) OVER (PARTITION BY segment, feature, x) - 1) / 2.0 AS rx,
                    rank() OVER (PARTITION BY segment, feature ORDER BY s)
                      + (count(*) OVER (PARTITION BY segment, feature, s) - 1) / 2.0 AS rs
             FROM pairs WHERE x IS NOT NULL),
  corr AS (SELECT segment, feature, position, covar_pop(rx, rs) / nullif(stddev_pop(rx) * stddev_pop(rs), 0) AS r
           FROM ranked GROUP BY 1, 2, 3)
SELECT segment, feature, position, round(r, 6) AS correlation FROM corr WHERE r IS NOT NULL AND NOT isnan(r)""",
    "order_audit"))
def q_spearman_sliced(spark, d):
    """Spearman correlation with region per customer segment."""
    from ..sources.tables import order_audit
    oa = order_audit(spark, d).select("region", "o_totalprice", "c_acctbal", "n_regionkey", "y_pred", "segment")
    c = X.spearman(oa, "region", ["o_totalprice", "c_acctbal", "y_pred"], slice_cols=["segment"])
    return c.select("segment", "feature", "position", F.round("correlation", 6).alias("correlation"))
