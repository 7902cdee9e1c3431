"""Queries for §2.10: attribution aggregates (SQL-checked on the
contributions view) and TreeSHAP on a trained forest (rows; its local-
accuracy invariant is tested)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explain as E
from ..sources.tables import contributions
from .registry import register
from .views_sql import with_views


def _contrib(spark, d):
    return contributions(spark, d)


@register("global_importance", with_views("""
SELECT feature, avg(abs(contribution)) AS mean_abs_shap FROM contributions
GROUP BY feature ORDER BY mean_abs_shap DESC, feature LIMIT 10""", "contributions"))
def q_global_importance(spark, d):
    return E.global_importance(_contrib(spark, d), 10)


_PROFILE_ABS = """
, profile AS (SELECT CAST(region AS VARCHAR) AS grp, feature, round(avg(abs(contribution)), 6) AS mean_contribution
              FROM contributions WHERE region IS NOT NULL GROUP BY 1, 2)
"""
_PROFILE_SIGNED = """
, profile AS (SELECT CAST(region AS VARCHAR) AS grp, feature, round(avg(contribution), 6) AS mean_contribution
              FROM contributions WHERE region IS NOT NULL GROUP BY 1, 2)
"""


@register("group_importance", with_views(_PROFILE_ABS + "SELECT * FROM profile", "contributions"))
def q_group_importance(spark, d):
    return E.group_importance(_contrib(spark, d), "region")


@register("group_importance_signed", with_views(_PROFILE_SIGNED + "SELECT * FROM profile", "contributions"))
def q_group_importance_signed(spark, d):
    return E.group_importance(_contrib(spark, d), "region", use_absolute_values=False)


@register("group_spread", with_views(_PROFILE_ABS + """
SELECT feature, max(mean_contribution) - min(mean_contribution) AS group_spread FROM profile
GROUP BY feature ORDER BY group_spread DESC, feature LIMIT 10""", "contributions"))
def q_group_spread(spark, d):
    return E.group_spread(E.group_importance(_contrib(spark, d), "region"), 10)


def _insights_sql(profile: str, threshold: float, top_n: int) -> str:
    f = "trim(replace(a.feature, '_', ' '))"
    return profile + f"""
, pairs AS (
  SELECT a.feature, a.grp AS ga, b.grp AS gb, a.mean_contribution AS va, b.mean_contribution AS vb,
         abs(a.mean_contribution - b.mean_contribution) AS diff,
         CASE WHEN a.mean_contribution < 0 AND b.mean_contribution < 0 THEN
                {f} || ' has a higher negative impact on ' ||
                (CASE WHEN abs(a.mean_contribution) > abs(b.mean_contribution) THEN a.grp ELSE b.grp END) ||
                ' candidates than on ' ||
                (CASE WHEN abs(a.mean_contribution) > abs(b.mean_contribution) THEN b.grp ELSE a.grp END) || ' candidates.'
              WHEN a.mean_contribution >= 0 AND b.mean_contribution >= 0 THEN
                {f} || ' influences ' ||
                (CASE WHEN abs(a.mean_contribution) > abs(b.mean_contribution) THEN a.grp ELSE b.grp END) ||
                ' candidates more strongly than ' ||
                (CASE WHEN abs(a.mean_contribution) > abs(b.mean_contribution) THEN b.grp ELSE a.grp END) || ' candidates.'
              WHEN a.mean_contribution < b.mean_contribution THEN
                {f} || ' has a more negative effect on ' || a.grp || ' candidates than on ' || b.grp || ' candidates.'
              ELSE {f} || ' has a more negative effect on ' || b.grp || ' candidates than on ' || a.grp || ' candidates.'
         END AS insight
  FROM profile a JOIN profile b ON a.feature = b.feature AND a.grp < b.grp
  WHERE abs(a.mean_contribution - b.mean_contribution) >= {threshold}
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY lower(insight) ORDER BY diff DESC, feature, ga, gb) AS d FROM pairs
), top AS (
  SELECT * FROM firsts WHERE d = 1 ORDER BY diff DESC, feature, ga, gb LIMIT {top_n}
)
SELECT CAST(row_number() OVER (ORDER BY diff DESC, feature, ga, gb) AS INT) AS rank, insight FROM top
UNION ALL
SELECT 1, '{E.NO_INSIGHT}' WHERE NOT EXISTS (SELECT 1 FROM top)"""


@register("pairwise_insights", with_views(_insights_sql(_PROFILE_SIGNED, 0.04, 10), "contributions"))
def q_pairwise_insights(spark, d):
    prof = E.group_importance(_contrib(spark, d), "region", use_absolute_values=False)
    return E.pairwise_insights(prof, 10, 0.04).select(F.col("rank").cast("int").alias("rank"), "insight")


@register("pairwise_insights_abs", with_views(_insights_sql(_PROFILE_ABS, 0.06, 5), "contributions"))
def q_pairwise_insights_abs(spark, d):
    prof = E.group_importance(_contrib(spark, d), "region")
    return E.pairwise_insights(prof, 5, 0.06).select(F.col("rank").cast("int").alias("rank"), "insight")


@register("tree_contributions")
def q_tree_contributions(spark, d):
    """TreeSHAP of a 20-tree, depth-6 forest on the prepared orders (test
    split): per row the expected value, the forest probability and the sum
    of contributions (local accuracy: expected + sum = p1)."""
    from ..operators import models as MO
    from .q_strategies import _train_test
    tr, te, feats = _train_test(spark, d)
    rf = MO.fit(tr, feats, MO.ModelSpec("random_forest", params={"numTrees": 20, "maxDepth": 6}))
    c = E.tree_contributions(te, rf, feats, ["row_id", "sensitive"])
    return c.select("row_id", "sensitive", F.round("expected_value", 6).alias("expected_value"),
                    F.round("p1", 6).alias("p1"),
                    F.round(F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x), 6).alias("sum_contributions"))


@register("tree_group_importance")
def q_tree_group_importance(spark, d):
    """Per-group mean |contribution| of the forest above (rows)."""
    from ..operators import models as MO
    from .q_strategies import _train_test
    tr, te, feats = _train_test(spark, d)
    rf = MO.fit(tr, feats, MO.ModelSpec("random_forest", params={"numTrees": 20, "maxDepth": 6}))
    c = E.tree_contributions(te, rf, feats, ["row_id", "sensitive"])
    long = E.contributions_long(c, feats, ["row_id", "sensitive"])
    return E.group_importance(long, "sensitive")
