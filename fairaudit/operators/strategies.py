"""Strategy evaluation, ranking and selection (§2.9) over evaluation rows.

An evaluation row is (slice..., strategy, position, accuracy, fairness);
the baseline is the row whose strategy is ``baseline``. Ranking is a window
partitioned by slice over at most (strategies) rows per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import fairness_score
from .metrics import evaluate_predictions, models_long

MONITORING = "Continuous Fairness Monitoring"

# Strategy aliases (trimmed lower-case) -> canonical name.
ALIASES = {
    "reweighing": "Reweighing",
    "data reweighing": "Reweighing",
    "fairness constrained learning": "Fairness-Constrained Learning",
    "fairness constraint": "Fairness-Constrained Learning",
    "post-processing threshold optimization": "Post-Processing Threshold Optimization",
    "equalized odds post-processing": "Equalized Odds Post-Processing",
    "feature debiasing": "Feature Debiasing",
    "feature removal or auditing": "Feature Removal or Auditing",
}


def normalize_strategy(c: Column) -> Column:
    m = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.lower(F.trim(c))], F.trim(c))


def dedupe(df: DataFrame, keys: list[str], name: str = "strategy", position: str = "position") -> DataFrame:
    """Keep the first occurrence (by position) of each normalised name."""
    w = Window.partitionBy(*keys, name).orderBy(position)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def evaluate_candidates(df: DataFrame, preds: dict[str, str], y_true: str, attr: str,
                        slice_cols=()) -> DataFrame:
    """One cube for all candidate prediction columns: (slice..., strategy,
    position, accuracy, fairness) with ``baseline`` at position -1."""
    keep = list(slice_cols) + [attr, y_true]
    long = models_long(df, preds, keep, "y_pred")
    ev = evaluate_predictions(long, y_true, "y_pred", attr, slice_cols, model_col="model")
    order = {name: i - 1 for i, name in enumerate(preds)}
    pos = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    return ev.select(*slice_cols, F.col("model").alias("strategy"), pos[F.col("model")].alias("position"),
                     "accuracy", F.col("fairness_score").alias("fairness"))


def strategy_gain(ev: DataFrame, keys: list[str]) -> DataFrame:
    """Adds baseline accuracy/fairness, fairness_improvement and
    accuracy_retention (0 when the baseline accuracy is 0)."""
    # the baseline row of each slice reaches its siblings through a window over
    # the (strategies per slice) evaluation rows -- no join
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    is_base = F.col("strategy") == "baseline"
    j = ev.select("*", F.max(F.when(is_base, F.col("accuracy"))).over(w).alias("baseline_accuracy"),
                  F.max(F.when(is_base, F.col("fairness"))).over(w).alias("baseline_fairness")) \
          .where(~is_base)
    return j.select(
        "*",
        F.round(F.col("baseline_fairness") - F.col("fairness"), 6).alias("fairness_improvement"),
        F.when(F.col("baseline_accuracy") > 0,
               F.round(F.col("accuracy") / F.col("baseline_accuracy"), 6)).otherwise(F.lit(0.0))
         .alias("accuracy_retention"))


def rank_strategies(g: DataFrame, keys: list[str]) -> DataFrame:
    """normalised gain = max(imp, 0) / best gain (best 0 -> 1);
    rank_score = 0.65 gain + 0.35 retention; rank by score, improvement,
    accuracy (descending), then list order."""
    imp = F.coalesce(F.col("fairness_improvement"), F.lit(0.0))
    ret = F.coalesce(F.col("accuracy_retention"), F.lit(0.0))
    wk = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    best = F.max(F.greatest(imp, F.lit(0.0))).over(wk)
    best = F.when(best == 0, F.lit(1.0)).otherwise(best)
    ng = F.greatest(imp, F.lit(0.0)) / best
    r = g.select("*", F.round(ng, 6).alias("normalized_fairness_improvement"),
                 F.round(0.65 * ng + 0.35 * ret, 6).alias("rank_score"))
    wr = wk.orderBy(F.col("rank_score").desc(), imp.desc(), F.col("accuracy").desc(), F.col("position").asc())
    return r.withColumn("rank", F.row_number().over(wr))


def best_fairness(g: DataFrame, keys: list[str]) -> DataFrame:
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(
        F.coalesce(F.col("fairness"), F.lit(1.0)).asc(), F.coalesce(F.col("accuracy"), F.lit(0.0)).desc(),
        F.col("position").asc())
    return (g.withColumn("_r", F.row_number().over(w)).where("_r = 1")
             .select(*keys, "strategy", "fairness", "accuracy"))


def best_accuracy(g: DataFrame, keys: list[str]) -> DataFrame:
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(
        F.coalesce(F.col("accuracy"), F.lit(0.0)).desc(),
        F.coalesce(F.col("fairness_improvement"), F.lit(0.0)).desc(), F.col("position").asc())
    return (g.withColumn("_r", F.row_number().over(w)).where("_r = 1")
             .select(*keys, "strategy", "accuracy", "fairness"))


def balanced_choice(ranked: DataFrame, keys: list[str], slices: DataFrame | None = None) -> DataFrame:
    """Rank-1 row per slice; slices without results get a null report."""
    top = ranked.where(F.col("rank") == 1).select(*keys, "strategy", "rank_score", "fairness", "accuracy")
    if slices is None:
        return top
    return slices.select(*keys).distinct().join(top, keys, "left")


def select_strategy(ranked: DataFrame, keys: list[str], slices: DataFrame, preferred: str | None = None) -> DataFrame:
    """Preferred (must have been evaluated), else the balanced choice, else
    continuous monitoring: (slice..., selected_strategy, reason)."""
    bc = balanced_choice(ranked, keys, slices)
    if preferred:
        have = ranked.where(F.col("strategy") == preferred).select(*keys).distinct() \
                     .withColumn("_has", F.lit(True))
        j = bc.join(have, keys, "left")
        sel = F.when(F.col("_has"), F.lit(preferred)).otherwise(
            F.raise_error(F.lit(f"Preferred strategy '{preferred}' was not evaluated.")))
        return j.select(*keys, sel.alias("selected_strategy"), F.lit("preferred").alias("reason"))
    return bc.select(*keys, F.coalesce(F.col("strategy"), F.lit(MONITORING)).alias("selected_strategy"),
                     F.when(F.col("strategy").isNull(), F.lit("no results"))
                      .otherwise(F.lit("balanced choice")).alias("reason"))


def fairness_of(ev: DataFrame) -> Column:
    return fairness_score(F.col("demographic_parity_difference"), F.col("equalized_odds_difference"),
                          F.col("disparate_impact_ratio"))
