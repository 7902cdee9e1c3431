"""Rule operators (§2.7) as column expressions over audit rows.

An audit row holds, per (slice, attribute), the fairness metrics of a model
and the imbalance ratio of the data. The rules, scores, type, severity and
explanation are projections of that row, so thousands of audits are
classified in one pass with no Python loop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import fixed3
from .metrics import fairness_metrics

# Category names, in tie-break order for the bias type.
SELECTION, PREDICTION, HISTORICAL, PROXY = ("Selection Bias", "Prediction Bias",
                                            "Historical Bias", "Proxy Bias")
NO_BIAS = "No Significant Bias"

# Rule messages.
RULE_TEXT = {
    "selection_di": "Selection Bias signal: disparate impact ratio below 0.80 heuristic.",
    "selection_dp": "Selection Bias signal: notable demographic parity difference across groups.",
    "prediction_eo": "Prediction Bias signal: equalized odds difference indicates performance disparity.",
    "historical_imbalance": "Historical Bias signal: sensitive-group representation is highly imbalanced.",
    "proxy_gap": "Proxy Bias signal: outcome disparity is high while equalized-odds disparity is lower.",
}
RULE_ORDER = ["selection_di", "selection_dp", "prediction_eo", "historical_imbalance", "proxy_gap"]
NO_BIAS_TEXT = ("Fairness metrics do not cross the configured rule thresholds for "
                "selection, prediction, historical, or proxy bias.")

# Root-cause messages of the diagnosis.
CAUSE_HISTORICAL = "Group distribution is highly imbalanced across the sensitive attribute."
CAUSE_SELECTION = "Unequal selection rates across sensitive groups."
CAUSE_PROXY = "High correlation of {feature} with the sensitive attribute."


@dataclass(frozen=True)
class BiasThresholds:
    disparate_impact_alert: float = 0.80
    equalized_odds_moderate: float = 0.10
    equalized_odds_high: float = 0.20
    demographic_parity_moderate: float = 0.10
    demographic_parity_high: float = 0.20
    historical_imbalance_alert: float = 0.50


@dataclass(frozen=True)
class DiagnosisThresholds:
    historical_imbalance_alert: float = 0.50
    selection_rate_gap_moderate: float = 0.15
    selection_rate_gap_high: float = 0.25
    proxy_correlation_moderate: float = 0.50
    proxy_correlation_high: float = 0.70


def _clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _inputs(dp="demographic_parity_difference", eo="equalized_odds_difference",
            di="disparate_impact_ratio", imb="imbalance_ratio"):
    """|DP| (default 0), |EO| (default 0), DI (default 1), imbalance ratio."""
    return (F.abs(F.coalesce(F.col(dp).cast("double"), F.lit(0.0))),
            F.abs(F.coalesce(F.col(eo).cast("double"), F.lit(0.0))),
            F.coalesce(F.col(di).cast("double"), F.lit(1.0)),
            F.col(imb).cast("double"))


def signal_strengths(cfg: BiasThresholds = BiasThresholds(), **names) -> dict[str, Column]:
    """Rule -> strength column (null when the rule does not fire)."""
    dp, eo, di, r = _inputs(**names)
    a = cfg
    return {
        "selection_di": F.when(di < a.disparate_impact_alert,
                               F.least(F.lit(1.0), (F.lit(a.disparate_impact_alert) - di) / 0.40)),
        "selection_dp": F.when(dp >= a.demographic_parity_moderate, F.least(F.lit(1.0), dp / 0.50)),
        "prediction_eo": F.when(eo >= a.equalized_odds_moderate, F.least(F.lit(1.0), eo / 0.50)),
        "historical_imbalance": F.when(r.isNotNull() & (r < a.historical_imbalance_alert),
                                       F.least(F.lit(1.0), (F.lit(a.historical_imbalance_alert) - r) / 0.50)),
        "proxy_gap": F.when((dp >= a.demographic_parity_high) & (eo < a.equalized_odds_moderate) & (di < 1.0),
                            F.least(F.lit(1.0), dp / 0.60)),
    }


def category_scores(cfg: BiasThresholds = BiasThresholds(), **names) -> dict[str, Column]:
    dp, eo, di, r = _inputs(**names)
    a = cfg
    sel = F.when((di < a.disparate_impact_alert) | (dp >= a.demographic_parity_moderate),
                 F.greatest(_clamp01((F.lit(a.disparate_impact_alert) - di) / 0.40), _clamp01(dp / 0.50)))
    pred = F.when(eo >= a.equalized_odds_moderate, _clamp01(eo / 0.50))
    hist = F.when(r.isNotNull() & (r < a.historical_imbalance_alert),
                  _clamp01((F.lit(a.historical_imbalance_alert) - r) / 0.50))
    prox = F.when((dp >= a.demographic_parity_high) & (eo < a.equalized_odds_moderate) & (di < 1.0),
                  _clamp01(dp / 0.60))
    z = F.lit(0.0)
    return {SELECTION: F.coalesce(sel, z), PREDICTION: F.coalesce(pred, z),
            HISTORICAL: F.coalesce(hist, z), PROXY: F.coalesce(prox, z)}


def identify_bias(audit: DataFrame, cfg: BiasThresholds = BiasThresholds(), **names) -> DataFrame:
    """Adds detected_bias_type, severity_score, triggered_rules (joined by
    ' | '), n_triggered, explanation and the four supporting metrics."""
    sig = signal_strengths(cfg, **names)
    cat = category_scores(cfg, **names)
    dp, eo, di, r = _inputs(**names)
    strengths = F.array_compact(F.array(*[sig[k] for k in RULE_ORDER]))
    rules = F.array_compact(F.array(*[F.when(sig[k].isNotNull(), F.lit(RULE_TEXT[k])) for k in RULE_ORDER]))
    order = [SELECTION, PREDICTION, HISTORICAL, PROXY]
    # argmax with ties to the earlier category: maximise (score, -priority)
    best = F.array_max(F.array(*[F.struct(cat[n].alias("score"), F.lit(-i).alias("prio"), F.lit(n).alias("name"))
                                 for i, n in enumerate(order)]))
    n_trig = F.size(strengths)
    none = (best["score"] < 0.20) & (n_trig == 0)
    btype = F.when(none, F.lit(NO_BIAS)).otherwise(best["name"])
    mx = F.array_max(strengths)
    mean = F.aggregate(strengths, F.lit(0.0), lambda acc, x: acc + x) / n_trig
    sev = F.when(n_trig == 0, F.lit(0.0)).otherwise(
        F.round(_clamp01(0.7 * mx + 0.3 * mean), 3))
    parts = F.concat_ws("; ",
                        F.concat(F.lit("Detected "), btype, F.lit(" based on threshold rules.")),
                        F.concat(F.lit("Demographic parity difference="), fixed3(dp)),
                        F.concat(F.lit("Equalized odds difference="), fixed3(eo)),
                        F.concat(F.lit("Disparate impact ratio="), fixed3(di)),
                        F.when(r.isNotNull(), F.concat(F.lit("Sensitive distribution imbalance ratio="), fixed3(r))),
                        F.when(n_trig > 0, F.concat(F.lit("Triggered rules: "), F.array_join(rules, " | "))))
    expl = F.when(none, F.lit(NO_BIAS_TEXT)).otherwise(parts)
    return audit.select(
        "*",
        btype.alias("detected_bias_type"), sev.alias("severity_score"),
        F.array_join(rules, " | ").alias("triggered_rules"), n_trig.alias("n_triggered"),
        expl.alias("explanation"),
        F.round(dp, 6).alias("sm_demographic_parity_difference"),
        F.round(eo, 6).alias("sm_equalized_odds_difference"),
        F.round(di, 6).alias("sm_disparate_impact_ratio"),
        F.round(r, 6).alias("sm_distribution_imbalance_ratio"),
        *[cat[n].alias(f"score_{n.split()[0].lower()}") for n in order],
    )


def rules_long(audit: DataFrame, keys: list[str], cfg: BiasThresholds = BiasThresholds(), **names) -> DataFrame:
    """(keys..., rule, message, strength) for every rule that fires."""
    sig = signal_strengths(cfg, **names)
    recs = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(RULE_TEXT[k]).alias("message"),
                              sig[k].alias("strength")) for k in RULE_ORDER])
    return (audit.select(*keys, F.inline(recs)).where(F.col("strength").isNotNull()))


def severity_label(combined: Column) -> Column:
    return F.when(combined >= 0.67, "High").when(combined >= 0.34, "Medium").otherwise("Low")


def diagnose(summary: DataFrame, keys: list[str], proxies: DataFrame | None = None,
             cfg: DiagnosisThresholds = DiagnosisThresholds()) -> DataFrame:
    """Root-cause diagnosis per audit row.

    ``summary``: (keys..., imbalance_ratio, selection_rate_gap).
    ``proxies``: optional (keys..., feature, correlation, rank) top list; the
    first flagged feature by rank is the proxy cause.
    """
    s = summary
    if proxies is not None:
        rc = F.round(F.col("correlation"), 6)
        flagged = (proxies.where(F.abs(rc) >= cfg.proxy_correlation_moderate)
                   .groupBy(*keys).agg(F.min_by(F.struct(F.col("feature").alias("f"), F.abs(rc).alias("c")),
                                                F.col("rank")).alias("px")))
        s = s.join(flagged, keys, "left")
    else:
        s = s.withColumn("px", F.lit(None).cast("struct<f:string,c:double>"))
    r, gap = F.col("imbalance_ratio"), F.col("selection_rate_gap")
    hist = F.when(r.isNotNull() & (r < cfg.historical_imbalance_alert),
                  F.least(F.lit(1.0), (F.lit(cfg.historical_imbalance_alert) - r) / cfg.historical_imbalance_alert))
    sel = F.when(gap.isNotNull() & (gap >= cfg.selection_rate_gap_moderate),
                 F.least(F.lit(1.0), gap / cfg.selection_rate_gap_high))
    prox = F.when(F.col("px").isNotNull(), F.least(F.lit(1.0), F.col("px.c") / cfg.proxy_correlation_high))
    causes = F.array_compact(F.array(
        F.when(hist.isNotNull(), F.struct(hist.alias("strength"), F.lit(0).alias("neg_prio"),
                                          F.lit(HISTORICAL).alias("bias_type"), F.lit(CAUSE_HISTORICAL).alias("cause"))),
        F.when(sel.isNotNull(), F.struct(sel.alias("strength"), F.lit(-1).alias("neg_prio"),
                                         F.lit(SELECTION).alias("bias_type"), F.lit(CAUSE_SELECTION).alias("cause"))),
        F.when(prox.isNotNull(), F.struct(prox.alias("strength"), F.lit(-2).alias("neg_prio"),
                                          F.lit(PROXY).alias("bias_type"),
                                          F.concat(F.lit("High correlation of "), F.col("px.f"),
                                                   F.lit(" with the sensitive attribute.")).alias("cause")))))
    n = F.size(causes)
    strengths = F.transform(causes, lambda x: x["strength"])
    combined = (0.7 * F.array_max(strengths)
                + 0.3 * F.aggregate(strengths, F.lit(0.0), lambda a, x: a + x) / n)
    return s.select(
        *keys,
        F.when(n == 0, F.lit(NO_BIAS)).otherwise(F.array_max(causes)["bias_type"]).alias("bias_type"),
        F.array_join(F.transform(causes, lambda x: x["cause"]), " | ").alias("root_causes"),
        n.alias("n_causes"),
        F.when(n == 0, F.lit("Low")).otherwise(severity_label(combined)).alias("severity"),
    )


# --------------------------------------------------------------------------
# strategy recommendations
# --------------------------------------------------------------------------

# Bias type -> ordered (strategy, reason).
STRATEGY_MAP = {
    SELECTION: [
        ("Fairness-Constrained Learning",
         "Apply in-processing constraints (for example demographic parity or equalized-odds "
         "constraints) to reduce selection-rate disparities."),
        ("Reweighing",
         "Adjust sample weights by sensitive group and label to reduce imbalanced selection "
         "patterns during training."),
    ],
    PREDICTION: [
        ("Post-Processing Threshold Optimization",
         "Tune decision thresholds per group to reduce unequal false positive and true positive "
         "rates after model training."),
        ("Equalized Odds Post-Processing",
         "Use equalized-odds post-processing methods to align error rates across demographic groups."),
    ],
    HISTORICAL: [
        ("Data Reweighing",
         "Reweight underrepresented group examples to reduce the impact of historical imbalance "
         "in training data."),
        ("Resampling",
         "Use over/under-sampling to improve representation balance before model training."),
    ],
    PROXY: [
        ("Feature Debiasing",
         "Transform or regularize features correlated with sensitive attributes to reduce "
         "indirect discrimination."),
        ("Feature Removal or Auditing",
         "Identify and remove proxy variables that leak sensitive information into model decisions."),
    ],
    NO_BIAS: [
        ("Continuous Fairness Monitoring",
         "No major bias signal detected now, but metrics should be monitored across retraining "
         "cycles and new hiring cohorts."),
    ],
}


def strategy_table(spark: SparkSession, mapping: dict | None = None) -> DataFrame:
    m = mapping or STRATEGY_MAP
    rows = [(bt, i + 1, name, reason) for bt, recs in m.items() for i, (name, reason) in enumerate(recs)]
    return spark.createDataFrame(rows, "bias_type string, strategy_rank int, strategy string, reason string")


def canonical_bias_type(c: Column, mapping: dict | None = None) -> Column:
    """trim/lower alias -> canonical; exact canonical kept; else no-bias."""
    m = mapping or STRATEGY_MAP
    norm = F.lower(F.trim(c))
    out = None
    for name in [SELECTION, PREDICTION, HISTORICAL, PROXY, NO_BIAS]:
        cond = norm == F.lit(name.lower())
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    exact = F.lit(None).cast("string")
    for name in m:
        exact = F.when(c == F.lit(name), F.lit(name)).otherwise(exact)
    return F.coalesce(out, exact, F.lit(NO_BIAS))


def recommend(audit: DataFrame, keys: list[str], type_col: str = "detected_bias_type",
              mapping: dict | None = None) -> DataFrame:
    """(keys..., bias_type, strategy_rank, strategy, reason); blank type is an error row-wise
    (raise_error), unknown types fall back to the no-bias advice."""
    m = mapping or STRATEGY_MAP
    t = F.col(type_col)
    checked = F.when(t.isNull() | (F.trim(t) == ""), F.raise_error(F.lit("bias_type must be a non-empty string."))) \
               .otherwise(canonical_bias_type(t, m))
    a = audit.select(*keys, checked.alias("bias_type"))
    st = strategy_table(audit.sparkSession, m)
    # the strategy table is a fixed handful of rows
    return a.join(F.broadcast(st), "bias_type", "left")


def audit_rows(df: DataFrame, y_true: str, y_pred: str, attrs, slice_cols=()) -> DataFrame:
    """Fairness metrics and the imbalance ratio of the group shares (null kept
    as a group), one row per (slice, attr), from a single confusion cube."""
    return fairness_metrics(df, y_true, y_pred, attrs, slice_cols, rounded=False)
