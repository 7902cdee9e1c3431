"""End-to-end jobs: strategy evaluation and the audit pipeline.

Every step is a Spark job over the prepared table; the driver holds only
model objects and tables bounded by groups x strategies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models as MO
from ..operators import proxy as X
from ..operators import rules as R
from ..operators import strategies as S
from ..operators.metrics import confusion_matrix, distribution_summary, evaluate_predictions
from ..operators.profile import profile_table, validate_schema
from ..session import materialize, scratch_path
from ..sources.io import read_csv

MAX_PARALLEL_FITS = 4  # concurrent strategy fits (each is itself a distributed job)


def evaluate_strategies(train: DataFrame, test: DataFrame, features: list[str], strategies: list[str],
                        sensitive_col: str = "sensitive", sensitive_name: str | None = None,
                        spec: MO.ModelSpec = MO.ModelSpec()) -> DataFrame:
    """Train every (normalised, de-duplicated) strategy, predict the test
    split, and evaluate all predictions with one cube aggregate.

    Output per strategy: accuracy, fairness, baseline_accuracy,
    baseline_fairness, fairness_improvement, accuracy_retention, the three
    fairness metrics, ``position`` (list order) and ``error``. A strategy
    whose training fails with ValueError keeps its row: the reason in
    ``error``, null figures. ``error`` is null for all others.
    """
    if not strategies:
        raise ValueError("strategies must be a non-empty list.")
    seen: list[str] = []
    for s in strategies:
        n = S.ALIASES.get((s or "").strip().lower(), s.strip())
        if n not in seen:
            seen.append(n)
    baseline = MO.fit(train, features, spec)
    preds = MO.score(baseline, test).select(sensitive_col, "y", "y_pred", F.lit("baseline").alias("strategy"))
    positions = {"baseline": -1}

    def run(item):
        i, name = item
        try:
            _, p = MO.run_strategy(name, train, test, features, sensitive_col, sensitive_name, baseline, spec)
        except ValueError as e:
            return i, name, None, str(e)
        return i, name, p, None

    # independent fits run as concurrent Spark jobs from a small driver pool
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=min(MAX_PARALLEL_FITS, len(seen))) as pool:
        done = list(pool.map(run, list(enumerate(seen))))
    failed = [(name, i, error) for i, name, _, error in done if error is not None]
    for i, name, p, error in done:
        if error is not None:
            continue
        positions[name] = i
        preds = preds.unionByName(p.select(sensitive_col, "y", "y_pred", F.lit(name).alias("strategy")))
    ev = evaluate_predictions(preds, "y", "y_pred", sensitive_col, model_col="strategy", binary=True)
    pos = F.create_map(*[x for k, v in positions.items() for x in (F.lit(k), F.lit(v))])
    ev = ev.select("strategy", pos[F.col("strategy")].alias("position"), "accuracy",
                   F.col("fairness_score").alias("fairness"), "demographic_parity_difference",
                   "equalized_odds_difference", "disparate_impact_ratio")
    gains = S.strategy_gain(ev, []).withColumn("error", F.lit(None).cast("string"))
    if failed:
        rows = train.sparkSession.createDataFrame(failed, "strategy string, position int, error string")
        gains = gains.unionByName(rows, allowMissingColumns=True)
    return gains


def audit_pipeline(df: DataFrame, target: str, sensitive: str, key: str, out_dir: str | None = None,
                   strategies: list[str] | None = None, preferred: str | None = None,
                   test_size: float = 0.2, seed: int = 42, spec: MO.ModelSpec = MO.ModelSpec()) -> DataFrame:
    """Load -> prepare -> baseline -> evaluate -> raw audit -> rules ->
    diagnosis -> recommendations -> strategy evaluation -> ranking ->
    selection -> final model -> comparison -> saved reports and models.

    Returns the one-row summary; full reports are written under ``out_dir/reports``
    (default: a fresh folder in the shared checkpoint location), a folder of JSON
    lines each: config, dataset_analysis, profile, correlations, baseline,
    mitigated, bias, diagnosis, recommendations, strategies, failed_strategies,
    choices (balanced, fairness, accuracy), comparison, confusion_matrix. ``spec``
    gives the type and parameters of the baseline and of every strategy that
    trains a model of its own. Strategies that failed are reported apart and
    not ranked.
    """
    from .audit import feature_columns, prepare_dataset
    spark = df.sparkSession
    out_dir = out_dir or scratch_path(spark, "audit")
    prepared = materialize(prepare_dataset(df, target, sensitive, key, test_size, seed))
    feats = feature_columns(prepared, key)
    train = prepared.where(F.col("split") == "train")
    test = prepared.where(F.col("split") == "test")

    baseline = MO.fit(train, feats, spec)
    base_pred = MO.score(baseline, test)
    base_eval = evaluate_predictions(base_pred, "y", "y_pred", "sensitive")
    # bias rules: baseline metrics on the test split + imbalance of the raw data
    audit = R.audit_rows(base_pred, "y", "y_pred", "sensitive").drop("imbalance_ratio")
    raw = distribution_summary(df, target, sensitive).drop("_all")
    ident = R.identify_bias(audit.withColumn("attr", F.lit(sensitive))
                            .join(raw.select("attr", "imbalance_ratio"), "attr", "left"))
    corr = X.top_k(X.pearson(df.drop(target), sensitive), 5).withColumn("attr", F.lit(sensitive))
    diag = R.diagnose(raw, ["attr"], corr)
    rec = R.recommend(ident, ["attr"])
    rec_names = [r["strategy"] for r in rec.orderBy("strategy_rank").collect()]  # <= a handful
    cands = strategies or rec_names
    # a handful of rows that ranking, selection and reports all read
    ev = materialize(evaluate_strategies(train, test, feats, cands, sensitive_name=sensitive, spec=spec))
    ranked = S.rank_strategies(ev.where(F.col("error").isNull()).drop("error"), [])
    slices = spark.range(1).select(F.lit(sensitive).alias("attr"))
    sel = S.select_strategy(ranked.withColumn("attr", F.lit(sensitive)), ["attr"], slices, preferred)
    chosen = sel.first()["selected_strategy"]
    model, final_pred = MO.run_strategy(chosen, train, test, feats, "sensitive", sensitive, baseline,
                                        spec, key=key)
    pairs = (base_pred.select(key, "sensitive", "y", F.col("y_pred").alias("baseline"))
             .join(final_pred.select(key, F.col("y_pred").alias("mitigated")), key))
    from ..operators.metrics import compare_models
    cmp = compare_models(pairs, "baseline", "mitigated", "y", "sensitive").withColumn("attr", F.lit(sensitive))
    # reports
    final_eval = evaluate_predictions(final_pred, "y", "y_pred", "sensitive")
    short = S.balanced_choice(ranked, []).select(F.lit("balanced").alias("choice"), "strategy", "accuracy", "fairness")
    best = [short, *(f(ranked, []).select(F.lit(name).alias("choice"), "strategy", "accuracy", "fairness")
                     for name, f in (("fairness", S.best_fairness), ("accuracy", S.best_accuracy)))]
    both = base_pred.select("y", "y_pred", F.lit("baseline").alias("model")).unionByName(
        final_pred.select("y", "y_pred", F.lit("mitigated").alias("model")))
    bundle = {
        "dataset_analysis": raw,
        "profile": profile_table(df, target, [sensitive], exact=False),
        "correlations": corr,
        "recommendations": rec,
        "choices": best[0].unionByName(best[1]).unionByName(best[2]),
        "mitigated": final_eval,
        "confusion_matrix": confusion_matrix(both, "y", "y_pred", ["model"]),
        "config": spark.createDataFrame(
            [(target, sensitive, key, spec.model_type, float(test_size), seed, chosen)],
            "target string, sensitive string, key string, model_type string, test_size double, seed long, selected_strategy string"),
    }
    for name, table in bundle.items():
        table.write.mode("overwrite").json(f"{out_dir}/reports/{name}")
    base_eval.write.mode("overwrite").json(f"{out_dir}/reports/baseline")
    ident.write.mode("overwrite").json(f"{out_dir}/reports/bias")
    diag.write.mode("overwrite").json(f"{out_dir}/reports/diagnosis")
    ranked.write.mode("overwrite").json(f"{out_dir}/reports/strategies")
    ev.where(F.col("error").isNotNull()).select("strategy", "position", "error") \
        .write.mode("overwrite").json(f"{out_dir}/reports/failed_strategies")
    cmp.write.mode("overwrite").json(f"{out_dir}/reports/comparison")
    MO.save_model(spark, baseline, f"{out_dir}/models/baseline",
                  {"target": target, "sensitive": sensitive, "model_type": spec.model_type})
    MO.save_model(spark, model, f"{out_dir}/models/mitigated",
                  {"target": target, "sensitive": sensitive, "strategy": chosen})
    summary = (ident.select("attr", "detected_bias_type", "severity_score")
               .join(diag.select("attr", F.col("bias_type").alias("root_cause_type"), "severity"), "attr")
               .join(cmp, "attr")
               .withColumn("selected_strategy", F.lit(chosen))
               .withColumn("output", F.lit(out_dir)))
    return summary


ROW_KEY = "_row_number"


def audit_csv(spark, path: str, target: str, sensitive: str, key: str | None = None, required=(),
              multi_line: bool = False, **options) -> DataFrame:
    """``audit_pipeline`` on a CSV file or folder: read (sentinels, types), check
    the schema (``SchemaError`` names what is missing), audit.

    Without a ``key`` column the rows are numbered once, in a checkpoint."""
    df = read_csv(spark, path, multi_line=multi_line)
    columns = [c for c in df.columns if c != target]
    validate_schema(df, [*columns, *required, *([key] if key else [])], target, sensitive)
    if key is None:
        key = ROW_KEY
        df = materialize(df.withColumn(key, F.monotonically_increasing_id()))
    return audit_pipeline(df, target, sensitive, key, **options)
