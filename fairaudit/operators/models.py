"""Model jobs (§2.8): weighted LR / RF with Spark ML, scoring, fairness-
constrained learning by exponentiated gradient, feature removal, and the
strategy dispatch.

Training data are prepared once (``plans.audit.prepare_dataset``) and
persisted for the iterative fits; every fit is a distributed Spark ML job.
Multiple models are compared by unioning their predictions with a
``model`` column and running one confusion-cube aggregate.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_broadcast
from . import mitigate as MI
from . import mixed_thresholds as MX
from .forest import cell_forest
from .prepare import WIDE_PREFIXES
from .saddle import Game

LR_MAX_ITER = 1000
RF_TREES = 200
RF_MAX_DEPTH = 12  # the source grows trees without a depth limit; Spark caps depth at 30
FOREST_TASKS = 12  # tasks of a forest's passes, where each has rows enough
FOREST_TASK_ROWS = (10_000, 250_000)  # least and most rows of such a task
FOREST_CELL_ROWS = 20_000  # from here on forests grow on cells of rows alike; below, passes over the rows are short


@dataclass
class ModelSpec:
    model_type: str = "logistic_regression"
    params: dict = field(default_factory=dict)
    balanced: bool = True
    seed: int = 42


def _norm_type(t: str) -> str:
    k = t.strip().lower()
    if k in {"logistic_regression", "logistic", "lr"}:
        return "logistic_regression"
    if k in {"random_forest", "rf", "randomforest"}:
        return "random_forest"
    raise ValueError("Unsupported model_type. Use 'logistic_regression' or 'random_forest'.")


def training_weights(train: DataFrame, label: str = "y", sample_weight: str | None = None,
                     balanced: bool = True) -> tuple[DataFrame, int, float | None, int]:
    """Row weight column ``_w`` (balanced class weight x sample weight), the
    number of classes, the total weight when it is known without a pass
    (balanced weights alone sum to n), and the number of rows."""
    cw, _ = bounded_broadcast(MI.class_weight_table(train, label))
    rows = cw.collect()  # one row per class
    k, n = len(rows), sum(r["n"] for r in rows)
    if balanced:
        t = cw.select(F.col("y").alias("_y"), "class_weight")
        j = train.join(t, train[label].eqNullSafe(t["_y"]), "left").drop("_y")
        w = F.col("class_weight") * (F.col(sample_weight) if sample_weight else F.lit(1.0))
        return j.withColumn("_w", w).drop("class_weight"), k, (None if sample_weight else float(n)), n
    w = F.col(sample_weight) if sample_weight else F.lit(1.0)
    return train.withColumn("_w", w), k, (None if sample_weight else float(n)), n


def _forest_tasks(rows: int) -> int:
    """Tasks for the passes of a forest. It depends on the rows alone, not on the
    cluster, since the tasks seed the draws of rows."""
    least, most = FOREST_TASK_ROWS
    return max(1, min(FOREST_TASKS, rows // least), -(-rows // most))


def fit(train: DataFrame, features: list[str], spec: ModelSpec = ModelSpec(), label: str = "y",
        sample_weight: str | None = None) -> PipelineModel:
    """Fit VectorAssembler + classifier. At least two classes are required."""
    mt = _norm_type(spec.model_type)
    data, classes, total_w, n = training_weights(train, label, sample_weight, spec.balanced)
    if classes < 2:
        raise ValueError(f"Target must have at least 2 classes for classification. Found {classes}.")
    asm = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep")
    if mt == "logistic_regression":
        if total_w is None:
            total_w = data.agg(F.sum("_w")).first()[0]
        p = {"maxIter": LR_MAX_ITER, "regParam": 1.0 / total_w, "elasticNetParam": 0.0,
             "standardization": False, "tol": 1e-6}
        p.update(spec.params)
        clf = LogisticRegression(featuresCol="_features", labelCol=label, weightCol="_w",
                                 predictionCol="_pred", probabilityCol="_prob",
                                 rawPredictionCol="_raw", **p)
    else:
        p = {"numTrees": RF_TREES, "maxDepth": RF_MAX_DEPTH, "seed": spec.seed, "cacheNodeIds": True}
        p.update(spec.params)
        clf = RandomForestClassifier(featuresCol="_features", labelCol=label, weightCol="_w",
                                     predictionCol="_pred", probabilityCol="_prob",
                                     rawPredictionCol="_raw", **p)
        if n >= FOREST_CELL_ROWS:
            forest = cell_forest(data, features, label, "_w", clf)
            if forest is not None:
                return PipelineModel(stages=[asm, forest])
        # every level of the trees is a pass over all rows and trees; the rows come in as
        # few tasks as their files have splits, so they are spread first
        tasks = _forest_tasks(n)
        if tasks > 1:
            data = data.repartition(tasks)
    return Pipeline(stages=[asm, clf]).fit(data.select(*features, label, "_w"))


def score(model: PipelineModel, df: DataFrame, out: str = "y_pred", proba: str = "p1") -> DataFrame:
    """Adds the hard label (int) and the probability of class 1."""
    s = model.transform(df)
    return (s.withColumn(out, F.col("_pred").cast("int"))
             .withColumn(proba, vector_to_array("_prob")[1])
             .drop("_features", "_pred", "_prob", "_raw"))


def train_many(train: DataFrame, features: list[str], configs: dict[str, ModelSpec] | None = None,
               sample_weight: str | None = None, errors: dict[str, str] | None = None) -> dict[str, PipelineModel]:
    """Models by name, fitted at the same time. With ``errors`` a model that
    cannot be fitted is left out and its reason put there; without, it raises."""
    configs = configs or {"logistic_regression": ModelSpec("logistic_regression"),
                          "random_forest": ModelSpec("random_forest")}

    def one(item):
        try:
            return item[0], fit(train, features, item[1], sample_weight=sample_weight), None
        except Exception as e:  # noqa: BLE001 - whatever one model fails with, the others go on
            if errors is None:
                raise
            return item[0], None, str(e).split("\n")[0]
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=max(1, min(4, len(configs)))) as pool:
        done = list(pool.map(one, configs.items()))
    if errors is not None:
        errors.update({name: why for name, _, why in done if why is not None})
    return {name: m for name, m, why in done if why is None}


def debiased_features(features: list[str], sensitive: str, mode: str = "wide") -> list[str]:
    def dropped(c):
        if c == sensitive or c.startswith(f"{sensitive}_"):
            return True
        return mode == "wide" and any(c.startswith(p) for p in WIDE_PREFIXES)
    return [c for c in features if not dropped(c)]


# --------------------------------------------------------------------------
# fairness-constrained learning (exponentiated gradient, Agarwal et al. 2018)
# --------------------------------------------------------------------------

@dataclass
class ConstrainedModel:
    """Mixture of hypotheses (each a fitted model or a constant label) with
    mixture weights; ``history`` records, per iteration, the primal-dual gap,
    the largest constraint violation and the error of the mixture then best."""
    members: list  # (weight, PipelineModel | int)
    features: list[str]
    history: list = field(default_factory=list)

    def predict(self, df: DataFrame, out: str = "y_pred", key: str | None = None, seed: int = 42) -> DataFrame:
        """``mixture_score`` = probability of predicting 1. With ``key`` the
        label is drawn with that probability from a per-row hash uniform
        (repeatable), as the randomised classifier of the reduction; without
        it the score is thresholded at 0.5."""
        total = sum(w for w, _ in self.members)
        acc = F.lit(0.0)
        d = df
        for i, (w, m) in enumerate(self.members):
            if w == 0:
                continue
            if isinstance(m, int):
                acc = acc + F.lit(w * m)
                continue
            d = score(m, d, out=f"_h{i}", proba=f"_p{i}")
            acc = acc + F.lit(w) * F.col(f"_h{i}")
        d = d.withColumn("mixture_score", acc / total)
        if key is not None:
            from .prepare import hash_order
            u = F.conv(F.substring(hash_order(F.col(key), seed), 1, 12), 16, 10).cast("double") / float(16 ** 12)
            d = d.withColumn(out, (u < F.col("mixture_score")).cast("int"))
        else:
            d = d.withColumn(out, (F.col("mixture_score") >= 0.5).cast("int"))
        drop = [c for i in range(len(self.members)) for c in (f"_h{i}", f"_p{i}")]
        return d.drop(*drop)


CONSTRAINED_ITERATIONS = 50
MAX_CELLS = 20_000       # constraint cells (groups, or groups x labels) whose multipliers the driver holds
LP_CELLS = 500           # up to here the best mixture of the hypotheses is solved for, beyond only averaged
SHRINK = 0.8


def fair_constrained(train: DataFrame, features: list[str], group: str = "sensitive", label: str = "y",
                     constraint: str = "demographic_parity", iterations: int = CONSTRAINED_ITERATIONS, eps: float = 0.01,
                     eta: float = 2.0, seed: int = 42, nu: float | None = None) -> ConstrainedModel:
    """Exponentiated-gradient reduction with a weighted LR best response
    (Agarwal et al. 2018).

    Per iteration: costs reach the rows through a broadcast join of the
    (group[, label]) multiplier table; the relabelled, re-weighted rows train
    an LR; one aggregate measures the new hypothesis' rates and errors per
    cell. Rates are linear in a mixture, so every mixture is known without a
    pass: the average of the plays, and the best mixture of all hypotheses
    (``saddle.Game``). Learning stops when the primal-dual gap of the better of
    the two, checked with a best response of its own, is at most ``nu`` (default:
    half the standard error of the first hypothesis' error), or after
    ``iterations``. The step shrinks while the gap of the average does not fall.

    The driver holds hypotheses x cells numbers; more than ``MAX_CELLS`` cells
    are refused. A null group is a group of its own. ``history`` has, per
    iteration, the gap, violation and error of the mixture and the step.
    """
    key = constraint.strip().lower()
    if key not in ("demographic_parity", "equalized_odds"):
        raise ValueError("Unsupported constraint. Use 'demographic_parity' or 'equalized_odds'.")
    data = train.select(*features, MI._group_text(group).alias("_g"), F.col(label).alias("_y"))
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _constrained(data, features, key == "equalized_odds", iterations, eps, eta, seed, nu)
    finally:
        data.unpersist()


def _constrained(data: DataFrame, features: list[str], eo: bool, iterations: int, eps: float, eta: float,
                 seed: int, nu: float | None) -> ConstrainedModel:
    spark = data.sparkSession
    counts = data.groupBy("_g", "_y").agg(F.count(F.lit(1)).alias("_n")).limit(2 * MAX_CELLS + 3).collect()
    if any(r["_y"] not in (0, 1) for r in counts):
        raise ValueError("Fairness-Constrained Learning requires binary labels encoded as 0/1.")
    cell_keys = ["_g", "_y"] if eo else ["_g"]
    size: dict = {}
    for r in counts:
        cell = tuple(r[k] for k in cell_keys)
        size[cell] = size.get(cell, 0) + r["_n"]
    if len(size) > MAX_CELLS:
        raise ValueError(f"Fairness-Constrained Learning takes up to {MAX_CELLS} groups.")
    cells = sorted(size, key=str)
    share = np.array([size[c] for c in cells], float)
    n = share.sum()
    event = np.array([int(c[-1]) if eo else 0 for c in cells])
    in_event = np.array([share[event == e].sum() for e in event])

    def gamma_of(rates: dict) -> np.ndarray:
        """E[h | cell] - E[h | event of the cell] for every cell."""
        r = np.array([rates.get(c, 0.0) for c in cells])
        return r - np.array([(r * share)[event == e].sum() for e in event]) / in_event
    game = Game(eps, 1.0 / eps)
    models: list = []

    def respond(multipliers: np.ndarray) -> int:
        """The hypothesis of least Lagrangian, fitted and measured."""
        d = multipliers[:len(cells)] - multipliers[len(cells):]
        same = np.array([d[event == e].sum() for e in event])
        cost = d / share - same / in_event
        rows = [(*[str(x) if i == 0 else int(x) for i, x in enumerate(c)], float(v)) for c, v in zip(cells, cost)]
        table, _ = bounded_broadcast(spark.createDataFrame(rows, "_g string, _y int, _lc double" if eo else "_g string, _lc double"))
        c = (1 - 2 * F.col("_y")) / F.lit(float(n)) + F.col("_lc")
        costed = data.join(table, cell_keys).select(*features, (c < 0).cast("int").alias("_lab"), (F.abs(c) * n).alias("_rw"))
        k = costed.agg(F.min("_lab").alias("lo"), F.max("_lab").alias("hi"), F.sum("_rw").alias("sw")).first()
        if k["lo"] == k["hi"] or not k["sw"]:
            model = int(k["lo"] or 0)      # all relabels agree: the constant hypothesis
            scored = data.withColumn("_h", F.lit(model))
        else:
            model = fit(costed, features, ModelSpec("logistic_regression", balanced=False, seed=seed), label="_lab", sample_weight="_rw")
            scored = score(model, data, out="_h")
        got = scored.groupBy(*cell_keys).agg(F.avg("_h").alias("r"), F.sum((F.col("_h") != F.col("_y")).cast("int")).alias("e")).collect()
        models.append(model)
        return game.add(sum(r["e"] for r in got) / n, gamma_of({tuple(r[x] for x in cell_keys): r["r"] for r in got}))

    theta = np.zeros(2 * len(cells))
    total, plays, history = np.zeros(2 * len(cells)), [], []
    best: tuple | None = None
    last = float("inf")
    for t in range(iterations):
        e = np.exp(theta - max(theta.max(initial=0.0), 0.0))
        multipliers = game.bound * e / (np.exp(-max(theta.max(initial=0.0), 0.0)) + e.sum())
        plays.append(respond(multipliers))
        total += multipliers
        if nu is None:
            first = game.errors[0]
            nu = 0.5 * math.sqrt(max(first * (1 - first), 1e-12) / n)
        average = np.bincount(plays, minlength=len(models)) / len(plays)
        averaged = game.gap(average, total / len(plays))
        options = [(averaged, average, total / len(plays))]
        if len(cells) <= LP_CELLS:
            options.append((None, *game.best_mixture()))
        options = [(game.gap(w, m), w, m) for _, w, m in options]
        gap, weights, dual = min(options, key=lambda o: o[0])
        if gap <= nu:          # against the known hypotheses; the best response decides
            respond(dual)
            gap = game.gap(weights, dual)
        if best is None or gap < best[0] or (gap <= nu and game.violation(weights) < game.violation(best[1])):
            best = (gap, weights)
        history.append({"t": t + 1, "gap": gap, "violation": game.violation(weights), "error": game.mixture(weights)[0], "eta": eta})
        if gap <= nu:
            break
        theta = theta + eta * (game.gammas[plays[-1]] - eps)
        if averaged > SHRINK * last:
            eta *= SHRINK
        last = averaged
    weights = best[1] if best else np.ones(0)
    members = [(float(w), m) for w, m in zip(weights, models) if w > 1e-12]
    return ConstrainedModel(members, features, history)


# --------------------------------------------------------------------------
# strategies
# --------------------------------------------------------------------------

# Canonical strategy names.
REWEIGHING = "Reweighing"
CONSTRAINED = "Fairness-Constrained Learning"
THRESHOLD_DP = "Post-Processing Threshold Optimization"
THRESHOLD_EO = "Equalized Odds Post-Processing"
DEBIAS = "Feature Debiasing"
REMOVAL = "Feature Removal or Auditing"


def run_strategy(name: str, train: DataFrame, test: DataFrame, features: list[str],
                 sensitive_col: str = "sensitive", sensitive_name: str | None = None,
                 baseline: PipelineModel | None = None, spec: ModelSpec = ModelSpec(),
                 removal_mode: str = "wide", constrained_iterations: int = CONSTRAINED_ITERATIONS, key: str | None = None):
    """(model, test predictions with ``y_pred``) for one canonical strategy.
    Unknown names, monitoring and resampling fall through to the baseline.
    ``key`` names the row key that seeds the draws of mixed thresholds and of
    the constrained mixture; by
    default the first column, where ``prepare_dataset`` puts it."""
    if name in (REWEIGHING, "Data Reweighing"):
        rw = MI.reweigh(train, sensitive_col, "y")
        m = fit(rw, features, spec, sample_weight="sample_weight")
        return m, score(m, test)
    if name == CONSTRAINED:
        cm = fair_constrained(train, features, sensitive_col, "y", "demographic_parity",
                              iterations=constrained_iterations)
        return cm, cm.predict(test, key=key or test.columns[0])
    if name in (THRESHOLD_DP, THRESHOLD_EO):
        base = fit(train, features, ModelSpec("logistic_regression", seed=spec.seed))
        hull = MX.group_hull(score(base, train), "p1", "y", sensitive_col)
        th = MX.parity_mixture(hull) if name == THRESHOLD_DP else MX.equalized_odds_mixture(hull)
        return (base, th), MX.apply_mixture(score(base, test).drop("y_pred"), th, "p1", sensitive_col, key or test.columns[0])
    if name in (DEBIAS, REMOVAL):
        feats = debiased_features(features, sensitive_name or sensitive_col, removal_mode)
        m = fit(train, feats, spec)
        return m, score(m, test)
    m = baseline or fit(train, features, spec)
    return m, score(m, test)


def save_model(spark, model, path: str, metadata: dict) -> None:
    """ML persistence for the model(s) plus a one-row JSON metadata table.

    A PipelineModel is saved as is; a threshold model as its base model and
    the per-group threshold table; a constrained mixture as its members."""
    if isinstance(model, PipelineModel):
        model.write().overwrite().save(f"{path}/model")
    elif isinstance(model, tuple):
        model[0].write().overwrite().save(f"{path}/model")
        model[1].write.mode("overwrite").parquet(f"{path}/thresholds")
    elif isinstance(model, ConstrainedModel):
        mixture = []  # per member: its weight and, for a constant, its label
        for i, (w, m) in enumerate(model.members):
            mixture.append([w, m if isinstance(m, int) else None])
            if not isinstance(m, int):
                m.write().overwrite().save(f"{path}/member_{i}")
        metadata = dict(metadata, mixture=mixture, mixture_features=list(model.features))
    kind = next(k for k, t in MODEL_KINDS.items() if isinstance(model, t))
    spark.createDataFrame([(json.dumps(dict(metadata, kind=kind), sort_keys=True),)], "metadata string") \
        .write.mode("overwrite").json(f"{path}/metadata")


MODEL_KINDS = {"pipeline": PipelineModel, "thresholds": tuple, "mixture": ConstrainedModel}


def load_model(spark, path: str):
    """What ``save_model`` was given: a PipelineModel, a (base model,
    threshold table) pair, or a constrained mixture with its weights."""
    meta = json.loads(spark.read.json(f"{path}/metadata").first()["metadata"])
    if meta["kind"] == "mixture":
        members = [(w, PipelineModel.load(f"{path}/member_{i}") if label is None else label)
                   for i, (w, label) in enumerate(meta["mixture"])]
        return ConstrainedModel(members, meta["mixture_features"])
    base = PipelineModel.load(f"{path}/model")
    return (base, spark.read.parquet(f"{path}/thresholds")) if meta["kind"] == "thresholds" else base


def predict(model, df: DataFrame, sensitive_col: str = "sensitive", key: str | None = None) -> DataFrame:
    """``y_pred`` of any kind of model that ``run_strategy`` returns."""
    if isinstance(model, ConstrainedModel):
        return model.predict(df, key=key or df.columns[0])
    if isinstance(model, tuple):
        scored = score(model[0], df).drop("y_pred")
        if "b" in model[1].columns:        # saved by a version that kept one level per group
            return MI.apply_group_threshold(scored, model[1], "p1", sensitive_col)
        return MX.apply_mixture(scored, model[1], "p1", sensitive_col, key or df.columns[0])
    return score(model, df)
