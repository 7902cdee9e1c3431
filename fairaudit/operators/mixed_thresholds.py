"""Per-group thresholds that meet a fairness constraint exactly (§2.8), by mixing
two thresholds of a group.

A group's attainable (false, true) positive counts are the points below the
upper hull of its ROC. Every point of a hull edge is reached by using the edge's
two thresholds with probabilities ``p0`` and ``p1``. So the search runs over the
piecewise-linear hulls, not over a grid of target rates:

* the rows become (group, score) counts and, by a distributed prefix sum, ROC
  points (``mitigate.group_roc_exact``);
* every task reduces the points it holds to their hull, with numpy; a group's
  hull is the hull of these (a group of N rows has at most about ``N ** (2/3)``
  vertices, usually some dozens);
* demographic parity: the groups' accuracy curves are concave in the selection
  rate, and so is their sum; a prefix sum of slope changes over all merged
  breakpoints finds where the sum stops rising;
* equalized odds: the lowest hull is concave in the false-positive rate, so the
  best rate is bracketed and the two supporting lines of the bracket are
  intersected until they meet the curve. Groups above it ignore their score with
  the probability that brings them down to it.

Defined results: a null group is ``Unknown``; a row without a score is never
selected by a threshold (it bounds the rates its group can reach); a group
without negatives does not bind the false-positive rate and one without positives
not the true-positive rate. Ties take the smaller rate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from ..session import bounded_broadcast, materialize, ship_package
from .mitigate import _clean_score, _group_text, group_roc_exact
from .prepare import hash_order
from .ranking import prefix_before

FLAT = 1e-9          # a sum of slopes below this share of the rows counts as no rise
NEAR = 1e-12         # rates this close are one breakpoint
LEVELS = 129         # rates evaluated together
ROUNDS = 12

HULL = "grp string, threshold double, tp long, fp long, n_pos long, n_neg long"


def upper_chain(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions of the vertices of the upper hull of points whose ``x`` and ``y``
    never fall. Points on or below the line through their two neighbours cannot be
    vertices and are taken out together, until none is left to take out."""
    at = np.arange(len(x))
    while len(at) > 2:
        px, py = x[at], y[at]
        ax, ay, bx, by = px[1:-1] - px[:-2], py[1:-1] - py[:-2], px[2:] - px[1:-1], py[2:] - py[1:-1]
        one, two = ax.astype(float) * by, ay.astype(float) * bx
        turn = one - two
        unsure = np.flatnonzero(np.abs(turn) <= 1e-14 * (np.abs(one) + np.abs(two)))
        for i in unsure.tolist():       # exact in whole numbers of any size
            turn[i] = float(np.sign(int(ax[i]) * int(by[i]) - int(ay[i]) * int(bx[i])))
        keep = np.concatenate([[True], turn < 0, [True]])
        if keep.all():
            break
        at = at[keep]
    return at


def _chain_of(part):
    part = part.sort_values("threshold", ascending=False, kind="stable")
    return part.iloc[upper_chain(part["fp"].to_numpy(), part["tp"].to_numpy())]


def group_hull(df: DataFrame, score: str, label: str, group: str) -> DataFrame:
    """Vertices of each group's ROC hull: (grp, threshold, tp, fp, n_pos, n_neg);
    predict 1 iff score >= threshold."""
    points = group_roc_exact(df, score, label, group).select("grp", "threshold", "tp", "fp", "n_pos", "n_neg")
    ship_package(df.sparkSession)

    def local(batches: Iterator) -> Iterator:
        for b in batches:
            kept = [_chain_of(part) for _, part in b.groupby("grp", sort=False)]
            yield from kept

    def whole(part):
        return _chain_of(part)
    # a hull of hulls: what a task drops lies below a line between two points it keeps
    return materialize(points.mapInPandas(local, HULL).groupBy("grp").applyInPandas(whole, HULL))


def _edges(hull: DataFrame) -> DataFrame:
    """Hull vertices with their rates and those of the next vertex (``_1``)."""
    P, N = F.col("n_pos"), F.col("n_neg")
    v = hull.select("grp", "threshold", "n_pos", "n_neg", (P + N).alias("n"),
                    F.coalesce(ratio(F.col("tp"), P), F.lit(0.0)).alias("tpr"),
                    F.coalesce(ratio(F.col("fp"), N), F.lit(0.0)).alias("fpr"),
                    ratio(F.col("tp") + F.col("fp"), P + N).alias("rate"),
                    (F.col("tp") + N - F.col("fp")).cast("double").alias("correct"))
    w = Window.partitionBy("grp").orderBy(F.col("threshold").desc())
    return v.select("*", *[F.lead(c).over(w).alias(f"{c}_1") for c in ("threshold", "tpr", "fpr", "rate", "correct")])


def _on_edge(edges: DataFrame, axis: str, x: Column) -> DataFrame:
    """The edge of each group that holds ``axis`` = x, with ``p1``: the share of its
    far end (0 on a vertex)."""
    far = F.col(f"{axis}_1")
    # x within NEAR of the far end counts as the far end, which is the next row's vertex
    e = edges.where((F.col(axis) <= x + NEAR) & (far.isNull() | (far > x + NEAR)))
    p1 = F.greatest((x - F.col(axis)) / (far - F.col(axis)), F.lit(0.0))
    return e.withColumn("p1", F.when(far.isNull() | (p1 <= NEAR), F.lit(0.0)).otherwise(p1))


def _between(c: str) -> Column:
    return F.when(F.col("p1") == 0, F.col(c)).otherwise(F.col(c) + F.col("p1") * (F.col(f"{c}_1") - F.col(c)))


def _mixture(picked: DataFrame, *more: Column) -> DataFrame:
    return picked.select(
        "grp", (1 - F.col("p1")).alias("p0"), F.col("threshold").alias("threshold0"), "p1",
        F.when(F.col("p1") == 0, F.col("threshold")).otherwise(F.col("threshold_1")).alias("threshold1"), *more)


def parity_mixture(hull: DataFrame) -> DataFrame:
    """Demographic parity: the common selection rate with the most correct
    predictions, each group's two thresholds and their probabilities: (grp, p0,
    threshold0, p1, threshold1, p_ignore, prediction_constant, selection_rate,
    target_rate, accuracy); expected rates, equal in all groups."""
    edges = materialize(_edges(hull))
    reach = edges.groupBy("grp").agg(F.max("rate").alias("top"), F.max("n").alias("n"))
    bounds = reach.agg(F.min("top").alias("top"), F.sum("n").alias("n")).first()
    if bounds["n"] is None:
        return _mixture(_on_edge(edges, "rate", F.lit(0.0)), *_parity_columns(0.0, 1))
    slope = (F.col("correct_1") - F.col("correct")) / (F.col("rate_1") - F.col("rate"))
    w = Window.partitionBy("grp").orderBy(F.col("threshold").desc())
    turns = (edges.select("grp", "threshold", "rate", F.coalesce(slope, F.lit(0.0)).alias("s"))
             .select("rate", (F.col("s") - F.coalesce(F.lag("s").over(w), F.lit(0.0))).alias("turn"))
             .groupBy("rate").agg(F.sum("turn").alias("turn")))
    rising = F.col("turn_before") + F.col("turn")
    best = (prefix_before(turns, [], "rate", ["turn"])
            .where((rising <= FLAT * bounds["n"]) | (F.col("rate") >= bounds["top"])).agg(F.min("rate")).first()[0])
    x = min(best, bounds["top"])
    return _mixture(_on_edge(edges, "rate", F.lit(x)), *_parity_columns(x, bounds["n"]))


def _parity_columns(x: float, n: int) -> list[Column]:
    every = Window.partitionBy(F.lit(0))         # over a row per group
    return [F.lit(0.0).alias("p_ignore"), F.lit(x).alias("prediction_constant"), _between("rate").alias("selection_rate"),
            F.lit(x).alias("target_rate"), (F.sum(_between("correct")).over(every) / F.lit(float(n))).alias("accuracy")]


def _lowest(edges: DataFrame, xs: list[float]) -> dict[float, tuple[float, float, float]]:
    """Lowest hull at some rates: value, slope to its right and to its left."""
    levels = F.array(*[F.lit(float(x)) for x in xs])
    a, b = F.col("fpr"), F.col("fpr_1")
    last = b.isNull()
    e = edges.where("n_pos > 0").select(
        "fpr", "tpr", "fpr_1", "tpr_1",
        F.explode(F.filter(levels, lambda x: (x >= a) & (last | (x <= b)))).alias("x"))
    x = F.col("x")
    slope = (F.col("tpr_1") - F.col("tpr")) / (b - a)
    flat = last | (b == a)
    y = F.when(flat, F.greatest(F.col("tpr"), F.coalesce(F.col("tpr_1"), F.col("tpr")))).otherwise(F.col("tpr") + slope * (x - a))
    at = e.select("x", F.round(y, 12).alias("y"), slope.alias("s"), last.alias("last"),
                  ((x < b) | last).alias("right"), ((x > a) & ~flat).alias("left"), (b == a).alias("up"))
    got = at.where(~F.coalesce("up", F.lit(False))).groupBy("x").agg(
        F.min(F.when(F.col("right"), F.struct("y", F.coalesce("s", F.lit(0.0)).alias("s")))).alias("r"),
        F.min(F.when(F.col("left"), F.struct("y", (-F.col("s")).alias("s")))).alias("l"))
    return {r["x"]: (r["r"]["y"], r["r"]["s"], -r["l"]["s"] if r["l"] else r["r"]["s"]) for r in got.collect() if r["r"]}


def equalized_odds_mixture(hull: DataFrame) -> DataFrame:
    """Equalized odds: the false-positive rate at which the lowest hull is most
    accurate. (grp, p0, threshold0, p1, threshold1, p_ignore,
    prediction_constant, fpr, tpr, eo_gap, accuracy): with ``p_ignore`` the label is 1
    with probability ``prediction_constant``; expected rates are equal in all groups."""
    edges = materialize(_edges(hull))
    total = edges.groupBy("grp").agg(F.max("n_pos").alias("p"), F.max("n_neg").alias("n"),
                                     F.max(F.when(F.col("n_neg") > 0, F.col("fpr"))).alias("top"))
    t = total.agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.min("top").alias("top")).first()
    p, n, top = t["p"] or 0, t["n"] or 0, t["top"] or 0.0
    x = _best_fpr(edges, p, n, top) if p and n else 0.0
    low = _lowest(edges, [x]).get(x, (0.0,))[0] if p else 0.0
    picked = _on_edge(edges, "fpr", F.lit(x))
    y = _between("tpr")
    above = F.when((F.col("n_pos") > 0) & (y - low > NEAR), (y - low) / (y - x)).otherwise(F.lit(0.0))
    out = _mixture(picked, above.alias("p_ignore"), F.lit(x).alias("prediction_constant"),
                   (above * x + (1 - above) * _between("fpr")).alias("fpr"), (above * x + (1 - above) * y).alias("tpr"),
                   F.col("n_pos").alias("_p"), F.col("n_neg").alias("_n"))
    every = Window.partitionBy(F.lit(0))
    spread = [F.max(F.when(F.col(k) > 0, F.col(c))).over(every) - F.min(F.when(F.col(k) > 0, F.col(c))).over(every)
              for c, k in (("tpr", "_p"), ("fpr", "_n"))]
    right = F.sum(F.col("tpr") * F.col("_p") + (1 - F.col("fpr")) * F.col("_n")).over(every)
    return out.select("*", F.greatest(*[F.coalesce(s, F.lit(0.0)) for s in spread]).alias("eo_gap"),
                      (right / F.lit(float(max(1, p + n)))).alias("accuracy")).drop("_p", "_n")


def _best_fpr(edges: DataFrame, p: int, n: int, top: float) -> float:
    """Maximum of ``p * lowest(x) - n * x`` over [0, top], a concave function."""
    lo, hi, best = 0.0, top, 0.0
    for _ in range(ROUNDS):
        xs = sorted({lo + (hi - lo) * i / (LEVELS - 1) for i in range(LEVELS)} | {lo, hi})
        at = _lowest(edges, xs)
        xs = [x for x in xs if x in at]
        value = {x: p * at[x][0] - n * x for x in xs}
        b = max(range(len(xs)), key=lambda i: (value[xs[i]], -xs[i]))
        best = xs[b]
        flat = FLAT * (p + n)
        if (b == 0 and p * at[best][1] - n <= flat) or (b == len(xs) - 1 and p * at[best][2] - n >= -flat):
            return best
        left, right = xs[max(0, b - 1)], xs[min(len(xs) - 1, b + 1)]
        up, down = p * at[left][1] - n, p * at[right][2] - n       # supporting lines of the bracket
        if up <= flat:
            return left
        if up - down > 0:
            cross = (value[right] - value[left] + up * left - down * right) / (up - down)
            near = edges.where(F.abs(F.col("fpr") - cross) <= NEAR).agg(F.min("fpr")).first()[0]
            cross = min(max(near if near is not None else cross, left), right)
            got = _lowest(edges, [cross]).get(cross)
            if got and p * got[0] - n * cross >= value[left] + up * (cross - left) - flat:
                return cross
        lo, hi = left, right
    return best


def apply_mixture(df: DataFrame, mixture: DataFrame, score: str, group: str, key: str,
                  seed: int = 42, out: str = "y_pred") -> DataFrame:
    """Labels drawn with the mixture's probabilities from a uniform number that
    md5 of 'seed:key' gives to the row, so results repeat; 0 for a group that the
    mixture does not know. The table of groups is broadcast after a size check."""
    names = ["p0", "threshold0", "p1", "threshold1", "p_ignore", "prediction_constant"]
    t, _ = bounded_broadcast(mixture.select(F.col("grp").alias("_grp"), *[F.col(c).alias(f"_{c}") for c in names]))
    s = _clean_score(score)
    by_score = sum((F.when(s >= F.col(f"_threshold{i}"), F.col(f"_p{i}")).otherwise(F.lit(0.0)) for i in (0, 1)), F.lit(0.0))
    chance = F.col("_p_ignore") * F.col("_prediction_constant") + (1 - F.col("_p_ignore")) * by_score
    u = F.conv(F.substring(hash_order(F.col(key), seed), 1, 12), 16, 10).cast("double") / float(16 ** 12)
    j = df.join(t, _group_text(group) == F.col("_grp"), "left")
    return j.withColumn(out, F.coalesce((u < chance).cast("int"), F.lit(0))).drop("_grp", *[f"_{c}" for c in names])
