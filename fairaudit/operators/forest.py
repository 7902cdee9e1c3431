"""Random forests grown on cells: rows that fall into the same bins.

A tree of Spark ML sees a row only as the bins of its features, its label and
its weight. Rows alike in all three are one cell with a count, and what a tree
draws of its rows (Poisson(1) each) is Poisson(count) for the cell. So two or
three passes over the rows (cut points, cells) do for all levels of all trees;
the trees grow side by side, each in one task on the broadcast table of cells,
by the rules of Spark ML (``test_forest_cells.py`` compares them node by node).

The table of cells is checked before it is gathered; a forest whose cells are
too many, or whose settings are not known here, is left to Spark ML.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import named
from ..session import materialize, scratch_path, ship_package, small_batches

CELL_BYTES = 64 * 1024 * 1024   # largest table of cells that is broadcast
CELL_FEATURES = 1000            # with more features a batch of rows is too wide
GROUPS = 2_000_000              # groups of values, over all features, that are held at a time
CLASSES = 100                   # labels that Spark ML takes without metadata
PREFIXES = (24, 32, 40, 48, 56, 64)     # bits by which a column's values are told apart, pass by pass
HISTOGRAM = 1_000_000           # sums that a level of a tree holds at a time
EPSILON = float(np.finfo(float).eps)


def cell_forest(data: DataFrame, features: list[str], label: str, weight: str,
                clf: RandomForestClassifier) -> RandomForestClassificationModel | None:
    """The forest of ``clf`` over ``data``, or None where Spark ML has to grow it
    (or to refuse it: a label, weight or feature it does not take)."""
    if not _known(data, features, label, clf):
        return None
    rows = data.select(*[named(c).cast("double").alias(f"_{i}") for i, c in enumerate(features)],
                       F.col(label).cast("long").alias("_y"), F.col(weight).cast("double").alias("_w"))
    ship_package(data.sparkSession)
    with small_batches(data.sparkSession):
        cuts = cut_points(rows, len(features), clf.getMaxBins())
        cells = None if cuts is None else gathered_cells(rows, cuts)
    return None if cells is None else _forest(data, label, weight, cells, cuts, clf)


def _known(data: DataFrame, features: list[str], label: str, clf: RandomForestClassifier) -> bool:
    fields = [data.schema[c] for c in features]
    plain = all(isinstance(f.dataType, (T.NumericType, T.BooleanType)) and "ml_attr" not in f.metadata for f in fields)
    return (plain and 0 < len(features) <= CELL_FEATURES and isinstance(data.schema[label].dataType, T.IntegralType)
            and "ml_attr" not in data.schema[label].metadata and clf.getMaxBins() <= 256
            and clf.getImpurity() == "gini" and clf.getSubsamplingRate() == 1.0
            and clf.getMinWeightFractionPerNode() == 0.0 and clf.getFeatureSubsetStrategy() in ("auto", "all", "sqrt"))


def _matrix(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    """Features as rows of a matrix, a null as NaN, -0.0 as 0.0."""
    return np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)], dtype=float) + 0.0


# --------------------------------------------------------------------------
# cut points
# --------------------------------------------------------------------------

def _ordered_bits(v: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the values."""
    u = v.view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(u & top, ~u, u | top)


def _prefix(v: np.ndarray, bits: int) -> np.ndarray:
    return (_ordered_bits(v) >> np.uint64(64 - bits)).view(np.int64)


def _merged(key: np.ndarray, w: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    keys, at = np.unique(key, return_inverse=True)
    least, most = np.full(len(keys), np.inf), np.full(len(keys), -np.inf)
    np.minimum.at(least, at, lo)
    np.maximum.at(most, at, hi)
    return keys, np.bincount(at, weights=w, minlength=len(keys)), least, most


def _batch(columns) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["f", "key", "w", "lo", "hi"])


REFUSED = _batch([[-1], [0], [0.0], [0.0], [0.0]])


def _value_groups(rows: DataFrame, columns: int, bits: int, within: dict[int, np.ndarray] | None, before: int) -> dict[int, tuple] | None:
    """Per feature (weight, least, most) of the values that share their first
    ``bits`` bits; with ``within`` only of those whose first ``before`` bits are
    in it. None if a value, label or weight is one that Spark ML refuses, or for
    more than ``GROUPS``."""
    wanted = range(columns) if within is None else sorted(within)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {f: [] for f in wanted}
        new, refused = dict.fromkeys(wanted, 0), False
        for batch in batches:
            if refused:
                continue
            x = _matrix(batch, columns)
            w = np.asarray(batch.column(columns + 1).to_numpy(zero_copy_only=False), dtype=float)
            if not (np.isfinite(x).all() and np.isfinite(w).all() and (w >= 0).all() and batch.column(columns).null_count == 0):
                refused = True
                continue
            for f in wanted:
                v, vw = x[f], w
                if within is not None:
                    inside = np.isin(_prefix(v, before), within[f])
                    v, vw = v[inside], w[inside]
                held[f].append(_merged(_prefix(v, bits), vw, v, v))
                new[f] += len(held[f][-1][0])
            for f in wanted:
                if new[f] > 40_000 or sum(new.values()) > GROUPS:
                    held[f] = [_merged(*(np.concatenate(p) for p in zip(*held[f])))]
                    new[f] = 0
            refused = sum(len(part[0]) for parts in held.values() for part in parts) > 2 * GROUPS
        if refused:
            yield REFUSED
            return
        for f in wanted:
            if held[f]:
                key, w, lo, hi = _merged(*(np.concatenate(p) for p in zip(*held[f])))
                yield _batch([np.full(len(key), f), key, w, lo, hi])
    groups = (rows.mapInArrow(run, "f int, key long, w double, lo double, hi double").groupBy("f", "key")
              .agg(F.sum("w").alias("w"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).limit(GROUPS + 1).toArrow())
    f, w, lo, hi = (groups.column(c).to_numpy() for c in ("f", "w", "lo", "hi"))
    if len(f) > GROUPS or (f < 0).any():
        return None
    order = np.lexsort((lo, f))
    at = np.searchsorted(f[order], [[i, i + 1] for i in wanted])
    return {i: (w[order[a:b]], lo[order[a:b]], hi[order[a:b]]) for i, (a, b) in zip(wanted, at)}


def cut_points(rows: DataFrame, columns: int, bins: int) -> list[np.ndarray] | None:
    """Per feature the cuts between its bins, as Spark ML sets them (halfway
    between neighbouring values: all of them, or else where the weight passes
    another share of 1 / ``bins``), though from all rows and not from 10,000.

    Values are told apart by their first bits. A group of values that stays
    whole has at most 1 / (32 ``bins``) of the weight; others are told apart by
    further bits in a further pass, which most columns do not need."""
    groups = _value_groups(rows, columns, PREFIXES[0], None, 0)
    # sums of weights differ in their last digits with the order of rows
    light = {f: w.sum() / (32 * bins) * (1 + 1e-9) for f, (w, _, _) in (groups or {}).items()}
    for before, bits in zip(PREFIXES, PREFIXES[1:]):
        if groups is None:
            return None
        coarse = {}
        for f, (w, lo, hi) in groups.items():
            whole = (lo < hi) & ((w > light[f]) | (len(w) <= bins))
            if whole.any():
                coarse[f] = whole
        if not coarse:
            break
        finer = _value_groups(rows, columns, bits, {f: _prefix(groups[f][1][whole], before) for f, whole in coarse.items()}, before)
        if finer is None:
            return None
        for f, whole in coarse.items():
            groups[f] = tuple(np.concatenate([old[~whole], new]) for old, new in zip(groups[f], finer[f]))
    if groups is None or any(w.sum() <= 0 for w, _, _ in groups.values()):
        return None
    return [_cuts(*groups[f], bins - 1) for f in range(columns)]


def _cuts(w: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int) -> np.ndarray:
    order = np.argsort(lo)
    w, lo, hi = w[order], lo[order], hi[order]
    middle = hi[:-1] / 2 + lo[1:] / 2
    middle = np.where((middle >= hi[:-1]) & (middle < lo[1:]), middle, hi[:-1])
    if len(middle) <= most:
        return middle
    upto, total = np.cumsum(w), w.sum()
    cuts, target = [], total / (most + 1)
    for i in range(1, len(w)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target) - 1e-9 * total:
            cuts.append(middle[i - 1])
            target += total / (most + 1)
    return np.array(cuts[:most])


# --------------------------------------------------------------------------
# cells
# --------------------------------------------------------------------------

def gathered_cells(rows: DataFrame, cuts: list[np.ndarray]) -> dict | None:
    """bins (features x cells), y, w, n of the cells in a fixed order; None if
    they are more than ``CELL_BYTES`` or have labels that Spark ML refuses."""
    columns = len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, columns)
            bins = np.empty((batch.num_rows, columns), np.uint8)
            for f in range(columns):
                bins[:, f] = np.searchsorted(cuts[f], x[f], side="left")
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * columns
            key = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(bins)])
            yield pa.RecordBatch.from_arrays([key, batch.column(columns), batch.column(columns + 1)], ["key", "_y", "_w"])
    cells = materialize(rows.mapInArrow(run, "key binary, _y long, _w double").groupBy("key", "_y", "_w")
                        .agg(F.count(F.lit(1)).alias("n")))
    count, least, most = cells.agg(F.count(F.lit(1)), F.min("_y"), F.max("_y")).first()
    if not count or count * (columns + 24) > CELL_BYTES or least < 0 or most >= CLASSES:
        return None
    table = cells.orderBy("key", "_y", "_w").toArrow()
    bins = np.frombuffer(b"".join(table.column("key").to_pylist()), np.uint8).reshape(count, columns)
    y, w, n = (table.column(c).to_numpy() for c in ("_y", "_w", "n"))
    return {"bins": np.ascontiguousarray(bins.T), "y": y, "w": w, "n": n, "classes": int(most) + 1}


# --------------------------------------------------------------------------
# trees
# --------------------------------------------------------------------------

def _gini(stats: np.ndarray) -> np.ndarray:
    total = stats.sum(axis=-1)
    share = stats / np.where(total > 0, total, 1.0)[..., None]
    return np.where(total > 0, 1.0 - (share * share).sum(axis=-1), 0.0)


def _best_splits(bins, y, m, mw, cell, pos, tried, stats, raw, width, classes, least, min_gain):
    """Per open node (feature, last bin to the left, gain, left and right sums of
    weights and of rows) of its best split; gain -inf where none is allowed.
    ``cell`` and ``pos``: the cells still open and the node each is in."""
    nodes, size = len(tried), bins.shape[1]
    flat = bins.reshape(-1)
    best = {"gain": np.full(nodes, -np.inf), "feature": np.full(nodes, -1), "bin": np.zeros(nodes, np.int64),
            "left": np.zeros((nodes, classes)), "right": np.zeros((nodes, classes)),
            "left_raw": np.zeros(nodes, np.int64), "right_raw": np.zeros(nodes, np.int64)}
    at_node = pos * width
    label, weight, drawn = y[cell], mw[cell], m[cell].astype(float)
    parent, every = _gini(stats), np.arange(nodes)
    for s in range(tried.shape[1]):
        at = at_node + flat[tried[pos, s] * size + cell]
        sums = np.bincount(at * classes + label, weights=weight, minlength=nodes * width * classes).reshape(nodes, width, classes)
        rows = np.bincount(at, weights=drawn, minlength=nodes * width).reshape(nodes, width)
        left = np.cumsum(sums, axis=1)[:, :-1]
        right = np.cumsum(sums[:, ::-1], axis=1)[:, ::-1][:, 1:]       # summed, not subtracted: no rest of rounding
        left_raw = np.cumsum(rows, axis=1)[:, :-1]
        right_raw = raw[:, None] - left_raw
        lw, rw = left.sum(axis=2), right.sum(axis=2)
        total = np.where(lw + rw > 0, lw + rw, 1.0)
        gain = parent[:, None] - lw / total * _gini(left) - rw / total * _gini(right)
        gain[(left_raw < least) | (right_raw < least) | (gain < min_gain)] = -np.inf
        i = gain.argmax(axis=1)
        better = np.flatnonzero(gain[every, i] > best["gain"])
        j = i[better]
        best["gain"][better] = gain[better, j]
        best["feature"][better] = tried[better, s]
        best["bin"][better] = j
        for name, from_ in (("left", left), ("right", right), ("left_raw", left_raw), ("right_raw", right_raw)):
            best[name][better] = from_[better, j]
    return best


def grow_tree(cells: dict, tree: int, p: dict) -> dict[str, np.ndarray]:
    """One tree as a table of its nodes, parents before children, pruned as Spark
    ML does: two leaves that say the same become one. What it draws depends on
    the seed, the tree's number and the cells alone."""
    bins, y, classes = cells["bins"], cells["y"], cells["classes"]
    columns, width = bins.shape[0], p["bins"]
    rng = np.random.default_rng([p["seed"] % 2 ** 64, tree])
    m = rng.poisson(cells["n"]) if p["bootstrap"] else cells["n"]
    mw = m * cells["w"]
    cell = np.flatnonzero(m)
    pos = np.zeros(len(cell), np.int64)
    stats = [np.bincount(y[cell], weights=mw[cell], minlength=classes)[None, :]]
    raw = [np.array([m.sum()], np.int64)]
    levels = []
    open_ = np.zeros(1, np.int64)        # of the nodes of this level, those that may be split
    for depth in range(p["depth"] + 1):
        st, rw = stats[depth], raw[depth]
        nodes = len(st)
        level = {"gain": np.full(nodes, -1.0), "feature": np.full(nodes, -1), "bin": np.zeros(nodes, np.int64), "child": np.full(nodes, -1),
                 "impurity": _gini(st)}
        levels.append(level)
        if depth == p["depth"] or not len(open_):
            break
        if p["tried"] < columns:
            tried = rng.random((len(open_), columns)).argsort(axis=1)[:, :p["tried"]]
        else:
            tried = np.broadcast_to(np.arange(columns), (len(open_), columns))
        step = max(1, HISTOGRAM // (width * classes))
        if len(open_) > step:
            order = pos.argsort(kind="stable")
            cell, pos = cell[order], pos[order]
        parts = []
        for start in range(0, len(open_), step):
            some = open_[start:start + step]
            a, b = (0, len(pos)) if len(open_) <= step else np.searchsorted(pos, [start, start + step])
            parts.append(_best_splits(bins, y, m, mw, cell[a:b], pos[a:b] - start, tried[start:start + step], st[some], rw[some],
                                      width, classes, p["least"], p["min_gain"]))
        best = {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}
        level["impurity"][open_[np.isneginf(best["gain"])]] = -1.0       # as Spark ML marks them
        split = np.flatnonzero(best["gain"] > 0)
        if not len(split):
            break
        at = open_[split]
        level["gain"][at], level["feature"][at], level["bin"][at] = best["gain"][split], best["feature"][split], best["bin"][split]
        level["child"][at] = 2 * np.arange(len(split))
        stats.append(np.stack([best["left"][split], best["right"][split]], axis=1).reshape(-1, classes))
        raw.append(np.stack([best["left_raw"][split], best["right_raw"][split]], axis=1).reshape(-1))
        open_ = np.flatnonzero(np.abs(_gini(stats[-1])) >= EPSILON)
        child = np.full(len(best["gain"]), -1)
        child[split] = level["child"][at]
        inner = child[pos] >= 0
        cell, pos = cell[inner], pos[inner]
        to = child[pos] + (bins[best["feature"][pos], cell] > best["bin"][pos])
        slot = np.full(len(stats[-1]), -1)
        slot[open_] = np.arange(len(open_))
        inner = slot[to] >= 0
        cell, pos = cell[inner], slot[to][inner]
    return _node_table(levels, stats, raw)


def _node_table(levels, stats, raw) -> dict[str, np.ndarray]:
    said = [s.argmax(axis=1) for s in stats]
    for depth in range(len(levels) - 2, -1, -1):
        child, below = levels[depth]["child"], levels[depth + 1]["child"]
        inner = np.flatnonzero(child >= 0)
        left = child[inner]
        same = (below[left] < 0) & (below[left + 1] < 0) & (said[depth + 1][left] == said[depth + 1][left + 1])
        child[inner[same]] = -1
    kept, out, first = np.zeros(1, np.int64), [], 0
    for depth, level in enumerate(levels):
        child = level["child"][kept]
        inner = child >= 0
        after = first + len(kept)
        left = np.where(inner, after + 2 * (np.cumsum(inner) - 1), -1)
        out.append({"id": first + np.arange(len(kept)), "prediction": said[depth][kept].astype(float), "impurity": level["impurity"][kept],
                    "stats": stats[depth][kept], "raw": raw[depth][kept], "gain": np.where(inner, level["gain"][kept], -1.0),
                    "left": left, "right": np.where(inner, left + 1, -1), "feature": np.where(inner, level["feature"][kept], -1),
                    "bin": level["bin"][kept]})
        kept = np.stack([child[inner], child[inner] + 1], axis=1).reshape(-1)
        first = after
        if not len(kept):
            break
    return {k: np.concatenate([o[k] for o in out]) for k in out[0]}


NODES = "treeID int, id int, prediction double, impurity double, stats array<double>, rawCount long, gain double, leftChild int, rightChild int, feature int, threshold double"


def _forest(data: DataFrame, label: str, weight: str, cells: dict, cuts: list[np.ndarray], clf: RandomForestClassifier) -> RandomForestClassificationModel:
    spark = data.sparkSession
    trees, columns = clf.getNumTrees(), len(cuts)
    everything = clf.getFeatureSubsetStrategy() == "all" or (clf.getFeatureSubsetStrategy() == "auto" and trees == 1)
    p = {"seed": clf.getSeed(), "depth": clf.getMaxDepth(), "bins": max(2, max(len(c) for c in cuts) + 1), "bootstrap": clf.getBootstrap(),
         "tried": columns if everything else int(np.ceil(np.sqrt(columns))), "least": clf.getMinInstancesPerNode(), "min_gain": clf.getMinInfoGain()}
    shared = spark.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                t = grow_tree(shared.value, tree, p)
                at = [float(cuts[f][b]) if f >= 0 else None for f, b in zip(t["feature"], t["bin"])]
                columns = [np.full(len(at), tree), t["id"], t["prediction"], t["impurity"], list(t["stats"]), t["raw"], t["gain"], t["left"], t["right"], t["feature"], at]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
    i4, f8 = pa.int32(), pa.float64()
    kinds, names = [i4, i4, f8, f8, pa.list_(f8), pa.int64(), f8, i4, i4, i4, f8], [c.split()[0] for c in NODES.split(", ")]
    nodes = spark.range(0, trees, 1, trees).mapInArrow(run, NODES)
    cut = F.when(F.col("threshold").isNull(), F.array().cast("array<double>")).otherwise(F.array("threshold"))
    split = F.struct(F.col("feature").alias("featureIndex"), cut.alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    node = F.struct("id", "prediction", "impurity", F.col("stats").alias("impurityStats"), "rawCount", "gain", "leftChild", "rightChild", split.alias("split"))
    # Spark ML writes the settings of the forest, with trees of one node over a row per
    # class; its node table is then put in place of theirs
    path = scratch_path(spark, "forest-cells")
    stub = spark.createDataFrame([(Vectors.dense([0.0] * columns), float(c), 1.0) for c in range(cells["classes"])], ["_features", label, weight])
    clf.fit(stub).write().save(path)
    nodes.select("treeID", node.alias("nodeData")).repartition(8).write.mode("overwrite").parquet(f"{path}/data")
    shared.destroy()
    return RandomForestClassificationModel.load(path)
