"""Proxy features (§2.6): correlation of every feature with the sensitive
attribute, top-k, and the proxy flag.

* Pearson: one aggregate over the rows with a guarded correlation per feature
  (``covar_pop / (stddev_pop * stddev_pop)`` on pairwise-complete values;
  undefined -> null -> skipped).
* Spearman and Kendall: the rows are first reduced to one row per
  (feature, value) holding the count of each sensitive code (partial
  aggregation; the sensitive attribute has few codes). Average ranks and the
  concordance counts come from a distributed prefix sum over that table;
  there is no row-level self-join, no join back to the rows and no window
  over a whole feature in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import named
from ..functions.labels import NUMERIC
from ..session import Scratch, bounded_broadcast, materialize, reuse, ship_package
from .prepare import ordinal_codes
from .ranking import average_ranks, prefix_before

MAX_CODES = 256  # up to here rank correlations keep one count column per sensitive code


class TooManyCodes(ValueError):
    """More sensitive codes than one count column each allows."""


def _is_num(dt) -> bool:
    return isinstance(dt, NUMERIC) or isinstance(dt, T.BooleanType)


def encode(df: DataFrame, sensitive: str, features: list[str], keep=()) -> DataFrame:
    """Sensitive and features as doubles: numeric as is (NaN -> null),
    text as codes of the sorted values with null -> 'Unknown'; ``keep``
    columns pass through unchanged."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [sensitive] + features
    text = [c for c in cols if not _is_num(types[c])]
    base = df.select(*[named(c) for c in (*keep, *cols)])
    coded = ordinal_codes(base, text) if text else base
    out = [named(k) for k in keep]
    for c in cols:
        v = named(c).cast("double")
        out.append(F.nanvl(v, F.lit(None).cast("double")).alias("_s" if c == sensitive else c))
    return coded.select(*out)


def _features(df: DataFrame, sensitive: str, features) -> list[str]:
    return list(features) if features else [c for c in df.columns if c != sensitive]


def pearson(df: DataFrame, sensitive: str, features=None, slice_cols=()) -> DataFrame:
    """(slice..., feature, position, correlation) -- unrounded; undefined
    skipped. Text codes are the sorted values of the whole table.

    Features are unpivoted to (feature, x, code) inside the scan stage and
    aggregated by feature, so the aggregation buffer stays a handful of
    fields (whole-stage codegen; one wide aggregate with ~10 fields per
    feature would exceed the codegen field limit) and the pass is single."""
    sl = list(slice_cols)
    feats = [f for f in _features(df, sensitive, features) if f not in sl]
    enc = encode(df, sensitive, feats, keep=sl)
    long = (enc.unpivot(sl + ["_s"], [named(f) for f in feats], "feature", "x")
               .where(F.col("x").isNotNull() & F.col("_s").isNotNull()))
    x, y = F.col("x"), F.col("_s")
    r = long.groupBy(*sl, "feature").agg(
        F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("correlation"))
    return (r.join(F.broadcast(_positions(df, feats)), "feature")
             .where(F.col("correlation").isNotNull() & ~F.isnan("correlation"))
             .select(*sl, "feature", "position", "correlation"))


def _cell_key(sl: list[str]):
    """One text key per (slice..., feature), computed in Spark on both sides."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sl] + [F.col("feature")]
    return F.concat_ws("\u0001", *parts)


def code_table(df: DataFrame, sensitive: str, features=None, slice_cols=()):
    """(slice..., feature, x, c0..cK-1, _k): per value the count of rows with
    each sensitive code (pairwise-complete rows), persisted; the code list,
    the feature list, and the per-(slice, feature, code) marginals keyed by
    ``_k`` (slices x features x codes numbers on the driver)."""
    sl = list(slice_cols)
    feats = [f for f in _features(df, sensitive, features) if f not in sl]
    enc = encode(df, sensitive, feats, keep=sl)
    codes = sorted(r[0] for r in enc.select("_s").where(F.col("_s").isNotNull()).distinct()
                   .limit(MAX_CODES + 1).collect())
    if len(codes) > MAX_CODES:
        raise TooManyCodes(f"one count column per code needs at most {MAX_CODES} sensitive codes")
    cn = [f"c{k}" for k in range(len(codes))]
    long = (enc.unpivot(sl + ["_s"], [named(f) for f in feats], "feature", "x")
               .where(F.col("x").isNotNull() & F.col("_s").isNotNull()))
    X = long.groupBy(*sl, "feature", "x").agg(
        *[F.sum(F.when(F.col("_s") == v, 1).otherwise(0)).cast("double").alias(name)
          for v, name in zip(codes, cn)])
    X = reuse(X.withColumn("_k", _cell_key(sl)))
    marg = {r["_k"]: [r[c] for c in cn]
            for r in X.groupBy("_k").agg(*[F.sum(c).alias(c) for c in cn]).collect()}
    return X, codes, cn, feats, marg


def _code_ranks(u: list[float]) -> tuple[float, list[float]]:
    """Total W and the average rank of each code given its count u_k."""
    below, ranks = 0.0, []
    for n in u:
        ranks.append(below + (n + 1) / 2.0)
        below += n
    return below, ranks


def _key_map(values: dict, dtype: str = "double"):
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast(dtype))])


def _finish(r: DataFrame, df: DataFrame, feats: list[str], sl: list[str]) -> DataFrame:
    return (r.join(F.broadcast(_positions(df, feats)), "feature")
             .where(F.col("correlation").isNotNull() & ~F.isnan("correlation"))
             .select(*sl, "feature", "position", "correlation"))


def spearman(df: DataFrame, sensitive: str, features=None, slice_cols=()) -> DataFrame:
    """Pearson correlation of average ranks, pairwise complete, per slice.

    Ranks of x: one distributed prefix sum over (slice, feature, x). Ranks of
    the codes: from the per-(slice, feature, code) marginals. cov = sum over
    values of sum_k c_k (rx - m)(rs_k - m), with m = (W + 1) / 2."""
    sl = list(slice_cols)
    try:
        X, codes, cn, feats, marg = code_table(df, sensitive, features, sl)
    except TooManyCodes:
        return _spearman_cells(df, sensitive, features, sl)
    info = {}
    for k, u in marg.items():
        W, rs = _code_ranks(u)
        m = (W + 1) / 2.0
        info[k] = (m, [r - m for r in rs], sum(n * (r - m) ** 2 for n, r in zip(u, rs)))
    t = sum((F.col(c) for c in cn), F.lit(0.0))
    pre = prefix_before(X.withColumn("_t", t), sl + ["feature"], "x", ["_t"])
    key = F.col("_k")
    mcol = _key_map({k: v[0] for k, v in info.items()})[key]
    dx = F.col("_t_before") + (F.col("_t") + 1) / 2.0 - mcol
    cov_terms = sum((F.col(c) * _key_map({k: v[1][j] for k, v in info.items()})[key]
                     for j, c in enumerate(cn)), F.lit(0.0))
    a = pre.groupBy(*sl, "feature", "_k").agg(F.sum(dx * cov_terms).alias("cov"),
                                               F.sum(F.col("_t") * dx * dx).alias("vx"))
    vs = _key_map({k: v[2] for k, v in info.items()})[key]
    r = a.select(*sl, "feature", F.try_divide(F.col("cov"), F.sqrt(F.col("vx") * vs)).alias("correlation"))
    X.unpersist()
    return _finish(r, df, feats, sl)


def _spearman_cells(df: DataFrame, sensitive: str, features, sl: list[str]) -> DataFrame:
    """Spearman for any number of sensitive values: counts per (slice,
    feature, x, s) cell, average ranks of both sides from distributed prefix
    sums, joined back to the cells."""
    feats = [f for f in _features(df, sensitive, features) if f not in sl]
    keys = sl + ["feature"]
    long = (encode(df, sensitive, feats, keep=sl).unpivot(sl + ["_s"], [named(f) for f in feats], "feature", "x")
            .where(F.col("x").isNotNull() & F.col("_s").isNotNull()))
    cells = materialize(long.groupBy(*keys, "x", "_s").agg(F.count(F.lit(1)).alias("_c")))
    rx = average_ranks(cells, "x", keys, "_rx", "_c").drop("_n")
    rs = average_ranks(cells, "_s", keys, "_rs", "_c").drop("_n")
    total, _ = bounded_broadcast(cells.groupBy(*keys).agg(((F.sum("_c") + 1) / 2.0).alias("_mid")))
    j = cells.join(rx, keys + ["x"]).join(rs, keys + ["_s"]).join(total, keys)
    dx, ds, c = F.col("_rx") - F.col("_mid"), F.col("_rs") - F.col("_mid"), F.col("_c")
    r = j.groupBy(*keys).agg(F.try_divide(F.sum(c * dx * ds), F.sqrt(F.sum(c * dx * dx) * F.sum(c * ds * ds))).alias("correlation"))
    return _finish(r, df, feats, sl)


def _positions(df: DataFrame, feats: list[str]) -> DataFrame:
    rows = [(f, df.columns.index(f)) for f in feats]
    return df.sparkSession.createDataFrame(rows, "feature string, position int")


def kendall(df: DataFrame, sensitive: str, features=None, slice_cols=()) -> DataFrame:
    """Kendall tau-b per (slice, feature) from concordant/discordant counts.

    For the row of value x with per-code counts c_k and per-code counts B_k
    of all rows with smaller x: concordant += sum_k c_k * sum_{j<k} B_j,
    discordant += sum_k c_k * sum_{j>k} B_j. Ties enter through the x and
    code marginals.
    """
    sl = list(slice_cols)
    try:
        X, codes, cn, feats, marg = code_table(df, sensitive, features, sl)
    except TooManyCodes:
        return _kendall_cells(df, sensitive, features, sl)
    pre = prefix_before(X, sl + ["feature"], "x", cn)
    conc, disc = F.lit(0.0), F.lit(0.0)
    for k in range(len(codes)):
        lower = sum((F.col(f"{cn[j]}_before") for j in range(k)), F.lit(0.0))
        upper = sum((F.col(f"{cn[j]}_before") for j in range(k + 1, len(codes))), F.lit(0.0))
        conc = conc + F.col(cn[k]) * lower
        disc = disc + F.col(cn[k]) * upper
    t = sum((F.col(x) for x in cn), F.lit(0.0))
    agg = pre.groupBy(*sl, "feature", "_k").agg(F.sum(conc).alias("C"), F.sum(disc).alias("D"),
                                                 F.sum(t * (t - 1) / 2).alias("n1"), F.sum(t).alias("N"))
    n2 = _key_map({k: sum(u * (u - 1) / 2 for u in us) for k, us in marg.items()})[F.col("_k")]
    n0 = F.col("N") * (F.col("N") - 1) / 2
    tau = F.try_divide(F.col("C") - F.col("D"), F.sqrt((n0 - F.col("n1")) * (n0 - n2)))
    r = agg.select(*sl, "feature", tau.alias("correlation"))
    X.unpersist()
    return _finish(r, df, feats, sl)


def _kendall_cells(df: DataFrame, sensitive: str, features, sl: list[str]) -> DataFrame:
    """Kendall tau-b for any number of sensitive values.

    Quantiles cut every feature, and the sensitive column, into blocks of
    values; a value that is itself a quantile is a block of its own, so the rows
    of any other block are bounded however often a value repeats. A pair of rows
    is counted once:

    * in different blocks of both columns: from the counts per (block, block);
    * in one block of x: by the task that has this block;
    * in one block of s but two of x: by the task that has this block of s, with
      the number of the block of x in place of x.

    A block of one value has no pairs to count, its rows go to no task. So each
    row is shuffled at most twice per feature, and no pair of rows is written.
    """
    feats = [f for f in _features(df, sensitive, features) if f not in sl]
    spark = df.sparkSession
    ship_package(spark)
    slice_key = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sl]) if sl else F.lit("")
    cols = [f"f{i}" for i in range(len(feats))]     # whatever the columns are called
    kind = "f int, z string"
    with Scratch(spark) as scratch:
        enc = scratch.staged(
            encode(df, sensitive, feats, keep=sl).where(F.col("_s").isNotNull())
            .select(*sl, slice_key.alias("_z"), "_s", *[named(f).alias(c) for f, c in zip(feats, cols)]), "kendall_values")
        cuts = _cut_values(enc, ["_s", *cols])

        def blocked(batches):
            for b in batches:
                s, z = b["_s"].to_numpy(), b["_z"]
                sb = _block_numbers(s, cuts["_s"])
                for i, c in enumerate(cols):
                    x = b[c].to_numpy()
                    there = ~np.isnan(x)
                    yield pd.DataFrame({"f": np.int32(i), "z": z[there], "xb": _block_numbers(x[there], cuts[c]), "sb": sb[there],
                                        "x": x[there], "s": s[there]})

        def counted(b):
            c, z = pd.factorize(b["z"])
            score, tied = _signed_pairs(c, b["u"].to_numpy(), b["v"].to_numpy())
            by_s = bool(b["side"].iloc[0])
            return pd.DataFrame({"f": b["f"].iloc[0], "z": z, "cd": score, "n1": 0.0 if by_s else tied, "n2": tied if by_s else 0.0, "n": 0.0})

        def crossed(b):
            score, n1, n2, n = _signed_cells(b["xb"].to_numpy(), b["sb"].to_numpy(), b["n"].to_numpy())
            return pd.DataFrame({"f": b["f"].iloc[:1], "z": b["z"].iloc[:1], "cd": score, "n1": n1, "n2": n2, "n": n})

        rows = scratch.staged(enc.select("_z", "_s", *cols).mapInPandas(blocked, f"{kind}, xb int, sb int, x double, s double"), "kendall_blocks")
        sums = f"{kind}, cd double, n1 double, n2 double, n double"
        side = lambda by_s, block, u, v: F.struct(
            F.lit(by_s).alias("side"), F.col(block).alias("block"), F.col(u).alias("u"), F.col(v).cast("double").alias("v"))
        inner = (rows.select("f", "z", F.explode(F.array(side(0, "xb", "x", "s"), side(1, "sb", "s", "xb"))).alias("r"))
                 .select("f", "z", "r.*").where("block % 2 = 0")
                 .groupBy("f", "side", "block").applyInPandas(counted, sums))
        outer = (rows.groupBy("f", "z", "xb", "sb").agg(F.count(F.lit(1)).cast("double").alias("n"))
                 .groupBy("f", "z").applyInPandas(crossed, sums))
        total = inner.unionByName(outer).groupBy("f", "z").agg(*[F.sum(c).alias(c) for c in ("cd", "n1", "n2", "n")])
        n0 = F.col("n") * (F.col("n") - 1) / 2
        tau = F.try_divide(F.col("cd"), F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2"))))
        names = spark.createDataFrame(list(enumerate(feats)), "f int, feature string")
        r = total.join(F.broadcast(names), "f").select("z", "feature", tau.alias("correlation"))
        if sl:
            r = r.join(enc.select(*sl, F.col("_z").alias("z")).distinct(), "z")
        r = materialize(r.select(*sl, "feature", "correlation"))
    return _finish(r, df, feats, sl)


BLOCK_ROWS = 50_000   # rows of a block of values, where BLOCKS are enough
BLOCKS = 500          # most cuts of a column: the counts per (block, block) of a feature stay below 1,001 x 1,001


def _cut_values(enc: DataFrame, cols: list[str]) -> dict:
    """Per column at most ``BLOCKS`` - 1 of its values, sorted, with at most about
    ``BLOCK_ROWS`` (beyond ``BLOCKS`` of them, rows / ``BLOCKS``) rows between two."""
    n = min(BLOCKS, -(-enc.count() // BLOCK_ROWS))
    if n < 2:
        return {c: np.empty(0) for c in cols}
    at = [i / n for i in range(1, n)]
    got = enc.agg(*[F.percentile_approx(c, at, 20 * n).alias(c) for c in cols]).first()
    return {c: np.unique(np.array(got[c] or [], float)) for c in cols}


def _block_numbers(v: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Even numbers for the values between two cuts, odd ones for a cut itself;
    they grow with the value."""
    i = np.searchsorted(cuts, v)
    return (2 * i + (np.append(cuts, np.nan)[i] == v)).astype(np.int32)


def _signed_pairs(z: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per code of z: the sum of sign(du) * sign(dv) over its pairs of rows, and the
    number of its pairs equal in u.

    Two positions of u differ first at one bit. From the highest bit on, the rows
    are kept sorted by (z, higher bits of the position, v): each row with the bit
    set meets the rows without it that have a smaller and a larger v.
    """
    k, m = int(z.max()) + 1, len(z)
    pos, w = np.unique(u, return_inverse=True)[1], np.unique(v, return_inverse=True)[1]
    groups, size = np.unique(z * (int(pos.max()) + 1) + pos, return_counts=True)
    tied = np.bincount(groups // (int(pos.max()) + 1), size * (size - 1) / 2, k)
    order = np.lexsort((w, z))
    z, pos, w = z[order], pos[order], w[order]
    score, part = np.zeros(k), z
    row = np.arange(m)
    for bit in reversed(range(int(pos.max()).bit_length())):
        hi = (pos >> bit) & 1
        starts = np.append(True, part[1:] != part[:-1])
        run = starts | np.append(True, w[1:] != w[:-1])
        first, run_first = np.flatnonzero(starts), np.flatnonzero(run)
        at, run_at = np.cumsum(starts) - 1, np.cumsum(run) - 1
        low = np.append(0, np.cumsum(1 - hi))       # rows without the bit before each row
        before = low[first][at]
        smaller = low[run_first][run_at] - before
        larger = low[np.append(first[1:], m)][at] - low[np.append(run_first[1:], m)][run_at]
        score += np.bincount(z, hi * (smaller - larger), k)
        # rows without the bit first, each half still in order of v
        lows = low[:-1] - before
        to = first[at] + np.where(hi == 1, low[np.append(first[1:], m)][at] - before + (row - first[at] - lows), lows)
        moved = np.empty_like(row)
        moved[to] = row
        part = (2 * at + hi)[moved]
        z, pos, w = z[moved], pos[moved], w[moved]
    return score, tied


def _signed_cells(xb: np.ndarray, sb: np.ndarray, n: np.ndarray) -> tuple[float, float, float, float]:
    """From the counts of rows per (block of x, block of s): the sum of sign(dx) * sign(ds)
    over the pairs in different blocks of both, the pairs equal in x and those equal in s
    within blocks of one value, and the rows."""
    (xs, i), (ss, j) = np.unique(xb, return_inverse=True), np.unique(sb, return_inverse=True)
    cells = np.zeros((len(xs), len(ss)))
    cells[i, j] = n
    below = np.cumsum(cells, axis=0) - cells
    upto = np.cumsum(below, axis=1)
    score = (cells * (upto - below - (upto[:, -1:] - upto))).sum()
    pairs = lambda c: float((c * (c - 1) / 2).sum())
    return float(score), pairs(cells.sum(axis=1)[xs % 2 == 1]), pairs(cells.sum(axis=0)[ss % 2 == 1]), float(cells.sum())


METHODS = {"pearson": pearson, "spearman": spearman, "kendall": kendall}


def correlations(df: DataFrame, sensitive: str, method: str = "pearson", features=None,
                 slice_cols=()) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    return METHODS[method](df, sensitive, features, slice_cols)


def top_k(corr: DataFrame, k: int = 5, keys=()) -> DataFrame:
    """Top k by |correlation| (unrounded) descending, ties in column order."""
    if k <= 0:
        raise ValueError("top_k must be a positive integer.")
    w = Window.partitionBy(*keys) if keys else None
    order = [F.abs(F.col("correlation")).desc(), F.col("position").asc()]
    if w is None:
        # the correlation table has one row per feature: a bounded sort
        ranked = corr.orderBy(*order).limit(k)
        wr = Window.orderBy(*order)
        return ranked.select("*", F.row_number().over(wr).alias("rank"))
    return (corr.select("*", F.row_number().over(w.orderBy(*order)).alias("rank"))
                .where(F.col("rank") <= k))


def flag(top: DataFrame, threshold: float = 0.50) -> DataFrame:
    """Features of the top list with |rounded correlation| >= threshold."""
    rc = F.round(F.col("correlation"), 6)
    return top.where(F.abs(rc) >= threshold).select("*", F.abs(rc).alias("abs_correlation"))
