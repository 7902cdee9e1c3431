"""Distributed exact order statistics: dense index, average ranks, medians.

None of these uses an unpartitioned window over rows. Ranks come from a
range-partitioned sort plus per-partition offsets (a table with one row per
partition); medians from approximate-quantile brackets narrowed until the
candidate values are few enough to settle on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import named
from ..session import bounded_broadcast, reuse

# A candidate set at most this large (distinct values in the bracket) is
# settled on the driver; larger ones are narrowed by another pass.
SETTLE_MAX = 20_000
QUANTILE_ACCURACY = 10_000


def _partition_offsets(counted: DataFrame, pid: str, cnt: str) -> DataFrame:
    """(pid, offset) prefix sums over the per-partition counts (tiny table)."""
    w = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(pid, F.coalesce(F.sum(cnt).over(w), F.lit(0)).alias("offset"))


def dense_index(values: DataFrame, order_col: str, index_col: str = "idx",
                partitions: int | None = None) -> DataFrame:
    """0-based position of each (distinct) value in sort order.

    ``values`` must hold one row per distinct ``order_col`` value. Range
    partitioning sorts it across tasks; each task numbers its rows and adds
    the count of all rows in earlier partitions.
    """
    n_parts = partitions or values.sparkSession.sparkContext.defaultParallelism
    # partition ids and row ids must be the same in every later use: the
    # range bounds are sampled and the ids are positional, so fix them once.
    ranged = reuse(values.repartitionByRange(n_parts, order_col)
                         .sortWithinPartitions(order_col)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"), F.min("_mid").alias("_m0"))
    offs, _ = bounded_broadcast(
        _partition_offsets(counts, "_pid", "_c").join(counts.select("_pid", "_m0"), "_pid"))
    j = ranged.join(offs, "_pid")
    # within a partition monotonically_increasing_id is consecutive in row order
    return j.select(*[c for c in values.columns],
                    (F.col("offset") + F.col("_mid") - F.col("_m0")).alias(index_col))


def prefix_before(df: DataFrame, keys: list[str], order_col: str, values: list[str],
                  suffix: str = "_before") -> DataFrame:
    """For each row, the sum of ``values`` over rows with the same ``keys``
    and a smaller ``order_col`` (one row per (keys, order) value expected).

    Distributed: range partitioning on (keys, order) spreads a key's rows over
    many tasks; sums within a task come from a window on (partition, keys),
    and the totals of earlier tasks from a table with one row per
    (partition, key), broadcast after a size check.
    """
    n_parts = df.sparkSession.sparkContext.defaultParallelism
    # range bounds are sampled: fix the partition of every row once, so the
    # in-partition sums and the per-partition totals agree
    r = reuse(df.repartitionByRange(n_parts, *keys, order_col)
                    .withColumn("_pid", F.spark_partition_id()))
    w = (Window.partitionBy("_pid", *keys).orderBy(order_col)
         .rowsBetween(Window.unboundedPreceding, -1))
    within = r.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"_w_{v}") for v in values])
    tot = r.groupBy("_pid", *keys).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    wo = (Window.partitionBy(*keys).orderBy("_pid")
          .rowsBetween(Window.unboundedPreceding, -1))
    offs = tot.select("_pid", *keys, *[F.coalesce(F.sum(f"_t_{v}").over(wo), F.lit(0)).alias(f"_o_{v}")
                                      for v in values])
    offs_b, _ = bounded_broadcast(offs)
    j = within.join(offs_b, ["_pid", *keys])
    return j.select(*df.columns, *[(F.col(f"_w_{v}") + F.col(f"_o_{v}")).alias(f"{v}{suffix}")
                                   for v in values])


def average_ranks(df: DataFrame, value_col: str, keys: list[str] | None = None,
                  rank_col: str = "rank", count_col: str | None = None) -> DataFrame:
    """1-based average rank of each distinct value per key (ties share the
    mean rank): ``below(v) + (count(v) + 1) / 2`` on the (value, count)
    histogram. ``count_col`` names a weight column when ``df`` is already a
    histogram."""
    keys = keys or []
    nn = F.col(count_col) if count_col else F.lit(1)
    hist = (df.where(F.col(value_col).isNotNull())
            .groupBy(*keys, value_col).agg(F.sum(nn).alias("_n")))
    pre = prefix_before(hist, keys, value_col, ["_n"])
    return pre.select(*keys, value_col, "_n",
                      (F.col("_n_before") + (F.col("_n") + 1) / 2.0).alias(rank_col))


def exact_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact median of each numeric column (nulls ignored; mean of the two
    middle values for an even count), in a few passes over the data.

    Pass 1 counts each column and brackets its median between two
    approximate quantiles (rank error at most ``n / accuracy``). Each further
    pass counts the values below and inside the bracket; a bracket that
    misses the middle ranks is widened, one holding at most ``SETTLE_MAX``
    values is settled from its (value, count) histogram, a larger one is
    narrowed by approximate quantiles of the values inside it.
    """
    if not cols:
        return {}
    names = cols
    cols = [f"c{i}" for i in range(len(names))]         # whatever the columns are called
    d = df.select(*[named(n).cast("double").alias(c) for n, c in zip(names, cols)])
    eps = 3.0 / QUANTILE_ACCURACY
    first = d.agg(*[F.count(c).alias(f"n_{i}") for i, c in enumerate(cols)],
                  *[F.percentile_approx(c, [max(0.0, 0.5 - eps), min(1.0, 0.5 + eps)],
                                        QUANTILE_ACCURACY).alias(f"q_{i}") for i, c in enumerate(cols)]).first()
    state, result = {}, {c: None for c in cols}
    for i, c in enumerate(cols):
        n = first[f"n_{i}"]
        if n:
            lo, hi = first[f"q_{i}"]
            state[c] = {"ks": sorted({(n - 1) // 2, n // 2}), "lo": lo, "hi": hi}
    pending = list(state)
    while pending:
        aggs = []
        for c in pending:
            s = state[c]
            aggs.append(F.count(F.when(_in_bracket(F.col(c), s["lo"], s["hi"]), 1)).alias(f"m_{c}"))
            aggs.append(F.count(F.when(_below(F.col(c), s["lo"]), 1)).alias(f"b_{c}"))
        stats = d.agg(*aggs).first()
        settle, narrow, again = [], [], []
        for c in pending:
            s = state[c]
            prev = s.get("m")
            s["below"], s["m"] = stats[f"b_{c}"], stats[f"m_{c}"]
            if s["lo"] is not None and s["below"] > s["ks"][0]:
                s["lo"] = s["m"] = None  # bracket starts above the middle: widen down
                again.append(c)
                continue
            if s["hi"] is not None and s["below"] + s["m"] <= s["ks"][-1]:
                s["hi"] = s["m"] = None  # bracket ends below the middle: widen up
                again.append(c)
                continue
            if s["lo"] is not None and s["lo"] == s["hi"]:
                result[c] = float(s["lo"])  # every bracketed value is the median
                continue
            no_progress = prev is not None and s["m"] >= prev
            (settle if s["m"] <= SETTLE_MAX or no_progress else narrow).append(c)
        if settle:
            _settle(d, settle, state, result)
        if narrow:
            qaggs = []
            for c in narrow:
                s = state[c]
                m = s["m"]
                p_lo = max(0.0, (s["ks"][0] - s["below"]) / m - eps)
                p_hi = min(1.0, (s["ks"][-1] - s["below"]) / m + eps)
                v = F.when(_in_bracket(F.col(c), s["lo"], s["hi"]), F.col(c))
                qaggs.append(F.percentile_approx(v, [p_lo, p_hi], QUANTILE_ACCURACY).alias(f"q_{c}"))
            q = d.agg(*qaggs).first()
            for c in narrow:
                state[c]["lo"], state[c]["hi"] = q[f"q_{c}"]
        pending = narrow + again
    return {n: result[c] for n, c in zip(names, cols)}


def _below(c, lo):
    return c < F.lit(lo) if lo is not None else F.lit(False)


def _in_bracket(c, lo, hi):
    cond = c.isNotNull()
    if lo is not None:
        cond = cond & (c >= F.lit(lo))
    if hi is not None:
        cond = cond & (c <= F.lit(hi))
    return cond


def _settle(d: DataFrame, cols: list[str], state: dict, result: dict) -> None:
    """Histogram of the bracketed values (bounded) -> exact middle values."""
    parts = [d.where(_in_bracket(F.col(c), state[c]["lo"], state[c]["hi"]))
              .select(F.lit(c).alias("col"), F.col(c).alias("v")) for c in cols]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    hist = u.groupBy("col", "v").agg(F.count(F.lit(1)).alias("n")).collect()
    by_col: dict[str, list] = {c: [] for c in cols}
    for r in hist:
        by_col[r["col"]].append((r["v"], r["n"]))
    for c in cols:
        s = state[c]
        vals = sorted(by_col[c])
        picks = []
        for k in s["ks"]:
            target = k - s["below"]
            acc = 0
            for v, n in vals:
                if acc + n > target:
                    picks.append(v)
                    break
                acc += n
        result[c] = sum(picks) / len(picks) if picks else None
        if result[c] is not None and math.isnan(result[c]):
            result[c] = None
