"""Packing documents into sequences by non-negative least squares.

1. One pass over the texts makes ids and cuts every document into whole windows
   and one rest; only lengths and checksums are kept, no ids.
2. The histogram of piece lengths (at most ``window`` numbers, whatever the
   corpus) goes to the driver. Lengths are put into bins of ``UNIT`` tokens, all
   combinations of up to ``DEPTH`` bins that fill the window are enumerated, and
   non-negative least squares gives how often to use each. Repeat counts are
   rounded down to what the bins hold; the longest lengths of a bin are used
   first. What is left, and the space the combinations leave, is packed
   greedily, longest first, best fit.
3. The plan says, for the k-th piece of a length, which sequence and offset it
   gets. Pieces are numbered per length through counts per (length, bucket), so
   a length that a third of all pieces share is numbered by many tasks.

The plan's size depends on window, unit and depth only; it is sent to the tasks.

Defined results: a null or empty text is the end id alone. Null ids and repeated
rows are packed like any other row. An empty table gives an empty result. Only
``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package, small_batches, staged
from .registry import read_table, register
from .tokens import encode_texts, vocabulary_path

WINDOW = 4096
END_ID = 2
UNIT = 32
DEPTH = 4
BUCKET_PIECES = 5_000        # pieces numbered together

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Whole windows and the rest of every document, with checksums of their ids."""
    ship_package(docs.sparkSession)

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            ids = batch.column("doc_id").to_pylist()
            at = 0
            texts = batch.column("text")
            while at < len(ids):     # a few documents at a time: texts stay in Arrow until used
                part = texts.slice(at, 256).to_pylist()
                for doc_id, data in zip(ids[at:at + 256], encode_texts(part, path)):
                    data += end
                    n = len(data) // 4
                    for start in range(0, n, window):
                        piece = data[4 * start:4 * (start + window)]
                        rows["doc_id"].append(doc_id)
                        rows["start"].append(start)
                        rows["length"].append(len(piece) // 4)
                        rows["ids_crc32"].append(zlib.crc32(piece))
                        rows["doc_tokens"].append(n)
                at += 256
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["start"], pa.int64()),
                 pa.array(rows["length"], pa.int32()), pa.array(rows["ids_crc32"], pa.int64()),
                 pa.array(rows["doc_tokens"], pa.int64())], names=list(rows))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def combinations(total: int, depth: int, allowed: list[int]) -> list[tuple[int, ...]]:
    """Non-increasing tuples of up to ``depth`` allowed bins that sum to ``total``."""
    found: list[tuple[int, ...]] = []
    ok = sorted(allowed, reverse=True)
    in_set = set(ok)

    def extend(prefix: tuple[int, ...], rest: int) -> None:
        if len(prefix) == depth - 1:
            if rest in in_set and (not prefix or rest <= prefix[-1]):
                found.append((*prefix, rest))
            return
        for b in ok:
            if b > rest or (prefix and b > prefix[-1]):
                continue
            if b == rest:
                found.append((*prefix, b))
            elif b * (depth - len(prefix)) >= rest:
                extend((*prefix, b), rest - b)
    extend((), total)
    return found


def nnls(a: np.ndarray, b: np.ndarray, max_steps: int | None = None) -> np.ndarray:
    """min |a x - b| with x >= 0, by an active set (Lawson and Hanson)."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    tol = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(max_steps or 3 * a.shape[0] + 10):
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tol:
            break
        free[j] = True
        while True:
            k = np.flatnonzero(free)
            s = np.linalg.lstsq(a[:, k], b, rcond=None)[0]
            if (s > tol * 1e-3).all():
                x[:] = 0
                x[k] = s
                break
            bad = s <= tol * 1e-3
            step = np.min(x[k][bad] / np.maximum(x[k][bad] - s[bad], 1e-300))
            x[k] += min(max(step, 0.0), 1.0) * (s - x[k])
            drop = k[bad & (x[k] <= tol * 1e-3)]
            if not len(drop):
                drop = k[bad][:1]
            x[drop] = 0
            free[drop] = False
            if not free.any():
                break
    return x


class _Open:
    """Groups of equal, not yet full sequences, by free space."""

    def __init__(self, window: int) -> None:
        self.window, self.free, self.groups, self.full = window, [], {}, []

    def push(self, rest: int, count: int, content: tuple) -> None:
        if rest == 0:
            self.full.append((count, content))
        else:
            if rest not in self.groups:
                bisect.insort(self.free, rest)
                self.groups[rest] = []
            self.groups[rest].append((count, content))

    def place(self, length: int, n: int) -> None:
        """Best fit of ``n`` pieces of one length, many sequences at a time."""
        while n:
            i = bisect.bisect_left(self.free, length)
            if i == len(self.free):
                m = min(self.window // length, n)
                self.push(self.window - m * length, n // m, ((length, m),))
                n %= m
                continue
            rest = self.free[i]
            count, content = self.groups[rest].pop()
            if not self.groups[rest]:
                del self.groups[rest]
                self.free.pop(i)
            m = min(rest // length, n)
            used = min(count, n // m)
            if used < count:
                self.push(rest, count - used, content)
            self.push(rest - m * length, used, (*content, (length, m)))
            n -= used * m

    def all(self) -> list[tuple[int, tuple]]:
        return self.full + [g for groups in self.groups.values() for g in groups]


def plan(histogram: dict[int, int], window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> list[tuple[int, tuple]]:
    """Kinds of sequences: (how many, ((length, pieces of it), ...))."""
    left = {n: c for n, c in histogram.items() if c > 0}
    bins: dict[int, list[int]] = {}
    for n in sorted(left, reverse=True):
        bins.setdefault(-(-n // unit), []).append(n)
    space = _Open(window)
    combos = combinations(-(-window // unit), depth, list(bins))
    if combos:
        order = sorted(bins)
        at = {b: i for i, b in enumerate(order)}
        a = np.zeros((len(order), len(combos)))
        for j, c in enumerate(combos):
            for b in c:
                a[at[b], j] += 1
        have = np.array([sum(left[n] for n in bins[b]) for b in order], dtype=float)
        scale = 1.0 / np.sqrt(np.maximum(have, 1.0))
        x = nnls(a * scale[:, None], have * scale)
        for j in np.argsort(-x, kind="stable"):
            need = a[:, j]
            use = need > 0
            count = int(min(np.floor(x[j] + 1e-6), np.min(have[use] // need[use])))
            if count <= 0:
                continue
            have -= need * count
            for content, k in _fill(combos[j], count, bins, left):
                space.push(window - sum(n * m for n, m in content), k, content)
    for n in sorted(left, reverse=True):
        if left[n]:
            space.place(n, left[n])
    return space.all()


def _fill(combo: tuple[int, ...], count: int, bins: dict, left: dict) -> Iterator[tuple[tuple, int]]:
    """Takes the longest lengths of each bin for ``count`` sequences of a
    combination; gives runs of sequences with the same lengths."""
    runs = []
    for b in combo:
        mine, need = [], count
        for n in bins[b]:
            k = min(left[n], need)
            if k:
                mine.append((n, k))
                left[n] -= k
                need -= k
            if not need:
                break
        runs.append(mine)
    ends = sorted(set(itertools.chain.from_iterable(np.cumsum([k for _, k in r]).tolist() for r in runs)))
    at = 0
    for e in ends:
        lengths = [r[bisect.bisect_right(np.cumsum([k for _, k in r]).tolist(), at)][0] for r in runs]
        yield tuple((n, lengths.count(n)) for n in sorted(set(lengths), reverse=True)), e - at
        at = e


def plan_arrays(kinds: list[tuple[int, tuple]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces of it in a sequence, first
    sequence, offset) in order of rank."""
    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    base = 0
    for count, content in kinds:
        offset = 0
        for n, m in content:
            rank = ranks.get(n, 0)
            rows.setdefault(n, []).append((rank, m, base, offset))
            ranks[n] = rank + count * m
            offset += n * m
        base += count
    return {n: np.array(r, dtype=np.int64) for n, r in rows.items()}


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``."""
    spark = docs.sparkSession
    with small_batches(spark):
        cut = staged(pieces(docs, path, window, end_id), "pack-pieces")
    per_length = cut.groupBy("length").count().collect()         # at most ``window`` rows
    table = plan_arrays(plan({r["length"]: r["count"] for r in per_length}, window))
    n = sum(r["count"] for r in per_length)
    buckets = max(1, n // BUCKET_PIECES)
    p = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("long"))
    before = (p.groupBy("length", "bucket").count()
               .withColumn("before", F.sum("count").over(
                   Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
               .select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before")))
    numbered = (p.withColumn("_k", F.row_number().over(
                    Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1)
                 .join(before, ["length", "bucket"])
                 .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("_k")).alias("rank")))
    shared = spark.sparkContext.broadcast(table)

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa
        rows = shared.value
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for v in np.unique(length):
                k = np.flatnonzero(length == v)
                t = rows[int(v)]
                r = t[np.searchsorted(t[:, 0], rank[k], side="right") - 1]
                d = rank[k] - r[:, 0]
                seq[k] = r[:, 2] + d // r[:, 1]
                off[k] = r[:, 3] + (d % r[:, 1]) * int(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(length.astype(np.int64)), b.column(3), b.column(4), pa.array(seq), pa.array(off)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    ship_package(spark)
    return numbered.mapInArrow(assign, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


@register("op10_pack")
def op10_pack(spark, sf_dir):
    return pack(read_table(spark, sf_dir, "documents"), vocabulary_path())
