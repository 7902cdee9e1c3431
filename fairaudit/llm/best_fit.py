"""Best-fit packing with exact complements found by hashing length sums.

1. One pass makes the ids and cuts documents that are longer than a sequence into
   whole sequences (the first piece is the shorter one). Lengths and checksums
   are kept, no ids. Each task numbers its pieces per length as it goes.
2. The histogram of piece lengths (at most ``window`` numbers, whatever the
   corpus) goes to the driver. Three tables, addressed by sum, count the single
   lengths, pairs and triples that are still available; taking a length away
   updates them by shifts. The longest piece left opens a sequence; if one, two
   or three lengths fill its gap exactly they are taken, as often as the counts
   allow; if none do, the longest piece that fits is added and the gap looked up
   again.
3. Pieces for which no exact filling was left are packed by best fit, longest
   first.
4. The plan says, for the k-th piece of a length, which sequence and offset it
   gets; k is the piece's number in its task plus the pieces of that length in
   the tasks before, so a length that a third of all pieces share is numbered by
   many tasks.

The plan's size depends on the window only; it is sent to the tasks.

Defined results: a null or empty text is the end id alone. Null ids and repeated
rows are packed like any other row. An empty table gives an empty result. Only
``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package, staged
from .byte_tokens import encode_column
from .registry import read_table, register
from .tokens import vocabulary_path

WINDOW = 2048
END_ID = 0

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, k long"


def whole_pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Documents in pieces of at most ``window`` ids; ``part`` and ``k`` number the pieces of a length."""
    ship_package(docs.sparkSession)

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"]
        part = TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, stop_at, encoded in encode_column(batch.column(1).cast(pa.string()), path):
                rows = []
                for doc_id, data in zip(ids[at:stop_at], encoded):
                    data += end
                    n = len(data) // 4
                    start, number = 0, 0
                    stop = n % window or window
                    while start < n:
                        length = stop - start
                        rows.append((doc_id, number, start, length, zlib.crc32(data[4 * start:4 * stop]), part, seen[length]))
                        seen[length] += 1
                        start, stop, number = stop, stop + window, number + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


class Sums:
    """Available lengths, and how many ordered pairs and triples of them have each sum."""

    def __init__(self, counts: dict[int, int], window: int) -> None:
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        for n, c in counts.items():
            self.count[n] = c
        self.one = (self.count > 0).astype(np.int64)
        self.two = np.convolve(self.one, self.one)[:window + 1]
        self.three = np.convolve(self.two, self.one)[:window + 1]

    def _shift(self, a: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(a)
        if by <= self.window:
            out[by:] = a[:self.window + 1 - by]
        return out

    def take(self, n: int, k: int) -> None:
        """``k`` pieces of length ``n`` are used; the last one leaves all sums."""
        self.count[n] -= k
        if self.count[n] == 0 and self.one[n]:
            self.three -= 3 * self._shift(self.two, n) - 3 * self._shift(self.one, 2 * n)
            if 3 * n <= self.window:
                self.three[3 * n] -= 1
            self.two -= 2 * self._shift(self.one, n)
            if 2 * n <= self.window:
                self.two[2 * n] += 1
            self.one[n] = 0

    def largest(self, most: int) -> int:
        """The longest available length of at most ``most`` (0: none)."""
        at = np.flatnonzero(self.one[:most + 1])
        return int(at[-1]) if len(at) else 0

    def filling(self, gap: int) -> tuple[int, ...] | None:
        """Available lengths that fill a gap exactly: one, else two, else three."""
        if self.one[gap]:
            return (gap,)
        if self.two[gap]:
            found = self._pair(gap, gap)
            if found:
                return found
        if self.three[gap]:
            for a in np.flatnonzero(self.one[:gap])[::-1].tolist():
                if 3 * a < gap:
                    break
                if self.two[gap - a]:
                    found = self._pair(gap - a, a, a)
                    if found:
                        return (a, *found)
        return None

    def _pair(self, total: int, most: int, taken: int = 0) -> tuple[int, int] | None:
        """Two lengths of at most ``most`` with a sum; ``taken`` is in use once already."""
        low = np.arange(max(1, total - most), total // 2 + 1)
        for b in low[(self.one[low] > 0) & (self.one[total - low] > 0)].tolist():
            a = total - b
            need = {a: 0, b: 0}
            for x in (a, b, taken):
                if x in need:
                    need[x] += 1
            if all(self.count[x] >= m for x, m in need.items()):
                return a, b
        return None


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, tuple]]:
    """Kinds of sequences: (how many, ((length, pieces of it), ...))."""
    sums = Sums({n: c for n, c in histogram.items() if c > 0}, window)
    done: list[tuple[int, tuple]] = []
    left: dict[int, int] = {}

    def times(content: list[int]) -> int:
        return min(int(sums.count[n]) // content.count(n) for n in set(content))

    def use(content: list[int], k: int) -> None:
        done.append((k, tuple((n, content.count(n)) for n in sorted(set(content), reverse=True))))
        for n in set(content):
            sums.take(n, k * content.count(n))

    while longest := sums.largest(window):
        content, gap = [longest], window - longest
        kept = int(sums.count[longest])
        while gap:
            # what the sequence holds already is not available to fill it
            filling = sums.filling(gap)
            if filling and times([*content, *filling]) > 0:
                content += filling
                break
            n = sums.largest(gap)
            while n and times([*content, n]) == 0:
                n = sums.largest(n - 1)
            if not n:
                break
            content.append(n)
            gap -= n
        if sum(content) == window:
            use(content, times(content))
        else:
            left[longest] = left.get(longest, 0) + kept
            sums.take(longest, kept)
    return done + _best_fit(left, window)


def _best_fit(left: dict[int, int], window: int) -> list[tuple[int, tuple]]:
    """Longest first into the fullest sequence that has room, many equal ones at a time."""
    free: list[int] = []                                 # sorted room of open groups
    groups: dict[int, list[tuple[int, tuple]]] = {}
    full: list[tuple[int, tuple]] = []

    def put(room: int, k: int, content: tuple) -> None:
        if room == 0:
            full.append((k, content))
            return
        if room not in groups:
            insort(free, room)
            groups[room] = []
        groups[room].append((k, content))
    for n in sorted(left, reverse=True):
        todo = left[n]
        while todo:
            i = bisect_left(free, n)
            if i == len(free):
                m = min(window // n, todo)
                k = todo // m
                put(window - m * n, k, ((n, m),))
                todo -= k * m
                continue
            room = free[i]
            k, content = groups[room].pop()
            if not groups[room]:
                del groups[room]
                free.pop(i)
            m = min(room // n, todo)
            used = min(k, todo // m)
            if used < k:
                put(room, k - used, content)
            put(room - m * n, used, (*content, (n, m)))
            todo -= used * m
    return full + [g for held in groups.values() for g in held]


def places(kinds: list[tuple[int, tuple]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces of it in a sequence, first
    sequence, offset) in order of rank."""
    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    base = 0
    for k, content in kinds:
        offset = 0
        for n, m in content:
            rank = ranks.get(n, 0)
            rows.setdefault(n, []).append((rank, m, base, offset))
            ranks[n] = rank + k * m
            offset += n * m
        base += k
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def best_fit_pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    spark = docs.sparkSession
    cut = staged(whole_pieces(docs, path, window, end_id), "best-fit-pieces")
    counts = staged(cut.groupBy("part", "length").count(), "best-fit-counts")
    per_length = counts.groupBy("length").agg(F.sum("count").alias("n")).collect()      # at most ``window`` rows
    shared = spark.sparkContext.broadcast(places(plan({r["length"]: r["n"] for r in per_length}, window)))
    before = counts.select("part", "length", (F.sum("count").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("before"))
    ranked = cut.join(before, ["part", "length"]).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("before") + F.col("k")).alias("rank"))

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa
        rows = shared.value
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for k in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                n = int(length[k[0]])
                t = rows[n]
                r = t[np.searchsorted(t[:, 0], rank[k], side="right") - 1]
                d = rank[k] - r[:, 0]
                seq[k] = r[:, 2] + d // r[:, 1]
                off[k] = r[:, 3] + (d % r[:, 1]) * n
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(5)), pa.array(seq), pa.array(off)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return ranked.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


@register("op12_best_fit_pack")
def op12_best_fit_pack(spark, sf_dir):
    return best_fit_pack(read_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
