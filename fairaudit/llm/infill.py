"""Fill-in-the-middle documents by content-defined chunk memoization.

A text's units are ``[A-Za-z]+|[^A-Za-z]`` over code points. Two keyed draws of
the document's id say after how many units the prefix and the middle end. To
find these places without matching every text again:

1. A rolling hash of the last ``2 ** LEVELS`` bytes ends a chunk wherever its low
   bits are zero, so a passage that documents share is cut in the same way in
   each of them.
2. A chunk's summary (units, code points, does it begin or end with a letter) is
   kept in a cache that compares the content itself; it is worked out once for
   each content that the worker sees.
3. Summaries are added up: a letter run that goes on over a chunk boundary
   counts once. The running sums say which chunk holds a cut, and only that
   chunk is matched.

Chunk boundaries and the cache change no result, only the work.

Defined results: a null text is empty; an empty text, or one that holds a marker,
is left as it is (form ``plain``). A null id draws as the text ``1:`` alone. Rows
are treated one by one, so repeated rows give repeated results and an empty table
an empty one. Only ``doc_id`` and ``text`` are read; other columns may have any
name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .registry import read_table, register

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM = 90, 20           # of 100 documents, and of 100 of those
LEVELS = 5                   # the rolling hash sees 2 ** 5 bytes
CHUNK_BITS = 8               # about 256 bytes between boundaries
CHUNK_MAX = 4096             # bytes; longer stretches without a boundary are cut here
CACHE_MAX = 200_000          # summaries kept by a worker
BLOCK = 1 << 20              # bytes hashed together

SCHEMA = "doc_id long, n long, form string, output binary, prefix_chars long, middle_chars long"

_CACHE: dict[bytes, tuple[int, int, bool, bool]] = {}
_UNIT = re.compile(rb"[A-Za-z]+|[^A-Za-z][\x80-\xbf]*")
_KIND = bytes(97 if chr(b).isalpha() and b < 128 else 98 for b in range(256))   # letters a, others b
_INNER = bytes(range(0x80, 0xC0))                                               # bytes inside a code point


def _gear(seed: int = 13) -> np.ndarray:
    """A random 32-bit number for every byte, from a seeded generator."""
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


_GEAR = _gear()


def chunk_ends(data: bytes) -> list[int]:
    """Ends of a text's chunks. A boundary depends only on the bytes around it."""
    found = []
    width = 1 << LEVELS
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, len(data), BLOCK):
        low = max(0, at - width)
        part = raw[low:at + BLOCK]
        h = _GEAR[part]
        for k in range(LEVELS):     # h[i] sums gear << distance over 2, 4, 8 ... bytes
            step = 1 << k
            if len(h) > step:
                h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        hits = np.flatnonzero((h >> np.uint32(32 - CHUNK_BITS)) == 0) + low + 1
        found.append(hits[(hits > max(at, width)) & (hits < len(data))])
    ends = np.concatenate(found) if found else np.empty(0, np.int64)
    ends = ends[(raw[ends] & 0xC0) != 0x80].tolist()      # never inside a code point
    ends.append(len(data))
    out, last = [], 0
    for e in ends:
        while e - last > CHUNK_MAX:
            last += CHUNK_MAX
            while raw[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        out.append(e)
        last = e
    return out


def summary(chunk: bytes) -> tuple[int, int, bool, bool]:
    """Units, code points, begins with a letter, ends with a letter."""
    kinds = chunk.translate(_KIND, _INNER)
    starts, ends = kinds[:1] == b"a", kinds[-1:] == b"a"
    return kinds.count(b"b") + kinds.count(b"ba") + starts, len(kinds), starts, ends


def _summaries(data: bytes, ends: list[int]) -> list[tuple[int, int, bool, bool]]:
    out, last = [], 0
    for e in ends:
        chunk = data[last:e]
        s = _CACHE.get(chunk)
        if s is None:
            if len(_CACHE) >= CACHE_MAX:
                _CACHE.clear()
            s = _CACHE[chunk] = summary(chunk)
        out.append(s)
        last = e
    return out


class Units:
    """The units of a text, counted by chunks."""

    def __init__(self, data: bytes) -> None:
        self.data, self.ends = data, chunk_ends(data) if data else []
        parts = _summaries(data, self.ends)
        self.joined = [i > 0 and p[2] and parts[i - 1][3] for i, p in enumerate(parts)]
        units = np.array([p[0] for p in parts], np.int64) - np.array(self.joined, np.int64)
        self.upto = np.cumsum(units)
        self.chars = np.cumsum(np.array([p[1] for p in parts], np.int64))
        self.n = int(self.upto[-1]) if len(parts) else 0
        self.length = int(self.chars[-1]) if len(parts) else 0

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first ``k`` units."""
        if k >= self.n:
            return len(self.data), self.length
        i = int(np.searchsorted(self.upto, k, side="right"))     # unit k begins in chunk i
        begin, before = (self.ends[i - 1], int(self.upto[i - 1])) if i else (0, 0)
        chunk = self.data[begin:self.ends[i]]
        at = next(islice(_UNIT.finditer(chunk), k - before + self.joined[i], None)).start()
        return begin + at, (int(self.chars[i - 1]) if i else 0) + len(chunk[:at].translate(None, _INNER))


def draws(doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def fill(doc_id: int | None, data: bytes) -> tuple:
    """``n, form, output, prefix_chars, middle_chars`` of one document."""
    units = Units(data)
    n = units.n
    h1, h2, h3, h4 = draws(doc_id)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not data or h3 % 100 >= RATE or p in data or s in data or m in data:
        return n, "plain", data, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    (x, x_chars), (y, y_chars) = units.cut(a), units.cut(b)
    prefix, middle, suffix = data[:x], data[x:y], data[y:]
    if h4 % 100 < SPM:
        return n, "spm", b"".join((s, suffix, p, prefix, m, middle)), x_chars, y_chars - x_chars
    return n, "psm", b"".join((p, prefix, s, suffix, m, middle)), x_chars, y_chars - x_chars


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n, form, output`` (text), ``prefix_chars``
    and ``middle_chars`` (null if plain)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        names = ["doc_id", "n", "form", "output", "prefix_chars", "middle_chars"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):     # a few texts at a time
                part = batch.slice(at, 256)
                ids = part.column(0).to_pylist()
                rows = [(i, *fill(i, t or b"")) for i, t in zip(ids, part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, SCHEMA)
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that a document had, from its output and form."""
    def before(c: Column, mark: str) -> Column:
        return F.substring_index(c, mark, 1)

    def after(c: Column, mark: str) -> Column:
        return F.substring_index(c, mark, -1)
    middle = after(output, MIDDLE)
    rest = before(output, MIDDLE)
    psm = F.concat(after(before(rest, SUFFIX), PREFIX), middle, after(rest, SUFFIX))
    spm = F.concat(after(rest, PREFIX), middle, after(before(rest, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
e AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (
  SELECT *, coalesce(array_to_string(list_slice(u, 1, a), ''), '') AS p,
         coalesce(array_to_string(list_slice(u, a + 1, b), ''), '') AS m,
         coalesce(array_to_string(list_slice(u, b + 1, n), ''), '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM g
"""


@register("op13_fill_in_middle", _SQL)
def op13_fill_in_middle(spark, sf_dir):
    out = fill_in_middle(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))
