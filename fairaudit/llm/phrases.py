"""Phrase collocations by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces
into words ``[^\\x20\\x09]+``; a phrase is up to four neighbouring words of a piece.

1. A task lays its texts end to end as bytes and forms prefix polynomials modulo
   2 ** 64 with numpy: over the bytes, which gives every word a hash, and over the
   word hashes, which gives every n-gram a fingerprint by one subtraction and one
   product. The language enters each fingerprint. Tasks count equal fingerprints
   first and a shuffle adds the counts up: first words and pairs, then only those
   triples and quadruples whose pairs are all frequent.
2. Frequent fingerprints become a bit table of bounded size (two bits each), which
   goes to the tasks. A bit too many costs work and no result.
3. Occurrences whose fingerprint may be frequent are cut out of the text at their
   pointer (document, word) and compared as text: counts are kept per phrase, not
   per fingerprint, with the pointer of the smallest document. Fingerprints that
   collide are thereby told apart, and only these phrases are ever materialised.
4. The table of phrases with at least ``MIN_COUNT`` occurrences holds every part of
   every candidate; scores are joins on it, in exact decimals.

Defined results: a null text is empty; a null language is ``und``. A null id is a
pointer that is null. Repeated rows count as often as they occur. An empty table
gives an empty result. Only ``doc_id``, ``text`` and ``lang`` are read, so other
columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package, staged
from .bits import bit_table, may_hold
from .registry import read_table, register

MIN_COUNT = 30
MAX_WORDS = 4
CONTAINED = 80               # of 100 occurrences inside one longer candidate: dropped
SCALE = 2_000_000
TOP = 2000
SALTS = 64                   # parts of a language that are ranked first

SLICE = 1 << 19              # bytes of text handled together
RUN = 500_000                # fingerprints counted together
HELD = 1_000_000             # distinct fingerprints a task holds before it hands them on
CUT = 150_000                # phrases cut out before equal ones are added up
DISTINCT = 1_000_000         # distinct phrases a task holds before it hands them on
SPLITS = 4                   # splits of the input that a task reads to materialise phrases

_U = np.uint64
_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"


def _odd(seed: int) -> int:
    return int.from_bytes(hashlib.sha256(f"phrase-{seed}".encode()).digest()[:8], "little") | 1


class Base:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""

    def __init__(self, seed: int) -> None:
        self.b = _odd(seed)
        self.up = self.down = np.ones(1, _U)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(self.b, -1, 1 << 64)
            self.up = np.concatenate([np.ones(1, _U), np.cumprod(np.full(size - 1, self.b, _U))])
            self.down = np.concatenate([np.ones(1, _U), np.cumprod(np.full(size - 1, inverse, _U))])
        return self.up[:n], self.down[:n]

    def ranges(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Polynomial of ``values[start:end]`` for each start and end."""
        up, down = self.powers(max(1, len(values)))
        prefix = np.zeros(len(values) + 1, _U)
        np.cumsum(values * up, out=prefix[1:])
        return (prefix[end] - prefix[start]) * down[start]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the input (a finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(_odd(901))
    x = (x ^ (x >> _U(27))) * _U(_odd(902))
    return x ^ (x >> _U(31))


_BYTES, _WORDS = Base(1), Base(2)
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=_U)      # of each byte
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)                                            # 0 word, 1 blank, 2 end of piece
_KIND[[0x20, 0x09]] = 1
_KIND[list(_PIECE_ENDS)] = 2


def lang_seed(lang: str) -> int:
    return int.from_bytes(hashlib.sha256(lang.encode("utf-8", "replace")).digest()[:8], "little")


class Words:
    """The words of some texts: where they are, their pieces and their hashes."""

    def __init__(self, texts: list[bytes], seeds: list[int]) -> None:
        raw = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
        kind = _KIND[raw]
        word = kind == 0
        edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
        self.raw = raw
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(kind == 2, dtype=np.int64)[self.start] if len(raw) else self.start
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        self.doc = np.searchsorted(begins, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, begins)          # number of a text's first word
        self.seed = np.array(seeds, _U)[self.doc] if len(self.start) else np.empty(0, _U)
        self.hash = mixed(_BYTES.ranges(_VALUE[raw], self.start, self.end) + (self.end - self.start).astype(_U))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and fingerprint of every n-gram that lies in one piece."""
        count = len(self.start) - n + 1
        if count <= 0:
            return np.empty(0, np.int64), np.empty(0, _U)
        at = np.flatnonzero(self.piece[:count] == self.piece[n - 1:])
        return at, mixed(_WORDS.ranges(self.hash, at, at + n) + self.seed[at] * _U(_odd(800 + n)))


def _slices(batches: Iterator) -> Iterator[tuple[list, list[bytes], list[str], list[bool]]]:
    """Ids, texts, languages, about ``SLICE`` bytes at a time. A longer text is
    handed on in parts that end where one of its pieces ends; the last list says
    which entries go on with the text before."""
    ids: list = []
    texts: list[bytes] = []
    langs: list[str] = []
    more: list[bool] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for i, text, lang in zip(*(part.column(k).to_pylist() for k in range(3))):
                text = text or b""
                begin = 0
                while True:
                    stop = len(text)
                    if stop - begin > SLICE:
                        stop = max(text.rfind(bytes([c]), begin, begin + SLICE) for c in _PIECE_ENDS) + 1
                        if stop <= begin:
                            found = [k for k in (text.find(bytes([c]), begin) for c in _PIECE_ENDS) if k >= 0]
                            stop = min(found) + 1 if found else len(text)
                    ids.append(i)
                    texts.append(text[begin:stop])
                    langs.append(lang)
                    more.append(begin > 0)
                    size += stop - begin + 1
                    if size >= SLICE:
                        yield ids, texts, langs, more
                        ids, texts, langs, more, size = [], [], [], [], 0
                    begin = stop
                    if begin >= len(text):
                        break
    if texts:
        yield ids, texts, langs, more


class Counter:
    """Counts of fingerprints, as sorted runs that are merged now and then."""

    def __init__(self) -> None:
        self.new: list[np.ndarray] = []
        self.size = 0
        self.keys, self.counts = np.empty(0, _U), np.empty(0, np.int64)

    def add(self, prints: np.ndarray) -> None:
        self.new.append(prints)
        self.size += len(prints)
        if self.size >= RUN:
            self.merge()

    def merge(self) -> None:
        if not self.new:
            return
        keys, counts = np.unique(np.concatenate(self.new), return_counts=True)
        self.new, self.size = [], 0
        if not len(keys):
            return
        both = np.concatenate([self.keys, keys])
        order = np.argsort(both, kind="stable")          # two sorted runs
        both, counts = both[order], np.concatenate([self.counts, counts])[order]
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        self.keys, self.counts = both[first], np.add.reduceat(counts, first)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = self.keys, self.counts
        self.keys, self.counts = np.empty(0, _U), np.empty(0, np.int64)
        return out


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("und")))


def counted(docs: DataFrame, orders: tuple[int, ...], table=None) -> DataFrame:
    """``fp, n``: fingerprints of the n-grams of these orders and their counts. With
    a broadcast bit table, only n-grams whose pairs it may hold."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        pairs = None if table is None else np.frombuffer(table.value, np.uint8)
        counts = Counter()

        def rows() -> Iterator:
            keys, n = counts.take()
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at:at + 100_000].view(np.int64)), pa.array(n[at:at + 100_000])], names=["fp", "n"])
        for _, texts, langs, _ in _slices(batches):
            words = Words(texts, [lang_seed(x) for x in langs])
            good = None
            if pairs is not None:
                at, prints = words.grams(2)
                good = np.zeros(len(words.start) + 1, np.int64)      # frequent pairs that begin before a word
                good[at[may_hold(pairs, prints)] + 1] = 1
                good = np.cumsum(good)
            for n in orders:
                at, prints = words.grams(n)
                if good is not None:
                    prints = prints[good[at + n - 1] - good[at] == n - 1]
                counts.add(prints)
            if len(counts.keys) > HELD:
                yield from rows()
        yield from rows()
    return _inputs(docs).mapInArrow(run, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))


def materialised(docs: DataFrame, table) -> DataFrame:
    """``lang, words, phrase, f, doc_id, word``: exact counts of the phrases whose
    fingerprints the bit table may hold, with one occurrence; ``words`` 0 counts
    all words of a language."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        bits = np.frombuffer(table.value, np.uint8)
        held: list = []

        def summed() -> pa.Table:
            t = pa.concat_tables(held).group_by(["lang", "words", "phrase"], use_threads=False).aggregate([("f", "sum"), ("at", "min")])
            t = t.rename_columns({"f_sum": "f", "at_min": "at"}).select(["lang", "words", "phrase", "f", "at"])
            held[:] = [t]
            return t
        pointers: list = []          # id of the document and number of the word, by "at"

        def rows() -> Iterator:
            if held:
                t = summed()
                at = t["at"].to_numpy()
                held.clear()
                ids = pa.array([pointers[k][0] if k >= 0 else None for k in (at >> 32).tolist()], pa.int64())
                word = pa.array((at & 0xFFFFFFFF), pa.int64())
                first = pa.array([pointers[k][1] if k >= 0 else 0 for k in (at >> 32).tolist()], pa.int64())
                import pyarrow.compute as pc
                t = pa.table([t["lang"], t["words"], t["phrase"], t["f"], ids, pc.subtract(word, first)],
                             names=["lang", "words", "phrase", "f", "doc_id", "word"])
                yield from t.to_batches(max_chunksize=50_000)
            pointers.clear()
        todo = before = 0            # words of a long text before this part
        for ids, texts, langs, more in _slices(batches):
            words = Words(texts, [lang_seed(x) for x in langs])
            codes = {x: i for i, x in enumerate(dict.fromkeys(langs))}
            names = pa.array(list(codes), pa.string())
            lang = np.array([codes[x] for x in langs], np.int32)[words.doc] if len(words.doc) else np.empty(0, np.int32)
            # words with one space behind each: a phrase is a stretch of it
            keep = np.zeros(len(words.raw) + 1, np.int8)
            keep[words.start] = 1
            keep[words.end] -= 1
            keep = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
            size = words.end - words.start + 1
            begin = np.cumsum(size) - size
            joined = np.full(int(size.sum()), 32, np.uint8)
            inside = np.ones(len(joined), bool)
            inside[begin + size - 1] = False
            joined[inside] = words.raw[keep]
            base = len(pointers)
            first = words.first.tolist()
            for i, begins, ends, goes_on in zip(ids, first, [*first[1:], len(words.start)], more):
                before = before if goes_on else 0
                pointers.append((i, begins - before))
                before += ends - begins
            for n in range(1, MAX_WORDS + 1):
                at, prints = words.grams(n)
                at = at[may_hold(bits, prints)]
                if len(at):
                    length = begin[at + n - 1] + size[at + n - 1] - 1 - begin[at]
                    stops = np.cumsum(length)
                    move = np.repeat(begin[at] - (stops - length), length) + np.arange(int(stops[-1]))
                    offsets = np.concatenate([[0], stops]).astype(np.int32)
                    phrase = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(joined[move])])
                    held.append(pa.table([names.take(pa.array(lang[at])), pa.array(np.full(len(at), n, np.int32)), phrase,
                                          pa.array(np.ones(len(at), np.int64)), pa.array(((words.doc[at] + base) << 32) | at)],
                                         names=["lang", "words", "phrase", "f", "at"]))
                    todo += len(at)
            total = np.bincount(lang, minlength=len(codes))
            held.append(pa.table([names, pa.array(np.zeros(len(codes), np.int32)), pa.array([b""] * len(codes), pa.binary()),
                                  pa.array(total.astype(np.int64)), pa.array(np.full(len(codes), -1 << 32, np.int64))],
                                 names=["lang", "words", "phrase", "f", "at"]))
            if todo >= CUT:
                if summed().num_rows > DISTINCT:
                    yield from rows()
                pa.default_memory_pool().release_unused()
                todo = 0
        yield from rows()
    # nearly every task sees every frequent phrase: fewer, larger tasks hand on fewer rows
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-docs.rdd.getNumPartitions() // SPLITS))
    found = _inputs(docs).coalesce(tasks).mapInArrow(run, "lang string, words int, phrase binary, f long, doc_id long, word long")
    return (found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"), F.min(F.struct("doc_id", "word")).alias("at"))
            .select("lang", "words", F.col("phrase").cast("string").alias("phrase"), "f", "at.doc_id", "at.word"))


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Every phrase of one to four words with at least ``min_count`` occurrences in
    its language: ``lang, words, phrase, f, doc_id, word``; ``words`` 0: all words."""
    spark = docs.sparkSession
    ship_package(spark)
    frequent = F.col("n") >= min_count
    low = staged(counted(docs, (1, 2)).filter(frequent).select("fp"), "phrase-pairs")
    pairs = spark.sparkContext.broadcast(bit_table(low).tobytes())
    high = staged(counted(docs, (3, 4), pairs).filter(frequent).select("fp"), "phrase-longer")
    every = spark.sparkContext.broadcast(bit_table(low.union(high)).tobytes())
    return staged(materialised(docs, every).filter((F.col("f") >= min_count) | (F.col("words") == 0)), "phrase-counts")


def _word_range(c, start: int, n: int):
    return F.array_join(F.slice(F.split(c, " "), start, n), " ")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """Best phrases of each language: ``lang, rank, phrase, a, l, r, n, score`` and
    one occurrence (``doc_id, word``)."""
    f = frequent_phrases(docs, min_count)
    phrases = f.filter(F.col("words") >= 1).select("lang", "words", "phrase", "f")
    totals = f.filter(F.col("words") == 0).select("lang", F.col("f").alias("n"))
    cand = f.filter(F.col("words") >= 2).select("lang", "words", "phrase", F.col("f").alias("a"), "doc_id", "word")

    # part of a longer candidate: the most frequent one that holds it decides
    spans = [(w, n, i) for w in range(3, MAX_WORDS + 1) for n in range(2, w) for i in range(1, w - n + 2)]
    inner = F.array_compact(F.array(*(F.when(F.col("words") == w, _word_range(F.col("phrase"), i, n)) for w, n, i in spans)))
    holders = (cand.filter(F.col("words") >= 3).select("lang", F.explode(inner).alias("phrase"), "a")
               .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = (cand.join(holders, ["lang", "phrase"], "left")
            .filter(F.col("longer").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("longer") < F.lit(CONTAINED).cast("decimal(20,0)") * F.col("a"))))

    cuts = F.array_compact(F.array(*(
        F.when(F.col("words") == w, F.struct(F.lit(k).alias("k"), _word_range(F.col("phrase"), 1, k).alias("left"),
                                             _word_range(F.col("phrase"), k + 1, w - k).alias("right")))
        for w in range(2, MAX_WORDS + 1) for k in range(1, w))))
    parts = kept.select("lang", "phrase", "a", "doc_id", "word", F.inline(cuts))
    left = phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = parts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn(
        "score", F.expr(f"CAST({SCALE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    best = (scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "doc_id", "word")).alias("b"))
            .select("lang", "phrase", "b.*"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    first = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return (ranked.join(totals, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "doc_id", "word"))


_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT unnest([1, 2, 3, 4]) AS m),
grams AS (
  SELECT lang, m, unnest([array_to_string(list_slice(w, i, i + m - 1), ' ') for i in range(1, len(w) - m + 2)]) AS phrase
  FROM words, sizes WHERE len(w) >= m),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE m = 1 GROUP BY lang),
freq AS (SELECT * FROM counts WHERE f >= 30),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE m >= 2),
spans AS (SELECT * FROM (VALUES (3, 2, 1), (3, 2, 2), (4, 2, 1), (4, 2, 2), (4, 2, 3), (4, 3, 1), (4, 3, 2)) t(m, size, i)),
holders AS (
  SELECT c.lang, array_to_string(list_slice(c.w, s.i, s.i + s.size - 1), ' ') AS phrase, max(c.a) AS longer
  FROM cand c JOIN spans s ON c.m = s.m GROUP BY ALL),
kept AS (
  SELECT c.* FROM cand c LEFT JOIN holders h ON c.lang = h.lang AND c.phrase = h.phrase
  WHERE h.longer IS NULL OR 100 * CAST(h.longer AS HUGEINT) < 80 * CAST(c.a AS HUGEINT)),
cutat AS (SELECT * FROM (VALUES (2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (4, 3)) t(m, k)),
cuts AS (
  SELECT kept.lang, kept.phrase, kept.a, k, x.f AS l, y.f AS r, CAST((2000000 * CAST(kept.a AS HUGEINT)) // (x.f + y.f) AS BIGINT) AS score
  FROM kept JOIN cutat ON kept.m = cutat.m
  JOIN freq x ON x.lang = kept.lang AND x.phrase = array_to_string(list_slice(w, 1, k), ' ')
  JOIN freq y ON y.lang = kept.lang AND y.phrase = array_to_string(list_slice(w, k + 1, kept.m), ' ')),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM cuts) WHERE o = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals ON ranked.lang = totals.lang WHERE rank <= 2000
"""


@register("op11_phrase_collocations", _SQL)
def op11_phrase_collocations(spark, sf_dir):
    return collocations(read_table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
