"""Near-duplicate documents by Order MinHash and banded alignment.

A document is its sequence of k-mers of ``K`` words, lower-cased, each labelled
with its occurrence number so that repeats count. For every one of ``SKETCHES``
hash functions the ``PICK`` smallest k-mers are taken *in text order*; two
sketches agree only if the same k-mers come in the same order, which follows
edit similarity rather than set overlap. ``PER_BAND`` sketches make a band key.

Texts with equal words form a class; only one text of a class is compared.
Classes that share a band key are candidates, verified by a banded alignment:
matching k-mers within the diagonal band that the threshold allows, longest
increasing chain of them. The similarity is chain / (n + m - chain), at most the
Jaccard similarity of the labelled k-mers.

Candidates of a bucket are not paired at once: the bucket's first documents are
compared with all members (``STARS`` rounds), and only members that are still in
different components after that are compared with each other. Buckets of up to
``SMALL`` members do so as pairs whose lengths allow the threshold. In larger
ones, members outside the bucket's main component are looked up, block by block,
in an inverted index of its members; the number of common k-mers bounds the
similarity, so only pairs that can reach the threshold are aligned, and none is
written out but links. A pair left out is in one component already, so components
are those of all candidate pairs.

Defined results: a null text, or one without a word, links with nothing and is
kept. Texts under ``K`` words are one k-mer. A group is named after its smallest
doc_id and keeps one row of it (repeated rows: one of them); null ids come last
and name a group only as null. An empty table gives an empty result. Only
``doc_id`` and ``text`` are read; ``near_duplicates`` takes any other columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, ship_package, small_batches
from .bits import bit_table, may_hold
from .columns import spans
from .graph import components
from .registry import read_table, register
from .worker import keep_for

K = 5
SKETCHES = 32
PICK = 2
PER_BAND = 2
THRESHOLD = 0.8
STARS = 2
SMALL = 16                   # members of a bucket that are paired by a join
BLOCK = 256                  # members of a large bucket indexed together
QUERIES = 512                # members looked up together
BLOCK_KMERS = 1_000_000      # k-mers of a block and of a part of the members looked up, about
MATCHES = 1_000_000          # postings of a document that are counted at once, about
SLICE_WORDS = 150_000        # words sketched together
PLACE = (1 << 24) - 1        # places of k-mers are told apart modulo this plus one
CACHE_MAX = 200_000          # word hashes kept by a worker
_WORDS: dict[str, int] = {}
U = np.uint64
_RNG = np.random.default_rng(20240501)
_MUL = _RNG.integers(1, 2 ** 63, SKETCHES, dtype=np.uint64) * U(2) + U(1)
_ADD = _RNG.integers(0, 2 ** 63, SKETCHES, dtype=np.uint64)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


def _word_hashes(words: list[str]) -> np.ndarray:
    import xxhash
    keep_for("words", _WORDS.clear)
    if len(_WORDS) > CACHE_MAX:
        _WORDS.clear()
    for w in set(words).difference(_WORDS):
        _WORDS[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def kmers(docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mer hashes of several non-empty documents in text
    order, and where each document starts (one entry more than documents)."""
    with np.errstate(over="ignore"):
        # a text under K words is filled up, so that it is one k-mer
        flat = [w for d in docs for w in (d if len(d) >= K else d + [""] * (K - len(d)))]
        w = _word_hashes(flat)
        words = np.array([max(len(d), K) for d in docs])
        ends = np.cumsum(words)
        n = words - K + 1
        starts = np.concatenate(([0], np.cumsum(n)))
        inside = np.ones(len(w), bool)
        for i in range(1, K):
            inside[ends - i] = False
        h = np.zeros(len(w) - K + 1, np.uint64)
        for i in range(K):
            h = h * U(0x9E3779B97F4A7C15) + w[i:i + len(h)]
        h = _mix(h[inside[:len(h)]])
        own = h + _mix(np.repeat(np.arange(1, len(docs) + 1, dtype=np.uint64), n))
        order = np.argsort(own, kind="stable")
        own = own[order]
        same = own[1:] == own[:-1]
        if same.any():
            run = np.arange(len(h))
            run[1:][same] = 0
            occ = np.empty(len(h), np.uint64)
            occ[order] = np.arange(len(h)) - np.maximum.accumulate(run)
            h = np.where(occ > 0, _mix(h + occ * U(0xD1B54A32D192ED03)), h)
        return h, starts


def bands(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Band keys, one row per document of ``kmers``.

    The low bits of a hash value carry the k-mer's place, so that the minimum
    also says where it is.
    """
    first = starts[:-1]
    n = np.diff(starts)
    with np.errstate(over="ignore"):
        place = (np.arange(len(h)) - np.repeat(first, n)).astype(np.uint64) & U(PLACE)
        codes = np.empty((len(first), SKETCHES), np.uint64)
        x = np.empty_like(h)
        for s in range(SKETCHES):
            np.multiply(h, _MUL[s], out=x)
            x += _ADD[s]
            x &= U(~PLACE & 0xFFFFFFFFFFFFFFFF)
            x |= place
            picked = np.empty((len(first), PICK), np.int64)
            for j in range(PICK):
                p = (np.minimum.reduceat(x, first) & U(PLACE)).astype(np.int64)
                picked[:, j] = np.where(n > j, p, -1)
                x[first + np.where(n > j, p, 0)] = np.iinfo(np.uint64).max
            picked.sort(axis=1)          # text order
            code = np.zeros(len(first), np.uint64)
            for j in range(PICK):
                p = picked[:, j]
                code = code * U(0x9E3779B97F4A7C15) + np.where(p >= 0, h[first + np.maximum(p, 0)], U(7))
            codes[:, s] = _mix(code)
        out = np.empty((len(first), SKETCHES // PER_BAND), np.uint64)
        for b in range(out.shape[1]):
            key = np.full(len(first), b, np.uint64)
            for j in range(PER_BAND):
                key = _mix(key * U(0x9E3779B97F4A7C15) + codes[:, b * PER_BAND + j])
            out[:, b] = key
        return out.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Banded alignment of two k-mer sequences (labels make k-mers unique)."""
    import bisect
    n, m = len(a), len(b)
    if min(n, m) < threshold * max(n, m):
        return 0.0
    _, i, j = np.intersect1d(a, b, return_indices=True)
    # pairs at the threshold leave at most this many k-mers unmatched on both sides
    band = (n + m) * (1 - threshold) / (1 + threshold) + 1e-9
    inside = np.abs(i - j) <= band
    i, j = i[inside], j[inside]
    if len(i) < threshold / (1 + threshold) * (n + m) - 1e-9:
        return 0.0
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        chain = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            k = bisect.bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        chain = len(tails)
    return chain / (n + m - chain)


def sketch(docs: DataFrame, place: Column | None = None) -> DataFrame:
    """``uid, doc_id, cls, n, bands, kmers, file, row`` of every row (null where no word).

    ``uid`` is a running number; ``file, row`` are those of the struct ``place``, if given.
    """
    ship_package(docs.sparkSession)

    def work(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa
        from pyspark import TaskContext
        uid = TaskContext.get().partitionId() << 36
        for b in batches:
            ids, texts, at = b.column(0), b.column(1), 0
            while at < len(ids):
                lists, size, end = [], 0, at
                while end < len(ids) and size < SLICE_WORDS:
                    text = texts[end].as_py()
                    lists.append(text.lower().split() if text else [])
                    size += len(lists[-1])
                    end += 1
                full = [x for x in lists if x]
                if full:
                    h, starts = kmers(full)
                    keys = bands(h, starts)
                    small = (h >> U(32)).astype("<u4")
                cols: tuple = ([], [], [], [], [])
                k = 0
                for words in lists:
                    uid += 1
                    if words:
                        cls = hashlib.blake2b("\0".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                        row = (uid, cls, int(starts[k + 1] - starts[k]), keys[k].tolist(), small[starts[k]:starts[k + 1]].tobytes())
                        k += 1
                    else:
                        row = (uid, None, 0, [], None)
                    for c, v in zip(cols, row):
                        c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), ids.slice(at, end - at), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int32()),
                     pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.binary()),
                     b.column(2).slice(at, end - at), b.column(3).slice(at, end - at)],
                    names=["uid", "doc_id", "cls", "n", "bands", "kmers", "file", "row"])
                at = end
    none = F.struct(F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("row"))
    where = none if place is None else place
    cols = [F.col("doc_id").cast("long"), F.col("text").cast("string"), where["file"].alias("file"), where["row"].alias("row")]
    return docs.select(*cols).mapInArrow(
        work, "uid long, doc_id long, cls binary, n int, bands array<long>, kmers binary, file string, row long")


def _shares(rows: str, grams: str, most: int) -> Column:
    """Into how many shares to cut so many rows, so that one has about ``most`` rows
    and ``BLOCK_KMERS`` k-mers at most."""
    return F.greatest(F.ceil(F.col(rows) / most), F.ceil(F.col(grams) / BLOCK_KMERS)).cast("int")


def common_kmers(g: np.ndarray, post: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """How many k-mers of ``g`` each of ``docs`` documents has; ``post`` are their
    sorted k-mers and ``owner`` the document of each."""
    lo = np.searchsorted(post, g, "left")
    n = np.searchsorted(post, g, "right") - lo
    out = np.zeros(docs, np.int64)
    for i, j in spans(n, MATCHES):
        k = n[i:j]
        at = np.repeat(lo[i:j] - np.concatenate(([0], np.cumsum(k)[:-1])), k)
        at += np.arange(len(at))
        out += np.bincount(owner[at], minlength=docs)
    return out


def _in_blocks(members: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b`` between components of large buckets.

    ``members`` holds ``band, uid, comp, main, size, grams, outside, outside_grams``. One
    group gets one block of a bucket and some of the members outside its main component;
    both are bounded by rows and by k-mers, so that long texts do not fill a worker.
    """
    m = members.join(known, "uid")
    nb = _shares("size", "grams", BLOCK)
    nq = _shares("outside", "outside_grams", QUERIES)
    h = F.xxhash64("uid")
    index = (m.withColumn("block", F.pmod(h, nb).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), nq - 1)))
              .select("band", "block", "part", "uid", "comp", "kmers"))
    query = (m.filter("comp <> main").withColumn("part", F.pmod(h, nq).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), nb - 1)))
              .select("band", "block", "part", "uid", "comp", "kmers"))

    def look_up(left, right):
        import pandas as pd
        a, b = [], []
        if len(left) and len(right):
            grams = [np.frombuffer(x, "<u4") for x in left["kmers"]]
            size = np.array([len(g) for g in grams])
            post = np.concatenate(grams)
            order = np.argsort(post, kind="stable")
            owner = np.repeat(np.arange(len(grams), dtype=np.int32), size)[order]
            post = post[order]
            del order
            uid, comp = left["uid"].to_numpy(), left["comp"].to_numpy()
            up: dict[int, int] = {}

            def root(c: int) -> int:
                while c in up:
                    c = up[c]
                return c
            for me, mine, raw in zip(right["q_uid"], right["q_comp"], right["q_kmers"]):
                g = np.frombuffer(raw, "<u4")
                common = np.minimum(common_kmers(g, post, owner, len(grams)), np.minimum(size, len(g)))
                for k in np.flatnonzero((common >= threshold * (size + len(g) - common) - 1e-9) & (comp != mine)).tolist():
                    x, y = root(int(mine)), root(int(comp[k]))
                    if x != y and similarity(g, grams[k], threshold) >= threshold:
                        up[max(x, y)] = min(x, y)
                        a.append(min(me, uid[k]))
                        b.append(max(me, uid[k]))
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})
    key = ["band", "block", "part"]
    query = query.select(*[F.col(c).alias(f"q_{c}") for c in query.columns])      # same table: tell the columns apart
    return index.groupBy(*key).cogroup(query.groupBy(*[f"q_{c}" for c in key])).applyInPandas(look_up, "a long, b long")


def _perhaps(sketches: DataFrame, uids: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of these uids and perhaps some more, without a shuffle of the k-mers:
    tasks look the uid up in a bit table of bounded size."""
    table = uids.sparkSession.sparkContext.broadcast(bit_table(scratch.staged(uids.select(F.xxhash64("uid").alias("fp")), "omh-uids")).tobytes())

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa
        bits = np.frombuffer(table.value, np.uint8)
        for b in batches:
            yield b.filter(pa.array(may_hold(bits, b.column("fp").to_numpy().view(U)))).select(["uid", "kmers"])
    return sketches.select("uid", "kmers", F.xxhash64("uid").alias("fp")).mapInArrow(keep, "uid long, kmers binary")


def _verified(pairs: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` whose alignment reaches the threshold."""
    k = known.select("uid", "kmers")
    full = (pairs.join(k.withColumnsRenamed({"uid": "a", "kmers": "ka"}), "a")
                 .join(k.withColumnsRenamed({"uid": "b", "kmers": "kb"}), "b").select("a", "b", "ka", "kb"))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            keep = [similarity(np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4"), threshold) >= threshold
                    for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return full.mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, class_id, component_id, kept``.

    ``class_id`` is the smallest doc_id with the same words, ``component_id``
    the smallest one reachable by verified links.
    """
    with Scratch(docs.sparkSession) as scratch, small_batches(docs.sparkSession):
        marks = scratch.staged(_marks(sketch(docs), scratch, threshold).drop("uid", "file", "row"), "omh-marks")
        scratch.keep("omh-marks")
    return marks


def _marks(sketches: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """``uid, file, row`` and the columns of ``near_duplicates``.

    Tables are dropped as soon as what is made of them is written, so the k-mers
    of all rows and of the rows with a partner are never held beside a copy.
    """
    staged = scratch.staged
    last = F.lit(2 ** 63 - 1)
    sk = staged(sketches, "omh-sketches")
    # the row that stands for a class: smallest id, then position
    first = F.min(F.struct(F.coalesce("doc_id", last).alias("id"), "uid"))
    reps = staged(sk.filter("cls IS NOT NULL").groupBy("cls").agg(first.alias("r"))
                  .select("cls", F.col("r.id").alias("id"), F.col("r.uid").alias("uid")), "omh-classes")
    rows = sk.select("uid", "n", "bands").join(reps.select("uid", "id"), "uid")
    rows = rows.select("uid", "id", "n", F.explode("bands").alias("band"))
    rows = staged(rows, "omh-bands")
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("band")
    rows = staged(rows.join(shared, "band"), "omh-buckets")
    scratch.drop("omh-bands")
    known = staged(_perhaps(sk.select("uid", "kmers"), rows.select("uid").distinct(), scratch), "omh-known")
    sk = staged(sk.select("uid", "doc_id", "cls", "file", "row"), "omh-rows")
    scratch.drop("omh-sketches")
    edges = None
    labels = None
    state = rows.withColumn("comp", F.col("uid"))
    for r in range(STARS + 1):
        ratio = F.expr(f"least(n, n2) >= {threshold} * greatest(n, n2)")
        if r < STARS:
            # of the component with the smallest first document, and then the next one
            lead = state.groupBy("band").agg(F.min(F.struct("id", "uid", "n", "comp")).alias("l"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
            lead = lead.filter("c1 <> c2")
            if r:
                own = lead.select("band", F.col("l.comp").alias("own"))
                other = state.join(own, "band").filter("comp <> own")
                lead = other.groupBy("band").agg(F.min(F.struct("id", "uid", "n", "comp")).alias("l"))
            lead = lead.select("band", F.col("l.uid").alias("a"), F.col("l.n").alias("n2"), F.col("l.comp").alias("own"))
            pairs = state.join(lead, "band").filter(F.col("comp") != F.col("own")).filter(ratio).select("a", F.col("uid").alias("b"))
        else:
            per = state.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("g"))
            mixed = per.groupBy("band").agg(F.sum("k").alias("size"), F.sum("g").alias("grams"), F.count(F.lit(1)).alias("comps"),
                                            F.max(F.struct("k", "comp", "g")).alias("m"))
            mixed = mixed.filter("comps > 1").select("band", "size", "grams", (F.col("size") - F.col("m.k")).alias("outside"),
                                                     (F.col("grams") - F.col("m.g")).alias("outside_grams"), F.col("m.comp").alias("main"))
            mixed = staged(mixed, "omh-mixed-buckets")
            left = staged(state.join(mixed, "band"), "omh-mixed")
            large = _in_blocks(left.filter(F.col("size") > SMALL), known, threshold)
            small = left.filter(F.col("size") <= SMALL)
            right = small.select("band", F.col("uid").alias("a"), F.col("n").alias("n2"), F.col("comp").alias("own"))
            pairs = small.join(right, "band").filter(F.col("uid") > F.col("a")).filter(F.col("comp") != F.col("own")).filter(ratio) \
                         .select("a", F.col("uid").alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = _verified(staged(pairs, "omh-pairs"), known, threshold)
        found = staged(found if r < STARS else found.union(large).distinct(), "omh-edges")
        edges = found if edges is None else edges.union(found)
        if not found.isEmpty():
            labels = components(edges, scratch)
            scratch.drop("cc-labels", but_last=1)
            state = (rows.join(labels.withColumnRenamed("id", "_i"), rows["uid"] == F.col("_i"), "left")
                         .withColumn("comp", F.coalesce("comp", "uid")).drop("_i"))
    if labels is None:
        named = reps.withColumn("gid", F.col("id")).withColumn("gu", F.col("uid"))
    else:
        named = reps.join(labels.withColumnRenamed("id", "_i"), reps["uid"] == F.col("_i"), "left") \
                    .withColumn("comp", F.coalesce("comp", "uid")).drop("_i")
        name = named.groupBy("comp").agg(F.min(F.struct("id", "uid")).alias("g"))
        named = named.join(name, "comp").withColumn("gid", F.col("g.id")).withColumn("gu", F.col("g.uid"))
    named = named.select("cls", F.col("id").alias("cid"), "gid", "gu")
    none = F.nullif
    scratch.drop("omh-known", "omh-buckets")
    out = sk.join(named, "cls", "left")
    return out.select(
        "uid", "file", "row", "doc_id", F.coalesce(none("cid", last), "doc_id").alias("class_id"),
        F.coalesce(none("gid", last), "doc_id").alias("component_id"),
        F.coalesce(F.col("gu") == F.col("uid"), F.lit(True)).alias("kept"))


def _place(docs: DataFrame) -> Column | None:
    """File and row number of each row, if ``docs`` are rows of files as they are
    stored (columns and rows may have been left out): then they can be read again."""
    nodes = re.findall(r"^[\s:+\-]*(\w+)", docs._jdf.queryExecution().analyzed().toString(), re.M)
    if set(nodes) - {"Project", "Filter", "SubqueryAlias", "Relation"} or nodes.count("Relation") != 1:
        return None
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta["row_index"]).schema      # not every format numbers its rows
    except AnalysisException:
        return None
    return F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The kept row of every group, with its own columns, whatever their names.

    Rows are told apart by file and row number, so rows that share an id or have
    none are kept or left out one by one. Rows that are not stored as they are
    get a stored copy first. The rows to leave out are the smaller table.
    """
    with Scratch(docs.sparkSession) as scratch, small_batches(docs.sparkSession):
        place = _place(docs)
        if place is None:
            docs = scratch.staged(docs, "omh-copy")
            scratch.keep("omh-copy")
            place = _place(docs)
        out = scratch.staged(_marks(sketch(docs, place), scratch).filter(~F.col("kept")).select("file", "row"), "omh-left-out")
        scratch.keep("omh-left-out")
    rows = docs.select(place.alias("at"), F.struct("*").alias("doc"))
    return rows.join(out.select(F.struct("file", "row").alias("gone")), F.col("at") == F.col("gone"), "left_anti").select("doc.*")


@register("op5_minhash_near_dedup")
def op5_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents"))
