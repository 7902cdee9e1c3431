"""Language identification by interpolated Kneser-Ney character models.

For each language, n-grams of orders 1 to ``ORDER`` over lower-cased characters
(white space is one blank) give an interpolated Kneser-Ney model: the highest
order uses counts, lower orders continuation counts. All languages share, per
order, one sorted array of n-gram hashes; beside each hash stand the languages'
log probabilities and the weights for backing off from that n-gram.

A whole text is scored by its cross-entropy per character under each language;
the lowest wins. Texts whose cross-entropy is above what the calibration texts
of that language reach are marked ``rejected``; the score is a softmax of the
cross-entropies whose temperature the calibration texts set.

The model is fitted on a sample of labelled rows and learns every labelled
language: about ``DOCS_PER_LANG`` whole documents drawn by hash for each of up to
``FULL_LANGS`` languages, fewer for each as languages grow beyond that, and at
least one. The tables hold n-grams times languages, so the documents of a language
go down with the square; their size keeps its bound as long as that leaves more
than one document, and they are broadcast. A language always has a text to learn
from; one with a single sampled text has none to calibrate with and rejects
nothing. N-gram counting and scoring run in the tasks; texts are read whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0.
Null ids count as not held out. Without any labelled row all texts are ``und``.
Repeated rows get equal results; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, staged
from .registry import read_table, register

ORDER = 4
DISCOUNT = 0.75
DOCS_PER_LANG = 600
FULL_LANGS = 64
SLICE_CHARS = 400_000
REJECT_QUANTILE = 0.995
U = np.uint64
BLANK = 32


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of the texts, each after ``ORDER - 1`` blanks, white
    space runs as one blank; and where each text starts."""
    pad = " " * (ORDER - 1)
    parts = [pad + " ".join(t.lower().split()) for t in texts]
    data = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return data, np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each position (from position n - 1 on)."""
    with np.errstate(over="ignore"):
        m = len(data) - n + 1
        h = np.zeros(max(m, 0), np.uint64)
        for i in range(n):
            h = (h + data[i:i + m].astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15)
            h ^= h >> U(29)
        return h


def grams_at(data: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at the given positions."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(ends), np.uint64)
        for i in range(n):
            h = (h + data[ends - (n - 1 - i)].astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15)
            h ^= h >> U(29)
        return h


def count_grams(texts: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per order: n-gram hashes, hashes of their contexts, of their suffixes, counts."""
    data, starts = codes_of(texts)
    first = np.zeros(len(data), bool)
    for k in range(ORDER - 1):
        first[starts[:-1] + k] = True
    ends = np.flatnonzero(~first)            # predicted characters
    out = {}
    for n in range(1, ORDER + 1):
        g = gram_hashes(data, n)[ends - n + 1]
        c = gram_hashes(data, n - 1)[ends - n + 1] if n > 1 else np.zeros(len(ends), np.uint64)
        s = gram_hashes(data, n - 1)[ends - n + 2] if n > 1 else np.zeros(len(ends), np.uint64)
        u, i, k = np.unique(g, return_index=True, return_counts=True)
        out[n] = (u, c[i], s[i], k)
    return out


class Model:
    """Joint tables of all languages."""

    def __init__(self, langs: list[str], counts: dict[str, dict[int, tuple]]) -> None:
        self.langs = langs
        self.hashes, self.logp, self.back, self.starts = {}, {}, {}, {}
        size = len(langs)
        alphabet = 1 + max((len(counts[x][1][0]) for x in langs), default=1)
        self.floor = np.zeros(size, np.float32)
        grams, probs = {}, {}
        for k, lang in enumerate(langs):
            below: dict | None = None
            for n in range(1, ORDER + 1):
                g, c, s, cnt = counts[lang][n]
                if n < ORDER:                # continuation counts: distinct characters before
                    u, t = np.unique(counts[lang][n + 1][2], return_counts=True)
                    at = np.minimum(np.searchsorted(u, g), len(u) - 1)
                    value = np.where(u[at] == g, t[at], 1).astype(float)
                else:
                    value = cnt.astype(float)
                if n == 1:
                    total = value.sum()
                    spare = DISCOUNT * len(g) / total / (alphabet * 4)
                    p = np.maximum(value - DISCOUNT, 0) / total + spare
                    self.floor[k] = np.log(spare)
                else:
                    ctx, inv = np.unique(c, return_inverse=True)
                    total = np.bincount(inv, weights=value)
                    kinds = np.bincount(inv)
                    weight = DISCOUNT * kinds / total
                    lg, lp = below
                    at = np.searchsorted(lg, s)
                    at = np.minimum(at, len(lg) - 1)
                    lower = np.where(lg[at] == s, lp[at], np.exp(self.floor[k]))
                    p = np.maximum(value - DISCOUNT, 0) / total[inv] + weight[inv] * lower
                    grams.setdefault(("back", n - 1), []).append((k, ctx, np.log(weight)))
                grams.setdefault(n, []).append((k, g, np.log(p)))
                below = (g, p)
        for n in range(1, ORDER + 1):
            rows = grams.get(n, []) + grams.get(("back", n), [])
            h = np.unique(np.concatenate([r[1] for r in rows])) if rows else np.zeros(0, np.uint64)
            lp = np.full((len(h), size), np.nan, np.float32)
            bk = np.zeros((len(h), size), np.float32)
            for k, g, v in grams.get(n, []):
                lp[np.searchsorted(h, g), k] = v
            for k, g, v in grams.get(("back", n), []):
                bk[np.searchsorted(h, g), k] = v
            self.hashes[n], self.logp[n], self.back[n] = h, lp, bk
        # an n-gram that a language has not seen: back off once and for all
        for n in range(1, ORDER + 1):
            lp = self.logp[n]
            hole = np.isnan(lp)
            if n == 1:
                self.logp[1] = np.where(hole, self.floor[None, :], lp)

    def fill(self, links: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Completes the tables from (n-gram, context, suffix) of every stored n-gram."""
        for n in range(2, ORDER + 1):
            g, c, s = links[n]
            h, lp = self.hashes[n], self.logp[n]
            order = np.argsort(g)
            g, c, s = g[order], c[order], s[order]
            at = np.minimum(np.searchsorted(g, h), len(g) - 1) if len(g) else np.zeros(len(h), int)
            known = (g[at] == h) if len(g) else np.zeros(len(h), bool)
            ctx = self._row(n - 1, np.where(known, c[at] if len(g) else 0, U(0)))
            suf = self._row(n - 1, np.where(known, s[at] if len(g) else 0, U(0)))
            back = np.where(ctx[:, None] >= 0, self.back[n - 1][np.maximum(ctx, 0)], 0)
            low = np.where(suf[:, None] >= 0, self.logp[n - 1][np.maximum(suf, 0)], self.floor[None, :])
            self.logp[n] = np.where(np.isnan(lp), back + low, lp).astype(np.float32)

    def _row(self, n: int, h: np.ndarray) -> np.ndarray:
        """Rows of n-gram hashes in the sorted table of an order, -1 where absent.

        The leading bits of a hash say where in the table to begin.
        """
        if n not in self.starts:
            t = self.hashes[n]
            bits = max(1, len(t)).bit_length() + 2
            low = np.arange(1 << bits, dtype=np.uint64) << U(64 - bits)
            self.starts[n] = (U(64 - bits), np.searchsorted(t, low).astype(np.int32), np.append(t, U(0xFFFFFFFFFFFFFFFF)))
        shift, start, t = self.starts[n]
        at = start[(h >> shift).astype(np.int32)]
        found = t[at]
        todo = np.flatnonzero(found < h)
        while len(todo):
            at[todo] += 1
            found[todo] = t[at[todo]]
            todo = todo[found[todo] < h[todo]]
        return np.where((found == h) & (at < len(t) - 1), at, -1)

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log probability per character, by text and language, and lengths."""
        data, starts = codes_of(texts)
        first = np.zeros(len(data), bool)
        for k in range(ORDER - 1):
            first[starts[:-1] + k] = True
        ends = np.flatnonzero(~first)
        length = np.diff(starts) - (ORDER - 1)
        if not len(ends):
            return np.zeros((len(texts), len(self.langs))), length
        row = self._row(ORDER, gram_hashes(data, ORDER)[ends - ORDER + 1])
        lp = np.where((row >= 0)[:, None], self.logp[ORDER][np.maximum(row, 0)], np.float32(0)).astype(np.float64)
        todo = np.flatnonzero(row < 0)
        e = ends[todo]
        for n in range(ORDER, 0, -1):
            if n < ORDER:
                row = self._row(n, grams_at(data, e, n))
                hit = row >= 0
                lp[todo[hit]] += self.logp[n][row[hit]]
                todo, e = todo[~hit], e[~hit]
            if not len(todo):
                break
            if n == 1:
                lp[todo] += self.floor[None, :]
            else:
                ctx = self._row(n - 1, grams_at(data, e - 1, n - 1))
                seen = ctx >= 0
                lp[todo[seen]] += self.back[n - 1][ctx[seen]]
        some = np.flatnonzero(length > 0)
        total = np.zeros((len(texts), len(self.langs)))
        offsets = np.concatenate(([0], np.cumsum(length)))[:-1][some]
        total[some] = np.add.reduceat(lp, offsets, axis=0)
        return -total / np.maximum(length, 1)[:, None], length


def fit(labelled: DataFrame) -> tuple[Model, float, np.ndarray] | None:
    """Model, temperature and rejection limits from ``text, lang`` of labelled rows."""
    spark = labelled.sparkSession
    ship_package(spark)
    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL")
    parts = 1 << 20
    h = F.pmod(F.xxhash64("text"), F.lit(parts))
    speaks = F.col("text").rlike(r"\p{L}")
    per = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.min(F.when(speaks, h)).alias("low")).orderBy("lang").collect()    # a row per language
    if not per:
        return None
    wanted = DOCS_PER_LANG * min(1.0, FULL_LANGS / len(per)) ** 2
    # the share that gives the wanted number of documents, and at least one text
    shares = [(r["lang"], max(1, int(parts * min(1.0, wanted / r["count"])), 0 if r["low"] is None else r["low"] + 1)) for r in per]
    shares = spark.createDataFrame(shares, "lang string, share long")
    drawn = rows.withColumn("lang", F.col("lang").cast("string")).join(F.broadcast(shares), "lang").filter(h < F.col("share"))
    sample = staged(drawn.select("lang", "text", (F.pmod(F.xxhash64("text", F.lit(1)), F.lit(5)) == 0).alias("tune")), "lang-sample")
    # where all texts would be for calibration, they are learnt from
    only = sample.groupBy("lang").agg(F.max(~F.col("tune") & speaks).alias("learns")).filter("NOT learns").select("lang", F.lit(True).alias("only"))
    sample = sample.join(F.broadcast(only), "lang", "left").withColumn("tune", F.col("tune") & F.col("only").isNull()).drop("only")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        held: dict[str, list[str]] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(lang, []).append(text)
        for lang, texts in held.items():
            for n, (g, c, s, k) in count_grams(texts).items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(g)), pa.array([n] * len(g), pa.int32()), pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), pa.array(s.view(np.int64)), pa.array(k.astype(np.int64))],
                    names=["lang", "n", "g", "c", "s", "k"])
    grams = (sample.filter("NOT tune").select("lang", "text").mapInArrow(count, "lang string, n int, g long, c long, s long, k long")
             .groupBy("lang", "n", "g").agg(F.min("c").alias("c"), F.min("s").alias("s"), F.sum("k").alias("k")))
    # bounded by the sample: distinct n-grams of languages x documents
    got = grams.toPandas()
    langs = sorted(got["lang"].unique().tolist())
    if not langs:
        return None
    counts: dict = {}
    links = {}
    for n in range(1, ORDER + 1):
        part = got[got["n"] == n]
        links[n] = tuple(np.ascontiguousarray(part[x].to_numpy()).view(np.uint64) for x in ("g", "c", "s"))
        for lang in langs:
            p = part[part["lang"] == lang].sort_values("g", key=lambda v: v.to_numpy().view(np.uint64))
            counts.setdefault(lang, {})[n] = tuple(p[x].to_numpy().view(np.uint64) for x in ("g", "c", "s")) + (p["k"].to_numpy(),)
    model = Model(langs, counts)
    model.fill(links)
    tune = _calibration(sample.filter("tune").filter(F.col("lang").isin(*langs)), model)
    if not tune:
        return model, 1.0, np.full(len(langs), np.inf)
    x = np.array([v for _, v in tune])
    y = np.array([langs.index(k) for k, _ in tune])
    best = min((0.5, 1, 2, 5, 10, 20, 50), key=lambda t: -np.log(np.maximum(softmax(-x * t)[np.arange(len(y)), y], 1e-12)).sum())
    limits = np.array([np.quantile(x[y == k, k], REJECT_QUANTILE) * 1.1 if (y == k).any() else np.inf for k in range(len(langs))])
    return model, float(best), limits


def _calibration(sample: DataFrame, model: Model) -> list[tuple[str, list[float]]]:
    """Language and cross-entropies of the calibration texts (part of the bounded sample)."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, length = shared.value.cross_entropy([text])
                if length[0] > 0:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([x[0].tolist()], pa.list_(pa.float64()))], names=["lang", "x"])
    return [(r["lang"], r["x"]) for r in sample.select("lang", "text").mapInArrow(work, "lang string, x array<double>").collect()]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, fitted: tuple[Model, float, np.ndarray] | None) -> DataFrame:
    """``doc_id, lang_pred, score, cross_entropy, rejected`` of every document."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(fitted)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            ids, column, at = b.column(0), b.column(1), 0
            while at < len(ids):
                texts, size, end = [], 0, at
                while end < len(ids) and (end == at or size < SLICE_CHARS):
                    t = column[end].as_py()
                    texts.append(t)
                    size += len(t or "")
                    end += 1
                lang, score, xent, out = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts)
                use = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
                if use and shared.value is not None:
                    model, heat, limits = shared.value
                    x, _ = model.cross_entropy([texts[i] for i in use])
                    p, best = softmax(-x * heat), np.argmin(x, axis=1)
                    for r, i in enumerate(use):
                        k = int(best[r])
                        lang[i], score[i], xent[i], out[i] = model.langs[k], float(p[r, k]), float(x[r, k]), bool(x[r, k] > limits[k])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, end - at), pa.array(lang), pa.array(score, pa.float64()), pa.array(xent, pa.float64()), pa.array(out)],
                    names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])
                at = end
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        work, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def held_out():
    """The rows that are never learnt from: crc32 of the id modulo 3 is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


@register("op2_language_id")
def op2_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs.filter(~held_out()).select("text", "lang")))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
