"""Near-duplicate embeddings by product quantisation with exact results.

Vectors are brought to length 1, so cosine >= ``threshold`` means a distance of
at most ``radius = sqrt(2 - 2 * threshold)``. Coarse centroids and residual
subspace codebooks are fitted on at most ``SAMPLE`` vectors; every vector is
indexed: cell, codes, and its own quantisation error. Both prunings are bounds,
so no link is lost:

- probes: a vector within ``radius`` lies in another cell only if the plane
  between the two centroids is that near, so exactly such cells are probed;
- asymmetric distances from lookup tables may exceed ``radius`` by a vector's
  quantisation error at most; what passes is settled by the cosine in double
  precision.

Equal vectors of a label form a class, compared once and counted by size. A cell
is split into blocks of ``BLOCK`` indexed vectors and ``QUERIES`` querying ones,
so a hot label or cell is shared by many tasks. A task returns link counts and a
spanning forest of its links, never the pairs.

Defined results: null labels, and vectors that are null, empty, zero, or hold a
null or non-finite component, link with nothing, as do rows without an id (their
component is null and they are kept). Vectors of different length are not
compared. Repeated rows of one id and vector count as one vector. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, staged
from .graph import components
from .registry import read_table, register

THRESHOLD = 0.98
SAMPLE = 16_384
MAX_CELLS = 256
SUBSPACES = 8
CODES = 64
BLOCK = 512
QUERIES = 2048
SLACK = 1e-6                 # for rounding, in favour of more candidates


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    """Centroids of the rows of ``x``; at most as many as there are rows."""
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(steps):
        near = nearest(x, c)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c ** 2).sum(1)[None, :] - 2 * x @ c.T, axis=1)


class Quantiser:
    """Coarse cells and residual codes for vectors of one length."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        rng = np.random.default_rng(7)
        self.coarse = kmeans(sample, cells, rng)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [kmeans(rest[:, p], CODES, rng) for p in self.parts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes and quantisation errors."""
        cell = nearest(x, self.coarse)
        rest = x - self.coarse[cell]
        codes = np.stack([nearest(rest[:, p], b) for p, b in zip(self.parts, self.books)], axis=1)
        near = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)
        return cell, codes.astype(np.uint8), np.sqrt(((rest - near) ** 2).sum(1))

    def probes(self, x: np.ndarray, cell: np.ndarray, radius: float) -> list[np.ndarray]:
        """Every cell that can hold a vector within ``radius``."""
        d2 = (x ** 2).sum(1)[:, None] - 2 * x @ self.coarse.T + (self.coarse ** 2).sum(1)[None, :]
        own = d2[np.arange(len(x)), cell]
        apart = np.sqrt(((self.coarse[cell][:, None, :] - self.coarse[None, :, :]) ** 2).sum(2))
        near = (d2 - own[:, None]) <= 2 * apart * (radius + SLACK) + SLACK
        return [np.flatnonzero(r) for r in near]

    def distances(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the coded vectors of a cell."""
        rest = q - self.coarse[cell]
        out = np.zeros((len(q), len(codes)))
        for i, (p, b) in enumerate(zip(self.parts, self.books)):
            table = ((rest[:, p][:, None, :] - b[None, :, :]) ** 2).sum(2)
            out += table[:, codes[:, i]]
        return np.sqrt(out)


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, "<f8") for r in raw])
    x = x / np.abs(x).max(axis=1, keepdims=True)         # keeps squares finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _forest(q: np.ndarray, y: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the smallest member of each component of one block's links."""
    i, j = np.nonzero(link)
    ids, inv = np.unique(np.concatenate([q[i], y[j]]), return_inverse=True)
    a, b = inv[:len(i)], inv[len(i):]
    comp = np.arange(len(ids))
    while True:
        low = np.minimum(comp[a], comp[b])
        new = comp.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == comp).all():
            break
        comp = new
    other = np.flatnonzero(comp != np.arange(len(ids)))
    return ids[comp[other]], ids[other]


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for ``vec_id, embedding, label``."""
    spark = vectors.sparkSession
    ship_package(spark)
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"),
                          F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite
              & F.exists("embedding", lambda v: v != 0))
    good = rows.filter(usable).groupBy("label", "embedding", "vec_id").agg(F.lit(1).alias("one"))
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("cnt"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "pq-classes")
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    def as_bytes(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            raw = [np.asarray(v, "<f8").tobytes() for v in b.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("dim"), b.column("node"), b.column("cnt"), pa.array(raw, pa.binary())],
                                             names=["label", "dim", "node", "cnt", "v"])
    plain = classes.select("label", "dim", "node", "cnt", "embedding").mapInArrow(as_bytes, "label string, dim int, node long, cnt long, v binary")
    books = {}
    for dim, n in sizes.items():
        # a bounded sample in hash order fits the codebooks; every vector is indexed
        got = plain.filter(F.col("dim") == dim).filter(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / n) + 1))
        sample = _unit([r["v"] for r in got.limit(2 * SAMPLE).collect()] or [r["v"] for r in plain.filter(F.col("dim") == dim).limit(1).collect()])
        books[dim] = Quantiser(sample, min(MAX_CELLS, max(1, int(math.sqrt(n) / 4))))
    shared = spark.sparkContext.broadcast(books)

    def index(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            for dim in sorted(set(b.column("dim").to_pylist())):
                part = b.filter(pa.array([d == dim for d in b.column("dim").to_pylist()]))
                for at in range(0, len(part), 1024):
                    p = part.slice(at, 1024)
                    x = _unit(p.column("v").to_pylist())
                    quant = shared.value[dim]
                    cell, codes, err = quant.encode(x)
                    probe = quant.probes(x, cell, radius)
                    yield pa.RecordBatch.from_arrays(
                        [*p.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err),
                         pa.array([list(map(int, r)) for r in probe], pa.list_(pa.int32()))],
                        names=["label", "dim", "node", "cnt", "v", "cell", "codes", "err", "probes"])
    table = staged(plain.mapInArrow(index, "label string, dim int, node long, cnt long, v binary, cell int, codes binary, err double, probes array<int>"), "pq-index")
    asked = staged(table.select("label", "dim", "node", "v", F.explode("probes").alias("cell")), "pq-probes")
    key = ["label", "dim", "cell"]
    have = table.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    want = asked.groupBy(key).agg(F.count(F.lit(1)).alias("q"))
    grid = staged(have.join(want, key).select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("q") / QUERIES).cast("int").alias("nq")), "pq-grid")
    h = F.xxhash64("node")
    y = (table.drop("probes").join(grid, key).withColumn("b", F.pmod(h, F.col("nb")).cast("int"))
              .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).drop("nb", "nq"))
    q = (asked.join(grid, key).withColumn("qb", F.pmod(h, F.col("nq")).cast("int"))
              .withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).drop("nb", "nq"))

    def match(ids, left, right):
        import pandas as pd
        out = {"a": [], "b": [], "n": []}
        if len(left) and len(right):
            quant = shared.value[int(left["dim"].iloc[0])]
            cell = int(left["cell"].iloc[0])
            codes = np.stack([np.frombuffer(c, np.uint8) for c in left["codes"]])
            limit = radius + left["err"].to_numpy() + SLACK
            raw_y = np.stack([np.frombuffer(r, "<f8") for r in left["v"]])
            node, cnt = left["node"].to_numpy(), left["cnt"].to_numpy()
            for at in range(0, len(right), 256):
                part = right.iloc[at:at + 256]
                raw_q = np.stack([np.frombuffer(r, "<f8") for r in part["v"]])
                me = part["node"].to_numpy()
                near = quant.distances(_unit(list(part["v"])), cell, codes) <= limit[None, :]
                near &= me[:, None] != node[None, :]
                i, j = np.nonzero(near)
                for k in range(0, len(i), 100_000):
                    ii, jj = i[k:k + 100_000], j[k:k + 100_000]
                    near[ii, jj] = cosine(raw_q[ii], raw_y[jj]) >= threshold
                n = near @ cnt
                hit = n > 0
                a, b = _forest(me, node, near)
                out["a"] += [me[hit], a]
                out["b"] += [np.full(hit.sum(), -1), b]
                out["n"] += [n[hit], np.zeros(len(a), np.int64)]
        return pd.DataFrame({k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}, dtype="int64")
    block = [*key, "b", "qb"]
    found = staged(y.groupBy(*block).cogroup(q.groupBy(*block)).applyInPandas(match, "a long, b long, n long"), "pq-links")
    links = found.filter("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    named = classes.join(links, "node", "left")
    edges = found.filter("b >= 0").select("a", "b").distinct()
    if edges.isEmpty():
        named = named.withColumn("comp", F.col("rep"))
    else:
        named = named.join(components(edges).withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        name = named.groupBy("comp").agg(F.min("rep").alias("least_id"))
        named = named.join(name, "comp").drop("comp").withColumnRenamed("least_id", "comp")
    named = staged(named.select("label", "embedding", (F.col("cnt") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "comp"), "pq-result")
    out = rows.withColumn("_ok", F.coalesce(usable, F.lit(False))).withColumn("_l", F.when(F.col("_ok"), F.col("label")))
    out = out.withColumn("_e", F.when(F.col("_ok"), F.col("embedding")))
    r = named.withColumnsRenamed({"label": "_rl", "embedding": "_re"})
    out = out.join(r, (F.col("_l") == F.col("_rl")) & (F.col("_e") == F.col("_re")), "left")
    comp = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"),
                      F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of pairs of rows, in double precision."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r AS (SELECT a AS id, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id),
n AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.c, v.vec_id) AS component_id, coalesce(c.c, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.id = v.vec_id LEFT JOIN c ON c.id = v.vec_id"""


@register("op7_embedding_dedup", ORACLE)
def op7_embedding_dedup(spark, sf_dir):
    return link_vectors(read_table(spark, sf_dir, "embeddings"))
