"""Mixing sources to target weights by Poisson replication.

Every source has a mean repetition rate: target share of the mixture divided
by its natural share, times the wanted size. A document's number of copies is
the inverse Poisson distribution function at a uniform number that a keyed hash
of its id gives, so copies are drawn independently, in place and repeatably.
Documents are exploded by their count and dealt to a global order by a second
keyed hash.

The only aggregate is one row per source (summed before the shuffle); its join
back broadcasts the table of sources only if the planner finds it under its
size threshold. Splitting by the order hash spreads a hot source and groups of
copies evenly.

Defined results: a null source is a source of its own; a null text weighs 0
characters; a null id hashes like the empty string; repeated rows of one id get
equal counts, as they get equal hashes. A source whose texts are all empty has
rate 0 by weight of characters, so its rate is set to ``size``. An empty table
gives an empty result. Input columns named ``rate``, ``n_copies``, ``copy`` or
``order_key`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .columns import ROW, aside
from .registry import read_table, register

SEED = "mix-2"
ADDED = ("rate", "n_copies", "copy", "order_key")


def uniform(seed: str, *cols: Column) -> Column:
    """52 bits of a keyed md5 as a number in [0, 1)."""
    key = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def poisson_cdf(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... to far beyond any 52-bit uniform.

    Probabilities are carried as logarithms, so that a rate in the hundreds
    does not underflow.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    step = F.coalesce(F.log(rate), F.lit(float("-inf")))
    first = F.struct((-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))
    return F.aggregate(
        F.sequence(F.lit(1), last), first,
        lambda a, k: F.struct((a["p"] + step - F.log(k)).alias("p"),
                              F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + F.exp(a["p"] + step - F.log(k)))).alias("cdf")),
        lambda a: a["cdf"])


def source_rates(docs: DataFrame, temperature: float = 0.7, size: float = 1.0,
                 weights: dict[str, float] | None = None) -> DataFrame:
    """One row per source: ``source, n_docs, n_chars_total, rate, cdf``.

    Without ``weights`` the target share of a source is its share of characters
    to the power ``temperature``, normalised. ``size`` is the expected size of
    the mixture as a multiple of the corpus.
    """
    per = docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("n_chars_total"))
    per = staged(per, "mix-sources")
    total = per.agg(F.sum("n_chars_total").alias("t")).first()["t"] or 0
    share = F.col("n_chars_total") / F.lit(float(max(total, 1)))
    if weights is None:
        per = per.withColumn("_w", F.pow(share, F.lit(float(temperature))))
    else:
        pairs = [F.when(F.col("source") == s, F.lit(float(w))) for s, w in weights.items()]
        per = per.withColumn("_w", F.coalesce(*pairs, F.lit(0.0)))
    norm = per.agg(F.sum("_w").alias("w")).first()["w"] or 1.0
    rate = F.when(F.col("n_chars_total") > 0, F.lit(float(size)) * F.col("_w") / F.lit(float(norm)) / share) \
            .otherwise(F.lit(float(size)))
    return per.withColumn("rate", rate).withColumn("cdf", poisson_cdf(F.col("rate"))).drop("_w")


def mix(docs: DataFrame, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """Documents repeated by their drawn counts, in a global random order.

    Adds ``rate, n_copies, copy, order_key``; rows are dealt to partitions by
    ``order_key`` and sorted inside them.
    """
    d = aside(docs, "doc_id", "source")
    r = rates.select(F.col("source").alias("_s"), "rate", "cdf")
    # the count is drawn before the join can shuffle: only sources are joined
    j = d.join(r, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    # the one-element array binds the uniform, so that it is computed once
    count = F.get(F.transform(F.array(uniform(seed, F.col("doc_id"))), lambda u: F.size(F.filter("cdf", lambda c: c <= u))), 0)
    j = j.withColumn("n_copies", count.cast("int"))
    j = j.filter(F.col("n_copies") > 0).drop("cdf")
    j = j.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    j = j.withColumn("order_key", F.md5(F.concat_ws(":", F.lit(seed + "/order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long")
    j = j.repartitionById(parts, F.floor(slot * parts / F.lit(2 ** 32)).cast("int"))
    own = [c for c in docs.columns if c not in ADDED]
    return (j.sortWithinPartitions("order_key", "doc_id")
             .select(*[F.col(ROW).getField(c).alias(c) for c in own], *ADDED))


ORACLE = f"""
WITH s AS (SELECT source, sum(coalesce(length(text), 0)) AS c FROM documents GROUP BY source),
t AS (SELECT sum(c) AS t FROM s),
w AS (SELECT source, c, c / t.t::DOUBLE AS share, power(c / t.t::DOUBLE, 0.7) AS w FROM s, t),
n AS (SELECT sum(w) AS w FROM w),
r AS (SELECT source, CASE WHEN c > 0 THEN w.w / n.w / share ELSE 1.0 END AS rate FROM w, n),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM r),
p AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM k),
c AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
cl AS (SELECT source, any_value(rate) AS rate, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source),
u AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, cl.rate,
        len(list_filter(cl.cdf, lambda x: x <= ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE))::INTEGER AS n_copies
      FROM documents d JOIN cl ON d.source IS NOT DISTINCT FROM cl.source),
x AS (SELECT *, unnest(range(1, n_copies + 1))::INTEGER AS copy FROM u WHERE n_copies > 0)
SELECT doc_id, text, lang, source, n_chars, round(rate, 6) AS rate, n_copies, copy,
       md5('{SEED}/order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS order_key FROM x"""


@register("op8_mix_sources", ORACLE)
def op8_mix_sources(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return mix(docs, source_rates(docs)).withColumn("rate", F.round("rate", 6))
