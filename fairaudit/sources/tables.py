"""Input tables and the audit views derived from them.

Every view is a plain DataFrame plan over the parquet tables, so Catalyst
prunes columns and pushes filters into the scans. The small dimension tables
(``nation``, ``region``) are joined with a size-checked broadcast; the
fact-to-fact join (``orders`` x ``customer``) is left to the planner, which
shuffles both sides on the customer key and lets AQE split a skewed key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BROADCAST_MAX_ROWS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_ROWS: dict = {}


def row_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Row count of an input table (parquet footers), remembered per path."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _ROWS:
        _ROWS[key] = table(spark, sf_dir, name).count()
    return _ROWS[key]


def nation_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation x region, broadcast once both row counts (parquet metadata,
    no scan) are known to be small; otherwise a plain join."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    small = (row_count(spark, sf_dir, "nation") <= BROADCAST_MAX_ROWS
             and row_count(spark, sf_dir, "region") <= BROADCAST_MAX_ROWS)
    r = F.broadcast(region) if small else region
    nr = nation.join(r, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_regionkey", "r_name")
    return F.broadcast(nr) if small else nr


def order_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored orders: one row per order with region/segment/priority groups.

    ``y_pred`` is biased by region, ``y_pred_b`` is a second ("mitigated")
    model, ``score`` a probability-like value.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    cust = customer.join(nation_region(spark, sf_dir),
                         customer.c_nationkey == F.col("n_nationkey"))
    j = orders.join(cust, orders.o_custkey == cust.c_custkey)
    price = F.col("o_totalprice")
    return j.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("priority"),
        F.date_format("o_orderdate", "yyyy-MM").alias("period"),
        (price / F.lit(500000.0)).alias("score"),
        ((price + (F.col("o_orderkey") * 7919) % 200000) > 350000).cast("int").alias("y_true"),
        ((price + F.col("n_regionkey") * 40000) > 330000).cast("int").alias("y_pred"),
        (price > 250000).cast("int").alias("y_pred_b"),
        price.alias("o_totalprice"),
        F.col("c_acctbal"),
        F.col("n_regionkey"),
    )


def doc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    j = docs.join(labels, "doc_id")
    return j.select(
        F.col("doc_id").alias("row_id"), "lang", "source", "n_chars",
        F.col("quality").alias("y_true"),
        ((F.col("n_chars") >= 500) & (F.col("toxic") == 0)).cast("int").alias("y_pred"),
    )


def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    ln = F.col("l_linenumber")
    code = (F.when(F.col("l_returnflag") == "A", 0)
            .when(F.col("l_returnflag") == "N", 1).otherwise(2))
    return li.select(
        "l_orderkey", "l_linenumber",
        F.col("l_returnflag").alias("sens"),
        F.when(ln == 3, F.lit(None)).otherwise(F.col("l_quantity")).alias("qty"),
        F.when(ln == 2, F.lit(None)).otherwise(F.col("l_linestatus")).alias("status"),
        F.when(ln == 4, F.lit(None)).otherwise(F.col("l_returnflag")).alias("sens_nullable"),
        (code * 20 + F.col("l_quantity")).alias("proxy_qty"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.lit(1).alias("constant_f"),
        (F.col("l_extendedprice") > 30000).cast("int").alias("y_true"),
    )


def part_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice",
        F.when(F.col("p_size") <= 5, "small").otherwise("large").alias("grp"),
        (F.col("p_retailprice") > 1500).cast("int").alias("y"),
    )


def event_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("event_time"),
        F.col("event_type").alias("grp"),
        (F.col("value") > 50).cast("int").alias("y"),
    )


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribution-shaped long table (row_id, region, feature, contribution)."""
    oa = order_audit(spark, sf_dir)
    feats = F.array(
        F.struct(F.lit("price_level").alias("feature"),
                 ((F.col("o_totalprice") - 250000) / F.lit(250000.0)
                  * (2 + F.col("n_regionkey")) / 10).alias("contribution")),
        F.struct(F.lit("account_balance").alias("feature"),
                 (F.col("c_acctbal") / F.lit(10000.0) * 3 / 10).alias("contribution")),
        F.struct(F.lit("region_offset").alias("feature"),
                 ((F.col("n_regionkey") - 2).cast("double") * 5 / 100).alias("contribution")),
    )
    return (oa.select("row_id", "region", F.explode(feats).alias("fc"))
              .select("row_id", "region", "fc.feature", "fc.contribution"))
