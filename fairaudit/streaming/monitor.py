"""Continuous fairness monitoring with Structured Streaming.

The same plan runs in batch and in a stream: group counts and selection
rates per event-time window (tumbling or sliding) and group; window-level
demographic-parity difference and disparate-impact ratio are taken from the
emitted group rows (in the stream, inside ``foreachBatch``: in append mode a
window's group rows are all emitted in the batch where the watermark passes
it). Late rows beyond the watermark are dropped by the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from ..operators.rules import BiasThresholds, RULE_ORDER, RULE_TEXT, signal_strengths

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def window_groups(df: DataFrame, time_col: str, group: str, label: str, duration: str = "1 day",
                  slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """(window_start, window_end, grp, n, n_pos, selection_rate)."""
    d = df.withColumn(time_col, F.col(time_col).cast("timestamp"))  # watermarks need TIMESTAMP
    if watermark:
        d = d.withWatermark(time_col, watermark)
    w = F.window(time_col, duration, slide) if slide else F.window(time_col, duration)
    g = d.groupBy(w.alias("w"), F.col(group).cast("string").alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).alias("n_pos"))
    return g.select(F.date_format("w.start", TS_FORMAT).alias("window_start"),
                    F.date_format("w.end", TS_FORMAT).alias("window_end"), "grp", "n", "n_pos",
                    ratio(F.col("n_pos"), F.col("n")).alias("selection_rate"))


def window_metrics(groups: DataFrame) -> DataFrame:
    """Per window: n_groups, n, DP difference, DI ratio (1 when no positives)."""
    a = groups.groupBy("window_start", "window_end").agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n"),
        F.max("selection_rate").alias("_mx"), F.min("selection_rate").alias("_mn"))
    return a.select("window_start", "window_end", "n_groups", "n",
                    (F.col("_mx") - F.col("_mn")).alias("demographic_parity_difference"),
                    F.when(F.col("_mx") == 0, F.lit(1.0)).otherwise(ratio(F.col("_mn"), F.col("_mx")))
                     .alias("disparate_impact_ratio"))


def window_alerts(metrics: DataFrame, cfg: BiasThresholds = BiasThresholds()) -> DataFrame:
    """Windows whose metrics fire a selection rule: (window, rules, strength)."""
    m = metrics.withColumn("equalized_odds_difference", F.lit(0.0)).withColumn(
        "imbalance_ratio", F.lit(None).cast("double"))
    sig = signal_strengths(cfg)
    keys = [k for k in RULE_ORDER if k in ("selection_di", "selection_dp", "proxy_gap")]
    rules = F.array_compact(F.array(*[F.when(sig[k].isNotNull(), F.lit(RULE_TEXT[k])) for k in keys]))
    st = F.array_compact(F.array(*[sig[k] for k in keys]))
    return (m.select("window_start", "window_end", "demographic_parity_difference", "disparate_impact_ratio",
                     F.array_join(rules, " | ").alias("alerts"), F.array_max(st).alias("max_strength"),
                     F.size(rules).alias("n_alerts"))
             .where(F.col("n_alerts") > 0))


def run_monitor_stream(spark: SparkSession, source_path: str, schema, time_col: str, group: str, label: str,
                       out_path: str, checkpoint: str, duration: str = "1 day", watermark: str = "1 day",
                       prepare=None, glob: str | None = None) -> None:
    """Stream the parquet files under the folder ``source_path`` (optionally
    only those matching ``glob``) to completion
    (``availableNow``) and write group rows, window metrics and alerts to
    ``out_path/{groups,metrics,alerts}/epoch=N``, one folder per micro-batch.
    A batch that is run again after a failure replaces its own folder, so no
    row comes twice. Restartable from ``checkpoint``."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    src = reader.parquet(source_path)
    if prepare is not None:
        src = prepare(src)
    groups = window_groups(src, time_col, group, label, duration, watermark=watermark)

    def sink(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        b = batch.persist()
        met = window_metrics(b)
        for name, part in (("groups", b), ("metrics", met), ("alerts", window_alerts(met))):
            part.write.mode("overwrite").parquet(f"{out_path}/{name}/epoch={epoch}")
        b.unpersist()

    q = (groups.writeStream.outputMode("append").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
