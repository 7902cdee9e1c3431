"""Queries for continuous monitoring: the batch form (SQL-checked) and the
Structured Streaming run over the same rows (rows; batch = stream on
closed windows is tested)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import event_monitor, table
from ..streaming import monitor as MON
from .registry import register
from .views_sql import with_views

_GROUPS = """
, g AS (SELECT strftime(date_trunc('day', event_time), '%Y-%m-%d %H:%M:%S') AS window_start,
               strftime(date_trunc('day', event_time) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
               grp, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS n_pos,
               CAST(sum(y) AS DOUBLE) / count(*) AS selection_rate
        FROM event_monitor GROUP BY 1, 2, 3),
  m AS (SELECT window_start, window_end, CAST(count(*) AS BIGINT) AS n_groups, CAST(sum(n) AS BIGINT) AS n,
               max(selection_rate) - min(selection_rate) AS dp,
               CASE WHEN max(selection_rate) = 0 THEN 1.0 ELSE min(selection_rate) / max(selection_rate) END AS di
        FROM g GROUP BY 1, 2)
"""


def _groups(spark, d):
    return MON.window_groups(event_monitor(spark, d), "event_time", "grp", "y", "1 day")


@register("monitor_window", with_views(_GROUPS + """
SELECT window_start, window_end, grp, n, n_pos, round(selection_rate, 6) AS selection_rate FROM g""",
    "event_monitor"))
def q_monitor_window(spark, d):
    return _groups(spark, d).withColumn("selection_rate", F.round("selection_rate", 6))


@register("monitor_window_metrics", with_views(_GROUPS + """
SELECT window_start, window_end, n_groups, n, round(dp, 6) AS demographic_parity_difference,
       round(di, 6) AS disparate_impact_ratio FROM m""", "event_monitor"))
def q_monitor_window_metrics(spark, d):
    m = MON.window_metrics(_groups(spark, d))
    return m.select("window_start", "window_end", "n_groups", "n",
                    F.round("demographic_parity_difference", 6).alias("demographic_parity_difference"),
                    F.round("disparate_impact_ratio", 6).alias("disparate_impact_ratio"))


@register("monitor_alert", with_views(_GROUPS + """
, s AS (SELECT *, CASE WHEN di < 0.8 THEN least(1.0, (0.8 - di) / 0.4) END AS s1,
               CASE WHEN dp >= 0.1 THEN least(1.0, dp / 0.5) END AS s2,
               CASE WHEN dp >= 0.2 AND di < 1.0 THEN least(1.0, dp / 0.6) END AS s5 FROM m)
SELECT window_start, window_end, round(dp, 6) AS demographic_parity_difference, round(di, 6) AS disparate_impact_ratio,
       concat_ws(' | ', CASE WHEN s1 IS NOT NULL THEN 'Selection Bias signal: disparate impact ratio below 0.80 heuristic.' END,
                 CASE WHEN s2 IS NOT NULL THEN 'Selection Bias signal: notable demographic parity difference across groups.' END,
                 CASE WHEN s5 IS NOT NULL THEN 'Proxy Bias signal: outcome disparity is high while equalized-odds disparity is lower.' END) AS alerts,
       round(greatest(coalesce(s1, 0), coalesce(s2, 0), coalesce(s5, 0)), 6) AS max_strength
FROM s WHERE s1 IS NOT NULL OR s2 IS NOT NULL OR s5 IS NOT NULL""", "event_monitor"))
def q_monitor_alert(spark, d):
    a = MON.window_alerts(MON.window_metrics(_groups(spark, d)))
    return a.select("window_start", "window_end",
                    F.round("demographic_parity_difference", 6).alias("demographic_parity_difference"),
                    F.round("disparate_impact_ratio", 6).alias("disparate_impact_ratio"), "alerts",
                    F.round("max_strength", 6).alias("max_strength"))


@register("monitor_stream")
def q_monitor_stream(spark, d):
    """The events file as a stream (availableNow, 1-day watermark); returns the
    group rows of the windows the watermark closed."""
    ev = table(spark, d, "events")
    out = scratch_path(spark, "monitor")

    def prep(s):
        return s.select(F.col("ts").cast("timestamp").alias("event_time"), F.col("event_type").alias("grp"),
                        (F.col("value") > 50).cast("int").alias("y"))
    MON.run_monitor_stream(spark, d, ev.schema, "event_time", "grp", "y",
                           out, f"{out}/_checkpoint", "1 day", "1 day", prepare=prep, glob="events.parquet")
    return spark.read.parquet(f"{out}/groups").drop("epoch")
