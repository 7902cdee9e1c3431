"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``id, comp`` for every end of an edge ``a, b``: the smallest id reachable.

    Each round takes the smallest label among neighbours and then the label of
    that label, until nothing changes; every round is written to the shared
    folder and the one before deleted. Labels are summed per node before the
    shuffle, so a hub with many edges is no hot key; its row in the join can be
    split. The result is the table ``cc-labels`` of ``scratch``.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    staged = scratch.staged
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("m"))
                    .select(F.col("a").alias("id"), F.least("a", "m").alias("comp")), "cc-labels")
    while True:
        near = (both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("m")))
        one = labels.join(near, labels["id"] == near["a"]).select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        up = labels.select(F.col("id").alias("_i"), F.col("comp").alias("_c"))
        new = staged(one.join(up, one["comp"] == up["_i"], "left")
                     .select("id", "old", F.least("comp", F.coalesce("_c", "comp")).alias("comp")), "cc-labels")
        labels = new.select("id", "comp")
        scratch.drop("cc-labels", but_last=1)
        if new.filter("old <> comp").isEmpty():
            scratch.drop("cc-edges")
            return labels
