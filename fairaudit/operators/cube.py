"""The confusion cube: one aggregate over the rows that feeds every metric.

Rows are reduced to ``(slice..., attr, grp, y_true, y_pred) -> n`` with a
hash aggregate. Spark's partial (map-side) aggregation means each task emits
at most ``groups x labels^2`` rows per slice, so a group holding a third of
all rows costs no more shuffle than a small one. Label inference and
binarisation then run on this small cube, not on the rows.

Several sensitive attributes are audited in the same pass: the rows are
unpivoted to ``(attr, grp)`` (an ``Expand`` inside the same codegen stage)
before the partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import drop_all, fill_group, keys_of, with_all
from ..functions.labels import is_pos, window_positive_label


def as_list(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def with_groups(df: DataFrame, attrs, keep: list[str], unknown: str | None = None) -> DataFrame:
    """Long form ``(keep..., attr, grp)``; ``grp`` is text, null kept unless
    ``unknown`` names a fill value."""
    attrs = as_list(attrs)
    conv = (lambda c: fill_group(F.col(c), unknown)) if unknown else (lambda c: F.col(c).cast("string"))
    if len(attrs) == 1:
        a = attrs[0]
        return df.select(*keep, F.lit(a).alias("attr"), conv(a).alias("grp"))
    wide = df.select(*keep, *[conv(a).alias(a) for a in attrs])
    return wide.unpivot(keep, attrs, "attr", "grp")


def confusion_cube(df: DataFrame, y_true: str, y_pred: str, attrs, slice_cols=()) -> DataFrame:
    """(slice keys..., attr, grp, y_true, y_pred, n) with raw label values."""
    d = with_all(df, slice_cols)
    keys = keys_of(slice_cols)
    d = d.select(*keys, *as_list(attrs), F.col(y_true).alias("y_true"),
                 F.col(y_pred).alias("y_pred"))
    g = with_groups(d, attrs, keys + ["y_true", "y_pred"])
    return g.groupBy(*keys, "attr", "grp", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def binarized_confusion(cube: DataFrame, keys: list[str], pos_label=None) -> DataFrame:
    """Per-group TP/FP/FN/TN from a raw-label cube.

    ``pos_label`` None -> inferred per slice from y_true and y_pred together.
    """
    if pos_label is None:
        dt = cube.select(F.array("y_true", "y_pred").alias("a")).schema["a"].dataType.elementType
        c = cube.withColumn("pos_label", window_positive_label(
            F.col("y_true").cast(dt), F.col("y_pred").cast(dt), keys, dt, "pair"))
        p = F.col("pos_label")
    else:
        c, p = cube, F.lit(pos_label)
    t, yp, n = is_pos(F.col("y_true"), p), is_pos(F.col("y_pred"), p), F.col("n")
    return c.groupBy(*keys, "attr", "grp").agg(
        F.sum(n).alias("n"),
        F.sum(F.when((t == 1) & (yp == 1), n).otherwise(0)).alias("tp"),
        F.sum(F.when((t == 0) & (yp == 1), n).otherwise(0)).alias("fp"),
        F.sum(F.when((t == 1) & (yp == 0), n).otherwise(0)).alias("fn"),
        F.sum(F.when((t == 0) & (yp == 0), n).otherwise(0)).alias("tn"),
    )


def group_confusion(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                    attrs="grp", slice_cols=(), pos_label=None) -> DataFrame:
    """(slice keys..., attr, grp, n, tp, fp, fn, tn) -- the core table."""
    keys = keys_of(slice_cols)
    cube = confusion_cube(df, y_true, y_pred, attrs, slice_cols)
    return drop_all(binarized_confusion(cube, keys, pos_label), slice_cols)


def outcome_cube(df: DataFrame, target: str, attrs, slice_cols=(), unknown: str | None = "Unknown") -> DataFrame:
    """(slice keys..., attr, grp, y, n) for raw-data audits (one label column)."""
    d = with_all(df, slice_cols)
    keys = keys_of(slice_cols)
    d = d.select(*keys, *as_list(attrs), F.col(target).alias("y"))
    g = with_groups(d, attrs, keys + ["y"], unknown=unknown)
    return g.groupBy(*keys, "attr", "grp", "y").agg(F.count(F.lit(1)).alias("n"))
