"""Positive-label inference and binarisation as column expressions.

Inference runs on a *small* table of distinct labels (per slice), never on
the rows: the callers first aggregate the rows to a label cube and then apply
these expressions to the cube, so a single pass over the data suffices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Positive-label candidates, matched on trimmed lower-case text,
# earlier entries win.
AUDIT_CANDIDATES = ["1", "true", "yes", "y", "hired", "selected", "positive"]
PAIR_CANDIDATES = ["1", "true", "yes", "y", "hired", "positive"]
PREPROCESS_CANDIDATES = ["1", "true", "yes", "y", "hired", "positive"]

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC)


def _text(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def _one_of(dt: T.DataType) -> Column:
    """The label ``1`` in the column's own type; null for text labels.

    A text label never equals the integer 1, so a text column with other than
    two labels has no positive value at all.
    """
    if isinstance(dt, T.StringType):
        return F.lit(None).cast(dt)
    return F.lit(1).cast(dt)


def positive_label_expr(k: Column, lo: Column, hi: Column, dt: T.DataType,
                        candidates: list[str], numeric_shortcut: bool,
                        minus_one_shortcut: bool) -> Column:
    """Positive label from the distinct-label summary ``(k, lo, hi)``.

    ``k`` is the number of distinct non-null labels; when ``k == 2`` the label
    set is exactly ``{lo, hi}``. Rules: not two labels -> 1; numeric {0,1}
    (and optionally {-1,1}) -> 1; else the first candidate present (by
    trimmed lower text); else the larger label by lower-case text.
    """
    one = _one_of(dt)
    cand = F.array(*[F.lit(c) for c in candidates])
    lo_i = F.array_position(cand, _text(lo))
    hi_i = F.array_position(cand, _text(hi))
    by_candidate = (F.when((lo_i > 0) & ((hi_i == 0) | (lo_i <= hi_i)), lo)
                    .when(hi_i > 0, hi))
    lo_s, hi_s = F.lower(lo.cast("string")), F.lower(hi.cast("string"))
    by_text = F.when(lo_s > hi_s, lo).otherwise(hi)
    out = F.when(k != 2, one)
    if isinstance(dt, T.BooleanType):
        # pandas: {False, True} is a subset of {0, 1}
        out = out.when(F.lit(numeric_shortcut), one)
    elif is_numeric(dt) and numeric_shortcut:
        zero_one = lo.cast("double").isin(0.0, 1.0) & hi.cast("double").isin(0.0, 1.0)
        out = out.when(zero_one, one)
        if minus_one_shortcut:
            m1 = lo.cast("double").isin(-1.0, 1.0) & hi.cast("double").isin(-1.0, 1.0)
            out = out.when(m1, one)
    return out.otherwise(F.coalesce(by_candidate, by_text))


def label_summary(labels: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """(keys..., k, lo, hi) over a long table of labels."""
    c = F.col(label)
    return labels.groupBy(*keys).agg(
        F.count_distinct(c).alias("k"), F.min(c).alias("lo"), F.max(c).alias("hi"))


def infer_positive(labels: DataFrame, keys: list[str], label: str = "label",
                   variant: str = "audit") -> DataFrame:
    """(keys..., pos_label) for each key combination.

    ``variant``: ``audit`` (raw-data audit), ``pair`` (y_true with y_pred,
    metric binarisation) or ``preprocess`` (target encoding).
    """
    dt = labels.schema[label].dataType
    cands = {"audit": AUDIT_CANDIDATES, "pair": PAIR_CANDIDATES,
             "preprocess": PREPROCESS_CANDIDATES}[variant]
    numeric_shortcut = variant in ("audit", "preprocess")
    minus_one = variant in ("audit", "preprocess")
    s = label_summary(labels, keys, label)
    return s.select(*keys, positive_label_expr(
        F.col("k"), F.col("lo"), F.col("hi"), dt, cands, numeric_shortcut,
        minus_one).alias("pos_label"), "k")


def is_pos(c: Column, pos: Column) -> Column:
    """1 when ``c`` equals the positive label, else 0 (null counts as 0)."""
    return F.coalesce(c == pos, F.lit(False)).cast("int")


def window_positive_label(y_true: Column, y_pred: Column | None, keys: list[str], dt: T.DataType,
                          variant: str = "pair") -> Column:
    """Positive label per slice, computed over a (small) label cube with a
    window partitioned by the slice keys -- no join back, one scan."""
    from pyspark.sql import Window
    cands = {"audit": AUDIT_CANDIDATES, "pair": PAIR_CANDIDATES,
             "preprocess": PREPROCESS_CANDIDATES}[variant]
    w = Window.partitionBy(*keys)
    elems = F.array(y_true, y_pred) if y_pred is not None else F.array(y_true)
    labels = F.filter(F.array_distinct(F.flatten(F.collect_set(elems).over(w))), lambda x: x.isNotNull())
    numeric_shortcut = variant in ("audit", "preprocess")
    return positive_label_expr(F.size(labels), F.array_min(labels), F.array_max(labels), dt, cands,
                               numeric_shortcut, numeric_shortcut)
