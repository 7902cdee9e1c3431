"""Small shared column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "_all"  # constant slice key used when a caller gives no slice columns


def dbl(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def named(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; null when den is 0 or null (ANSI-safe)."""
    return F.try_divide(dbl(num), dbl(den))


def rate0(num: Column, den: Column) -> Column:
    """num / den, 0 when undefined (zero-division -> 0)."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def r6(c: Column) -> Column:
    return F.round(c, 6)


def keys_of(slice_cols) -> list[str]:
    """Slice keys, never empty: a constant key stands for "whole table"."""
    return list(slice_cols) if slice_cols else [ALL]


def with_all(df: DataFrame, slice_cols) -> DataFrame:
    return df if slice_cols else df.withColumn(ALL, F.lit(0))


def drop_all(df: DataFrame, slice_cols) -> DataFrame:
    return df if slice_cols else df.drop(ALL)


def group_text(c: Column) -> Column:
    """Group label as text (booleans print as Spark's 'true'/'false')."""
    return c.cast("string")


def fill_group(c: Column, fill: str = "Unknown") -> Column:
    return F.coalesce(c.cast("string"), F.lit(fill))


def fairness_score(dp: Column, eo: Column, di: Column, cap: bool = True) -> Column:
    """Mean of |DP|, |EO| and |1 - DI| (each capped at 1 unless ``cap=False``)."""
    parts = [F.abs(dp), F.abs(eo), F.abs(F.lit(1.0) - di)]
    if cap:
        parts = [F.least(p, F.lit(1.0)) for p in parts]
    return F.round((parts[0] + parts[1] + parts[2]) / 3.0, 6)


def fixed3(c: Column) -> Column:
    """'%.3f' text of a double rounded from its exact binary value.

    Java's formatter rounds the shortest decimal form half-up (0.2875 ->
    0.288), the audit's text rounds the binary value (0.287). Applied to
    audit rows only (one per slice), through an Arrow-batched pandas UDF that
    is defined here, so that executors need not import this package.
    """
    def text(s):
        return s.map(lambda v: None if v is None or v != v else f"{v:.3f}")
    text.__module__ = "__main__"
    return F.pandas_udf(text, "string")(c.cast("double"))


def bin_column(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins ``(e0, e1], (e1, e2], ...``; outside -> null."""
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (c > lo) & (c <= hi)
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out
