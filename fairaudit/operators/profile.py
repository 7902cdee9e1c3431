"""Validation and profiling (§2.2): one aggregate pass, header checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import drop_all, keys_of, named, with_all
from ..functions.labels import infer_positive
from .cube import as_list

# UI limit for a usable sensitive attribute (fixed value)
MAX_GROUPS = 20


class SchemaError(ValueError):
    pass


def validate_schema(df: DataFrame, required_columns, target: str, sensitive) -> dict:
    """Header-only checks, in the order the audit expects; returns present
    sensitive attributes. Emptiness needs one bounded job (``isEmpty``)."""
    if df is None:
        raise SchemaError("Dataset is None. Expected a DataFrame.")
    cols = df.columns
    missing = [c for c in required_columns if c not in cols]
    if df.isEmpty():
        raise SchemaError("Dataset is empty. Provide a non-empty dataset.")
    if missing:
        raise SchemaError("Missing required feature columns: " + ", ".join(missing))
    if target not in cols:
        raise SchemaError(f"Target column '{target}' is missing from the dataset.")
    sens = as_list(sensitive)
    if not sens:
        raise SchemaError("At least one sensitive attribute name must be provided.")
    present = [a for a in sens if a in cols]
    if not present:
        raise SchemaError("No sensitive attribute column found. Expected at least one of: "
                          + ", ".join(sens))
    return {"columns": len(cols), "present_sensitive_attributes": present}


def profile_table(df: DataFrame, target: str | None = None, sensitive=(), exact: bool = True) -> DataFrame:
    """(column, position, dtype, role, n_rows, n_null, n_distinct), one pass.

    Exact distinct counts use Spark's distinct-aggregate rewrite (an Expand
    per column, deduplicated by partial aggregation before the shuffle);
    ``exact=False`` uses HyperLogLog sketches instead (no Expand, 1 %
    relative error) for very wide tables.
    """
    sens = set(as_list(sensitive))
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(cols):
        aggs.append(F.count(named(c)).alias(f"nn_{i}"))
        nd = F.count_distinct(named(c)) if exact else F.approx_count_distinct(named(c), 0.01)
        aggs.append(nd.alias(f"nd_{i}"))
    row = df.agg(*aggs)
    dtypes = dict(df.dtypes)
    recs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                 F.lit(dtypes[c]).alias("dtype"),
                 F.lit("target" if c == target else ("sensitive" if c in sens else "feature")).alias("role"),
                 (F.col("n_rows") - F.col(f"nn_{i}")).alias("n_null"),
                 F.col(f"nd_{i}").alias("n_distinct"))
        for i, c in enumerate(cols)])
    return (row.select("n_rows", F.inline(recs))
               .select("column", "position", "dtype", "role", "n_rows", "n_null", "n_distinct"))


def sensitive_candidates(df: DataFrame, target: str, max_groups: int = MAX_GROUPS) -> DataFrame:
    """Columns other than the target with at most ``max_groups`` distinct
    non-null values, in column order: (column, position, n_unique).

    Pass 1: ``approx_count_distinct`` for every column (no Expand). Pass 2:
    exact distinct counts only for columns the sketch cannot rule out.
    """
    cols = [c for c in df.columns if c != target]
    approx = df.agg(*[F.approx_count_distinct(named(c), 0.01).alias(f"a_{i}")
                      for i, c in enumerate(cols)]).first()
    # generous margin over the sketch's error: never drop a true candidate
    maybe = [(i, c) for i, c in enumerate(cols) if approx[f"a_{i}"] <= max_groups * 2 + 10]
    spark = df.sparkSession
    if not maybe:
        return spark.createDataFrame([], "column string, position int, n_unique bigint")
    exact = df.agg(*[F.count_distinct(named(c)).alias(f"e_{i}") for i, c in maybe])
    recs = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(df.columns.index(c)).alias("position"),
                              F.col(f"e_{i}").alias("n_unique")) for i, c in maybe])
    return (exact.select(F.inline(recs)).where(F.col("n_unique") <= max_groups))


def label_profile(df: DataFrame, target: str, slice_cols=()) -> DataFrame:
    """Per slice: number of distinct labels, binary flag, {0,1} flag."""
    keys = keys_of(slice_cols)
    d = with_all(df, slice_cols)
    y = F.col(target)
    out = d.groupBy(*keys).agg(
        F.count_distinct(y).alias("n_labels"),
        F.coalesce(F.bool_and(F.when(y.isNotNull(), y.cast("string").isin("0", "1"))),
                   F.lit(True)).alias("is_zero_one"))
    out = out.select(*keys, "n_labels", (F.col("n_labels") == 2).alias("is_binary"), "is_zero_one")
    return drop_all(out, slice_cols)


def require_zero_one(df: DataFrame, target: str, context: str) -> None:
    """Raise naming the labels found (a bounded sample of them) unless 0/1."""
    prof = label_profile(df, target).first()
    if not prof["is_zero_one"]:
        found = sorted(str(r[0]) for r in df.select(target).where(F.col(target).isNotNull())
                       .distinct().limit(20).collect())
        raise ValueError(f"{context} requires binary labels encoded as 0/1, but found labels: {found}.")


def positive_label(df: DataFrame, target: str, slice_cols=(), variant: str = "audit") -> DataFrame:
    """(slice..., pos_label, n_labels) -- the positive label per slice."""
    keys = keys_of(slice_cols)
    d = with_all(df, slice_cols)
    labels = d.select(*keys, F.col(target).alias("label")).where(F.col("label").isNotNull())
    out = infer_positive(labels, keys, "label", variant).withColumnRenamed("k", "n_labels")
    return drop_all(out, slice_cols)


def positive_label_pair(df: DataFrame, y_true: str, y_pred: str, slice_cols=()) -> DataFrame:
    keys = keys_of(slice_cols)
    d = with_all(df, slice_cols)
    labels = (d.select(*keys, F.col(y_true).alias("label"))
              .unionByName(d.select(*keys, F.col(y_pred).alias("label")))
              .where(F.col("label").isNotNull()))
    out = infer_positive(labels, keys, "label", "pair").withColumnRenamed("k", "n_labels")
    return drop_all(out, slice_cols)
