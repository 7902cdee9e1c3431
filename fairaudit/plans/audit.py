"""Composite jobs: dataset preparation and the audit report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import named
from ..operators import prepare as P
from ..session import materialize
from ..operators.cube import as_list


def prepare_dataset(df: DataFrame, target: str, sensitive: str, key: str,
                    test_size: float = 0.2, seed: int = 42, include_sensitive: bool = True,
                    exclude=(), stratify: bool = True) -> DataFrame:
    """Impute -> encode target -> one-hot features -> split, as one DataFrame.

    Output: ``key``, encoded feature columns, ``y`` (0/1 when binary),
    ``sensitive`` (the imputed group value) and ``split``. Imputation
    statistics come from all rows, target and sensitive column included, as
    the audit this mirrors does.

    Columns and values may have any name: a feature is called after its column
    (and value), with an underscore for a dot or backtick, and numbered if that
    name is taken (by the key, ``y``, ``sensitive`` or ``split`` as well, in letters
    of either case); its metadata hold the column and the value as they were. A date counts as
    days, a time as seconds since 1970. Nested and binary columns are refused.
    """
    exclude = set(as_list(exclude))
    given = [c for c in df.columns if c != key and c not in exclude]
    odd = [c for c in given if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    if odd:
        raise ValueError(f"columns {odd} cannot be features; exclude them")
    taken = {key.lower(), "y", "sensitive", "split", "_y", "_key"}
    name = {c: P.plain_name(c, taken) for c in given}
    cols = [name[c] for c in given]
    target, sensitive_name = name[target], name[sensitive]
    # the statistics below take several passes: read the input once, then
    # work from a checkpoint of just the needed columns
    base = materialize(P.nan_to_null(df.select(named(key).alias("_key"), *[_as_feature(df, c).alias(name[c]) for c in given])))
    cat_cols = P.categorical_columns(base.drop("_key"))
    # one (column, value) count gives the modes and the one-hot value lists
    modes, values = P.modes_and_values(base, cat_cols)
    stats = {c: (0 if m is None else m) for c, m in
             P.exact_medians(base, P.numeric_columns(base.drop("_key"))).items()}
    stats.update({c: ("missing" if modes.get(c) is None else modes[c]) for c in cat_cols})
    for c in cat_cols:
        if values[c] is not None and modes.get(c) is None:
            values[c] = sorted(set(values[c]) | {"missing"})  # all-null column filled with 'missing'
    filled = P.apply_fill(base, stats)
    filled = P.encode_binary_target(filled, target, out="_y")
    feats = [c for c in cols if c != target and (include_sensitive or c != sensitive_name)]
    sel = filled.select("_key", *feats, F.col("_y").alias("y"), F.col(sensitive_name).cast("string").alias("sensitive"))
    cat = [c for c in feats if c in P.categorical_columns(sel)]
    known = {c: values[c] for c in cat if values.get(c) is not None}
    wide = [c for c in cat if c not in known]
    # too many values for a column each: one sparse vector column instead
    enc = P.one_hot_sparse(sel, wide) if wide else sel
    was = {v: k for k, v in name.items()}
    out = []
    for c in enc.columns:
        if c in known:
            for v in known[c]:
                about = {"feature": {"column": was[c], "value": v}}
                out.append((F.col(c).cast("string") == F.lit(v)).cast("int").alias(P.plain_name(f"{c}_{v}", taken), metadata=about))
        elif c in was and was[c] != c:
            out.append(F.col(c).alias(c, metadata={"feature": {"column": was[c]}}))
        else:
            out.append(F.col(c))
    split = P.split(enc.select(*out), "_key", "y", test_size=test_size, seed=seed, stratify=stratify)
    return split.select(F.col("_key").alias(key), *[c for c in split.columns if c != "_key"])


def _as_feature(df: DataFrame, c: str):
    kind = df.schema[c].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(named(c)).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return named(c).cast("timestamp").cast("double")
    return named(c)


def feature_columns(prepared: DataFrame, key: str) -> list[str]:
    return [c for c in prepared.columns if c not in (key, "y", "sensitive", "split")]


def audit_report(df: DataFrame, y_true: str, y_pred: str, attr: str, features: list[str],
                 top_k: int = 5) -> DataFrame:
    """One audit row for a sensitive attribute: prediction fairness, raw-data
    shares (imbalance), observed selection-rate gap, the bias rules and the
    root-cause diagnosis with the strongest proxy among ``features`` (the
    target is never a feature)."""
    from ..operators import proxy as X
    from ..operators import rules as R
    from ..operators.metrics import distribution_summary
    audit = R.audit_rows(df, y_true, y_pred, attr)
    ident = R.identify_bias(audit)
    summ = distribution_summary(df, y_true, attr).drop("_all")
    top = X.top_k(X.pearson(df.select(attr, *[f for f in features if f != y_true]), attr), top_k) \
        .withColumn("attr", F.lit(attr))
    diag = R.diagnose(summ, ["attr"], top)
    best = top.where(F.col("rank") == 1).select("attr", F.col("feature").alias("top_proxy"),
                                                F.round("correlation", 6).alias("top_proxy_correlation"))
    return (ident.select("attr", "n_groups", F.round("demographic_parity_difference", 6).alias("dp"),
                         F.round("equalized_odds_difference", 6).alias("eo"),
                         F.round("disparate_impact_ratio", 6).alias("di"),
                         F.round("imbalance_ratio", 6).alias("imbalance_ratio"),
                         "detected_bias_type", "severity_score")
            .join(summ.select("attr", F.round("selection_rate_gap", 6).alias("selection_rate_gap")), "attr")
            .join(diag.select("attr", F.col("bias_type").alias("root_cause_type"),
                              F.col("severity").alias("root_cause_severity"), "root_causes"), "attr")
            .join(best, "attr", "left"))
