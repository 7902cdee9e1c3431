"""Preparation (§2.3): imputation, encoding, codes, split.

Column statistics (medians, modes, category lists) are computed by
distributed aggregates and come back as one small row per column; they are
applied as literals in a projection, so the rows are never joined or
shuffled to impute or encode.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import bin_column, fill_group, named
from ..functions.labels import NUMERIC, infer_positive, is_pos
from ..session import bounded_broadcast, materialize, scratch_path, staged
from .cube import as_list
from .ranking import dense_index, exact_medians

MAX_ONE_HOT = 1_000  # wider encodings go to the sparse-vector path (one_hot_sparse)
MAX_LITERAL_CODES = 10_000  # ordinal codes by literal map up to this many values, else a join

# Prefixes dropped by the "wide" feature-removal mode.
WIDE_PREFIXES = ["gender_", "sex_", "race_", "age_", "ethnicity_"]

# Age bins, right-closed, with their labels.
AGE_EDGES = [20, 27, 38, 50, 61]
AGE_LABELS = ["21-27", "28-38", "39-50", "51+"]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> null once, at load (Spark aggregates treat NaN as a value)."""
    out = []
    for f in df.schema.fields:
        c = named(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def column_modes(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """Most frequent non-null value per column, smallest on ties.

    Two distributed aggregates: (column, value) counts, then the best value
    per column with ``min_by`` on (-count, value). No per-column job and no
    single-task value map.
    """
    if not cols:
        return {}
    counts = _value_rows(df, cols).groupBy("col", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("col").agg(
        F.min_by("v", F.struct((-F.col("n")).alias("nn"), F.col("v").alias("vv"))).alias("mode"))
    found = {r["col"]: r["mode"] for r in best.collect()}  # one row per column
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    out = {}
    for c in cols:
        v = found.get(c)
        if v is not None and isinstance(types[c], T.BooleanType):
            v = v == "true"
        out[c] = v
    return out


def modes_and_values(df: DataFrame, cols: list[str], max_values: int = MAX_ONE_HOT):
    """Mode (smallest on ties) and sorted distinct values of each column:
    ({col: mode}, {col: values, or None when more than ``max_values``})."""
    if not cols:
        return {}, {}
    modes = column_modes(df, cols)
    vals = category_values(df, cols, max_values, on_overflow="skip")
    return modes, {c: vals.get(c) for c in cols}


def impute_stats(df: DataFrame, numeric=None, categorical=None) -> dict[str, object]:
    """Fill values: exact median (0 if none) and mode ("missing" if none)."""
    df = nan_to_null(df)
    numeric = numeric_columns(df) if numeric is None else list(numeric)
    categorical = categorical_columns(df) if categorical is None else list(categorical)
    stats: dict[str, object] = {}
    for c, m in exact_medians(df, numeric).items():
        stats[c] = 0 if m is None else m
    for c, m in column_modes(df, categorical).items():
        stats[c] = "missing" if m is None else m
    return stats


def apply_fill(df: DataFrame, stats: dict[str, object]) -> DataFrame:
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    out = []
    for c in df.columns:
        if c in stats:
            dt = types[c]
            v = stats[c]
            if isinstance(dt, T.BooleanType) and v == "missing":
                lit = F.lit("missing")
                out.append(F.coalesce(named(c).cast("string"), lit).alias(c))
                continue
            if isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)) and \
                    isinstance(v, float) and not float(v).is_integer():
                out.append(F.coalesce(named(c).cast("double"), F.lit(v)).alias(c))
                continue
            out.append(F.coalesce(named(c), F.lit(v).cast(dt)).alias(c))
        else:
            out.append(named(c))
    return df.select(*out)


def impute(df: DataFrame, numeric=None, categorical=None, fit_on: DataFrame | None = None) -> DataFrame:
    """Median / mode imputation; statistics from ``fit_on`` (default: df)."""
    df = nan_to_null(df)
    base = nan_to_null(fit_on) if fit_on is not None else df
    return apply_fill(df, impute_stats(base, numeric, categorical))


def _bounded_columns(df: DataFrame, cols: list[str], max_values: int) -> list[str]:
    """Columns whose distinct count may be within ``max_values`` (one sketch
    pass; the 1.5x margin is far beyond the sketch's error)."""
    a = df.agg(*[F.approx_count_distinct(named(c), 0.01).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if a[f"a{i}"] <= max_values * 1.5 + 10]


def _value_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, v): the non-null values of some columns as text, in one scan."""
    cells = F.array(*[F.struct(F.lit(c).alias("col"), named(c).cast("string").alias("v")) for c in cols])
    return df.select(F.explode(cells).alias("x")).select("x.col", "x.v").where("v IS NOT NULL")


def category_values(df: DataFrame, cols: list[str], max_values: int = MAX_ONE_HOT,
                    on_overflow: str = "raise") -> dict[str, list]:
    """Sorted distinct non-null values per column (bounded by ``max_values``).

    A sketch pass rules out columns with far more values; the others'
    distinct values (a bounded set) are collected in one job and checked
    exactly. A column with more values raises, or with ``on_overflow='skip'``
    is left out of the result. No column's values are ever sorted in one
    task."""
    if not cols:
        return {}
    ok = _bounded_columns(df, cols, max_values)
    out: dict[str, list] = {c: [] for c in ok}
    if ok:
        for r in _value_rows(df, ok).distinct().collect():  # bounded by the sketch check
            out[r["col"]].append(r["v"])
    over = [c for c in cols if c not in ok] + [c for c in ok if len(out[c]) > max_values]
    for c in over:
        out.pop(c, None)
        if on_overflow != "skip":
            raise ValueError(f"column {c!r} has more than {max_values} categories; "
                             "use the sparse vector encoding (one_hot_vector)")
    for c in out:
        out[c].sort()
    return out


def one_hot(df: DataFrame, cols=None, values: dict[str, list] | None = None) -> DataFrame:
    """``{col}_{value}`` 0/1 columns for text/boolean columns, none dropped,
    values in sorted order; other columns pass through in place."""
    cols = categorical_columns(df) if cols is None else as_list(cols)
    values = values or category_values(df, cols)
    out = []
    for c in df.columns:
        if c in cols:
            for v in values[c]:
                out.append((named(c).cast("string") == F.lit(v)).cast("int").alias(f"{c}_{v}"))
        else:
            out.append(named(c))
    return df.select(*out)


def one_hot_vector(df: DataFrame, cols, output: str = "features_cat"):
    """Sparse-vector encoding for training: StringIndexer (alphabetical) +
    OneHotEncoder(dropLast=False). Returns (fitted PipelineModel, names)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    cols = as_list(cols)
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", stringOrderType="alphabetAsc",
                         handleInvalid="keep") for c in cols]
    enc = OneHotEncoder(inputCols=[f"{c}__idx" for c in cols],
                        outputCols=[f"{c}__vec" for c in cols], dropLast=False)
    model = Pipeline(stages=idx + [enc]).fit(df)
    names = []
    for c, m in zip(cols, model.stages[:len(cols)]):
        names += [f"{c}_{v}" for v in m.labels]
    return model, names


def plain_name(name: str, taken: set[str]) -> str:
    """A column name without dots and backticks, which mean something in
    expressions, that is not taken yet whatever the case of its letters."""
    base = re.sub(r"[.`]", "_", name) or "_"
    out, i = base, 1
    while out.lower() in taken:
        i += 1
        out = f"{base}_{i}"
    taken.add(out.lower())
    return out


SPREAD = 1024        # tasks' worth of keys among which missing values are dealt in a join


def one_hot_sparse(df: DataFrame, cols) -> DataFrame:
    """Each column replaced in place by its sparse vector ``{col}_values``, for
    any number of values: slot i stands for the i-th value in sorted order, the
    last slot for null. The values are numbered by a distributed sort and joined
    back, so no task and not the driver ever holds all of them; missing values
    are dealt over many keys of that join. The vectors are written as their
    stored form (kind, size, indices, values) and read back as vectors, all in
    the JVM."""
    from pyspark.ml.linalg import VectorUDT
    cols = as_list(cols)
    enc, sizes = df.withColumn("_sparse_row", F.monotonically_increasing_id()), {}
    stored = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"
    for i, c in enumerate(cols):
        value, slot, key = f"_sparse_value_{i}", f"_sparse_slot_{i}", f"_sparse_key_{i}"
        text = named(c).cast("string")
        distinct = df.select(text.alias(value)).where(F.col(value).isNotNull()).distinct()
        codes = staged(dense_index(distinct, value, slot), "one-hot-codes")
        n = codes.count()
        codes = codes.select(F.concat(F.lit("v"), F.col(value)).alias(key), slot)
        spread = F.concat(F.lit("n"), F.pmod(F.col("_sparse_row"), F.lit(SPREAD)).cast("string"))
        at = F.coalesce(F.col(slot), F.lit(n)).cast("int")
        vector = F.struct(F.lit(0).cast("tinyint"), F.lit(n + 1), F.array(at), F.array(F.lit(1.0))).cast(stored)
        enc = (enc.withColumn(key, F.coalesce(F.concat(F.lit("v"), text), spread)).join(codes, key, "left")
                  .withColumn(f"_sparse_{i}", vector).drop(key, slot))
        sizes[c] = {"ml_attr": {"num_attrs": n + 1}}          # models need the size, not the names
    order = {c: i for i, c in enumerate(cols)}
    out = enc.select(*[F.col(f"_sparse_{order[c]}").alias(f"{c}_values") if c in order else named(c) for c in df.columns])
    path = scratch_path(df.sparkSession, "one-hot-vectors")
    out.write.parquet(path)
    schema = T.StructType([T.StructField(f"{c}_values", VectorUDT(), True, sizes[c]) if c in order else df.schema[c] for c in df.columns])
    return df.sparkSession.read.schema(schema).parquet(path)


def encode_binary_target(df: DataFrame, target: str, out: str | None = None) -> DataFrame:
    """Two labels -> 0/1 (positive by the preprocessing rules); otherwise the
    column is returned unchanged. One aggregate decides."""
    from ..functions.labels import PREPROCESS_CANDIDATES, positive_label_expr
    out = out or target
    y = F.col(target)
    dt = df.schema[target].dataType
    k, lo, hi = F.count_distinct(y), F.min(y), F.max(y)
    r = df.agg(k.alias("k"), positive_label_expr(k, lo, hi, dt, PREPROCESS_CANDIDATES, True, True)
               .alias("pos")).first()
    if r["k"] != 2:
        return df.withColumn(out, y) if out != target else df
    return df.withColumn(out, is_pos(y, F.lit(r["pos"])))


def binarize_pair(df: DataFrame, y_true: str, y_pred: str, pos_label=None) -> DataFrame:
    """y_true, y_pred -> 1 when equal to the (pair-inferred) positive label."""
    if pos_label is None:
        labels = (df.select(F.col(y_true).alias("label"))
                  .unionByName(df.select(F.col(y_pred).alias("label")))
                  .where(F.col("label").isNotNull()))
        pos_df = infer_positive(labels, [], "label", "pair")
        pos_label = pos_df.first()["pos_label"]
    p = F.lit(pos_label)
    return df.withColumn(y_true, is_pos(F.col(y_true), p)).withColumn(y_pred, is_pos(F.col(y_pred), p))


def binary_outcome(df: DataFrame, target: str, pos_label=None, out: str = "selected") -> DataFrame:
    """(target == positive) as 0/1; null target -> 0."""
    if pos_label is None:
        labels = df.select(F.col(target).alias("label")).where(F.col("label").isNotNull())
        pos_label = infer_positive(labels, [], "label", "audit").first()["pos_label"]
    return df.withColumn(out, is_pos(F.col(target), F.lit(pos_label)))


def select_features(df: DataFrame, target: str, sensitive: str | None = None,
                    include_sensitive: bool = True, exclude=()) -> DataFrame:
    drop = {target, *as_list(exclude)}
    if not include_sensitive and sensitive:
        drop.add(sensitive)
    return df.select(*[c for c in df.columns if c not in drop])


def drop_sensitive_features(df: DataFrame, sensitive: str | None, mode: str = "strict",
                            keep=()) -> DataFrame:
    """Drop the sensitive column and ``{sensitive}_*``; ``wide`` also drops
    the fixed demographic prefixes. Columns in ``keep`` always stay."""
    keep = set(as_list(keep))

    def dropped(c: str) -> bool:
        if c in keep:
            return False
        if sensitive is not None and (c == sensitive or c.startswith(f"{sensitive}_")):
            return True
        return mode == "wide" and any(c.startswith(p) for p in WIDE_PREFIXES)
    return df.select(*[c for c in df.columns if not dropped(c)])


def ordinal_codes(df: DataFrame, cols, unknown: str = "Unknown") -> DataFrame:
    """Text column -> 0-based index of its (null -> ``unknown``) value among
    the sorted distinct values; numeric columns pass through.

    Up to ``MAX_LITERAL_CODES`` values the sorted value list (one bounded
    distinct job for all columns) becomes a literal map; beyond that the
    distinct values get a dense index by a range-partitioned sort and the
    code table is joined back with a size-checked broadcast.
    """
    text = [c for c in as_list(cols) if not isinstance(df.schema[c].dataType, NUMERIC)]
    if not text:
        return df
    filled = df.select(*[fill_group(named(c), unknown).alias(c) for c in text])
    small = category_values(filled, text, MAX_LITERAL_CODES, on_overflow="skip")
    out = df
    for c in text:
        v = fill_group(named(c), unknown)
        if c in small:
            # few values: a literal value -> code map, no join
            m = F.create_map(*[x for i, val in enumerate(small[c]) for x in (F.lit(val), F.lit(float(i)))])
            out = out.withColumn(c, m[v])
            continue
        vals = out.select(v.alias("_v")).distinct()
        codes, _ = bounded_broadcast(dense_index(vals, "_v", "_code"))
        out = (out.withColumn("_v", v).join(codes, "_v", "left")
               .withColumn(c, F.col("_code").cast("double")).drop("_v", "_code"))
    return out


def age_bins(c: Column) -> Column:
    return bin_column(c, AGE_EDGES, AGE_LABELS)


def preview(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """First n rows in key order (an order makes it repeatable)."""
    return df.orderBy(key).limit(n)


# --------------------------------------------------------------------------
# split
# --------------------------------------------------------------------------

def hash_order(key: Column, seed: int) -> Column:
    """Engine-independent uniform order: md5 of 'seed:key' as hex text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def split_counts(class_counts: list[tuple], n_test: int) -> dict:
    """Test rows per class: ``n_test`` allocated by largest remainder (ties by
    class value)."""
    n = sum(c for _, c in class_counts)
    base = {k: (c * n_test) // n for k, c in class_counts}
    rem = sorted(class_counts, key=lambda kc: (-((kc[1] * n_test) % n), str(kc[0])))
    left = n_test - sum(base.values())
    for k, _ in rem[:left]:
        base[k] += 1
    return base


def stratify_ok(classes: int, least: int | None, test_size: float) -> bool:
    """At least two classes, each with a test row of its own."""
    return classes > 1 and least >= 2 and int(least * test_size) >= 1


CUT_PREFIX = 4        # hex digits by which a pass narrows the place of a cut
CUT_ROWS = 50_000     # rows of a class that are numbered to find its cut
CLASSES_MAX = 100_000  # classes whose shares are settled on the driver


def _class_prefixes(rows: DataFrame, length: int) -> DataFrame:
    return rows.groupBy("_cls", F.substring("_h", 1, length).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))


def _boundary(hist: DataFrame, want: DataFrame) -> DataFrame:
    """(_cls, _p, _n, _take): the prefix that holds a class's ``_want``-th hash and
    how many of its rows are still wanted (all of a class that has fewer)."""
    from pyspark.sql import Window
    w = Window.partitionBy("_cls").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("_cls")
    cum = hist.where("_p IS NOT NULL").select("_cls", "_p", "_n", F.sum("_n").over(w).alias("_upto"), F.sum("_n").over(every).alias("_all"))
    wv = want.select(F.col("_cls").alias("_wc"), "_want")
    j = cum.join(wv, cum["_cls"].eqNullSafe(wv["_wc"])).withColumn("_want", F.least("_want", "_all"))
    before = F.col("_upto") - F.col("_n")
    return (j.where((before < F.col("_want")) & (F.col("_want") <= F.col("_upto")))
             .select("_cls", "_p", "_n", (F.col("_want") - before).alias("_take")))


def hash_cuts(rows: DataFrame, want: DataFrame, hist: DataFrame | None = None) -> DataFrame:
    """(_cls, _cut): the ``_want``-th smallest hash of each class, so that the
    first rows of a class in hash order are those with ``_h <= _cut``.

    ``rows`` holds ``_cls, _h`` (hex text), ``want`` a row per class. Counts per hash prefix say
    which prefix holds the cut; while it has over ``CUT_ROWS`` rows, a further
    pass counts longer prefixes of those rows only. What is left is numbered per
    class. No class is ever sorted whole, and a class without a row has no cut.
    """
    from pyspark.sql import Window
    length = CUT_PREFIX
    at = materialize(_boundary(_class_prefixes(rows, length) if hist is None else hist, want))

    def inside(edge: DataFrame) -> DataFrame:
        e, _ = bounded_broadcast(edge.select(F.col("_cls").alias("_ec"), F.col("_p").alias("_ep"), "_take"))
        return rows.join(e, rows["_cls"].eqNullSafe(e["_ec"]) & F.col("_h").startswith(F.col("_ep")))
    while length < 32:
        most = at.where("_take < _n").agg(F.max("_n")).first()[0]
        if most is None or most <= CUT_ROWS:
            break
        length += CUT_PREFIX
        todo = at.select("_cls", F.col("_take").alias("_want"))
        at = materialize(_boundary(_class_prefixes(inside(at).select("_cls", "_h"), length), todo))
    whole = (F.col("_take") == F.col("_n")) | F.lit(length == 32)       # rows of one key share their hash
    cuts = at.where(whole).select("_cls", F.rpad("_p", 32, "f").alias("_cut"))
    wr = Window.partitionBy("_cls").orderBy("_h")
    ranked = (inside(at.where(~whole)).withColumn("_r", F.row_number().over(wr))
              .where(F.col("_r") == F.col("_take")).select("_cls", F.col("_h").alias("_cut")))
    return materialize(cuts.unionByName(ranked))


def split(df: DataFrame, key: str, target: str, test_size: float = 0.2, seed: int = 42,
          stratify: bool = True, out: str = "split") -> DataFrame:
    """Exact, repeatable train/test split (``split`` = 'train' | 'test').

    Rows are ordered by ``md5(seed:key)``; per class the first ``test_c`` rows
    in that order are test, with ``n_test = ceil(test_size * n)`` allocated to
    classes by largest remainder when stratified. The result is one scan of the
    input with a comparison of hashes. Rows that share a key fall on the same
    side; rows without a key are train.
    """
    rows = df.select(F.col(target).cast("string").alias("_cls"), hash_order(F.col(key), seed).alias("_h"))
    hist = materialize(_class_prefixes(rows, CUT_PREFIX))
    per = hist.groupBy("_cls").agg(F.sum("_n").alias("_c"))
    classes, least, n = per.agg(F.count(F.lit(1)), F.min("_c"), F.sum("_c")).first()
    n_test = math.ceil(test_size * (n or 0))
    strat = stratify and stratify_ok(classes, least, test_size)
    h = hash_order(F.col(key), seed)
    if not strat:
        spark = df.sparkSession
        want = spark.createDataFrame([(None, n_test)], "_cls string, _want long")
        none = F.lit(None).cast("string")
        whole = hist.groupBy("_p").agg(F.sum("_n").alias("_n")).select(none.alias("_cls"), "_p", "_n")
        cut = hash_cuts(rows.select(none.alias("_cls"), "_h"), want, whole).first()
        test = h <= F.lit(cut["_cut"]) if cut else F.lit(False)
        return df.withColumn(out, F.when(test, "test").otherwise("train"))
    cuts, _ = bounded_broadcast(hash_cuts(rows, class_shares(per, classes, n, n_test), hist).select(F.col("_cls").alias("_cut_of"), "_cut"))
    j = df.join(cuts, F.col(target).cast("string").eqNullSafe(cuts["_cut_of"]), "left")
    return j.withColumn(out, F.when(h <= F.col("_cut"), "test").otherwise("train")).drop("_cut_of", "_cut")


def class_shares(per: DataFrame, classes: int, n: int, n_test: int) -> DataFrame:
    """(_cls, _want): ``n_test`` dealt to classes by largest remainder (ties by class)."""
    if classes <= CLASSES_MAX:
        counts = [(r["_cls"], r["_c"]) for r in per.collect()]
        return per.sparkSession.createDataFrame(list(split_counts(counts, n_test).items()), "_cls string, _want long")
    share = F.col("_c").cast("decimal(19,0)") * F.lit(n_test).cast("decimal(19,0)")
    exact = per.select("_cls", share.alias("_s"))
    total = F.lit(n).cast("decimal(19,0)")
    base = exact.select("_cls", F.floor((F.col("_s") - F.col("_s") % total) / total).cast("long").alias("_base"),
                        (F.col("_s") % total).alias("_rest"))
    left = n_test - (base.agg(F.sum("_base")).first()[0] or 0)
    ranked = dense_index(base.withColumn("_o", F.struct((-F.col("_rest")).alias("r"), "_cls")), "_o", "_i")
    return ranked.select("_cls", (F.col("_base") + (F.col("_i") < left).cast("long")).alias("_want"))
