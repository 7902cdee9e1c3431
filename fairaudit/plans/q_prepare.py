"""Queries for §2.2 (validation, profiling, labels) and §2.3 (preparation)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prepare as P
from ..operators import profile as PR
from ..sources.tables import doc_audit, line_features, order_audit, part_audit, table
from .registry import register
from .views_sql import with_views

# Candidate lists inside SQL (same fixed values as functions/labels.py)
_AUDIT_C = "['1', 'true', 'yes', 'y', 'hired', 'selected', 'positive']"
_PAIR_C = "['1', 'true', 'yes', 'y', 'hired', 'positive']"


def _pos_sql(cands: str, k="k", lo="lo", hi="hi") -> str:
    """DuckDB expression: positive label for text labels from (k, lo, hi)."""
    li = f"coalesce(list_position({cands}, lower(trim({lo}))), 0)"
    hi_ = f"coalesce(list_position({cands}, lower(trim({hi}))), 0)"
    return (f"CASE WHEN {k} <> 2 THEN NULL "
            f"WHEN {li} > 0 AND ({hi_} = 0 OR {li} <= {hi_}) THEN {lo} "
            f"WHEN {hi_} > 0 THEN {hi} "
            f"WHEN lower({lo}) > lower({hi}) THEN {lo} ELSE {hi} END")


# text targets derived from doc_audit, one labelling rule per language
_TEXT_TARGET_SPARK = None


def _text_target():
    y, n = F.col("y_true"), F.col("n_chars")
    return (F.when(F.col("lang") == "en", F.when(y == 1, "Hired").otherwise("rejected"))
             .when(F.col("lang") == "de", F.when(y == 1, "beta").otherwise("alpha"))
             .when(F.col("lang") == "fr", F.when(y == 1, " YES").otherwise("no"))
             .otherwise(F.when(n > 1000, "long").when(n > 100, "mid").otherwise("short")))


_TEXT_TARGET_SQL = """CASE lang WHEN 'en' THEN CASE WHEN y_true = 1 THEN 'Hired' ELSE 'rejected' END
  WHEN 'de' THEN CASE WHEN y_true = 1 THEN 'beta' ELSE 'alpha' END
  WHEN 'fr' THEN CASE WHEN y_true = 1 THEN ' YES' ELSE 'no' END
  ELSE CASE WHEN n_chars > 1000 THEN 'long' WHEN n_chars > 100 THEN 'mid' ELSE 'short' END END"""


# ------------------------------------------------------------------ §2.2
_LF_COLS = [("l_orderkey", "bigint"), ("l_linenumber", "int"), ("sens", "string"),
            ("qty", "double"), ("status", "string"), ("sens_nullable", "string"),
            ("proxy_qty", "double"), ("price", "double"), ("discount", "double"),
            ("tax", "double"), ("constant_f", "int"), ("y_true", "int")]


def _role(c):
    return "target" if c == "y_true" else ("sensitive" if c == "sens" else "feature")


@register("profile_table", with_views("\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {i} AS position, '{t}' AS dtype, '{_role(c)}' AS role, "
    f"CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count({c}) AS BIGINT) AS n_null, "
    f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM line_features"
    for i, (c, t) in enumerate(_LF_COLS)), "line_features"))
def q_profile_table(spark, d):
    lf = line_features(spark, d)
    PR.validate_schema(lf, ["qty", "price"], "y_true", ["sens"])
    return PR.profile_table(lf, target="y_true", sensitive=["sens"])


@register("infer_positive_label", with_views(f"""
, s AS (SELECT lang, count(DISTINCT t) AS k, min(t) AS lo, max(t) AS hi
        FROM (SELECT lang, {_TEXT_TARGET_SQL} AS t FROM doc_audit) WHERE t IS NOT NULL GROUP BY lang)
SELECT lang, {_pos_sql(_AUDIT_C)} AS pos_label, CAST(k AS BIGINT) AS n_labels FROM s""", "doc_audit"))
def q_infer_positive_label(spark, d):
    da = doc_audit(spark, d).withColumn("t", _text_target())
    return PR.positive_label(da, "t", slice_cols=["lang"])


@register("infer_positive_label_numeric", with_views("""
SELECT lang, 1 AS pos_label, CAST(count(DISTINCT y_true) AS BIGINT) AS n_labels
FROM doc_audit GROUP BY lang""", "doc_audit"))
def q_infer_positive_label_numeric(spark, d):
    return PR.positive_label(doc_audit(spark, d), "y_true", slice_cols=["lang"])


@register("infer_positive_label_pair", with_views(f"""
, x AS (SELECT lang, CASE WHEN y_true = 1 THEN 'Positive' ELSE 'negative' END AS t,
               CASE WHEN y_pred = 1 THEN 'Positive' ELSE (CASE WHEN lang = 'es' THEN 'unsure' ELSE 'negative' END) END AS p
        FROM doc_audit),
  s AS (SELECT lang, count(DISTINCT l) AS k, min(l) AS lo, max(l) AS hi
        FROM (SELECT lang, t AS l FROM x UNION ALL SELECT lang, p FROM x) GROUP BY lang)
SELECT lang, {_pos_sql(_PAIR_C)} AS pos_label, CAST(k AS BIGINT) AS n_labels FROM s""", "doc_audit"))
def q_infer_positive_label_pair(spark, d):
    da = doc_audit(spark, d)
    t = F.when(F.col("y_true") == 1, "Positive").otherwise("negative")
    p = (F.when(F.col("y_pred") == 1, "Positive")
          .otherwise(F.when(F.col("lang") == "es", "unsure").otherwise("negative")))
    return PR.positive_label_pair(da.select("lang", t.alias("t"), p.alias("p")), "t", "p",
                                  slice_cols=["lang"])


_OA_COLS = ["row_id", "region", "segment", "priority", "period", "score", "y_true", "y_pred",
            "y_pred_b", "o_totalprice", "c_acctbal", "n_regionkey"]


@register("sensitive_candidates", with_views("\n, c AS (\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {i} AS position, CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique "
    f"FROM order_audit" for i, c in enumerate(_OA_COLS) if c != "y_true")
    + ")\nSELECT * FROM c WHERE n_unique <= 20", "order_audit"))
def q_sensitive_candidates(spark, d):
    return PR.sensitive_candidates(order_audit(spark, d), "y_true")


@register("is_binary_target", with_views(f"""
SELECT lang, CAST(count(DISTINCT t) AS BIGINT) AS n_labels, count(DISTINCT t) = 2 AS is_binary
FROM (SELECT lang, {_TEXT_TARGET_SQL} AS t FROM doc_audit) GROUP BY lang""", "doc_audit"))
def q_is_binary_target(spark, d):
    da = doc_audit(spark, d).withColumn("t", _text_target())
    return PR.label_profile(da, "t", ["lang"]).select("lang", "n_labels", "is_binary")


@register("is_zero_one", with_views("""
SELECT lang, bool_and(y IN (0, 1)) AS is_zero_one, CAST(count(DISTINCT y) AS BIGINT) AS n_labels
FROM (SELECT lang, CASE WHEN lang = 'en' THEN y_true ELSE 2 * y_true - 1 END AS y FROM doc_audit)
GROUP BY lang""", "doc_audit"))
def q_is_zero_one(spark, d):
    da = doc_audit(spark, d)
    y = F.when(F.col("lang") == "en", F.col("y_true")).otherwise(2 * F.col("y_true") - 1)
    return PR.label_profile(da.withColumn("y", y), "y", ["lang"]).select("lang", "is_zero_one", "n_labels")


# ------------------------------------------------------------------ §2.3
@register("impute_numeric", with_views("""
SELECT l_orderkey, l_linenumber, coalesce(qty, (SELECT median(qty) FROM line_features)) AS qty,
       coalesce(price, (SELECT median(price) FROM line_features)) AS price
FROM line_features""", "line_features"))
def q_impute_numeric(spark, d):
    lf = line_features(spark, d).select("l_orderkey", "l_linenumber", "qty", "price")
    return P.impute(lf, numeric=["qty", "price"], categorical=[])


def _mode_sql(c):
    return (f"(SELECT {c} FROM line_features WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)")


@register("impute_categorical", with_views(f"""
SELECT l_orderkey, l_linenumber, coalesce(status, {_mode_sql('status')}) AS status,
       coalesce(sens_nullable, {_mode_sql('sens_nullable')}) AS sens_nullable
FROM line_features""", "line_features"))
def q_impute_categorical(spark, d):
    lf = line_features(spark, d).select("l_orderkey", "l_linenumber", "status", "sens_nullable")
    return P.impute(lf, numeric=[], categorical=["status", "sens_nullable"])


@register("one_hot", with_views("""
SELECT l_orderkey, l_linenumber,
       CAST(status = 'F' AS INT) AS status_F, CAST(status = 'O' AS INT) AS status_O,
       CAST(sens = 'A' AS INT) AS sens_A, CAST(sens = 'N' AS INT) AS sens_N, CAST(sens = 'R' AS INT) AS sens_R,
       qty
FROM line_features""", "line_features"))
def q_one_hot(spark, d):
    lf = line_features(spark, d).select("l_orderkey", "l_linenumber", "status", "sens", "qty")
    return P.one_hot(lf, ["status", "sens"])


@register("one_hot_wide", """
SELECT o_orderkey AS row_id, dense_rank() OVER (ORDER BY 'c' || o_custkey) - 1 AS slot FROM orders""")
def q_one_hot_wide(spark, d):
    """A value per customer: the slot that each order's sparse vector sets."""
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.concat(F.lit("c"), F.col("o_custkey")).alias("cust"))
    vector = F.col("cust_values").cast("string")  # (size,[slot],[1.0])
    return P.one_hot_sparse(orders, ["cust"]).select(
        "row_id", F.regexp_extract(vector, r"\[(\d+)\]", 1).cast("long").alias("slot"))


@register("encode_binary_target", with_views("""
SELECT row_id, CASE WHEN y_true = 1 THEN 1 ELSE 0 END AS y FROM doc_audit""", "doc_audit"))
def q_encode_binary_target(spark, d):
    da = doc_audit(spark, d)
    t = F.when(F.col("y_true") == 1, "Hired").otherwise("Rejected")
    return P.encode_binary_target(da.select("row_id", t.alias("y")), "y")


@register("binarize_pair", with_views("""
SELECT row_id, CAST(y_true = 1 AS INT) AS y_true, CAST(y_pred = 1 AS INT) AS y_pred FROM doc_audit""",
    "doc_audit"))
def q_binarize_pair(spark, d):
    da = doc_audit(spark, d)
    yn = lambda c: F.when(F.col(c) == 1, "Y").otherwise("N")
    return P.binarize_pair(da.select("row_id", yn("y_true").alias("y_true"),
                                     yn("y_pred").alias("y_pred")), "y_true", "y_pred")


@register("binary_outcome", with_views("""
SELECT row_id, CASE WHEN n_chars >= 50 AND y_true = 1 THEN 1 ELSE 0 END AS selected FROM doc_audit""",
    "doc_audit"))
def q_binary_outcome(spark, d):
    da = doc_audit(spark, d)
    t = (F.when(F.col("n_chars") < 50, F.lit(None))
          .when(F.col("y_true") == 1, "selected").otherwise("unselected"))
    return P.binary_outcome(da.select("row_id", t.alias("t")), "t").select("row_id", "selected")


@register("select_features", with_views("""
SELECT * EXCLUDE (y_true, region) FROM order_audit""", "order_audit"))
def q_select_features(spark, d):
    return P.select_features(order_audit(spark, d), "y_true", "region", include_sensitive=False)


_SPLIT_SQL = """
, cls AS (SELECT CAST(y_true AS VARCHAR) AS c, count(*) AS n FROM order_audit GROUP BY 1),
  tot AS (SELECT sum(n) AS n, CAST(ceil(0.2 * sum(n)) AS BIGINT) AS nt FROM cls),
  alloc AS (SELECT c, (cls.n * nt) // tot.n AS base, (cls.n * nt) % tot.n AS rem,
                   nt - sum((cls.n * nt) // tot.n) OVER () AS leftover FROM cls, tot),
  want AS (SELECT c, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, c) <= leftover THEN 1 ELSE 0 END AS w
           FROM alloc),
  ranked AS (SELECT o.*, row_number() OVER (PARTITION BY CAST(y_true AS VARCHAR)
                                            ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id) AS r
             FROM order_audit o)
"""


@register("split_stratified", with_views(_SPLIT_SQL + """
SELECT row_id, y_true, CASE WHEN r <= w THEN 'test' ELSE 'train' END AS split
FROM ranked JOIN want ON CAST(y_true AS VARCHAR) = want.c""", "order_audit"))
def q_split_stratified(spark, d):
    oa = order_audit(spark, d).select("row_id", "y_true")
    return P.split(oa, "row_id", "y_true", test_size=0.2, seed=42)


@register("preprocess", with_views("""
, cls AS (SELECT CAST(y_true AS VARCHAR) AS c, count(*) AS n FROM doc_audit GROUP BY 1),
  tot AS (SELECT sum(n) AS n, CAST(ceil(0.2 * sum(n)) AS BIGINT) AS nt FROM cls),
  alloc AS (SELECT c, (cls.n * nt) // tot.n AS base, (cls.n * nt) % tot.n AS rem,
                   nt - sum((cls.n * nt) // tot.n) OVER () AS leftover FROM cls, tot),
  want AS (SELECT c, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, c) <= leftover THEN 1 ELSE 0 END AS w
           FROM alloc),
  ranked AS (SELECT o.*, row_number() OVER (PARTITION BY CAST(y_true AS VARCHAR)
                                            ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id) AS r
             FROM doc_audit o)
SELECT row_id, n_chars, CAST(lang = 'de' AS INT) AS lang_de, CAST(lang = 'en' AS INT) AS lang_en,
       CAST(lang = 'es' AS INT) AS lang_es, CAST(lang = 'fr' AS INT) AS lang_fr,
       y_true AS y, lang AS sensitive, CASE WHEN r <= w THEN 'test' ELSE 'train' END AS split
FROM ranked JOIN want ON CAST(y_true AS VARCHAR) = want.c""", "doc_audit"))
def q_preprocess(spark, d):
    from ..plans.audit import prepare_dataset
    da = doc_audit(spark, d).select("row_id", "lang", "n_chars", "y_true")
    return prepare_dataset(da, target="y_true", sensitive="lang", key="row_id",
                           test_size=0.2, seed=42)


@register("preprocess_any_names", """
WITH o AS (SELECT o_orderkey AS row_id, CASE o_orderstatus WHEN 'F' THEN 'St. Louis' WHEN 'O' THEN 'St` Paul' ELSE o_orderstatus END AS city,
                  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d, o_totalprice, o_orderpriority FROM orders),
m AS (SELECT quantile_cont(date_diff('day', DATE '1970-01-01', d), 0.5) AS d FROM o)
SELECT row_id, CAST(city = 'P' AS INT) AS city_name_P, CAST(city = 'St. Louis' AS INT) AS "city_name_St_ Louis",
       CAST(city = 'St` Paul' AS INT) AS "city_name_St_ Paul", coalesce(date_diff('day', DATE '1970-01-01', o.d), m.d) AS ordered_at,
       o_totalprice AS y_2, CAST(o_totalprice > 150000 AS INT) AS y, o_orderpriority AS sensitive FROM o, m""")
def q_preprocess_any_names(spark, d):
    """Columns and values with dots and backticks, a feature called y, a date with missing values."""
    from ..plans.audit import prepare_dataset
    status = F.col("o_orderstatus")
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.when(status == "F", "St. Louis").when(status == "O", "St` Paul").otherwise(status).alias("city.name"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate").cast("date")).alias("ordered.at"),
        F.col("o_totalprice").alias("y"), (F.col("o_totalprice") > 150000).cast("int").alias("is.large"),
        F.col("o_orderpriority").alias("group"))
    return prepare_dataset(o, "is.large", "group", "row_id", include_sensitive=False).drop("split")


@register("ordinal_codes", with_views("""
, codes AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS code
            FROM (SELECT DISTINCT coalesce(sens_nullable, 'Unknown') AS v FROM line_features))
SELECT l_orderkey, l_linenumber, code AS sens_nullable, qty
FROM line_features JOIN codes ON coalesce(sens_nullable, 'Unknown') = v""", "line_features"))
def q_ordinal_codes(spark, d):
    lf = line_features(spark, d).select("l_orderkey", "l_linenumber", "sens_nullable", "qty")
    return P.ordinal_codes(lf, ["sens_nullable", "qty"])


@register("fill_group", with_views("""
SELECT coalesce(sens_nullable, 'Unknown') AS grp, CAST(count(*) AS BIGINT) AS n
FROM line_features GROUP BY 1""", "line_features"))
def q_fill_group(spark, d):
    from ..functions.exprs import fill_group
    lf = line_features(spark, d)
    return lf.groupBy(fill_group(F.col("sens_nullable")).alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@register("drop_sensitive_features", with_views("""
SELECT row_id, CAST(segment = 'AUTOMOBILE' AS INT) AS segment_AUTOMOBILE,
       CAST(segment = 'BUILDING' AS INT) AS segment_BUILDING, CAST(segment = 'FURNITURE' AS INT) AS segment_FURNITURE,
       CAST(segment = 'HOUSEHOLD' AS INT) AS segment_HOUSEHOLD, CAST(segment = 'MACHINERY' AS INT) AS segment_MACHINERY,
       y_true
FROM order_audit""", "order_audit"))
def q_drop_sensitive_features(spark, d):
    oa = order_audit(spark, d).select("row_id", "region", "segment", "y_true")
    enc = P.one_hot(oa, ["region", "segment"])
    return P.drop_sensitive_features(enc, "region", mode="wide")


@register("age_bins", with_views("""
SELECT CASE WHEN p_size + 11 > 20 AND p_size + 11 <= 27 THEN '21-27'
            WHEN p_size + 11 > 27 AND p_size + 11 <= 38 THEN '28-38'
            WHEN p_size + 11 > 38 AND p_size + 11 <= 50 THEN '39-50'
            WHEN p_size + 11 > 50 AND p_size + 11 <= 61 THEN '51+' END AS age_group,
       round(avg(y), 6) AS rate, CAST(count(*) AS BIGINT) AS n
FROM part_audit GROUP BY 1""", "part_audit"))
def q_age_bins(spark, d):
    p = part_audit(spark, d)
    return p.groupBy(P.age_bins(F.col("p_size") + 11).alias("age_group")).agg(
        F.round(F.avg("y"), 6).alias("rate"), F.count(F.lit(1)).alias("n"))


@register("preview", with_views("""
SELECT row_id, region, y_true, y_pred FROM order_audit ORDER BY row_id LIMIT 20""", "order_audit"))
def q_preview(spark, d):
    return P.preview(order_audit(spark, d).select("row_id", "region", "y_true", "y_pred"), "row_id")
