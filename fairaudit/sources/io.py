"""Sources and sinks (§2.1): CSV with missing-value sentinels, JSON and CSV
reports, datasets, and model persistence.

Reading never goes through the driver: sentinels become nulls and types
are decided by one distributed aggregate when no schema is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import named

# Text treated as missing when reading CSV (pandas' defaults).
NA_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


EMPTY = "Dataset is empty. Provide a non-empty dataset."


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             na_values=NA_VALUES, multi_line: bool = False) -> DataFrame:
    """CSV with a header. Sentinel text -> null, NaN -> null; with no schema,
    each column becomes bigint, double, boolean or string, whichever every
    non-null value parses as (one aggregate pass, which also counts the rows).
    Empty input is an error.

    A file is read by many tasks. ``multi_line`` allows line breaks inside quoted
    values; such a file cannot be cut and is read by one task."""
    raw = (spark.read.option("header", True).option("inferSchema", False)
           .option("escape", '"').option("multiLine", multi_line)
           .option("nullValue", "\u0000__never__").option("emptyValue", "").csv(path))
    na = F.array(*[F.lit(v) for v in na_values])
    clean = raw.select(*[F.when(F.array_contains(na, named(c)), F.lit(None).cast("string"))
                          .otherwise(named(c)).alias(c) for c in raw.columns])
    if schema is not None:
        if clean.isEmpty():
            raise ValueError(EMPTY)
        st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        out = clean.select(*[named(f.name).cast(f.dataType).alias(f.name) for f in st.fields])
    else:
        checks = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(clean.columns):
            v = named(c)
            checks += [F.bool_and(v.isNull() | v.try_cast("bigint").isNotNull()).alias(f"l{i}"),
                       F.bool_and(v.isNull() | v.try_cast("double").isNotNull()).alias(f"d{i}"),
                       F.bool_and(v.isNull() | F.lower(v).isin("true", "false")).alias(f"b{i}")]
        r = clean.agg(*checks).first()
        if not r["n"]:
            raise ValueError(EMPTY)
        cols = []
        for i, c in enumerate(clean.columns):
            if r[f"l{i}"]:
                cols.append(named(c).cast("bigint").alias(c))
            elif r[f"d{i}"]:
                cols.append(named(c).cast("double").alias(c))
            elif r[f"b{i}"]:
                cols.append((F.lower(named(c)) == "true").alias(c))
            else:
                cols.append(named(c))
        out = clean.select(*cols)
    return out.select(*[F.nanvl(named(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
                        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else named(f.name)
                        for f in out.schema.fields])


def write_dataset(df: DataFrame, path: str, null_value: str = "") -> None:
    """CSV with a header (Spark creates the folders)."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", null_value).csv(path)


def write_report_json(df: DataFrame, path: str) -> None:
    """One JSON object per audit row."""
    df.write.mode("overwrite").json(path)


def read_report_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_metric_table(df: DataFrame, path: str) -> None:
    """Long metric table (model, kind, metric, value) as CSV partitioned by
    model and kind -- one folder per (model, kind)."""
    df.write.mode("overwrite").partitionBy("model", "kind").option("header", True).csv(path)


def read_metric_table(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("header", True).schema("metric string, value double, model string, kind string")
            .csv(path))
