"""Documents to packed sequences, in five stages.

Each stage reads what the one before has written: quality rules, near-duplicate
removal, surrogates for personal data, mixing of sources, packing. All but the
last return the columns of ``documents``.

The near-duplicate and packing stages cannot be written in SQL, so ``ORACLE_SQL``
is None; the tests compare ``run`` with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairaudit.llm import mixing, near_dedup, packing, pii, quality
from fairaudit.llm.columns import ROW, aside, back
from fairaudit.llm.registry import read_table, register
from fairaudit.llm.tokens import vocabulary_path
from fairaudit.session import staged

ORACLE_SQL = None


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the quality rules."""
    return quality.passing(docs)


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return near_dedup.deduplicate(docs)


def pii_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; ``n_chars`` follows the new text."""
    out = pii.replace_pii(aside(docs, "doc_id", "text"))
    changed = F.col("n_entities") > 0
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("text").cast("long")).otherwise(F.col(ROW).getField("n_chars"))
    return back(out, docs.columns, **new)


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by source to the target mixture, in a global random order."""
    return back(mixing.mix(aside(docs, "doc_id", "source"), mixing.source_rates(docs)), docs.columns)


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mixture into sequences; one row per piece."""
    return packing.pack(docs, vocabulary_path())


STAGES = [("quality", quality_stage), ("near_dedup", dedup_stage), ("pii", pii_stage), ("mix", mix_stage), ("pack", pack_stage)]


@register("pipeline", ORACLE_SQL)
def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
