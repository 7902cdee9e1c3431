"""Quality rules: a threshold table compiled into one projection.

``RULES`` names a ratio, its bounds and the number of words from which the rule
applies. ``with_quality`` turns the table into column expressions; nothing here
needs a shuffle, a join or a user function, so a row costs the same whatever
its source and however many copies of it exist.

Defined results: a null or empty text has no words, so every count is 0,
``base_failed`` is true and ``kept`` false. Long texts are read whole. Repeated
rows get one result each; an empty table gives an empty result. Columns of the
input that share a name with a computed one are replaced by the computed one.

The stop-word rule speaks only where its words can be expected: texts labelled
with one of the languages of ``STOP_WORDS``, and unlabelled texts whose letters
are for the most part Latin. A text labelled with another language passes it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import aside, back
from .registry import read_table, register

WS = r"[\x20\x09-\x0D]+"
NOT_WS = r"[^\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Common function words of the four languages of the corpus.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "are", "as", "with", "an",
    "le", "la", "les", "de", "des", "et", "que", "qui", "dans", "pour", "un", "une", "en", "elle",
    "der", "die", "das", "und", "den", "von", "mit", "ist", "auf", "ein", "eine", "zu", "für", "sich",
    "el", "los", "las", "y", "por", "con", "para", "del", "se", "co", "es",
)
STOP_LANGS = ("en", "fr", "de", "es")


@dataclass(frozen=True)
class Rule:
    """``low <= ratio <= high`` must hold for texts of ``min_words`` words or more."""

    name: str
    ratio: str
    low: float | None
    high: float | None
    min_words: int = 0


RULES: tuple[Rule, ...] = (
    Rule("word_length", "mean_word_length", 1.5, 15.0),
    Rule("symbols", "symbol_ratio", None, 0.05),
    Rule("bangs", "bang_ratio", None, 0.20),
    Rule("stop_words", "stop_ratio", 0.01, None, 100),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.50, 20),
)


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside windows found twice or more, from window hashes in order.

    Sorting (hash, position) puts equal windows side by side; the positions of
    windows with an equal neighbour are then put in order and the lengths of
    their union summed.
    """
    def repeated(s: Column) -> Column:
        n = F.size(s)
        pos = F.sequence(F.lit(0), n - 1)

        def twin(i: Column) -> Column:
            h = F.get(s, i)["h"]
            return F.coalesce(F.get(s, i - 1)["h"] == h, F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == h, F.lit(False))
        return F.array_sort(F.transform(F.filter(pos, twin), lambda i: F.get(s, i)["p"]))
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    # one-element arrays bind the sorted pairs, so that they are computed once
    starts = F.get(F.transform(F.array(pairs), repeated), 0)
    acc0 = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(
        starts, acc0,
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"])
    has = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(has, covered).otherwise(0).cast("long")


def with_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds counts, ratios, ``base_failed``, ``failed_rules`` and ``kept``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_words", F.filter(F.split(text, WS), lambda w: w != ""))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    d = d.withColumn("_hash", F.when(
        F.col("n_words") >= WINDOW + 1,
        F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW),
                    lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)])))
        .otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_WS)))
    chars = F.length(F.concat_ws("", "_words")).cast("long")
    d = d.withColumns({
        "word_chars": chars,
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_bangs": (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long"),
        "n_stop": F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_words"), F.col("_hash")),
    })
    n = F.greatest(F.col("n_words"), F.lit(1))
    ratios = {
        "mean_word_length": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "bang_ratio": F.col("n_bangs") / F.greatest(F.col("word_chars"), F.lit(1)),
        "stop_ratio": F.col("n_stop") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }

    # 'en', 'en-US' and 'EN' are one language; no label, or 'und', says nothing
    lang = F.lower(F.regexp_extract(F.coalesce(F.col("lang").cast("string"), F.lit("")), r"^\s*([A-Za-z]*)", 1)) if "lang" in docs.columns else F.lit("")
    latin = F.length(F.regexp_replace(text, r"\P{IsLatin}", "")) * 2 >= F.length(F.regexp_replace(text, r"\P{L}", ""))
    speaks = lang.isin(*STOP_LANGS) | (lang.isin("", "und") & latin)

    def broken(r: Rule) -> Column:
        v, bad = ratios[r.ratio], F.lit(False)
        if r.low is not None:
            bad = bad | (v < r.low)
        if r.high is not None:
            bad = bad | (v > r.high)
        bad = bad & (F.col("n_words") >= r.min_words)
        return bad & speaks if r.ratio == "stop_ratio" else bad

    failed = F.filter(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    ok = reduce(lambda a, b: a & b, [~broken(r) for r in rules], F.lit(True))
    return (d.withColumns({"base_failed": base, "failed_rules": F.concat_ws(",", failed), "kept": ~base & ok})
             .drop("_words", "_hash", "_lines"))


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that are kept, with their own columns, whatever their names.

    The row number keeps the optimizer from moving the filter below the
    projection, where every use of a column would compute it anew.
    """
    d = with_quality(aside(docs, "doc_id", "text", "lang"), rules).withColumn("_n", F.monotonically_increasing_id())
    return back(d.filter(F.col("kept") & (F.col("_n") >= 0)), docs.columns)


def _oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    checks = {"mean_word_length": "word_chars / n", "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
              "bang_ratio": "n_bangs / greatest(word_chars, 1)", "stop_ratio": "n_stop / n",
              "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)"}
    bad = []
    for r in RULES:
        v = checks[r.ratio]
        parts = ([f"{v} < {r.low}"] if r.low is not None else []) + ([f"{v} > {r.high}"] if r.high is not None else [])
        bad.append(f"CASE WHEN ({' OR '.join(parts)}) AND n_words >= {r.min_words} THEN '{r.name}' END")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT k, p, array_to_string(list_slice(ws, p, p + 4), ' ') AS g
        FROM (SELECT k, ws, unnest(range(1, len(ws) - 3)) AS p FROM w)),
rep AS (SELECT k, p FROM win QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
cov AS (SELECT k, count(DISTINCT q) AS n FROM (SELECT k, unnest(range(p, p + 5)) AS q FROM rep) GROUP BY k),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bangs,
        len(list_filter(ws, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (k)),
r AS (SELECT *, greatest(n_words, 1) AS n,
        n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
f AS (SELECT *, concat_ws(',', {', '.join(bad)}) AS failed_rules FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM f"""


@register("op6_quality_rules", _oracle())
def op6_quality_rules(spark, sf_dir):
    return with_quality(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "failed_rules")
