"""Licence scans: TF-IDF cosine to templates and inheritance along directories.

1. Sentences and lines that speak of a licence, and whole licence files (by
   name), become segments of terms. Equal segments are merged before anything
   else, so a line that stands in a third of all files is compared once.
2. Terms are weighted by frequency and inverse document frequency over all
   segments; the cosine to each template is a join on terms. The templates are a
   fixed table of this module, which is broadcast.
3. Whole texts (files by name, and others that speak of a licence) are compared
   with the full texts of ``licence_texts``; blocks of adjacent lines that speak of
   a licence with the standard notices. Here a term counts 1 + ln(tf), and its idf
   is that of the texts and notices, so a text's result does not hang on the rest.
4. A file takes its best licence: one whose content is a licence text that text's,
   others that of their best line, or else of their best block. Files without one
   inherit from the licence
   file in the nearest ancestor directory: each distinct directory is expanded to
   its ancestors (their number is its depth) and joined to the directories that
   hold a licence file.

Only texts that speak of a licence enter a shuffle, as terms. A licence text under
another name is found (method ``file``) but nothing inherits from it. Everything is DataFrame code.

Defined results: a null or empty text has no licence of its own; a file with a
null path inherits nothing. Ties go to the first licence by name. Repeated rows
get one result each; an empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .registry import read_table, register

THRESHOLD = 0.6

# Header statements and first sentences of well-known licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Creative Commons license"),
    ("Proprietary", "Copyright All rights reserved No license is granted"),
)
# Standard notices; a notice also stands in its first paragraph alone. Short full texts are notices as well.
_GNU = """This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published
by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""
NOTICES = (
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("GPL-2.0", _GNU.format(what="program", name="General Public License", version="2")),
    ("GPL-3.0", _GNU.format(what="program", name="General Public License", version="3")),
    ("LGPL-2.1", _GNU.format(what="library", name="Lesser General Public License", version="2.1")),
    ("LGPL-3.0", _GNU.format(what="library", name="Lesser General Public License", version="3")),
    ("AGPL-3.0", _GNU.format(what="program", name="Affero General Public License", version="3")),
)
SHORT = ("BSD-2-Clause", "BSD-3-Clause", "MIT")
TEXT_THRESHOLD = 0.8         # of a whole text to a full text
MARK = r"(?i)licen[cs]e|copyright|spdx|creative commons|cc[ -]by|cc0|public domain"
BREAK = r"[.!?]+[ \t\n\f\r]"
TERM = r"[\p{L}\p{N}]+(?:[.]\p{N}+)*"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.\-_][^/]*)?$"


def _terms(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit(TERM), F.lit(0))


def _weighted(segments: DataFrame, idf: DataFrame) -> DataFrame:
    t = segments.select("seg", F.explode("seg").alias("term")).groupBy("seg", "term").agg(F.count(F.lit(1)).alias("tf"))
    return t.join(idf, "term").select("seg", "term", (F.col("tf") * F.col("idf")).alias("w"))


def licences_of_segments(segments: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Best licence of each distinct segment: ``seg, licence, cosine``.

    ``segments`` holds ``seg`` (array of terms) and ``n`` (how often it occurs).
    """
    spark = segments.sparkSession
    templates = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(TEMPLATES)], "t int, licence string, text string")
    templates = templates.withColumn("seg", _terms(F.col("text"))).select("t", "licence", "seg")
    both = segments.select("seg", "n").union(templates.select("seg", F.lit(1).cast("long")))
    total = both.agg(F.sum("n").alias("n")).first()["n"]
    df = both.select("n", F.explode(F.array_distinct("seg")).alias("term")).groupBy("term").agg(F.sum("n").alias("df"))
    idf = staged(df.select("term", (F.log((1 + F.lit(float(total))) / (1 + F.col("df"))) + 1).alias("idf")), "licence-idf")
    mine = staged(_weighted(segments, idf), "licence-weights")
    norm = mine.groupBy("seg").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    tw = _weighted(templates, idf).join(templates.select("t", "licence", "seg"), "seg").select("t", "licence", "term", F.col("w").alias("tw"))
    tn = tw.groupBy("t").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    tw = F.broadcast(tw.join(tn, "t").select("t", "licence", "term", (F.col("tw") / F.col("tnorm")).alias("tw")))
    dot = mine.join(tw, "term").groupBy("seg", "t", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    cos = dot.join(norm, "seg").select("seg", "licence", F.round(F.col("dot") / F.col("norm"), 4).alias("cosine"))
    best = cos.filter(F.col("cosine") >= threshold).groupBy("seg").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"))
    return best.select("seg", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))


@cache
def _standards() -> tuple[tuple[str, str, str], ...]:
    """``kind, licence, text`` of the full texts and notices (driver only)."""
    texts = [(f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    notices = [(k, t) for k, t in (*NOTICES, *(x for x in texts if x[0] in SHORT))]
    # of a full text kept as a notice, the body without its title and owner
    first = [(k, t.split("\n\n")[0]) for k, t in NOTICES] + [("MIT", t.split("\n\n")[2]) for k, t in texts if k == "MIT"]
    return tuple(("text", k, t) for k, t in texts) + tuple(("notice", k, t) for k, t in dict.fromkeys(notices + first))


def licences_of_texts(pieces: DataFrame) -> DataFrame:
    """Cosine of distinct pieces ``key, seg`` to every full text and notice that
    shares a term with them: ``key, kind, licence, cosine``."""
    spark = pieces.sparkSession
    known = spark.createDataFrame([(i, *x) for i, x in enumerate(_standards())], "t int, kind string, licence string, text string")
    size = float(len(_standards()))
    terms = known.select("t", "kind", "licence", F.explode(_terms(F.col("text"))).alias("term"))
    weight = 1 + F.log(F.col("tf").cast("double"))
    tf = terms.groupBy("t", "kind", "licence", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = tf.groupBy("term").agg((F.log((1 + F.lit(size)) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    tw = tf.join(idf, "term").withColumn("tw", weight * F.col("idf"))
    norm = tw.groupBy("t").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    tw = staged(tw.join(norm, "t").select("t", "kind", "licence", "term", "idf", (F.col("tw") / F.col("tnorm")).alias("tw")), "licence-texts")
    known_idf = F.broadcast(tw.select("term", "idf").distinct())          # bounded: terms of the fixed texts
    mine = pieces.select("key", F.explode("seg").alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    unknown = F.log(F.lit(1 + size)) + 1
    mine = staged(mine.join(known_idf, "term", "left").select("key", "term", (weight * F.coalesce("idf", unknown)).alias("w")), "licence-text-weights")
    own = mine.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = mine.join(F.broadcast(tw), "term").groupBy("key", "t", "kind", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    return dot.join(own, "key").select("key", "kind", "licence", F.round(F.col("dot") / F.col("norm"), 4).alias("cosine"))


def _of_texts(spoken: DataFrame, named: Column, threshold: float) -> DataFrame:
    """``file_id, path, rank, licence, c`` (rank 0: the content is a licence text,
    2: one of its blocks is a notice; c is minus the cosine)."""
    blocks = F.filter(F.split("text", r"\n[ \t\r]*\n"), lambda p: p.rlike(MARK))
    every = F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("part"))),
                     F.transform(F.when(named, F.array().cast("array<string>")).otherwise(blocks), lambda p: F.struct(F.lit(False).alias("whole"), p.alias("part"))))
    parts = spoken.filter("text IS NOT NULL").select("file_id", "path", named.alias("named"), F.explode(every).alias("x")).select("file_id", "path", "named", "x.whole", _terms(F.col("x.part")).alias("seg"))
    parts = staged(parts.withColumn("key", F.sha2(F.concat_ws(" ", "seg"), 256)), "licence-parts")
    pieces = parts.groupBy("key").agg(F.first("seg").alias("seg"))        # the same for all rows of a key
    best = staged(licences_of_texts(pieces).filter(F.col("cosine") >= threshold), "licence-best-texts")
    j = parts.select("file_id", "path", "named", "whole", "key").join(best, "key")
    full = F.col("whole") & (F.col("named") | ((F.col("kind") == "text") & (F.col("cosine") >= TEXT_THRESHOLD)))
    part = ~F.col("whole") & (F.col("kind") == "notice")
    return j.filter(full | part).select("file_id", "path", F.when(full, 0).otherwise(2).alias("rank"), "licence", (-F.col("cosine")).alias("c"))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``file_id, path, licence, method, cosine`` for files ``file_id, path, text``.

    ``method`` is ``header``, ``file``, ``inherited`` or null (no licence).
    """
    named = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    spoken = files.filter(named | F.col("text").rlike(MARK))
    pieces = F.split(F.regexp_replace("text", BREAK, "\n"), "\n")
    parts = spoken.select("file_id", "path", F.explode(F.when(named, F.array("text")).otherwise(F.filter(pieces, lambda p: p.rlike(MARK)))).alias("part"))
    segs = staged(parts.select("file_id", "path", _terms(F.col("part")).alias("seg")).filter(F.size("seg") > 0), "licence-segments")
    distinct = staged(segs.groupBy("seg").agg(F.count(F.lit(1)).alias("n")), "licence-distinct")
    best = staged(licences_of_segments(distinct, threshold), "licence-best")
    lines = segs.join(best, "seg").select("file_id", "path", F.when(named, 0).otherwise(1).alias("rank"), "licence", (-F.col("cosine")).alias("c"))
    own = (lines.union(_of_texts(spoken, named, threshold)).groupBy("file_id", "path")
                .agg(F.min(F.struct("rank", "c", "licence")).alias("b"))
                .select("file_id", "path", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"), (F.col("b.rank") == 0).alias("is_text")))
    own = staged(own, "licence-own")
    folder = F.regexp_replace(F.concat(F.lit("/"), F.col("path")), r"/[^/]*$", "")
    holders = (own.filter(F.col("path").rlike(FILE_NAME)).select(folder.alias("dir"), "licence", "cosine")
               .groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("h")))
    holders = staged(holders, "licence-dirs")
    # from a directory up to the root: as many rows as it is deep
    steps = F.split("dir", "/")
    dirs = files.filter("path IS NOT NULL").select(folder.alias("dir")).distinct()
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.concat_ws("/", F.slice(steps, 1, n)))).alias("above"))
    near = (up.join(holders.withColumnRenamed("dir", "above"), "above")
              .groupBy("dir").agg(F.max_by("h", F.length("above")).alias("h"))
              .select(F.col("dir").alias("_dir"), F.col("h.licence").alias("il"), (-F.col("h.c")).alias("ic")))
    near = staged(near, "licence-inherited")
    o = own.withColumnsRenamed({"file_id": "_f", "path": "_p"})
    j = files.select("file_id", "path", folder.alias("dir")).join(
        o, F.col("file_id").eqNullSafe(F.col("_f")) & F.col("path").eqNullSafe(F.col("_p")), "left")
    j = j.join(near, F.col("dir") == F.col("_dir"), "left")
    method = (F.when(F.col("licence").isNotNull(), F.when(F.col("is_text"), "file").otherwise("header")).when(F.col("il").isNotNull(), "inherited"))
    return j.select("file_id", "path", F.coalesce("licence", "il").alias("licence"), method.alias("method"), F.coalesce("cosine", "ic").alias("cosine"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: the source is their directory."""
    path = F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(".txt"))
    return docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), F.col("text").cast("string"))


def _oracle() -> str:
    values = ", ".join(f"({i}, '{k}', '{t}')" for i, (k, t) in enumerate(TEMPLATES))
    return rf"""
WITH files AS (SELECT doc_id, coalesce(source, 'unknown') || '/' || coalesce(doc_id::VARCHAR, 'null') || '.txt' AS path, text FROM documents),
p AS (SELECT doc_id, path, unnest(string_split(regexp_replace(text, '{BREAK}', chr(10), 'g'), chr(10))) AS part FROM files),
s AS (SELECT doc_id, path, regexp_extract_all(lower(part), '{TERM}') AS seg FROM p WHERE regexp_matches(part, '{MARK}')),
d AS (SELECT seg, count(*) AS n FROM s WHERE len(seg) > 0 GROUP BY seg),
t AS (SELECT t, licence, regexp_extract_all(lower(x), '{TERM}') AS seg FROM (VALUES {values}) v(t, licence, x)),
b AS (SELECT seg, n FROM d UNION ALL SELECT seg, 1 FROM t),
total AS (SELECT sum(n)::DOUBLE AS n FROM b),
df AS (SELECT term, sum(n) AS df FROM (SELECT n, unnest(list_distinct(seg)) AS term FROM b) GROUP BY term),
idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM df, total),
w AS (SELECT seg, term, count(*) * any_value(idf) AS w FROM (SELECT seg, unnest(seg) AS term FROM d) JOIN idf USING (term) GROUP BY seg, term),
tw0 AS (SELECT t, licence, term, count(*) * any_value(idf) AS w FROM (SELECT t, licence, unnest(seg) AS term FROM t) JOIN idf USING (term) GROUP BY ALL),
tw AS (SELECT t, licence, term, w / sqrt(sum(w * w) OVER (PARTITION BY t)) AS tw FROM tw0),
norm AS (SELECT seg, sqrt(sum(w * w)) AS norm FROM w GROUP BY seg),
c AS (SELECT seg, licence, round(sum(w * tw) / any_value(norm), 4) AS cosine FROM w JOIN tw USING (term) JOIN norm USING (seg) GROUP BY seg, t, licence),
own AS (SELECT doc_id, path, licence, cosine FROM s JOIN c USING (seg) WHERE cosine >= {THRESHOLD}
        QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY cosine DESC, licence) = 1)
SELECT f.doc_id, f.path, o.licence, CASE WHEN o.licence IS NOT NULL THEN 'header' END AS method, o.cosine
FROM files f LEFT JOIN own o ON f.doc_id IS NOT DISTINCT FROM o.doc_id AND f.path = o.path"""


@register("op9_licence_scan", _oracle())
def op9_licence_scan(spark, sf_dir):
    return scan(document_files(read_table(spark, sf_dir, "documents"))).withColumnRenamed("file_id", "doc_id")
