"""License scans with DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance.

A text is compared with templates of notices, headers and licence files in pieces of every size: its
lines and sentences, its paragraphs with wrapped lines joined and comment marks taken off, the sentences
of these, and the text as a whole. Terms are weighed by their inverse document frequency over all texts
(terms outside the templates: as if no text had them). A piece without any of the templates' cue terms
cannot reach the threshold, so only pieces with one are expanded. A text's license is that of its best
piece. Then a file without one takes that of the nearest directory at or above it that holds a licence
file.

Edge cases: null and empty texts have no license of their own; a null path is the empty path, in the
root; repeated rows each get their row; equal scores go to the template named first; an empty table gives
an empty table; extra columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import BROADCAST_ROWS, materialize, small

THRESHOLD = 0.7
_GNU = (
    "This {work} is free software: you can redistribute it and/or modify it under the terms" " of the GNU {name} as published by the Free Software Foundation, "
    "either version {v} of the License, or (at your option) any later version."
)
#: License, and how its notices, headers and files are worded.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge," " to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification," " are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("proprietary", "Copyright. All rights reserved."),
    # headers that run over several lines
    ("GPL-3.0", _GNU.format(work="program", name="General Public License", v="3")),
    ("GPL-2.0", _GNU.format(work="program", name="General Public License", v="2")),
    ("LGPL-2.1", _GNU.format(work="library", name="Lesser General Public License", v="2.1")),
    ("LGPL-3.0", _GNU.format(work="library", name="Lesser General Public License", v="3")),
    ("AGPL-3.0", _GNU.format(work="program", name="Affero General Public License", v="3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file" " except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License"
     " is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file," " You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose" " with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice" " appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # how licence files are headed
    ("MIT", "The MIT License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
)
TERM = r"[\p{L}\p{N}]+"
#: The end of a sentence becomes a line break; lines are pieces.
SENTENCE = r"([.!?])\s+"
#: What stands before a line of a comment; and between paragraphs.
MARK = r"(^|\n)[ \t]*(//+|/\*+|\*+/|\*+|#+|--+|;+|%+)[ \t]*"
GAP = r"\n[ \t\r]*\n\s*"
#: A licence file says little more than its template: at most twice its length and so many characters.
EXTRA = 200
PROSE_FILE = r"(?i)(^|/)[^/.]*(\.(txt|md|rst|html?))?$"
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)(\.[a-z0-9]+)?$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def pieces(text: Column) -> Column:
    """The different pieces of a text."""
    lines = lambda t: F.split(F.regexp_replace(t, SENTENCE, "$1\n"), r"\n+")
    bare = F.regexp_replace(F.regexp_replace(text, MARK, "$1"), GAP, "\f")
    joined = F.transform(F.split(bare, "\f"), lambda p: F.regexp_replace(p, r"\s*\n\s*", " "))
    whole = F.regexp_replace(F.array_join(joined, " "), r"\s*\n\s*", " ")
    return F.array_distinct(F.concat(lines(text), joined, lines(F.array_join(joined, "\n")), F.array(whole)))


def template_terms() -> list[Counter]:
    return [Counter(re.findall(r"[^\W_]+", t.lower())) for _, t in TEMPLATES]


def weights(counts: list[Counter], df: dict[str, int], total: int) -> tuple[list[dict[str, float]], dict[str, float]]:
    """Normalised TF-IDF vectors of the templates, and the idf of each of their terms."""
    idf = {t: math.log((1 + total) / (1 + df.get(t, 0))) + 1 for c in counts for t in c}
    vectors = []
    for c in counts:
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        vectors.append({t: n * idf[t] / norm for t, n in c.items()})
    return vectors, idf


def cue_terms(vectors: list[dict[str, float]], df: dict[str, int], threshold: float) -> list[str]:
    """Terms one of which every segment within the threshold has: what a template has besides its cues
    is, squared, less than the threshold squared. Rare terms are taken first."""
    cues: set[str] = set()
    for v in vectors:
        rest = sum(w * w for t, w in v.items() if t not in cues)
        for t in sorted(v, key=lambda t: (df.get(t, 0), t)):
            if rest < threshold**2 - 1e-9:
                break
            if t not in cues:
                cues.add(t)
                rest -= v[t] ** 2
    return sorted(cues)


def own_licenses(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(text_key, license, score, size of the template) of the texts that have one; text_key: xxhash64 of the text."""
    spark = df.sparkSession
    counts = template_terms()
    known = sorted({t for c in counts for t in c})
    docs = df.select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    mine = F.array_intersect(terms(F.col("text")), F.array(*[F.lit(t) for t in known]))
    # At most one row for each term of the templates, and one for the number of texts.
    seen = docs.select(F.explode(F.concat(F.array(F.lit("")), F.coalesce(mine, F.array().cast("array<string>")))).alias("t")).groupBy("t").count()
    freq = {r["t"]: r["count"] for r in seen.collect()}
    total = freq.pop("", 0)
    vectors, idf = weights(counts, freq, total)
    cues = cue_terms(vectors, freq, threshold)
    unseen = math.log(1 + total) + 1
    rows = [(t, i, idf[t], w) for i, v in enumerate(vectors) for t, w in v.items()]
    table = spark.createDataFrame(rows, "term string, template int, idf double, w double")
    cue = rf"(?iu)(?<![\p{{L}}\p{{N}}])({'|'.join(map(re.escape, cues))})(?![\p{{L}}\p{{N}}])"
    # the same text, and the same piece anywhere, is looked at once
    texts = docs.filter(F.col("text").rlike(cue)).dropDuplicates(["text_key"])
    lines = texts.select("text_key", F.explode(pieces(F.col("text"))).alias("line"))
    segments = materialize(lines.filter(F.col("line").rlike(cue)))
    uniq = segments.select("line").distinct().select(F.xxhash64("line").alias("line_key"), "line")
    words = uniq.select("line_key", F.explode(terms(F.col("line"))).alias("term")).groupBy("line_key", "term").agg(F.count("*").alias("tf"))
    vocabulary = F.broadcast(table.select("term", "idf").distinct())
    weighed = words.join(vocabulary, "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    norm = weighed.groupBy("line_key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(F.broadcast(table.select("term", "template", "w")), "term").groupBy("line_key", "template").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    # rounded first, so that sums in another order give the same winner
    scored = dots.join(norm, "line_key").select("line_key", "template", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).filter(F.col("score") >= threshold)
    best = scored.groupBy("line_key").agg(F.max(F.struct("score", (-F.col("template")).alias("order"))).alias("b"))
    found = segments.select("text_key", F.xxhash64("line").alias("line_key")).join(small(materialize(best)), "line_key")
    names, sizes = F.array(*[F.lit(n) for n, _ in TEMPLATES]), F.array(*[F.lit(len(t)) for _, t in TEMPLATES])
    per = found.groupBy("text_key").agg(F.max("b").alias("b"))
    at = 1 - F.col("b.order")
    return per.select("text_key", F.element_at(names, at).alias("license"), F.col("b.score").alias("score"), F.element_at(sizes, at).alias("size"))


def parent(path: Column) -> Column:
    """The directory of a path; the root is the empty path."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherited(files: DataFrame) -> DataFrame:
    """(dir, inherited, inherited_from) for every directory of files that has a license at or above it.

    files: dir, license, license_file. Of several license files of one directory the best score, then
    the first name, counts.
    """
    holders = files.filter("license_file and license is not null").groupBy("dir").agg(
        F.max_by("license", F.struct("score", "license")).alias("inherited")
    )
    dirs = files.select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = dirs.select("dir", F.posexplode(F.array_distinct(above)).alias("depth", "up"))
    held = small(holders.select(F.col("dir").alias("up"), "inherited"), BROADCAST_ROWS)
    near = up.join(held, "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "inherited")).alias("n"))
    return near.select("dir", F.col("n.inherited").alias("inherited"), F.col("n.up").alias("inherited_from"))


def scan(df: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, path, license and score of its own text, inherited and inherited_from, and final:
    its own license, or else the inherited one.

    A licence file is one named so, or a file of prose (not of code) that is its notice and little else:
    at most twice the template's length and EXTRA characters.
    """
    own = materialize(own_licenses(df, text_col, threshold))
    rows = df.select(
        F.col(id_col).alias("id"), F.coalesce(path, F.lit("")).alias("path"), F.xxhash64(text_col).alias("text_key"),
        F.coalesce(F.length(text_col), F.lit(0)).alias("n"),
    )
    # unlicensed texts find no row here, however many they are
    known = rows.join(own, "text_key", "left")
    files = materialize(
        known.select("id", "path", parent(F.col("path")).alias("dir"), "license", "score",
                     (F.col("path").rlike(LICENSE_FILE) | (F.col("license").isNotNull() & F.col("path").rlike(PROSE_FILE) & (F.col("n") <= 2 * F.col("size") + EXTRA))).alias("license_file"))
    )
    found = small(inherited(files))
    return files.join(found, "dir", "left").select(
        F.col("id").alias(id_col), "path", "license", "score", "license_file", "inherited", "inherited_from",
        F.coalesce("license", "inherited").alias("final"),
    )
