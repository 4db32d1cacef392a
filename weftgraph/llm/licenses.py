"""License scans: sparse TF-IDF cosine to templates, then inheritance by directory.

1. Statements: the lines of every whole text that mention a license.  Equal
   lines are counted first and scored once, so a line that a third of all files
   share is one row.
2. Terms are weighted by tf * idf, idf = ln((1 + N) / (1 + df)) + 1 over all
   statements of the table; a statement's score against a template is their
   cosine.  The template side is a fixed table (TEMPLATES), so its broadcast is
   bounded; a file's own license is its best statement of at least `least`.
   Passages are scored besides: comment headers and their paragraphs, whole
   paragraphs that mention a license, and the whole text of files named as
   license files, each joined over its lines, against TEXTS, with the idf of TEXTS;
   SPDX tags are read as such.  The best of all counts, a statement first.
3. A file is a license file if its name says so, or if its statements make up
   half of its text.  A directory has the license of its best license file.
4. A file without a license of its own takes that of the nearest ancestor
   directory that has one.  Ancestors are joined by path once per distinct
   directory, not per file.

DataFrame operations only.  Defined cases: null text has no statement; a null
path has no directory and inherits nothing; ties go to the template, then path,
first in order; repeated rows get equal results; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.shared import cut

#: License ids and statements by which works name them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software under the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Licensed under the simplified BSD License, two clauses."),
    ("BSD-3-Clause", "Licensed under the new BSD License, three clauses."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 license."),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
    ("ISC", "Licensed under the ISC License."),
]
MENTION = r"(?i)licen[sc]e|copyright|public domain"
_NAMES = {
    "MIT": ["MIT License"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"], "GPL-2.0": ["GNU General Public License version 2", "GPL v2"], "GPL-3.0": ["GNU General Public License version 3", "GPL v3"],
    "LGPL-3.0": ["GNU Lesser General Public License version 3"], "AGPL-3.0": ["GNU Affero General Public License version 3"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0"], "CC0-1.0": ["CC0 1.0 Universal public domain dedication"], "Unlicense": ["Unlicense"], "ISC": ["ISC License"],
}
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GNU_END = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see https://www.gnu.org/licenses/."
#: What passages are compared to: titles, sentences with a license's name, notices and short licenses as a whole.
TEXTS = [
    *TEMPLATES,
    *((k, f"{how}{name}") for k, names in _NAMES.items() for name in names for how in ("", "Distributed under the ", "Licensed under the terms of the ")),
    ("MIT", _MIT), ("MIT", f"MIT License {_MIT} {_AS_IS}"),
    ("BSD-2-Clause", _BSD), ("BSD-2-Clause", _BSD + _BSD_END), ("BSD-3-Clause", _BSD + _BSD_3), ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", _APACHE), ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    *((k, text.format(kind, version)) for k, kind, version in (("GPL-2.0", "", 2), ("GPL-3.0", "", 3), ("LGPL-3.0", "Lesser ", 3), ("AGPL-3.0", "Affero ", 3)) for text in (_GNU, _GNU + _GNU_END)),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
#: The comment that a file begins with, and marks of comments at the ends of lines.
HEADER = r"(?s)\A\s*(?:/\*.*?\*/|<!--.*?-->|\"\"\".*?\"\"\"|(?:[ \t]*(?:#|//|;|--|%)[^\n]*(?:\n|\z))+)"
MARKS = r"(?m)^[ \t]*(?:#+!?|//+|/\*+|\*+/?|;+|--+|%+|<!--+)|(?:\*/|-->)[ \t]*$"
SPDX = r"(?i)SPDX-License-Identifier:[\s(]*([a-z0-9.-]+?)(?:-only|-or-later|\+)?(?:[\s)*]|$)"
FILE_NAME = r"(?i)(?:^|/)(?:licen[sc]e|copying|notice|unlicense)(?:\.[a-z]+)?$"
LEAST = 0.6


def _terms(text):
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _directory(path):
    """The directory of a path; '' at the top, null for a null path."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def _passages(rows: DataFrame) -> DataFrame:
    """(doc_id, path, named, key, passage): comment headers, paragraphs and whole license files, joined over lines."""
    text, header = F.col("text"), F.regexp_extract("text", HEADER, 0)
    named = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    plain = lambda x: F.regexp_replace(x, MARKS, "")
    mention = F.filter(F.split(plain(text), r"\n[ \t\r]*\n"), lambda p: p.rlike(MENTION))
    found = F.concat(F.when(text.rlike(MENTION), mention).otherwise(F.array().cast("array<string>")), F.split(plain(header), r"\n[ \t\r]*\n"), F.array(plain(header)), F.when(named, F.array(plain(text))).otherwise(F.array().cast("array<string>")))
    joined = F.filter(F.transform(found, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    out = rows.where(text.rlike(MENTION) | text.rlike(HEADER) | named)
    out = out.select("doc_id", "path", named.alias("named"), F.explode(F.array_distinct(joined)).alias("passage"))
    return out.withColumn("key", F.sha2("passage", 256))


def _told_by_passages(rows: DataFrame, least: float) -> DataFrame:
    """(doc_id, path, license, score, statement, is_file): what passages and SPDX tags tell."""
    spark = rows.sparkSession
    df = Counter(w for _, t in TEXTS for w in set(re.findall("[a-z0-9]+", t.lower())))
    idf = lambda w: math.log((1 + len(TEXTS)) / (1 + df[w])) + 1
    words = []
    for k, (name, t) in enumerate(TEXTS):
        tw = {w: n * idf(w) for w, n in Counter(re.findall("[a-z0-9]+", t.lower())).items()}
        norm = math.sqrt(sum(x * x for x in tw.values()))
        words += [(k, name, w, x / norm) for w, x in tw.items()]
    # both are bounded by the fixed texts
    model = F.broadcast(spark.createDataFrame(words, "template int, license string, term string, tw double"))
    weights = F.broadcast(spark.createDataFrame([(w, idf(w)) for w in df], "term string, idf double"))
    held = cut(_passages(rows), "passages")
    terms = held.groupBy("key").agg(F.first("passage").alias("passage")).select("key", F.explode(_terms(F.col("passage"))).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    terms = cut(terms.join(weights, "term", "left").select("key", "term", (F.col("tf") * F.coalesce("idf", F.lit(idf("")))).alias("w")), "passage-terms")
    norm = terms.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = terms.join(model, "term").groupBy("key", "license", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    best = dots.join(norm, "key").select("key", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= least)
    best = best.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select("key", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))
    known = F.create_map(*(F.lit(x) for name in sorted({n for n, _ in TEMPLATES}) for x in (name.lower(), name)))
    by_text = held.join(best, "key").select("doc_id", "path", "license", "score", "passage", "named")
    by_tag = held.select("doc_id", "path", known[F.lower(F.regexp_extract("passage", SPDX, 1))].alias("license"), F.lit(1.0).alias("score"), F.regexp_extract("passage", SPDX, 0).alias("passage"), "named").where("license IS NOT NULL")
    return by_text.unionByName(by_tag).select("doc_id", "path", "license", "score", F.col("passage").alias("statement"), F.col("named").alias("is_file"))


def scan(files: DataFrame, *, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license, score, origin (own, inherited or null), statement (the line or passage that told) and directory."""
    spark = files.sparkSession
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = rows.where(F.col("text").rlike(MENTION)).select("doc_id", "path", F.length("text").alias("size"), F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(MENTION))
    lines = cut(lines, "statements")
    distinct = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    terms = cut(distinct.select("line", "n", F.explode(_terms(F.col("line"))).alias("term")).groupBy("line", "n", "term").agg(F.count(F.lit(1)).alias("tf")), "statement-terms")
    total = lines.count()
    df = terms.groupBy("term").agg(F.sum("n").alias("df"))
    idf = df.select("term", (F.log((F.lit(1.0) + total) / (1 + F.col("df"))) + 1).alias("idf"))

    model = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "template int, license string, wording string")
    words = model.select("template", "license", F.explode(_terms(F.col("wording"))).alias("term")).groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf"))
    rare = F.log(F.lit(1.0) + total) + 1
    words = words.join(idf, "term", "left").select("template", "license", "term", (F.col("tf") * F.coalesce("idf", rare)).alias("tw"))
    tnorm = words.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    words = cut(words.join(tnorm, "template"), "templates")

    weighted = terms.join(idf, "term").select("line", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = weighted.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # the template side has a row per template and term: bounded by the fixed table
    dots = weighted.join(F.broadcast(words), "term").groupBy("line", "template", "license", "tnorm").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    cosine = dots.join(norm, "line").select("line", "license", "template", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 6).alias("score"))
    best = cosine.where(F.col("score") >= least).groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", "template")).alias("b"))
    best = cut(best.select("line", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score")), "scored-statements")

    told = lines.join(best, "line")
    own = told.groupBy("doc_id", "path").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", "line")).alias("b"), (F.sum(F.length("line")) * 2 >= F.first("size")).alias("mostly"))
    own = own.select("doc_id", "path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), F.col("b.line").alias("statement"), (F.col("mostly") | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))).alias("is_file"))
    own = own.withColumn("kind", F.lit(0)).unionByName(_told_by_passages(rows, least).withColumn("kind", F.lit(1)))
    own = own.groupBy("doc_id", "path").agg(F.min(F.struct((-F.col("score")).alias("s"), "kind", "license", "statement")).alias("b"), F.max("is_file").alias("is_file"))
    own = cut(own.select("doc_id", "path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), F.col("b.statement").alias("statement"), "is_file"), "own-licenses")

    given = own.where("is_file AND path IS NOT NULL").groupBy(_directory(F.col("path")).alias("directory")).agg(F.min(F.struct((-F.col("score")).alias("s"), "license", "path")).alias("b"))
    given = cut(given.select("directory", F.col("b.license").alias("given"), (-F.col("b.s")).alias("given_score")), "directory-licenses")
    places = rows.select(_directory(F.col("path")).alias("place")).where("place IS NOT NULL").distinct()
    parts = F.split("place", "/")
    above = places.select("place", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("directory"))
    nearest = above.join(given, "directory").groupBy("place").agg(F.max(F.struct(F.length("directory").alias("depth"), "directory", "given", "given_score")).alias("b"))
    nearest = cut(nearest.select("place", F.col("b.directory").alias("from_directory"), F.col("b.given").alias("given"), F.col("b.given_score").alias("given_score")), "inherited")

    out = rows.select("doc_id", "path", _directory(F.col("path")).alias("place")).join(own.drop("is_file").distinct().withColumnRenamed("doc_id", "_d").withColumnRenamed("path", "_p"), F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("path").eqNullSafe(F.col("_p")), "left").join(nearest, "place", "left")
    has = F.col("license").isNotNull()
    return out.select(
        "doc_id",
        F.coalesce("license", "given").alias("license"),
        F.coalesce("score", "given_score").alias("score"),
        F.when(has, "own").when(F.col("given").isNotNull(), "inherited").alias("origin"),
        "statement",
        F.when(~has, F.col("from_directory")).alias("directory"),
    )


def oracle(least: float = LEAST) -> str:
    """scan() over documents by path source/lang/doc_id, for DuckDB."""
    quoted = ", ".join(f"({k}, '{n}', '{t}')" for k, (n, t) in enumerate(TEMPLATES))
    return f"""
WITH docs AS (SELECT doc_id, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS path, source || '/' || lang AS place, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, path, place, length(text) AS size, unnest(string_split(text, chr(10))) AS line FROM docs),
told AS (SELECT * FROM lines WHERE regexp_matches(line, '{MENTION}')),
terms AS (SELECT line, n, term, count(*) AS tf FROM (SELECT line, n, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS term FROM (SELECT line, count(*) AS n FROM told GROUP BY line)) GROUP BY ALL),
total AS (SELECT count(*) AS n FROM told),
idf AS (SELECT term, ln((1.0 + (SELECT n FROM total)) / (1 + sum(n))) + 1 AS idf FROM terms GROUP BY term),
templates(template, license, wording) AS (VALUES {quoted}),
words AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest(regexp_extract_all(lower(wording), '[a-z0-9]+')) AS term FROM templates) GROUP BY ALL),
tw AS (SELECT template, license, term, tf * coalesce(idf, ln(1.0 + (SELECT n FROM total)) + 1) AS w FROM words LEFT JOIN idf USING (term)),
tn AS (SELECT template, sqrt(sum(w * w)) AS tnorm FROM tw GROUP BY template),
lw AS (SELECT line, term, tf * idf AS w FROM terms JOIN idf USING (term)),
ln AS (SELECT line, sqrt(sum(w * w)) AS norm FROM lw GROUP BY line),
cosine AS (SELECT lw.line, tw.license, tw.template, round(sum(lw.w * tw.w) / (any_value(ln.norm) * any_value(tn.tnorm)), 6) AS score
           FROM lw JOIN tw USING (term) JOIN ln ON ln.line = lw.line JOIN tn ON tn.template = tw.template GROUP BY 1, 2, 3),
best AS (SELECT * FROM cosine WHERE score >= {least} QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, license, template) = 1),
own AS (SELECT doc_id, path, place, license, score, line AS statement, sum(length(line)) OVER (PARTITION BY doc_id) * 2 >= size AS is_file
        FROM told JOIN best USING (line) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license, line) = 1),
given AS (SELECT place AS directory, license AS given, score AS given_score FROM own WHERE is_file QUALIFY row_number() OVER (PARTITION BY place ORDER BY score DESC, license, path) = 1)
SELECT d.doc_id, coalesce(o.license, g.given) AS license, coalesce(o.score, g.given_score) AS score,
       CASE WHEN o.license IS NOT NULL THEN 'own' WHEN g.given IS NOT NULL THEN 'inherited' END AS origin,
       o.statement, CASE WHEN o.license IS NULL THEN g.directory END AS directory
FROM docs d LEFT JOIN own o USING (doc_id) LEFT JOIN given g ON g.directory = d.place"""
