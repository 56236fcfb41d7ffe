"""License scan by canonical digests, with DataFrame functions only.

A text is put into canonical form line by line: copyright notices go, then case, punctuation, white space and equivalent
spellings; the lines are joined, so that wrapping does not matter, and titles at the head go. A copyright notice is a line
that begins with the word or sign and has a year, a sign or a place for one, or that only reserves all rights; other lines
that begin with the word stay, as wrapped lines of a license may. The canonical text is hashed with SHA-256 and looked up
among the digests of known licenses by a hash join. Whole texts are looked up, and so is each line, as notices of one line are
the commonest form in web text.

Defined cases: null and blank texts match nothing; equal rows are reported each; an empty table gives no rows; several
names with one canonical text give the smallest name; a line that is a title alone matches nothing; very long texts are read
whole; other columns are ignored.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import materialize, small_side

#: Spellings that license matching guidelines treat as equal, written form -> canonical form.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("noncommercial", "non commercial"), ("optimise", "optimize"), ("organisation", "organization"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sublicence", "sublicense"),
    ("utilisation", "utilization"), ("wilful", "willful"),
)

#: Short license texts and notices in public use.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

#: Licenses as one-line notices name them, and how such notices begin.
NOTICE_NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "MIT": ("MIT License",),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC0-1.0": ("CC0 1.0",),
}
NOTICE_STARTS = ("Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This project is licensed under")
#: Titles that stand over license texts, in canonical form.
TITLES = (
    "mit license", "mit", "isc license", "isc", "bsd 2 clause license", "bsd 2 clause simplified license", "simplified bsd license", "2 clause bsd license",
    "bsd 3 clause license", "bsd 3 clause new or revised license", "new bsd license", "3 clause bsd license", "zlib license", "zlib",
)


def notices() -> dict[str, list[str]]:
    """License name -> notices of one line: each start with each name, with the article and without."""
    return {f"{k}-notice": [f"{start} {the}{name}" for start in NOTICE_STARTS for the in ("", "the ") for name in names] for k, names in NOTICE_NAMES.items()}


def full_texts() -> dict[str, str]:
    """Longer licenses in public use, from a data file beside this one; only the driver reads it."""
    return json.loads(Path(__file__).with_name("license_texts.json").read_text(encoding="utf-8"))


YEAR = r"(19|20)[0-9][0-9]([^0-9]|$)"
#: A copyright notice, on a line in lower case. Java and RE2 read these patterns alike.
COPYRIGHT = rf"^[^\p{{L}}\p{{N}}(©]*(copyright([^\p{{L}}\p{{N}}][^\n]*)?(\(c\)|©|[^0-9]{YEAR}|[<\[{{](yyyy|year))|©|\(c\) *(copyright|{YEAR})|all +rights +reserved[^\p{{L}}\p{{N}}]*$)"
HEAD = rf"^( (?:the  )?(?:{'|'.join(t.replace(' ', '  ') for t in sorted(TITLES, key=len, reverse=True))}) )+"


def canonical_line(line: Column) -> Column:
    """A line in canonical form: its words, each between two blanks of its own, so that neighbours have none in common; empty for a
    copyright notice."""
    t = F.lower(line)
    words = F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "  "))
    out = F.concat(F.lit(" "), words, F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.when(t.rlike(COPYRIGHT) | (words == ""), "").otherwise(out)


def without_titles(text: Column) -> Column:
    """Canonical lines joined, without the titles at the head."""
    return F.regexp_replace(text, HEAD, "")


def lines_of(text: Column) -> Column:
    """The canonical lines of a text that have words."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical_line), lambda x: x != "")


def digest_of(lines: Column) -> Column:
    return F.sha2(without_titles(F.array_join(lines, "")), 256)


def known_digests(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """digest, license of known texts; by default TEXTS, notices() and full_texts(). The caller's table of texts may have any size."""
    rows = list(texts.items()) if texts is not None else [*TEXTS.items(), *full_texts().items(), *((k, t) for k, ts in notices().items() for t in ts)]
    known = spark.createDataFrame(sorted(rows), "license string, text string")
    return known.groupBy(digest_of(lines_of(F.col("text"))).alias("digest")).agg(F.min("license").alias("license")).where(F.col("digest") != EMPTY)


#: The digest of no words at all, which no text is known by.
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def license_scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, digest, license (null if the whole text is none), line_licenses (sorted names on lines of it) for each row of docs.

    Each row's digests are written once; the lines' digests then meet the known ones in a hash join, and the few rows that have a known
    line come back by number. Sides are broadcast only if they have been counted and are small."""
    known = materialize(known_digests(docs.sparkSession, texts), "known")
    lines = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), lines_of(F.col("text")).alias("lines"))
    line_digests = F.array_distinct(F.transform("lines", lambda x: F.unhex(F.sha2(without_titles(x), 256))))
    written = materialize(lines.select("doc_id", "row", digest_of(F.col("lines")).alias("digest"), line_digests.alias("lines")), "digests")
    by_line = small_side(known.select(F.unhex("digest").alias("line"), F.col("license").alias("name")))
    hits = written.select("row", F.explode("lines").alias("line")).join(by_line, "line")
    named = materialize(hits.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("line_licenses")), "named")
    out = written.drop("lines").join(small_side(named), "row", "left").join(small_side(known), "digest", "left")
    return out.select("doc_id", "digest", "license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_line(x: str) -> str:
    words = rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', '  ', 'g'))"
    out = f"' ' || {words} || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new.replace(' ', '  ')} ')"
    return f"CASE WHEN regexp_matches(lower({x}), {_sql_text(COPYRIGHT)}) OR {words} = '' THEN '' ELSE {out} END"


def _sql_digest(x: str) -> str:
    return f"sha256(regexp_replace({x}, {_sql_text(HEAD)}, ''))"


def oracle(texts: dict[str, str] | None = None) -> str:
    """DuckDB SQL for license_scan(documents), on tables without a text of full_texts()."""
    pairs = sorted(texts.items()) if texts is not None else sorted([*TEXTS.items(), *((k, t) for k, ts in notices().items() for t in ts)])
    rows = ", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in pairs)
    return f"""
WITH src AS (SELECT 0 AS kind, row_number() OVER () AS r, doc_id, NULL AS l, coalesce(text, '') AS t FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, l, t FROM (VALUES {rows}) v(l, t)),
cut AS (SELECT kind, r, unnest(range(len(xs))) AS i, unnest(xs) AS x FROM (SELECT kind, r, string_split(t, chr(10)) AS xs FROM src)),
canon AS (SELECT * FROM (SELECT kind, r, i, {_sql_line("x")} AS c FROM cut) WHERE c <> ''),
whole AS (SELECT kind, r, string_agg(c, '' ORDER BY i) AS c FROM canon GROUP BY 1, 2),
full_digest AS (SELECT s.kind, s.r, s.doc_id, s.l, {_sql_digest("coalesce(w.c, '')")} AS digest FROM src s LEFT JOIN whole w USING (kind, r)),
known AS (SELECT digest, min(l) AS license FROM full_digest WHERE kind = 1 AND digest <> '{EMPTY}' GROUP BY 1),
found AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS ls FROM (SELECT r, {_sql_digest("c")} AS digest FROM canon WHERE kind = 0) JOIN known USING (digest) GROUP BY r)
SELECT doc_id, digest, license, coalesce(ls, '') AS line_licenses
FROM (SELECT * FROM full_digest WHERE kind = 0) LEFT JOIN found USING (r) LEFT JOIN known USING (digest)
"""
