"""Citations in long texts of several sources, found in one pass (PRS-05, PRS-06, PRS-09, PRS-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.plans.registry import Tables, query
from stemma.sources.automaton import apart, citation_column
from stemma.sources.citation_text import Forms

#: Numerals from one to ten.
NUMERALS = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")
PLAYS, SONNETS, POEMS = ("Ham.", "Mac.", "Tw.N.", "1 Hen. IV.", "2 Hen. IV.", "Merch. V."), ("Sonn.",), ("Ven.", "Lucr.")
STYLES = {"roman": Forms(PLAYS, SONNETS, POEMS), "mixed": Forms(PLAYS, SONNETS, POEMS, style="mixed")}

NUMERAL = "[" + ", ".join(f"'{n}'" for n in NUMERALS) + "]"
#: Every line of a document is followed by a citation of one of four forms; sources write the scene in letters or figures.
CITED = f"""SELECT doc_id, source, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: x || ' see ' || CASE (doc_id + i) % 4
 WHEN 0 THEN [{", ".join(f"'{p}'" for p in PLAYS)}][(doc_id + i) % {len(PLAYS)} + 1] || '  ' || n[i % 5 + 1] || '. ' || CASE source WHEN 'roman' THEN n[doc_id % 7 + 1] ELSE (doc_id % 7 + 1)::VARCHAR END || '. ' || (i % 300 + 1)
 WHEN 1 THEN 'Sonn. ' || n[i % 10 + 1] || '. ' || (doc_id % 14 + 1) WHEN 2 THEN 'Ven. ' || (i + doc_id) % 1000 ELSE 'Lucr.' || (i % 100) END || ' there'), chr(10)) AS text FROM (SELECT doc_id, text, {NUMERAL} AS n, CASE WHEN doc_id % 2 = 0 THEN 'roman' ELSE 'mixed' END AS source FROM documents WHERE text IS NOT NULL)"""
NAMES = "|".join(p.replace(".", r"\.").replace(" ", r"\s+") for p in sorted(PLAYS, key=len, reverse=True))
ROMAN = "[IVXLCDMivxlcdm]+"
PATTERN = rf"\b(?:({NAMES})\s*({ROMAN})[.]\s*({ROMAN}|[0-9]+)[.]\s*([0-9]+)|(Sonn\.)\s*({ROMAN})\.\s*([0-9]+)|(Ven\.|Lucr\.)\s*([0-9]+))"


def _cited(t: Tables) -> DataFrame:
    d, n, nl = F.col("doc_id"), F.array(*map(F.lit, NUMERALS)), F.lit("\n")
    source = F.when(d % 2 == 0, "roman").otherwise("mixed")
    pick = lambda words, k: F.get(F.array(*map(F.lit, words)), k.cast("int"))

    def with_citation(x, k):
        i = k + 1
        scene = F.when(d % 2 == 0, F.get(n, (d % 7).cast("int"))).otherwise((d % 7 + 1).cast("string"))
        play = F.concat(pick(PLAYS, (d + i) % len(PLAYS)), F.lit("  "), F.get(n, (i % 5).cast("int")), F.lit(". "), scene, F.lit(". "), (i % 300 + 1).cast("string"))
        sonnet = F.concat(F.lit("Sonn. "), F.get(n, (i % 10).cast("int")), F.lit(". "), (d % 14 + 1).cast("string"))
        poem = F.concat(F.lit("Ven. "), ((i + d) % 1000).cast("string"))
        other = F.concat(F.lit("Lucr."), (i % 100).cast("string"))
        form = (d + i) % 4
        return F.concat(x, F.lit(" see "), F.when(form == 0, play).when(form == 1, sonnet).when(form == 2, poem).otherwise(other), F.lit(" there"))

    return t.documents.where("text IS NOT NULL").select("doc_id", source.alias("source"), F.array_join(F.transform(F.split("text", nl), with_citation), "\n").alias("text"))


@query(rf"""WITH d AS ({CITED}), m AS (SELECT doc_id, text, regexp_extract_all(text, '{PATTERN}') AS m, string_split_regex(text, '{PATTERN}') AS p FROM d),
e AS (SELECT doc_id, unnest(range(1, len(m) + 1)) AS k, m, p FROM m), g AS (SELECT doc_id, k, m[k] AS x, list_sum(list_transform(p[1:k], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda z: length(z))), 0) AS s FROM e),
r AS (SELECT doc_id, x, s, regexp_extract(x, '{PATTERN}', ['name', 'act', 'scene', 'line', 'sonnet', 'number', 'verse', 'poem', 'place']) AS c FROM g)
SELECT doc_id, regexp_replace(c['name'] || c['sonnet'] || c['poem'], '\s+', ' ', 'g') AS abbrev, list_position({NUMERAL}, c['act'])::INT AS act, CASE WHEN c['sonnet'] <> '' THEN list_position({NUMERAL}, c['number']) WHEN c['name'] <> '' THEN coalesce(try_cast(c['scene'] AS INT), list_position({NUMERAL}, c['scene'])) END::INT AS scene,
 CASE WHEN c['poem'] <> '' THEN c['place'] WHEN c['sonnet'] <> '' THEN c['verse'] ELSE c['line'] END::INT AS line, s::INT AS "start", (s + length(x))::INT AS "end" FROM r WHERE c['place'] IS DISTINCT FROM '0'""")
def citations_of_sources(t: Tables) -> DataFrame:
    """PRS-05, PRS-06, PRS-09, PRS-10: all citations of the documents' lines, by one automaton for both sources."""
    found = _cited(t).select("doc_id", apart(citation_column(STYLES)("text", "source")).alias("s"))
    return found.select("doc_id", F.inline("s")).select("doc_id", "abbrev", "act", "scene", "line", "start", "end")
