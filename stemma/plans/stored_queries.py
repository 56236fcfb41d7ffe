"""Searches over indexes that are written once for each data folder and session, then read in part (FTS-01, FTS-03..06)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.operators import stored
from stemma.plans.registry import Tables, query
from stemma.plans.text_queries import TERMS, _bm25_sql
from stemma.session import scratch

_BUILT: dict[tuple, stored.StoredIndex] = {}


def _once(t: Tables, name: str, make: Callable[[str], stored.StoredIndex]) -> stored.StoredIndex:
    key = (t.spark.sparkContext.applicationId, t.sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = make(scratch(t.spark, name))
    return _BUILT[key]


def _words(t: Tables) -> stored.StoredIndex:
    return _once(t, "words", lambda path: stored.write_index(t.documents, "doc_id", "text", path))


def _trigrams(t: Tables) -> stored.StoredIndex:
    return _once(t, "trigrams", lambda path: stored.write_trigrams(t.documents, "doc_id", "text", path))


def _top_sql(terms: list[str], must: bool, k: int) -> str:
    slots = "CASE term " + " ".join(f"WHEN '{x}' THEN {n}" for n, x in enumerate(terms)) + " END"
    scored = _bm25_sql(slots, len(terms))
    return f"SELECT * FROM ({scored if must else scored.replace(f'HAVING count(*) = {len(terms)}', '')}) ORDER BY score DESC, doc LIMIT {k}"


ANY, ALL = ["reed", "thnd", "ofing", "thatin"], ["the", "that", "of"]


@query(_top_sql(ANY, False, 25))
def fts_top_any(t: Tables) -> DataFrame:
    """FTS-04, FTS-06: the 25 best documents for any of four words, by ranges whose bound reaches the 25th score."""
    return stored.best(_words(t), ANY, 25).best


@query(_top_sql(ALL, True, 25))
def fts_top_all(t: Tables) -> DataFrame:
    """FTS-04, FTS-06: the 25 best documents with all of three words."""
    return stored.best(_words(t), ALL, 25, must=True).best


@query(_bm25_sql("CASE term WHEN 'the' THEN 0 WHEN 'that' THEN 1 END", 2))
def fts_stored_all(t: Tables) -> DataFrame:
    """FTS-04: all documents with both words, from the stored index."""
    return stored.matches(_words(t), ["the", "that"]).select("doc", F.round("score", 6).alias("score"))


@query(_bm25_sql("CASE WHEN term = 'the' THEN 0 WHEN starts_with(term, 'thatin') THEN 1 END", 2))
def fts_stored_prefix(t: Tables) -> DataFrame:
    """FTS-04: the last word as a prefix, from the stored index."""
    return stored.with_prefix(_words(t), ["the"], "thatin").select("doc", F.round("score", 6).alias("score"))


@query("""SELECT DISTINCT doc FROM (SELECT doc_id AS doc, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)) WHERE list_contains(g, 'of the the') OR list_contains(g, 'the of the')""")
def fts_stored_phrase(t: Tables) -> DataFrame:
    """FTS-05: either of two phrases, one with a word that comes twice, by positions of the stored index."""
    i = _words(t)
    return stored.phrase(i, ["of", "the", "the"]).unionByName(stored.phrase(i, ["the", "of", "the"])).distinct()


@query(f"SELECT term, count(DISTINCT doc) AS df, count(*)::BIGINT AS n FROM ({TERMS}) GROUP BY 1")
def fts_stored_terms(t: Tables) -> DataFrame:
    """FTS-01: the stored dictionary, with each word's documents and occurrences."""
    i = _words(t)
    n = i.blocks.groupBy("term").agg(F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    return i.terms.select("term", "df").join(n, "term")


NEEDLES = ["Tion th", "over", "e\nTh"]
GRAMS = "SELECT needle, unnest(list_distinct(list_transform(range(1, length(needle) - 1), lambda i: substr(lower(needle), i, 3)))) AS gram FROM (VALUES {0}) AS v(needle)".format(", ".join("('" + n.replace("\n", "' || chr(10) || '") + "')" for n in NEEDLES))


@query(f"SELECT needle, doc_id FROM documents, (SELECT DISTINCT needle FROM ({GRAMS})) WHERE contains(lower(text), lower(needle))")
def trigram_contains(t: Tables) -> DataFrame:
    """FTS-03: documents that hold each of three strings, by the stored trigrams."""
    i, out = _trigrams(t), None
    for needle in NEEDLES:
        one = stored.containing(i, t.documents, "doc_id", "text", needle).select(F.lit(needle).alias("needle"), "doc_id")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH g AS ({GRAMS}), d AS (SELECT needle, gram, count(*) AS df FROM g JOIN documents ON contains(lower(text), gram) GROUP BY 1, 2),
r AS (SELECT needle, gram FROM d QUALIFY row_number() OVER (PARTITION BY needle ORDER BY df, gram) <= 3),
k AS (SELECT needle FROM d GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM g WHERE g.needle = d.needle)),
c AS (SELECT needle, doc_id, text FROM r JOIN documents ON contains(lower(text), gram) WHERE needle IN (FROM k) GROUP BY 1, 2, 3 HAVING count(*) = (SELECT count(*) FROM r AS s WHERE s.needle = r.needle))
SELECT needle, count(doc_id) AS tested, count(doc_id) FILTER (contains(lower(text), lower(needle))) AS found, (SELECT count(*) FROM documents) AS documents FROM (SELECT DISTINCT needle FROM g) LEFT JOIN c USING (needle) GROUP BY 1""")
def trigram_shares(t: Tables) -> DataFrame:
    """FTS-03: of all documents, how many are tested for each string, and how many hold it."""
    i, out = _trigrams(t), None
    n = t.documents.count()
    for needle in NEEDLES:
        tested = stored.candidates(i, stored.rarest(i, needle)).select(F.lit(1).alias("tested"), F.lit(0).alias("found"))
        found = stored.containing(i, t.documents, "doc_id", "text", needle).select(F.lit(0).alias("tested"), F.lit(1).alias("found"))
        sums = tested.unionByName(found).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tested", "found")])
        one = sums.select(F.lit(needle).alias("needle"), "tested", "found", F.lit(n).cast("long").alias("documents"))
        out = one if out is None else out.unionByName(one)
    return out
