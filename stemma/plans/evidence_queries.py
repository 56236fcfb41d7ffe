"""Citations found anywhere in the documents and resolved by the whole cascade (RES-05..07), with an all-pairs twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.similarity import words
from stemma.operators.citations import prepared_citations, prepared_lines, resolve
from stemma.operators.evidence import evidence, fuzzy_candidates, fuzzy_pairs
from stemma.operators.passages import line_table, plain_norm, plain_norm_sql
from stemma.plans.literary_queries import LINES
from stemma.plans.registry import Tables, query
from stemma.session import checkpointed

LEAST = 0.5
#: A third of the passages are cut to their first five words, so that all tiers occur.
QUOTE = f"CASE WHEN item_id % 3 = 0 THEN array_to_string(string_split({plain_norm_sql('text')}, ' ')[1:5], ' ') ELSE {plain_norm_sql('text')} END"
SETS = """len(list_intersect(l.w, p.w)) / len(list_distinct(list_concat(l.w, p.w)))"""
BASE = f"""WITH l AS (SELECT doc_id, line_no, norm, list_distinct(list_filter(string_split(norm, ' '), lambda x: x <> '')) AS w, lead(norm) OVER (PARTITION BY doc_id ORDER BY line_no) AS next FROM (SELECT doc_id, line_no, {plain_norm_sql('line')} AS norm FROM ({LINES}))),
p AS (SELECT item_id, q, list_distinct(list_filter(string_split(q, ' '), lambda x: x <> '')) AS w, list_filter(string_split(q, ' '), lambda x: x <> '') AS each, coalesce(string_split(q, ' ')[3], '') AS h, item_id % 30 + 1 AS line FROM (SELECT item_id, {QUOTE} AS q FROM benchmark))"""

def _quotes(t: Tables) -> DataFrame:
    norm = plain_norm(F.col("text"))
    return t.benchmark.select("item_id", F.when(F.col("item_id") % 3 == 0, F.array_join(F.slice(F.split(norm, " "), 1, 5), " ")).otherwise(norm).alias("norm"))


def _lines(t: Tables) -> DataFrame:
    return line_table(t.documents).select("doc_id", "line_no", plain_norm(F.col("line")).alias("norm"))


def _sets(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, words(F.col("norm")).alias("words"))


@query(f"{BASE} SELECT item_id, doc_id, line_no, round({SETS}, 9) AS similarity FROM l, p WHERE len(l.w) > 0 AND {SETS} > {LEAST}")
def fuzzy_lines(t: Tables) -> DataFrame:
    """RES-07, tier 9 anywhere: all lines whose words are over half those of a passage."""
    found = fuzzy_pairs(_sets(_quotes(t), "item_id"), _sets(_lines(t), "doc_id", "line_no"), LEAST)
    return found.select("item_id", "doc_id", "line_no", F.round("similarity", 9).alias("similarity"))


@query(f"""{BASE}, d AS (SELECT word, count(*) AS df FROM (SELECT unnest(w) AS word FROM l) GROUP BY 1), x AS (SELECT item_id, len(w) AS n, unnest(w) AS word FROM p),
r AS (SELECT item_id, n, word, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(df, 0), word) AS place FROM x LEFT JOIN d USING (word)),
m AS (SELECT DISTINCT item_id, doc_id, line_no FROM r JOIN (SELECT doc_id, line_no, len(w) AS m, unnest(w) AS word FROM l) USING (word) WHERE place <= n - ceil(n * {LEAST}) + 1 AND m BETWEEN n * {LEAST} AND n / {LEAST})
SELECT item_id, count(*) AS tested, (SELECT count(*) FROM l) AS lines FROM m GROUP BY 1""")
def fuzzy_tested(t: Tables) -> DataFrame:
    """RES-07: how many lines are compared with each passage, of all there are."""
    lines = _lines(t)
    tested = fuzzy_candidates(_sets(_quotes(t), "item_id"), _sets(lines, "doc_id", "line_no"), LEAST).groupBy("item_id").agg(F.count("*").alias("tested"))
    return tested.withColumn("lines", F.lit(lines.count()).cast("long"))


CASCADE = f"""{BASE},
e AS (SELECT DISTINCT item_id, doc_id FROM l, p WHERE contains(norm, q) OR contains(norm || ' ' || next, q) OR len(each) BETWEEN 2 AND 6 AND len(list_filter(each, lambda x: NOT contains(norm, x))) = 0 OR len(l.w) > 0 AND {SETS} > {LEAST}),
s AS (SELECT item_id, doc_id, line_no, norm, next, q, each, h, line_no = line AS on_line, abs(line_no - line) AS apart, line_no > line AS after, {SETS} AS sim, strlen(q) > 3 AS quoted, strlen(h) >= 2 AS v, contains(norm, h) AS hd FROM e JOIN l USING (doc_id) JOIN p USING (item_id)),
t AS (SELECT *, CASE WHEN v AND NOT hd THEN sim * 0.3 ELSE sim END AS fuzzy, CASE
 WHEN quoted AND contains(norm, q) THEN 1 WHEN quoted AND contains(norm || ' ' || next, q) THEN 3 WHEN quoted AND len(each) BETWEEN 2 AND 6 AND len(list_filter(each, lambda x: NOT contains(norm, x))) = 0 THEN 5
 WHEN on_line AND (v AND hd OR NOT v AND sim > 0.3) THEN 6 WHEN v AND hd AND apart BETWEEN 1 AND 20 THEN 7 WHEN on_line THEN 8 WHEN (CASE WHEN v AND NOT hd THEN sim * 0.3 ELSE sim END) > 0.15 THEN 9 END AS tier FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY tier, CASE tier WHEN 7 THEN -(sim + 0.5) WHEN 9 THEN -fuzzy ELSE 0 END, CASE tier WHEN 7 THEN apart * 2 + after::INT ELSE 0 END, line_no) AS rn FROM t WHERE tier IS NOT NULL)
SELECT item_id, doc_id, line_no, tier, CASE WHEN tier <= 5 THEN 'exact_quote' WHEN tier <= 8 THEN 'line_number' ELSE 'fuzzy_text' END AS match_type,
 round(CASE tier WHEN 1 THEN 1.0 WHEN 3 THEN 0.95 WHEN 5 THEN 0.8 WHEN 6 THEN 0.9 WHEN 7 THEN CASE WHEN sim + 0.5 > 0.5 THEN 0.8 ELSE 0.6 END WHEN 8 THEN CASE WHEN v THEN 0.6 ELSE 0.7 END ELSE fuzzy END::DOUBLE, 9) AS confidence FROM k WHERE rn = 1"""


@query(f"SELECT item_id, doc_id, line_no, match_type, confidence FROM ({CASCADE})")
def cite_anywhere(t: Tables) -> DataFrame:
    """RES-05..07: passages cited under a line number and a headword, in every document that gives evidence of them, by all tiers."""
    quotes, lines = checkpointed(_quotes(t)), checkpointed(_lines(t))
    found = checkpointed(evidence(quotes, lines, LEAST))
    same: Column = lambda c: c  # noqa: E731  both are normalised already
    head = F.get(F.split("norm", " "), F.lit(2))
    cited = found.join(quotes, "item_id").select(F.struct("item_id", "doc_id").alias("id"), F.col("doc_id").alias("work_id"), F.lit(None).cast("int").alias("act"), F.lit(None).cast("int").alias("scene"), (F.col("item_id") % 30 + 1).alias("line"), F.col("norm").alias("quote_text"), head.alias("headword"))
    named = lines.join(found.select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("line_no").alias("id"), F.col("doc_id").alias("work_id"), F.lit(1).alias("edition_id"), F.lit(None).cast("int").alias("act"), F.lit(None).cast("int").alias("scene"), F.col("line_no").alias("line_number"), F.col("norm").alias("content"))
    best = resolve(checkpointed(prepared_citations(cited, same, expand=False)), checkpointed(prepared_lines(named, same)))
    return best.select("citation_id.item_id", "citation_id.doc_id", F.col("text_line_id").alias("line_no"), "match_type", F.round("confidence", 9).alias("confidence"))
