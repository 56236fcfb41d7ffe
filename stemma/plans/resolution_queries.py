"""The later phases of resolution, and lists of the view layer, on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions.similarity import words
from stemma.operators import citations, views
from stemma.operators.passages import plain_norm, plain_norm_sql
from stemma.plans.given_queries import SAID, said
from stemma.plans.registry import Tables, query
from stemma.session import checkpointed, scratch
from stemma.sources.citation_text import Forms, span_column
from stemma.sources.splits import read_dump_by_split
from stemma.sources.writers import insert_statements

#: Conversations as plays of one act for each three turns, orders as citations of them by place and a headword.
LINED = f"SELECT conv_id AS work_id, 1 + conv_id % 3 AS act, scene, k AS line_number, n, line AS content, {plain_norm_sql('line')} AS norm FROM ({SAID})"
ASKED = """SELECT o_orderkey AS id, o_custkey % 60 AS w, 1 + o_custkey % 3 AS a, o_orderkey % 4 AS s, (o_orderkey % 9 + 1)::INT AS line, ['the', 'tion', 'eron', 'hein', 'thes', 'whou', 'zzzz', 'q'][o_orderkey % 8 + 1] AS h FROM orders"""
HEADS = ("the", "tion", "eron", "hein", "thes", "whou", "zzzz", "q")


def _lined(t: Tables) -> DataFrame:
    """Prepared lines: line_id is the place in the conversation."""
    norm = plain_norm(F.col("line"))
    one = said(t).select(F.col("n").cast("long").alias("line_id"), F.col("conv_id").alias("work_id"), F.lit(1).cast("long").alias("edition_id"), (1 + F.col("conv_id") % 3).cast("int").alias("act"), "scene", F.col("k").alias("line_number"), F.col("n").alias("ord"), norm.alias("norm"), words(norm).alias("words"), F.col("line").alias("content"))
    return checkpointed(one)


def _asked(t: Tables) -> DataFrame:
    """Prepared citations without a match."""
    k = F.col("o_orderkey")
    head = F.get(F.array(*map(F.lit, HEADS)), (k % 8).cast("int"))
    return t.orders.select(k.alias("citation_id"), (F.col("o_custkey") % 60).alias("work_id"), (1 + F.col("o_custkey") % 60 % 3).cast("int").alias("act"), (k % 4).cast("int").alias("scene"), (k % 9 + 1).cast("int").alias("line"), head.alias("head"), head.alias("nh"), k.cast("string").alias("raw_bibl"))


def _no_matches(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([], "citation_id long, edition_id long")


@query(f"""WITH l AS ({LINED}), c AS (SELECT id, w, 1 + w % 3 AS a, s, h FROM ({ASKED})), p AS (SELECT c.*, EXISTS (SELECT 1 FROM l WHERE work_id = w AND act = a AND scene = s) AS has FROM c),
m AS (SELECT p.id, l.n, CASE WHEN contains(norm, h) THEN 1 WHEN strlen(h) >= 4 AND len(list_filter(string_split(norm, ' '), lambda x: starts_with(x, substr(h, 1, length(h) - 1)) AND x <> h)) > 0 THEN 3 END AS tier FROM p JOIN l ON l.work_id = w AND l.act = a AND (NOT has OR l.scene = s))
SELECT id AS citation_id, arg_min(n, (tier, n))::BIGINT AS text_line_id, 0.4::DOUBLE AS confidence FROM m WHERE tier IS NOT NULL GROUP BY 1""")
def given_headwords(t: Tables) -> DataFrame:
    """RES-09, RES-10, SCL-04, SCL-05: the first line of the scene, or of the act, that has the headword or a word of its stem."""
    found = citations.headword_search(_asked(t), _lined(t), _no_matches(t), 0.4)
    return found.select("citation_id", "text_line_id", "confidence")


@query(f"""WITH l AS ({LINED}), c AS (SELECT id, CASE WHEN id % 3 = 0 THEN 0 ELSE 1 + w % 3 END AS a, line, h FROM ({ASKED}) WHERE strlen(h) >= 2 AND id % 10 = 3),
m AS (SELECT c.id, l.n, l.line_number AS k, abs(l.line_number - c.line) AS d FROM c JOIN l ON abs(l.line_number - c.line) <= 10 AND (a = 0 OR a = act) AND contains(norm, h))
SELECT id AS citation_id, arg_min(n, (d, k, n))::BIGINT AS text_line_id, 0.6::DOUBLE AS confidence FROM m GROUP BY 1""")
def given_cross_play(t: Tables) -> DataFrame:
    """RES-11, JN-11: citations of some orders, in any play: the nearest line within ten that holds the headword; a third have no act."""
    asked = _asked(t).where("citation_id % 10 = 3").withColumn("act", F.when(F.col("citation_id") % 3 != 0, F.col("act")))
    chosen = t.spark.createDataFrame([(1, "perseus_globe")], "id long, short_code string")
    return citations.cross_play(asked, _lined(t), chosen, _no_matches(t)).select("citation_id", "text_line_id", "confidence")


@query(f"""WITH l AS ({LINED}), c AS (SELECT id, w, 1 + w % 3 AS a, line, h FROM ({ASKED})),
r AS (SELECT id, h, w, line, CASE WHEN id % 2 = 0 THEN a END AS a FROM c WHERE id % 7 = 0), t AS (SELECT r.id, min(n) AS n FROM r JOIN l ON l.work_id = r.w AND l.line_number = r.line AND (r.a IS NULL OR r.a = act) GROUP BY 1)
SELECT id AS citation_id, n::BIGINT AS text_line_id, 0.99::DOUBLE AS confidence FROM t""")
def given_corrections(t: Tables) -> DataFrame:
    """RES-12: corrections of a seventh of the citations, half of them with an act."""
    asked = _asked(t)
    fixes = asked.where("citation_id % 7 = 0").select(F.col("head").alias("headword"), "raw_bibl", "work_id", F.lit("one").alias("edition"), F.when(F.col("citation_id") % 2 == 0, F.col("act")).alias("act"), F.lit(None).cast("int").alias("scene"), F.col("line").alias("line_number"), F.lit(0.99).alias("confidence"))
    editions = t.spark.createDataFrame([(1, "one")], "id long, short_code string")
    found = citations.manual_corrections(fixes, asked.select(F.col("citation_id").alias("id"), F.col("head").alias("headword"), "raw_bibl"), _lined(t), editions, _no_matches(t))
    return found.select("citation_id", "text_line_id", "confidence")


@query(f"""WITH l AS ({LINED}), c AS (SELECT id, w, 1 + w % 3 AS a, line FROM ({ASKED})), g AS (SELECT work_id, act, scene, min(line_number) AS lo, max(line_number) AS hi, list(DISTINCT line_number) AS ns FROM l GROUP BY 1, 2, 3),
r AS (SELECT id, scene, CASE WHEN list_contains(ns, line) THEN (1, 0) WHEN line BETWEEN lo AND hi THEN (2, 0) WHEN hi >= line THEN (3, list_min(list_filter(ns, lambda x: x >= line))) END AS r FROM c JOIN g ON work_id = w AND act = a)
SELECT id, arg_min(scene, (r, scene)) AS scene FROM r WHERE r IS NOT NULL GROUP BY 1""")
def given_missing_scenes(t: Tables) -> DataFrame:
    """RES-03, AGG-08, JN-15: the scene of citations that give act and line."""
    asked = _asked(t).select(F.col("citation_id").alias("id"), "work_id", "act", F.lit(None).cast("int").alias("scene"), "line")
    return citations.missing_scenes(asked, _lined(t))


@query("""WITH p AS (SELECT s_name AS prefix, s_suppkey AS work FROM supplier UNION ALL SELECT 'supplier#' || repeat('0', 7), 9999), c AS (SELECT o_orderkey AS id, 'SUPPLIER#' || lpad((o_custkey % 300)::VARCHAR, 9, '0') || ' p. ' || (o_orderkey % 77) AS raw, CASE WHEN o_orderkey % 2 = 0 THEN 5 END AS w, CASE WHEN o_orderkey % 3 = 0 THEN 8 END AS l FROM orders),
b AS (SELECT id, arg_max(work, (length(prefix), prefix)) AS work FROM c JOIN p ON starts_with(lower(raw), lower(prefix)) WHERE w IS NULL GROUP BY 1)
SELECT id, coalesce(w, work)::BIGINT AS work_id, CASE WHEN w IS NULL AND work IS NOT NULL THEN coalesce(l, id % 77) ELSE l END::INT AS line FROM c LEFT JOIN b USING (id)""")
def given_prefixes(t: Tables) -> DataFrame:
    """RES-02, FLT-08: orders cite suppliers by name, in capitals; the longest prefix gives the work, the last number the line."""
    k = F.col("o_orderkey")
    raw = F.concat(F.lit("SUPPLIER#"), F.lpad((F.col("o_custkey") % 300).cast("string"), 9, "0"), F.lit(" p. "), (k % 77).cast("string"))
    c = t.orders.select(k.alias("id"), raw.alias("raw_bibl"), F.when(k % 2 == 0, 5).cast("long").alias("work_id"), F.when(k % 3 == 0, 8).alias("line"))
    known = t.supplier.select(F.col("s_name").alias("prefix"), F.col("s_suppkey").alias("work_id")).unionByName(t.spark.createDataFrame([("supplier#" + "0" * 7, 9999)], "prefix string, work_id long"))
    return citations.assign_work_by_prefix(c, known).select("id", "work_id", F.col("line").cast("int").alias("line"))


@query("""WITH n AS (SELECT DISTINCT c_nationkey AS w, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN substr(c_mktsegment, 1, 4) ELSE 'x' || c_custkey END AS q FROM customer),
c AS (SELECT c_custkey AS id, c_nationkey AS w, lower(c_name) AS cid, lower('Old ' || c_mktsegment) AS nm, lower(c_mktsegment) AS ab FROM customer),
t AS (SELECT n.w, n.q, id, CASE WHEN cid = lower(q) THEN 1 WHEN nm = lower(q) THEN 2 WHEN ab = lower(q) THEN 3 WHEN starts_with(nm, lower(q)) THEN 4 WHEN contains(' ' || nm, ' ' || lower(q)) THEN 5 END AS tier FROM n JOIN c ON c.w = n.w)
SELECT w::BIGINT AS work_id, q AS char_name, arg_min(id, (tier, id)) AS character_id FROM t WHERE tier IS NOT NULL GROUP BY 1, 2""")
def given_characters(t: Tables) -> DataFrame:
    """RES-16, JN-10: customers as characters of their nation's play, found by name, abbreviation or a part of it."""
    c = t.customer.withColumn("w", F.col("c_nationkey").cast("long"))
    k = F.col("c_custkey") % 4
    said_by = F.when(k == 0, F.col("c_name")).when(k == 1, F.lower("c_mktsegment")).when(k == 2, F.substring("c_mktsegment", 1, 4)).otherwise(F.concat(F.lit("x"), F.col("c_custkey").cast("string")))
    people = c.select(F.col("c_custkey").alias("id"), F.col("w").alias("work_id"), F.col("c_name").alias("char_id"), F.concat(F.lit("Old "), "c_mktsegment").alias("name"), F.col("c_mktsegment").alias("abbrev"))
    return citations.resolve_characters(c.select(F.col("w").alias("work_id"), said_by.alias("char_name")), people)


@query("""WITH w AS (SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN p_brand || '.' WHEN p_partkey % 3 = 1 THEN p_brand END AS ab FROM part),
k AS (SELECT DISTINCT ab, title FROM w WHERE ab IS NOT NULL), e AS (SELECT unnest([k.ab, rtrim(k.ab, '.'), rtrim(k.ab, '.') || '.']) AS abbrev, w.id FROM k JOIN w ON w.title = k.title)
SELECT abbrev, min(id) AS work_id FROM e GROUP BY 1""")
def given_abbreviations(t: Tables) -> DataFrame:
    """RES-01: brands as abbreviations of parts, with and without a full stop; parts of one name share theirs."""
    k = F.col("p_partkey") % 3
    works = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(k == 0, F.concat("p_brand", F.lit("."))).when(k == 1, F.col("p_brand")).alias("schmidt_abbrev"))
    return citations.abbreviation_table(works)


# ---- lists


@query(f"""WITH d AS (SELECT DISTINCT conv_id AS work_id, scene, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 2 END AS e FROM ({SAID}) UNION ALL SELECT conv_id, 99, 1 FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT d.work_id, 1::BIGINT AS edition_id, d.scene, (SELECT count(*) FROM ({SAID}) l WHERE d.e = 1 AND l.conv_id = d.work_id AND l.scene = d.scene) AS line_count FROM d WHERE d.e = 1""")
def given_contents(t: Tables) -> DataFrame:
    """API-05, AGG-13, AGG-19: scenes of each conversation's lowest edition, with their lines counted; one scene of each has none."""
    lines = checkpointed(said(t).select(F.col("conv_id").alias("work_id"), F.when(F.col("conv_id") % 2 == 0, 1).otherwise(2).cast("long").alias("edition_id"), F.lit(1).alias("act"), "scene"))
    more = t.conversations.select(F.col("conv_id").alias("work_id"), F.lit(1).cast("long").alias("edition_id"), F.lit(1).alias("act"), F.lit(99).alias("scene")).distinct()
    parts = views.divisions(lines).drop("line_count").unionByName(more)
    return views.table_of_contents(parts, lines).select("work_id", "edition_id", "scene", "line_count")


@query("""WITH s AS (SELECT DISTINCT conv_id AS work_id, (turn % 2)::INT AS act, (turn // 2)::INT AS scene FROM conversations)
SELECT work_id, act, scene, lag(act) OVER w AS previous_act, lag(scene) OVER w AS previous_scene, lead(act) OVER w AS next_act, lead(scene) OVER w AS next_scene FROM s WINDOW w AS (PARTITION BY work_id ORDER BY act, scene)""")
def given_adjacent_scenes(t: Tables) -> DataFrame:
    """API-19, WIN-09: the scenes before and after each."""
    s = t.conversations.select(F.col("conv_id").alias("work_id"), (F.col("turn") % 2).cast("int").alias("act"), F.floor(F.col("turn") / 2).cast("int").alias("scene")).distinct()
    both = views.adjacent_scenes(s)
    return both.select("work_id", "act", "scene", *[F.col(f"{a}.{b}").alias(f"{a}_{b}") for a in ("previous", "next") for b in ("act", "scene")])


@query("""SELECT r_regionkey::BIGINT AS source_id, r_name AS name, n_name AS text, (n_nationkey % 2 = 0) AS required FROM nation JOIN region ON r_regionkey = n_regionkey
WHERE r_regionkey IN (SELECT s_nationkey % 5 FROM supplier WHERE s_acctbal > 9000) OR r_name = 'ASIA'""")
def given_attributions(t: Tables) -> DataFrame:
    """API-03, OTH-03, JN-06: nations as attributions of regions: those that suppliers of great balance refer to, and one that is named."""
    sources = t.region.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"), F.col("r_name").alias("short_code"))
    says = t.nation.select(F.col("n_regionkey").cast("long").alias("source_id"), F.col("n_name").alias("text"), (F.col("n_nationkey") % 2 == 0).alias("required"))
    editions = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).cast("long").alias("source_id"))
    lines = t.supplier.where("s_acctbal > 9000").select(F.col("s_suppkey").alias("edition_id"))
    return views.footer_attributions(says, sources, editions, lines, ["ASIA"]).select("source_id", "name", "text", "required")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 4 < 2 THEN 'plays' ELSE 'poetry' END AS kind, replace(p_name, ' ', '-') || '-' || p_partkey AS slug FROM part WHERE p_size % 4 < 3""")
def given_works(t: Tables) -> DataFrame:
    """API-04, API-07, FLT-19: parts as works with slugs, by type; other types are left out."""
    kind = F.element_at(F.array(*map(F.lit, ("comedy", "tragedy", "poem", "essay"))), (F.col("p_size") % 4 + 1).cast("int"))
    works = t.part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("title"), kind.alias("work_type"))
    return views.works_list(works).select("id", "kind", "slug")


@query("""SELECT DISTINCT l_partkey AS work_id, s_suppkey AS id, s_name AS name, n_name AS source_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey % 2 = 0""")
def given_editions(t: Tables) -> DataFrame:
    """API-06: suppliers as editions of the parts that they supply, with their source if it is known."""
    editions = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("source_id"))
    sources = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    lines = t.lineitem.select(F.col("l_partkey").alias("work_id"), F.col("l_suppkey").alias("edition_id"))
    return views.editions_of_works(editions, sources, lines).select("work_id", "id", "name", "source_name")


@query("""SELECT l_orderkey AS request, b.r AS row_line, b.t::INT AS tier FROM (SELECT l_orderkey, arg_min({'r': l_partkey, 't': t}, (t, d, l_linenumber > 3, l_partkey)) AS b FROM
(SELECT *, abs(l_linenumber - 3) AS d, CASE WHEN l_linenumber = 3 THEN 1 WHEN abs(l_linenumber - 3) <= 5 THEN 2 ELSE 3 END AS t FROM lineitem WHERE l_suppkey % 2 = 0) GROUP BY 1)""")
def given_locate(t: Tables) -> DataFrame:
    """API-18: of each order's items the one at the third place, or near it, if its supplier has the word."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("request"), F.lit(3).alias("line"), F.col("l_partkey").alias("row_line"), F.col("l_linenumber").alias("line_number"), (F.col("l_suppkey") % 2 == 0).alias("has_word"))
    return views.locate(rows)


@query("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'it''s ' || c_mktsegment END AS c_mktsegment FROM customer")
def given_statements(t: Tables) -> DataFrame:
    """SNK-06, SNK-07, SRC-01..03: customers as INSERT statements of at most 100 rows and 4,000 bytes, written, and read back by splits."""
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("it's "), "c_mktsegment")).alias("c_mktsegment"))
    path = scratch(t.spark, "statements")
    insert_statements(rows, "customer", 100, 4000).write.text(path)
    r = read_dump_by_split(t.spark, path).where("table_name = 'customer'").select("row")
    get = lambda k: F.get("row", F.lit(k))
    return r.select(get(0).cast("long").alias("c_custkey"), get(1).alias("c_name"), get(2).cast("double").alias("c_acctbal"), get(3).alias("c_mktsegment"))


ROMANS = ("i", "ii", "iii", "iv", "v")
SPACED = Forms(plays=("Hamlet", "Com. of Errors"), sonnets=("Sonnet",), style="spaced", spellings={"Hamlot": "Hamlet"})


@query(f"""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey % 4 AS f, {list(ROMANS)}[o_orderkey % 5 + 1] AS r, o_orderkey % 5 + 1 AS a, o_orderkey % 7 + 1 AS s, o_orderkey % 90 + 1 AS l FROM orders),
n AS (SELECT *, last_value(CASE f WHEN 0 THEN 'Hamlet' WHEN 1 THEN 'Com. of Errors' WHEN 2 THEN 'Sonnet' END IGNORE NULLS) OVER (PARTITION BY c ORDER BY k ROWS UNBOUNDED PRECEDING) AS name FROM o)
SELECT c AS o_custkey, name AS abbrev, CASE WHEN f <> 2 THEN a END::INT AS act, CASE WHEN f <> 2 THEN s END::INT AS scene, l::INT AS line FROM n WHERE name IS NOT NULL""")
def given_concordance(t: Tables) -> DataFrame:
    """PRS-07, WIN-07: orders as lines of a concordance; a misspelt name is mended, and a line without a name goes on under the last one."""
    k = F.col("o_orderkey")
    roman = F.get(F.array(*map(F.lit, ROMANS)), (k % 5).cast("int"))
    place = F.concat_ws("  ", roman, (k % 7 + 1).cast("string"), (k % 90 + 1).cast("string"))
    line = F.when(k % 4 == 0, F.concat(F.lit("some words  Hamlot  "), place)).when(k % 4 == 1, F.concat(F.lit("others  Com.  of  Errors  "), place)).when(k % 4 == 2, F.concat(F.lit("and  Sonnet  "), (k % 90 + 1).cast("string"))).otherwise(F.concat(F.lit("more of it  "), place))
    pages = t.orders.select("o_custkey", F.struct("o_orderkey", line.alias("line")).alias("s")).groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n").alias("text"))
    return pages.select("o_custkey", F.inline(span_column(SPACED)("text"))).select("o_custkey", "abbrev", "act", "scene", "line")


@query("""SELECT o_orderkey, 'Henry V' AS abbrev, (o_orderkey % 5 + 1)::INT AS act, (o_orderkey % 7 + 1)::INT AS scene FROM orders WHERE o_orderkey % 3 < 2""")
def given_slang(t: Tables) -> DataFrame:
    """PRS-08: citations of act and scene in words or in brackets, without lines."""
    k = F.col("o_orderkey")
    roman, scene = F.get(F.array(*map(F.lit, ROMANS)), (k % 5).cast("int")), (k % 7 + 1).cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("1599. Henry V [1599], Act "), roman, F.lit(". Sc. "), scene, F.lit(". A cheat."))).when(k % 3 == 1, F.concat(F.lit("See Henry V ["), roman, F.lit("., "), scene, F.lit(".] for it."))).otherwise("Henry V said nothing.")
    forms = Forms(plays=("Hamlet", "Henry V"), style="act_scene")
    return t.orders.select("o_orderkey", F.inline(span_column(forms)(text))).select("o_orderkey", "abbrev", "act", "scene")
