"""Sources and views on the given tables: conversations are written as files of each format and parsed again; customers, orders and line
items stand for entries, citations and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.operators import citations, views
from stemma.operators.scan import dealt, running
from stemma.plans.registry import Tables, query
from stemma.session import checkpointed, scratch
from stemma.sources import editions, lexicon, splits, tables

#: Lines of conversations: every three turns are a scene; k counts in the scene, n in the conversation.
SAID = r"""SELECT *, row_number() OVER (PARTITION BY conv_id, scene ORDER BY turn, p)::INT AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn, p)::INT AS n FROM (SELECT conv_id, turn, role, p, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line, (turn // 3 + 1)::INT AS scene
FROM (SELECT conv_id, turn, role, unnest(range(1, len(s) + 1)) AS p, unnest(s) AS line FROM (SELECT *, string_split(text, chr(10)) AS s FROM conversations))) WHERE line <> ''"""


def said(t: Tables) -> DataFrame:
    """conv_id, turn, role, p, line, scene, k, n."""
    each = t.conversations.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("q", "raw"))
    lines = each.select("conv_id", "turn", "role", (F.col("q") + 1).alias("p"), F.trim(F.regexp_replace("raw", r"\s+", " ")).alias("line"), (F.floor(F.col("turn") / 3) + 1).cast("int").alias("scene")).where("line <> ''")
    order = ["turn", "p"]
    counted = running(dealt(lines, ["conv_id", "scene"], order), ["conv_id", "scene"], order, {"k": ("count", F.lit(1))})
    return running(dealt(counted, ["conv_id"], order), ["conv_id"], order, {"n": ("count", F.lit(1))})


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def joined(df: DataFrame, keys: list[str], order: list[str], part: Column, name: str) -> DataFrame:
    """The parts of each group, in order, as one text."""
    return df.select(*keys, F.struct(*order, part.alias("_x")).alias("_s")).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["_x"]), "").alias(name))


def tagged(tag: str, inner: Column, **attributes: Column) -> Column:
    """An element as text."""
    return F.concat(F.lit(f"<{tag}"), *[x for k, v in attributes.items() for x in (F.lit(f' {k.rstrip("_")}="'), v.cast("string"), F.lit('"'))], F.lit(">"), inner, F.lit(f"</{tag}>"))


def plays(t: Tables, line: Column, scene: str = "div2", act: str = "div1") -> DataFrame:
    """work_id, xml: a play of each conversation, all of it act 2; every line is a speech."""
    speech = tagged("sp", F.concat(tagged("speaker", F.col("role")), line), who=F.concat(F.lit("#"), "role"))
    scenes = joined(said(t), ["conv_id", "scene"], ["turn", "p"], speech, "body")
    acts = joined(scenes, ["conv_id"], ["scene"], tagged(scene, F.col("body"), type=F.lit("scene"), n=F.col("scene")), "body")
    return acts.select(F.col("conv_id").alias("work_id"), tagged("TEI.2", tagged("text", tagged("body", tagged(act, F.col("body"), type=F.lit("act"), n=F.lit("ii"))))).alias("xml"))


def verse() -> Column:
    return tagged("l", escaped(F.col("line")))


SHOWN = ["work_id", "act", "scene", "line_number", "char_name", "content"]


@query(f"SELECT conv_id AS work_id, 2 AS act, scene, k AS line_number, role AS char_name, line AS content FROM ({SAID})")
def given_globe(t: Tables) -> DataFrame:
    """SRC-06, SRC-14, SRC-16, SCL-20: TEI plays with acts and scenes."""
    return editions.globe_plays(plays(t, verse()), 1).select(*SHOWN)


@query(f"SELECT conv_id AS work_id, 2 AS act, scene, n AS line_number, role AS char_name, line AS content FROM ({SAID})")
def given_folio(t: Tables) -> DataFrame:
    """SRC-06, SRC-17: lines that are numbered over the whole play."""
    return editions.folio_plays(plays(t, verse(), scene="div", act="div"), 2).select(*SHOWN)


@query(f"SELECT 'q1_' || conv_id || '_' || (1590 + conv_id % 30) AS short_code, (1590 + conv_id % 30)::INT AS year, 1 AS act, 1 AS scene, n AS line_number, line AS content FROM ({SAID})")
def given_quartos(t: Tables) -> DataFrame:
    """SRC-21, SRC-22: quartos without divisions, an edition each."""
    files = plays(t, verse()).select("work_id", F.col("work_id").cast("string").alias("oss_id"), (F.lit(1590) + F.col("work_id") % 30).cast("int").alias("year"), "xml")
    made, lines = editions.quarto_plays(files)
    return lines.join(made, lines["edition_id"] == made["id"]).select("short_code", "year", "act", "scene", "line_number", "content")


@query(f"SELECT conv_id AS work_id, 2 AS act, scene, CASE WHEN k % 2 = 1 THEN k ELSE k - 1 END::INT AS line_number, line AS content, len(list_filter(string_split(line, ' '), lambda w: w <> ''))::INT AS words FROM ({SAID})")
def given_words(t: Tables) -> DataFrame:
    """SRC-19, SRC-20, WIN-03: plays whose words are marked up; every other line has no number and takes the largest so far."""
    words = F.array_join(F.transform(F.split("line", " "), lambda w: F.concat(F.lit("<w>"), escaped(w), F.lit("</w>"))), "<c> </c>")
    number = F.when(F.col("k") % 2 == 1, F.concat_ws(".", F.lit("2"), F.col("scene").cast("string"), F.col("k").cast("string"))).otherwise("SD")
    lines, each = editions.word_plays(plays(t, tagged("l", words, n=number)), 3)
    counted = each.groupBy("line_id").agg(F.count("*").cast("int").alias("words"))
    return lines.join(counted, lines["id"] == counted["line_id"]).select("work_id", "act", "scene", "line_number", "content", "words")


@query(f"SELECT conv_id AS work_id, 1 AS act, scene, k AS line_number, role AS char_name, line AS content FROM ({SAID})")
def given_xhtml_plays(t: Tables) -> DataFrame:
    """SRC-09, SRC-10: plays as XHTML tables within JSON."""
    row = tagged("tr", F.concat(tagged("td", F.col("role"), class_=F.lit("persona")), tagged("td", tagged("p", escaped(F.col("line"))))))
    scenes = joined(said(t), ["conv_id", "scene"], ["turn", "p"], row, "body")
    scenes = joined(scenes, ["conv_id"], ["scene"], tagged("section", tagged("table", F.col("body")), id=F.concat(F.lit("scene-1-"), F.col("scene").cast("string"))), "body")
    html = tagged("section", F.col("body"), id=F.lit("act-1"))
    return editions.xhtml_plays(scenes.select(F.col("conv_id").alias("work_id"), F.to_json(F.create_map(F.lit("act-1.xhtml"), html)).alias("json")), 4).select(*SHOWN)


@query(f"SELECT 7::BIGINT AS work_id, (conv_id + 1)::INT AS scene, scene AS stanza, n AS line_number, line AS content FROM ({SAID})")
def given_xhtml_poems(t: Tables) -> DataFrame:
    """SRC-11..13: each conversation as a sonnet's article, its scenes as stanzas."""
    stanzas = joined(said(t), ["conv_id", "scene"], ["turn", "p"], tagged("span", escaped(F.col("line"))), "body")
    article = joined(stanzas, ["conv_id"], ["scene"], tagged("p", F.col("body")), "body").select(tagged("article", F.col("body"), id=F.concat(F.lit("sonnet-"), (F.col("conv_id") + 1).cast("string"))).alias("html"))
    made = editions.xhtml_poetry(article, t.spark.createDataFrame([("sonnet", 7)], "article string, work_id long"), 5)
    return made.select("work_id", "scene", "stanza", "line_number", "content")


@query(f"SELECT conv_id AS work_id, 1 AS act, scene, k AS line_number, line AS content FROM ({SAID})")
def given_tei_poems(t: Tables) -> DataFrame:
    """SRC-15, SRC-16: each scene of a conversation as a TEI sonnet."""
    sonnets = joined(said(t), ["conv_id", "scene"], ["turn", "p"], verse(), "body")
    body = joined(sonnets, ["conv_id"], ["scene"], tagged("div1", tagged("lg", F.col("body")), type=F.lit("sonnet"), n=F.col("scene")), "body")
    files = body.select(F.col("conv_id").alias("work_id"), tagged("TEI.2", tagged("text", tagged("body", F.col("body")))).alias("xml"))
    return editions.tei_poems(files, 6).select("work_id", "act", "scene", "line_number", "content")


@query("""SELECT oss_work_id, act, scene, row_number() OVER (PARTITION BY oss_work_id, act, scene ORDER BY turn, p)::INT AS line_number, char_name, content, CASE WHEN char_name = 'xxx' THEN 'stage_direction' ELSE 'speech' END AS content_type FROM
(SELECT 'c' || conv_id AS oss_work_id, 1 AS act, (turn // 3 + 1)::INT AS scene, turn, p, CASE role WHEN 'system' THEN 'xxx' ELSE role END AS char_name, trim(line) AS content FROM (SELECT conv_id, turn, role, unnest(range(1, len(s) + 1)) AS p, unnest(s) AS line FROM (SELECT *, string_split(text, chr(10)) AS s FROM conversations))) WHERE content <> ''""")
def given_dump(t: Tables) -> DataFrame:
    """SRC-01..05, WIN-02: a dump whose paragraphs are the turns, read by splits; system turns are stage directions."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    who = F.when(F.col("role") == "system", "xxx").otherwise(F.col("role"))
    number = F.col("conv_id") * 1000 + F.col("turn")
    values = [quoted(F.concat(F.lit("c"), F.col("conv_id").cast("string"))), number, F.col("turn"), quoted(who), quoted(F.replace("text", F.lit("\n"), F.lit("\n[p]"))), F.lit("''"), F.lit("''"), F.lit("'b'"), F.lit("1"), F.floor(F.col("turn") / 3) + 1, F.length("text"), F.lit("NULL")]
    row = F.concat(F.lit("INSERT INTO `Paragraphs` VALUES ("), F.concat_ws(",", *[v.cast("string") for v in values]), F.lit(");"))
    path = scratch(t.spark, "works")
    t.conversations.select(row).write.text(path)
    lines = editions.dump_lines(editions.dump_tables(splits.read_dump_by_split(t.spark, path))["paragraphs"], 8)
    return lines.select("oss_work_id", "act", "scene", "line_number", "char_name", "content", "content_type")


# ---- the lexicon

ENTRY = "SELECT o_custkey AS c, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders"


@query(f"""SELECT 'W' || c AS headword, 'shak. ham ' || (o % 5 + 1) || '.' || (o % 7 + 1) || '.' || (o % 200 + 1) AS raw_bibl, k::INT AS sense_number, 'quoted ' || o AS quote_text, 'sense no. ' || k || ': quoted ' || o || ' at H' || o AS definition_text FROM ({ENTRY})""")
def given_lexicon(t: Tables) -> DataFrame:
    """SRC-07, SRC-08, PRS-03, PRS-04: an entry file of each customer with a numbered sense and a citation of each order."""
    o = running(dealt(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"]), ["o_custkey"], ["o_orderkey"], {"k": ("count", F.lit(1))})
    key, s = F.col("o_orderkey"), lambda c: c.cast("string")
    place = F.concat(F.lit("shak. ham "), F.concat_ws(".", s(key % 5 + 1), s(key % 7 + 1), s(key % 200 + 1)))
    sense = F.concat(s(F.col("k")), F.lit(") sense no. "), s(F.col("k")), F.lit(": "), tagged("cit", F.concat(tagged("quote", F.concat(F.lit("quoted "), s(key))), F.lit(" at "), tagged("bibl", F.concat(F.lit("H"), s(key)), n=place))), F.lit(" "))
    bodies = joined(o, ["o_custkey"], ["k"], sense, "body")
    name = F.concat(F.lit("W"), s(F.col("o_custkey")))
    files = bodies.select(F.concat(name, F.lit(".xml")).alias("path"), tagged("TEI.2", tagged("entryFree", F.concat(tagged("orth", name), F.lit(" "), F.col("body")), key=name)).alias("raw"))
    entries, senses, cites = lexicon.lexicon_tables(files.lateralJoin(lexicon.LexiconEntry(F.col("raw").outer())).select("path", "key", "orth", "full_text", "senses", "citations"))
    text = senses.select(F.col("id").alias("sense_id"), "definition_text")
    return cites.join(text, "sense_id").select("headword", "raw_bibl", "sense_number", "quote_text", "definition_text")


# ---- views


def _matches(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("citation_id"), F.col("l_partkey").alias("text_line_id"), F.col("l_linenumber").alias("edition_id"), F.col("l_returnflag").alias("match_type"), F.col("l_discount").alias("confidence"))


def _cites(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entry_id"))


def _entries(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("key"))


@query("SELECT l_partkey AS text_line_id, c_name AS key, l_returnflag AS match_type, l_discount AS confidence FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey")
def given_reverse_lookup(t: Tables) -> DataFrame:
    """API-20: parts as lines, and the customers whose orders hold them."""
    return views.reverse_lookup(_matches(t), _cites(t), _entries(t))


@query("""SELECT DISTINCT l_partkey AS text_line_id, 'lexicon' AS source, c_name AS headword, c_custkey AS entry_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT DISTINCT l_partkey, 'nations', n_name, n_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey""")
def given_line_references(t: Tables) -> DataFrame:
    """API-14: for each part the customers and the suppliers' nations that refer to it, once each."""
    ref = t.lineitem.select(F.col("l_suppkey").alias("citation_id"), F.col("l_partkey").alias("text_line_id"))
    nations = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.lit("nations").alias("source"), F.col("n_name").alias("headword"))
    out = views.line_references(_matches(t), _cites(t), _entries(t), ref, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("entry_id")), nations)
    return out.select("text_line_id", F.inline("references")).select("text_line_id", "source", "headword", "entry_id")


@query("""SELECT citation_id, b.l AS text_line_id, b.e AS edition_id, b.c AS confidence FROM
(SELECT l_orderkey AS citation_id, arg_min({'e': l_linenumber, 'l': l_partkey, 'c': l_discount}, (CASE WHEN l_linenumber = 2 THEN 0 ELSE 1 END, -l_discount, l_linenumber, l_partkey)) AS b FROM lineitem GROUP BY 1)""")
def given_best_match(t: Tables) -> DataFrame:
    """JN-04: the best item of each order, of the preferred number first."""
    return views.best_match(_matches(t), 2).select("citation_id", "text_line_id", "edition_id", "confidence")


@query("""SELECT 'lexicon' AS source, count(DISTINCT c_mktsegment) AS n FROM customer UNION ALL SELECT n_name, count(*) FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""")
def given_source_counts(t: Tables) -> DataFrame:
    """API-16, AGG-04: entries of each source."""
    refs = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("source"))
    return views.source_counts(t.customer.select(F.col("c_mktsegment").alias("base_key")), refs, t.nation.select(F.col("n_name").alias("short_code")))


@query("""SELECT 'lines' AS what, n_name AS name, count(*) AS n, NULL::DOUBLE AS mean FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 2
UNION ALL SELECT 'matches', l_returnflag, count(*), round(avg(l_discount), 3) FROM lineitem GROUP BY 2""")
def given_build_summary(t: Tables) -> DataFrame:
    """OTH-12, AGG-06: rows of each edition and of each type of match."""
    lines, matches = views.build_summary(t.customer.select(F.col("c_nationkey").alias("edition_id")), t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("short_code")), _matches(t))
    return lines.select(F.lit("lines").alias("what"), F.col("short_code").alias("name"), F.col("lines").alias("n"), F.lit(None).cast("double").alias("mean")).unionByName(matches.select(F.lit("matches").alias("what"), F.col("match_type").alias("name"), "n", F.col("mean_confidence").alias("mean")))


@query("""WITH c AS (SELECT o_orderkey AS id, o_custkey % 40 AS w, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 5 END AS a, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 7 END AS s, CASE WHEN o_orderkey % 5 < 2 THEN NULL ELSE o_orderkey % 99 END AS l, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'q' END AS q FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)),
b AS (SELECT id, CASE WHEN w < 4 THEN 'no work' WHEN a IS NULL AND s IS NULL AND l IS NULL THEN 'no location' WHEN l IS NULL AND q = '' THEN 'no line and no quote' WHEN l IS NULL THEN 'no line' WHEN s IS NULL THEN 'no scene' WHEN q = '' THEN 'no quote' ELSE 'text not found' END AS bucket FROM c)
SELECT bucket, count(*) AS n, array_to_string(list_sort(list(id))[1:10], ',') AS samples FROM b GROUP BY 1""")
def given_unmatched(t: Tables) -> DataFrame:
    """AGG-18: orders without a large item as unmatched citations, by cause, with the first ten of each."""
    k = F.col("o_orderkey")
    none = F.lit(None)
    c = t.orders.select(k.alias("id"), F.when(F.col("o_custkey") % 40 >= 4, F.col("o_custkey") % 40).alias("work_id"), F.when(k % 3 == 0, none).otherwise(k % 5).alias("act"), F.when(k % 4 == 0, none).otherwise(k % 7).alias("scene"), F.when(k % 5 < 2, none).otherwise(k % 99).alias("line"), F.when(k % 2 == 0, "").otherwise("q").alias("quote_text"), k.cast("string").alias("raw_bibl"))
    found = citations.unmatched_report(c, t.lineitem.where("l_quantity > 25").select(F.col("l_orderkey").alias("citation_id")))
    return found.select("bucket", "n", F.array_join(F.transform("samples", lambda s: s["id"].cast("string")), ",").alias("samples"))


CAP = 3000


@query(f"""WITH d AS (SELECT c_nationkey, list(c_name ORDER BY c_name) AS l FROM customer GROUP BY 1),
k AS (SELECT *, list_transform(list_concat(list_transform(range(0, 12), lambda i: len(l) // (1 << i)), [0]), lambda n: '{{"nation":' || c_nationkey || ',"references":[' || array_to_string(list_transform(l[1:n], lambda x: '"' || x || '"'), ',') || ']}}') AS t FROM d)
SELECT c_nationkey AS nation, coalesce(list_filter(t, lambda x: strlen(x) <= {CAP})[1], t[-1]) AS data FROM k""")
def given_capped_documents(t: Tables) -> DataFrame:
    """API-21: a document of each nation's customers of at most so many bytes."""
    docs = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.array_sort(F.collect_list("c_name")).alias("references"))
    return views.capped_documents(docs, "references", CAP)


@query("""SELECT m AS base_key, (SELECT count(*) FROM customer WHERE c_mktsegment = m) AS entries, (SELECT count(DISTINCT (o_orderstatus, o_orderkey % 50)) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = m) AS citations,
(SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = m AND o_orderkey % 10 = 0) AS senses FROM (SELECT DISTINCT c_mktsegment AS m FROM customer)""")
def given_entry_documents(t: Tables) -> DataFrame:
    """API-10, API-11: a document of each market segment: its customers as entries, orders as citations, once for each place, some as senses."""
    entries = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("base_key"), F.col("c_name").alias("key"), F.col("c_name").alias("full_text"))
    o, none = t.orders, F.lit(None)
    senses = o.where("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("entry_id"), (F.col("o_orderkey") % 100).cast("int").alias("sense_number"), none.cast("string").alias("sub_sense"), F.col("o_orderkey").cast("string").alias("definition_text"))
    cites = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entry_id"), F.ascii("o_orderstatus").cast("long").alias("work_id"), none.cast("int").alias("act"), none.cast("int").alias("scene"), (F.col("o_orderkey") % 50).cast("int").alias("line"), F.lit("").alias("quote_text"), F.lit("").alias("display_text"))
    refs = t.nation.select(F.lit("nations").alias("source"), F.col("n_name").alias("headword"), F.col("n_name").alias("raw_text"))
    docs = views.entry_documents(entries, senses, cites, _matches(t), refs)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long").alias(c)
    return docs.select("base_key", size("entries"), size("citations"), size("senses"))


@query(f"""WITH l AS ({SAID}), a AS (SELECT conv_id, scene, k FROM l WHERE n % 10 = 0)
SELECT a.conv_id AS work_id, a.scene, a.k AS at, l.k AS line_number, l.line AS content FROM a JOIN l ON l.conv_id = a.conv_id AND l.scene = a.scene AND abs(l.k - a.k) <= 5""")
def given_passages(t: Tables) -> DataFrame:
    """API-20: the lines around every tenth line of a conversation, within its scene."""
    lines = checkpointed(said(t).select(F.xxhash64("conv_id", "n").alias("id"), F.col("conv_id").alias("work_id"), F.lit(1).alias("edition_id"), F.lit(1).alias("act"), "scene", F.col("k").alias("line_number"), F.col("line").alias("content"), "n"))
    at = lines.where("n % 10 = 0").select(F.col("id").alias("line_id"), "work_id", "scene", F.col("line_number").alias("at"))
    return views.passage(lines.drop("n"), at).join(at, "line_id").select("work_id", "scene", "at", "line_number", "content")


@query(f"""WITH l AS ({SAID}), c AS (SELECT o_orderkey AS id, o_custkey % 100 AS w, CASE WHEN o_orderkey % 3 > 0 THEN 1 END AS a, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 + 1 END AS s, o_orderkey % 60 AS line FROM orders),
f AS (SELECT c.*, CASE WHEN a IS NOT NULL AND EXISTS (SELECT 1 FROM l WHERE conv_id = w AND scene = s) THEN 1 WHEN a IS NOT NULL THEN 2 WHEN s IS NOT NULL THEN 3 ELSE 4 END AS v FROM c),
m AS (SELECT f.id, l.n, row_number() OVER (PARTITION BY f.id ORDER BY abs(l.k - f.line), l.scene, l.k, l.n) AS rn FROM f JOIN l ON l.conv_id = f.w AND abs(l.k - f.line) <= 10 AND (v NOT IN (1, 3) OR l.scene = f.s))
SELECT id AS citation_id, n::BIGINT AS text_line_id FROM m WHERE rn = 1""")
def given_reference_matches(t: Tables) -> DataFrame:
    """RES-14, JN-12: orders as citations of conversations' lines: nearest in the scene, the act or the work."""
    k = F.col("o_orderkey")
    c = t.orders.select(k.alias("id"), (F.col("o_custkey") % 100).alias("work_id"), F.when(k % 3 > 0, 1).alias("act"), F.when(k % 2 == 0, (k % 4 + 1).cast("int")).alias("scene"), (k % 60).cast("int").alias("line"))
    lines = said(t).select(F.col("n").cast("long").alias("id"), F.col("conv_id").alias("work_id"), F.lit(1).alias("edition_id"), F.lit(1).alias("act"), "scene", F.col("k").alias("line_number"), F.col("line").alias("content"))
    return citations.reference_matches(c, lines).select("citation_id", "text_line_id")


@query("""WITH c AS (SELECT o_orderkey AS id, o_custkey % 20 AS w, CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS a, CASE WHEN o_orderkey % 3 = 0 THEN 2 END AS s, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 8)::INT END AS l FROM orders WHERE o_custkey % 20 < 6)
SELECT nullif(w, 0)::BIGINT AS work_id, nullif(a, 0) AS act, nullif(s, 0) AS scene, coalesce(l, 1) AS line_number, arg_min('[' || id || '] h' || id, id) AS content, 0::BIGINT AS edition_id FROM c WHERE w > 0 GROUP BY 1, 2, 3, 4""")
def given_external_lines(t: Tables) -> DataFrame:
    """SRC-29: a stub line for each place that orders cite in external works."""
    k = F.col("o_orderkey")
    cites = t.orders.where("o_custkey % 20 < 6").select(k.alias("id"), (F.col("o_custkey") % 20).alias("work_id"), F.when(k % 2 == 0, 1).alias("act"), F.when(k % 3 == 0, 2).alias("scene"), F.when(k % 5 > 0, (k % 8).cast("int")).alias("line"), k.cast("string").alias("raw_bibl"), F.concat(F.lit("h"), k.cast("string")).alias("headword"))
    works = t.spark.range(1, 6).select("id")
    return tables.external_lines(cites, cites.limit(0), works).select("work_id", "act", "scene", "line_number", "content", "edition_id")
