"""String functions, similarity, search, citations in text, and documents, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions import text as tx
from stemma.functions.normalize import norm_chain, norm_chain_sql, normalize
from stemma.functions.similarity import aligned_threshold, hybrid, jaccard, trigram_cosine, trigram_cosine_builtin, with_affinity, words
from stemma.operators import fts
from stemma.plans.registry import Tables, query
from stemma.session import checkpointed, small_side
from stemma.sources.citation_text import Forms, span_column
from stemma.sources.markup import html_text_lines
from stemma.sources.sqldump import document_lines

LINES = "SELECT doc_id, unnest(range(1, len(s) + 1))::INT AS line_no, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)"
SHORT = "SELECT conv_id, turn, text FROM conversations"


@query(f"SELECT doc_id, line_no, line FROM ({LINES}) WHERE trim(line) <> ''")
def doc_lines(t: Tables) -> DataFrame:
    """SRC-05: lines of documents."""
    return document_lines(t.documents)


@query(f"SELECT conv_id, turn, {norm_chain_sql('text')} AS norm FROM ({SHORT})")
def norm_basic(t: Tables) -> DataFrame:
    """SCL-01 by built-in functions."""
    return t.conversations.select("conv_id", "turn", norm_chain(F.col("text")).alias("norm"))


@query()
def norm_exact(t: Tables) -> DataFrame:
    """SCL-01 exactly (elisions in one pass), over Arrow batches."""
    return t.conversations.select("conv_id", "turn", normalize("text").alias("norm"))


@query(f"SELECT doc_id, line_no, len(list_filter(regexp_extract_all(line, '[^\\s]+'), lambda x: x <> ''))::INT AS n FROM ({LINES}) WHERE trim(line) <> ''")
def word_count(t: Tables) -> DataFrame:
    """SCL-18."""
    return document_lines(t.documents).select("doc_id", "line_no", tx.word_count(F.col("line")).alias("n"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' & ' || p_type), '[^\p{L}\p{Nd}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slugify(t: Tables) -> DataFrame:
    """SCL-08."""
    return t.part.select("p_partkey", tx.slugify(F.concat("p_name", F.lit(" & "), "p_type")).alias("slug"))


@query(r"SELECT c_custkey, CASE WHEN regexp_full_match(c_name, '\p{Nd}*') THEN c_name ELSE regexp_replace(c_name, '\p{Nd}+$', '') END AS stripped FROM customer")
def strip_sense(t: Tables) -> DataFrame:
    """SCL-06."""
    return t.customer.select("c_custkey", tx.strip_sense_number(F.col("c_name")).alias("stripped"))


@query(r"SELECT doc_id, CASE WHEN regexp_extract(source, '^(.*?[^0-9])[0-9]+$', 1) <> '' THEN regexp_extract(source, '^(.*?[^0-9])[0-9]+$', 1) ELSE source END AS base_key, try_cast(nullif(regexp_extract(source, '[^0-9]([0-9]+)$', 1), '') AS INT) AS sense_group FROM documents")
def split_sense(t: Tables) -> DataFrame:
    """SCL-07."""
    base, group = tx.split_sense_key(F.col("source"))
    return t.documents.select("doc_id", base.alias("base_key"), group.alias("sense_group"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS head FROM documents")
def truncate_ellipsis(t: Tables) -> DataFrame:
    """SCL-26."""
    return t.documents.select("doc_id", tx.truncate(F.col("text"), 200).alias("head"))


@query(r"SELECT doc_id, CASE WHEN regexp_full_match(upper(substr(trim(text), 1, 1)), '\p{L}') THEN upper(substr(trim(text), 1, 1)) ELSE '?' END AS letter FROM documents")
def first_letter(t: Tables) -> DataFrame:
    """SCL-19."""
    return t.documents.select("doc_id", tx.first_letter(F.col("text")).alias("letter"))


@query(rf"SELECT doc_id, line_no, regexp_matches(line, '\p{{L}}') AND upper(line) = line AS caps, regexp_full_match(trim(line), '[0-9]{{1,4}}') AS page_number FROM ({LINES}) WHERE trim(line) <> ''")
def all_caps(t: Tables) -> DataFrame:
    """SCL-19."""
    return document_lines(t.documents).select("doc_id", "line_no", tx.is_all_caps(F.col("line")).alias("caps"), tx.is_page_number(F.col("line")).alias("page_number"))


ROMAN = ["XIV", "mcmxc", "IIII", "abc", "CDXLIV"]


@query("SELECT n_nationkey, ['XIV', 'mcmxc', 'IIII', 'abc', 'CDXLIV'][1 + n_nationkey % 5] AS roman, [14, 1990, 4, 0, 444][1 + n_nationkey % 5]::INT AS value, (n_nationkey % 5 <> 3) AS is_roman FROM nation")
def roman_to_int(t: Tables) -> DataFrame:
    """SCL-13, SCL-14."""
    r = t.nation.select("n_nationkey", F.element_at(F.array(*map(F.lit, ROMAN)), (1 + F.col("n_nationkey") % 5).cast("int")).alias("roman"))
    return r.select("n_nationkey", "roman", tx.roman_to_int(F.col("roman")).alias("value"), tx.is_roman(F.col("roman")).alias("is_roman"))


@query(r"SELECT c_custkey, CASE WHEN regexp_full_match(split_part(c_name, '#', 2), '[0-9]+') THEN split_part(c_name, '#', 2)::INT ELSE 0 END AS number, coalesce(try_cast(nullif(regexp_extract(c_name || ' 12 x', '([0-9]+) x', 1), '') AS INT), 0) AS last_number, 56::INT AS line FROM customer")
def numbers_in_text(t: Tables) -> DataFrame:
    """SCL-15, SCL-16, SCL-17."""
    return t.customer.select("c_custkey", tx.strict_atoi(F.split_part("c_name", F.lit("#"), F.lit(2))).alias("number"), tx.trailing_number(F.concat("c_name", F.lit(" 12 x"))).alias("last_number"), tx.folger_line(F.lit("3.1.56")).alias("line"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean, replace(replace(text, 'ä', 'ä'), 'ſ', 's') AS plain, trim(translate(trim(text), '\"*-+', '')) AS q FROM conversations")
def clean_strings(t: Tables) -> DataFrame:
    """SCL-10, SCL-12, SCL-25."""
    return t.conversations.select("conv_id", "turn", tx.clean_text(F.col("text")).alias("clean"), F.replace("text", F.lit("ſ"), F.lit("s")).alias("plain"), tx.sanitize_search(F.col("text")).alias("q"))


@query("SELECT n_nationkey, replace(replace(replace(replace(replace('Cæsar ' || n_name || ' Œdipus ſo', 'æ', 'ae'), 'Æ', 'Ae'), 'œ', 'oe'), 'Œ', 'Oe'), 'ſ', 's') AS plain FROM nation")
def ligatures(t: Tables) -> DataFrame:
    """SCL-11."""
    return t.nation.select("n_nationkey", tx.normalize_ligatures(F.concat(F.lit("Cæsar "), "n_name", F.lit(" Œdipus ſo"))).alias("plain"))


@query()
def html_entities(t: Tables) -> DataFrame:
    """SCL-09."""
    return t.pages.select("page_id", tx.decode_entities(F.concat(F.lit("&#233;&#x41;&#0; "), "html")).alias("text"))


@query("SELECT p_partkey, list_filter(list_transform(string_split(replace(p_name || '...' || p_type || '… ' || p_brand, '…', '...'), '...'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM part")
def ellipsis_parts(t: Tables) -> DataFrame:
    """SCL-21."""
    return t.part.select("p_partkey", tx.split_ellipsis(F.concat("p_name", F.lit("..."), "p_type", F.lit("… "), "p_brand")).alias("parts"))


@query()
def expansions(t: Tables) -> DataFrame:
    """SCL-22, SCL-23."""
    key = F.lower(F.split_part("p_type", F.lit(" "), F.lit(-1)))
    return t.part.select("p_partkey", tx.expand_quote(F.concat(F.substring(key, 1, 1), F.lit(". of it --s")), key).alias("quote"), tx.expand_definition(F.lit("adj. --ed, --ing"), key).alias("definition"))


@query(r"SELECT n_nationkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace('to ' || n_name || ' ( , ) , ; here  .', '\(\s*[,;:.]*\s*\)', '', 'g'), '\s+([,;:.!?)])', '\1', 'g'), '([,;:])(\s*[,;:])+', '\1', 'g'), '\s+', ' ', 'g')) AS definition FROM nation")
def clean_definitions(t: Tables) -> DataFrame:
    """SCL-24."""
    return t.nation.select("n_nationkey", tx.clean_definition(F.concat(F.lit("to "), "n_name", F.lit(" ( , ) , ; here  ."))).alias("definition"))


@query("SELECT o_orderkey, concat_ws(' ', o_orderstatus, nullif(concat_ws('.', CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 5 END, CASE WHEN o_orderkey % 2 > 0 THEN o_orderkey % 7 END), '')) AS label FROM orders")
def reference_labels(t: Tables) -> DataFrame:
    """SCL-30."""
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", tx.reference_label(F.col("o_orderstatus"), F.when(k % 3 > 0, k % 5), F.when(k % 2 > 0, k % 7), F.lit(None)).alias("label"))


@query("""SELECT c_custkey, coalesce(m.v, c_mktsegment) AS resolved FROM customer LEFT JOIN (VALUES ('BUILDING', 'bldg'), ('MACHINERY', 'mach')) m(k, v) ON m.k = c_mktsegment""")
def abbreviations(t: Tables) -> DataFrame:
    """SCL-28."""
    dim = t.spark.createDataFrame([("BUILDING", "bldg"), ("MACHINERY", "mach")], "abbr string, value string")
    return tx.translate_abbreviation(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", dim, "abbr", "value").select("c_custkey", "resolved")


WORDS = r"list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query(f"""WITH b AS (SELECT item_id, {WORDS.format('text')} AS bw FROM benchmark), s AS (SELECT DISTINCT item_id, unnest(bw) AS w FROM b),
d AS (SELECT doc_id, line_no, {WORDS.format('line')} AS dw FROM ({LINES})), e AS (SELECT doc_id, line_no, len(dw) AS n, unnest(dw) AS w FROM d),
c AS (SELECT item_id, doc_id, line_no, any_value(n) AS n, count(*) AS i FROM s JOIN e USING (w) GROUP BY 1, 2, 3)
SELECT item_id, doc_id, line_no, round(i / (len(bw) + n - i), 6) AS jaccard FROM c JOIN b USING (item_id) WHERE i / (len(bw) + n - i) >= 0.3""")
def jaccard_bench_docs(t: Tables) -> DataFrame:
    """SIM-01: passages against lines. A line with a similarity of 0.3 shares three tenths of a passage's words, so one at least of all but
    its three tenths most frequent: lines meet passages by these alone, and pairs are counted on whole sets."""
    words_of = lambda c: F.array_distinct(fts.plain_tokens(c))
    b = t.benchmark.select("item_id", words_of("text").alias("bw"))
    l = document_lines(t.documents).select("doc_id", "line_no", words_of("line").alias("dw"))
    every = b.select("item_id", F.size("bw").alias("m"), F.explode("bw").alias("w"))
    wanted = small_side(every.select("w").distinct(), 100_000)
    often = l.select(F.explode("dw").alias("w")).join(wanted, "w").groupBy("w").agg(F.count("*").alias("df"))
    held = every.join(often, "w").groupBy("item_id", "m").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("ws"))
    # Words that no line has come first, and need no place.
    rare = F.col("m") - F.ceil(F.col("m") * 0.3 - 1e-9) + 1 - (F.col("m") - F.size("ws"))
    keys = checkpointed(held.where(rare >= 1).select("item_id", "m", F.explode(F.slice("ws", 1, rare.cast("int"))).alias("x")).select("item_id", "m", F.col("x.w").alias("w")))
    e = l.select("doc_id", "line_no", F.size("dw").alias("n"), F.explode("dw").alias("w"))
    met = e.join(small_side(keys, 100_000), "w").where((F.col("n") * 10 >= F.col("m") * 3) & (F.col("m") * 10 >= F.col("n") * 3))
    # A line with i of the keys has at most the frequent words besides: few pairs are left to be counted on whole sets.
    n_keys = keys.groupBy("item_id").agg(F.count("*").alias("k"))
    near = met.groupBy("item_id", "doc_id", "line_no", "m", "n").agg(F.count("*").alias("i")).join(small_side(n_keys, 20_000), "item_id")
    most = F.least(F.col("i") + F.col("m") - F.col("k"), F.col("n"))
    near = near.where(most / (F.col("m") + F.col("n") - most) >= 0.3).drop("i", "k")
    both = near.join(l, ["doc_id", "line_no"]).join(small_side(b, 20_000), "item_id").withColumn("i", F.size(F.array_intersect("bw", "dw")))
    j = F.col("i") / (F.col("m") + F.col("n") - F.col("i"))
    return both.where(j >= 0.3).select("item_id", "doc_id", "line_no", F.round(j, 6).alias("jaccard"))


@query(f"""WITH p AS (SELECT a.conv_id, a.turn, {WORDS.format('a.text')} AS x, {WORDS.format('b.text')} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard FROM p""")
def jaccard_turns(t: Tables) -> DataFrame:
    """SIM-01 of neighbouring turns, with the rules for empty sets."""
    c = t.conversations.select("conv_id", "turn", F.array_distinct(fts.plain_tokens("text")).alias("w"))
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return c.join(n, ["conv_id", "turn"]).select("conv_id", "turn", F.round(jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


COS = """WITH p AS (SELECT a.p_partkey, replace(a.p_name, ' ', '') AS x, replace(a.p_type || 'ing', ' ', '') AS y FROM part a),
g AS (SELECT p_partkey, list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3)) AS gx, list_transform(range(1, length(y) - 1), lambda i: substr(y, i, 3)) AS gy FROM p),
n AS (SELECT p_partkey, list_sum(list_transform(list_distinct(gx), lambda u: pow(len(list_filter(gx, lambda v: v = u)), 2))) AS nx, list_sum(list_transform(list_distinct(gy), lambda u: pow(len(list_filter(gy, lambda v: v = u)), 2))) AS ny,
 coalesce(list_sum(list_transform(list_intersect(list_distinct(gx), list_distinct(gy)), lambda u: len(list_filter(gx, lambda v: v = u)) * len(list_filter(gy, lambda v: v = u)))), 0) AS dot FROM g)
SELECT p_partkey, round(dot / sqrt(nx * ny), 6) AS cosine FROM n"""


@query(COS, "trigram_cosine")
def trigram_cosine_(t: Tables) -> DataFrame:
    """SIM-02 by built-in functions."""
    return t.part.select("p_partkey", F.round(trigram_cosine_builtin(F.col("p_name"), F.concat("p_type", F.lit("ing"))), 6).alias("cosine"))


@query()
def hybrid_turns(t: Tables) -> DataFrame:
    """SIM-02..05: the similarity of neighbouring turns as the aligner sees it, and whether it counts as aligned."""
    c = t.conversations.select("conv_id", "turn", normalize("text").alias("norm"))
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("norm").alias("next"))
    p = c.join(n, ["conv_id", "turn"]).withColumn("x", words(F.col("norm"))).withColumn("y", words(F.col("next")))
    s = with_affinity(hybrid(jaccard(F.col("x"), F.col("y")), trigram_cosine("norm", "next"), F.col("x"), F.col("y")), F.col("turn"), F.col("turn") + 1, 0.15)
    limit = aligned_threshold(F.lit("speech"), F.lit("speech"), F.col("x"), F.col("y"))
    return p.select("conv_id", "turn", F.round(s, 6).alias("similarity"), (s >= limit).alias("aligned"))


@query(f"""WITH d AS (SELECT doc_id, line_no, lower(line) AS l, {WORDS.format('line')} AS dw FROM ({LINES})),
b AS (SELECT DISTINCT item_id, lower(s) AS s, {WORDS.format('s')} AS w FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[.!?]')) AS s FROM benchmark)),
q AS (SELECT * FROM b WHERE len(w) BETWEEN 2 AND 6)
SELECT item_id, doc_id, line_no, s FROM q JOIN d ON len(list_intersect(w, dw)) = len(w)""")
def contains_all_words(t: Tables) -> DataFrame:
    """RES-07, tier 1e: lines with every word of a sentence of two to six words. Lines meet a sentence by its rarest word alone; the others
    are looked for in the line."""
    sentences = t.benchmark.select("item_id", F.explode(F.split("text", "[.!?]")).alias("s")).select("item_id", F.lower("s").alias("s")).distinct()
    q = sentences.withColumn("ws", F.array_distinct(fts.plain_tokens("s"))).where(F.size("ws").between(2, 6))
    lines = document_lines(t.documents).select("doc_id", "line_no", F.array_distinct(fts.plain_tokens("line")).alias("dw"))
    each = q.select("item_id", "s", "ws", F.explode("ws").alias("word"))
    often = lines.select(F.explode("dw").alias("word")).join(small_side(each.select("word").distinct(), 100_000), "word").groupBy("word").agg(F.count("*").alias("df"))
    rarest = each.join(often, "word", "left").groupBy("item_id", "s").agg(F.min_by(F.struct("word", "ws"), F.struct(F.coalesce("df", F.lit(0)), "word")).alias("r")).select("item_id", "s", "r.word", "r.ws")
    met = lines.select("doc_id", "line_no", "dw", F.explode("dw").alias("word")).join(small_side(checkpointed(rarest), 100_000), "word")
    return met.where(F.forall("ws", lambda x: F.array_contains("dw", x))).select("item_id", "doc_id", "line_no", "s")


@query(f"""SELECT p_partkey, len(list_filter({WORDS.format('p_type')}, lambda w: starts_with(w, substr(lower(split_part(p_type, ' ', 1)), 1, 4)))) > 0 AS word_prefix, split_part(p_name, ' ', 2) IN ('bolt', 'gear') AS stem_prefix FROM part""")
def stem_prefix(t: Tables) -> DataFrame:
    """SCL-04, SCL-05."""
    w = fts.plain_tokens("p_type")
    first = F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))
    return t.part.select("p_partkey", tx.contains_word_prefix(w, F.substring(first, 1, 4)).alias("word_prefix"), tx.contains_stem_prefix(fts.plain_tokens(F.concat("p_name", F.lit(" bolts gears"))), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("stem_prefix"))


# ---- search

TERMS = "SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents"


def _index(t: Tables) -> fts.Index:
    return fts.build_index(t.documents.select("doc_id", "text"), "doc_id", ["text"], stem=False)


@query(f"SELECT term, doc, count(*)::INT AS tf FROM ({TERMS}) GROUP BY 1, 2")
def fts_terms(t: Tables) -> DataFrame:
    """FTS-01."""
    return _index(t).postings.select("term", "doc", "tf")


def _bm25_sql(condition: str, slots: int) -> str:
    return f"""WITH x AS ({TERMS}), dl AS (SELECT doc_id AS doc, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM documents), n AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
h AS (SELECT {condition} AS slot, doc, count(*) AS tf FROM x WHERE {condition} IS NOT NULL GROUP BY 1, 2), f AS (SELECT slot, count(*) AS df FROM h GROUP BY 1)
SELECT doc, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM h JOIN f USING (slot) JOIN dl USING (doc), n GROUP BY 1 HAVING count(*) = {slots}"""


@query(_bm25_sql("CASE term WHEN 'thnd' THEN 0 WHEN 'ofing' THEN 1 WHEN 'reed' THEN 0 END", 1), "fts_bm25_any")
def fts_bm25_any(t: Tables) -> DataFrame:
    """FTS-06 for single-term hits: the documents that one of two alternatives matches."""
    i = _index(t)
    renamed = fts.Index(i.postings.withColumn("term", F.when(F.col("term") == "reed", "thnd").otherwise(F.col("term"))).groupBy("term", "doc", "field").agg(F.sum("tf").alias("tf")), i.docs, i.stats, False)
    a, b = fts.bm25(renamed, ["thnd"]), fts.bm25(renamed, ["ofing"])
    both = a.join(b.select("doc"), "doc", "left_anti").unionByName(b.join(a.select("doc"), "doc", "left_anti"))
    return both.select("doc", F.round("score", 6).alias("score"))


@query(_bm25_sql("CASE term WHEN 'the' THEN 0 WHEN 'that' THEN 1 END", 2))
def fts_bm25(t: Tables) -> DataFrame:
    """FTS-04, FTS-06: all terms, ranked."""
    return fts.bm25(_index(t), ["the", "that"]).select("doc", F.round("score", 6).alias("score"))


@query(_bm25_sql("CASE WHEN term = 'the' THEN 0 WHEN starts_with(term, 'thatin') THEN 1 END", 2))
def fts_prefix(t: Tables) -> DataFrame:
    """FTS-04: the last term as a prefix."""
    return fts.bm25(_index(t), ["the", "thatin"], prefix_last=True).select("doc", F.round("score", 6).alias("score"))


@query("""SELECT DISTINCT doc FROM (SELECT doc_id AS doc, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)) WHERE list_contains(g, 'of the')""")
def fts_phrase(t: Tables) -> DataFrame:
    """FTS-05."""
    return fts.phrase(_index(t), ["of", "the"])


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion th')")
def fts_trigram(t: Tables) -> DataFrame:
    """FTS-03."""
    return fts.trigram_search(t.documents, "text", "Tion th").select("doc_id")


@query("""WITH g AS (SELECT item_id AS doc, list_distinct(list_transform(range(1, greatest(length(text) - 1, 2)), lambda i: substr(lower(text), i, 3))) AS g FROM benchmark WHERE length(text) >= 3) SELECT doc, unnest(g) AS gram FROM g""")
def trigram_postings(t: Tables) -> DataFrame:
    """FTS-03, FTS-01."""
    return fts.trigram_postings(t.benchmark, "item_id", "text").select("doc", "gram")


@query()
def fts_stemmed(t: Tables) -> DataFrame:
    """FTS-02, FTS-05: a query string over a stemmed index."""
    i = fts.build_index(t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", "role"), "id", ["text", "role"])
    return fts.search(i, 'the OR role:assistant "of the"')


@query(f"""WITH s AS ({_bm25_sql("CASE term WHEN 'the' THEN 0 WHEN 'that' THEN 1 END", 2)}) SELECT lang, arg_min(doc, (-score, doc)) AS doc, max(score) AS score FROM s JOIN documents ON doc_id = doc GROUP BY 1""")
def fts_grouped(t: Tables) -> DataFrame:
    """FTS-07, FTS-09, JN-18: the best document of each language for two words."""
    scored = fts.bm25(_index(t), ["the", "that"]).select("doc", F.round("score", 6).alias("score"))
    return fts.grouped(scored, t.documents.select(F.col("doc_id").alias("doc"), "lang"), "lang")


# ---- citations in text, pages

FORMS = Forms(plays=("Ham.", "Mac.", "Tw.N."), sonnets=("Sonn.",), poems=("Ven.", "Lucr."))


def _quoted(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(F.lit("see Ham.  iii. "), F.element_at(F.array(*map(F.lit, ("i", "ii", "iv"))), (k % 3 + 1).cast("int")), F.lit(". "), (k % 90 + 1).cast("string"), F.lit(" and Ven. "), (k % 400 + 1).cast("string"), F.lit("; Sonn. xl. 7"))
    return t.orders.select("o_orderkey", text.alias("text"))


CITED = r"""WITH q AS (SELECT o_orderkey, 'see Ham.  iii. ' || ['i', 'ii', 'iv'][o_orderkey % 3 + 1] || '. ' || (o_orderkey % 90 + 1) || ' and Ven. ' || (o_orderkey % 400 + 1) || '; Sonn. xl. 7' AS text FROM orders)
SELECT o_orderkey, 'Ham.' AS abbrev, 3::INT AS act, [1, 2, 4][o_orderkey % 3 + 1]::INT AS scene, regexp_extract(text, 'Ham\.\s+iii\.\s*[iv]+\.\s*([0-9]+)', 1)::INT AS line, {a} FROM q
UNION ALL SELECT o_orderkey, 'Ven.', NULL, NULL, regexp_extract(text, 'Ven\.\s*([0-9]+)', 1)::INT, {b} FROM q UNION ALL SELECT o_orderkey, 'Sonn.', NULL, 40, 7, {c} FROM q"""


@query(CITED.format(a="0 AS n", b="0", c="0").replace(", 0 AS n", "").replace(", 0 FROM", " FROM"))
def citations_extract(t: Tables) -> DataFrame:
    """PRS-05..08: citations in text, as rows."""
    return _quoted(t).select("o_orderkey", F.inline(span_column(FORMS)("text"))).select("o_orderkey", "abbrev", "act", "scene", "line").distinct()


@query(r"""WITH c AS (""" + CITED.format(a="strpos(text, 'Ham') - 1 AS s, strpos(text, ' and') - 1 AS e", b="strpos(text, 'Ven') - 1, strpos(text, ';') - 1", c="strpos(text, 'Sonn') - 1, length(text)") + """) SELECT o_orderkey, abbrev, s::INT AS "start", e::INT AS "end" FROM c""")
def citation_spans(t: Tables) -> DataFrame:
    """PRS-09."""
    return _quoted(t).select("o_orderkey", F.inline(span_column(FORMS)("text"))).select("o_orderkey", "abbrev", "start", "end")


@query(name="html_text_lines")
def html_lines(t: Tables) -> DataFrame:
    """SRC-09..12: lines of web pages as shown."""
    return t.pages.select("page_id", F.posexplode(html_text_lines("html")).alias("pos", "line"))


# ---- documents


@query("SELECT c_custkey, c_name, list_sort(list(o_orderkey)) AS orders, count(*)::BIGINT AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def lexicon_doc(t: Tables) -> DataFrame:
    """API-21: nested documents of a parent and its children."""
    o = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"), F.count("*").alias("n"))
    return t.customer.join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "orders", "n")


@query("""SELECT o_orderkey, coalesce('[' || string_agg('{"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']', '[]') AS spans
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def ref_doc(t: Tables) -> DataFrame:
    """API-22: JSON documents of a parent and its spans."""
    s = t.lineitem.groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))).alias("spans"))
    d = t.orders.join(s, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return d.select("o_orderkey", F.coalesce("spans", F.lit("[]")).alias("spans"))
