"""The engine on a small library of its own: sources, alignment, resolution, views and sinks over literal rows, with the rows they must give.

The SQL of each query is the expected result, worked out by hand from the rules. Nothing here reads the driver's tables.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions.normalize import normalize
from stemma.operators import align, citations, fts, views
from stemma.plans.registry import Tables
from stemma.plans.schemas import TABLES
from stemma.session import checkpointed
from stemma.sources import citation_text, editions, lexicon, markup, ocr, sqldump, tables, writers

CASES: dict = {}


def query(sql: str, name: str | None = None):
    """A case: a function of Tables, and the SQL of the rows that it must give."""

    def register(f):
        CASES[name or f.__name__] = f, sql
        return f

    return register


KINDS = {"VARCHAR": "string", "BIGINT": "long", "INT": "int", "DOUBLE": "double", "BOOLEAN": "boolean"}


def literal(v) -> str:
    if v is None:
        return "NULL"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)


def expect(columns: str, *rows: tuple) -> str:
    """SQL for literal rows. columns: name TYPE, ..."""
    pairs = [c.split() for c in columns.split(", ")]
    cast = ", ".join(f'CAST({n} AS {k}) AS "{n}"' for n, k in pairs)
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT {cast} FROM (VALUES {values}) v({', '.join(n for n, _ in pairs)})"


def rows(spark: SparkSession, columns: str, *data: tuple) -> DataFrame:
    """Literal rows. columns: name TYPE, ..."""
    return spark.createDataFrame([tuple(r) for r in data], ", ".join(f"{n} {KINDS[k]}" for n, k in (c.split() for c in columns.split(", "))))


# ---- sources

DUMP = r"""
-- made up; with a semicolon
CREATE TABLE `Works` (id int); /* another; one */
INSERT INTO `Works` VALUES ('tide','The Tide; a Play','it''s \'so\'',NULL,1601,'c','n','s',10,'20'),('mere','The Mere (Poem)','a\nb','Mere',-3.5,'p','','',0,'0');
insert into Paragraphs values ('tide',1,2,'anna','Low water\n[p]runs &#233; north','x','y','b',2,1,10,4),('tide',2,1,'xxx','Enter ANNA','x','y','b',2,1,5,1),('short',1);
"""


def _dump(t: Tables) -> DataFrame:
    text = rows(t.spark, "value VARCHAR", (DUMP,))
    return text.lateralJoin(sqldump.DumpRows(F.col("value").outer())).select("table_name", "ordinal", "row")


@query(expect(
    "table_name VARCHAR, ordinal INT, n INT, first VARCHAR, third VARCHAR, fourth VARCHAR",
    ("Works", 0, 10, "tide", "it's 'so'", None), ("Works", 1, 10, "mere", "a\nb", "Mere"), ("Paragraphs", 2, 12, "tide", "2", "anna"), ("Paragraphs", 3, 12, "tide", "1", "xxx"), ("Paragraphs", 4, 2, "short", None, None),
))
def src_dump_rows(t: Tables) -> DataFrame:
    """SRC-01..03."""
    return _dump(t).select("table_name", F.col("ordinal").cast("int").alias("ordinal"), F.size("row").alias("n"), F.get("row", F.lit(0)).alias("first"), F.get("row", F.lit(2)).alias("third"), F.get("row", F.lit(3)).alias("fourth"))


@query(expect(
    "kind VARCHAR, key VARCHAR, act INT, scene INT, number INT, text VARCHAR, type VARCHAR",
    ("work", "tide", None, None, 1601, "The Tide; a Play", "c"), ("work", "mere", None, None, None, "The Mere (Poem)", "p"),
    ("line", "tide", 2, 1, 1, "Enter ANNA", "stage_direction"), ("line", "tide", 2, 1, 2, "Low water", "speech"), ("line", "tide", 2, 1, 3, "runs é north", "speech"),
))
def src_dump_edition(t: Tables) -> DataFrame:
    """SRC-04, SRC-05, SCL-09, WIN-02."""
    made = editions.dump_tables(_dump(t))
    none = F.lit(None).cast("int")
    works = made["works"].select(F.lit("work").alias("kind"), F.col("oss_id").alias("key"), none.alias("act"), none.alias("scene"), F.col("year").alias("number"), F.col("title").alias("text"), F.col("genre_type").alias("type"))
    lines = editions.dump_lines(made["paragraphs"], 1)
    return works.unionByName(lines.select(F.lit("line").alias("kind"), F.col("oss_work_id").alias("key"), "act", "scene", F.col("line_number").alias("number"), F.col("content").alias("text"), F.col("content_type").alias("type")))


TEI = """<TEI><text><body><div1 type="act" n="1"><div2 type="scene" n="2"><stage>Enter ANNA.</stage>
<sp who="ann"><speaker>Ann.</speaker><p>The boats <lb ed="G" n="5"/>come home<lb ed="G"/>at last</p></sp>
<sp who="ben"><speaker>Ben.</speaker><l n="9">No b<g ref="x"/>oat &amp; no wind</l><l>ſo <gap/> far</l></sp></div2></div1></body></text></TEI>"""
GLOBE = ((1, 2, 0, "Enter ANNA.", "stage_direction"), (1, 2, 4, "The boats", "speech"), (1, 2, 5, "come home", "speech"), (1, 2, 7, "at last", "speech"), (1, 2, 9, "No boat & no wind", "speech"), (1, 2, 10, "so [?] far", "speech"))


def _as_lines(df: DataFrame) -> DataFrame:
    return df.select("act", "scene", "line_number", F.col("content").alias("text"), F.col("content_type").alias("type"))


@query(expect("act INT, scene INT, line_number INT, text VARCHAR, type VARCHAR", *GLOBE))
def src_tei_globe(t: Tables) -> DataFrame:
    """SRC-14, SRC-16, SCL-11, SCL-20, WIN-04, WIN-05: numbers between marks are interpolated."""
    return _as_lines(editions.globe_plays(rows(t.spark, "work_id BIGINT, xml VARCHAR", (7, TEI)), 1))


@query(expect("act INT, scene INT, line_number INT, text VARCHAR, type VARCHAR", *((a, s, k, x, c) for k, (a, s, _, x, c) in enumerate(GLOBE, 1))))
def src_tei_folio(t: Tables) -> DataFrame:
    """SRC-17, SRC-18: numbers run over the play."""
    return _as_lines(editions.folio_plays(rows(t.spark, "work_id BIGINT, xml VARCHAR", (7, TEI)), 2))


@query(expect("short_code VARCHAR, act INT, scene INT, line_number INT, text VARCHAR", *(("q1_tide_1603", 1, 1, k, x) for k, (_, _, _, x, _) in enumerate(GLOBE, 1))))
def src_tei_quarto(t: Tables) -> DataFrame:
    """SRC-21, SRC-22: one edition for each file, without acts and scenes."""
    made, lines = editions.quarto_plays(rows(t.spark, "work_id BIGINT, oss_id VARCHAR, year INT, xml VARCHAR", (7, "tide", 1603, TEI)))
    return lines.join(made.select(F.col("id").alias("edition_id"), "short_code"), "edition_id").select("short_code", "act", "scene", "line_number", F.col("content").alias("text"))


POEM = '<TEI><text><body><div1 type="sonnet" n="XL"><l>The tide</l><lg><l n="5">returns</l><l>again</l></lg></div1><div1 type="sonnet" n="q7"><l>skip</l></div1><div1 type="sonnet" n="2"><l>Low</l></div1></body></text></TEI>'
STORY = '<TEI><text><body><div1 n="1"><l>Once</l></div1><div1 n="2"><l>there</l><l> </l></div1></body></text></TEI>'


@query(expect("work_id BIGINT, act INT, scene INT, line_number INT, text VARCHAR", (1, 1, 40, 1, "The tide"), (1, 1, 40, 5, "returns"), (1, 1, 40, 6, "again"), (1, 1, 2, 1, "Low"), (2, 1, 1, 1, "Once"), (2, 1, 2, 2, "there")))
def src_tei_poems(t: Tables) -> DataFrame:
    """SRC-15, SRC-16, SCL-13: sonnets by Roman and Arabic numbers, other poems counted on."""
    return editions.tei_poems(rows(t.spark, "work_id BIGINT, xml VARCHAR", (1, POEM), (2, STORY)), 3).select("work_id", "act", "scene", "line_number", F.col("content").alias("text"))


WORDS = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div1 type="act" n="1"><div2 type="scene" n="1"><sp who="#a"><speaker>A</speaker>
<l n="1.1.3"><w lemma="who" pos="q">Who</w><pc>'</pc><w lemma="be">s</w><c> </c><w>there</w><pc>?</pc></l><l><w>None</w></l></sp></div2></div1></body></text></TEI>"""


@query(expect("line_number INT, text VARCHAR, word VARCHAR, lemma VARCHAR, position INT", (3, "Who's there?", "Who", "who", 1), (3, "Who's there?", "s", "be", 2), (3, "Who's there?", "there", None, 3), (3, "None", "None", None, 1)))
def src_words_play(t: Tables) -> DataFrame:
    """SRC-19, SRC-20, WIN-03: words with their lemmas; a line without a number takes the largest so far."""
    lines, words = editions.word_plays(rows(t.spark, "work_id BIGINT, xml VARCHAR", (1, WORDS)), 5)
    return lines.join(words.withColumnRenamed("line_id", "id"), "id").select("line_number", F.col("content").alias("text"), "word", "lemma", "position")


def _act(n: int, text: str) -> str:
    return f'<section id="act-{n}"><section id="scene-{n}-1"><table><tr><td/><td><i epub:type="z3998:stage-direction">Enter {n}.</i></td></tr><tr><td epub:type="z3998:persona">Pe<b>ter</b></td><td epub:type="z3998:verse"><p><span>{text}</span><br/><span>and on&#8217;t</span></p></td></tr></table></section></section>'


@query(expect(
    "act INT, scene INT, line_number INT, text VARCHAR, type VARCHAR, who VARCHAR",
    *((n, 1, k, x, c, w) for n, y in ((1, "first"), (2, "second")) for k, x, c, w in ((None, f"Enter {n}.", "stage_direction", None), (1, y, "speech", "Peter"), (2, "and on’t", "speech", "Peter"))),
))
def src_xhtml_play(t: Tables) -> DataFrame:
    """SRC-06, SRC-09, SRC-10: acts of a JSON object in the order of their names."""
    files = json.dumps({"act-2.xhtml": _act(2, "second"), "act-1.xhtml": _act(1, "first")})
    made = editions.xhtml_plays(rows(t.spark, "work_id BIGINT, json VARCHAR", (1, files)), 2)
    return made.select("act", "scene", "line_number", F.col("content").alias("text"), F.col("content_type").alias("type"), F.col("char_name").alias("who"))


@query(expect("work_id BIGINT, scene INT, line_number INT, stanza INT, text VARCHAR", (5, 3, 1, 1, "Look"), (5, 3, 2, 1, "again"), (6, None, 1, 1, "Even"), (6, None, 2, 2, "now")))
def src_xhtml_poetry(t: Tables) -> DataFrame:
    """SRC-11..13: sonnets and poems; articles of no work are left out."""
    html = '<article id="sonnet-3"><header><h2>III</h2></header><p><span>Look</span><br/><span>again</span></p></article><article id="mere"><section id="dedication"><p>To X</p></section><p><span>Even</span></p><p><span>now</span></p></article><article id="other"><p><span>x</span></p></article>'
    made = editions.xhtml_poetry(rows(t.spark, "html VARCHAR", (html,)), rows(t.spark, "article VARCHAR, work_id BIGINT", ("sonnet", 5), ("mere", 6)), 2)
    return made.select("work_id", "scene", "line_number", "stanza", F.col("content").alias("text"))


OCR = {
    "glossary": ("front matter", "abate, vb. to lessen", "more of it", "12", "abhor: to hate"),
    "grammar": ("x", "GRAMMAR.", "1. Adjectives are", "used freely", "600. no", "2. Also", "INDEX TO THE QUOTATIONS", "3. not"),
    "concordance": ("Abbey.  In the abbey", "and more", "ACT.  I", "Able.  He is able"),
    "slang": ("ABRAM, subs. a cheat", "1600. Shakspeare", "ACE, subs. other"),
}


@query(expect(
    "source VARCHAR, headword VARCHAR, letter VARCHAR, raw_text VARCHAR",
    ("glossary", "abate", "A", "abate, vb. to lessen\nmore of it"), ("glossary", "abhor", "A", "abhor: to hate"), ("grammar", "§ 1", "?", "1. Adjectives are\nused freely\n600. no"), ("grammar", "§ 2", "?", "2. Also"),
    ("concordance", "abbey", "A", "Abbey.  In the abbey\nand more\nACT.  I"), ("concordance", "able", "A", "Able.  He is able"), ("slang", "abram", "A", "ABRAM, subs. a cheat\n1600. Shakspeare"),
))
def src_ocr_entries(t: Tables) -> DataFrame:
    """SRC-23..26, OTH-01, OTH-02, SCL-19, WIN-07."""
    out = None
    for source, text in OCR.items():
        made = ocr.reference_entries(rows(t.spark, "volume VARCHAR, line_no INT, line VARCHAR", *(("v", k, x) for k, x in enumerate(text))), source)
        out = made if out is None else out.unionByName(made)
    return out


ENTRY = """<?xml version="1.0"?><TEI.2><text><body><div1 n="G"><entryFree key="Gill2" type="main"><orth>Gill,</orth> 1) a fish & part: <cit><quote>by the gills</quote> <bibl n="shak. tn 2.5.26">Tw. II, 5, 26</bibl></cit>. 2) a girl: <bibl n="shak. ham 1.2.3">Hml. I, 2, 3</bibl> <bibl n="hom. 1">X</bibl></entryFree></div1></body></text></TEI.2>"""


@query(expect(
    "base_key VARCHAR, sense_group INT, letter VARCHAR, raw_bibl VARCHAR, quote_text VARCHAR, sense_number INT, definition VARCHAR",
    ("Gill", 2, "G", "shak. tn 2.5.26", "by the gills", 1, "a fish & part: by the gills Tw. II, 5, 26."), ("Gill", 2, "G", "shak. ham 1.2.3", "", 2, "a girl: Hml. I, 2, 3 X"),
))
def src_lexicon(t: Tables) -> DataFrame:
    """SRC-07, SRC-08, SCL-07, PRS-03, PRS-04: the first file of a key wins."""
    files = rows(t.spark, "path VARCHAR, value VARCHAR", ("a.xml", ENTRY), ("b.xml", ENTRY.replace("girl", "second file")))
    e, s, c = lexicon.lexicon_tables(files.lateralJoin(lexicon.LexiconEntry(F.col("value").outer())))
    sense = s.select(F.col("id").alias("sense_id"), F.regexp_replace(F.trim("definition_text"), r"\s+", " ").alias("definition"))
    return c.join(e.select(F.col("id").alias("entry_id"), "base_key", "sense_group", "letter"), "entry_id").join(sense, "sense_id").select("base_key", "sense_group", "letter", "raw_bibl", "quote_text", "sense_number", "definition")


@query(expect("kind VARCHAR, key VARCHAR, n INT", ("stub", "[Hom. 1] a", 1), ("passage", "verse", 4), ("passage", "prose", 5), ("work", "Iliad", None), ("url", "https://x/tide", 1), ("url", None, 2), ("rule", "second", 1), ("missing", "b", None)))
def src_small_tables(t: Tables) -> DataFrame:
    """SRC-13, SRC-28..30, SRC-32, OTH-03, OTH-04."""
    s, none = t.spark, F.lit(None).cast("int")
    cites = rows(s, "id BIGINT, work_id BIGINT, act INT, scene INT, line INT, raw_bibl VARCHAR, headword VARCHAR", (1, 9, 0, 0, None, "Hom. 1", "a"), (2, 9, None, None, 1, "Hom. 2", "b"), (3, 8, None, None, 1, "x", "c"))
    stub = tables.external_lines(cites, cites.limit(0), rows(s, "id BIGINT", (9,))).select(F.lit("stub").alias("kind"), F.col("content").alias("key"), F.col("line_number").alias("n"))
    lines = s.createDataFrame([("p", 1, [(1, 1, 4, "x", None), (1, 1, 5, "y", "prose")])], "edition string, work_id long, lines array<struct<act:int,scene:int,line_number:int,content:string,content_type:string>>")
    passage = tables.passage_lines(lines).select(F.lit("passage"), "content_type", "line_number")
    works = tables.external_works(s, rows(s, "prefix VARCHAR, title VARCHAR", ("Il.", "Iliad"), ("Hom. Il.", "Iliad"))).select(F.lit("work"), "title", none)
    url = tables.with_folger_urls(rows(s, "id INT", (1,), (2,)), rows(s, "work_id INT, slug VARCHAR", (1, "tide")), "https://x/").select(F.lit("url"), "folger_url", "id")
    rules = rows(s, "seq INT, short_code VARCHAR, text VARCHAR", (1, "a", "first"), (2, "a", "second"), (3, "none", "x"))
    rule = tables.attributions(rules, rows(s, "id INT, short_code VARCHAR", (1, "a"))).select(F.lit("rule"), tables.optional("text"), "source_id")
    missing = tables.missing_files(rows(s, "name VARCHAR", ("a",), ("b",)), rows(s, "name VARCHAR", ("a",))).select(F.lit("missing"), "name", none)
    return stub.union(passage).union(works).union(url).union(rule).union(missing)


REFERENCES = (
    ("shak. ham 3.1.56", "", "play", "ham", 3, 1, 56), ("shak. son 1.14", "", "sonnet_sequence", "son", None, 1, 14), ("shak. ham 5.1", "", "play", "ham", 5, 1, None), ("shak. ham 4.60", "", "play", "ham", 4, None, 60),
    ("shak. ven 1.2.30", "", "poem", "ven", None, None, 30), ("shak. shr ind.2.77", "", "play", "shr", 0, 2, 77), ("shak. ham 1.2", "Hml. I, 2, 15", "play", "ham", 1, 2, 15), ("shak. ham 4.12", "Tp. IV, 12.", "play", "ham", 4, None, 12),
    ("hom. il. 1", "", "play", None, None, None, None),
)
WORK_TYPES = {"ham": "play", "son": "sonnet_sequence", "ven": "poem", "shr": "play"}


@query(expect("ref VARCHAR, shown VARCHAR, code VARCHAR, act INT, scene INT, line INT", *((r, s, c, a, b, n) for r, s, _, c, a, b, n in REFERENCES)))
def prs_references(t: Tables) -> DataFrame:
    """PRS-01, PRS-02."""

    @F.udf("code string, act int, scene int, line int")
    def parsed(ref, shown, kind):
        return citation_text.supplement(citation_text.parse_reference(ref, WORK_TYPES), shown, kind)

    return rows(t.spark, "ref VARCHAR, shown VARCHAR, kind VARCHAR", *(r[:3] for r in REFERENCES)).withColumn("p", parsed("ref", "shown", "kind")).select("ref", "shown", "p.*")


CONCORDANCE = "Quarry.  near  the  old  quarry  stood  Com.  of  Errors  iv  2  61\nas before  iii  2  5\nLet us go Coriolanut  ii  2  152\n sweet  Sonnet  12"


@query(expect(
    "source VARCHAR, abbrev VARCHAR, act INT, scene INT, line INT",
    ("concordance", "Com. of Errors", 4, 2, 61), ("concordance", "Com. of Errors", 3, 2, 5), ("concordance", "Coriolanus", 2, 2, 152), ("concordance", "Sonnet", None, None, 12),
    ("slang", "Hamlet", 3, 2, None), ("slang", "Henry V", 4, 3, None), ("mixed", "J. C.", 3, 2, 119),
))
def prs_concordances(t: Tables) -> DataFrame:
    """PRS-06..08: spaced columns with lines that go on, act and scene forms, Roman acts with Arabic scenes."""
    forms = {
        "concordance": (CONCORDANCE, citation_text.Forms(plays=("Com. of Errors", "Coriolanus"), poems=("Sonnet",), style="spaced", spellings={"Coriolanut": "Coriolanus"})),
        "slang": ("1602. Hamlet [1602], iii. Sc. 2; Henry V [iv., 3.]", citation_text.Forms(plays=("Hamlet", "Henry V"), style="act_scene")),
        "mixed": ("J.  C.  iii.  2.  119.", citation_text.Forms(plays=("J. C.",), style="mixed")),
    }
    out = None
    for name, (text, f) in forms.items():
        found = rows(t.spark, "text VARCHAR", (text,)).select(F.lit(name).alias("source"), F.inline(citation_text.span_column(f)("text"))).select("source", "abbrev", "act", "scene", "line")
        out = found if out is None else out.unionByName(found)
    return out


NORMALISED = (
    ("Stay; you there -- \"Friend\"?", "stay you ther friend"), (" \ttwo  words\nor\t three ", "two words or thre"), ("have", "haue"), ("vpon", "upon"), ("virtue", "uirtue"), ("beautie", "beauty"), ("pittie", "pitty"),
    ("die", "die"), ("Juliet", "iuliet"), ("joy", "ioy"), ("speake", "speak"), ("done", "done"), ("arrive", "arriue"), ("'gainsth", "againsth"), ("", ""), ("!!!", ""), ("to-morrow", "tomorrow"), ("musick", "music"), ("suspicion", "suspition"),
)


@query(expect("text VARCHAR, norm VARCHAR", *NORMALISED))
def scl_normalize(t: Tables) -> DataFrame:
    """SCL-01."""
    return rows(t.spark, "text VARCHAR", *((a,) for a, _ in NORMALISED)).select("text", normalize("text").alias("norm"))


# ---- alignment, resolution and views, on a play and a sonnet in two editions

PLAY = ("To be or not to be that is the question", "Whether tis nobler in the mind to suffer", "The slings and arrows of outrageous fortune", "Or to take arms against a sea of troubles", "And by opposing end them to die to sleep")
SONNET = ("Shall I compare thee to a summers day", "Thou art more lovely and more temperate", "Rough winds do shake the darling buds", "And summers lease hath all too short a date")
LINES = "id BIGINT, work_id BIGINT, edition_id BIGINT, act INT, scene INT, line_number INT, char_name VARCHAR, content VARCHAR, content_type VARCHAR, word_count INT"


def _text() -> list[tuple]:
    out = []
    for edition in (1, 2):
        for work, act, scene, text, base in ((1, 3, 1, PLAY, 0), (2, 0 if edition == 1 else None, 18, SONNET, 5)):
            for k, line in enumerate(text, 1):
                line = f"{line} no more" if edition == 2 and k == len(text) else line
                out.append(((edition - 1) * 10 + base + k, work, edition, act, scene, k, "HAMLET", line, "speech", len(line.split())))
    return out


def _library(spark: SparkSession) -> dict[str, DataFrame]:
    data = {
        "works": [(1, "hamlet", "Hamlet", "Hamlet", "Hml.", "play", "t", None), (2, "sonnets", "Sonnets", "Sonnets", "Sonn.", "sonnet_sequence", "s", None), (3, "notes", "Notes", "Notes", None, "essay", "e", None)],
        "editions": [(1, "Globe", "perseus_globe", 1, 1864, "", "", "oss", None), (2, "Modern", "se_modern", 2, 2020, "", "", "se", "cc0")],
        "sources": [(1, "Open", "oss", "", "", "", "", True, ""), (2, "Standard", "se", "", "", "", "", False, ""), (3, "Unused", "no", "", "", "", "", True, "")],
        "attributions": [(1, 1, True, "always", "html", "Open text"), (2, 2, False, "on_export", "html", "Standard text"), (3, 3, True, "always", "html", "Unused text")],
        "text_lines": _text(),
        "lexicon_entries": [(1, "question", "question", None, "Q", "question: a matter"), (2, "Gill2", "Gill", 2, "G", "gill"), (3, "sea", "sea", None, "S", "sea: water")],
        "lexicon_senses": [(1, 1, 1, None, "a matter")],
        "lexicon_citations": [
            (1, 1, 1, 1, "Hml.", 3, 1, 1, "that is the question", "Hml. III, 1, 1", "shak. ham 3.1.1", "question"),
            (2, 1, 1, 1, "Hml.", 3, 1, 1, "", "", "shak. ham 3.1.1", "question"),
            (3, 1, 1, 2, "Sonn.", None, 18, 2, "", "", "shak. son 18.2", "temperate"),
            (4, 2, None, 1, "Hml.", 3, 1, None, "arrows -- slings", "", "shak. ham 3.1", "sling"),
            (5, 2, None, 1, "Hml.", 3, 1, None, "nothing of the kind whatever it were", "", "x 1", "zebra"),
            (6, 3, None, 1, "Hml.", 3, 1, None, "", "", "shak. ham 3.1", "sea"),
            (7, 3, None, 9, "X", None, None, 3, "", "", "x 2", "outrageous"),
        ],
        "reference_entries": [(1, "glossary", "sling", "S", "sling: see Ham. iii. i. 3"), (2, "glossary", "buds", "B", "buds: Sonn. xviii.")],
        "reference_citations": [(1, 1, "glossary", 1, 3, 1, 3), (2, 2, "glossary", 2, None, 18, 12), (3, 1, "glossary", 1, 3, 1, 40)],
    }
    return {name: spark.createDataFrame(data[name], TABLES[name]) for name in data}


MAPPED = [(1, 3, 1, k, 1, 2, k, 10 + k, "aligned", 1.0 if k < 5 else 0.8) for k in range(1, 6)] + [(2, 0, 18, k, 1, 2, 5 + k, 15 + k, "aligned", 1.0 if k < 4 else 0.818182) for k in range(1, 5)]


@query(expect("work_id BIGINT, act INT, scene INT, align_order INT, edition_a_id BIGINT, edition_b_id BIGINT, line_a_id BIGINT, line_b_id BIGINT, match_type VARCHAR, similarity DOUBLE", *MAPPED))
def e2e_align(t: Tables) -> DataFrame:
    """ALN-01, ALN-02, ALN-07..10: a sonnet without an act in one edition is aligned with act 0 of the other."""
    d = _library(t.spark)
    return align.align_editions(d["text_lines"], d["works"], d["editions"]).withColumn("similarity", F.round("similarity", 6))


def _shapes(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Editions of other shapes: lines lost, broken in two, of another scene structure, and works of one edition."""
    lines = []

    def add(work, edition, act, scene, contents, kind="speech"):
        lines.extend([(len(lines) + 1 + k, work, edition, act, scene, k + 1, None, c, kind, 0) for k, c in enumerate(contents)])

    add(1, 1, 1, 1, ("first line here about boats", "second line there of wind", "third line where gulls cry"))  # 1..3
    add(1, 2, 1, 1, ("first line here about boats", "third line where gulls cry"))  # 4, 5
    add(2, 1, 1, 1, ("alpha beta gamma delta", "kappa lambda", "sigma tau upsilon", "omega psi chi phi"))  # 6..9
    add(2, 2, 1, 1, ("alpha beta gamma delta", "kappa lambda sigma tau upsilon", "omega psi chi phi"))  # 10..12
    add(3, 1, 1, 1, ("only in one edition",))  # 13
    add(4, 1, 1, 1, PLAY[:3])  # 14..16
    add(4, 2, 2, 1, PLAY[:3])  # 17..19
    works = spark.createDataFrame([(k, "play") for k in (1, 2, 3, 4)], "id long, work_type string")
    return spark.createDataFrame(lines, TABLES["text_lines"]), works, spark.createDataFrame([(1, "oss"), (2, "se")], "id long, short_code string")


@query(expect(
    "work_id BIGINT, act INT, scene INT, align_order INT, line_a_id BIGINT, line_b_id BIGINT, match_type VARCHAR, similarity DOUBLE",
    (1, 1, 1, 1, 1, 4, "aligned", 1.0), (1, 1, 1, 2, 2, None, "only_a", 0.0), (1, 1, 1, 3, 3, 5, "aligned", 1.0),
    (2, 1, 1, 1, 6, 10, "aligned", 1.0), (2, 1, 1, 2, 7, None, "only_a", 0.0), (2, 1, 1, 3, 8, 11, "aligned", 0.73598), (2, 1, 1, 4, 9, 12, "aligned", 1.0),
    (3, 1, 1, 1, 13, None, "only_a", 0.0),
    *((4, 0, 0, k, 13 + k, 16 + k, "aligned", 1.0) for k in (1, 2, 3)),
))
def e2e_align_shapes(t: Tables) -> DataFrame:
    """ALN-01, ALN-02, ALN-08, SIM-02, SIM-03: a lost line, a broken one, a work of one edition, and another structure of scenes."""
    made = align.align_editions(*_shapes(t.spark))
    return made.select("work_id", "act", "scene", "align_order", "line_a_id", "line_b_id", "match_type", F.round("similarity", 6).alias("similarity"))


@query(expect("edition_a_id BIGINT, edition_b_id BIGINT, aligned BIGINT, modified BIGINT, only_a BIGINT, only_b BIGINT, mean_similarity DOUBLE", (1, 2, 9, 0, 0, 0, 0.958)))
def e2e_align_stats(t: Tables) -> DataFrame:
    """AGG-16: eight ninths and a bit."""
    return align.alignment_stats(_mapped(t))


def _mapped(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(MAPPED, TABLES["line_mappings"])


RESOLVED = [
    (1, 1, 1, "exact_quote", 1.0), (1, 11, 2, "exact_quote", 1.0), (2, 1, 1, "line_number", 0.9), (2, 11, 2, "line_number", 0.9), (3, 7, 1, "line_number", 0.9), (3, 17, 2, "line_number", 0.9),
    (4, 3, 1, "exact_quote", 0.8), (4, 13, 2, "exact_quote", 0.8), (5, 12, 2, "manual", 0.95), (6, 4, 1, "headword", 0.4), (6, 14, 2, "headword", 0.4), (7, 3, 1, "cross_play", 0.6),
]


@query(expect("citation_id BIGINT, text_line_id BIGINT, edition_id BIGINT, match_type VARCHAR, confidence DOUBLE", *RESOLVED))
def e2e_resolve(t: Tables) -> DataFrame:
    """RES-05..12: quotes, cited lines, all words, headwords, another work, and a correction by hand."""
    d = _library(t.spark)
    by_hand = t.spark.createDataFrame([("zebra", "x 1", 1, "se_modern", 3, None, 2, 0.95)], "headword string, raw_bibl string, work_id long, edition string, act int, scene int, line_number int, confidence double")
    made = citations.resolve_all(d["lexicon_citations"], d["text_lines"], d["editions"], _mapped(t), by_hand)
    return made.select("citation_id", "text_line_id", "edition_id", "match_type", F.round("confidence", 6).alias("confidence"))


@query(expect("case_no BIGINT, text_line_id BIGINT, edition_id BIGINT, match_type VARCHAR, confidence DOUBLE", *((7, a, b, c, d) for a, b, c, d in ((1, 1, "exact_quote", 1.0), (11, 2, "propagated", 0.9), (21, 3, "propagated", 0.27), (31, 4, "propagated", 0.27))), *((8, a, b, c, d) for a, b, c, d in ((31, 4, "exact_quote", 0.8), (21, 3, "propagated", 0.8), (11, 2, "propagated", 0.24), (1, 1, "propagated", 0.216)))))
def e2e_propagate(t: Tables) -> DataFrame:
    """RES-08, JN-17: along three mappings, forward and back; a weak one counts 0.3, and of two the better is taken."""
    maps = rows(t.spark, "edition_a_id BIGINT, edition_b_id BIGINT, line_a_id BIGINT, line_b_id BIGINT, similarity DOUBLE", (1, 2, 1, 11, 0.9), (1, 2, 1, 12, 0.5), (2, 3, 11, 21, 0.1), (3, 4, 21, 31, 1.0), (1, 2, 2, None, 0.0))
    lines = rows(t.spark, "line_id BIGINT, content VARCHAR", *((k, f"line {k}") for k in (1, 11, 12, 21, 31)))
    first = t.spark.createDataFrame([(7, 1, 1, "exact_quote", 1.0, "x"), (8, 31, 4, "exact_quote", 0.8, "x")], TABLES["citation_matches"])
    made = citations.propagate(first, maps, lines)
    return made.select(F.col("citation_id").alias("case_no"), "text_line_id", "edition_id", "match_type", F.round("confidence", 6).alias("confidence"))


@query(expect("citation_id BIGINT, text_line_id BIGINT, edition_id BIGINT, confidence DOUBLE", (1, 3, 1, 1.0), (1, 13, 2, 1.0), (2, 9, 1, 1.0), (2, 19, 2, 1.0)))
def e2e_reference(t: Tables) -> DataFrame:
    """RES-14, JN-12, JN-13: the nearest line within ten; one that is too far gives none."""
    d = _library(t.spark)
    return citations.reference_matches(d["reference_citations"], d["text_lines"]).select("citation_id", "text_line_id", "edition_id", "confidence")


@query(expect("step VARCHAR, id BIGINT, work_id BIGINT, act INT, scene INT, line INT", ("scene", 1, None, None, 4, None), ("scene", 3, None, None, 5, None), ("scene", 4, None, None, 4, None), ("prefix", 1, 8, None, None, 3), ("prefix", 2, 5, None, None, None), ("prefix", 3, None, None, None, None), ("fix", 1, 1, 0, 2, 1), ("fix", 2, 2, 1, 0, 7)))
def e2e_locations(t: Tables) -> DataFrame:
    """RES-02..04: the scene of a line, works by the longest prefix, known errors of place, and prologues of the one work that has them."""
    s, none = t.spark, lambda k: F.lit(None).cast(k)
    text = rows(s, "id BIGINT, work_id BIGINT, act INT, scene INT, line_number INT, content VARCHAR", *((k, 1, 1, 4, k, "x") for k in range(8, 13)), (60, 1, 1, 5, 60, "x"), (61, 2, 1, 0, 7, "Chorus"))
    cites = rows(s, "id BIGINT, work_id BIGINT, act INT, scene INT, line INT", (1, 1, 1, None, 9), (2, 1, 1, None, 61), (3, 1, 1, None, 50), (4, 1, 1, None, 11))
    scene = citations.missing_scenes(cites, text).select(F.lit("scene").alias("step"), "id", none("long").alias("work_id"), none("int").alias("act"), "scene", none("int").alias("line"))
    open_ = rows(s, "id BIGINT, work_id BIGINT, raw_bibl VARCHAR, line INT", (1, None, "Acts of the Apostles 3", None), (2, 5, "Acts 1", None), (3, None, "Nothing 4", None))
    prefix = citations.assign_work_by_prefix(open_, rows(s, "prefix VARCHAR, work_id BIGINT", ("acts", 7), ("Acts of the Apostles", 8))).select(F.lit("prefix"), "id", "work_id", none("int"), none("int"), "line")
    wrong = rows(s, "id BIGINT, work_id BIGINT, act INT, scene INT, line INT, raw_bibl VARCHAR, headword VARCHAR", (1, 1, None, None, 1, "Shr. Ind. 2, 1", "x"), (2, 1, 1, 0, 7, "Chor. 7", "x"))
    fix = citations.fix_locations(wrong, text, rows(s, "prefix VARCHAR, act INT, scene INT", ("shr. ind", 0, 1), ("shr. ind. 2", 0, 2))).select(F.lit("fix"), "id", "work_id", "act", "scene", "line")
    return scene.union(prefix).union(fix)


@query(expect("kind VARCHAR, key VARCHAR, id BIGINT", ("abbreviation", "Hml.", 1), ("abbreviation", "Hml", 1), ("abbreviation", "Sonn.", 2), ("abbreviation", "Sonn", 2), ("character", "HAMLET", 1), ("character", "Gho", 2), ("character", "Gert", 3)))
def e2e_names(t: Tables) -> DataFrame:
    """RES-01, RES-16, JN-10: abbreviations with and without the stop; speech prefixes by id, abbreviation and a word's beginning."""
    s = t.spark
    a = citations.abbreviation_table(_library(s)["works"]).select(F.lit("abbreviation").alias("kind"), F.col("abbrev").alias("key"), F.col("work_id").alias("id"))
    people = rows(s, "id BIGINT, work_id BIGINT, char_id VARCHAR, name VARCHAR, abbrev VARCHAR", (1, 1, "hamlet", "Hamlet", "Ham"), (2, 1, "ghost", "Ghost of Hamlet", "Gho"), (3, 1, "q", "Queen Gertrude", "Qu"))
    names = rows(s, "work_id BIGINT, char_name VARCHAR", (1, "HAMLET"), (1, "Gho"), (1, "Gert"), (1, "Nobody"), (1, ""))
    return a.union(citations.resolve_characters(names, people).select(F.lit("character"), "char_name", "character_id"))


def _matches(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(*r, None) for r in RESOLVED], TABLES["citation_matches"])


@query(expect("bucket VARCHAR, n BIGINT, samples VARCHAR", ("no work", 1, "1"), ("no location", 1, "2"), ("text not found", 2, "3,5")))
def e2e_unmatched(t: Tables) -> DataFrame:
    """AGG-18."""
    cites = rows(t.spark, "id BIGINT, work_id BIGINT, act INT, scene INT, line INT, quote_text VARCHAR, raw_bibl VARCHAR", (1, None, 1, 1, 1, "q", "r"), (2, 1, None, None, None, "q", "r"), (3, 1, 1, 1, 1, "q", "r"), (4, 1, 1, 1, 1, "q", "r"), (5, 1, 1, 1, 1, "q", "r"))
    made = citations.unmatched_report(cites, rows(t.spark, "citation_id BIGINT", (4,)))
    return made.select("bucket", "n", F.array_join(F.transform("samples", lambda x: x["id"].cast("string")), ",").alias("samples"))


@query(expect("text_line_id BIGINT, key VARCHAR, confidence DOUBLE", (1, "question", 1.0), (1, "question", 0.9), (11, "question", 1.0), (11, "question", 0.9), (7, "question", 0.9), (17, "question", 0.9), (3, "Gill2", 0.8), (13, "Gill2", 0.8), (12, "Gill2", 0.95), (4, "sea", 0.4), (14, "sea", 0.4), (3, "sea", 0.6)))
def api_reverse_lookup(t: Tables) -> DataFrame:
    """API-20."""
    d = _library(t.spark)
    return views.reverse_lookup(_matches(t), d["lexicon_citations"], d["lexicon_entries"]).select("text_line_id", "key", "confidence")


@query(expect("text_line_id BIGINT, refs VARCHAR", (1, "lexicon:question"), (11, "lexicon:question"), (7, "lexicon:question"), (17, "lexicon:question"), (3, "glossary:sling,lexicon:Gill2,lexicon:sea"), (13, "glossary:sling,lexicon:Gill2"), (12, "lexicon:Gill2"), (4, "lexicon:sea"), (14, "lexicon:sea"), (9, "glossary:buds"), (19, "glossary:buds")))
def api_line_references(t: Tables) -> DataFrame:
    """API-14: each entry once for a line."""
    d = _library(t.spark)
    found = citations.reference_matches(d["reference_citations"], d["text_lines"])
    made = views.line_references(_matches(t), d["lexicon_citations"], d["lexicon_entries"], found, d["reference_citations"], d["reference_entries"])
    return made.select("text_line_id", F.array_join(F.transform("references", lambda r: F.concat(r["source"], F.lit(":"), r["headword"])), ",").alias("refs"))


@query(expect("work_id BIGINT, row_line BIGINT, gap INT, editions VARCHAR", *((1, k, 0, f"1:{k},2:{10 + k}") for k in range(1, 6)), *((2, 5 + k, 0, f"1:{5 + k},2:{15 + k}") for k in range(1, 5)), (4, 1, 0, "1:1,2:11"), (4, 2, 0, "1:2"), (4, 2, 2, "2:12")))
def api_scene(t: Tables) -> DataFrame:
    """API-12, API-13, WIN-10: editions side by side; a line of the other edition alone stands after the last line before it."""
    s = t.spark
    extra = [(4, 1, 1, k, 1, 2, a, b, "x", 1.0) for k, (a, b) in enumerate([(1, 11), (2, None), (None, 12)], 1)]
    lines = _library(s)["text_lines"].select("id", "work_id", "edition_id", "act", "scene").union(rows(s, "id BIGINT, work_id BIGINT, edition_id BIGINT, act INT, scene INT", (1, 4, 1, 1, 1), (2, 4, 1, 1, 1), (11, 4, 2, 1, 1), (12, 4, 2, 1, 1)))
    view = views.scene_view(lines, s.createDataFrame(MAPPED + extra, TABLES["line_mappings"]), rows(s, "work_id BIGINT, edition_id BIGINT", (1, 1), (2, 1), (4, 1)))
    pairs = F.array_sort(F.transform(F.map_entries("editions"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))))
    return view.select("work_id", "row_line", "gap", F.array_join(pairs, ",").alias("editions"))


@query(expect("row_line BIGINT, source VARCHAR, headword VARCHAR", (1, "lexicon", "question"), (3, "lexicon", "sea")))
def api_row_references(t: Tables) -> DataFrame:
    """API-17: references of all editions of a row, each entry once."""
    s = t.spark
    view = s.createDataFrame([(1, 3, 1, 1, 0, {1: 1, 2: 11}), (1, 3, 1, 3, 0, {1: 3, 2: 13})], "work_id long, act int, scene int, row_line long, position int, editions map<long,long>")
    refs = s.createDataFrame([(11, [("lexicon", "question", 1)]), (1, [("lexicon", "question", 1)]), (13, [("lexicon", "sea", 3)]), (14, [("lexicon", "sea", 3)])], "text_line_id long, references array<struct<source:string,headword:string,entry_id:long>>")
    return views.row_references(view, refs).select("row_line", "source", "headword")


@query(expect("request INT, row_line BIGINT, tier INT", (1, 5, 1), (2, 7, 2), (4, 3, 3)))
def api_locate(t: Tables) -> DataFrame:
    """API-18: the cited line, a near one, any with the word, or none."""
    return views.locate(rows(t.spark, "request INT, line INT, row_line BIGINT, line_number INT, has_word BOOLEAN", (1, 10, 5, 10, True), (1, 10, 6, 9, True), (2, 10, 7, 14, True), (2, 10, 8, 30, True), (3, 1, 9, 1, False), (4, 10, 3, 99, True)))


@query(expect("kind VARCHAR, key VARCHAR, value VARCHAR, n BIGINT", ("plays", "Hamlet", "hamlet", 1), ("poetry", "Sonnets", "sonnets", 2), ("slug", "Hamlet", "hamlet", 1), ("id", "Sonnets", "sonnets", 2), ("footer", "Open", "oss", 1), ("footer", "Standard", "se", 0), ("edition", "Globe", "Open", 1), ("edition", "Globe", "Open", 2), ("edition", "Modern", "Standard", 1), ("edition", "Modern", "Standard", 2), ("letter", "G", None, 1), ("letter", "Q", None, 1), ("letter", "S", None, 1), ("source", "lexicon", None, 3)))
def api_lists(t: Tables) -> DataFrame:
    """API-03, API-04, API-06, API-07, API-09, API-16, FLT-19: lists of works, editions, letters and attributions."""
    d = _library(t.spark)
    none = F.lit(None).cast("string")
    out = views.works_list(d["works"]).select("kind", F.col("title").alias("key"), F.col("slug").alias("value"), F.col("id").alias("n"))
    for kind, key in (("slug", "hamlet"), ("id", "2")):
        out = out.union(views.find_work(d["works"], key).select(F.lit(kind), "title", "slug", "id"))
    foot = views.footer_attributions(d["attributions"], d["sources"], d["editions"], d["text_lines"])
    out = out.union(foot.select(F.lit("footer"), "name", "short_code", F.col("required").cast("long")))
    out = out.union(views.editions_of_works(d["editions"], d["sources"], d["text_lines"]).select(F.lit("edition"), "name", "source_name", "work_id"))
    out = out.union(views.letters(d["lexicon_entries"]).select(F.lit("letter"), "letter", none, "n"))
    return out.union(views.source_counts(d["lexicon_entries"], d["reference_entries"], d["sources"]).select(F.lit("source"), "source", none, "n"))


@query(expect("work_id BIGINT, edition_id BIGINT, act INT, scene INT, line_count BIGINT, near_id BIGINT", (1, 1, 3, 1, 5, None), (2, 1, 0, 18, 4, None), (None, 1, None, None, None, 1), (None, 1, None, None, None, 2), (None, 1, None, None, None, 3)))
def api_contents(t: Tables) -> DataFrame:
    """API-05, API-20, AGG-13, AGG-19: divisions of the lowest edition, and the lines around one."""
    d = _library(t.spark)
    lines, none = d["text_lines"], lambda k: F.lit(None).cast(k)
    toc = views.table_of_contents(views.divisions(lines).drop("line_count"), lines).withColumn("near_id", none("long"))
    near = views.passage(lines, rows(t.spark, "line_id BIGINT", (1,)), 2).select(none("long"), F.col("line_id"), none("int"), none("int"), none("long"), "near_id")
    return toc.union(near)


@query(expect("base_key VARCHAR, n_entries INT, n_senses INT, places VARCHAR, n_references INT", ("question", 1, 1, "1:1 exact_quote,3:7 line_number", None), ("Gill", 1, None, "4:3 exact_quote", None), ("sea", 1, None, "6:4 headword,7:3 cross_play", None)))
def api_entry(t: Tables) -> DataFrame:
    """API-10, API-11, AGG-09, JN-04: an entry's citations once for each place, each with its best match; of two unresolved places without a
    line the first."""
    d = _library(t.spark)
    made = views.entry_documents(d["lexicon_entries"], d["lexicon_senses"], d["lexicon_citations"], _matches(t), d["reference_entries"])
    shown = F.transform(F.filter("citations", lambda c: c["text_line_id"].isNotNull()), lambda c: F.concat(c["citation_id"].cast("string"), F.lit(":"), c["text_line_id"].cast("string"), F.lit(" "), c["match_type"]))
    return made.select("base_key", F.size("entries").alias("n_entries"), F.nullif(F.size("senses"), F.lit(-1)).alias("n_senses"), F.array_join(F.array_sort(shown), ",").alias("places"), F.nullif(F.size("references"), F.lit(-1)).alias("n_references"))


@query(expect("citation_id BIGINT, valid_line BIGINT", (1, 1), (2, 4)))
def api_revalidated(t: Tables) -> DataFrame:
    """API-10: a matched line without the headword gives way to the nearest that has it."""
    asked = rows(t.spark, "citation_id BIGINT, headword VARCHAR, text_line_id BIGINT", (1, "question", 4), (2, "sea2", 2), (3, "zebra", 1))
    return views.revalidated(asked, _library(t.spark)["text_lines"])


@query(expect("source VARCHAR, headword VARCHAR, text VARCHAR", ("lexicon", "question", "question: a matter"), ("lexicon", "sea", "sea: water"), ("glossary", "sling", "sling: see Ham. iii. i. 3"), ("glossary", "buds", "buds: Sonn. xviii.")))
def api_cross_search(t: Tables) -> DataFrame:
    """SET-01, FTS-08, API-08, API-16: headwords that hold the query, of the lexicon and the references."""
    d = _library(t.spark)
    return views.cross_search(d["lexicon_entries"], d["reference_entries"], "S")


@query(expect("q VARCHAR, doc BIGINT", ("slings", 3), ("slings", 13), ("char_name:hamlet slings", 3), ("char_name:hamlet slings", 13), ('"a sea of"', 4), ('"a sea of"', 14), ("temper*", 7), ("temper*", 17), ("buds OR arrow", 8), ("buds OR arrow", 18), ("buds OR arrow", 3), ("buds OR arrow", 13)))
def api_text_search(t: Tables) -> DataFrame:
    """FTS-02, FTS-04, FTS-05, FTS-09: query strings over a stemmed index of lines."""
    index = fts.build_index(_library(t.spark)["text_lines"], "id", ["content", "char_name"])
    out = None
    for q in ("slings", "char_name:hamlet slings", '"a sea of"', "temper*", "buds OR arrow"):
        found = fts.search(index, q).select(F.lit(q).alias("q"), "doc")
        out = found if out is None else out.unionByName(found)
    return out


# ---- sinks


@query(expect("k INT, v VARCHAR, how VARCHAR", (1, "old", "ignore"), (2, "x", "ignore"), (1, "n1", "replace"), (2, "y", "replace"), (3, "kept", "replace"), (3, "kept", "ignore"), (1, "z", "update"), (3, "kept", "update")))
def snk_merges(t: Tables) -> DataFrame:
    """SNK-02, SNK-03, SNK-05: first wins, last wins, update by key."""
    s = t.spark
    old, new = rows(s, "k INT, v VARCHAR", (1, "old"), (3, "kept")), rows(s, "k INT, v VARCHAR, s INT", (1, "n1", 1), (2, "x", 1), (2, "y", 2))
    ignored = writers.insert_or_ignore(old, new.select("k", "v"), ["k"], ["v"]).select("k", "v", F.lit("ignore").alias("how"))
    replaced = writers.insert_or_replace(old, new, ["k"], "s").select("k", "v", F.lit("replace"))
    return ignored.union(replaced).union(writers.update(old, rows(s, "k INT, v VARCHAR", (1, "z"), (3, None)), ["k"]).select("k", "v", F.lit("update")))


@query(expect("statement VARCHAR", ("INSERT INTO T (id, t) VALUES (1,'it''s'),(2,NULL);",), ("INSERT INTO T (id, t) VALUES (3,'x');",), ('{"id":1,"t":"it\'s"}',), ('{"id":2,"t":null}',), ('{"id":3,"t":"x"}',)))
def snk_statements(t: Tables) -> DataFrame:
    """SNK-06, SNK-07, SNK-12: statements of two rows at most, and JSON."""
    df = rows(t.spark, "id INT, t VARCHAR", (1, "it's"), (2, None), (3, "x")).coalesce(1)
    return writers.insert_statements(df, "T", rows=2).union(writers.to_json(df))


@query(expect("id BIGINT, which VARCHAR", (1, "all"), (2, "all"), (2, "named")))
def snk_licensed(t: Tables) -> DataFrame:
    """FLT-18: an unknown tier stays, non-commercial editions and excluded sources go."""
    e = rows(t.spark, "id BIGINT, license_tier VARCHAR, source_key VARCHAR", (1, "free", "a"), (2, None, "b"), (3, "non-commercial", "c"))
    lines = rows(t.spark, "id BIGINT, edition_id BIGINT", (1, 1), (2, 2), (3, 3))
    return tables.licensed(lines, e).select("id", F.lit("all").alias("which")).union(tables.licensed(lines, e, ["a"]).select("id", F.lit("named")))


@query(expect("edition_id BIGINT, lines BIGINT, match_type VARCHAR, n BIGINT, mean_confidence DOUBLE", (1, 9, None, None, None), (2, 9, None, None, None), (None, None, "exact_quote", 4, 0.9), (None, None, "line_number", 4, 0.9), (None, None, "manual", 1, 0.95), (None, None, "headword", 2, 0.4), (None, None, "cross_play", 1, 0.6)))
def api_build_summary(t: Tables) -> DataFrame:
    """OTH-12, AGG-06."""
    d = _library(t.spark)
    by_edition, by_type = views.build_summary(d["text_lines"], d["editions"], _matches(t))
    none = lambda k: F.lit(None).cast(k)
    return by_edition.select("edition_id", "lines", none("string").alias("match_type"), none("long").alias("n"), none("double").alias("mean_confidence")).union(by_type.select(none("long"), none("long"), "match_type", "n", "mean_confidence"))
