from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stemma.sources import citation_text as ct
from stemma.sources import lexicon, markup, ocr, sqldump, tables, writers

DUMP = r"""
-- a comment; with a semicolon
CREATE TABLE `Works` (id int); /* another; one */
INSERT INTO `Works` VALUES ('hamlet','Hamlet; Prince','it''s \'so\'',NULL,12),('lear','Lear (King)','a\nb',NULL,-3.5);
insert into Chapters values (1,'x');
"""


def test_dump():
    s = list(sqldump.statements(DUMP))
    assert len(s) == 3 and s[0].startswith("CREATE")
    assert [sqldump.insert_table(x) for x in s] == [None, "Works", "Chapters"]
    assert list(sqldump.insert_rows(s[1])) == [["hamlet", "Hamlet; Prince", "it's 'so'", None, "12"], ["lear", "Lear (King)", "a\nb", None, "-3.5"]]
    assert list(sqldump.insert_rows("SELECT 1")) == [] and list(sqldump.statements("")) == []


def test_dump_tables(spark, tmp_path):
    (tmp_path / "d.sql").write_text(DUMP)
    rows = sqldump.read_dump(spark, str(tmp_path / "d.sql"))
    works = sqldump.dump_table(rows, "Works", {"oss_id": "string", "title": "string", "note": "string", "nothing": "string", "n": "int"}, 5)
    assert [(r["oss_id"], r["n"]) for r in works.orderBy("ordinal").collect()] == [("hamlet", 12), ("lear", None)]
    p = spark.createDataFrame([(1, " To be\n[p]or not\n[p]\n[p] to be ")], "id int, t string")
    assert [(r["pos"], r["line"]) for r in sqldump.verse_lines(p, "t").collect()] == [(0, "To be"), (1, "or not"), (2, "to be")]


def test_references():
    kinds = {"ham": "play", "son": "sonnet_sequence", "ven": "poem", "shr": "play"}
    at = lambda ref: tuple((ct.parse_reference(ref, kinds) or {}).get(k) for k in ("code", "act", "scene", "line"))
    assert at("shak. ham 3.1.56") == ("ham", 3, 1, 56)
    assert at("shak. son 1.14") == ("son", None, 1, 14) and at("shak. son 14") == ("son", None, None, 14)
    assert at("shak. ham 5.1") == ("ham", 5, 1, None) and at("shak. ham 4.60") == ("ham", 4, None, 60)
    assert at("shak. ven 1.2.30") == ("ven", None, None, 30) and at("shak. ven ven 12") == ("ven", None, None, 12)
    assert at("shak. shr ind.2.77") == ("shr", 0, 2, 77) and at("shak. ham") == ("ham", None, None, None)
    assert ct.parse_reference("shak. xyz 1.1", kinds) is None and ct.parse_reference("hom. il. 1", kinds) is None
    full = ct.supplement(ct.parse_reference("shak. ham 1.2", kinds), "Hml. I, 2, 15", "play")
    assert (full["act"], full["scene"], full["line"]) == (1, 2, 15)
    two = ct.supplement(ct.parse_reference("shak. ham 4.12", kinds), "Tp. IV, 12.", "play")
    assert (two["scene"], two["line"]) == (None, 12)


def test_inline_citations():
    forms = ct.Forms(plays=("Ham.", "Tw.N.", "Tw."), sonnets=("Sonn.",), poems=("Lucr.",))
    text = "see Ham.  ii.  i.  58, Tw.N. iii. iv. 2; Sonn.  xlii.  7 and Lucr.  1403. Ham. ii. i. 58 éHam. i. i. 1"
    assert ct.citations(text, forms) == [("Ham.", 2, 1, 58), ("Tw.N.", 3, 4, 2), ("Sonn.", None, 42, 7), ("Lucr.", None, None, 1403), ("Ham.", 1, 1, 1)]
    for name, *_, a, b in ct.spans(text, forms):
        assert text[a:b].startswith(name)
    assert len(ct.spans(text, forms)) == 6 and ct.citations(None, forms) == []
    mixed = ct.Forms(plays=("J. C.",), style="mixed")
    assert ct.citations("J.  C.  iii.  2.  119.", mixed) == [("J. C.", 3, 2, 119)]


def test_concordance_citations():
    forms = ct.Forms(plays=("Com. of Errors", "Coriolanus"), poems=("Sonnet",), style="spaced", spellings={"Coriolanut": "Coriolanus"})
    text = "Quarry.  near  the  old  quarry  stood  Com.  of  Errors  iv  2  61\nas before  iii  2  5\nLet us go Coriolanut  ii  2  152\n sweet  Sonnet  12\nvi  1  2"
    assert ct.citations(text, forms) == [("Com. of Errors", 4, 2, 61), ("Com. of Errors", 3, 2, 5), ("Coriolanus", 2, 2, 152), ("Sonnet", None, None, 12), ("Sonnet", 6, 1, 2)]
    henley = ct.Forms(plays=("Hamlet", "Henry V"), style="act_scene")
    assert ct.citations("1602. Hamlet [1602], iii. Sc. 2; Henry V [iv., 3.]", henley) == [("Hamlet", 3, 2, None), ("Henry V", 4, 3, None)]
    assert ct.segments("see Ham. i. here", [(4, 11)]) == [("see ", False), ("Ham. i.", True), (" here", False)]


def test_senses():
    assert lexicon.senses("plain meaning") == [(1, None, "plain meaning")]
    assert lexicon.senses("1) first (see 2) x) 2) second: a) one b) two") == [(1, None, "first (see 2) x)"), (2, None, "second:"), (2, "a", "one"), (2, "b", "two")]
    assert lexicon.sense_of("1) see A 2) see B", "B") == 2 and lexicon.sense_of("1) see A 2) see B", "A") == 1 and lexicon.sense_of("no", "x") == 1


ENTRY = """<?xml version="1.0"?><TEI.2><text><body><div1 n="G"><entryFree key="Gill2" type="main"><orth>Gill,</orth> 1) a fish & part: <cit><quote>by the gills</quote> <bibl n="shak. tn 2.5.26">Tw. II, 5, 26</bibl></cit>. 2) a girl: <bibl n="shak. ham 1.2.3">Hml. I, 2, 3</bibl> <bibl n="hom. 1">X</bibl></entryFree></div1></body></text></TEI.2>"""


def test_lexicon(spark):
    e = lexicon.parse_entry(ENTRY)
    assert e["key"] == "Gill2" and "a fish & part" in e["full_text"] and len(e["senses"]) == 2
    assert [(c["raw_bibl"], c["quote_text"], c["sense_number"]) for c in e["citations"]] == [("shak. tn 2.5.26", "by the gills", 1), ("shak. ham 1.2.3", "", 2)]
    files = spark.createDataFrame([("a.xml", ENTRY), ("b.xml", ENTRY.replace("girl", "second file"))], "path string, value string")
    parsed = files.lateralJoin(lexicon.LexiconEntry(F.col("value").outer()))
    entries, senses, cites = lexicon.lexicon_tables(parsed)
    assert [(r["base_key"], r["sense_group"], r["letter"]) for r in entries.collect()] == [("Gill", 2, "G")]
    assert senses.count() == 2 and cites.where("sense_id IS NOT NULL").count() == 2


PLAY = """<TEI><text><body><div1 type="act" n="1"><div2 type="scene" n="2"><stage>Enter GHOST.</stage>
<sp who="ham"><speaker>Ham.</speaker><p>My fate <lb ed="G" n="5"/>cries out<lb ed="F"/> and <stage>aside</stage>more</p></sp>
<sp who="gho"><speaker>Ghost.</speaker><l n="7">Mar<g ref="x"/>k me</l><l>and <gap/> ſpeak</l></sp></div2></div1>
<div1 type="act" n="II"><sp><speaker>A.</speaker><l>one &amp; two</l></sp></div1></body></text></TEI>"""


def test_tei_play():
    rows = list(markup.tei_play(PLAY))
    assert [(r[0], r[1], r[5], r[6], r[7], r[8]) for r in rows] == [
        (1, 2, "Enter GHOST.", True, False, None),
        (1, 2, "My fate", False, False, None),
        (1, 2, "cries out and more", False, False, 5),
        (1, 2, "Mark me", False, True, 7),
        (1, 2, "and [?] speak", False, True, None),
        (2, 1, "one & two", False, True, None),
    ]
    assert rows[3][3:5] == ("Ghost.", "gho") and [r[2] for r in rows] == [1, 2, 3, 4, 5, 6]
    assert {(r[0], r[1]) for r in markup.quarto(PLAY)} == {(1, 1)}


WORDS = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div1 type="act" n="1"><div2 type="scene" n="1"><sp who="#a"><speaker>A</speaker>
<l n="1.1.3"><w lemma="who" pos="q">Who</w><pc>'</pc><w lemma="be">s</w><c> </c><w>there</w><pc>?</pc></l></sp><stage n="SD 1.1.3" who="#b"><w>Exit</w></stage></div2></div1></body></text></TEI>"""


def test_words_play(spark):
    rows = list(markup.tei_words_play(WORDS))
    assert rows[0][5] == "Who's there?" and rows[0][8] == 3 and rows[0][9][0] == ("Who", "who", "q") and rows[1][6] and rows[1][8] == 0
    got = markup.parse_files(spark.createDataFrame([("f", WORDS)], "name string, xml string"), "xml", markup.WordsPlay, ["name"]).collect()
    assert [(r["name"], r["text"], len(r["words"])) for r in got] == [("f", "Who's there?", 3), ("f", "Exit", 1)]


XHTML = """<html><body><section id="act-1"><section id="scene-1-1"><h3>Scene I</h3><table><tr><td/><td><i epub:type="z3998:stage-direction">Enter two.</i></td></tr>
<tr><td epub:type="z3998:persona">Ber<b>nardo</b></td><td epub:type="z3998:verse"><p><span>Who&#8217;s there?</span><br/><span>Stand.</span></p></td></tr>
<tr><td epub:type="z3998:persona">Fran</td><td>Nay, answer me.</td></tr></table></section><section id="epilogue"><table><tr><td epub:type="z3998:persona">E</td><td>Bye.</td></tr></table></section></section></body></html>"""


def test_xhtml():
    rows = list(markup.xhtml_play(XHTML))
    assert [(r[0], r[1], r[3], r[5], r[6], r[8]) for r in rows] == [
        (1, 1, None, "Enter two.", True, None),
        (1, 1, "Bernardo", "Who’s there?", False, 1),
        (1, 1, "Bernardo", "Stand.", False, 2),
        (1, 1, "Fran", "Nay, answer me.", False, 3),
        (1, 99, "E", "Bye.", False, 1),
    ]
    poems = """<article id="sonnet-18"><header><h2>XVIII</h2></header><p><span>Shall I</span><br/><span>Thou art</span></p></article><article id="lucrece"><section id="dedication"><p>To X</p></section><p><span>From</span></p><p><span>Lust</span></p></article>"""
    assert list(markup.xhtml_poems(poems)) == [("sonnet-18", 18, 1, 1, "Shall I"), ("sonnet-18", 18, 1, 2, "Thou art"), ("lucrece", None, 1, 1, "From"), ("lucrece", None, 2, 2, "Lust")]
    assert markup.html_lines("<head><title>T</title></head><p>a <b>b</b></p><script>var t='</p>'</script><div>c<br>d</div>") == ["a b", "c", "d"]


def test_xml_tolerance():
    assert markup.text_of(markup.parse_xml("<!DOCTYPE x [<!ENTITY a 'b'>]><a>x & y &eacute; <b>z</b> w</a>"), frozenset(["b"])) == "x & y é w"


def test_numbering(spark):
    rows = [(1, None), (2, 5), (3, None), (4, None), (5, 9), (6, None), (7, None)]
    df = spark.createDataFrame([(1, p, n, p == 3) for p, n in rows], "s int, p int, n int, stage boolean")
    got = {r["p"]: r["line_number"] for r in markup.interpolate_numbers(df, "n", ["s"], ["p"], "stage").collect()}
    assert got == {1: 4, 2: 5, 3: 5, 4: 7, 5: 9, 6: 10, 7: 11}
    plain = markup.interpolate_numbers(df.withColumn("n", F.lit(None).cast("int")), "n", ["s"], ["p"]).collect()
    assert [r["line_number"] for r in sorted(plain, key=lambda r: r["p"])] == [1, 2, 3, 4, 5, 6, 7]


def test_ocr(spark, tmp_path):
    (tmp_path / "v1.txt").write_text("front matter\nabate, vb. to lessen\nmore of it\n12\nabhor: to hate Shak\n")
    got = {r["headword"]: r["raw_text"] for r in ocr.reference_entries(ocr.read_lines(spark, str(tmp_path)), "glossary").collect()}
    assert got == {"abate": "abate, vb. to lessen\nmore of it", "abhor": "abhor: to hate Shak"}
    lines = spark.createDataFrame([("v", k, x) for k, x in enumerate(["x", "GRAMMAR.", "1. Adjectives are", "used freely", "600. no", "2. Also", "INDEX TO THE QUOTATIONS", "3. not"])], "volume string, line_no int, line string")
    assert {r["headword"]: r["raw_text"] for r in ocr.reference_entries(lines, "grammar").collect()} == {"§ 1": "1. Adjectives are\nused freely\n600. no", "§ 2": "2. Also"}
    slang = spark.createDataFrame([("v", k, x) for k, x in enumerate(["ABRAM, subs. a cheat", "1600. Shakspeare", "ACE, subs. other"])], "volume string, line_no int, line string")
    assert [r["headword"] for r in ocr.reference_entries(slang, "slang").collect()] == ["abram"]
    conc = spark.createDataFrame([("v", k, x) for k, x in enumerate(["Abbey.  In the abbey", "and more", "ACT.  I", "Able.  He is able"])], "volume string, line_no int, line string")
    assert {r["headword"] for r in ocr.reference_entries(conc, "concordance").collect()} == {"abbey", "able"}


def test_small_tables(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"ham": "Hml.", "tn": "Tw."}')
    assert {r["key"]: r["value"] for r in tables.read_map(spark, str(tmp_path / "m.json")).collect()} == {"ham": "Hml.", "tn": "Tw."}
    cites = spark.createDataFrame([(1, 9, 0, 0, None, "Hom. 1", "a"), (2, 9, None, None, 1, "Hom. 2", "b")], "id long, work_id long, act int, scene int, line int, raw_bibl string, headword string")
    works = spark.createDataFrame([(9,)], "id long")
    assert [tuple(r) for r in tables.external_lines(cites, cites.limit(0), works).select("work_id", "act", "line_number", "content", "edition_id").collect()] == [(9, None, 1, "[Hom. 1] a", 0)]
    lines = spark.createDataFrame([("Hamlet", 2, "b"), ("Hamlet", 1, "a"), ("Nothing", 1, "x")], "title string, pos int, text string")
    numbered, unknown = tables.play_level_numbers(lines, spark.createDataFrame([("Hamlet", 1)], "title string, work_id long"))
    assert {r["text"]: r["line_number"] for r in numbered.collect()} == {"a": 1, "b": 2} and [r["title"] for r in unknown.collect()] == ["Nothing"]
    editions = spark.createDataFrame([(1, "free", "a"), (2, None, "b"), (3, "non-commercial", "c")], "id long, license_tier string, source_key string")
    text = spark.createDataFrame([(k, k) for k in (1, 2, 3)], "id long, edition_id long")
    assert {r["id"] for r in tables.licensed(text, editions).collect()} == {1, 2} and {r["id"] for r in tables.licensed(text, editions, ["b"]).collect()} == {1}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "w int, e int, t string")
    for _ in range(2):
        writers.overwrite_partitions(df, f"{tmp_path}/t", ["w", "e"])
    writers.overwrite_partitions(df.where("w = 2").withColumn("t", F.lit("d")), f"{tmp_path}/t", ["w", "e"])
    assert sorted(r["t"] for r in spark.read.parquet(f"{tmp_path}/t").collect()) == ["a", "b", "d"]
    old = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "n1", 1), (2, "x", 1), (2, "y", 2)], "k int, v string, s int")
    assert {r["k"]: r["v"] for r in writers.insert_or_ignore(old, new.select("k", "v"), ["k"], ["v"]).collect()} == {1: "old", 2: "x"}
    assert {r["k"]: r["v"] for r in writers.insert_or_replace(old, new, ["k"], "s").collect()} == {1: "n1", 2: "y"}
    assert [r["v"] for r in writers.update(old, spark.createDataFrame([(1, "z")], "k int, v string"), ["k"]).collect()] == ["z"]
    s = [r["statement"] for r in writers.insert_statements(spark.createDataFrame([(1, "it's"), (2, None), (3, "x")], "id int, t string").coalesce(1), "T", rows=2).collect()]
    assert s == ["INSERT INTO T (id, t) VALUES (1,'it''s'),(2,NULL);", "INSERT INTO T (id, t) VALUES (3,'x');"]
    writers.log_phase(spark, f"{tmp_path}/log", "fts", 3, 0.5)
    assert spark.read.parquet(f"{tmp_path}/log").first()["count"] == 3
    assert writers.to_json(old).first()["value"] == '{"k":1,"v":"old"}'


def test_stream(spark, tmp_path):
    from stemma.streaming.ingest import ingest_files

    src = spark.createDataFrame([(1, "a b"), (2, "c")], "w int, t string")
    src.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest_files(spark, f"{tmp_path}/in", "w int, t string", lambda df: df.select("w", F.explode(F.split("t", " ")).alias("x")), f"{tmp_path}/out", ["w"], f"{tmp_path}/ck").awaitTermination()
    assert sorted(r["x"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("q", ["", "x"])
def test_missing_files(spark, q):
    a = spark.createDataFrame([("a",), ("b",)], "name string")
    assert {r["name"] for r in tables.missing_files(a, a.where(f"name = '{q}'")).collect()} == {"a", "b"}


def test_shown_numbers():
    said = {"Hml. I, 2, 15": [1, 2, 15], "Tp. IV, 12.": [4, 12], "Sonn. 18, 3": [18, 3], "Ven. 30": [30], "H6A I, 1, 1, 1": [1, 1, 1], "no number": [], "": [], "Ham.III": [3], "1, 2, 3, 4": [2, 3, 4]}
    assert {s: ct.shown_numbers(s) for s in said} == said and ct.shown_numbers(None) == []
