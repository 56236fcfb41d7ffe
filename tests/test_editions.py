from __future__ import annotations

from stemma.sources import editions, sqldump

POEM = '<TEI><text><body><div1 type="sonnet" n="XVIII"><l>Shall I</l><lg><l n="5">Thou art</l><l>Rough</l></lg></div1><div1 type="sonnet" n="x1"><l>skip</l></div1><div1 type="sonnet" n="2"><l>When</l></div1></body></text></TEI>'
STORY = '<TEI><text><body><div1 n="1"><l>Even</l></div1><div1 n="2"><l>Had</l><l> </l></div1></body></text></TEI>'
PLAY = '<TEI><text><body><div1 type="act" n="1"><div2 type="scene" n="1"><stage>Enter</stage><sp><speaker>A</speaker><p>one <lb ed="G" n="4"/>two <lb ed="G"/>three</p></sp></div2></div1></body></text></TEI>'


def test_poems(spark):
    assert list(editions.tei_poem(POEM)) == [(18, 1, "Shall I"), (18, 5, "Thou art"), (18, 6, "Rough"), (2, 1, "When")]
    assert list(editions.tei_poem(STORY)) == [(1, 1, "Even"), (2, 2, "Had")]
    got = editions.tei_poems(spark.createDataFrame([(7, POEM)], "work_id long, xml string"), 3).collect()
    assert {(r["act"], r["scene"], r["line_number"]) for r in got} == {(1, 18, 1), (1, 18, 5), (1, 18, 6), (1, 2, 1)} and len({r["id"] for r in got}) == 4


def test_plays(spark):
    files = spark.createDataFrame([(7, "ham", 1603, PLAY)], "work_id long, oss_id string, year int, xml string")
    globe = editions.globe_plays(files.select("work_id", "xml"), 1).orderBy("line_number").collect()
    assert [(r["line_number"], r["content"], r["content_type"]) for r in globe] == [(0, "Enter", "stage_direction"), (3, "one", "speech"), (4, "two", "speech"), (5, "three", "speech")]
    folio = editions.folio_plays(files.select("work_id", "xml"), 2)
    assert sorted(r["line_number"] for r in folio.collect()) == [1, 2, 3, 4]
    e, lines = editions.quarto_plays(files)
    assert [r["short_code"] for r in e.collect()] == ["q1_ham_1603"] and lines.count() == 4


def test_words(spark):
    xml = '<TEI><text><body><div1 type="act" n="1"><div2 type="scene" n="1"><sp><l n="1.1.3"><w lemma="a">A</w><c> </c><w>b</w></l><l><w>c</w></l></sp></div2></div1></body></text></TEI>'
    lines, words = editions.word_plays(spark.createDataFrame([(1, xml)], "work_id long, xml string"), 5)
    assert [(r["line_number"], r["content"]) for r in lines.orderBy("content").collect()] == [(3, "A b"), (3, "c")]
    assert sorted((r["position"], r["word"], r["lemma"]) for r in words.collect()) == [(1, "A", "a"), (1, "c", None), (2, "b", None)]


def test_xhtml_editions(spark):
    act = lambda n, t: f'<section id="act-{n}"><section id="scene-{n}-1"><table><tr><td epub:type="z3998:persona">P</td><td>{t}</td></tr></table></section></section>'
    import json

    play = json.dumps({"act-2.xhtml": act(2, "second"), "act-1.xhtml": act(1, "first")})
    got = editions.xhtml_plays(spark.createDataFrame([(1, play)], "work_id long, json string"), 2).collect()
    assert sorted((r["act"], r["scene"], r["line_number"], r["content"], r["char_name"]) for r in got) == [(1, 1, 1, "first", "P"), (2, 1, 1, "second", "P")]
    poems = '<article id="sonnet-3"><p><span>Look</span></p></article><article id="venus"><p><span>Even</span></p></article><article id="other"><p>x</p></article>'
    articles = spark.createDataFrame([("sonnet", 5), ("venus", 6)], "article string, work_id long")
    poetry = editions.xhtml_poetry(spark.createDataFrame([(poems,)], "html string"), articles, 2).collect()
    assert sorted((r["work_id"], r["act"], r["scene"], r["content"]) for r in poetry) == [(5, None, 3, "Look"), (6, None, None, "Even")]


def test_dump_edition(spark, tmp_path):
    sql = "INSERT INTO Paragraphs VALUES ('ham',1,2,'hamlet','To be\n[p]or &#110;ot','x','y','b',3,1,10,4),('ham',2,1,'xxx','Enter','x','y','b',3,1,5,1),('short',1);"
    (tmp_path / "d.sql").write_text(sql)
    tables = editions.dump_tables(sqldump.read_dump(spark, str(tmp_path / "d.sql")))
    lines = editions.dump_lines(tables["paragraphs"], 1).orderBy("line_number").collect()
    assert [(r["act"], r["scene"], r["line_number"], r["content"], r["content_type"]) for r in lines] == [(3, 1, 1, "Enter", "stage_direction"), (3, 1, 2, "To be", "speech"), (3, 1, 3, "or not", "speech")]
