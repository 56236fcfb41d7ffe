from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from stemma.operators import fts, views
from stemma.operators.passages import edition_pairs_by_lines, find_passages
from stemma.plans.build import Build
from stemma.plans.schemas import TABLES

STEMS = [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("adoption", "adopt"), ("controll", "control"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("is", "is")]


@pytest.mark.parametrize("word,stem", STEMS)
def test_porter(word, stem):
    assert fts.porter(word) == stem


def test_tokens():
    assert fts.tokens("Élan, SLINGS and arrow_s 12") == ["elan", "sling", "and", "arrow", "s", "12"]
    q = fts.parse_query('speaker:Hamlet "slings and arrows" OR outra*')
    assert q.clauses == [[("speaker", ["hamlet"], False, False), (None, ["sling", "and", "arrow"], True, False)], [(None, ["outra"], False, True)]]
    assert fts.parse_query("").clauses == []


@pytest.fixture(scope="module")
def index(spark):
    docs = [(1, "the slings and arrows of outrageous fortune", "Hamlet"), (2, "arrows and slings", "Ghost"), (3, "outrage is fortune", "Hamlet"), (4, "", None), (5, "one two three four five", "x")]
    return fts.build_index(spark.createDataFrame(docs, "id long, content string, who string"), "id", ["content", "who"])


def test_search(index):
    ids = lambda q: {r["doc"] for r in fts.search(index, q).collect()}
    assert ids("slings arrows") == {1, 2} and ids('"slings and arrows"') == {1} and ids("outra*") == {1, 3}
    assert ids("who:hamlet fortune") == {1, 3} and ids("two OR ghost") == {2, 5} and ids("nothing") == set() and ids("") == set()
    (r,) = fts.bm25(index, ["ghost"]).collect()
    dl, avg = 4, (7 + 1 + 3 + 1 + 3 + 1 + 0 + 5 + 1) / 5
    assert r["score"] == pytest.approx(math.log((5 - 1 + 0.5) / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avg)))


def test_grouping_and_pages(index, spark):
    e = spark.createDataFrame([(1, "k"), (2, "k"), (5, "m")], "doc long, base_key string")
    got = fts.grouped(fts.bm25(index, ["sling"]), e).collect()
    assert len(got) == 1 and got[0]["base_key"] == "k"
    df = spark.range(30).withColumn("key", F.concat(F.lit("part"), "id")).withColumn("score", F.col("id").cast("double"))
    assert [r["id"] for r in fts.page(df, ["id"], limit=3, offset=4).collect()] == [4, 5, 6] and fts.page(df, ["id"], limit=1000).count() == 30
    assert [r["id"] for r in fts.tiered_page(df, "key", "part1", limit=3).collect()] == [1, 19, 18]
    assert fts.trigram_search(df, "key", "rt1").count() == 11 and fts.trigram_search(df, "key", "rt").count() == 0


def test_passages(spark):
    lines = spark.createDataFrame([(1, 1, "alpha beta gamma delta"), (1, 2, "epsilon zeta eta theta iota"), (1, 4, "beta gamma delta epsilon zeta eta theta"), (2, 1, "xbeta gamma delta epsilon zeta eta thetax"), (3, 1, "a b")], "doc_id long, line_no int, norm string")
    p = spark.createDataFrame([(7, "beta gamma delta epsilon zeta eta theta"), (8, "zeta eta theta"), (9, "no such words are in any line here")], "item_id long, norm string")
    got = {(r["item_id"], r["doc_id"]): (r["line_no"], r["confidence"]) for r in find_passages(p, lines).collect()}
    assert got == {(7, 1): (4, 1.0), (7, 2): (1, 1.0), (8, 1): (2, 1.0), (8, 2): (1, 1.0)}
    held = spark.createDataFrame([(d, f"a line that is long enough to tell {k}") for d in (1, 2) for k in range(3)] + [(3, "a line that is long enough to tell 0")], "doc_id long, line string")
    assert [(r["a"], r["b"], r["shared"]) for r in edition_pairs_by_lines(held).collect()] == [(1, 2, 3)]


def test_edition_pairs_of_frequent_lines(spark):
    line = lambda k: f"a line that is long enough to tell {k}"
    held = {d: {0, 1, 2, 3} for d in range(25)} | {30: {0, 1, 2}, 31: {1, 2, 3, 9}, 32: {0, 1, 7}, 33: {7, 8, 9}, 34: {7, 8, 9}, 35: {0}}
    lines = spark.createDataFrame([(d, line(k)) for d, ks in held.items() for k in ks], "doc_id long, line string")
    want = {(a, b, len(held[a] & held[b])) for a in held for b in held if a < b and len(held[a] & held[b]) >= 3}
    got = edition_pairs_by_lines(lines).collect()
    assert {(r["a"], r["b"], r["shared"]) for r in got} == want and len(got) == len(want) > 300


def test_short_passages(spark):
    """Passages of one and two words are found wherever their letters stand, also within words and over two lines."""
    from stemma.operators.passages import find_passages

    lines = spark.createDataFrame([(1, 1, "the heart of it"), (1, 2, "art thou"), (2, 1, "no such thing"), (2, 5, "part"), (2, 6, "ly so"), (3, 1, "ar")], "doc_id long, line_no int, norm string")
    passages = spark.createDataFrame([(1, "art"), (2, "it art"), (3, "such thing"), (4, "rt l"), (5, "ar"), (6, "zzz"), (7, "of it art")], "item_id long, norm string")
    got = {(r["item_id"], r["doc_id"]): (r["line_no"], r["confidence"]) for r in find_passages(passages, lines).collect()}
    assert got == {(1, 1): (1, 1.0), (1, 2): (5, 1.0), (2, 1): (1, 0.95), (3, 2): (1, 1.0), (4, 2): (5, 0.95), (7, 1): (1, 0.95)}


def test_small_views(spark):
    works = spark.createDataFrame([(1, "Hamlet", "play"), (2, "Sonnets", "sonnet_sequence"), (3, "Other", "essay")], "id long, title string, work_type string")
    assert [(r["kind"], r["slug"]) for r in views.works_list(works).collect()] == [("plays", "hamlet"), ("poetry", "sonnets")]
    assert views.find_work(works, "hamlet").first()["id"] == 1 and views.find_work(works, "2").first()["title"] == "Sonnets"
    assert views.stats_row(works=works, none=works.limit(0)).first().asDict() == {"works": 3, "none": 0}
    lines = spark.createDataFrame([(1, 1, 2, 1, 1, 1, "a"), (2, 1, 2, 1, 1, 2, "b"), (3, 1, 5, 1, 2, 1, "c")], "id long, work_id long, edition_id long, act int, scene int, line_number int, content string")
    toc = views.table_of_contents(views.divisions(lines).drop("line_count"), lines).collect()
    assert [(r["edition_id"], r["line_count"]) for r in toc] == [(2, 2)]
    adjacent = views.adjacent_scenes(lines.select("work_id", "act", "scene").distinct()).orderBy("scene").collect()
    assert adjacent[0]["previous"] is None and adjacent[0]["next"]["scene"] == 2
    assert {r["near_id"] for r in views.passage(lines, spark.createDataFrame([(1,)], "line_id long")).collect()} == {1, 2}
    rows = spark.createDataFrame([(1, 10, 5, 10, True), (1, 10, 6, 9, True), (2, 10, 7, 14, True), (2, 10, 8, 30, True), (3, 1, 9, 1, False)], "request int, line int, row_line long, line_number int, has_word boolean")
    assert {r["request"]: (r["row_line"], r["tier"]) for r in views.locate(rows).collect()} == {1: (5, 1), 2: (7, 2)}


def test_scene_view(spark):
    lines = spark.createDataFrame([(k, 1, 1, 1, 1) for k in (1, 2, 3)] + [(k, 1, 2, 1, 1) for k in (11, 12, 13)], "id long, work_id long, edition_id long, act int, scene int")
    maps = spark.createDataFrame([(1, 1, 1, k, 1, 2, a, b, "x", 1.0) for k, (a, b) in enumerate([(1, 11), (2, None), (None, 12), (3, 13)], 1)], "work_id long, act int, scene int, align_order int, edition_a_id long, edition_b_id long, line_a_id long, line_b_id long, match_type string, similarity double")
    view = views.scene_view(lines, maps, spark.createDataFrame([(1, 1)], "work_id long, edition_id long"))
    got = {(r["row_line"], r["gap"]): r["editions"] for r in view.collect()}
    assert got == {(1, 0): {1: 1, 2: 11}, (2, 0): {1: 2}, (2, 2): {2: 12}, (3, 0): {1: 3, 2: 13}}
    refs = spark.createDataFrame([(11, [("lexicon", "w", 5)]), (1, [("lexicon", "w", 5)])], "text_line_id long, references array<struct<source:string,headword:string,entry_id:long>>")
    assert views.row_references(view, refs).count() == 1
    assert {r["edition_id"] for r in views.visible_editions(view).collect()} == {1, 2}


def test_capped_documents(spark):
    df = spark.createDataFrame([("k", ["x" * 100] * 64), ("m", ["y"])], "base_key string, references array<string>")
    got = {r["base_key"]: json.loads(r["data"]) for r in views.capped_documents(df, most=1000).collect()}
    assert len(got["k"]["references"]) == 8 and got["m"]["references"] == ["y"]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("build"))
    play = ["To be or not to be that is the question", "Whether tis nobler in the mind to suffer", "The slings and arrows of outrageous fortune", "Or to take arms against a sea of troubles", "And by opposing end them to die to sleep"]
    sonnet = ["Shall I compare thee to a summers day", "Thou art more lovely and more temperate", "Rough winds do shake the darling buds", "And summers lease hath all too short a date"]
    lines, n = [], 0
    for edition in (1, 2):
        for work, act, scene, text in ((1, 3, 1, play), (2, 0 if edition == 1 else None, 18, sonnet)):
            for k, t in enumerate(text, 1):
                n += 1
                t = t + " no more" if edition == 2 and k == len(text) else t
                lines.append((n, work, edition, act, scene, k, "HAMLET", t, "speech", len(t.split())))
    data = {
        "works": [(1, "hamlet", "Hamlet", "Hamlet", "Hml.", "play", "t", None), (2, "sonnets", "Sonnets", "Sonnets", "Sonn.", "sonnet_sequence", "s", None)],
        "editions": [(1, "Globe", "oss_globe", 1, 1864, "", "", "oss", None), (2, "Modern", "se_modern", 2, 2020, "", "", "se", "cc0")],
        "text_lines": lines,
        "lexicon_entries": [(1, "question", "question", None, "Q", "question: a matter"), (2, "Gill2", "Gill", 2, "G", "gill")],
        "lexicon_citations": [(1, 1, 1, 1, "Hml.", 3, 1, 1, "that is the question", "Hml. III, 1, 1", "shak. ham 3.1.1", "question"), (2, 1, 1, 1, "Hml.", 3, 1, 1, "", "", "shak. ham 3.1.1", "question")],
        "reference_entries": [(1, "glossary", "sling", "S", "sling: see Ham. iii. i. 3")],
        "reference_citations": [(1, 1, "glossary", 1, 3, 1, 3)],
    }
    for name, schema in TABLES.items():
        spark.createDataFrame(data.get(name, []), schema).write.mode("overwrite").parquet(f"{root}/{name}")
    b = Build(spark, root)
    b.run()
    return b


def test_end_to_end(built):
    m = built.table("line_mappings").where("work_id = 1").orderBy("align_order").collect()
    assert [r["align_order"] for r in m] == [1, 2, 3, 4, 5] and sum(r["similarity"] == 1.0 for r in m) >= 4 and any(r["similarity"] < 1 for r in m)
    assert built.table("line_mappings").where("work_id = 2 AND line_a_id IS NOT NULL AND line_b_id IS NOT NULL").count() == 4
    matches = built.table("citation_matches")
    assert {(r["citation_id"], r["edition_id"]) for r in matches.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    found = views.reverse_lookup(matches, built.table("lexicon_citations"), built.table("lexicon_entries")).where("text_line_id = 1").collect()
    assert {r["key"] for r in found} == {"question"} and max(r["confidence"] for r in found) >= 0.8
    assert {r["edition_id"] for r in built.table("reference_citation_matches").collect()} == {1, 2}
    i = fts.build_index(built.table("text_lines"), "id", ["content", "char_name"])
    assert fts.search(i, "slings").count() == 2 and fts.search(i, "char_name:hamlet slings").count() == 2
    assert built.table("import_log").count() == 4


def test_rerun_changes_nothing(built):
    before = {t: sorted(map(str, built.table(t).collect())) for t in ("line_mappings", "citation_matches", "reference_citation_matches")}
    built.run(exclude=("fts",))
    assert before == {t: sorted(map(str, built.table(t).collect())) for t in before}


def test_partitioning_does_not_matter(built, spark):
    from stemma.operators.align import align_editions

    args = [built.table(t) for t in ("text_lines", "works", "editions")]
    before = sorted(map(str, align_editions(*args).collect()))
    n = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert before == sorted(map(str, align_editions(*args).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)


def test_documents(built, spark):
    senses = spark.createDataFrame([(1, 1, 1, None, "a matter")], TABLES["lexicon_senses"])
    docs = views.entry_documents(built.table("lexicon_entries"), senses, built.table("lexicon_citations"), built.table("citation_matches"), built.table("reference_entries")).collect()
    q = next(r for r in docs if r["base_key"] == "question")
    assert len(q["citations"]) == 1 and q["citations"][0]["text_line_id"] == 1 and len(q["senses"]) == 1 and q["references"] is None
    valid = views.revalidated(spark.createDataFrame([(1, "question", 4)], "citation_id long, headword string, text_line_id long"), built.table("text_lines")).collect()
    assert [(r["citation_id"], r["valid_line"]) for r in valid] == [(1, 1)]
    refs = views.line_references(built.table("citation_matches"), built.table("lexicon_citations"), built.table("lexicon_entries"), built.table("reference_citation_matches"), built.table("reference_citations"), built.table("reference_entries"))
    assert {r["text_line_id"]: len(r["references"]) for r in refs.collect()}[1] == 1
    assert [r["headword"] for r in views.cross_search(built.table("lexicon_entries"), built.table("reference_entries"), "s").collect()] == ["question", "sling"]


def test_empty_build(spark, tmp_path):
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
    b = Build(spark, str(tmp_path))
    b.run()
    assert b.table("line_mappings").count() == 0 and b.table("citation_matches").count() == 0
