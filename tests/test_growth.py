"""Steps whose work must not grow faster than their rows."""

from __future__ import annotations

import random
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from stemma.operators import align, citations, evidence, fts, passages, scan, stored, views
from stemma.plans import literary_queries, relational_queries, split_queries
from stemma.plans.registry import queries
from stemma.sources import automaton, citation_text
from stemma.sources.versioned import VersionedTable

queries()


def joined_rows(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_prefix_join_meets_one_supplier_of_each_prefix(spark):
    part = spark.createDataFrame([(1, 5, "sun"), (2, 5, ""), (3, 5, None), (4, 6, "Sea"), (5, 7, "x"), (6, None, "s")], "p_partkey long, p_size int, p_name string")
    supplier = spark.createDataFrame([(9, 5, "Supplier#9"), (4, 5, "tree"), (7, 6, "Sand"), (3, 7, None), (8, None, "s")], "s_suppkey long, s_nationkey int, s_name string")
    got = relational_queries.prefix_theta_join(SimpleNamespace(part=part, supplier=supplier))
    assert {tuple(r) for r in got.collect()} == {(1, 9), (2, 4), (4, 7)}
    assert "StartsWith" not in joined_rows(got)  # no test over all pairs of a nation


def test_titles_of_many_rows_are_dealt_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(relational_queries, "OUT", 100)
    part = spark.createDataFrame([(k, "a", "b", 1) for k in range(40)] + [(k, "c", "d", None) for k in range(40, 45)] + [(50, "e", "f", 2)], "p_partkey long, p_type string, p_brand string, p_size int")
    got = relational_queries.alias_expansion(SimpleNamespace(part=part))
    rows = got.withColumn("at", F.spark_partition_id()).collect()
    assert sorted((r["id"], r["alias_id"]) for r in rows) == sorted([(a, b) for a in range(40) for b in range(40)] + [(50, 50)])
    assert len({r["at"] for r in rows}) > 4


def test_pairs_of_suppliers_are_not_shuffled(spark):
    items = spark.createDataFrame([(1, 3), (1, 1), (1, 3), (1, 2), (2, 1), (2, 3), (3, 5), (None, 7), (None, 8), (4, None), (4, 9)], "l_partkey long, l_suppkey long")
    got = relational_queries.pairs_with_shared_key(SimpleNamespace(lineitem=items))
    assert sorted(map(tuple, got.collect())) == [(1, 2), (1, 3), (2, 3)]
    assert "Exchange" not in joined_rows(got).split("Generate explode(rest")[0]  # pairs are made after the last shuffle


def test_equal_texts_are_aligned_without_a_matrix(monkeypatch):
    r = random.Random(4)
    for n in (1, 5, 40):
        text = [" ".join(r.choices(["a", "b", "sea", "sand", ""], k=r.randrange(6))) for _ in range(n)]
        numbers, kinds = [r.randrange(5) for _ in text], ["speech"] * n
        side = lambda t: align.Lines(t, numbers, kinds)  # noqa: B023, E731
        plain = align.align_sequences(side(text), side([t + " " for t in text]), 0.15)  # the same to every measure, by the whole way
        with monkeypatch.context() as m:
            m.setattr(align, "similarity_matrix", None)
            assert align.align_sequences(side(text), side(text), 0.15) == plain


def test_rows_of_classes_for_pairs_of_documents(spark):
    classes = spark.createDataFrame([(1, 1), (4, 1), (6, 1), (2, 2), (5, 2)], "doc_id long, rep long")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "a long, b long")
    rows = spark.createDataFrame([(1, 1, "s"), (1, 2, "x"), (2, 1, "y")], "a long, b long, v string")
    got = {tuple(x) for x in literary_queries._each(rows, pairs, classes, "a", "b").collect()}
    assert got == {(1, 4, "s"), (1, 6, "s"), (4, 6, "s"), (1, 2, "x"), (1, 5, "x"), (4, 5, "x"), (2, 4, "y"), (2, 6, "y"), (5, 6, "y")}


@pytest.mark.parametrize("shown", [True, False])
def test_scenes_seen_as_the_view_has_them(spark, shown):
    m = spark.createDataFrame([(1, 1, 1, 1, 1, 2, 1, 7 if shown else None, "aligned", 1.0), (1, 1, 1, 2, 1, 2, 2, None, "only_a", 0.0)], "work_id long, act int, scene int, align_order int, edition_a_id long, edition_b_id long, line_a_id long, line_b_id long, match_type string, similarity double")
    lines = spark.createDataFrame([(k, 1, 1, 1, 1) for k in (1, 2)], "id long, work_id long, edition_id long, act int, scene int")
    view = views.visible_editions(views.scene_view(lines, m, spark.createDataFrame([(1, 1)], "work_id long, edition_id long")))
    seen = {r["edition_b_id"] for r in views.scenes_seen(m).where("seen").collect()}
    assert {r["edition_id"] for r in view.collect()} == {1} | seen == ({1, 2} if shown else {1})



def test_an_index_shuffles_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "TOKENS", 5)  # ranges of several blocks of a term
    df = spark.createDataFrame([(k, "sun sea " * (k % 3 + 1) + ("moon" if k % 2 else "")) for k in range(40)] + [(50, None), (51, "")], "doc_id long, text string")
    seen = []
    dealt = stored._dealt
    monkeypatch.setattr(stored, "_dealt", lambda rows, buckets: seen.append(rows.columns) or dealt(rows, buckets))
    index = stored.write_index(df, "doc_id", "text", str(tmp_path / "i"), per_range=8, buckets=4)
    assert seen == [["term", "range", "n", "most", "doc", "tf", "dl", "positions"]]
    assert {r["term"]: r["df"] for r in index.terms.collect()} == {"sun": 40, "sea": 40, "moon": 20}
    want = stored.matches(index, ["sun", "moon"]).orderBy(F.round("score", 6).desc(), "doc").limit(5)
    assert [r["doc"] for r in stored.best(index, ["sun", "moon"], 5, must=True).best.collect()] == [r["doc"] for r in want.collect()]
    assert [r["doc"] for r in stored.phrase(index, ["sea", "moon"]).orderBy("doc").collect()] == list(range(1, 40, 2))



def test_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(scan, "ROWS", 50)
    df = spark.range(2000).select(F.col("id").alias("k"), F.when(F.col("id") % 7 == 0, F.col("id") * 2).alias("n"))
    d = scan.dealt(df, [], ["k"])
    assert scan.parts_of(d) == 40 and d.select(scan.PART).distinct().count() > 20
    assert "hashpartitioning(_part#" in joined_rows(got := scan.running(d, [], ["k"], {"c": ("count", F.lit(1))})) and ", 40)" in joined_rows(got)
    assert [(r["k"], r["c"]) for r in got.orderBy("k").collect()] == [(k, k + 1) for k in range(2000)]
    line = {r["k"]: r["line_number"] for r in scan.interpolated(df, "n", [], ["k"]).collect()}
    assert all(line[k] == 2 * k for k in range(1995))



def test_a_volume_is_not_sorted_by_one_task(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scan, "ROWS", 20)
    orders = spark.createDataFrame([(k, f"{k % 5}-X") for k in range(200)], "o_orderkey long, o_orderpriority string")
    monkeypatch.setattr(split_queries, "scratch", lambda *_: str(tmp_path / "volume"))
    got = split_queries.volume_entries(SimpleNamespace(spark=spark, orders=orders))
    assert len(list((tmp_path / "volume").glob("part-*"))) > 10
    want = [(f"w{chr(97 + k % 26)}x", f"w{chr(97 + k % 26)}x: see {k % 5}-X" + ("" if k % 3 == 0 else f"\n  and {k % 5}-X")) for k in range(200)]
    assert sorted(map(tuple, got.collect())) == sorted(want)



def test_citations_that_ask_alike_meet_lines_once(spark, monkeypatch):
    lines = spark.createDataFrame([(n, 1, 1, 1, 1, n, f"line {n}") for n in range(1, 9)], "id long, work_id long, edition_id int, act int, scene int, line_number int, content string")
    asked = [(k, 1, None if k % 2 else 1, None, 3) for k in range(50)]
    c = spark.createDataFrame([*asked, (7, 1, 1, 1, 30), (60, 1, 1, None, None)], "id long, work_id long, act int, scene int, line int")
    met = []
    band = citations.band_join
    monkeypatch.setattr(citations, "band_join", lambda left, *more: met.append(left.count()) or band(left, *more))
    got = {(r["citation_id"], r["text_line_id"]) for r in citations.reference_matches(c, lines).collect()}
    assert got == {(k, 3) for k in range(50)} and met == [3]



def test_found_citations_are_python_objects_in_few(spark, monkeypatch):
    monkeypatch.setattr(automaton, "FEW", 2)
    forms = {"a": citation_text.Forms(("Ham.",), ("Sonn.",), ("Ven.",))}
    df = spark.createDataFrame([(k, None if k == 3 else f"x Ven. {k + 1} y", "a") for k in range(7)], "id long, text string, source string").coalesce(1)
    find = automaton.citation_column(forms)
    got = {r["id"]: [tuple(s) for s in r["s"]] for r in df.select("id", find("text", "source").alias("s")).collect()}
    assert got == {k: [] if k == 3 else [("Ven.", None, None, k + 1, 2, 8)] for k in range(7)}



def test_a_search_makes_the_stems_once(spark):
    df = spark.createDataFrame([(1, "the running"), (2, "runs"), (3, "É of the")], "id long, text string")
    index = fts.build_index(df, "id", ["text"])
    assert "ArrowEvalPython" not in joined_rows(fts.search(index, 'run OR "of the"'))
    assert {r["doc"] for r in fts.search(index, "run").collect()} == {1, 2}
    assert fts.porter.cache_info().maxsize


def test_lines_that_may_be_cited_are_split_once(spark):
    documents = spark.createDataFrame([(1, "One two, three four five\nsix"), (2, "two three four six"), (3, None), (4, "x\n\n" + "a b " * 3000 + "three four five six")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, "two three four five six"), (8, "a"), (9, None)], "item_id long, text string")
    got = literary_queries._cited(SimpleNamespace(documents=documents, benchmark=benchmark))
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [(7, 1, 1), (7, 4, 3)]
    made = [x for x in joined_rows(got).splitlines() if "Generate explode(array_distinct" in x]
    assert made and not any("split(" in x for x in made)  # else words times words for each line



def test_short_quotes_meet_words_not_lines(spark, monkeypatch):
    lines = spark.createDataFrame([(1, 1, "the seaside walk"), (1, 2, "of old men"), (2, 1, "walk of"), (3, 1, "a sea of sand and the sun on it"), (4, 1, ""), (4, 2, "x")], "doc_id long, line_no int, norm string")
    asked = spark.createDataFrame([(1, "sea walk"), (2, "walk of"), (3, "sea of sand and a sun on it all"), (4, "seas"), (5, "x"), (6, "seaside walk of old men the sea"), (7, "the seaside walk of old men"), (8, None), (9, "")], "item_id long, norm string")
    seen, grams = [], evidence.grams
    monkeypatch.setattr(evidence, "grams", lambda c, n: seen.append(str(c)) or grams(c, n))
    got = {tuple(r) for r in evidence.evidence(asked, lines).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (3, 3), (4, 1), (5, 4), (7, 1)}
    assert seen and set(seen) == {str(F.col("word"))}  # a row for each three letters of each word there is, not of each line


def test_levels_that_are_not_asked_do_not_meet_lines(spark):
    lines = citations.prepared_lines(spark.createDataFrame([(1, 1, 1, None, None, 1, "one"), (2, 1, 1, None, None, 2, "two")], "id long, work_id long, edition_id int, act int, scene int, line_number int, content string"), F.lower)
    asked = citations.prepared_citations(spark.createDataFrame([(5, 1, None, None, 2, "two", "")], "id long, work_id long, act int, scene int, line int, quote_text string, headword string"), F.lower, expand=False)
    met = citations.candidates(citations.search_levels(asked, lines).localCheckpoint(), lines.localCheckpoint())
    assert joined_rows(met).count("Join") == 1 and met.count() == 2
    assert [r["text_line_id"] for r in citations.resolve(asked, lines).collect()] == [2]


def test_spaces_of_a_line(spark):
    given = ["a  b", "a\tb", " a \n\n b\r", "a b c", "a\u00a0b", "a - b", "\x0b", None, "a\x0c \x0bb "]
    got = spark.createDataFrame([(x,) for x in given], "s string").select(passages.plain_norm(F.col("s"))).collect()
    assert [r[0] for r in got] == ["a b", "a b", "a b", "a b c", "ab", "a b", "", None, "a b"]


def test_files_of_a_table_follow_its_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scan, "ROWS", 50)
    table = VersionedTable(spark, str(tmp_path / "t"), ["k", "n"])
    table.create(spark.range(1000).selectExpr("id * 2 AS k", "CAST(id % 3 AS int) AS n", "'a' AS v"))
    assert (n := table.files().count()) >= 15
    table.append(spark.range(1000).selectExpr("id * 2 + 1 AS k", "0 AS n", "'b' AS v"))
    assert table.files().count() >= 2 * n - 10 and table.files().agg(F.max("n")).first()[0] <= 150
    low = {r["file"] for r in table.files().where("CAST(high AS long) < 1000").collect()}
    # The ends of the table change, by keys of a type that is not its own; what lies between stays as it is.
    new = spark.sql("SELECT CAST(k AS int) AS k, n, 'c' AS v FROM VALUES (1, 0), (1998, 0), (1998, 0), (2500, 1) AS t(k, n)")
    table.swap(new.select("k").distinct(), ["k"], new)
    rows = {(r["k"], r["n"], r["v"]) for r in table.read().collect()}
    assert len(rows) == 2001 and rows >= {(1, 0, "c"), (1998, 0, "c"), (2500, 1, "c")} and not {r for r in rows if r[0] in (1, 1998) and r[2] != "c"}
    files = table.files().collect()
    assert len(low & {r["file"] for r in files}) == len(low) - 1 and sum(r["n"] for r in files) == 2002
    bounds = sorted((int(r["low"]), int(r["high"])) for r in files)
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:], strict=False))


def test_copies_of_a_text_have_their_anchors_found_once(spark, monkeypatch):
    r = random.Random(6)
    words = "amber brook cedar delta ember frost grove haven inlet jetty knoll lodge".split()
    shared, near = ([f"{' '.join(r.sample(words, 6))} {kind} mark{k}" for k in range(4)] for kind in ("common", "other"))

    def text():
        own = [" ".join(w for w in x.split() if r.random() < 0.9) for x in near * 2] + [" ".join(r.choices(words, k=r.randint(1, 4))) for _ in range(6)]
        return "\n".join(r.sample([*own, *shared, "---", "..."], len(own) + len(shared) + 2))

    texts = [text() for _ in range(4)]
    documents = [(k, texts[k % 4] if k < 10 else f"only here {k}\n---") for k in range(12)]
    asked = []
    inner = literary_queries.best_of_pairs
    monkeypatch.setattr(literary_queries, "best_of_pairs", lambda pairs, *a: asked.append(pairs.count()) or inner(pairs, *a))
    rows = literary_queries.mutual_best_anchors(SimpleNamespace(documents=spark.createDataFrame(documents, "doc_id long, text string"))).collect()
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", documents)
    want = con.sql(literary_queries.ANCHORS).fetchall()
    assert sorted(map(tuple, rows)) == sorted(want) and any(x[4] < 1 for x in want)
    assert asked == [6] and len({x[:2] for x in want}) == 45  # of 45 pairs of documents, six are of different texts


def test_rounds_of_propagation_carry_no_text(spark):
    matches = spark.createDataFrame([(7, 1, 1, "exact_quote", 1.0, "x"), (None, 1, 1, "exact_quote", 1.0, "y")], "citation_id long, text_line_id long, edition_id long, match_type string, confidence double, matched_text string")
    maps = spark.createDataFrame([(1, 2, 1, 11, 0.9), (1, 2, 1, 99, 0.5), (2, 3, 11, 21, 0.5), (1, 4, 1, 98, 1.0)], "edition_a_id long, edition_b_id long, line_a_id long, line_b_id long, similarity double")
    lines = spark.createDataFrame([(k, f"line {k}") for k in (1, 11, 21)], "line_id long, content string")
    seen = []

    def cut(df):
        seen.append("matched_text" in df.columns)
        return spark.createDataFrame(df.collect(), df.schema)

    got = citations.propagate(matches, maps, lines, cut=cut).where("citation_id = 7").collect()
    assert {(r["edition_id"], r["matched_text"], r["confidence"]) for r in got} == {(1, "x", 1.0), (2, "line 11", 0.9), (3, "line 21", 0.45)}  # 98 is no line
    assert seen.count(True) == 1  # what is given; before, each round joined the text of all lines


def test_lines_meet_their_pairs_without_a_shuffle(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    lines = spark.range(4_000).select((F.col("id") % 4).alias("doc_id"), F.col("id").cast("int").alias("line_no"), F.repeat(F.lit("word "), 500).alias("line"))
    got = passages.pair_lines(pairs, lines, "a")
    assert got.count() == 2_000 and "BroadcastHashJoin" in joined_rows(got) and "hashpartitioning" not in joined_rows(got)
