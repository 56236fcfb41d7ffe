from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stemma.functions import similarity as sim
from stemma.functions import text as tx
from stemma.functions.normalize import norm_chain, normalize, normalize_text

NORMAL = [
    ("Stay; you there -- \"Friend\"?", "stay you ther friend"),
    (" \ttwo  words\nor\t three ", "two words or thre"),
    ("have", "haue"), ("vpon", "upon"), ("virtue", "uirtue"), ("beautie", "beauty"), ("pittie", "pitty"), ("die", "die"),
    ("Juliet", "iuliet"), ("joy", "ioy"), ("speake", "speak"), ("done", "done"), ("arrive", "arriue"), ("shallle", "shall"),
    ("i' th' air", "in the air"), ("o'th'world", "of theworld"), ("'gainsth", "againsth"), ("ﬁre ſee", "fire se"), ("to-morrow", "tomorrow"),
    ("sleep—perchance", "sleepperchanc"), ("musick", "music"), ("suspicion", "suspition"), ("", ""), ("!!!", ""),
]


@pytest.mark.parametrize("given_,want", NORMAL)
def test_normalize(given_, want):
    assert normalize_text(given_) == want


def test_normalize_columns(spark):
    rows = [(k, s) for k, (s, _) in enumerate(NORMAL) if "gainsth" not in s]
    df = spark.createDataFrame(rows, "k int, s string").select("k", normalize("s").alias("exact"), norm_chain(F.col("s")).alias("chain"))
    for r in df.collect():
        assert r["exact"] == NORMAL[r["k"]][1]
        if NORMAL[r["k"]][0].isascii():
            assert r["chain"] == r["exact"], NORMAL[r["k"]]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeiljkvwt' -.,EV\n", max_size=40))
def test_normalize_has_single_spaces(s):
    out = normalize_text(s)
    assert out == " ".join(out.split()) and "v" not in out and "j" not in out and "-" not in out


def test_jaccard_and_cosine(spark):
    pairs = [("to be or not", "to be and die", 2 / 6), ("", "", 1.0), ("a", "", 0.0), ("x y", "y x", 1.0)]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    got = df.select("want", sim.jaccard(sim.words(F.col("a")), sim.words(F.col("b"))).alias("j")).collect()
    assert all(abs(r["want"] - r["j"]) < 1e-12 for r in got)
    assert sim.cosine_text("", "") == 1.0 and sim.cosine_text("abc", "") == 0.0 and sim.cosine_text("abcd", "abcd") == pytest.approx(1.0)
    texts = [("hamlet prince", "hamlet princes"), ("abc", "xyz"), ("banana band", "ananas")]
    both = spark.createDataFrame(texts, "a string, b string").select(sim.trigram_cosine("a", "b").alias("x"), sim.trigram_cosine_builtin(F.col("a"), F.col("b")).alias("y"))
    assert all(abs(r["x"] - r["y"]) < 1e-9 for r in both.collect())


def test_thresholds_and_affinity(spark):
    assert sim.threshold("stage_direction", "speech", 9) == 0.1 and sim.threshold("speech", "speech", 2) == 0.1
    assert sim.threshold("speech", "speech", 4) == 0.15 and sim.threshold("speech", "speech", 5) == 0.2
    rows = [(0.5, 3, 3, 0.65), (0.5, 3, 6, 0.575), (0.5, 3, 7, 0.5), (0.95, 1, 1, 1.0), (0.5, 0, 0, 0.5), (0.5, None, 1, 0.5)]
    df = spark.createDataFrame(rows, "s double, a int, b int, want double")
    assert all(abs(r["want"] - r["got"]) < 1e-9 for r in df.select("want", sim.with_affinity(F.col("s"), F.col("a"), F.col("b"), 0.15).alias("got")).collect())


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_string_functions(spark):
    c = F.col
    assert one(spark, tx.strip_sense_number(c("s")), s="Gill2") == "Gill" and one(spark, tx.strip_sense_number(c("s")), s="123") == "123"
    base, group = tx.split_sense_key(c("s"))
    assert (one(spark, base, s="A1"), one(spark, group, s="A1")) == ("A", 1)
    assert (one(spark, base, s="12"), one(spark, group, s="12")) == ("12", None)
    assert one(spark, tx.slugify(c("s")), s="Henry IV, Part 1") == "henry-iv-part-1"
    assert one(spark, tx.decode_entities(c("s")), s="&#233;&#x41;&#0;&amp;") == "éA&#0;&amp;"
    assert one(spark, tx.clean_text(c("s")), s=" a  b\t") == "a b"
    assert one(spark, tx.trailing_number(c("s")), s="Ven. 12 34") == 34 and one(spark, tx.trailing_number(c("s")), s="none") is None
    assert one(spark, tx.folger_line(c("s")), s="3.1.56") == 56 and one(spark, tx.folger_line(c("s")), s="SD 3.1.5") == 0
    assert one(spark, tx.strict_atoi(c("s")), s="12a") == 0 and one(spark, tx.strict_atoi(c("s")), s="012") == 12
    assert one(spark, tx.split_ellipsis(c("s")), s="a ... b… ") == ["a", "b"]
    assert one(spark, tx.truncate(c("s"), 3), s="abcd") == "abc…" and one(spark, tx.truncate(c("s"), 4), s="abcd") == "abcd"
    assert one(spark, tx.sanitize_search(c("s")), s=' "a*-+b" ') == "ab"
    assert one(spark, tx.first_letter(c("s")), s="élan") == "É" and one(spark, tx.first_letter(c("s")), s="'tis") == "?"
    assert one(spark, tx.word_count(c("s")), s="  two  words ") == 2
    assert one(spark, tx.clean_definition(c("s")), s="a , ( ; ) b ,; c .") == "a, b, c."
    assert one(spark, tx.key_matches(c("w"), c("k")), w="Gills,", k="Gill2") and not one(spark, tx.key_matches(c("w"), c("k")), w="cat", k="dog")
    assert one(spark, tx.reference_label(c("a"), F.lit(3), F.lit(1), F.lit(56)), a="Ham.") == "Ham. 3.1.56"


@pytest.mark.parametrize("s,want", [("XIV", 14), ("mcmxc", 1990), ("IIII", 4), ("", 0), ("IVa", 0), ("xlii", 42)])
def test_roman(spark, s, want):
    assert tx.roman_value(s) == want
    assert one(spark, tx.roman_to_int(F.col("s")), s=s) == want


def test_expansions():
    assert tx.expand_quote_text("he --s them", "Tickle") == "he tickles them"
    assert tx.expand_quote_text("to b. himself", "betake") == "to betake himself"
    assert tx.expand_quote_text("ab. himself", "betake") is None and tx.expand_quote_text("", "x") is None
    assert tx.expand_definition_text("--ed, --ies", "carry") == "carryed, carries"
    assert tx.expand_definition_text("--ing", "make") == "making"


def test_abbreviation_fallback(spark):
    dim = spark.createDataFrame([("J.C.", "Julius"), ("Ham.", "Hamlet")], "a string, v string")
    got = tx.translate_abbreviation(spark.createDataFrame([("J. C.",), ("Ham.",), ("X",)], "k string"), "k", dim, "a", "v")
    assert {r["k"]: r["resolved"] for r in got.collect()} == {"J. C.": "Julius", "Ham.": "Hamlet", "X": "X"}


def test_first_letter_that_has_no_single_capital_or_follows_other_spaces(spark):
    rows = spark.createDataFrame([(1, "ßan"), (2, "  ß"), (3, "ŉa"), (4, "　ét"), (5, "ᾳ"), (6, "\tab"), (7, ""), (8, None)], "k int, s string")
    assert dict(rows.select("k", tx.first_letter(F.col("s"))).collect()) == {1: "ẞ", 2: "ẞ", 3: "ŉ", 4: "É", 5: "ᾼ", 6: "?", 7: "?", 8: "?"}
