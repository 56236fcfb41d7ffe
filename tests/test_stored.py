"""The stored index against scores and substrings computed one by one."""

from __future__ import annotations

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from stemma.operators import fts, stored

WORDS = ["sun", "moon", "star", "sea", "sand", "rock", "tree", "leaf", "rain", "snow"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = {k * 3 - 50: " ".join(rng.choices(WORDS, range(len(WORDS), 0, -1), k=rng.randrange(1, 40))) for k in range(400)}
    out |= {2000: "", 2001: None, 2002: "Comet comet COMET", 2003: "sun comet", 2004: "É tree"}
    return out


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return stored.write_index(df, "doc_id", "text", str(tmp_path_factory.mktemp("index") / "i"), per_range=16, buckets=8)


def scores(texts, terms, must):
    words = {d: re.findall("[a-z0-9]+", (t or "").lower()) for d, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)
    df = {t: sum(t in w for w in words.values()) for t in terms}
    out = {}
    for d, w in words.items():
        hit = [t for t in terms if t in w]
        if hit and (not must or len(hit) == len(terms)):
            out[d] = sum(max(1e-6, math.log((len(words) - df[t] + 0.5) / (df[t] + 0.5))) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in hit)
    return out


@pytest.mark.parametrize("terms", [["snow"], ["comet", "sun"], ["rain", "snow", "leaf"], ["sun", "moon"], ["nowhere"], ["nowhere", "sun"], []])
@pytest.mark.parametrize("must", [True, False])
def test_best(index, texts, terms, must):
    want = scores(texts, terms, must)
    assert {r["doc"]: round(r["score"], 9) for r in stored.matches(index, terms, must).collect()} == {d: round(s, 9) for d, s in want.items()}
    top = sorted(((-round(s, 6), d) for d, s in want.items()))[:7]
    got = stored.best(index, terms, 7, must)
    assert [(r["doc"], pytest.approx(r["score"], abs=2e-6)) for r in got.best.collect()] == [(d, -s) for s, d in top]
    assert got.scored_ranges <= got.ranges


def test_bounds_leave_ranges_out(index):
    got = stored.best(index, ["comet", "sun"], 2)
    assert got.scored_ranges < got.ranges / 4


def test_only_some_partitions_are_read(index):
    plan = index_plan = stored.matches(index, ["comet"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan), index_plan
    assert "positions" not in re.search(r"ReadSchema: (\S+)", plan)[1]
    assert len(index.blocks.where("term = 'comet'").select("bucket").distinct().collect()) == 1


@pytest.mark.parametrize("terms", [["sun", "moon"], ["moon", "sun", "star"], ["sun", "sun"], ["comet", "comet", "comet"], ["snow", "nowhere"], []])
def test_phrase(index, texts, terms):
    held = {d for d, t in texts.items() if f" {' '.join(terms)} " in f" {(t or '').lower()} "} if terms else set()
    got = [r["doc"] for r in stored.phrase(index, terms).collect()]
    assert sorted(got) == sorted(held)


def test_prefix(index, texts):
    renamed = {d: re.sub(r"\bs(un|tar|ea|and|now)\b", "s*", t or "") for d, t in texts.items()}
    both = scores({d: t.replace("s*", "sss") for d, t in renamed.items()}, ["moon", "sss"], True)
    assert {r["doc"]: round(r["score"], 9) for r in stored.with_prefix(index, ["moon"], "s").collect()} == {d: round(s, 9) for d, s in both.items()}


@pytest.mark.parametrize("needle", ["un m", "SNOW", "comet", "ea sea sa", "xyz", "su", "", "é t", "tree"])
def test_substrings(spark, texts, needle, tmp_path):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    i = stored.write_trigrams(df, "doc_id", "text", str(tmp_path / "t"), per_range=16, buckets=4)
    want = sorted(d for d, t in texts.items() if len(needle) >= 3 and needle.lower() in (t or "").lower())
    assert sorted(r["doc_id"] for r in stored.containing(i, df, "doc_id", "text", needle).collect()) == want
    tested = {r["doc"] for r in stored.candidates(i, stored.rarest(i, needle)).collect()}
    assert tested >= set(want) and (needle != "comet" or tested == {2002, 2003})


def test_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    i = stored.write_index(df, "doc_id", "text", str(tmp_path / "e"))
    assert i.n == 0 and stored.best(i, ["sun"], 3).best.count() == 0 and stored.phrase(i, ["sun"]).count() == 0


def test_grams_of_a_long_text_take_one_pass(spark):
    """Looking for each place from the beginning takes minutes here."""
    text = "".join(chr(0x1F600 + k * k % 40) + "ab\n"[k % 3] for k in range(400_000))
    began = time.time()
    got = {r[0] for r in spark.createDataFrame([(text,)], "t string").select(F.explode(fts.grams(F.col("t"), 3))).collect()}
    assert got == {text[k : k + 3] for k in range(len(text) - 2)}
    assert time.time() - began < 30
