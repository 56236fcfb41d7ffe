"""Passages meet exactly the lines that comparing all pairs finds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stemma.functions.similarity import words
from stemma.operators.evidence import evidence, fuzzy_candidates, fuzzy_pairs, scattered
from stemma.operators.patience import mutual_best, rare_first

VOCABULARY = [a + b for a in ("ka", "lo", "mi", "ru", "x") for b in ("n", "rast", "", "vel", "o")]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    line = lambda n: " ".join(rng.choices(VOCABULARY, range(len(VOCABULARY), 0, -1), k=n))
    lines = [(d, k, line(rng.randrange(1, 12))) for d in range(40) for k in range(1, 8)]
    passages = [(k, line(rng.randrange(1, 10))) for k in range(30)] + [(100 + k, lines[k * 9][2]) for k in range(12)] + [(200, "mi x"), (201, "x lo"), (202, "zzz qqq"), (203, "")]
    return lines, passages


@pytest.fixture(scope="module")
def frames(spark, corpus):
    lines, passages = corpus
    return spark.createDataFrame(passages, "item_id long, norm string"), spark.createDataFrame(lines, "doc_id long, line_no int, norm string").repartition(3)


def similarity(a, b):
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8])
def test_fuzzy(frames, corpus, least):
    lines, passages = corpus
    p, l = (df.withColumn("words", words(F.col("norm"))) for df in frames)
    got = {(r["item_id"], r["doc_id"], r["line_no"]): round(r["similarity"], 9) for r in fuzzy_pairs(p, l, least).collect()}
    assert got == {(i, d, k): round(similarity(q, x), 9) for i, q in passages for d, k, x in lines if similarity(q, x) > least}
    assert least < 0.8 or fuzzy_candidates(p, l, least).count() < len(lines) * len(passages) / 4


def short(q, x):
    own = q.split()
    return 2 <= len(own) <= 6 and all(w in x for w in own)


def test_scattered(frames, corpus):
    lines, passages = corpus
    got = {tuple(r) for r in scattered(*frames).collect()}
    assert got == {(i, d, k) for i, q in passages for d, k, x in lines if short(q, x)}
    assert scattered(frames[0].where("item_id = 203"), frames[1]).count() == 0


def test_evidence(frames, corpus):
    lines, passages = corpus
    after = {(d, k): x for d, k, x in lines}
    # find_passages() leaves passages of one or two words under three letters out, as documented
    holds = lambda i, q, d, k, x: q and len(q) >= 3 and (q in x or (d, k + 1) in after and q in f"{x} {after[d, k + 1]}")
    want = {(i, d) for i, q in passages for d, k, x in lines if holds(i, q, d, k, x) or short(q, x) or similarity(q, x) > 0.5}
    assert {tuple(r) for r in evidence(*frames).collect()} == want


def test_mutual_best_meets_by_rare_words(spark, frames, corpus):
    lines = [(d, k, x) for d, k, x in corpus[0] if d < 2]
    held = rare_first(frames[1].where("doc_id < 2"), 0.4)
    side = lambda d, no, n: held.where(F.col("doc_id") == d).select(F.lit(0).alias("a"), F.lit(1).alias("b"), F.col("line_no").alias(no), F.size("w").alias(n), "rare")
    got = {(r["i"], r["j"]) for r in mutual_best(side(0, "i", "n"), side(1, "j", "m"), ["a", "b"], held, 0.4).collect()}
    sim = {(i, j): similarity(x, y) for d, i, x in lines if d == 0 for e, j, y in lines if e == 1}
    best = {(i, j) for (i, j), s in sim.items() if s >= 0.4 and all((-s, j) <= (-sim[i, k], k) and (-s, i) <= (-sim[k, j], k) for k in range(1, 8))}
    assert got == best
    assert all(r["rare"] < r["w"] for r in held.select(F.size("w").alias("w"), F.size("rare").alias("rare")).where("w > 3").collect())
