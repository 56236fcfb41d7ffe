"""The automaton finds what the patterns find."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stemma.sources.automaton import Finder, apart, citation_column
from stemma.sources.citation_text import Forms, spans

STYLES = {
    "roman": Forms(plays=("Ham.", "1 Hen. IV", "1 Hen. IVa", "Tw.N."), sonnets=("Sonn.",), poems=("Ven.", "Lucr."), spellings={"Lucr.": "Lucrece"}),
    "mixed": Forms(plays=("J. C.", "Ham.", "Tw.N."), poems=("V. A.", "Ham."), style="mixed"),
}
PARTS = ["Ham.", "1 Hen. IV", "1  Hen.\nIV", "1 Hen. IVa", "Tw.N.", "J. C.", "J.  C.", "Sonn.", "Ven.", "V. A.", "Lucr.", "i.", "ii.", "iv", "x.", " ", "  ", "\n", "\t ", "3", "12.", ",", ".", "and", "0", "xHam.", "é"]


@pytest.mark.parametrize("source", sorted(STYLES))
def test_like_patterns(source):
    rng, finder, n = random.Random(source), Finder(STYLES), 0
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 25)))
        want = spans(text, STYLES[source])
        assert finder.find(text, source) == want, text
        n += len(want)
    assert n > 200 and finder.find(None, source) == [] and finder.find("Ham. i. ii. 3", "none") == []


def test_columns(spark):
    df = spark.createDataFrame([(1, "see Ham. iii. i. 56; Ham.  iv", "roman"), (2, "Ham. iii. 2. 119 and V. A. 7", "mixed"), (3, None, "roman"), (4, "Ham. 3", "other")], "id int, text string, source string")
    got = df.select("id", apart(citation_column(STYLES)("text", "source")).alias("s")).select("id", F.inline("s")).collect()
    assert sorted(tuple(r) for r in got) == [(1, "Ham.", 3, 1, 56, 4, 19), (2, "Ham.", 3, 2, 119, 0, 16), (2, "V. A.", None, None, 7, 21, 28)]
    overlap = spark.sql("SELECT array(struct(0 AS start, 5 AS end), struct(3 AS start, 9 AS end), struct(5 AS start, 6 AS end)) AS s").select(apart(F.col("s")).alias("s")).first()
    assert [tuple(x) for x in overlap["s"]] == [(0, 5), (5, 6)]
