"""Multiprobe p-stable hashing against all pairs."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from stemma.llm import pstable

SCHEMA = "vec_id long, embedding array<double>, label int"


def found(df):
    out = {}
    for r in pstable.neighbour_report(df).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(x) for q, x in out.items()}


def best(rows, q, k=20):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    top = {}
    for i, v in rows:
        if i != q[0]:
            top[i] = max(top.get(i, -np.inf), dot(q[1], v))
    return sorted(((-s, i) for i, s in top.items()))[:k]


def recall_of(df, rows):
    got, shares = found(df), []
    for q in (r for r in rows if r[0] % 20 == 0):
        want, own = best(rows, q), got[q[0]]
        assert [x[0] for x in own] == list(range(1, len(own) + 1))
        assert own == sorted(own, key=lambda x: (-x[2], x[1]))
        vectors = dict(rows)
        for _, i, score in own:
            assert score == pytest.approx(sum(a * b for a, b in zip(q[1], vectors[i], strict=False)), rel=1e-12, abs=1e-12)
        shares.append(len({x[1] for x in own} & {i for _, i in want}) / max(1, len(want)))
    return float(np.mean(shares))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r["vec_id"], list(map(float, r["embedding"]))) for r in df.collect()]
    assert recall_of(df, rows) >= 0.9


def test_recall_on_clusters_of_all_norms(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16)) * 3
    rows = [(k, ((centres[k % 12] + rng.standard_normal(16) * 0.3) * rng.uniform(0.2, 2)).tolist()) for k in range(3000)]
    assert recall_of(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), rows) >= 0.9


def test_many_copies(spark):
    rng = np.random.default_rng(4)
    same = rng.standard_normal(8).tolist()
    rows = [(k, same if k % 3 == 0 else rng.standard_normal(8).tolist()) for k in range(9000)]
    got = found(spark.createDataFrame([(*r, 0) for r in rows if r[0] % 3 == 0 or r[0] < 300], SCHEMA))
    n = sum(x * x for x in same)
    assert [x[1] for x in got[60]] == [i for i in range(0, 66, 3) if i != 60][:20] and got[60][0][2] == pytest.approx(n)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [0.0, 0.0]), (7, [2.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [0.0, 0.0])]
    got = found(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA))
    assert got == {0: [(1, 7, 2.0), (2, 8, 1.0), (3, 20, 1.0), (4, 1, 0.5)], 20: [(1, 7, 2.0), (2, 0, 1.0), (3, 8, 1.0), (4, 1, 0.5)]}
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    assert found(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)) == {}


def test_cells_come_by_probability():
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.ones(5), size=4)
    names = rng.integers(0, 2**63, (4, 5), dtype=np.uint64)
    cells = sorted(itertools.product(range(5), repeat=4), key=lambda c: -np.prod([p[k, x] for k, x in enumerate(c)]))
    got = pstable.likeliest(p, names, 0.9)
    with np.errstate(over="ignore"):
        want = [sum(names[k, x] for k, x in enumerate(c)) for c in cells[: len(got)]]
    assert got.tolist() == want
    held = sum(np.prod([p[k, x] for k, x in enumerate(c)]) for c in cells[: len(got)])
    assert held >= 0.9 > held - np.prod([p[k, x] for k, x in enumerate(cells[len(got) - 1])])
