"""Running values that cross the borders of partitions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stemma.operators.scan import PART, dealt, running

SCHEMA = "k string, o long, v long"


def expected(rows):
    out, by_key = {}, {}
    for k, o, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        by_key.setdefault(k, []).append((o, v))
    for k, own in by_key.items():
        n, total, top, last, x = 0, None, None, None, None
        for at, (o, v) in enumerate(own):
            if v is not None:
                n, total, top, last, x = n + 1, (total or 0) + v, max(v, v if top is None else top), v, (x or 0) ^ v
            out[k, o] = (n, total, top, last, next((w for _, w in own[at:] if w is not None), None), x)
    return out


@pytest.mark.parametrize("shape", ["one key", "few keys", "many keys", "no value", "empty"])
def test_running_values(spark, shape):
    rng = random.Random(shape)
    keys = {"one key": ["a"], "few keys": ["a", None, "c"], "many keys": list(map(str, range(60))), "no value": ["a", "b"], "empty": []}[shape]
    rows = [(rng.choice(keys), o, None if shape == "no value" or rng.random() < 0.7 else rng.randrange(50)) for o in range(200)] if keys else []
    d = dealt(spark.createDataFrame(rows, SCHEMA).repartition(3), ["k"], ["o"])
    v = F.col("v")
    got = running(d, ["k"], ["o"], {"n": ("count", v), "total": ("sum", v), "top": ("max", v), "last": ("last", v), "next": ("next", v), "x": ("xor", v)})
    assert {(r.k, r.o): (r.n, r.total, r.top, r.last, r.next, r.x) for r in got.collect()} == expected(rows)
    if shape == "one key":  # the key's rows are in several partitions, none of them has all
        sizes = [r["count"] for r in d.groupBy(PART).count().collect()]
        assert len(sizes) > 1 and max(sizes) < 120
