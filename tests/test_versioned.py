"""Changes are whole or not at all."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stemma.sources.versioned import Conflict, VersionedTable

SCHEMA = "k long, part string, v long"


@pytest.fixture
def table(spark, tmp_path):
    out = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    out.create(spark.createDataFrame([(k, f"p{k % 3}", k) for k in range(0, 200, 2)], SCHEMA), files=6)
    return out


def rows(table, version=None):
    return sorted((tuple(r) for r in table.read(version).collect()), key=str)


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_a_killed_write_leaves_the_old_version(spark, table, monkeypatch):
    before = rows(table)
    new = frame(spark, [(2, "new", 1), (3, "new", 1)])

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # files and list are written, the commit is not
        m.setattr(VersionedTable, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            table.replace(new, F.col("v"))
    assert rows(table) == before and table.version() == 1
    stream = table._fs.create(table._path(f"{table.path}/commits/{2:010d}"), False)  # killed before the commit's content
    stream.close()
    assert table.version() == 1 and rows(table) == before
    assert table.replace(new, F.col("v")) == 3
    assert {r[0]: r[1] for r in rows(table)}[2] == "new" and len(rows(table)) == len(before) + 1 and rows(table, 1) == before


def test_two_writers(spark, table, monkeypatch):
    other = VersionedTable(spark, table.path, ["k"])
    write = VersionedTable._listed

    def meanwhile(self, folder):
        if self is table:
            other.append(frame(spark, [(1, "x", 0)]))
        return write(self, folder)

    monkeypatch.setattr(VersionedTable, "_listed", meanwhile)
    with pytest.raises(Conflict):
        table.append(frame(spark, [(5, "y", 0)]))
    assert len(rows(table)) == 101


def test_files_that_are_not_touched_stay(spark, table):
    before = {r["file"]: (int(r["low"]), int(r["high"])) for r in table.files().collect()}
    table.replace(frame(spark, [(20, "new", 1), (21, "new", 1)]), F.col("v"))
    after = {r["file"] for r in table.files().collect()}
    assert len(before) == 6 and len(set(before) & after) == 5 and len(after) == 6


@pytest.mark.parametrize("seed", range(3))
def test_many_changes(spark, table, seed):
    rng = random.Random(seed)
    want = {k: (f"p{k % 3}", k) for k in range(0, 200, 2)}
    for step in range(4):
        keys = rng.sample(range(-20, 260), 12)
        new = [(k, f"s{step}", rng.randrange(9)) for k in keys]
        kind = ("replace", "ignore", "update", "swap")[(step + seed) % 4]
        if kind == "replace":
            table.replace(frame(spark, new), F.col("v"))
            want |= {k: (p, v) for k, p, v in new}
        elif kind == "ignore":
            table.ignore(frame(spark, new), F.col("v"))
            want = {k: (p, v) for k, p, v in new} | want
        elif kind == "update":
            table.update(spark.createDataFrame([(k, v if v > 4 else None) for k, _, v in new], "k long, v long"))
            want |= {k: (want[k][0], v) for k, _, v in new if k in want and v > 4}
        else:
            table.swap(frame(spark, new).select("k"), ["k"], frame(spark, new[:6]))
            want = {k: x for k, x in want.items() if k not in keys} | {k: (p, v) for k, p, v in new[:6]}
        assert rows(table) == sorted(((k, *x) for k, x in want.items()), key=str), kind
        bounds = sorted((int(r["low"]), int(r["high"])) for r in table.files().collect())
        assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:], strict=False))


def test_nulls_and_nothing(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "n"), ["k"])
    t.create(frame(spark, []))
    assert rows(t) == [] and t.version() == 1
    t.append(frame(spark, [(None, "a", 1), (3, "b", 2)]))
    t.replace(frame(spark, [(None, "c", 5)]), F.col("v"))
    assert rows(t) == sorted([(None, "c", 5), (3, "b", 2)], key=str)
    assert t.replace(frame(spark, []), F.col("v")) == t.version()
