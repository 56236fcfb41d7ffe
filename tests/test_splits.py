"""Reading by splits gives what reading whole files gives, wherever the splits end."""

from __future__ import annotations

import random

import pytest

from stemma.sources import splits, sqldump

PIECES = ["a", "''", "\\'", "\\\\", ";", "\n", "--", "#", "/*", "*/", '"', "`", " ", "(1,'x')", "é"]


def a_dump(rng, n):
    out = []
    for k in range(n):
        s = "".join(rng.choice(["a", "''", "\\'", "\\\\", ";", "\n", "--", "#", "/*", '"', "`", "é", " "]) for _ in range(rng.randrange(30)))
        out.append(rng.choice([f"INSERT INTO `t{k % 3}` VALUES ({k},'{s}'),\n({k},NULL);", f"-- it's; a \"comment\"\n", f"/* more '; {s.replace('*/', '')} */", f"CREATE TABLE x (a `b;`,\n c \"d;\");\n", f"# {k}'\n", ";;"]))
    return "\n".join(out) + "INSERT INTO last VALUES (1)"


def read(spark, path, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        return {(r["ordinal"], r["table_name"], tuple(r["row"])) for r in splits.read_dump_by_split(spark, path).collect()}, sorted((r["number"], r["statement"]) for r in splits.statements_by_split(spark, path).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [57, 400, 10**8])
def test_any_split(spark, tmp_path, size):
    text = a_dump(random.Random(3), 60)
    (tmp_path / "one.sql").write_text(text)
    rows, found = read(spark, str(tmp_path), size)
    assert [s for _, s in found] == list(sqldump.statements(text))
    want = {(r["ordinal"], r["table_name"], tuple(r["row"])) for r in sqldump.read_dump(spark, str(tmp_path)).collect()}
    assert rows == want and len(want) > 20


def test_several_files(spark, tmp_path):
    texts = [a_dump(random.Random(k), 12) for k in range(3)]
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.sql").write_text(text)
    _, found = read(spark, str(tmp_path), 100)
    assert sorted(s for _, s in found) == sorted(s for text in texts for s in sqldump.statements(text))


@pytest.mark.parametrize("state", range(5))
def test_chunks_follow_each_other(state):
    rng = random.Random(state)
    for _ in range(300):
        lines = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(12))).replace("\n", "") + "\n" for _ in range(4)]
        whole, end = splits.lex("".join(lines), state)
        parts, now = [], state
        for line in lines:
            found, now = splits.lex(line, now)
            parts += found
        join = lambda xs: "".join("\0" if x is None else x for x in xs)
        assert (join(parts), now) == (join(whole), end)


def test_numbered_lines(spark, tmp_path):
    lines = [f"line {k}\r" if k % 2 else f"line {k}" for k in range(200)]
    (tmp_path / "v.txt").write_bytes("\n".join(lines).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = sorted((r["line_no"], r["line"]) for r in splits.numbered_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(k, f"line {k}") for k in range(200)]
