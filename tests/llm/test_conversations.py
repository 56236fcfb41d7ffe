"""The prefix trie and the repair of conversations, against direct computation."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from stemma.llm import prefix_trie, repair

SCHEMA = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.001/conversations.parquet"


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}:{text}".encode()).digest()


def first_nulls(x):
    return (x is not None, x or 0)


# ---- repair


def damage(rows):
    out = {}
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        own = out.setdefault(c, [])
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        own += [(t, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return {c: sorted(own, key=lambda r: (first_nulls(r[0]), digest(*r[1:]))) for c, own in out.items()}


def faults(own):
    seen, out = set(), []
    for _, role, text in own:
        full = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not full else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(own, marks):
    """(cost, audit, turns) by trying every edit from every state: states are the initials so far, shortened to their last ones."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "", ())}

    def put(best):
        for _ in range(3):
            for q, (c, a, o) in list(best.items()):
                for x, name in (("u", "user"), ("a", "assistant")):
                    if to := step[q].get(x):
                        best[to] = min(best.get(to, (10**9,)), (c + 2, a + "I", (*o, f"{name}:")))
        return best

    for (_, role, text), mark in zip(own, marks, strict=True):
        after = {}
        for q, (c, a, o) in put(best).items():
            options = [(q, c + 3, a + "D", o)]
            if mark not in ("blank", "duplicate"):
                extra = mark == "truncated"
                if to := step[q].get(role[:1]):
                    options.append((to, c + extra, a + "K", (*o, f"{role}:{text}")))
                options += [(step[q][x], c + 2 + extra, a + "R", (*o, f"{name}:{text}")) for x, name in (("u", "user"), ("a", "assistant")) if x in step[q]]
            for to, *rest in options:
                after[to] = min(after.get(to, (10**9,)), tuple(rest))
        best = after
    return min(x for q, x in put(best).items() if q in ("", "a"))


def repaired(rows):
    out = {}
    for c, own in damage(rows).items():
        marks = faults(own)
        cost, audit, turns = cheapest(own, marks)
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        out[c] = (gaps, *(marks.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())
    return out


def some_conversations(rng, n, most):
    say = ["Yes.", "No", "What?", "", " \n", "Go on!", "é…", "a\nb.", None, "over. "]
    roles = ["user", "assistant", "system", "tool", "", None, "sage", "ux"]
    rows = []
    for c in range(n):
        for t in range(rng.randrange(most)):
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            rows.append((c - 3, rng.choice([t, t, t, t * 2, None]), role, rng.choice(say) if rng.random() < 0.5 else f"turn {rng.randrange(40)}."))
    rows += [(None, t, "user", "null id.") for t in range(3)]
    return rows


@pytest.mark.parametrize("segment", [4096, 3])
def test_repair(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = some_conversations(random.Random(7), 60, 25) + [(99, t, ("user", "assistant")[t % 2], f"long {t % 70}.") for t in range(150)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS key", "1 AS part", "0 AS cut").repartition(3)
    got = {r["conv_id"]: tuple(r[1:]) for r in repair.repair_report(df).collect()}
    assert got == repaired(rows)


def test_repair_of_given_conversations(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}'").fetchall()
    assert {r["conv_id"]: tuple(r[1:]) for r in repair.repair_report(spark.read.parquet(SF)).collect()} == repaired(rows)
    assert repair.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repair_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 10)
    monkeypatch.setattr(repair, "SEGMENT_BYTES", 300)
    rows = some_conversations(random.Random(8), 40, 12) + [(500, 0, "user", "x" * 100_000 + ".")] * 3
    got = {r["conv_id"]: tuple(r[1:]) for r in repair.repair_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == repaired(rows)


# ---- prefix trie


def nodes(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((first_nulls(t), digest(role or "", text or ""), role or "", text or ""))
    turns = {c: [r[2:] for r in sorted(x)] for c, x in own.items()}
    built = {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = turns.get(base, [])[:h] + x[h:]
    members = {}
    for c, x in built.items():
        for d in range(len(x) + 1):
            members.setdefault(tuple(x[:d]), []).append(c)
    out = {}
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        has = lambda q: [x for x in members if len(x) == len(q) + 1 and x[:-1] == q]
        ends = ",".join(str(c) for c in sorted(own) if len(built[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        out[min(own), len(p)] = (min(members[p[:-1]]) if p else None, len(own), len(has(p)), sum(not has(q) for q in below), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie_of(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'x' AS digest", "2 AS _part")
    got = prefix_trie.trie_report(df).collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got}
    assert len(out) == len(got)
    return out


def test_prefix_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STEP", 3)
    monkeypatch.setattr(prefix_trie, "RUN", 2)
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 12), *range(100, 112), -5, -100, 207, 208]:
        say = ["same start", "é€", None, ""][: rng.randrange(1, 5)]
        rows += [(c, rng.choice([t, t, t, None]), rng.choice(["user", None]) if rng.random() < 0.1 else ("user", "assistant")[t % 2], rng.choice(say)) for t in range(rng.randrange(1, 9))]
    rows += [(c, t, "user", f"copy {t}") for c in range(300, 330) for t in range(9)]  # equal conversations
    rows += [(400, t, "user", "a") for t in range(3)] + rows[:4] + [(None, 0, "user", "no id")]
    assert trie_of(spark, rows) == nodes(rows)


def test_paths_that_hang_on_each_other(spark):
    rows = [(1000 + 100 * c, t, "user", f"turn {t}" if t <= c else f"own {c}") for c in range(7) for t in range(c + 2)]
    assert trie_of(spark, rows) == nodes(rows)
    assert prefix_trie.trie_report(spark.createDataFrame([], SCHEMA)).count() == 0
