from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from stemma.functions import similarity as sim
from stemma.functions import text as tx
from stemma.functions.normalize import normalize_text
from stemma.operators import align, fts
from stemma.plans import registry
from stemma.sources.markup import html_lines

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tables_of(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return tables_of(SF)


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    for sf, con in ((SF, lambda: duck), (LARGER, lambda: tables_of(LARGER))):
        df = registry.queries()[name](spark, sf)
        columns = sorted(df.columns)
        got = sorted(repr(plain([r[c] for c in columns])) for r in df.collect())
        rel = con().sql(registry.oracle_sql()[name])
        assert sorted(rel.columns) == columns
        assert got == sorted(repr(plain([r[rel.columns.index(c)] for c in columns])) for r in rel.fetchall())
        if got:
            return
    raise AssertionError("no rows: nothing has been compared")


# ---- queries that SQL cannot express, each against direct computation


@pytest.fixture(scope="module")
def run(spark):
    held = {}

    def of(name):
        if name not in held:
            held[name] = [r.asDict(recursive=True) for r in registry.queries()[name](spark, SF).collect()]
            assert held[name], name
        return held[name]

    return of


@pytest.fixture(scope="module")
def data(duck):
    return lambda sql: duck.sql(sql).fetchall()


@pytest.fixture(scope="module")
def document_lines(data):
    out = {}
    for doc, text in data("SELECT doc_id, text FROM documents"):
        out[doc] = [(k, x) for k, x in enumerate((text or "").split("\n"), 1) if x.strip(" ")]
    return out


def test_every_query_has_a_check():
    checked = set(registry.oracle_sql()) | {n[len("test_") :] for n in globals() if n.startswith("test_")}
    assert set(registry.queries()) <= checked


def test_norm_exact(run, data):
    assert {(r["conv_id"], r["turn"]): r["norm"] for r in run("norm_exact")} == {(c, t): normalize_text(x or "") for c, t, x in data("SELECT conv_id, turn, text FROM conversations")}


def test_html_entities(run, data):
    def decoded(s):
        return re.sub(r"&#(?:[xX]([0-9a-fA-F]+)|([0-9]+));", lambda m: chr(n) if 0 < (n := int(m[1], 16) if m[1] else int(m[2])) < 0x110000 and not 0xD800 <= n < 0xE000 else m[0], s)

    assert {r["page_id"]: r["text"] for r in run("html_entities")} == {i: decoded("&#233;&#x41;&#0; " + h) for i, h in data("SELECT page_id, html FROM pages")}


def test_html_text_lines(run, data):
    want = {(i, k): x for i, h in data("SELECT page_id, html FROM pages") for k, x in enumerate(html_lines(h))}
    assert {(r["page_id"], r["pos"]): r["line"] for r in run("html_text_lines")} == want
    for i, h in data("SELECT page_id, html FROM pages"):  # no text is lost, by another way to it
        shown = re.sub(r"<(script|style|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", h or "", flags=re.S | re.I)
        assert " ".join(x for (j, _), x in sorted(want.items()) if j == i).replace(" ", "") == "".join(html.unescape(shown).split()).replace("\xa0", ""), i


def test_expansions(run, data):
    want = {}
    for i, kind in data("SELECT p_partkey, p_type FROM part"):
        key = kind.split(" ")[-1].lower()
        want[i] = tx.expand_quote_text(f"{key[:1]}. of it --s", key), tx.expand_definition_text("adj. --ed, --ing", key)
    assert {r["p_partkey"]: (r["quote"], r["definition"]) for r in run("expansions")} == want
    kind = {i: k.lower() for i, k in data("SELECT p_partkey, p_type FROM part")}
    assert all(r["quote"] == f"{kind[r['p_partkey']][0]}. of it {kind[r['p_partkey']]}s" for r in run("expansions"))  # a dash goes before a stop


def test_hybrid_turns(run, data):
    text = {(c, t): normalize_text(x or "") for c, t, x in data("SELECT conv_id, turn, text FROM conversations")}
    want = {}
    for (c, t), a in text.items():
        if (b := text.get((c, t + 1))) is not None:
            x, y = frozenset(a.split()), frozenset(b.split())
            s = len(x & y) / len(x | y) if x or y else 1.0
            if min(len(x), len(y)) <= 3:
                s = max(s, sim.cosine_text(a, b))
            s = min(1.0, s + 0.075) if t > 0 else s
            want[c, t] = round(s, 6), s >= (0.1 if min(len(x), len(y)) <= 2 else 0.15 if min(len(x), len(y)) <= 4 else 0.2)
    assert {(r["conv_id"], r["turn"]): (round(r["similarity"], 6), r["aligned"]) for r in run("hybrid_turns")} == want


def test_fts_stemmed(run, data):
    want = set()
    for c, t, role, text in data("SELECT conv_id, turn, role, text FROM conversations"):
        words, roles = fts.tokens(text), fts.tokens(role)
        of, the = fts.porter("of"), fts.porter("the")
        phrase = any((of, the) == pair for field in (words, roles) for pair in zip(field, field[1:], strict=False))
        if the in words or the in roles or "assist" in roles and phrase:
            want.add(c * 1000 + t)
    assert {r["doc"] for r in run("fts_stemmed")} == want


def test_align_lines(run, document_lines):
    rows = defaultdict(list)
    for r in run("align_lines"):
        rows[r["edition_a_id"], r["edition_b_id"]].append(r)
    side = lambda d: align.Lines([x for _, x in document_lines[d]], [k for k, _ in document_lines[d]], ["speech"] * len(document_lines[d]))
    for (a, b), own in rows.items():
        place = lambda d, i: document_lines[d][i][0] if i >= 0 else None
        want = [(k, place(a, i), place(b, j), kind, round(s, 9)) for k, (i, j, kind, s) in enumerate(align.align_sequences(side(a), side(b)), 1)]
        assert sorted((r["align_order"], r["line_a_id"], r["line_b_id"], r["match_type"], round(r["similarity"], 9)) for r in own) == want
    held = {d: {x for _, x in lines if len(x) > 30} for d, lines in document_lines.items()}
    assert set(rows) == {(a, b) for a in held for b in held if a < b and len(held[a] & held[b]) >= 3}


def test_alignment_summary(run):
    want = defaultdict(list)
    for r in run("align_lines"):
        want[r["edition_a_id"], r["edition_b_id"]].append(r)
    got = {(r["edition_a_id"], r["edition_b_id"]): r for r in run("alignment_summary")}
    assert set(got) == set(want)
    for pair, rows in want.items():
        kinds = Counter(r["match_type"] for r in rows)
        assert all(got[pair][k] == kinds[k] for k in ("aligned", "modified", "only_a", "only_b"))
        assert abs(got[pair]["mean_similarity"] - sum(r["similarity"] for r in rows) / len(rows)) <= 0.000501


def test_symmetric_lines(run):
    want = Counter()
    for r in run("align_lines"):
        if r["line_a_id"] is not None and r["line_b_id"] is not None:
            want[r["edition_a_id"], r["edition_b_id"], r["line_a_id"], r["line_b_id"], r["match_type"]] += 1
            want[r["edition_b_id"], r["edition_a_id"], r["line_b_id"], r["line_a_id"], r["match_type"]] += 1
    assert Counter((r["from_edition"], r["to_edition"], r["from_line"], r["to_line"], r["match_type"]) for r in run("symmetric_lines")) == want


def brute_scenes(run, document_lines):
    """(work, row line, gap, position) -> editions: the rows of each smaller document beside its editions."""
    out = defaultdict(dict)
    for work in {r["edition_a_id"] for r in run("align_lines")}:
        for k, _ in document_lines[work]:
            out[work, k, 0, 0][work] = k
    by_pair = defaultdict(list)
    for r in run("align_lines"):
        by_pair[r["edition_a_id"], r["edition_b_id"]].append(r)
    for (a, b), rows in by_pair.items():
        after = None
        for r in sorted(rows, key=lambda r: r["align_order"]):
            after = r["line_a_id"] if r["line_a_id"] is not None else after
            if r["line_b_id"] is not None:
                out[(a, r["line_a_id"], 0, 0) if r["line_a_id"] is not None else (a, after, b, r["align_order"])].setdefault(b, r["line_b_id"])
    return out


def test_symmetric_scene_view(run, document_lines):
    want = Counter((*k, len(v)) for k, v in brute_scenes(run, document_lines).items())
    assert Counter((r["work_id"], r["row_line"], r["gap"], r["position"], r["n_editions"]) for r in run("symmetric_scene_view")) == want


def test_scene_editions(run, document_lines):
    assert {(r["work_id"], r["edition_id"]) for r in run("scene_editions")} == {(k[0], e) for k, v in brute_scenes(run, document_lines).items() for e in v}


def test_propagate_matches(run, document_lines):
    """Rounds of all one-step moves, forward and then back, worked out pair by pair."""
    maps = [(r["edition_a_id"], r["line_a_id"], r["edition_b_id"], r["line_b_id"], r["similarity"]) for r in run("align_lines") if r["line_a_id"] is not None and r["line_b_id"] is not None]
    held = {(r["item_id"], r["doc_id"]): (r["line_no"], r["confidence"], "exact_quote") for r in run("cite_two_line")}
    for _ in range(3):
        before = len(held)
        for turn in (lambda m: m, lambda m: (m[2], m[3], m[0], m[1], m[4])):
            found = defaultdict(list)
            for m in maps:
                e, line, f, to, s = turn(m)
                for (item, doc), (at, confidence, _) in held.items():
                    if (doc, at) == (e, line) and (item, f) not in held:
                        found[item, f].append((to, confidence * (s if s >= 0.2 else 0.3), confidence * s))
            for key, options in found.items():
                top = max(o[2] for o in options)
                held[key] = min((to, c) for to, c, o in options if o == top) + ("propagated",)
        if len(held) == before:
            break
    got = {(r["item_id"], r["doc_id"]): (r["confidence"], r["match_type"]) for r in run("propagate_matches")}
    assert got == {k: (round(c, 9), kind) for k, (_, c, kind) in held.items()}


def test_cite_cascade(run, data, document_lines):
    """The whole passage is compared: a passage that stands in one line or in two is found there with full confidence, others by likeness."""
    kinds = Counter(r["match_type"] for r in run("cite_cascade"))
    passages = [normalize_text((x or "").replace("--", "").strip()) for (x,) in data("SELECT text FROM benchmark")]
    grams = lambda s: {tuple(w[k : k + 4]) for w in [s.split()] for k in range(len(w) - 3)}
    basic = lambda s: re.sub(r"[^\w\s]|_", "", s.lower())
    whole, cited = 0, 0
    own = [grams(basic(x or "")) for (x,) in data("SELECT text FROM benchmark")]
    for lines in document_lines.values():
        norms = [normalize_text(x) for _, x in lines]
        for p, g in zip(passages, own, strict=True):
            if any(g & grams(basic(x)) for _, x in lines):
                cited += 1
                whole += any(p in n for n in norms)
    assert kinds["exact_quote"] >= whole and sum(r["confidence"] == 1.0 for r in run("cite_cascade")) == whole
    assert len(run("cite_cascade")) <= cited and set(kinds) <= {"exact_quote", "fuzzy_text", "line_number"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
