"""Editions in TEI XML and XHTML (SRC-06, SRC-09..22).

Mixed content with milestones needs the order of text and elements, so the parsers walk event streams of the standard library and
are table functions over whole files; numbering that only needs an order of rows is done by windows in DataFrames.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, StringType

from stemma.functions.text import roman_value

LINE = "act int, scene int, pos int, character string, char_id string, text string, is_stage boolean, is_verse boolean, line_number int"
_BARE_AMPERSAND = re.compile(r"&(?!#?\w+;)")
PROLOGUE, EPILOGUE = 0, 99


def parse_xml(text: str) -> ET.Element:
    """SRC-06: the tree of a document that may have bare ampersands, HTML entities, a document type and namespaces (dropped)."""
    import html

    text = re.sub(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", "", text or "")
    text = re.sub(r"&(?!amp;|lt;|gt;|quot;|apos;|#)(\w+);", lambda m: html.unescape(m[0]) if html.unescape(m[0]) != m[0] else f"&amp;{m[1]};", text)
    root = ET.fromstring(_BARE_AMPERSAND.sub("&amp;", text).encode("utf-8", "surrogatepass"))
    for e in root.iter():
        if isinstance(e.tag, str):
            e.tag = e.tag.rpartition("}")[2]
    return root


def text_of(e: ET.Element, skip: frozenset[str] = frozenset()) -> str:
    """All text of an element but that of the skipped elements (their tails stay), with single spaces."""

    def parts(x) -> Iterator[str]:
        yield x.text or ""
        for child in x:
            if child.tag not in skip:
                yield from parts(child)
            yield child.tail or ""

    return " ".join("".join(parts(e)).split())


def _place(e: ET.Element, kind: str, order: int) -> int:
    """The number of an act or scene: digits, Roman, or by name; others by order."""
    n = (e.get("n") or "").strip()
    low = f"{e.get('type', '')} {n}".lower()
    if "prologue" in low or "induction" in low:
        return PROLOGUE
    if "epilogue" in low:
        return EPILOGUE if kind == "scene" else PROLOGUE
    return int(n) if n.isdigit() else roman_value(n) or order


def _divisions(root: ET.Element) -> Iterator[tuple[int, int, ET.Element]]:
    """(act, scene, element) of each scene; an act without scenes is scene 1."""
    is_kind = lambda e, kind: e.tag in ("div", "div1", "div2", "div3") and e.get("type") == kind
    acts = [e for e in root.iter() if is_kind(e, "act")]
    outside = [e for e in root.iter() if e.tag in ("div", "div1", "div2") and e.get("type") in ("prologue", "epilogue", "induction")]
    for k, act in enumerate(acts, 1):
        number = _place(act, "act", k)
        scenes = [e for e in act.iter() if is_kind(e, "scene")]
        if not scenes:
            yield number, 1, act
        for j, scene in enumerate(scenes, 1):
            yield number, _place(scene, "scene", j), scene
    for e in outside:
        if not any(e in list(a.iter()) for a in acts):
            yield 0, _place(e, "scene", 1), e


def tei_play(text: str) -> Iterator[tuple]:
    """SRC-14 and SRC-17: speeches, stage directions and lines of a TEI play. Prose is broken at <lb ed="G">, whose n is its line
    number; verse is one row for each <l>. End-of-line hyphens (<g>) go, gaps are [?], long s is s."""
    root = parse_xml(text)
    scenes = list(_divisions(root)) or [(1, 1, root)]
    pos = 0

    def clean(s: str) -> str:
        return " ".join(s.replace("ſ", "s").split())

    def pieces(e) -> Iterator[tuple[str, str | None]]:
        """Text, with None in front of a milestone's number at each line break."""
        yield e.text or "", None
        for c in e:
            if c.tag == "lb" and c.get("ed", "G") == "G":
                yield "", c.get("n") or "?"
            elif c.tag == "gap":
                yield "[?]", None
            elif c.tag not in ("g", "speaker", "stage", "note", "fw", "pb"):
                yield from pieces(c)
            yield c.tail or "", None

    for act, scene, div in scenes:
        inside = {id(x) for s in div.iter("sp") for x in s.iter("stage")}
        for e in div.iter():
            if e.tag == "stage" and id(e) not in inside:
                if t := clean(text_of(e)):
                    pos += 1
                    yield act, scene, pos, None, None, t, True, False, None
            elif e.tag == "sp":
                who, speaker = e.get("who"), e.find("speaker")
                name = clean(text_of(speaker)) if speaker is not None else None
                for part in e:
                    if part.tag == "stage":
                        if t := clean(text_of(part)):
                            pos += 1
                            yield act, scene, pos, name, who, t, True, False, None
                        continue
                    verses = [x for x in part.iter("l")] or ([part] if part.tag in ("p", "ab", "q", "lg", "l") else [])
                    for v in verses:
                        held, number = "", int(v.get("n")) if (v.get("n") or "").isdigit() else None
                        for t, lb in (*pieces(v), ("", "end")):
                            if lb is None:
                                held += t
                                continue
                            if s := clean(held):
                                pos += 1
                                yield act, scene, pos, name, who, s, False, v.tag == "l", number
                            held, number = "", int(lb) if lb.isdigit() else None


def tei_words_play(text: str) -> Iterator[tuple]:
    """SRC-19: TEIsimple with every word marked up: act, scene, pos, character, char_id, text, is_stage, is_verse, line number (from
    n="a.s.l"; 0 if none), words (word, lemma, pos)."""
    root = parse_xml(text)
    pos = 0
    for act, scene, div in list(_divisions(root)) or [(1, 1, root)]:
        speaker_of = {id(x): s for s in div.iter("sp") for x in s.iter()}
        for e in div.iter():
            if e.tag not in ("l", "p", "ab", "stage"):
                continue
            words, out = [], ""
            for x in e.iter():
                if x.tag in ("w", "c", "pc"):
                    t = "".join(x.itertext())
                    out += t
                    if x.tag == "w":
                        words.append((t, x.get("lemma"), x.get("pos") or x.get("ana")))
            sp = speaker_of.get(id(e))
            n = (e.get("n") or "").split(".")
            number = int(n[2]) if len(n) == 3 and n[2].isdigit() and not n[0].upper().startswith("SD") else 0
            if s := " ".join(out.split()):
                pos += 1
                who = (sp.get("who") if sp is not None else None) or e.get("who")
                name = sp.find("speaker") if sp is not None else None
                yield act, scene, pos, text_of(name) if name is not None else None, who, s, e.tag == "stage", e.tag == "l", number, words


def quarto(text: str) -> Iterator[tuple]:
    """SRC-21: a quarto without divisions: everything is act 1, scene 1."""
    root = parse_xml(text)
    for e in root.iter():
        if e.tag in ("div", "div1", "div2", "div3"):
            e.set("type", "")
    yield from tei_play(ET.tostring(root, encoding="unicode"))


class _Flow(HTMLParser):
    """Text of an XHTML edition in its order: (kind, classes, id, text) of the block elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict]] = []
        self.events: list[tuple[str, str, dict | str]] = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("start", tag, dict(attrs)))
        if tag in ("br", "img", "hr", "meta", "link"):
            self.events.append(("end", tag, {}))

    def handle_endtag(self, tag):
        self.events.append(("end", tag, {}))

    def handle_data(self, data):
        self.events.append(("text", "", data))


def _events(html: str):
    p = _Flow()
    p.feed(html or "")
    p.close()
    return p.events


def xhtml_play(html: str) -> Iterator[tuple]:
    """SRC-09: tables of persona and speech. Sections are act-N and scene-N-M; prologues are scene 0, epilogues scene 99. A speech is
    verse if its lines are spans, prose if not; <i epub:type="z3998:stage-direction"> is a stage direction."""
    act = scene = pos = line = 0
    persona, held, stage, in_persona, in_stage, verse = None, "", "", False, False, False

    def flush(text, is_stage):
        nonlocal pos, line
        t = " ".join(text.split())
        if not t:
            return None
        pos += 1
        line += not is_stage
        return act, scene, pos, persona, None, t, is_stage, verse, None if is_stage else line

    for kind, tag, value in _events(html):
        if kind == "start":
            eid = value.get("id") or ""
            words = f"{value.get('class') or ''} {value.get('epub:type') or ''}"
            if m := re.fullmatch(r"act-([0-9ivx]+)", eid):
                act, scene, line = _number(m[1]), 0, 0
            if tag == "section" and (m := re.fullmatch(r"scene-(?:[0-9ivx]+-)?([0-9ivx]+)", eid)):
                scene, line = _number(m[1]), 0
            if tag == "section" and ("prologue" in eid or "prologue" in words):
                scene, line = PROLOGUE, 0
            if tag == "section" and ("epilogue" in eid or "epilogue" in words):
                scene, line = EPILOGUE, 0
            if tag == "td" and "persona" in words:
                in_persona, persona = True, ""
            if tag == "tr" or tag == "td" and not in_persona:
                held, verse = "", "verse" in words if tag == "td" else False
            if tag == "span" and not in_persona:
                held, verse = "", True
            if tag == "i" and "stage-direction" in words:
                in_stage, stage = True, ""
        elif kind == "text":
            if in_persona:
                persona += value
            elif in_stage:
                stage += value
            else:
                held += value
        else:
            if tag == "td" and in_persona:
                in_persona, persona = False, " ".join(persona.split()) or None
            elif tag == "i" and in_stage:
                in_stage = False
                if row := flush(stage, True):
                    yield row
            elif tag in ("span", "p", "td", "br") and not in_persona:
                if row := flush(held, False):
                    yield row
                held = ""
            if tag == "tr":
                persona = None


def _number(s: str) -> int:
    return int(s) if s.isdigit() else roman_value(s)


def xhtml_poems(html: str, skip: tuple[str, ...] = ("dedication", "header", "titlepage")) -> Iterator[tuple[str, int | None, int, int, str]]:
    """SRC-11 and SRC-12: (article id, sonnet number or null, stanza, line in the article, text) of each span or line of the articles."""
    article, sonnet, stanza, line, held, muted = "", None, 0, 0, "", 0
    for kind, tag, value in _events(html):
        if kind == "start":
            eid, words = value.get("id") or "", f"{value.get('id') or ''} {value.get('epub:type') or ''} {value.get('class') or ''}"
            if muted or tag in ("header", "h1", "h2", "h3", "hgroup") or tag in ("section", "div") and any(s in words for s in skip):
                muted += tag not in ("br", "img", "hr", "meta", "link")
                continue
            if tag == "article":
                m = re.fullmatch(r"sonnet-([0-9]+)", eid)
                article, sonnet, stanza, line = eid, int(m[1]) if m else None, 0, 0
            stanza += tag == "p"
            held = "" if tag in ("p", "span") else held
        elif kind == "text":
            held += "" if muted else value
        elif muted:
            muted -= tag not in ("br", "img", "hr", "meta", "link")
        elif tag in ("span", "br", "p"):
            if (t := " ".join(held.split())) and article:
                line += 1
                yield article, sonnet, max(1, stanza), line, t
            held = ""


@udtf(returnType=LINE)
class TeiPlay:
    def eval(self, text: str):
        yield from tei_play(text)


@udtf(returnType=LINE)
class QuartoPlay:
    def eval(self, text: str):
        yield from quarto(text)


@udtf(returnType=LINE)
class XhtmlPlay:
    def eval(self, html: str):
        yield from xhtml_play(html)


@udtf(returnType=LINE + ", words array<struct<word:string,lemma:string,pos:string>>")
class WordsPlay:
    def eval(self, text: str):
        yield from tei_words_play(text)


@udtf(returnType="article string, sonnet int, stanza int, line int, text string")
class XhtmlPoems:
    def eval(self, html: str):
        yield from xhtml_poems(html)


_SHOWN = re.compile(r"<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", re.DOTALL | re.IGNORECASE)


def html_lines(html: str | None) -> list[str]:
    """The lines of text that a web page shows: block elements end lines; scripts, styles and the head are left out."""
    out, held = [], ""
    for kind, tag, value in _events(_SHOWN.sub("", html or "")):
        if kind == "text":
            held += value
        elif tag in ("p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "tr", "td", "section", "article", "nav", "header", "footer", "main", "aside", "blockquote", "pre", "body"):
            out += [held]
            held = ""
    return [t for t in (" ".join(x.split()) for x in [*out, held]) if t]


@F.pandas_udf(ArrayType(StringType()))
def html_text_lines(html):
    return html.map(html_lines)


def parse_files(files: DataFrame, column: str, parser, keep: list[str]) -> DataFrame:
    """Rows of a table function over a column of whole files, with the columns to keep."""
    files.sparkSession.udtf.register("_parse_files", parser)
    files.createOrReplaceTempView("_files_to_parse")
    kept = ", ".join(f"f.`{c}`" for c in keep)
    return files.sparkSession.sql(f"SELECT {kept}{', ' if kept else ''}t.* FROM _files_to_parse f, LATERAL _parse_files(f.`{column}`) t")


# ---- numbering by windows

def fill_running_max(number: Column, keys: list[str], order: list[str]) -> Column:
    """SRC-20 and WIN-03: lines without a number (0 or null) take the largest number so far in their scene, or 0."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.when(F.coalesce(number, F.lit(0)) > 0, number).otherwise(F.coalesce(F.max(number).over(w), F.lit(0)))


def scene_counter(keys: list[str], order: list[str]) -> Column:
    """WIN-02: 1, 2, ... within each scene."""
    return F.row_number().over(W.partitionBy(*keys).orderBy(*order))


def run_ids(value: Column, keys: list[str], order: list[str]) -> Column:
    """WIN-06: the number of each run of equal values."""
    w = W.partitionBy(*keys).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(value) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return F.sum(change).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))


def interpolate_numbers(df: DataFrame, number: str, keys: list[str], order: list[str], is_stage: str | None = None, out: str = "line_number") -> DataFrame:
    """SCL-20, WIN-04 and WIN-05: numbers of all speech lines from those that are marked: between two marks by linear interpolation with
    truncating division, before the first by counting back (1 at least), after the last by counting on, without marks 1..n. Stage
    directions take the number of the speech before them, 0 at first."""
    speech = df.where(~F.col(is_stage)) if is_stage else df
    w = W.partitionBy(*keys).orderBy(*order)
    n = speech.withColumn("_k", F.row_number().over(w))
    mark = F.when(F.col(number).isNotNull(), F.struct(F.col("_k").alias("k"), F.col(number).alias("n")))
    n = n.withColumn("_b", F.last(mark, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("_a", F.first(mark, ignorenulls=True).over(w.rowsBetween(W.currentRow, W.unboundedFollowing)))
    between = F.expr("_b.n + ((_a.n - _b.n) * (_k - _b.k)) div nullif(_a.k - _b.k, 0)")
    value = (
        F.when(F.col(number).isNotNull(), F.col(number).cast("long"))
        .when(F.col("_b").isNull() & F.col("_a").isNull(), F.col("_k"))
        .when(F.col("_b").isNull(), F.greatest(F.lit(1), F.expr("_a.n - (_a.k - _k)")))
        .when(F.col("_a").isNull(), F.expr("_b.n + (_k - _b.k)"))
        .otherwise(between)
    )
    numbered = n.withColumn(out, value.cast("int")).drop("_k", "_b", "_a")
    if not is_stage:
        return numbered
    both = numbered.unionByName(df.where(F.col(is_stage)).withColumn(out, F.lit(None).cast("int")))
    return both.withColumn(out, F.coalesce(F.last(out, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(0)))
