"""The lexicon in TEI (SRC-07, SRC-08, PRS-03, PRS-04)."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from stemma.functions.text import split_sense_key
from stemma.sources.markup import parse_xml, text_of

_NUMBERED = re.compile(r"(?<![0-9A-Za-z])([0-9]+)\)\s")
_LETTERED = re.compile(r"(?<![0-9A-Za-z])([a-z])\)\s")


def _outside(text: str, at: int) -> bool:
    """Whether a place is outside parentheses; a closing bracket without an open one belongs to a marker."""
    depth = 0
    for c in text[:at]:
        depth += (c == "(") - (c == ")" and depth > 0)
    return depth == 0


def _markers(pattern: re.Pattern, text: str, first: int, value) -> list[tuple[int, int, int]]:
    """(number, start, end) of markers that count up from first, outside parentheses."""
    out, want = [], first
    for m in pattern.finditer(text):
        if value(m[1]) == want and _outside(text, m.start()):
            out.append((want, m.start(), m.end()))
            want += 1
    return out


def senses(text: str | None) -> list[tuple[int, str | None, str]]:
    """PRS-03: (number, letter or null, text) of the senses of a definition. Without markers it is sense 1; text before the first letter
    is a sense of its own."""
    text = (text or "").strip()
    numbered = _markers(_NUMBERED, text, 1, int)
    if not numbered:
        numbered = [(1, 0, 0)]
    out = []
    for k, (n, _, start) in enumerate(numbered):
        body = text[start : numbered[k + 1][1] if k + 1 < len(numbered) else len(text)].strip()
        letters = _markers(_LETTERED, body, 0, lambda c: ord(c) - ord("a"))
        if len(letters) < 2:
            out.append((n, None, body))
            continue
        if head := body[: letters[0][1]].strip():
            out.append((n, None, head))
        for j, (letter, _, at) in enumerate(letters):
            out.append((n, chr(ord("a") + letter), body[at : letters[j + 1][1] if j + 1 < len(letters) else len(body)].strip()))
    return out


def sense_of(text: str, shown: str) -> int:
    """PRS-04: the number of the last raw marker before the first place of a citation's text; 1 if there is none."""
    at = text.find(shown) if shown else -1
    found = [int(m[1]) for m in _NUMBERED.finditer(text[:at] if at >= 0 else "")]
    return found[-1] if found else 1


def parse_entry(raw: str) -> dict | None:
    """SRC-07: key, entry text, senses and citations of one entry file; files with bare ampersands are read as if they were escaped."""
    try:
        root = parse_xml(raw)
    except ET.ParseError:
        root = parse_xml((raw or "").replace("&", "&amp;"))
    entry = next(root.iter("entryFree"), None)
    if entry is None:
        return None
    orth = next(entry.iter("orth"), None)
    full = text_of(entry)
    cites = []
    for cit in [c for c in entry.iter() if c.tag in ("cit", "bibl")]:
        if cit.tag == "bibl" and any(cit in list(c) for c in entry.iter("cit")):
            continue
        bibl = next(cit.iter("bibl"), None)
        if bibl is None or not (bibl.get("n") or "").startswith("shak."):
            continue
        quote, shown = next(cit.iter("quote"), None), text_of(bibl)
        cites.append({"raw_bibl": bibl.get("n"), "display_text": shown, "quote_text": text_of(quote) if quote is not None else "", "sense_number": sense_of(full, shown)})
    return {
        "key": entry.get("key") or (text_of(orth) if orth is not None else ""),
        "orth": text_of(orth) if orth is not None else "",
        "full_text": full,
        "senses": [{"sense_number": n, "sub_sense": s, "definition_text": t} for n, s, t in senses(full)],
        "citations": cites,
    }


@udtf(returnType="key string, orth string, full_text string, senses array<struct<sense_number:int,sub_sense:string,definition_text:string>>, citations array<struct<raw_bibl:string,display_text:string,quote_text:string,sense_number:int>>")
class LexiconEntry:
    def eval(self, raw: str):
        e = parse_entry(raw)
        if e:
            yield e["key"], e["orth"], e["full_text"], e["senses"], e["citations"]


def lexicon_tables(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC-08: (entries, senses, citations) from parsed files: the first file of a key wins; ids are hashes of natural keys. A citation
    belongs to the last sub-sense of its number, or to none if the number has no sense."""
    first = entries.withColumn("_rn", F.row_number().over(W.partitionBy("key").orderBy("path"))).where("_rn = 1 AND key <> ''")
    base, group = split_sense_key(F.col("key"))
    e = first.select(F.xxhash64("key").alias("id"), "key", base.alias("base_key"), group.alias("sense_group"), F.upper(F.substring("key", 1, 1)).alias("letter"), "full_text", "senses", "citations")
    s = e.select(F.col("id").alias("entry_id"), F.posexplode("senses").alias("pos", "s")).select(F.xxhash64("entry_id", "pos").alias("id"), "entry_id", "s.sense_number", "s.sub_sense", "s.definition_text", "pos")
    last = s.groupBy("entry_id", "sense_number").agg(F.max_by("id", "pos").alias("sense_id"))
    c = e.select(F.col("id").alias("entry_id"), F.col("key").alias("headword"), F.posexplode("citations").alias("pos", "c"))
    c = c.select(F.xxhash64("entry_id", F.lit("citation"), "pos").alias("id"), "entry_id", "headword", "c.raw_bibl", "c.display_text", "c.quote_text", "c.sense_number")
    return e.drop("senses", "citations"), s.drop("pos"), c.join(last, ["entry_id", "sense_number"], "left")
