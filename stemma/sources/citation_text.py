"""Citations in the text of reference works (PRS-01, PRS-02, PRS-05..10).

Abbreviations are inputs: a Forms object holds those of one work. All finders return (abbreviation, act, scene, line, start, end)
with character offsets; citations() drops repeats, spans() keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F

from stemma.functions.text import NOT_AFTER, roman_value

Found = tuple[str, int | None, int | None, int | None, int, int]
ROMAN, NUMBER = "[IVXLCDMivxlcdm]+", "[0-9]+"


@dataclass(frozen=True)
class Forms:
    """Abbreviations of plays, sonnets and other poems, OCR spellings of them, and how numbers are written."""

    plays: tuple[str, ...]
    sonnets: tuple[str, ...] = ()
    poems: tuple[str, ...] = ()
    style: str = "roman"  # roman: i. ii. 3; mixed: the scene may be Arabic; spaced: i 2 3 by lines; act_scene: no lines
    spellings: dict[str, str] = field(default_factory=dict)


def _names(names: tuple[str, ...]) -> str:
    """An alternation, longest first, in which any white space may stand for a space."""
    return "|".join(r"\s+".join(map(re.escape, n.split())) for n in sorted(names, key=lambda n: (-len(n), n))) or r"(?!)"


def _number(s: str | None) -> int:
    return int(s) if s and s.isdigit() else roman_value(s)


def _canonical(forms: Forms, name: str) -> str:
    plain = " ".join(name.split())
    return forms.spellings.get(plain, forms.spellings.get(plain.replace(",", "."), plain))


def _inline(forms: Forms, text: str) -> Iterator[Found]:
    scene = f"{ROMAN}|{NUMBER}" if forms.style == "mixed" else ROMAN
    sep = r"[.,]?\s*" if forms.style == "mixed" else r"\.\s*"
    for m in re.finditer(rf"{NOT_AFTER}({_names(forms.plays)})\s*({ROMAN}){sep}({scene}){sep}({NUMBER})", text):
        act, sc, line = _number(m[2]), _number(m[3]), int(m[4])
        if act and sc and line:
            yield _canonical(forms, m[1]), act, sc, line, m.start(), m.end()
    for m in re.finditer(rf"{NOT_AFTER}({_names(forms.sonnets)})\s*({ROMAN}|{NUMBER})[.,]\s*({NUMBER})", text):
        if _number(m[2]) and int(m[3]):
            yield _canonical(forms, m[1]), None, _number(m[2]), int(m[3]), m.start(), m.end()
    for m in re.finditer(rf"{NOT_AFTER}({_names(forms.poems)})\s*({NUMBER})", text):
        if int(m[2]):
            yield _canonical(forms, m[1]), None, None, int(m[2]), m.start(), m.end()


def _by_line(forms: Forms, text: str) -> Iterator[Found]:
    """Concordance lines: a play and three numbers anywhere, else a poem and a number, else three numbers under the last name."""
    names = tuple({*forms.plays, *forms.spellings})
    play = re.compile(rf"({_names(names)})\s+({ROMAN})\s+({NUMBER})\s+({NUMBER})")
    poem = re.compile(rf"({_names(forms.poems + forms.sonnets)})\s+({NUMBER})")
    bare = re.compile(rf"(?:^|\s)({ROMAN})\s+({NUMBER})\s+({NUMBER})\s*$")
    last, at = "", 0
    for line in text.split("\n"):
        hits = list(play.finditer(line)) or list(play.finditer(line.replace(",", ".")))
        if hits:
            for m in hits:
                last = _canonical(forms, m[1])
                if _number(m[2]) and int(m[3]) and int(m[4]):
                    yield last, _number(m[2]), int(m[3]), int(m[4]), at + m.start(), at + m.end()
        elif m := poem.search(line):
            if int(m[2]):
                last = _canonical(forms, m[1])
                yield last, None, None, int(m[2]), at + m.start(), at + m.end()
        elif last and (m := bare.search(line)) and _number(m[1]) and int(m[2]) and int(m[3]):
            yield last, _number(m[1]), int(m[2]), int(m[3]), at + m.start(1), at + m.end(3)
        at += len(line) + 1


def _act_scene(forms: Forms, text: str) -> Iterator[Found]:
    """Name, act and scene in words or brackets, without lines."""
    worded = rf"({_names(forms.plays)})\s+(?:\[\d{{4}}\],?\s+)?\[?(?:[Aa]ct\s+)?({ROMAN})\.?,?\s+(?:[Ss]cene|[Ss]c\.)\s+({ROMAN}|{NUMBER})"
    bracket = rf"({_names(forms.plays)})\s+\[({ROMAN})\.,\s+({NUMBER})\.?\]"
    for pattern in (worded, bracket):
        for m in re.finditer(pattern, text):
            if _number(m[2]) and _number(m[3]):
                yield _canonical(forms, m[1]), _number(m[2]), _number(m[3]), None, m.start(), m.end()


def spans(text: str | None, forms: Forms) -> list[Found]:
    """PRS-09: every citation, sorted by where it stands."""
    find = {"spaced": _by_line, "act_scene": _act_scene}.get(forms.style, _inline)
    return sorted(find(forms, text or ""), key=lambda f: (f[4], f[5]))


def citations(text: str | None, forms: Forms) -> list[tuple[str, int | None, int | None, int | None]]:
    """PRS-05..08: each citation once, in the order of the text."""
    return list(dict.fromkeys(f[:4] for f in spans(text, forms)))


SPAN = "array<struct<abbrev:string,act:int,scene:int,line:int,start:int,end:int>>"


def span_column(forms: Forms):
    """A function of a text column that gives its citation spans; explode with inline()."""

    @F.pandas_udf(SPAN)
    def find(texts: pd.Series) -> pd.Series:
        names = ("abbrev", "act", "scene", "line", "start", "end")
        return texts.map(lambda t: [dict(zip(names, f, strict=True)) for f in spans(t, forms)])

    return find


def segments(text: str, found: list[tuple[int, int]]) -> list[tuple[str, bool]]:
    """PRS-10: the text in parts (part, is a citation); spans that begin within the one before are passed over."""
    out, at = [], 0
    for start, end in sorted(found):
        if start < at:
            continue
        out += [(text[at:start], False)] if start > at else []
        out.append((text[start:end], True))
        at = end
    return out + ([(text[at:], False)] if at < len(text) else [])


# ---- references of the lexicon

#: A second number of a two-part reference to a play above this is a line: no act has so many scenes.
MOST_SCENES = 15


def parse_reference(ref: str | None, work_types: dict[str, str]) -> dict | None:
    """PRS-01: 'shak. ham 3.1.56' as code, act, scene, line; work_types: code -> work type (input). Null if it is none of the known works."""
    m = re.match(r"shak\.\s*(\S+)(.*)", ref or "")
    if not m or m[1] not in work_types:
        return None
    out = {"code": m[1], "act": None, "scene": None, "line": None}
    kind, rest = work_types[m[1]], m[2].split()
    if not rest:
        return out
    induction = re.match(r"ind\.?(?:(\d+))?(?:\.(\d+))?", rest[0], re.IGNORECASE)
    if induction:
        return out | {"act": 0, "scene": _int(induction[1]), "line": _int(induction[2])}
    numbers = next((p for p in rest[:2] if p.split(".")[0].isdigit()), None)
    if numbers is None:
        return out
    parts = [_int(p) for p in numbers.split(".")]
    if len(parts) == 1:
        return out | {"line": parts[0]}
    if kind == "sonnet_sequence":
        return out | {"scene": parts[-2], "line": parts[-1]} if len(parts) <= 3 else out
    if kind == "poem":
        return out | ({"scene": parts[0], "line": parts[1]} if len(parts) == 2 else {"line": parts[2]} if len(parts) == 3 else {})
    if len(parts) == 2:
        return out | {"act": parts[0], ("line" if (parts[1] or 0) > MOST_SCENES else "scene"): parts[1]}
    return out | {"act": parts[0], "scene": parts[1], "line": parts[2]} if len(parts) == 3 else out


def _int(s: str | None) -> int | None:
    return int(s) if s and s.isdigit() else None


#: Numbers of a displayed reference: act, scene and line at most.
MOST_SHOWN = 3


def shown_numbers(shown: str | None) -> list[int]:
    """The numbers that a displayed reference ends in, set off by commas; the first may be Roman and follow the name of the work."""
    out: list[int] = []
    for part in reversed((shown or "").rstrip().removesuffix(".").split(",")):
        last = re.split(r"[^0-9A-Za-z]", part.strip())[-1]
        if not (last.isdigit() or last and set(last) <= set("IVXLC")) or len(out) == MOST_SHOWN:
            break
        out.insert(0, _number(last))
        if not part.strip().isdigit():
            break
    return out


def supplement(ref: dict | None, shown: str | None, kind: str) -> dict | None:
    """PRS-02: parts that the reference lacks, from the numbers at the end of the displayed text; a play shown with two numbers cites
    act and line, so a scene without a line is read as the line."""
    numbers = shown_numbers(shown)
    if ref is None or not numbers:
        return ref
    names = {"sonnet_sequence": ("scene", "line"), "poem": ("line",)}.get(kind, ("act", "scene", "line"))
    if kind not in ("sonnet_sequence", "poem") and len(numbers) == 2:
        if ref["line"] is None and ref["scene"] == numbers[1]:
            return ref | {"scene": None, "line": numbers[1]}
        names = ("act", "line")
    names = names[-len(numbers) :] if len(numbers) < len(names) else names
    got = dict(zip(names, numbers[-len(names) :], strict=True))
    return ref | {k: v for k, v in got.items() if ref[k] is None and v}
