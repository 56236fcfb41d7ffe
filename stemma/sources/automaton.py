"""Citations of all sources in one pass: an automaton of names, and a small grammar after each (PRS-05, PRS-06, PRS-09, PRS-10).

The names of all works, in all their spellings, are one Aho-Corasick automaton, which goes over a text once however many there are. Where a
name ends, what follows is read by the grammar of its kind and of the text's style; of names that begin at one place the longest goes first.
Runs of white space are one space in names and text; offsets are those of the text as given. The result is that of spans().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from stemma.functions.text import NOT_AFTER
from stemma.sources.citation_text import NUMBER, ROMAN, SPAN, Forms, Found, _canonical, _number

KINDS = ("plays", "sonnets", "poems")
NAMES = ("abbrev", "act", "scene", "line", "start", "end")
FOUND = pa.list_(pa.struct([("abbrev", pa.string()), *((name, pa.int32()) for name in NAMES[1:])]))
#: Texts whose citations are Python objects at a time.
FEW = 64
_SPACE, _BEFORE = re.compile(r"\s+"), re.compile(NOT_AFTER)


class Finder:
    """All names of some sources' forms. styles: source -> forms."""

    def __init__(self, styles: dict[str, Forms]):
        self.styles = styles
        self.names = ahocorasick.Automaton()
        uses: dict[str, dict[tuple[str, str], str]] = {}
        for source, forms in styles.items():
            for kind in KINDS:
                for name in getattr(forms, kind):
                    uses.setdefault(" ".join(name.split()), {})[source, kind] = _canonical(forms, name)
        for name, own in uses.items():
            self.names.add_word(name, (len(name), own))
        if uses:
            self.names.make_automaton()
        self.tails = {style: {kind: re.compile(p) for kind, p in self._grammar(style).items()} for style in ("roman", "mixed")}

    @staticmethod
    def _grammar(style: str) -> dict[str, str]:
        """What follows a name, in text with single spaces."""
        scene, dot = (f"{ROMAN}|{NUMBER}", r"[.,]? ?") if style == "mixed" else (ROMAN, r"\. ?")
        return {"plays": rf" ?({ROMAN}){dot}({scene}){dot}({NUMBER})", "sonnets": rf" ?({ROMAN}|{NUMBER})[.,] ?({NUMBER})", "poems": rf" ?({NUMBER})"}

    @staticmethod
    def _place(kind: str, m: re.Match) -> tuple[int | None, int | None, int] | None:
        numbers = [_number(g) for g in m.groups()]
        return (*[None] * (3 - len(numbers)), *numbers) if all(numbers) else None

    def find(self, text: str | None, source: str) -> list[Found]:
        """The citations of a text of one source, sorted by where they stand; within plays, sonnets and poems none overlap."""
        if not text or not len(self.names) or source not in self.styles:
            return []
        runs = [(m.start(), m.end()) for m in _SPACE.finditer(text) if m.end() - m.start() > 1 or text[m.start()] != " "]
        plain = _SPACE.sub(" ", text) if runs else text
        hits: dict[str, dict[int, list[int]]] = {k: {} for k in KINDS}
        for last, (n, uses) in self.names.iter(plain):
            for kind in KINDS:
                if (source, kind) in uses:
                    hits[kind].setdefault(last + 1 - n, []).append(n)
        tails, out = self.tails["mixed" if self.styles[source].style == "mixed" else "roman"], []
        for kind, starts in hits.items():
            free = 0
            for start in sorted(starts):
                if start < free or not _BEFORE.match(plain, start):
                    continue
                for n in sorted(starts[start], reverse=True):
                    if m := tails[kind].match(plain, start + n):
                        free = m.end()
                        if place := self._place(kind, m):
                            out.append((_canonical(self.styles[source], plain[start : start + n]), *place, start, m.end()))
                        break
        if not runs:
            return sorted(out, key=lambda f: (f[4], f[5]))
        return sorted(((*f[:4], *_given(runs, f[4], f[5])) for f in out), key=lambda f: (f[4], f[5]))


def _given(runs: list[tuple[int, int]], start: int, end: int) -> Iterator[int]:
    """Offsets in the text as given, of offsets where each of runs is one character."""
    for x, is_end in ((start, False), (end, True)):
        cut = 0
        for a, b in runs:
            at = a - cut  # where the run stands in the plain text
            if at + is_end > x or at >= x:
                break
            cut += b - a - 1
        yield x + cut


def citation_column(styles: dict[str, Forms]):
    """A function of a text and a source column that gives the citations found; explode with inline()."""
    finder: list[Finder] = []

    @F.arrow_udf(SPAN)
    def find(texts: pa.Array, sources: pa.Array) -> pa.Array:
        if not finder:
            finder.append(Finder(styles))
        # A text is a Python object only while it is searched; what is found becomes columns every few texts.
        out = []
        for at in range(0, len(texts), FEW):
            pairs = zip(texts[at : at + FEW], sources[at : at + FEW], strict=True)
            out.append(pa.array([[dict(zip(NAMES, f, strict=True)) for f in finder[0].find(t.as_py(), s.as_py())] for t, s in pairs], FOUND))
        return pa.concat_arrays(out) if out else pa.array([], FOUND)

    def of(text: Column | str, source: Column | str) -> Column:
        return find(text, source)

    return of


def apart(spans: Column) -> Column:
    """PRS-10: sorted spans without those that begin within the one kept before."""
    empty = F.filter(spans, lambda x: F.lit(False))
    return F.aggregate(spans, empty, lambda kept, x: F.when((F.size(kept) == 0) | (F.element_at(kept, -1)["end"] <= x["start"]), F.concat(kept, F.array(x))).otherwise(kept))
