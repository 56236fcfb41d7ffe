"""Personal data by fixed forms and by a semi-Markov conditional random field.

Fixed forms (email, ip, card, phone) are found by regular expression and checks. Besides them, a semi-Markov CRF labels
whole segments of up to MAX_TOKENS tokens: features of the entire segment (its shape, digits, checksum, the word before it)
score each candidate with each type, everything else is single outside tokens, and dynamic programming over bounded
segments chooses boundaries and types together. An entity is bounded: at most MAX_TOKENS tokens and MAX_CHARS characters, and
never without a digit, an at sign or an address in words. So decoding only visits the tokens near such characters; all others
are outside with certainty, and a longer run of characters is none of the types (features of a single token outside read its
first MAX_FEATURE characters). The weights are trained here, by
gradient ascent on the log-likelihood of sentences made from templates (TRAINING_SENTENCES, SEED), once for each driver.

Defined cases: a null text is an empty one, without spans; equal rows are reported each; an empty table gives no rows; very
long texts are read whole, and decoding is linear in their tokens; segmentations of equal score go by the shortest last
segment and the first type; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import tidy, to_batch

BASE = ("email", "ip", "card", "phone")
TYPES = ("email", "ip", "card", "phone", "number")
KINDS = BASE + tuple(f"crf_{t}" for t in TYPES)
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match can only begin at a run of digits, or it would have begun earlier
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed forms; matches that fail a check are dropped and not tried again."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:
        a = at
        while a > floor and text[a - 1] in LOCAL_CHARS:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, 0, m.end()))
            floor = m.end()
            at = text.find("@", floor)
        else:
            at = text.find("@", at + 1)
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


# ---- the model

#: Scores that differ by less are equal: sums over parts of a text round in another way than sums over all of it.
SAME = 1e-10
MAX_TOKENS, MAX_CHARS, MAX_FEATURE, REACH = 5, 80, 120, 5
TRAINING_SENTENCES, EPOCHS, RATE, DECAY, SEED = 240, 6, 0.3, 1e-3, 7
HOT = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S+")
STRIP_LEFT, STRIP_RIGHT = "\"'<[{,;:!?.", "\"'>]},;:!?."
#: Words that announce an entity.
CUES = frozenset("mail email e-mail contact write call phone tel tel. telephone mobile fax dial ip host server address card visa mastercard pay ssn id passport iban account number no nr".split())
SHAPE = ((re.compile(r"[0-9]+"), lambda m: str(min(len(m[0]), 5))), (re.compile(r"[^\W\d_]+"), lambda m: "a"))


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A segment without the punctuation around it."""
    while a < b and text[a] in STRIP_LEFT:
        a += 1
    while b > a and text[b - 1] in STRIP_RIGHT:
        b -= 1
    return a, b


@functools.lru_cache(maxsize=20_000)
def segment_features(s: str, tokens: int, before: str) -> tuple[str, ...]:
    """Features of a whole segment, without its type."""
    shape = s.lower()
    for pattern, by in SHAPE:
        shape = pattern.sub(by, shape)
    digits = DIGIT.sub("", s)
    out = [f"n{tokens}", f"s:{shape[:40]}", f"d{min(len(digits), 20)}", f"n{tokens}d{min(len(digits), 20)}", "cue:" + (before if before in CUES else "")]
    out += ["at"] * ("@" in s) + ["at+dot"] * (" at " in s and " dot " in s) + ["plus"] * s.startswith("+") + ["paren"] * s.startswith("(")
    if 14 <= len(digits) <= 19 and len(digits) + s.count(" ") + s.count("-") == len(s):
        out.append("luhn" if luhn(digits) else "not luhn")
    parts = s.split(".")
    if len(parts) == 4 and all(p.isdigit() for p in parts):
        out.append("octets" if all(len(p) <= 3 and int(p) <= 255 for p in parts) else "not octets")
    return tuple(out)


class SemiCrf:
    """Types are 1.. of TYPES, 0 is outside. Scores are sums of weights of (type, feature)."""

    def __init__(self, weights: dict[tuple[int, str], float] | None = None):
        self.weights = weights or {}

    def lattice(self, text: str, spans: list[tuple[int, int]], first: str = "") -> list[list[tuple[int, int, tuple[str, ...]]]]:
        """For each end (token number + 1): (start token, 0 or 1 for entities allowed, features). first: the token before them all."""
        out = [[] for _ in range(len(spans) + 1)]
        for e in range(1, len(spans) + 1):
            for n in range(1, min(MAX_TOKENS, e) + 1):
                k = e - n
                a, b = trimmed(text, spans[k][0], spans[e - 1][1])
                s = text[a:b]
                entity = b - a <= MAX_CHARS and HOT.search(s) is not None or " at " in s and " dot " in s
                if n > 1 and not entity:
                    continue
                before = (text[slice(*spans[k - 1])] if k else first).lower().rstrip(":,")
                out[e].append((k, int(entity), segment_features(s[:MAX_FEATURE], n, before)))
        return out

    def score(self, label: int, features: tuple[str, ...]) -> float:
        return sum(self.weights.get((label, f), 0.0) for f in features)

    def labels(self, start: int, end: int, entity: int) -> range:
        return range(0 if end - start == 1 else 1, len(TYPES) + 1 if entity else 1)

    def decode(self, lattice) -> list[tuple[int, int, int]]:
        """The best segmentation: (start token, end token, type) of its entities."""
        best, back = [0.0], [None]
        for e in range(1, len(lattice)):
            best.append(-math.inf)
            back.append(None)
            for k, entity, features in lattice[e]:
                for label in self.labels(k, e, entity):
                    v = best[k] + self.score(label, features)
                    if v > best[e] + SAME:
                        best[e], back[e] = v, (k, label)
        out, e = [], len(lattice) - 1
        while e:
            k, label = back[e]
            if label:
                out.append((k, e, label))
            e = k
        return out[::-1]

    def gradient_step(self, lattice, gold: dict[tuple[int, int], int], rate: float) -> None:
        """One step up the log-likelihood of a segmentation: its features less their expectation by forward and backward sums."""
        n = len(lattice) - 1
        scored = [[(k, label, features, self.score(label, features)) for k, entity, features in lattice[e] for label in self.labels(k, e, entity)] for e in range(n + 1)]

        def logsum(values):
            top = max(values)
            return top + math.log(sum(math.exp(v - top) for v in values))

        forward = [0.0] + [-math.inf] * n
        for e in range(1, n + 1):
            forward[e] = logsum([forward[k] + v for k, _, _, v in scored[e]])
        onward: list[list[float]] = [[] for _ in range(n + 1)]
        backward = [-math.inf] * n + [0.0]
        for e in range(n, 0, -1):
            if e < n:
                backward[e] = logsum(onward[e])
            for k, _, _, v in scored[e]:
                onward[k].append(v + backward[e])
        for e in range(1, n + 1):
            for k, label, features, v in scored[e]:
                p = math.exp(forward[k] + v + backward[e] - forward[n])
                g = (gold.get((k, e), 0 if e - k == 1 and not any(a <= k < b for a, b in gold) else -1) == label) - p
                if abs(g) > 1e-4:
                    for f in features:
                        w = self.weights.get((label, f), 0.0)
                        self.weights[label, f] = w + rate * (g - DECAY * w)


def sentences(n: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Made-up sentences and their entities (start, end, type), with things of like form that are none."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["ba", "ne", "ti", "ro", "lu", "ka", "mi", "den", "ist", "ora"]) for _ in range(r.randint(1, 4)))

    def card():
        d = "4" + digits(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice([d, f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", f"{d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:]}"])

    entity = {
        1: lambda: r.choice([f"{word()}.{word()}@{word()}.com", f"{word()}{digits(2)}@{word()}.org", f"{word()} at {word()} dot com"]),
        2: lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        3: card,
        4: lambda: r.choice([f"+{r.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(11)}", f"{digits(3)} {digits(3)} {digits(4)}"]),
        5: lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
    }
    cue = {1: ["mail", "email", "contact", "write"], 2: ["ip", "host", "server", "address"], 3: ["card", "visa", "pay"], 4: ["call", "phone", "tel.", "dial"], 5: ["ssn", "id", "passport"]}
    decoy = [lambda: str(r.randint(1, 2100)), lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"${digits(2)}.{digits(2)}", lambda: f"{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", lambda: f"{digits(2)}:{digits(2)}", lambda: digits(r.randint(5, 9)), lambda: f"{digits(2)}%", lambda: f"978-3-{digits(2)}-{digits(6)}-{digits(1)}", lambda: f"@{word()}", lambda: digits(16), lambda: ".".join(digits(3) for _ in range(2)), lambda: f"{word()} at {word()}", lambda: f"{word()}{digits(2)}"]
    for _ in range(n):
        parts, at, found = [], 0, []

        def put(s, t=0):
            nonlocal at
            if t:
                found.append((at, at + len(s), t))
            parts.append(s)
            at += len(s) + 1

        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(1, 4)):
                put(word())
            if r.random() < 0.6:
                t = r.randint(1, 5)
                if r.random() < 0.6:
                    put(r.choice(cue[t]))
                s = entity[t]()
                put(s, t)
                if r.random() < 0.3:
                    parts[-1] += "."
                    at += 1
            else:
                put(r.choice(decoy)())
        put(word())
        yield " ".join(parts), found


def prepared(crf: SemiCrf, text: str, found: list[tuple[int, int, int]]):
    spans = [m.span() for m in TOKEN.finditer(text)]
    gold = {}
    for a, b, t in found:
        inside = [k for k, (x, y) in enumerate(spans) if x < b and a < y]
        gold[inside[0], inside[-1] + 1] = t
    return spans, crf.lattice(text, spans), gold


@functools.lru_cache(maxsize=1)
def trained() -> SemiCrf:
    crf = SemiCrf()
    data = [prepared(crf, t, f)[1:] for t, f in sentences(TRAINING_SENTENCES, SEED)]
    for epoch in range(EPOCHS):
        for lattice, gold in data:
            crf.gradient_step(lattice, gold, RATE / (1 + epoch / 2))
    return crf


def crf_spans(crf: SemiCrf, text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the entities of the best segmentation."""
    hot = {m.start() for m in HOT.finditer(text)}
    if not hot and " dot " not in text:
        return []
    spans = [m.span() for m in TOKEN.finditer(text)]
    near, hot = set(), sorted(hot)
    h = 0
    for k, (a, b) in enumerate(spans):
        while h < len(hot) and hot[h] < a:
            h += 1
        if h < len(hot) and hot[h] < b or text[a:b] == "dot":
            near.update(range(max(0, k - REACH), min(len(spans), k + REACH + 1)))
    out, near = [], sorted(near)
    start = 0
    for i in range(1, len(near) + 1):
        if i < len(near) and near[i] == near[i - 1] + 1:
            continue
        first, last = near[start], near[i - 1] + 1
        start = i
        region = spans[first:last]
        for k, e, label in crf.decode(crf.lattice(text, region, text[slice(*spans[first - 1])] if first else "")):
            a, b = trimmed(text, region[k][0], region[e - 1][1])
            if b > a:
                out.append((a, len(BASE) + label - 1, b))
    return out


def all_spans(crf: SemiCrf, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(fixed forms, those and the entities that overlap none of them), each sorted."""
    base = base_spans(text)
    more, k, reach = [], 0, 0  # the fixed forms before k begin before the entity, and reach so far
    for span in sorted(crf_spans(crf, text)):
        while k < len(base) and base[k][0] < span[2]:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= span[0]:
            more.append(span)
    return base, sorted(base + more)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


REPORT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row of docs (doc_id, text)."""
    weights = docs.sparkSession.sparkContext.broadcast(trained().weights)  # a few thousand numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])
        crf = SemiCrf(weights.value)
        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in schema}
            for text in batch.column("text").to_pylist():
                base, spans = all_spans(crf, text) if text else ([], [])
                for k, name in enumerate(BASE):
                    rows[f"n_{name}"].append(sum(s[1] == k for s in base))
                rows["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                rows["spans"].append(_joined(spans))
            yield to_batch(rows | {"doc_id": batch.column("doc_id")}, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), REPORT)
