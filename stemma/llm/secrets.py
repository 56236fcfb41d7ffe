"""Secret scan: fixed forms, and strings that a battery of randomness tests takes for random.

Fixed forms (assign, access, hex) are found by regular expression. Besides them, every run of 20 or more characters of
the base64 alphabets gets an inferred encoding and three tests against uniform draws from its alphabet: chi-squared over
bins of the alphabet, runs above and below its middle, and lag-one serial correlation; Fisher's method combines
their p-values. A random string keeps a large p-value, words and numbers in sequence do not. How large it must be is
decided for each band of lengths and class (letters of one case against their own alphabet, and all others) from the whole
corpus: each candidate has a decoy of its class (as many letters of the text before it, other candidates left out), and the lowest score is taken at
which decoys that pass are at most FALSE_SHARE of the candidates that pass. A band with too few candidates for that takes
p-values of 0.01 or more, as long as its decoys keep the share, but not in the classes of one case: a single long word may
look random. Runs of 16 or more digits or a-f are hex spans, so they are found whatever the battery says.

Defined cases: a null text is an empty one, without spans; equal rows are reported each; an empty table gives no rows;
a text of one very long run is tested whole; other columns are ignored or, by redact(), kept.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.common import materialize, tidy, to_batch

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the longest runs, as [0-9a-f]+ finds them, of 16 or more
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
ALPHANUMERIC, LETTERS = re.compile(r"[^A-Za-z0-9]+"), re.compile(r"[^A-Za-z]+")  # what is left out

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from the narrowest alphabet to the widest.
ENCODINGS = {
    "decimal": DIGITS,
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "lower": LOWER,
    "upper": UPPER,
    "base32": UPPER + "234567",
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
    "mixed": UPPER + LOWER + DIGITS + "+/-_",
}
#: Classes of candidates: letters of one case are tested against their case, all others against the encoding inferred.
CLASSES = (None, "lower", "upper")
_RANKS = {name: np.array([alphabet.find(chr(c)) for c in range(128)]) for name, alphabet in ENCODINGS.items()}
#: Bins of each alphabet for the chi-squared test, as edges of ranks: halves of each case, the digits and the signs apart, so that a lack
#: of digits or a wealth of signs shows.
BINS = {
    "decimal": np.arange(0, 11, 2),
    "hex": np.arange(0, 17, 2),
    "HEX": np.arange(0, 17, 2),
    "lower": np.array([0, 5, 10, 15, 20, 26]),
    "upper": np.array([0, 5, 10, 15, 20, 26]),
    "base32": np.array([0, 13, 26, 32]),
    "base62": np.array([0, 13, 26, 39, 52, 62]),
    "base64": np.array([0, 13, 26, 39, 52, 62, 64]),
    "base64url": np.array([0, 13, 26, 39, 52, 62, 64]),
    "mixed": np.array([0, 13, 26, 39, 52, 62, 66]),
}
#: Upper bounds of the bands of lengths; a last band has the rest.
BANDS = (24, 32, 48, 64, 96)
#: Scores are -log10 of the p-value in steps of 1 / STEPS, up to CEILING.
STEPS, CEILING = 4, 12
FALSE_SHARE = 0.05
#: In bands too sparse for the count: p-values of 0.01 or more.
SPARSE = 2 * STEPS


def infer_encoding(s: str) -> str:
    """The narrowest alphabet that holds all of s; letters alone may come from any with letters, and count as base32 or base62."""
    codes = np.frombuffer(s.encode("ascii"), dtype=np.uint8)
    return next(name for name, ranks in _RANKS.items() if name not in CLASSES and (ranks[codes] >= 0).all())


def chi2_tail(x: float, k: int) -> float:
    """P(chi-squared with k degrees > x), by Wilson and Hilferty's cube root."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return min(1.0, max(1e-300, 0.5 * math.erfc(z / math.sqrt(2))))


def normal_tail(z: float) -> float:
    """P(|N(0, 1)| > |z|)."""
    return max(1e-300, math.erfc(abs(z) / math.sqrt(2)))


def battery(s: str, encoding: str | None = None) -> float:
    """Fisher's combined p-value of the three tests of s against uniform draws from its encoding's alphabet."""
    encoding = encoding or infer_encoding(s)
    x = _RANKS[encoding][np.frombuffer(s.encode("ascii"), dtype=np.uint8)].astype(float)
    size, n = len(ENCODINGS[encoding]), len(s)
    edges = BINS[encoding]
    counts = np.histogram(x, bins=edges - 0.5)[0]
    expected = n * np.diff(edges) / size
    off = np.maximum(0, np.abs(counts - expected) - np.where(expected < 2, 0.5, 0))  # continuity where few are expected
    p = [chi2_tail(float((off**2 / expected).sum()), len(expected) - 1)]
    high = x >= size / 2
    n1 = int(high.sum())
    n2 = n - n1
    if n1 and n2:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * n1 * n2 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p.append(normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1e-12)
    else:
        p.append(1e-12)
    d = x - x.mean()
    denominator = float((d * d).sum())
    p.append(normal_tail(float((d[1:] * d[:-1]).sum()) / denominator * math.sqrt(n)) if denominator > 0 else 1e-12)
    return chi2_tail(-2 * sum(math.log(v) for v in p), 2 * len(p))


def score(s: str, encoding: str | None = None) -> int:
    """The p-value of s as a step: 0 is the most random."""
    return min(CEILING * STEPS, int(-math.log10(battery(s, encoding)) * STEPS))


def band(n: int, kind: int = 0) -> int:
    """The number of a band of lengths in a class."""
    return kind * (len(BANDS) + 1) + sum(n > b for b in BANDS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed forms; matches that are too short still use up their text."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(start, end, band, score, decoy's score) of runs apart from the spans taken (sorted). A decoy is made of the letters before that stand
    in neither a run nor a span taken, else one secret would be the decoy of another; its score is -1 if they are too few."""
    out, k, at = [], 0, 0
    before: tuple[list[str], list[str]] = ([], [])  # what stands before: letters and digits, and letters

    def pass_by(end: int) -> None:
        piece = ALPHANUMERIC.sub("", text[at:end])
        for held, more in zip(before, (piece, LETTERS.sub("", piece)), strict=True):
            held += [more] * bool(more)

    def last(held: list[str], n: int) -> str:
        parts, have = [], 0
        for piece in reversed(held):
            parts.append(piece)
            have += len(piece)
            if have >= n:
                return "".join(reversed(parts))[-n:]
        return ""

    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][0] < b:
            if (end := min(taken[k][0], a)) > at:
                pass_by(end)
            at = max(at, taken[k][2])
            k += 1
        if at > a:
            at = max(at, b)
            continue
        pass_by(a)
        at, n, run = b, b - a, m[0]
        kind = (1 if run.islower() else 2 if run.isupper() else 0) if run.isalpha() else 0
        decoy = last(before[kind > 0], n)
        decoy = decoy.lower() if kind == 1 else decoy.upper() if kind == 2 else decoy
        out.append((a, b, band(n, kind), score(run, CLASSES[kind]), score(decoy, CLASSES[kind]) if decoy else -1))
    return out


def found_in(text: str | None) -> tuple[list[int], list[int]]:
    """(base spans, candidates) of a text, as flat lists."""
    base = base_spans(text) if text else []
    return [v for span in base for v in span], [v for c in candidates(text, base) for v in c] if text else []


FOUND = pa.list_(pa.int64())


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("base", FOUND), ("cand", FOUND)])
    for batch in batches:
        found = [found_in(t) for t in batch.column("text").to_pylist()]
        yield to_batch({"doc_id": batch.column("doc_id"), "base": [f[0] for f in found], "cand": [f[1] for f in found]}, schema)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base, cand: spans and scored candidates of each row, as flat lists."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_scan), "doc_id long, base array<long>, cand array<long>")


def thresholds(scanned: DataFrame, share: float = FALSE_SHARE) -> dict[int, int]:
    """The largest score that passes, by band of lengths, from a histogram of all documents' candidates and decoys.

    The histogram has at most 18 x 49 cells, whatever the corpus. One decoy is added to those that pass; bands that are too sparse for it
    go without, up to SPARSE. Bands in which no score keeps the share even so have none.
    """
    c = scanned.where(F.size("cand") > 0).select(F.explode(F.sequence(F.lit(0), F.size("cand") - 1, F.lit(5))).alias("i"), "cand")
    cells = c.groupBy(F.get("cand", F.col("i") + 2).alias("b"), F.get("cand", F.col("i") + 3).alias("t"), F.get("cand", F.col("i") + 4).alias("d")).count()
    bands = (len(BANDS) + 1) * len(CLASSES)
    target, decoy = np.zeros((bands, CEILING * STEPS + 1)), np.zeros((bands, CEILING * STEPS + 1))
    cells = cells.select("b", F.explode(F.array(F.struct(F.lit(0).alias("w"), F.col("t").alias("s")), F.struct(F.lit(1).alias("w"), F.col("d").alias("s")))).alias("x"), "count")
    for r in cells.groupBy("b", "x.w", "x.s").agg(F.sum("count").alias("n")).where("s >= 0").collect():
        (decoy if r["w"] else target)[r["b"], r["s"]] += r["n"]
    out = {}
    for b in range(bands):
        decoys, targets = decoy[b].cumsum(), target[b].cumsum()
        passing = np.nonzero((decoys + 1) / np.maximum(1, targets) <= share)[0]
        if not len(passing) and b <= len(BANDS):
            passing = np.nonzero((targets > 0) & (decoys <= share * targets))[0]
            passing = passing[passing <= SPARSE]
        if len(passing):
            out[b] = int(passing[-1])
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def accepted(cand: list[tuple[int, int, int, int, int]], limits: dict[int, int]) -> list[tuple[int, int, int]]:
    return [(a, 3, b) for a, b, band_, s, _ in cand if s <= limits.get(band_, -1)]


REPORT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of docs (doc_id, text)."""
    scanned = materialize(scan(docs), "secrets")
    limits = thresholds(scanned)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
        for batch in batches:
            rows = {f.name: [] for f in schema}
            for i, base, cand in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "base", "cand")), strict=True):
                spans = [(base[k], base[k + 1], base[k + 2]) for k in range(0, len(base), 3)]
                more = accepted([tuple(cand[k : k + 5]) for k in range(0, len(cand), 5)], limits)
                rows["doc_id"].append(i)
                for k in range(3):
                    rows[f"n_{KINDS[k]}"].append(sum(s[1] == k for s in spans))
                rows["base_sha256"].append(hashlib.sha256(_joined(spans).encode()).hexdigest())
                rows["spans"].append(_joined(sorted(spans + more)))
            yield to_batch(rows, schema)

    return scanned.mapInArrow(tidy(finish), REPORT)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret's characters replaced by mark, and n_chars (if there) counted anew. The battery runs once: what it finds is
    written beside the rows, and read for the thresholds and for the marks."""
    fields = [*docs.schema.fields, *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("__stemma_base", "__stemma_cand"))]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [found_in(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield batch.append_column("__stemma_base", pa.array([f[0] for f in found], FOUND)).append_column("__stemma_cand", pa.array([f[1] for f in found], FOUND))

    written = materialize(docs.mapInArrow(tidy(search), T.StructType(fields)), "searched")
    limits = thresholds(written.select(F.col("__stemma_cand").alias("cand")))

    def one(text: str | None, base: list[int], cand: list[int]) -> str | None:
        spans = [(base[k], base[k + 1], base[k + 2]) for k in range(0, len(base), 3)]
        spans = sorted(spans + accepted([tuple(cand[k : k + 5]) for k in range(0, len(cand), 5)], limits))
        out, at = [], 0
        for a, _, b in spans:
            if b <= at:
                continue
            out += [text[at:a], mark] if a >= at else []
            at = b
        return "".join([*out, text[at:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = batch.num_columns - 2, batch.schema.get_field_index("text")
            rows = zip(batch.column(k).to_pylist(), batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)
            yield batch.select(list(range(n))).set_column(k, batch.schema.field(k), pa.array([one(*r) for r in rows], batch.schema.field(k).type))

    changed = written.mapInArrow(tidy(run), docs.schema)
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else changed
