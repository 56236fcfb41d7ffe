"""Packing of token sequences by lexical retrieval.

Each document's ids are cut into windows of its own as long as they fill them; the rest of it is packed with other rests. A
sharded BM25 inverted index serves the rests: documents are sorted by a signature of four min-hashes over all their tokens
(an LSH forest: documents with much in common have a long prefix in common), and consecutive documents make a shard, so a
group too large for one shard is split where its next min-hash differs. The next unused rest of a shard is the seed of a
window, all tokens of its whole document query the index over whole documents, and unused neighbours fill the window in the
order of their scores: those that fit whole first, then the best one is cut and its remainder is the next seed. A window that
a shard cannot fill is filled by the next one, so only the last window of a partition has padding.

Defined cases: a null or empty text has only the end id; equal rows are documents of their own (also under one doc_id);
neighbours of equal score go by (signature, spread, doc_id); an empty table gives no rows; very long texts are encoded in
slices cut at white space; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.byte_bpe import blocks
from stemma.llm.common import keep, materialize, release, tidy, to_batch

WINDOW, END_ID = 2048, 1
SHARD_DOCS, K1, B = 1000, 1.2, 0.75
#: Characters of text encoded at once, and bytes of encoded documents in a partition of shards.
BLOCK_BYTES, PART_BYTES = 1_000_000, 16_000_000
_ENCODERS: dict[str, "TextEncoder"] = {}

LETTER, DIGIT, SPACE, OTHER, END, UNSURE = range(6)
#: Between texts of a block; texts that hold it are encoded by themselves.
SEP = "\ue000"
WHITE = re.compile(r"\s")


def char_kinds(n: int = 0x20000) -> np.ndarray:
    """The kind of each code point below n, as the tokenizer's pattern sees it. Kinds that depend on the version of Unicode are
    UNSURE, and so are vowels that compose; the last entry stands for all code points beyond."""
    kinds = np.full(n, UNSURE, np.uint8)
    for c in range(n - 1):
        now, old = unicodedata.category(chr(c)), unicodedata.ucd_3_2_0.category(chr(c))
        if now[0] == old[0] and now[0] in "LNZ":
            kinds[c] = LETTER if now[0] == "L" else DIGIT if now[0] == "N" else SPACE
        elif now[0] in "PSM" or now in ("Cc", "Cf"):
            kinds[c] = OTHER if old == "Cn" or old[0] in "PSMC" else UNSURE
    kinds[[9, 10, 11, 12, 13, 0x85]] = SPACE
    kinds[0x1100:0x1200] = UNSURE
    kinds[ord(SEP)] = END
    return kinds


class TextEncoder:
    """The ids of a lower-casing tokenizer with word ends, by ranks.

    A vocabulary whose merges stand in the order of their ids is a table of ranks, if the end of a word is a byte of its own: a
    space, which no pre-token holds. So the pre-tokens of a block are found with array operations, a space goes after each, and
    one call encodes them all. Texts with characters that the tokenizer may see in another way go to the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # Bytes that are no printable characters have stand-ins from 256 on, in their order.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(byte[c] for c in t.removesuffix("</w>")) + b" " * t.endswith("</w>"): i for t, i in vocabulary.items() if not t.startswith("<|")}
        del vocabulary
        self.ranks = tiktoken.Encoding("word ends", pat_str="[^ ]+ | ", mergeable_ranks=ranks, special_tokens={"<|no text|>": max(ranks.values()) + 9})
        self.mark = ranks[b" "]  # a space by itself: the end of a text
        self.path, self.own = path, None
        self.kinds = char_kinds()
        release()  # what the reading of the vocabulary took

    @property
    def tokenizer(self):
        """The tokenizer itself, which few texts need."""
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.path)
        return self.own

    @classmethod
    def of(cls, path: str) -> TextEncoder:
        keep("packing", _ENCODERS.clear)
        return _ENCODERS.get(path) or _ENCODERS.setdefault(path, cls(path))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text without special tokens, and END_ID."""
        if not any(t and len(t) > BLOCK_BYTES for t in texts):
            return self._whole(texts)
        parts = [[self._whole([x])[0] for x in slices(t or "", BLOCK_BYTES)] for t in texts]
        return [np.concatenate([*(ids[:-1] for ids in p[:-1]), p[-1]]) for p in parts]

    def _whole(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        ready = {k: p for k, t in enumerate(texts) if (p := plain(t or "")) is not None}
        codes = np.frombuffer((SEP.join(ready.values()) + SEP * bool(ready)).encode("utf-32-le"), dtype="<u4")
        kinds = self.kinds[np.minimum(codes, len(self.kinds) - 1)]
        if (unsure := np.flatnonzero(kinds == UNSURE)).size:
            ends = np.flatnonzero(kinds == END)
            names = list(ready)
            bad = np.unique(np.searchsorted(ends, unsure)).tolist()
            gone = np.zeros(len(codes), dtype=bool)
            for k in bad:
                gone[ends[k - 1] + 1 if k else 0 : ends[k] + 1] = True
                del ready[names[k]]
            codes, kinds = codes[~gone], kinds[~gone]
        if ready:
            for k, ids in zip(ready, self._block(codes, kinds), strict=True):
                out[k] = ids
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(rest, self.tokenizer.encode_batch([texts[k] or "" for k in rest], add_special_tokens=False) if rest else (), strict=True):
            out[k] = np.array([*e.ids, END_ID], dtype="<u4")
        return out

    def _block(self, codes: np.ndarray, kinds: np.ndarray) -> list[np.ndarray]:
        """The ids of texts in a row, each with END after it."""
        held = kinds != SPACE
        held[kinds == END] = False
        last = held.copy()  # whether a pre-token ends here
        last[:-1] &= (kinds[:-1] != kinds[1:]) | (kinds[:-1] == DIGIT)
        quote = np.flatnonzero(codes == 39)
        if len(quote):  # 's 't 'm 'd 're 've 'll, where an apostrophe begins a pre-token
            near = np.r_[codes, 0, 0, 0]
            begins = (quote == 0) | (kinds[quote - 1] != OTHER)
            one, two = near[quote + 1], near[quote + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for found, n in ((quote[begins & short], 1), (quote[begins & long], 2)):
                last[found] = False
                last[found + n] = True
        size = held.astype(np.int8) + last + (kinds == END)
        upto = np.cumsum(size, dtype=np.int32 if len(size) < 2**29 else np.int64)
        spaced = np.full(int(upto[-1]), 32, dtype="<u4")
        spaced[(upto - size)[held]] = codes[held]
        ids = self.ranks.encode_to_numpy(spaced.tobytes().decode("utf-32-le"), disallowed_special=()).astype("<u4")
        ends = np.flatnonzero(ids == self.mark)
        ids[ends] = END_ID
        cuts = (ends + 1).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


def slices(text: str, size: int) -> list[str]:
    """A text in slices of about size characters, cut at white space, which no pre-token crosses."""
    out, at = [], 0
    while len(text) - at > size:
        m = WHITE.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]]


def plain(t: str) -> str | None:
    """A text in lower case, if that and nothing else is what the tokenizer's normaliser does to it besides white space."""
    if "<|" in t or SEP in t:
        return None
    low = t.lower()
    if t.isascii():
        return low
    return low if len(low) == len(t) and "\u03a3" not in t and unicodedata.is_normalized("NFC", t) and unicodedata.is_normalized("NFC", low) else None


SIGNATURE, VOCABULARY = 4, 1 << 16
#: Hash functions of tokens, as orders of the vocabulary.
_ORDERS = np.stack([np.random.default_rng(k).permutation(VOCABULARY).astype(np.uint16) for k in range(SIGNATURE)])


def signature(terms: np.ndarray) -> int:
    """The tokens that each hash function puts first, in one signed number; numbers sort as the lists of tokens do, but for the sign."""
    out = 0
    for order in _ORDERS:
        out = out << 16 | int(terms[np.argmin(order[terms])])
    return out - (1 << 64) if out >> 63 else out


ENCODED = "doc_id long, doc_tokens long, crcs binary, rest binary, terms binary, counts binary, route long, size long"


def _encode(path: str):
    schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}[kind]) for n, kind in (f.split() for f in ENCODED.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder.of(path)
        for batch in batches:
            texts = batch.column("text")
            for a, b in blocks(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), BLOCK_BYTES):
                rows = {f.name: [] for f in schema}
                for doc, ids in zip(batch.column("doc_id")[a:b].to_pylist(), encoder.encode(texts[a:b].to_pylist()), strict=True):
                    full = len(ids) // WINDOW * WINDOW
                    rest = ids[full:].astype("<u2").tobytes()
                    terms, counts = np.unique(ids.astype("<u2"), return_counts=True)
                    crcs = np.array([zlib.crc32(ids[k : k + WINDOW]) for k in range(0, full, WINDOW)], dtype="<u4").tobytes()
                    held = doc, len(ids), crcs, rest, terms.tobytes(), counts.astype("<u4").tobytes(), signature(terms), len(crcs) + len(rest) + 6 * len(terms)
                    for name, v in zip(rows, held, strict=True):
                        rows[name].append(v)
                yield to_batch(rows, schema)

    return run


class Bm25:
    """An inverted index over documents given by their distinct tokens and the counts of these. Postings of the tokens that many of the
    documents hold are rows of a matrix, the others are lists."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray]):
        n = self.n = len(terms)
        length = np.array([c.sum() for c in counts], dtype=np.float64)
        every, tf = np.concatenate(terms), np.concatenate(counts).astype(np.float64)
        order = np.argsort(every, kind="stable")
        every, tf, self.doc = every[order], tf[order], np.repeat(np.arange(n), [len(t) for t in terms])[order]
        self.start = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        self.df = np.diff(np.r_[self.start, len(every)])
        self.tokens = every[self.start]
        idf = np.log1p((n - self.df + 0.5) / (self.df + 0.5))
        self.weight = np.repeat(idf, self.df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.doc] / length.mean()))
        common = self.df > max(16, n // 16)
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        inside = np.repeat(self.row, self.df)
        self.matrix = np.zeros((int(common.sum()), n), dtype=np.float32)
        self.matrix[inside[inside >= 0], self.doc[inside >= 0]] = self.weight[inside >= 0]

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 of every document for all of these distinct tokens."""
        at = np.searchsorted(self.tokens, terms)
        at = at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == terms]
        row = self.row[at]
        dense, at = self.matrix[row[row >= 0]].sum(axis=0, dtype=np.float64), at[row < 0]
        n = self.df[at]
        upto = np.cumsum(n)
        flat = np.repeat(self.start[at] - (upto - n), n) + np.arange(int(upto[-1]) if len(upto) else 0)
        return dense + np.bincount(self.doc[flat], self.weight[flat], self.n)


class Packer:
    """Fills windows from one shard after another. emit(item, start, length, sequence, offset) takes each piece of a rest."""

    def __init__(self, emit, window: int = WINDOW):
        self.emit, self.window = emit, window
        self.sequence, self.left, self.query = -1, 0, None

    def begin(self) -> int:
        self.sequence += 1
        return self.sequence

    def _put(self, item, start: int, length: int) -> None:
        self.emit(item, start, length, self.open, self.window - self.left)
        self.left -= length

    def shard(self, items: list, lengths: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray]) -> None:
        """Pack the rests of a shard: each id of each rest once. The last window may stay open for the next shard."""
        if not len(items):
            return
        index = Bm25(terms, counts)
        unused = lengths > 0
        order, at, seed = np.argsort(-lengths, kind="stable"), 0, None
        while True:
            if not self.left:
                if seed is None:
                    while at < len(order) and not unused[order[at]]:
                        at += 1
                    if at == len(order):
                        return
                    seed = int(order[at]), 0
                k, start = seed
                seed, unused[k] = None, False
                self.open, self.left, self.query = self.begin(), self.window, terms[k]
                self._put(items[k], start, int(lengths[k]) - start)
            open_ = np.flatnonzero(unused)
            if not len(open_):
                if self.left:
                    return
                continue
            ranked = open_[np.argsort(-index.scores(self.query)[open_], kind="stable")]
            fits = lengths[ranked]
            while self.left:  # whole neighbours in the order of their scores
                i = int(np.argmax(fits <= self.left)) if len(fits) else 0
                if not len(fits) or fits[i] > self.left:
                    break
                self._put(items[ranked[i]], 0, int(fits[i]))
                unused[ranked[i]] = False
                ranked, fits = np.delete(ranked, i), np.delete(fits, i)
            if self.left and len(ranked):  # the best one is cut
                seed = int(ranked[0]), self.left
                unused[ranked[0]] = False
                self._put(items[ranked[0]], 0, self.left)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of one partition of encoded documents, in their order, shard by shard."""
    schema = pa.schema([(f.split()[0], pa.int64()) for f in PIECES.split(", ")])
    base = TaskContext.get().partitionId() << 32
    rows: dict[str, list] = {f.name: [] for f in schema}

    def put(doc, start, length, crc, tokens, sequence, offset):
        for name, v in zip(rows, (doc, start, length, crc, tokens, base + sequence, offset), strict=True):
            rows[name].append(v)

    def emit(item, start, length, sequence, offset):
        doc, tokens, rest = item
        put(doc, tokens - len(rest) + start, length, zlib.crc32(rest[start : start + length].astype("<u4")), tokens, sequence, offset)

    packer = Packer(emit)
    shard: list[tuple] = []

    def close() -> pa.RecordBatch:
        nonlocal rows, shard
        packer.shard([s[0] for s in shard], np.array([len(s[0][2]) for s in shard], dtype=np.int64), [s[1] for s in shard], [s[2] for s in shard])
        out, rows, shard = to_batch(rows, schema), {f.name: [] for f in schema}, []
        return out

    for batch in batches:
        for doc, tokens, crcs, rest, terms, counts in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "doc_tokens", "crcs", "rest", "terms", "counts")), strict=True):
            for i, crc in enumerate(np.frombuffer(crcs, dtype="<u4").tolist()):
                put(doc, i * WINDOW, WINDOW, crc, tokens, packer.begin(), 0)
            if rest:
                shard.append(((doc, tokens, np.frombuffer(rest, dtype="<u2")), np.frombuffer(terms, dtype="<u2"), np.frombuffer(counts, dtype="<u4")))
            if len(shard) >= SHARD_DOCS:
                yield close()
    yield close()


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each piece of each row of docs (doc_id, text): PIECES."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = materialize(d.mapInArrow(tidy(_encode(tokenizer), owner="packing"), ENCODED), "encoded")
    held = encoded.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    # As many partitions as the bytes ask for; fewer bytes are still spread over the cores, in shards of their own.
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(-(-held["n"] // SHARD_DOCS), max(cores, -(-(held["size"] or 0) // PART_BYTES))))
    # Copies have one signature: the hash of the row spreads them over partitions, however many they are.
    spread = encoded.drop("size").withColumn("spread", F.xxhash64("doc_id", "doc_tokens", "rest"))
    ordered = spread.repartitionByRange(parts, "route", "spread").sortWithinPartitions("route", "spread", "doc_id", "doc_tokens", "rest", "terms")
    return ordered.mapInArrow(tidy(_pack), PIECES)
