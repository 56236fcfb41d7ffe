"""Byte-level BPE encoding and decoding by replay of the merges over a block of the corpus.

The texts of a block are cut into pre-tokens by the pattern; each distinct pre-token of the block becomes one word of a
chain of symbols. An inverted index maps the rank of a token pair to the places in the chain where it stands. The ranks are
replayed in ascending order: all places of a rank are merged, left to right, and only the pairs with the two neighbours of
a merge are looked up anew. A block has a bounded number of bytes (a longer text is a block of its own), so memory does not
depend on the corpus; words met before are kept in a bounded table.

Defined cases: a null text is empty; empty texts have no ids, and the digests of no bytes; equal rows are encoded each;
an empty table gives no rows; other columns are ignored. Ids that are not in the vocabulary make decode() raise KeyError.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import keep, tidy, to_batch

BLOCK_BYTES = 6_000_000
KNOWN_WORDS = 600_000


class MergeReplay:
    """An encoder for byte-level ranks (token bytes -> id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        # (left id, right id) -> id of their concatenation, for every cut of every token into two tokens
        pairs = {(ranks[t[:k]] << 32) | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self._clear()

    @classmethod
    def from_file(cls, path: str, pattern: str) -> MergeReplay:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, or -1; negative ids (gaps) merge with nothing."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.merged[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each), by replay of the merges over all words together."""
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        # The chain has the symbols of every word, with a gap after each and one in front.
        ends = np.cumsum(sizes + 1)
        chain = np.full(int(ends[-1]) + 1 if len(ends) else 1, -1, dtype=np.int64)
        inside = np.ones(len(chain), dtype=bool)
        inside[np.r_[0, ends]] = False
        chain[inside] = self.byte_ids[raw]
        first = ends - sizes
        # A word that is a token needs no merges: its own merges lead to it.
        tokens = np.flatnonzero((whole >= 0) & (sizes > 0))
        if len(tokens):
            n = sizes[tokens]
            upto = np.cumsum(n)
            chain[np.repeat(first[tokens] - (upto - n), n) + np.arange(int(upto[-1]))] = -2
            chain[first[tokens]] = whole[tokens]
        if len(tokens) < len(words):
            self._replay(chain)
        alive = chain >= 0
        counts = np.add.reduceat(alive, first, dtype=np.int64) if len(first) else np.empty(0, np.int64)
        return chain[alive], np.where(sizes > 0, counts, 0)

    def _replay(self, chain: np.ndarray) -> None:
        nxt, prv = np.arange(1, len(chain) + 1), np.arange(-1, len(chain) - 1)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            keep = ranks >= 0
            places, ranks = places[keep], ranks[keep]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]) if len(ranks) else ()
            for r, a, b in zip(ranks[cuts].tolist() if len(ranks) else (), cuts, [*cuts[1:], len(ranks)], strict=False):
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heapq.heappush(heap, r)

        start = np.flatnonzero(chain[:-1] >= 0)
        enter(start, self.rank_of(chain[start], chain[start + 1]))
        while heap:
            r = heapq.heappop(heap)
            held = index.pop(r)
            places = np.unique(np.concatenate(held)) if len(held) > 1 else np.unique(held[0])
            right = nxt[places]
            now = self.rank_of(chain[places], chain[right]) == r
            places, right = places[now], right[now]
            if not len(places):
                continue
            if len(places) > 1 and np.isin(right, places).any():  # they overlap: from left to right, one by one
                self._merge_singly(chain, nxt, prv, places, r, enter, index, heap)
                continue
            saved = chain[places], chain[right], nxt[places], nxt[right]
            after = nxt[right]
            chain[places], chain[right] = r, -2
            nxt[places] = after
            prv[after] = places
            before = prv[places]
            after = nxt[places]
            on_left, on_right = self.rank_of(chain[before], chain[places]), self.rank_of(chain[places], chain[after])
            if ((on_left >= 0) & (on_left < r)).any() or ((on_right >= 0) & (on_right < r)).any():  # a lower rank comes up: it goes first
                chain[places], chain[right], nxt[places] = saved[0], saved[1], right
                prv[saved[3]] = right
                self._merge_singly(chain, nxt, prv, places, r, enter, index, heap)
                continue
            enter(np.concatenate([before, places]), np.concatenate([on_left, on_right]))

    def _merge_singly(self, chain, nxt, prv, places, r, enter, index, heap) -> None:
        for at, p in enumerate(places.tolist()):
            q = int(nxt[p])
            if chain[p] < 0 or int(self.rank_of(chain[p : p + 1], chain[q : q + 1])[0]) != r:
                continue
            chain[p], chain[q] = r, -2
            n, o = int(nxt[q]), int(prv[p])
            nxt[p], prv[n] = n, p
            new = self.rank_of(chain[[o, p]], chain[[p, n]])
            enter(np.array([o, p]), new)
            if ((new >= 0) & (new < r)).any() and at + 1 < len(places):
                if r in index:
                    index[r].append(places[at + 1 :])
                else:
                    index[r] = [places[at + 1 :]]
                    heapq.heappush(heap, r)
                return

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.start, self.size, self.used = np.empty(1 << 16, dtype="<u4"), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def _learn(self, words: list[str]) -> None:
        ids, sizes = self.encode_words([w.encode("utf-8", "surrogatepass") for w in words])
        n, k, used = len(self.known), len(words), self.used
        while n + k > len(self.start):
            self.start, self.size = np.r_[self.start, np.zeros_like(self.start)], np.r_[self.size, np.zeros_like(self.size)]
        while used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.empty_like(self.ids)]
        self.ids[used : used + len(ids)] = ids
        self.start[n : n + k] = used + np.cumsum(sizes) - sizes
        self.size[n : n + k] = sizes
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + k), strict=True))

    def encode_block(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        words, ends = [], []
        for t in texts:
            words += self.split(t)
            ends.append(len(words))
        new = set(words) - self.known.keys()
        if len(self.known) + len(new) > KNOWN_WORDS:
            self._clear()
            new = set(words)
        if new:
            self._learn(list(new))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        sizes = self.size[at]
        upto = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.start[at] - (upto - sizes), sizes) + np.arange(int(upto[-1]) if len(upto) else 0)]
        cuts = np.r_[0, upto][np.array(ends, dtype=np.int64)].tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def blocks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Slices of consecutive items whose sizes add up to at most limit, or of one item."""
    start = total = 0
    for k, n in enumerate(sizes):
        if k > start and total + n > limit:
            yield start, k
            start, total = k, 0
        total += n
    if sizes:
        yield start, len(sizes)


_ENCODERS: dict[tuple[str, str], MergeReplay] = {}


def encoder(path: str, pattern: str) -> MergeReplay:
    """One encoder for each Python worker and vocabulary."""
    keep("byte_bpe", _ENCODERS.clear)
    return _ENCODERS.get((path, pattern)) or _ENCODERS.setdefault((path, pattern), MergeReplay.from_file(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) of each row of docs (doc_id, text)."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
        for batch, ids, _ in _encoded(batches, path, pattern):
            yield to_batch({"doc_id": batch, "ids": [x.tobytes() for x in ids]}, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run, owner="byte_bpe"), "doc_id long, ids binary")


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str):
    bpe = encoder(path, pattern)
    for batch in batches:
        text = batch.column("text")
        for a, b in blocks(pc.fill_null(pc.binary_length(text), 0).to_pylist(), BLOCK_BYTES):
            yield batch.column("doc_id")[a:b], bpe.encode_block([t or "" for t in text[a:b].to_pylist()]), bpe


def encode_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs: texts are encoded, and the ids decoded."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        for doc, ids, bpe in _encoded(batches, path, pattern):
            yield to_batch(
                {
                    "doc_id": doc,
                    "n_tokens": [len(x) for x in ids],
                    "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
                },
                schema,
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run, owner="byte_bpe"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
