"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised to integers. A block of rows holds, for each attribute, one bitmap for each bit of (value - least
value of the block). A query adds the slices of all attributes with bitmap arithmetic: a weight's set bits shift slices to
higher columns (a negative weight takes the complement), and full adders reduce each column to one bitmap, which leaves the
bit slices of all rows' scores. The best k rows are then selected from the most significant slice downward; rows that tie
at the boundary are resolved by their ids, and the chosen rows' scores are computed from the integers themselves.

Rows stay in blocks of bounded bytes, and the queries go to the blocks: a block's rows reach its task before the queries, which
pass by in batches, so one index serves them all and neither all rows nor all queries are ever in one task's memory. The k best
of each query in each block go on. Where there are fewer blocks than cores, some tasks share a block's queries.

Defined cases: vectors that are null, or hold a null or a non-finite component, take no part; empty ones do, with products of 0, nor do rows with a null
id; shorter vectors count as padded with zeros; repeated rows under one id are rows each; equal query rows are answered once; rows with the query's id are its own;
an empty table gives no rows; scores that may not fit a long raise ValueError; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.llm.common import materialize, tidy, to_batch

#: Bytes of a block's integers in memory, and most vectors in it.
BLOCK_BYTES, BLOCK_ROWS = 64_000_000, 65_536


class BitSlicedIndex:
    """Bit slices of the columns of an integer matrix."""

    def __init__(self, rows: np.ndarray):
        self.rows, (self.n, self.dims) = rows, rows.shape
        self.words = -(-self.n // 64)
        self.valid = self._bitmap(np.ones(self.n, dtype=bool))
        self.low = rows.min(axis=0)
        lifted = (rows - self.low).astype(np.uint64)
        self.slices = [np.stack([self._bitmap((lifted[:, d] >> np.uint64(b)) & np.uint64(1)) for b in range(int(lifted[:, d].max()).bit_length())] or [np.zeros(self.words, np.uint64)]) for d in range(self.dims)]

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.words * 64, dtype=np.uint8)
        padded[: self.n] = bits
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def add(self, weights: list[int]) -> list[np.ndarray]:
        """The bit slices, least first, of each row's weighted sum, up to a constant that is the same for all rows."""
        columns: dict[int, list[np.ndarray]] = {}
        for d, w in enumerate(weights):
            s = self.slices[d] if w >= 0 else ~self.slices[d]
            for j in range(abs(w).bit_length()):
                if abs(w) >> j & 1:
                    for b in range(len(s)):
                        columns.setdefault(b + j, []).append(s[b])
        out, p = [], 0
        while columns:
            column = columns.pop(p, [])
            stack = np.stack(column) if column else np.zeros((1, self.words), np.uint64)
            carries = []
            while len(stack) > 1:
                k = len(stack) // 3
                if k:
                    a, b, c = stack[: 3 * k : 3], stack[1 : 3 * k : 3], stack[2 : 3 * k : 3]
                    x = a ^ b
                    carries.append((a & b) | (x & c))
                    stack = np.concatenate([x ^ c, stack[3 * k :]])
                else:
                    carries.append(stack[:1] & stack[1:])
                    stack = stack[:1] ^ stack[1:]
            for c in carries:
                columns.setdefault(p + 1, []).extend(c)
            out.append(stack[0])
            p += 1
        return out

    def top(self, weights: list[int], k: int, skip: np.ndarray) -> np.ndarray:
        """Places of the k rows with the largest sums, ties to smaller places; skip: places that take no part."""
        open_ = self.valid.copy()
        for at in skip:
            open_[at // 64] &= ~np.uint64(1 << int(at % 64))
        chosen, count = np.zeros(self.words, np.uint64), 0
        if int(np.bitwise_count(open_).sum()) <= k:
            chosen, open_ = open_, chosen
        else:
            for s in reversed(self.add(weights)):
                high = open_ & s
                n = int(np.bitwise_count(high).sum())
                if count + n > k:
                    open_ = high
                else:
                    chosen, count, open_ = chosen | high, count + n, open_ & ~s
                    if count == k:
                        open_[:] = 0
                        break
        places = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
        sure = places(chosen)
        return np.r_[sure, places(open_)[: max(0, k - len(sure))]]


def _quantise(scale: float):
    schema = pa.schema([("id", pa.int64()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v"), strict=True):
                if i is None or not v.is_valid or v.values is not None and v.values.null_count:
                    continue
                x = np.floor(np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=np.float64) * scale)
                if not np.isfinite(x).all():
                    continue
                if np.abs(x).max(initial=0) >= 2**31:
                    raise ValueError("a quantised component needs more than 32 bits: scores may not fit a long")
                ids.append(i)
                out.append(x.astype("<i4").tobytes())
            yield to_batch({"id": ids, "v": out}, schema)

    return run


def _matrix(vectors: list[bytes], dims: int) -> np.ndarray:
    """Vectors as rows of dims integers: shorter ones padded with zeros, longer ones cut."""
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for k, v in enumerate(vectors):
        x = np.frombuffer(v, dtype="<i4")[:dims]
        out[k, : len(x)] = x
    return out


class Block:
    """The rows of one block, in the order of their ids, and an index that is made when the first query comes."""

    def __init__(self):
        self.ids: list[int] = []
        self.raw: list[bytes] = []
        self.index: BitSlicedIndex | None = None

    def best(self, query_id: int, query: bytes, k: int) -> tuple[list[int], list[int]]:
        """(ids, scores) of the k best rows that do not have the query's id."""
        if not self.ids:
            return [], []
        if self.index is None:
            rows = _matrix(self.raw, max(1, max(map(len, self.raw)) // 4))
            self.index, self.order, self.largest, self.raw = BitSlicedIndex(rows), np.array(self.ids), float(np.abs(rows).max()), []
        weights = _matrix([query], self.index.dims)[0]
        if self.largest * float(np.abs(weights).sum()) >= 2**62:
            raise ValueError("scores may not fit a long")
        at = self.index.top(weights.tolist(), k, np.arange(*np.searchsorted(self.order, [query_id, query_id + 1])))
        return self.order[at].tolist(), (self.index.rows[at] @ weights).tolist()


def _search(k: int):
    """Answers from a stream of (task, query, id, v) in the order of task and query: a block's rows, then its queries."""
    schema = pa.schema([("query_id", pa.int64()), ("query", pa.binary()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, Block()
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for task, is_query, i, v in zip(*(batch.column(c).to_pylist() for c in ("task", "query", "id", "v")), strict=True):
                if task != held:
                    held, block = task, Block()
                if not is_query:
                    block.ids.append(i)
                    block.raw.append(v)
                    continue
                ids, scores = block.best(i, v, k)
                for name, values in zip(out, ([i] * len(ids), [v] * len(ids), ids, scores), strict=True):
                    out[name] += values
            yield to_batch(out, schema)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors (id, v) with the largest quantised inner products with each row of
    queries (id, v) but those with its id."""
    rows = materialize(vectors.mapInArrow(tidy(_quantise(scale)), "id long, v binary"), "vectors")
    asked = materialize(queries.mapInArrow(tidy(_quantise(scale)), "id long, v binary").distinct(), "queries")
    held = rows.agg(F.count("*").alias("n"), F.max(F.octet_length("v")).alias("width")).first()
    per_block = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(8, 2 * (held["width"] or 0))))
    blocks = max(1, -(-held["n"] // per_block))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    shares = max(1, cores // blocks)  # of the queries: more than one only for small tables
    part = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Rows of one id or value, if they are many, still spread by the partition that read them.
    left = rows.select(F.lit(False).alias("query"), "id", "v", part(blocks, "id", "v", F.spark_partition_id()).alias("block")).withColumn("share", every(shares))
    right = asked.select(F.lit(True).alias("query"), "id", "v", part(shares, "id", "v").alias("share")).withColumn("block", every(blocks))
    both = left.unionByName(right).select((F.col("block") * shares + F.col("share")).alias("task"), "query", "id", "v")
    # A few tasks would often meet in one partition by their hash: they get more partitions than they fill.
    stream = both.repartition(max(blocks * shares, min(8 * blocks * shares, 8 * cores)), "task").sortWithinPartitions("task", "query", "id", "v")
    best = stream.mapInArrow(tidy(_search(k)), "query_id long, query binary, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_report(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k best of each row of embeddings (vec_id, embedding) whose id is divisible by every, against all rows."""
    v = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    return top_k(v, v.where(F.col("id") % every == 0), k)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, r.e), lambda z: z[1] * z[2])), 0)::BIGINT AS score FROM v q JOIN v r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM k WHERE rank <= 20
"""
