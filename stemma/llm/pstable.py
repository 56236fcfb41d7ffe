"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors get one more component that makes their norms equal, so that the largest inner product is the least distance. A table's hash is
CELLS functions floor((a . x + b) / width) with normal a; rows lie in the cell of their values. A query visits cells in the order of
the probability that a neighbour at distance r lies there, which is a product over the functions, as a . (x - q) is normal with deviation
r; it stops when the cells visited hold so much probability that, over all tables, a neighbour at r is found with probability
RECALL. r is the distance of the query's k-th best in a first, short search of one table, so it bounds the true one. Candidates of all
tables are merged and ranked by their exact products.

The width comes from a bounded sample (SAMPLE rows, by hash of id and vector), the number of functions from the number of rows, so that a
cell holds CELL_ROWS rows on average. Cells are dealt to groups by their name; a query goes to a group once, with its cells there. Groups
over PIECE rows are cut in pieces, each of which the query meets, so a cell of any size is spread. Each piece gives a query at most k rows,
none worse than the k-th that it knows from the first search. Equal vectors are one row with their k + 1 least ids: more of them are never among the k nearest of any query.

Defined cases: vectors that are null, empty, zero, or hold a null or a non-finite component take no part, nor do rows with a null id;
shorter vectors count as padded with zeros; rows that share an id are one candidate, at its best; equal query rows are answered once;
rows with the query's id are its own; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.llm.common import discard, materialize, small_side, tidy, to_batch

#: Tables, probability of finding a neighbour at the bounding distance, and in the first search.
TABLES, RECALL, FIRST = 2, 0.93, 0.35
#: Rows of a cell on average, rows of a piece of a group, rows from which the width is taken.
CELL_ROWS, PIECE, SAMPLE = 128, 8192, 1024
SEED = 20


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, by Abramowitz and Stegun 7.1.26 (error under 2e-7)."""
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x) / 2
    return np.where(z >= 0, 1 - tail, tail)


@dataclass(frozen=True)
class Hashes:
    """Hash functions of all tables: positions in cells, names of cells, and cells to visit."""

    dims: int
    norm: float
    width: float
    functions: int
    tables: int

    def _drawn(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng(SEED)
        a = rng.standard_normal((self.dims + 1, self.tables * self.functions))
        return a, rng.random(self.tables * self.functions), rng.integers(1, 2**63, self.tables * self.functions, dtype=np.uint64) | np.uint64(1)

    def positions(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(row, table, function): places in units of the width. Rows are lifted to the common norm, queries scaled to it."""
        own = np.sqrt((x * x).sum(axis=1))
        if query:
            lifted = np.c_[x * (self.norm / own)[:, None], np.zeros(len(x))]
        else:
            lifted = np.c_[x, np.sqrt(np.maximum(self.norm**2 - own**2, 0))]
        a, b, _ = self._drawn()
        return (lifted @ a / self.width + b).reshape(len(x), self.tables, self.functions)

    def names(self, cells: np.ndarray) -> np.ndarray:
        """A 64-bit name of each cell (row, table, function)."""
        mix = self._drawn()[2].reshape(self.tables, self.functions)
        return self._final((cells.astype(np.int64).astype(np.uint64) * mix).sum(axis=-1, dtype=np.uint64)).astype(np.int64)

    @staticmethod
    def _final(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    def visits(self, places: np.ndarray, distance: np.ndarray, mass: float, tables: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(query, table, names of cells) for each query's places: the likeliest cells for a neighbour at distance, until they hold mass."""
        mix = self._drawn()[2].reshape(self.tables, self.functions)
        r = np.maximum(distance / self.width, 1e-9)
        for q in range(len(places)):
            reach = max(1, math.ceil(4 * r[q]))
            edges = np.arange(-reach, reach + 2)
            for t in range(tables):
                home = np.floor(places[q, t])
                within = places[q, t] - home
                p = np.diff(normal_cdf((edges[None, :] - within[:, None]) / r[q]), axis=1)  # (function, shift)
                names = (home[:, None] + edges[None, :-1]).astype(np.int64).astype(np.uint64) * mix[t][:, None]
                yield q, t, self._final(likeliest(p, names, mass)).astype(np.int64)


def likeliest(p: np.ndarray, names: np.ndarray, mass: float) -> np.ndarray:
    """The sums of names, one of each row, of the largest products of p that reach mass, largest first. Products under a floor are left
    out as they form; the floor falls until enough is held."""
    best_after = np.r_[np.cumprod(p.max(axis=1)[::-1])[::-1][1:], 1.0]
    most = float(p.max(axis=1).prod())
    floor = most / 4
    while True:
        held, sums = np.ones(1), np.zeros(1, dtype=np.uint64)
        for row, own, rest in zip(p, names, best_after, strict=True):
            product = np.multiply.outer(held, row)
            keep = product * rest >= floor
            held, sums = product[keep], np.add.outer(sums, own)[keep]
        if held.sum() >= mass or floor < most * 1e-12:
            order = np.argsort(-held, kind="stable")
            n = int(np.searchsorted(np.cumsum(held[order]), mass)) + 1
            return sums[order[:n]]
        floor /= 4


# ---- rows and queries


def _vectors(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, v (its components as bytes), norm of the vectors that take part."""
        for b in batches:
            ids, out, norms = [], [], []
            for i, v in zip(b.column("id").to_pylist(), b.column("v"), strict=True):
                if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = np.asarray(v.values.to_numpy(zero_copy_only=False))
                x = x if x.dtype == np.float32 else x.astype(np.float64)
                wide = x.astype(np.float64)
                if np.isfinite(wide).all() and wide.any():
                    ids.append(i)
                    out.append(x.tobytes())
                    norms.append(math.sqrt(float(wide @ wide)))
            yield to_batch({"id": ids, "v": out, "norm": norms}, schema)

    return run


def as_matrix(vectors: list[bytes], dims: int, kind: str) -> np.ndarray:
    """Vectors as rows of dims doubles, shorter ones padded with zeros."""
    step = np.dtype(kind).itemsize
    if all(len(v) == dims * step for v in vectors):
        return np.frombuffer(b"".join(vectors), dtype=kind).reshape(-1, dims).astype(np.float64)
    out = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        x = np.frombuffer(v, dtype=kind)
        out[k, : len(x)] = x
    return out


def together(ids: list[list[int]], vectors: list[bytes], most: int) -> tuple[list[list[int]], list[bytes]]:
    """Equal vectors as one, with their least ids."""
    held: dict[bytes, list[int]] = {}
    for i, v in zip(ids, vectors, strict=True):
        held.setdefault(v, []).extend(i)
    return [sorted(set(x))[:most] for x in held.values()], list(held)


def groups(names: np.ndarray, n: int) -> np.ndarray:
    """The group of each cell."""
    return ((names.astype(np.uint64) >> np.uint64(7)) % np.uint64(n)).astype(np.int64)


ROWS = "group long, cell long, ids array<long>, v binary"
VISITS = "group long, query_id long, tag long, v binary, near double, cells array<long>"


def _rows(h: Hashes, kind: str, k: int, tables: int, n: int) -> Callable:
    schema = pa.schema([("group", pa.int64()), ("cell", pa.int64()), ("ids", pa.list_(pa.int64())), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, vectors = together([[i] for i in b.column("id").to_pylist()], b.column("v").to_pylist(), k + 1)
            cells = h.names(np.floor(h.positions(as_matrix(vectors, h.dims, kind), False)))
            for t in range(tables):
                yield to_batch({"group": groups(cells[:, t], n).tolist(), "cell": cells[:, t].tolist(), "ids": ids, "v": vectors}, schema)

    return run


def _visits(h: Hashes, kind: str, mass: float, tables: int, n: int, unknown: float) -> Callable:
    schema = pa.schema([("group", pa.int64()), ("query_id", pa.int64()), ("tag", pa.int64()), ("v", pa.binary()), ("near", pa.float64()), ("cells", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, tags, vectors = (b.column(c).to_pylist() for c in ("id", "tag", "v"))
            x = as_matrix(vectors, h.dims, kind)
            known = b.column("near").to_pylist()  # the k-th best product found
            near = np.array([math.nan if s is None else s for s in known])
            own = np.sqrt((x * x).sum(axis=1))
            far = np.where(np.isnan(near), unknown, np.sqrt(np.maximum(2 * h.norm**2 - 2 * h.norm * near / own, 0)))
            out: list[tuple] = []
            for q, found in itertools.groupby(h.visits(h.positions(x, True), far, mass, tables), key=lambda o: o[0]):
                cells = np.unique(np.concatenate([c for _, _, c in found]))
                where = groups(cells, n)
                order = np.argsort(where, kind="stable")
                each, starts = np.unique(where[order], return_index=True)
                out += [(g, ids[q], tags[q], vectors[q], known[q], c) for g, c in zip(each.tolist(), np.split(cells[order], starts[1:]), strict=True)]
            yield to_batch({f.name: [o[j] for o in out] for j, f in enumerate(schema)}, schema)

    return run


def exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, pair by pair, summed from the first component to the last."""
    out = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        out += queries[:, d] * rows[:, d]
    return out


class Held:
    """The rows of one piece, by cell."""

    def __init__(self, dims: int, kind: str, k: int):
        self.dims, self.kind, self.k = dims, kind, k
        self.raw: dict[int, tuple[list, list]] = {}
        self.cells: dict[int, tuple[list[list[int]], np.ndarray]] | None = None

    def add(self, cell: int, ids: list[int], v: bytes) -> None:
        own = self.raw.setdefault(cell, ([], []))
        own[0].append(ids)
        own[1].append(v)

    def answer(self, ids: list[int], x: np.ndarray, near: np.ndarray, cells: list[list[int]]) -> Iterator[tuple[int, int, float]]:
        """(place of the query, id, product): the k best of each query in its cells here, of those that reach near."""
        if self.cells is None:
            self.cells = {}
            for cell, (held, vectors) in self.raw.items():
                held, vectors = together(held, vectors, self.k + 1)
                self.cells[cell] = held, as_matrix(vectors, self.dims, self.kind)
            self.raw = {}
        asked: dict[int, list[int]] = {}
        for q, own in enumerate(cells):
            for c in own:
                if c in self.cells:
                    asked.setdefault(c, []).append(q)
        # The k + 1 best products of each query so far (one may be its own): what is below the least of them is not looked at.
        best = np.full((len(ids), self.k + 1), -np.inf)
        found: list[list[tuple[float, list[int]]]] = [[] for _ in ids]
        slack = 1e-9 * (1 + float(np.abs(x).max(initial=0)) * max((float(np.abs(r).max(initial=0)) for _, r in self.cells.values()), default=0.0) * self.dims)
        for c, who in asked.items():
            held, rows = self.cells[c]
            s = x[who] @ rows.T
            best[who] = np.partition(np.c_[best[who], s], s.shape[1], axis=1)[:, -(self.k + 1) :]
            a, b = np.nonzero(s >= np.maximum(best[who].min(axis=1), near[who])[:, None] - slack)
            for q, r, score in zip(a.tolist(), b.tolist(), exact(x[who][a], rows[b]).tolist(), strict=True):
                if score >= near[who[q]]:
                    found[who[q]].append((-score, held[r]))
        for q, own in enumerate(found):
            every = {(score, i) for score, held in own for i in held if i != ids[q]}
            for score, i in heapq.nsmallest(self.k, every):
                yield q, i, -score


def _answers(dims: int, kind: str, k: int) -> Callable:
    schema = pa.schema([("query_id", pa.int64()), ("tag", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From a stream of pieces in order, the rows of each before its queries."""
        at, held = None, Held(dims, kind, k)
        for b in batches:
            queries: list[tuple] = []

            def flush() -> pa.RecordBatch:
                near = np.array([-math.inf if q[3] is None else q[3] for q in queries])  # noqa: B023
                found = list(held.answer([q[0] for q in queries], as_matrix([q[2] for q in queries], dims, kind), near, [q[4] for q in queries])) if queries else []  # noqa: B023
                out = [(queries[q][0], queries[q][1], i, s) for q, i, s in found]  # noqa: B023
                queries.clear()  # noqa: B023
                return to_batch({f.name: [o[j] for o in out] for j, f in enumerate(schema)}, schema)

            for row in b.to_pylist():
                if (row["group"], row["piece"]) != at:
                    if queries:
                        yield flush()
                    at, held = (row["group"], row["piece"]), Held(dims, kind, k)
                if row["is_query"]:
                    queries.append((row["query_id"], row["tag"], row["v"], row["near"], row["cells"]))
                else:
                    held.add(row["cell"], row["ids"], row["v"])
            yield flush()

    return run


def _search(rows: DataFrame, asked: DataFrame, h: Hashes, kind: str, k: int, mass: float, tables: int, unknown: float) -> DataFrame:
    """query_id, tag, vec_id, score: for each query the k best of each piece that it visits. asked: id, tag, v, near (a product that k
    rows reach; null: the k-th is taken to be at distance unknown)."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n = max(2 * cores, -(-tables * rows.count() // PIECE))
    placed = rows.select("id", "v").mapInArrow(tidy(_rows(h, kind, k, tables, n), 10_000), ROWS)
    sizes = placed.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > 2 * PIECE)
    large = small_side(materialize(sizes.select("group", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces")), "large"))
    pieces = F.coalesce("pieces", F.lit(1))
    left = placed.join(large, "group", "left").withColumn("near", F.lit(None).cast("double")).withColumn("piece", F.pmod(F.xxhash64("v"), pieces).cast("int")).drop("pieces")
    visits = asked.mapInArrow(tidy(_visits(h, kind, mass, tables, n, unknown), 256), VISITS)
    right = visits.join(large, "group", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("pieces")
    stream = left.unionByName(right, allowMissingColumns=True).withColumn("is_query", F.col("query_id").isNotNull())
    # Groups would often meet in one partition by their hash: they get more partitions than they fill.
    stream = stream.repartition(min(4 * n, n + 8 * cores), "group", "piece").sortWithinPartitions("group", "piece", "is_query")
    return stream.mapInArrow(tidy(_answers(h.dims, kind, k), 1024), "query_id long, tag long, vec_id long, score double")


def fit(rows: DataFrame, kind: str) -> Hashes | None:
    """Hash functions for rows (id, v, norm), None if there are none: their norm and length from all rows, the width from a sample."""
    held = rows.agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.max(F.octet_length("v")).alias("bytes")).first()
    if not held["n"]:
        return None
    dims = held["bytes"] // np.dtype(kind).itemsize
    sample = as_matrix([r["v"] for r in rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").collect()], dims, kind)
    one = Hashes(dims, held["norm"], 1.0, 32, 1).positions(sample, False)[:, 0]
    spread = float(one.std(axis=0).mean()) or held["norm"]
    functions = max(1, round(math.log2(max(2, held["n"] / CELL_ROWS)) / 2))  # cells of one deviation: about two bits each
    return Hashes(dims, held["norm"], spread, functions, TABLES)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (id, v) the rows of vectors (id, v) found nearest by inner product."""
    kind = "<f4" if dict(vectors.dtypes)["v"] == "array<float>" and dict(queries.dtypes)["v"] == "array<float>" else "<f8"
    wide = "array<float>" if kind == "<f4" else "array<double>"
    schema = pa.schema([("id", pa.int64()), ("v", pa.binary()), ("norm", pa.float64())])
    clean = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("v").cast(wide).alias("v")).mapInArrow(tidy(_vectors(schema)), "id long, v binary, norm double")
    rows = materialize(clean(vectors), "vectors")
    asked = materialize(clean(queries).select("id", "v").distinct().withColumn("tag", F.xxhash64("v")), "queries")
    out = "query_id long, rank int, vec_id long, score double"
    h = fit(rows, kind)
    if h is None:
        return rows.sparkSession.createDataFrame([], out)
    h = Hashes(max(h.dims, (asked.agg(F.max(F.octet_length("v"))).first()[0] or 0) // np.dtype(kind).itemsize), h.norm, h.width, h.functions, h.tables)
    # The first search takes the width for a distance: only the order of the cells depends on it.
    start = asked.withColumn("near", F.lit(None).cast("double"))
    first = materialize(_search(rows, start, h, kind, k, FIRST, 1, h.width), "first")
    last = first.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "tag").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("_n") == k).select(F.col("query_id").alias("id"), "tag", F.col("score").alias("near"))
    again = materialize(asked.join(last, ["id", "tag"], "left").select("id", "tag", "v", "near"), "asked")
    discard(asked)
    found = first.unionByName(_search(rows, again, h, kind, k, 1 - (1 - recall) ** (1 / h.tables), h.tables, 2 * h.norm))
    best = found.groupBy("query_id", "tag", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id", "tag").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbour_report(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest found of each row of embeddings (vec_id, embedding) whose id is divisible by every, among all other rows."""
    v = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    return nearest(v, v.where(F.col("id") % every == 0), k)
