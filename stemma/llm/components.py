"""Connected components of a link table, without collecting anything."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import discard, materialize, tidy, to_batch

#: Up to so many edges (16 MB) one task finishes the work; more of them go through rounds of stars first.
ONE_TASK = 1_000_000


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes in order, the smallest node that each reaches) of the links a, b."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        rx, ry = root[x], root[y]
        apart = rx != ry
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of one task as stars around the smallest node that they reach among themselves: at most one for each node."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held, n = [], 0

    def drawn_in() -> tuple[np.ndarray, np.ndarray]:
        nodes, least = least_reached(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return nodes[nodes != least], least[nodes != least]

    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        n += batch.num_rows
        if n >= ONE_TASK:
            a, b = drawn_in()
            held, n = [(a, b)], len(a)
            if n >= ONE_TASK // 2:  # they do not draw in any further
                yield to_batch({"a": a, "b": b}, schema)
                held, n = [], 0
    if held:
        a, b = drawn_in()
        yield to_batch({"a": a, "b": b}, schema)


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of all edges of one task."""
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    nodes, least = least_reached(*(np.concatenate([x[k] for x in held]) if held else np.empty(0, np.int64) for k in range(2)))
    yield to_batch({"node": nodes, "component": least}, pa.schema([("node", pa.int64()), ("component", pa.int64())]))


def _mark(edges: DataFrame) -> tuple:
    """A fingerprint of an edge set: rows, and the sums of two hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a").cast("long"))).first())


def components(links: DataFrame, one_task: int | None = None) -> DataFrame:
    """node, component (the smallest node it reaches) for each node of links (a long, b long), a written table. Nodes without links are not
    listed.

    Each task first draws its own links in to stars. Alternating large and small stars go on until they change nothing, or until one task
    can hold the edges (one_task). Each round writes its edges to the shared folder, so that the lineage stays one round long. Null ends
    and loops are dropped; repeated links count once; no links give no rows.
    """
    one_task = ONE_TASK if one_task is None else one_task
    edges = materialize(links.where("a <> b").select("a", "b").mapInArrow(tidy(_stars, rows=100_000), "a long, b long"), "edges")
    before = _mark(edges)
    while before[0] > one_task:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        large = materialize(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        done = edges, large
        edges = materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
        discard(*done)
        after = _mark(edges)
        if after == before:
            break
        before = after
    if before[0] <= one_task:
        named = edges.coalesce(1).mapInArrow(tidy(_names, rows=100_000), "node long, component long")
    else:
        stars = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
        named = stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
    named = materialize(named, "components")
    discard(edges)
    return named
