"""Running values over one long sequence, without a task that holds it (WIN-02..07).

A window over a key that holds most rows, or over no key at all, would run in one task. Here rows are dealt to range partitions of
their order, each partition computes its own running values, and leaves one carry row for each key that goes on in another partition.
Carries are combined in the order of the partitions and joined back: there are at most two for each partition.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.session import checkpointed

PART = "_part"
#: Rows of a range partition on average, at most: there are more partitions than the session asks for if rows are more.
ROWS = 250_000


class Kind(NamedTuple):
    """How a running value is made in a partition, summed up for it, combined over partitions, and joined with the carry. ahead: rows and
    partitions are gone through from the last to the first."""

    local: Callable[[Column], Column]
    summary: Callable[[Column, Column], Column]
    over: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]
    ahead: bool = False


def _either(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.coalesce(f(a, b), a, b)


KINDS = {
    "count": Kind(F.count, lambda v, o: F.count(v), F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))),
    "sum": Kind(F.sum, lambda v, o: F.sum(v), F.sum, _either(lambda a, b: a + b)),
    "max": Kind(F.max, lambda v, o: F.max(v), F.max, F.greatest),
    "xor": Kind(F.bit_xor, lambda v, o: F.bit_xor(v), F.bit_xor, _either(lambda a, b: a.bitwiseXOR(b))),
    "last": Kind(lambda v: F.last(v, True), lambda v, o: F.max_by(v, F.when(v.isNotNull(), o)), lambda v: F.last(v, True), F.coalesce),
    "next": Kind(lambda v: F.last(v, True), lambda v, o: F.min_by(v, F.when(v.isNotNull(), o)), lambda v: F.last(v, True), F.coalesce, True),
}


def dealt(df: DataFrame, keys: list[str], order: list[str], cut: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """df with a column _part: range partitions of (keys, order), ascending with nulls first. The result is written, so that every
    reader sees the same borders. Rows that are equal in all of keys and order may be many only if order ends in a column that tells them apart."""
    n = parts_for(df)
    return cut(df.repartitionByRange(n, *keys, *order).withColumn(PART, F.spark_partition_id().alias(PART, metadata={"parts": n})))


def parts_for(df: DataFrame) -> int:
    """How many partitions its rows need, at least as many as the session asks for."""
    return max(_asked(df), -(-df.count() // ROWS))


def parts_of(df: DataFrame) -> int:
    """How many partitions dealt() made; what the session asks for if _part is of another making."""
    return df.schema[PART].metadata.get("parts", _asked(df))


def spread(df: DataFrame, parts: int, *by: str) -> DataFrame:
    """df over so many partitions by a hash of columns, if they are more than the session asks for, so that a task's rows stay few."""
    return df.repartition(parts, *by) if parts > _asked(df) else df


def _asked(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]], few: bool = True, keep: bool = False) -> DataFrame:
    """df, a result of dealt() with the same keys and order, and for each name the running (kind, value): over the rows of the key up to
    this one, or from this one on for "next". count counts values that are not null; last and next are the nearest that are not null.

    df may have a _part of its own making, in which later rows of a key never have a smaller one; then few is False, as nothing bounds the
    carries, and they are joined by a shuffle. keep leaves _part in the result."""
    kinds = {name: KINDS[kind] for name, (kind, _) in values.items()}
    place = F.struct(*order)
    sums = df.groupBy(*keys, PART).agg(*[kinds[n].summary(v, place).alias(n) for n, (_, v) in values.items()])
    group = W.partitionBy(*(keys or [F.lit(0)]))
    earlier, later = (group.orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.asc(PART), F.desc(PART)))
    carries = sums.withColumn("_parts", F.count("*").over(group)).where("_parts > 1")
    carries = carries.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(PART).alias("_p"), *[kinds[n].over(F.col(n)).over(later if kinds[n].ahead else earlier).alias(f"_c_{n}") for n in values])
    same = F.col(PART) == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    own = W.partitionBy(*keys, PART)
    back, ahead = (own.orderBy(*o).rowsBetween(W.unboundedPreceding, W.currentRow) for o in (order, [F.desc(c) for c in order]))
    local = spread(df, parts_of(df), PART).select("*", *[kinds[n].local(v).over(ahead if kinds[n].ahead else back).alias(f"_l_{n}") for n, (_, v) in values.items()])
    joined = local.join(F.broadcast(carries) if few else carries, same, "left")  # few: at most two rows for each range partition
    return joined.select(*[c for c in df.columns if keep or c != PART], *[kinds[n].join(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n in values])


def interpolated(df: DataFrame, number: str, keys: list[str], order: list[str]) -> DataFrame:
    """WIN-05 for long sequences: df with line_number: numbers as they are, whole steps between two known ones, counted back from the
    first one (not below 1) and on from the last one; places where none is known."""
    # Places are in the order of the rows, so the partitions serve them as well.
    placed = checkpointed(running(dealt(df, keys, order), keys, order, {"_k": ("count", F.lit(1))}, keep=True))
    known = F.when(F.col(number).isNotNull(), F.struct(F.col("_k").alias("k"), F.col(number).cast("long").alias("n")))
    both = running(placed, keys, ["_k"], {"_b": ("last", known), "_a": ("next", known)})
    k, b, a = F.col("_k"), F.col("_b"), F.col("_a")
    step = F.expr("(_a.n - _b.n) * (_k - _b.k) div nullif(_a.k - _b.k, 0)")
    line = F.when(F.col(number).isNotNull(), F.col(number)).when(b.isNull() & a.isNull(), k).when(b.isNull(), F.greatest(F.lit(1), a["n"] - (a["k"] - k))).when(a.isNull(), b["n"] + (k - b["k"])).otherwise(b["n"] + step)
    return both.withColumn("line_number", line.cast("int")).drop("_k", "_b", "_a")
