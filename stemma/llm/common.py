"""Shared helpers: the shared folder, cutting lineage, bounded broadcasts, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all is one process, as in tests, one is made
    here; on a cluster that would be a folder of the driver alone, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stemma-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/stemma/{name}-{uuid.uuid4().hex}"


#: Whether the shuffle files of a query go when it ends; else they stay until the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    Readers of the result do not recompute df, and a lost executor costs no more than its own tasks.
    """
    path = fresh_folder(df.sparkSession, name)
    before = df.sparkSession.conf.get(SHUFFLE_CLEANUP, "false")
    df.sparkSession.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        df.sparkSession.conf.set(SHUFFLE_CLEANUP, before)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.stemma_path = path
    for made in _RECORDED:
        made.append(path)
    return written


_RECORDED: list[list[str]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that materialize() writes meanwhile."""
    made: list[str] = []
    _RECORDED.append(made)
    try:
        yield made
    finally:
        _RECORDED[:] = [x for x in _RECORDED if x is not made]


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of materialize() that nothing will read again; others are left alone."""
    for df in tables:
        if path := getattr(df, "__dict__", {}).get("stemma_path"):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path in the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean_up(spark: SparkSession) -> None:
    """Delete every table that materialize() wrote; results that read them must have been used."""
    remove(spark, f"{shared_folder(spark)}/stemma")


def small_side(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """df (a written table) with a broadcast hint if it has at most max_rows rows, else df for an ordinary shuffled join."""
    return F.broadcast(df) if df.count() <= max_rows else df


def input_bytes(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Bytes of a table's files, as Hadoop's file system says."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def release() -> None:
    """Give freed memory back to the system: idle Python workers stay alive, and would keep it from the others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Tables that operators keep in a Python worker between tasks: owner -> function that drops them.
_KEPT: dict[str, Callable[[], None]] = {}


def keep(owner: str, drop: Callable[[], None]) -> None:
    """Say that this worker keeps tables of owner."""
    _KEPT[owner] = drop


def drop_others(owner: str | None) -> None:
    """Drop the tables that other operators left in this worker."""
    for name in [n for n in _KEPT if n != owner]:
        _KEPT.pop(name)()


def tidy(run: Callable, rows: int = 1000, owner: str | None = None) -> Callable:
    """A function for mapInArrow that works on slices of at most so many rows and releases memory at its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(owner)
        try:
            yield from run(b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows))
        finally:
            release()

    return tidied


def tidy_group(run: Callable) -> Callable:
    """A function for applyInArrow that releases memory at its end."""

    def one(table: pa.Table) -> pa.Table:
        drop_others(None)
        try:
            return run(table)
        finally:
            release()

    return one


def to_batch(columns: dict[str, Iterable], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch from lists or arrays by column name."""
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f in schema for x in (columns[f.name],)], schema=schema)
