"""Tables whose changes are whole or not at all (SNK-01..05).

A table is a folder: data files by ranges of the key's first column, a list of files for each version, and a commit for each. A
change finds the files whose ranges hold its keys, deals what they become to new files, lists old and new ones, and commits: it creates the
next commit file, which only one writer can, and writes the list's name into it. Readers take the last whole commit, so a writer that
is killed before leaves nothing that they see, and files that it leaves are not in any list. Files that a change does not touch are kept.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stemma.operators import scan
from stemma.operators.scan import dealt, running, spread
from stemma.session import checkpointed


class Conflict(Exception):
    """Another writer has committed since this change began."""


class VersionedTable:
    """A table at a path, with the columns that name a row. Nulls in them equal each other and come first."""

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), key, 1
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- versions

    def _commits(self) -> list[int]:
        folder = self._path(f"{self.path}/commits")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit()) if self._fs.exists(folder) else []

    def _list_of(self, version: int) -> str | None:
        stream = self._fs.open(self._path(f"{self.path}/commits/{version:010d}"))
        try:
            said = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return said.strip() if said.endswith("\n") else None  # a commit that was cut off is none

    def version(self) -> int:
        """The last whole commit, 0 if there is none."""
        return next((v for v in reversed(self._commits()) if self._list_of(v)), 0)

    def files(self, version: int | None = None) -> DataFrame:
        """file, low, high, n of a version."""
        version = self.version() if version is None else version
        return self.spark.read.schema("file string, low string, high string, n long").json(f"{self.path}/lists/{self._list_of(version)}")

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schema", wholetext=True).first()[0]))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        names = [f"{self.path}/data/{r['file']}" for r in self.files(version).select("file").collect()]  # a row for each file
        return self.spark.read.schema(self.schema()).parquet(*names) if names else self.spark.createDataFrame([], self.schema())

    def _commit(self, listed: DataFrame, after: int) -> int:
        name = uuid.uuid4().hex
        listed.coalesce(1).write.json(f"{self.path}/lists/{name}")
        number = max([after, *self._commits()]) + 1
        if self.version() != after:
            raise Conflict(self.path)
        stream = self._fs.create(self._path(f"{self.path}/commits/{number:010d}"), False)  # fails if it is there
        try:
            stream.write(bytearray(f"{name}\n".encode()))
        finally:
            stream.close()
        return number

    # ---- writing

    def _listed(self, folder: str) -> DataFrame:
        """file, low, high, n of the data files of a new folder."""
        key = F.col(self.key[0])
        made = self.spark.read.option("recursiveFileLookup", True).schema(self.schema()).parquet(f"{self.path}/data/{folder}")
        # Least and greatest of the key itself: without strings for each row, rows are not sorted for this.
        each = made.select(key.alias("k"), F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("n"), F.count("k").alias("known"))
        low = F.when(F.col("known") == F.col("n"), F.col("low")).cast("string")  # nulls come first
        return each.select(F.regexp_extract("file", f"({folder}/.*)$", 1).alias("file"), low.alias("low"), F.col("high").cast("string").alias("high"), "n")

    def create(self, rows: DataFrame, files: int = 8) -> int:
        """The first version, or one that replaces all rows, in so many ranges, or more if rows are many."""
        after = self.version()
        if not after:
            self.spark.createDataFrame([(rows.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/schema")
        folder = uuid.uuid4().hex
        rows.repartitionByRange(max(files, self._parts(rows.count())), self.key[0]).sortWithinPartitions(*self.key).write.parquet(f"{self.path}/data/{folder}")
        return self._commit(self._listed(folder), after)

    def _parts(self, n: int) -> int:
        """Over how many files or tasks so many rows go."""
        return max(1, -(-n // scan.ROWS))

    def _runs(self, listed: DataFrame, touched: set[str]) -> dict[str, int]:
        """For each touched file the number of its run: files that follow each other in the key's order, with none between that stays."""
        kind = self.schema()[self.key[0]].dataType
        runs, run, stays = {}, -1, True
        for r in listed.select("file").orderBy(F.col("low").cast(kind)).collect():  # files at most
            if r["file"] in touched:
                run += stays
                runs[r["file"]] = run
            stays = r["file"] not in touched
        return runs

    def _placed(self, listed: DataFrame, keys: DataFrame) -> DataFrame:
        """k, at: for each first key the file that it belongs to: the last that begins at or before it, or the first of all. Ranges do not
        overlap, as a file's rows stay in one file."""
        kind = self.schema()[self.key[0]].dataType
        bounds = listed.select(F.col("low").cast(kind).alias("k"), F.lit(0).alias("what"), "file")
        asked = keys.select(F.col(self.key[0]).cast(kind).alias("k"), F.lit(1).alias("what"), F.lit(None).cast("string").alias("file")).distinct()
        order = ["k", "what"]
        values = {"before": ("last", F.col("file")), "after": ("next", F.col("file"))}
        at = running(dealt(bounds.unionByName(asked), [], order), [], order, values).where("what = 1")
        return checkpointed(at.select("k", F.coalesce("before", "after", F.lit("new")).alias("at")))

    def _change(self, keys: DataFrame, new: DataFrame | None, become: Callable[[DataFrame, DataFrame | None], DataFrame]) -> int:
        """A version in which the rows of all files that keys belong to are what become makes of them and of new, both with their _run.
        Each run of files is dealt anew by ranges, so files and tasks follow the rows and ranges do not overlap with those of files that stay."""
        after = self.version()
        listed = self.files(after)
        placed = self._placed(listed, keys)
        names = {r["at"] for r in placed.select("at").distinct().collect()}  # files at most
        if not names:
            return after
        runs = self._runs(listed, names) or {"new": 0}
        schema = self.schema()
        there = [n for n in runs if n != "new"]
        several = self.spark.createDataFrame(list(runs.items()), "_file string, _run int") if len(set(runs.values())) > 1 else None
        old = self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{n}" for n in there]) if there else self.spark.createDataFrame([], schema)
        total = old.count() + (new.count() if new is not None else 0)
        self.parts = self._parts(total)
        if several is None:
            old, new = (None if df is None else df.select(*schema.names, F.lit(0).alias("_run")) for df in (old, new))
        else:
            old = old.withColumn("_file", F.regexp_extract(F.col("_metadata.file_path"), r"/data/(.*)$", 1)).join(F.broadcast(several), "_file").select(*schema.names, "_run")  # a row for each file
            if new is not None:
                at = placed.join(F.broadcast(several), F.col("at") == F.col("_file")).select(F.col("k").alias("_at"), "_run")
                key = F.col(self.key[0]).cast(schema[self.key[0]].dataType)
                new = self._met(new, key, at, F.col("_at"), key.eqNullSafe(F.col("_at")), "inner").select(*schema.names, "_run")
        folder = uuid.uuid4().hex
        rows = become(old, new)
        rows.repartitionByRange(self.parts, "_run", self.key[0]).sortWithinPartitions("_run", *self.key).write.partitionBy("_run").parquet(f"{self.path}/data/{folder}")
        return self._commit(listed.where(~F.col("file").isin(there)).unionByName(self._listed(folder)), after)

    def _met(self, a: DataFrame, by_a: Column, b: DataFrame, by_b: Column, on: Column, how: str) -> DataFrame:
        """a joined with b, over more tasks if a change has many rows."""
        h = lambda df, by, name: spread(df.withColumn(name, F.xxhash64(by)), self.parts, name)
        return h(a, by_a, "_ha").join(h(b, by_b, "_hb"), (F.col("_ha") == F.col("_hb")) & on, how).drop("_ha", "_hb")

    def _joined(self, a: DataFrame, b: DataFrame, how: str, columns: list[str] | None = None) -> DataFrame:
        """a joined with b, whose columns of the key, or others, are named by _named()."""
        kinds = {k: self.schema()[k].dataType for k in columns or self.key}  # equal values hash alike in one type only
        of = lambda mark: F.struct(*[F.col(f"{mark}{k}").cast(kind).alias(k) for k, kind in kinds.items()])
        return self._met(a, of(""), b, of("_"), self._same(a, b, columns), how)

    def _same(self, a: DataFrame, b: DataFrame, columns: list[str] | None = None) -> Column:
        out = F.lit(True)
        for k in columns or self.key:
            out = out & a[k].eqNullSafe(b[f"_{k}"])
        return out

    def _named(self, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """The key, or other columns, under names of their own."""
        return df.select(*[F.col(k).alias(f"_{k}") for k in columns or self.key])

    def _one(self, rows: DataFrame, order: Column, pick: Callable[[Column, Column], Column]) -> DataFrame:
        """A row for each key."""
        r = rows.groupBy(*self.key).agg(pick(F.struct(*rows.columns), order).alias("_r"))
        return checkpointed(r.select(*[F.col("_r")[c].alias(c) for c in self.schema().names]))

    def replace(self, rows: DataFrame, order: Column) -> int:
        """SNK-03: rows take the place of those of their key, others are added; of several under one key the last in order."""
        new = self._one(rows, order, F.max_by)
        gone = self._named(new)
        return self._change(new, new, lambda old, add: self._joined(old, gone, "left_anti").unionByName(add))

    def ignore(self, rows: DataFrame, order: Column) -> int:
        """SNK-02: rows are added whose key there is not yet; of several under one key the first in order."""
        new = self._one(rows, order, F.min_by)

        def become(old: DataFrame, add: DataFrame) -> DataFrame:
            there = self._named(old)
            return old.unionByName(self._joined(add, there, "left_anti"))

        return self._change(new, new, become)

    def update(self, changes: DataFrame) -> int:
        """SNK-05: rows get the values of changes (the key, once each, and some columns) where those are not null."""
        names = [c for c in changes.columns if c not in self.key]
        new = changes.select(*[F.col(c).alias(f"_{c}") for c in (*self.key, *names)])

        def become(old: DataFrame, _: DataFrame | None) -> DataFrame:
            joined = self._joined(old, new, "left")
            return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in old.columns])

        return self._change(changes, None, become)

    def swap(self, gone: DataFrame, columns: list[str], rows: DataFrame) -> int:
        """SNK-01: all rows that agree with a row of gone in columns, of which the key's first is one, go, and rows are added: an import
        that is run again changes nothing."""
        new = rows.select(*self.schema().names)
        named = self._named(gone, columns).distinct()
        reach = gone.select(self.key[0]).unionByName(new.select(self.key[0]))
        return self._change(reach, new, lambda old, add: self._joined(old, named, "left_anti", columns).unionByName(add))

    def append(self, rows: DataFrame) -> int:
        """SNK-04: rows are added as they are, whatever is there."""
        new = rows.select(*self.schema().names)
        return self._change(new, new, lambda old, add: old.unionByName(add))
