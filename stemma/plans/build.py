"""The build: loaded tables -> line mappings -> citation matches -> search indexes, in strict order, each step written whole."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from stemma.operators.align import align_editions
from stemma.operators.citations import propagate_once, reference_matches, resolve_all
from stemma.operators.fts import build_index
from stemma.plans.schemas import TABLES
from stemma.sources.writers import log_phase


class Build:
    """Tables under one folder; steps read what earlier steps wrote and overwrite their own output, so reruns change nothing."""

    STEPS = ("mappings", "citations", "ref_citations", "fts")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _cut(self, df: DataFrame) -> DataFrame:
        self._n = getattr(self, "_n", 0) + 1
        return self.write(f"_tmp/{self._n}", df)

    def mappings(self) -> DataFrame:
        return self.write("line_mappings", align_editions(self.table("text_lines"), self.table("works"), self.table("editions")))

    def citations(self) -> DataFrame:
        matches = resolve_all(self.table("lexicon_citations"), self.table("text_lines"), self.table("editions"), self.table("line_mappings"), cut=self._cut)
        return self.write("citation_matches", matches)

    def ref_citations(self) -> DataFrame:
        """RES-15: nearest lines, then one step forward and one back along the mappings."""
        from pyspark.sql import functions as F

        lines = self.table("text_lines")
        m = self._cut(reference_matches(self.table("reference_citations"), lines))
        text = lines.select(F.col("id").alias("line_id"), "content")
        for a, b in (("a", "b"), ("b", "a")):
            m = self._cut(m.unionByName(propagate_once(m, self.table("line_mappings"), text, a, b)))
        return self.write("reference_citation_matches", m)

    def fts(self) -> DataFrame:
        for name, table, fields in (("text_fts", "text_lines", ["content", "char_name"]), ("lexicon_fts", "lexicon_entries", ["key", "full_text"]), ("reference_fts", "reference_entries", ["headword", "raw_text"])):
            index = build_index(self.table(table), "id", fields)
            self.write(name, index.postings)
            self.write(f"{name}_docs", index.docs)
        return self.spark.read.parquet(f"{self.root}/text_fts")

    def run(self, only: str | None = None, exclude: tuple[str, ...] = ()) -> None:
        for step in self.STEPS:
            if step in exclude or only and step != only:
                continue
            began = time.time()
            n = getattr(self, step)().count()
            log_phase(self.spark, f"{self.root}/import_log", step, n, time.time() - began)
