"""Small inputs and derived lines (SRC-13, SRC-18, SRC-27..30, SRC-32, OTH-03..06)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_map(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """SRC-27: a JSON object of strings as rows."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """SRC-27: arrays of correction records in many files, as one table."""
    schema = "headword string, raw_bibl string, work_id long, edition string, act int, scene int, line_number int, confidence double, reason string, notes string"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def passage_lines(passages: DataFrame) -> DataFrame:
    """SRC-28: lines of standalone passages. passages: edition, work_id, lines array<struct<act, scene, line_number, content, content_type>>."""
    flat = passages.select("edition", "work_id", F.posexplode("lines").alias("pos", "l")).select("edition", "work_id", "pos", "l.*")
    return flat.withColumn("content_type", F.coalesce("content_type", F.lit("verse")))


def external_lines(citations: DataFrame, references: DataFrame, works: DataFrame) -> DataFrame:
    """SRC-29: a stub line for each place of an external work that is cited: the first citation of a place gives its text, lexicon before
    references; edition 0, line 1 where none is given, act and scene 0 as null. works: id of the external works."""
    take = lambda df, rank: df.select("work_id", "act", "scene", F.coalesce("line", F.lit(1)).alias("line_number"), F.concat(F.lit("["), F.coalesce("raw_bibl", F.lit("")), F.lit("] "), F.col("headword")).alias("content"), F.struct(F.lit(rank).alias("r"), F.col("id").alias("id")).alias("order"))
    both = take(citations, 0).unionByName(take(references, 1)).join(works.select(F.col("id").alias("work_id")), "work_id", "left_semi")
    z = lambda c: F.nullif(F.col(c), F.lit(0)).alias(c)
    placed = both.select("work_id", z("act"), z("scene"), "line_number", "content", "order")
    first = placed.groupBy("work_id", "act", "scene", "line_number").agg(F.min_by("content", "order").alias("content"))
    return first.withColumn("edition_id", F.lit(0).cast("long"))


def external_works(spark: SparkSession, prefixes: DataFrame) -> DataFrame:
    """SRC-30: one work for each title. prefixes: prefix, title."""
    return prefixes.groupBy("title").agg(F.min("prefix").alias("prefix"))


def missing_files(manifest: DataFrame, present: DataFrame, key: str = "name") -> DataFrame:
    """SRC-32: what a manifest lists and is not there."""
    return manifest.join(present.select(key).distinct(), key, "left_anti")


def with_folger_urls(works: DataFrame, slugs: DataFrame, base: str) -> DataFrame:
    """SRC-13: works with the URL of their slug. slugs: work_id, slug."""
    s = slugs.select(F.col("work_id").alias("id"), "slug")
    return works.join(s, "id", "left").withColumn("folger_url", F.concat(F.lit(base), "slug")).drop("slug")


def play_level_numbers(lines: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-18: (lines with work_id and a line number that runs over the whole play, titles that no work has). lines: title, pos, ...; titles:
    title, work_id."""
    joined = lines.join(titles, "title", "left")
    numbered = joined.where("work_id IS NOT NULL").withColumn("line_number", F.row_number().over(W.partitionBy("title").orderBy("pos")))
    return numbered, joined.where("work_id IS NULL").select("title").distinct()


def attributions(rules: DataFrame, sources: DataFrame) -> DataFrame:
    """OTH-03: attribution rules with their source's id; unknown sources are skipped, the last rule of a source replaces earlier ones. rules:
    seq, short_code, ...; sources: id, short_code."""
    known = rules.join(sources.select(F.col("id").alias("source_id"), "short_code"), "short_code")
    return known.withColumn("_rn", F.row_number().over(W.partitionBy("source_id").orderBy(F.col("seq").desc()))).where("_rn = 1").drop("_rn")


def optional(column: str):
    """OTH-04: empty strings as null."""
    return F.nullif(F.col(column), F.lit(""))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """OTH-05: the lines that have a number."""
    return lines.where("line_number IS NOT NULL")


def licensed(lines: DataFrame, editions: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """FLT-18: lines of editions that are not non-commercial (an unknown tier is kept) and whose source is not excluded."""
    ok = editions.where("license_tier <> 'non-commercial' OR license_tier IS NULL")
    ok = ok.where(~F.coalesce(F.col("source_key").isin(exclude), F.lit(False))) if exclude else ok
    return lines.join(ok.select(F.col("id").alias("edition_id")), "edition_id", "left_semi")
