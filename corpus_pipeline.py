"""Corpus preparation in five stages, each over all that the one before kept.

Each stage's result is to be written before the next stage is called, as run() does: a stage first deletes the tables that the one
before it needed until it was written.

Defined cases, for all stages: an empty table gives no rows; columns of any name are kept by all stages but the last, whatever
names the stages use themselves; a column lang, source or n_chars may be null anywhere; equal rows are rows each. Null, empty and
very long texts and null ids are said for each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stemma.llm import dedup_units, jaccard, packing, quality, secrets
from stemma.llm.common import fresh_folder, recorded, remove
from stemma.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_tables: list[str] = []


def stage(work: Stage) -> Stage:
    """A stage that deletes the tables of the stage before it, and notes its own."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _tables:
            remove(spark, _tables.pop())
        with recorded() as made:
            out = work(spark, docs, sf_dir)
        _tables.extend(made)
        return out

    run.__name__, run.__doc__ = work.__name__, work.__doc__
    return run


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, or their host's verdict, reject go.

    A null or empty text has too few words and goes; a null source has no host's verdict; a null id is no matter; a very long text is
    counted whole; equal rows are counted each and stay or go together.
    """
    return quality.keep_documents(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the smallest doc_id.

    Texts without words link with nothing and stay, and so do rows without an id; equal rows under the smallest id stay all; very long
    texts are compared whole.
    """
    return jaccard.keep_first(docs)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated paragraphs, lines and spans of sentences go but for their first occurrence; text and n_chars change.

    A null text stays null, an empty one empty; a text may become empty, and its row stays; rows without an id come after all others;
    rows equal in id and text are one document and change alike; very long texts are cut whole.
    """
    return dedup_units.remove_repeats(docs)


@stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; text and n_chars change.

    A null text stays null, and no row goes; equal rows change alike; ids are no matter; a very long run of characters is tested whole.
    """
    return secrets.redact(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences.

    A null or empty text has the end id alone; equal rows, and rows without an id, are documents of their own; very long texts fill
    windows of their own.
    """
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("secret scans", secret_scan),
    ("packing", pack),
]

#: Tokenization and the randomness battery are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences made of documents. Each stage is written, and deleted once the next one is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, work in STAGES:
        path = fresh_folder(spark, "stage-" + name.replace(" ", "-"))
        work(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
