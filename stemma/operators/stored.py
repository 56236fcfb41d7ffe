"""A full-text index that is written once and read in part (FTS-01, FTS-03..06).

Postings are blocks: a term's documents within one range of document ids, in order, with frequencies, lengths and positions, and the
greatest weight of any of them. Blocks lie in partitions by a hash of their term, sorted by term, so a query's terms are a partition filter
and, within the files, a filter on column statistics; columns that a query does not need are not read. Ranges are the same for all terms:
the sum of the terms' greatest weights in a range bounds every score in it. A search for the best k reads these bounds, scores the
ranges of the largest ones, and then only those ranges whose bound reaches the k-th score found.

Substrings are found by trigrams in the same layout: documents that hold the rarest grams of what is sought are intersected, then read and tested.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.operators.fts import B, K1, grams, tokens
from stemma.session import small_side

#: Documents of a range on average, partitions by hash of the term.
RANGE, BUCKETS = 128, 32
GRAM = 3
#: Documents of a partition on average while an index is made; tokens after which a range is cut.
DEALT, TOKENS = 20_000, 2_000_000
PLAIN = re.compile("[a-z0-9]+")

#: Trigram blocks have documents only.
BLOCKS = "term string, range long, n int, most double, doc array<long>, tf array<int>, dl array<int>, positions array<array<int>>, bucket int"


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.hash(term), F.lit(buckets))


def _width(docs: DataFrame, per_range: int) -> tuple[int, int]:
    """(least id, ids of a range) so that a range has per_range documents on average."""
    held = docs.agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n")).first()
    if not held["n"]:
        return 0, 1
    return held["low"], max(1, (held["high"] - held["low"] + 1) * per_range // held["n"])


def _range(doc: Column, low: int, width: int) -> Column:
    return F.floor((doc - F.lit(low)) / F.lit(width)).cast("long")


def _write_by_term(blocks: DataFrame, path: str) -> None:
    """blocks (bucket, slice, term, range, ...), already dealt by bucket and slice: a few files for each bucket, sorted by term."""
    blocks.sortWithinPartitions("bucket", "term", "range").drop("slice").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows with bucket and slice, one shuffle by both: a frequent term's ranges are spread over the slices of its bucket."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = max(1, -(-n // buckets))
    placed = rows.withColumn("bucket", _bucket(F.col("term"), buckets)).withColumn("slice", F.pmod(F.hash("range"), F.lit(each)))
    return placed.repartition(n, "bucket", "slice")


def _words(text: str, stem: bool) -> list[str]:
    return tokens(text) if stem else PLAIN.findall(text)


def _lengths(stem: bool) -> Callable[[Column], Column]:
    @F.arrow_udf("int")
    def lengths(texts: pa.Array) -> pa.Array:
        return pa.array([len(_words(t.as_py(), stem)) for t in texts], pa.int32())

    return lengths


def _blocks(mean: float, stem: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of texts in order (range, doc, text), the blocks of each range."""

    def block(at: int, docs: list[int], words: list[list[str]]) -> pa.RecordBatch:
        names: dict[str, int] = {}
        term = np.array([names.setdefault(w, len(names)) for own in words for w in own], np.int64)
        size = np.array([len(own) for own in words], np.int32)
        doc = np.repeat(np.arange(len(docs)), size)
        order = np.argsort(term, kind="stable")  # by term, then document, then position
        term, doc, pos = term[order], doc[order], (np.arange(len(term)) - np.repeat(np.cumsum(size) - size, size))[order]
        held = np.flatnonzero(np.diff(term, prepend=-1).astype(bool) | np.diff(doc, prepend=-1).astype(bool))  # where postings begin
        first = np.flatnonzero(np.diff(term[held], prepend=-1))  # where blocks begin, in postings
        tf, own = np.diff(held, append=len(term)).astype(np.int32), doc[held]
        dl = size[own]
        most = np.maximum.reduceat(_weight(tf, dl, mean), first) if len(first) else np.array([], np.float64)
        ends = pa.array(np.append(first, len(held)), pa.int32())
        positions = pa.ListArray.from_arrays(pa.array(np.append(held, len(term)), pa.int32()), pa.array(pos, pa.int32()))
        lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(np.array(docs, np.int64)[own]), pa.array(tf), pa.array(dl), positions)]
        n = np.diff(first, append=len(held)).astype(np.int32)
        columns = [pa.array(list(names), pa.string()), pa.array(np.full(len(names), at, np.int64)), pa.array(n), pa.array(most), *lists]
        return pa.RecordBatch.from_arrays(columns, ["term", "range", "n", "most", "doc", "tf", "dl", "positions"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, docs, words, n = None, [], [], 0
        for batch in batches:
            for r, d, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                if docs and (r.as_py() != at or n > TOKENS):
                    yield block(at, docs, words)
                    docs, words, n = [], [], 0
                at = r.as_py()
                docs.append(d.as_py())
                words.append(_words(text.as_py(), stem))
                n += len(words[-1])
        if docs:
            yield block(at, docs, words)

    return make


@dataclass(frozen=True)
class StoredIndex:
    """An index at a path: blocks by bucket, terms with their document frequency, and one row of statistics."""

    spark: SparkSession
    path: str
    n: int
    mean: float
    buckets: int
    stem: bool

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCKS).parquet(f"{self.path}/blocks")

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")


def write_index(df: DataFrame, key: str, column: str, path: str, stem: bool = False, per_range: int = RANGE, buckets: int = BUCKETS) -> StoredIndex:
    """FTS-01: the index of a column of df, whose key is a whole number without nulls or repetition. An existing one is replaced.

    Texts are dealt by their key, so that a range's documents come together: what is shuffled to its bucket is a block, not a token. A range
    that lies in two partitions, or has very many tokens, has several blocks of a term."""
    spark = df.sparkSession
    text = F.coalesce(F.col(column), F.lit(""))
    text = text if stem else F.lower(text)
    df.select(F.col(key).cast("long").alias("doc"), _lengths(stem)(text).alias("dl")).write.mode("overwrite").parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    low, width = _width(docs, per_range)
    held = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).first()
    texts = df.select(_range(F.col(key).cast("long"), low, width).alias("range"), F.col(key).cast("long").alias("doc"), text.alias("text"))
    texts = texts.repartitionByRange(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held["n"] // DEALT)), "doc").sortWithinPartitions("doc")
    _write_by_term(_dealt(texts.mapInArrow(_blocks(held["mean"] or 1.0, stem), BLOCKS.removesuffix(", bucket int")), buckets), f"{path}/blocks")
    written = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    terms = written.groupBy("term").agg(F.sum("n").alias("df"), F.first("bucket").alias("bucket"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    stats = spark.createDataFrame([(held["n"], held["mean"] or 1.0, buckets, stem)], "n long, mean double, buckets int, stem boolean")
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> StoredIndex:
    return StoredIndex(spark, path, **spark.read.parquet(f"{path}/stats").first().asDict())


def _weight(tf: Column | np.ndarray, dl: Column | np.ndarray, mean: float) -> Column | np.ndarray:
    """BM25 without the term's rarity; it grows with tf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def _rarity(n: int, df: int) -> float:
    return max(1e-6, math.log((n - df + 0.5) / (df + 0.5)))


def _read(index: StoredIndex, terms: list[str]) -> DataFrame:
    """The blocks of terms: only their partitions are listed, only their row groups read."""
    spark = index.spark
    hashed = spark.createDataFrame([(t,) for t in terms] or [("",)], "term string").select(_bucket(F.col("term"), index.buckets).alias("b"))
    buckets = sorted({r["b"] for r in hashed.collect()})
    return index.blocks.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def frequencies(index: StoredIndex, terms: list[str]) -> dict[str, int]:
    """In how many documents each of the terms is; terms that are nowhere are left out."""
    return {r["term"]: r["df"] for r in index.terms.where(F.col("term").isin(terms)).collect()}  # as many as the query has words


def _by_term(terms: dict[str, float]) -> Column:
    out = None
    for t, x in terms.items():
        out = F.when(F.col("term") == t, x) if out is None else out.when(F.col("term") == t, x)
    return out


def _scored(blocks: DataFrame, rarity: dict[str, float], mean: float, need: int) -> DataFrame:
    """doc, score of the documents in blocks that hold at least need terms."""
    each = blocks.select("term", F.inline(F.arrays_zip("doc", "tf", "dl")))
    score = F.sum(_by_term(rarity) * _weight(F.col("tf"), F.col("dl"), mean))
    return each.groupBy("doc").agg(score.alias("score"), F.count("*").alias("_n")).where(F.col("_n") >= need).select("doc", "score")


def matches(index: StoredIndex, terms: list[str], must: bool = True) -> DataFrame:
    """FTS-04, FTS-06: doc, score of all documents with all terms (must) or any of them."""
    terms = list(dict.fromkeys(terms))
    df = frequencies(index, terms)
    if not df or must and len(df) < len(terms):
        return index.spark.createDataFrame([], "doc long, score double")
    rarity = {t: _rarity(index.n, x) for t, x in df.items()}
    return _scored(_read(index, list(df)), rarity, index.mean, len(terms) if must else 1)


@dataclass(frozen=True)
class Pruned:
    """The best documents, and how many ranges and postings there were and were scored."""

    best: DataFrame
    ranges: int
    scored_ranges: int
    threshold: float


def best(index: StoredIndex, terms: list[str], k: int, must: bool = False, digits: int = 6) -> Pruned:
    """The k documents of the best scores, rounded to digits, ties to smaller ids: doc, score."""
    terms = list(dict.fromkeys(terms))
    df = frequencies(index, terms)
    none = index.spark.createDataFrame([], "doc long, score double")
    if not df or must and len(df) < len(terms):
        return Pruned(none, 0, 0, 0.0)
    rarity, need = {t: _rarity(index.n, x) for t, x in df.items()}, len(terms) if must else 1
    blocks = _read(index, list(df))
    top = lambda scored: scored.select("doc", F.round("score", digits).alias("score")).orderBy(F.desc("score"), "doc").limit(k)
    # Where a term has several blocks in a range, bounds are only larger. A range's bound is a few bytes; as many ranges go on as blocks of the rarest term could fill with k documents.
    bounds = blocks.groupBy("range").agg(F.sum(_by_term(rarity) * F.col("most")).alias("bound"), F.count("*").alias("_n")).where(F.col("_n") >= need)
    first = [r["range"] for r in bounds.orderBy(F.desc("bound"), "range").limit(k).collect()]
    seen = top(_scored(blocks.where(F.col("range").isin(first)), rarity, index.mean, need)).collect()  # k rows
    threshold = seen[-1]["score"] - 10.0**-digits if len(seen) == k else 0.0
    left = bounds.where(F.col("bound") >= threshold)
    counts = bounds.agg(F.count("*").alias("all"), F.count_if(F.col("bound") >= threshold).alias("left")).first()
    scored = _scored(blocks.join(small_side(left.select("range"), 100_000), "range", "left_semi"), rarity, index.mean, need)
    return Pruned(top(scored), counts["all"], counts["left"], threshold)


def with_prefix(index: StoredIndex, terms: list[str], prefix: str) -> DataFrame:
    """FTS-04: doc, score of the documents with all terms and a word that begins with prefix, which counts as one term."""
    df = frequencies(index, terms)
    if len(df) < len(set(terms)):
        return index.spark.createDataFrame([], "doc long, score double")
    begun = index.terms.where(F.startswith("term", F.lit(prefix))).select("term", "bucket")
    buckets = sorted(r["bucket"] for r in begun.select("bucket").distinct().collect())  # as many as the index has partitions
    found = index.blocks.where(F.col("bucket").isin(buckets) & F.startswith("term", F.lit(prefix))).select(F.inline(F.arrays_zip("doc", "tf", "dl")))
    one = found.groupBy("doc", "dl").agg(F.sum("tf").alias("tf"))
    n = one.count()
    last = one.select("doc", (_weight(F.col("tf"), F.col("dl"), index.mean) * _rarity(index.n, n)).alias("score"))
    return last if not terms else matches(index, terms).join(last.withColumnRenamed("score", "_s"), "doc").select("doc", (F.col("score") + F.col("_s")).alias("score"))


def phrase(index: StoredIndex, terms: list[str]) -> DataFrame:
    """FTS-05: doc of the documents in which terms follow each other. Ranges are joined by the rarest term first, so a frequent term's
    positions are read only where the others are."""
    df = frequencies(index, terms)
    none = index.spark.createDataFrame([], "doc long")
    if not terms or len(df) < len(set(terms)):
        return none
    blocks = _read(index, list(df))
    order = sorted(range(len(terms)), key=lambda k: (df[terms[k]], k))
    starts = None
    for k in order:
        own = blocks.where(F.col("term") == terms[k]).select("range", F.inline(F.arrays_zip("doc", "positions")))
        own = own.select("range", "doc", F.transform("positions", lambda p: p - k).alias(f"s{k}"))  # noqa: B023
        starts = own if starts is None else starts.join(own, ["range", "doc"]).withColumn("s", F.array_intersect("s", F.col(f"s{k}"))).where(F.size("s") > 0).drop(f"s{k}")
        starts = starts.withColumnRenamed(f"s{k}", "s")
    return starts.where(F.size("s") > 0).select("doc")


# ---- trigrams


def write_trigrams(df: DataFrame, key: str, column: str, path: str, per_range: int = RANGE, buckets: int = BUCKETS) -> StoredIndex:
    """FTS-03: the documents of each trigram of a column in lower case, as blocks. Rows without a text, or with less than three characters, have none."""
    spark = df.sparkSession
    t = df.select(F.col(key).cast("long").alias("doc"), F.lower(column).alias("text"))
    t.select("doc").write.mode("overwrite").parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    low, width = _width(docs, per_range)
    each = t.select("doc", F.explode(grams(F.col("text"), GRAM)).alias("term")).withColumn("range", _range(F.col("doc"), low, width))
    place = ["bucket", "slice", "term", "range"]
    blocks = _dealt(each, buckets).groupBy(*place).agg(F.array_sort(F.collect_list("doc")).alias("doc"))
    _write_by_term(blocks.withColumn("n", F.size("doc")), f"{path}/blocks")
    terms = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("term").agg(F.sum("n").alias("df"), F.first("bucket").alias("bucket"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    stats = spark.createDataFrame([(docs.count(), 1.0, buckets, False)], "n long, mean double, buckets int, stem boolean")
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return open_index(spark, path)


def rarest(index: StoredIndex, needle: str, most: int = 3) -> list[str]:
    """The grams of needle that the fewest documents hold, at most so many; empty if one of its grams is nowhere or it has none."""
    low = needle.lower()
    grams = list(dict.fromkeys(low[k : k + GRAM] for k in range(len(low) - GRAM + 1)))
    df = frequencies(index, grams)
    return [] if len(df) < len(grams) else sorted(grams, key=lambda g: (df[g], g))[:most]


def candidates(index: StoredIndex, grams: list[str]) -> DataFrame:
    """doc of the documents that hold all grams: blocks of a range are intersected, so that only ranges with every gram are opened."""
    if not grams:
        return index.spark.createDataFrame([], "doc long")
    met = _read(index, grams).groupBy("range").agg(F.collect_list("doc").alias("d")).where(F.size("d") == len(grams))  # a block for each gram
    return met.select(F.explode(F.aggregate(F.slice("d", 2, len(grams)), F.get("d", F.lit(0)), F.array_intersect)).alias("doc"))


def containing(index: StoredIndex, df: DataFrame, key: str, column: str, needle: str, most: int = 3) -> DataFrame:
    """FTS-03: the rows of df whose column holds needle, without regard to case: candidates are read and tested, no others. A needle of
    less than three characters is in no row, as the trigram tokenizer has it."""
    found = small_side(candidates(index, rarest(index, needle, most)).withColumnRenamed("doc", "_doc"), 100_000)
    return df.join(found, F.col(key) == F.col("_doc"), "left_semi").where(F.contains(F.lower(column), F.lit(needle.lower())))
