"""Substring dedup by hashing of paragraphs, lines and spans of sentences.

Texts are cut into units: paragraphs (lines between blank ones), lines, and spans of sentences within a paragraph, so that a
passage is found wherever it stands. Sentences end in . ! or ? before white space, in a full-width mark, or with their line;
from each sentence goes a span of as few sentences as have MIN_WORDS words. A unit's words in lower case, joined by one space,
are hashed; over all documents the occurrence with the smallest (doc_id, start) is kept and every other one goes, except that
one which overlaps the kept one stays. Units of fewer words than MIN_WORDS stay: they are too short to be copies of a passage.
Scripts without spaces count so many characters as a word. A unit within a larger one that goes is not reported by itself.
Of each sentence that goes an earlier one stays. Offsets are code points in the original text and include the white space
after the unit.

Sums by digest are combined before the shuffle; the join of occurrences to repeated digests is a plain inner join, whose
hot keys adaptive execution splits.

Defined cases: null and blank texts have no units; rows with equal doc_id and equal text are one document (their units
repeat each other at the same place, and stay); a null doc_id ranks after all others; an empty table gives no rows; other
columns are ignored or, by remove_repeats(), kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.llm.common import materialize, tidy, to_batch

#: Words of a unit, at least. Shorter lines repeat in documents that have no passage in common.
MIN_WORDS = 20
BOUNDARY = re.compile(r"\n|(?<=[.!?])[ \t]+\n?|(?<=[。！？])[ \t]*\n?")
#: Scripts without spaces, and their characters to a word: Han and kana; Thai, Lao, Myanmar and Khmer.
UNSPACED = ((re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff]"), 2), (re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]"), 4))


def count_words(words: list[str]) -> int:
    """Words between spaces, and those of scripts without spaces by their number of characters."""
    n = len(words)
    joined = "".join(words)
    if joined.isascii():
        return n
    return max(n, sum(len(script.findall(joined)) // size for script, size in UNSPACED))


def paragraphs(text: str) -> Iterator[list[tuple[int, int, list[str], bool]]]:
    """The sentences of each paragraph that have words: (start, end, words, whether the next one begins a line)."""
    found: list[tuple[int, int, list[str], bool]] = []
    start, blank = 0, True  # whether the line has no word so far
    for end in [m.end() for m in BOUNDARY.finditer(text)] + [len(text)]:
        words = text[start:end].lower().split()
        ends_line = end == len(text) or text[end - 1 : end] == "\n"
        if words:
            found.append((start, end, words, ends_line))
        elif ends_line and not blank:
            found[-1] = (*found[-1][:3], True)
        elif ends_line and found:
            yield found
            found = []
        blank = ends_line or blank and not words
        start = end
    if found:
        yield found


def units(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of the units of a text that have min_words words or more: paragraphs, lines, spans of sentences."""
    out = []
    for sentences in paragraphs(text):
        counts = [count_words(words) for _, _, words, _ in sentences]
        upto = [0, *accumulate(counts)]
        if upto[-1] < min_words:
            continue
        runs = {(0, len(sentences))}
        first = stop = 0
        for k, (_, _, _, ends_line) in enumerate(sentences):
            if ends_line:
                if upto[k + 1] - upto[first] >= min_words:
                    runs.add((first, k + 1))
                first = k + 1
            while stop < len(sentences) and upto[stop] - upto[k] < min_words:
                stop += 1
            if upto[stop] - upto[k] >= min_words:
                runs.add((k, stop))
        words = [w for s in sentences for w in s[2]]
        at = [0, *accumulate(len(s[2]) for s in sentences)]
        for a, b in runs:
            digest = blake2b(" ".join(words[at[a] : at[b]]).encode("utf-8", "surrogatepass"), digest_size=12).digest()
            out.append((sentences[a][0], sentences[b - 1][1], upto[b] - upto[a], digest))
    return out


def _units(min_words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {f.name: [] for f in schema}
            for doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text")), strict=True):
                for start, end, words, digest in units(text, min_words) if text else ():
                    for name, v in zip(rows, (doc, key, start, end, words, digest), strict=True):
                        rows[name].append(v)
                if len(rows["doc_id"]) >= 50_000:
                    yield to_batch(rows, schema)
                    rows = {f.name: [] for f in schema}
            yield to_batch(rows, schema)

    return run


def all_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, key (hash of the text), start, end, words, digest of each unit of each row of docs (doc_id, text)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("key"), "text")
    return d.mapInArrow(tidy(_units(min_words)), "doc_id long, key int, start int, end int, words int, digest binary")


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, key, start, end, words, kept_doc_id, kept_start of each unit that goes and the occurrence that stays."""
    found = materialize(all_units(docs, min_words), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("start"), F.col("end"))
    # Written, so that the join has no aggregate beside it: adaptive execution can then split a hot digest.
    first = materialize(found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "first")
    every = found.join(first, "digest")
    # A text that says one thing again and again has spans that overlap: those that overlap the first one stay.
    later = every.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("start") < F.col("first.end"))))
    later = later.select("doc_id", "key", "start", "end", "words", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start")).distinct()
    # One is within a larger one if an earlier one ends where it does, or later.
    reach = F.max("end").over(W.partitionBy("doc_id", "key").orderBy("start", F.desc("end")).rowsBetween(W.unboundedPreceding, -1))
    return later.withColumn("reach", reach).where("reach IS NULL OR end > reach").drop("reach")


def repeat_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end, words, kept_doc_id, kept_start: each repeated span that goes, with offsets in the original text."""
    return repeated_units(docs, min_words).drop("key").distinct()


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the repeated spans in text, and n_chars (if there) counted anew."""
    spans = repeated_units(docs, min_words).groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__stemma_spans")).select(F.col("doc_id").alias("__stemma_id"), F.col("key").alias("__stemma_key"), "__stemma_spans")
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.hash("text").alias("__stemma_text_key"))

    def without(text: str | None, gone: list[dict] | None) -> str | None:
        if text is None or not gone:
            return text
        out, at = [], 0
        for s in gone:
            out.append(text[at : s["start"]])  # empty where spans overlap
            at = max(at, s["end"])
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.num_columns - 1)
            kept = batch.select(list(range(batch.num_columns - 1)))
            k = kept.schema.get_field_index("text")
            texts = [without(t, g) for t, g in zip(batch.column(k).to_pylist(), spans.to_pylist(), strict=True)] if spans.null_count < len(spans) else batch.column(k)
            yield kept.set_column(k, kept.schema.field(k), pa.array(texts, kept.schema.field(k).type) if isinstance(texts, list) else texts)

    joined = keyed.join(spans, (F.col("__stemma_text_key") == F.col("__stemma_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__stemma_id")), "left")
    joined = joined.select(*[F.col(f"`{c}`") for c in docs.columns], "__stemma_spans").mapInArrow(tidy(run), docs.schema)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined
