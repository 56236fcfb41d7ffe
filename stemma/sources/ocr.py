"""Reference works from OCR text (SRC-23..26, OTH-01, OTH-02): headword heuristics as line flags, entries as running sums of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions.text import first_letter, is_all_caps, is_page_number
from stemma.operators.scan import dealt, parts_of, running, spread
from stemma.session import small_side
from stemma.sources.splits import numbered_lines


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """volume, line_no, line of the text files at a path, in the order of each file; files are read by splits."""
    return numbered_lines(spark, path)


def segment(lines: DataFrame, starts: Column, drop: Column | None = None) -> DataFrame:
    """volume, entry_no, first, raw_text: a flagged line begins an entry, which goes on to the next one; lines before the first are left
    out. Volumes are numbered apart; the numbers are a running sum, so a volume is not one task."""
    kept = lines.where(~drop) if drop is not None else lines
    flagged = kept.select("volume", "line_no", "line", F.coalesce(starts, F.lit(False)).cast("int").alias("_s"))
    d = dealt(flagged, ["volume"], ["line_no"])
    numbered = running(d, ["volume"], ["line_no"], {"entry_no": ("sum", F.col("_s"))}).where("entry_no > 0")
    parts = spread(numbered, parts_of(d), "volume", "entry_no").groupBy("volume", "entry_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return parts.select("volume", "entry_no", F.col("ls")[0]["line"].alias("first"), F.regexp_replace(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), r"^\s+|\s+$", "").alias("raw_text"))


def headword(first: Column, mark: str = r"[,.\[(;:]") -> Column:
    """OTH-02: what stands before the first mark, in lower case, without sense numbers and signs."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(first, rf"^([^{mark[1:-1]}]+)", 1), r"[0-9]+", ""), r"[^\p{L}\p{Nd}' -]", "")))


def glossary_start(line: Column) -> Column:
    """SRC-23: an entry of a glossary begins with a word in lower case, set off by a colon, comma, bracket or sense number."""
    return F.rlike(line, F.lit(r"^[a-zà-ÿ][a-zà-ÿ' -]{1,30}(\s+(sb|vb|adj|adv|pple|int|prep|conj)\.|\s*[:(\[,])")) & ~is_page_number(line)


def grammar_start(line: Column, most: int = 520) -> Column:
    """SRC-24: a numbered paragraph from 1 to 520."""
    n = F.regexp_extract(line, r"^\s*§?\s*([0-9]{1,3})\.\s", 1)
    return (n != "") & n.try_cast("int").between(1, most)


def concordance_start(line: Column) -> Column:
    """SRC-25: Word., two spaces, up to 60 characters before it, three bytes at least, not in capitals throughout."""
    word = F.regexp_extract(line, r"^(\p{Lu}[^.]{0,59})\.\s\s", 1)
    return (F.octet_length(word) >= 3) & ~is_all_caps(word)


def slang_start(line: Column) -> Column:
    """SRC-26: a headword in capitals."""
    word = F.regexp_extract(line, r"^(\p{Lu}[\p{Lu}' -]+)[,.(]", 1)
    return (F.length(word) >= 2) & is_all_caps(word)


def between_markers(lines: DataFrame, begin: str, end: str) -> DataFrame:
    """The lines of each volume after the first line that holds begin and before the next that holds end."""
    first = lines.where(F.contains("line", F.lit(begin))).groupBy("volume").agg(F.min("line_no").alias("_b"))
    after = lines.where(F.contains("line", F.lit(end))).join(first, "volume").where("line_no > _b").groupBy("volume").agg(F.min("line_no").alias("_e"))
    bounds = small_side(first.join(after, "volume", "left"), 100_000)  # a row for each volume
    return lines.join(bounds, "volume").where("line_no > _b AND (_e IS NULL OR line_no < _e)").select(*lines.columns)


def reference_entries(lines: DataFrame, source: str) -> DataFrame:
    """source, headword, letter, raw_text of one reference work: glossary, grammar, concordance or slang."""
    blank = is_page_number(F.col("line"))
    if source == "grammar":
        e = segment(between_markers(lines, "GRAMMAR.", "INDEX TO THE QUOTATIONS"), grammar_start(F.col("line")), blank)
        key = F.concat(F.lit("§ "), F.regexp_extract("first", r"([0-9]{1,3})", 1))
    elif source == "concordance":
        e = segment(lines, concordance_start(F.col("line")), blank)
        key = F.lower(F.regexp_extract("first", r"^([^.]+)\.", 1))
    elif source == "slang":
        e = segment(lines, slang_start(F.col("line")), blank).where(F.contains(F.lower("raw_text"), F.lit("shak")))
        key = headword(F.col("first"))
    else:
        e = segment(lines, glossary_start(F.col("line")), blank)
        key = headword(F.col("first"))
    return e.select(F.lit(source).alias("source"), key.alias("headword"), first_letter(key).alias("letter"), "raw_text").where("headword <> ''")
