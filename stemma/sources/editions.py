"""From parsed files to lines of editions (SRC-04, SRC-10, SRC-13, SRC-15, SRC-16, SRC-20, SRC-22). Keys are hashes of natural keys."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from stemma.functions.text import decode_entities, roman_value, word_count
from stemma.sources import markup
from stemma.sources.sqldump import dump_table, verse_lines

#: Columns of the dump's tables by place, with the rows' least width.
DUMP_TABLES = {
    "Works": (10, {"oss_id": "string", "title": "string", "full_title": "string", "short_title": "string", "year": "int", "genre_type": "string", "notes": "string", "source_text": "string", "total_words": "int", "total_paragraphs": "int"}),
    "Characters": (6, {"char_id": "string", "name": "string", "abbrev": "string", "oss_work_id": "string", "description": "string", "speech_count": "int"}),
    "Chapters": (5, {"oss_work_id": "string", "chapter_id": "int", "section": "int", "chapter": "int", "description": "string"}),
    "Paragraphs": (12, {"oss_work_id": "string", "paragraph_id": "int", "paragraph_num": "int", "char_id": "string", "text": "string", "phonetic": "string", "stem": "string", "paragraph_type": "string", "section": "int", "chapter": "int", "chars": "int", "words": "int"}),
}


def line_id(*columns: str | Column) -> Column:
    return F.xxhash64(*columns)


def content_type(is_stage: Column) -> Column:
    return F.when(is_stage, F.lit("stage_direction")).otherwise(F.lit("speech"))


def dump_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """SRC-04: works, characters, chapters and paragraphs of a dump; entities decoded, short rows left out."""
    out = {}
    for name, (width, columns) in DUMP_TABLES.items():
        df = dump_table(rows, name, columns, width)
        for c in {"full_title", "name", "description", "text"} & set(df.columns):
            df = df.withColumn(c, decode_entities(c))
        out[name.lower()] = df
    return out


def dump_lines(paragraphs: DataFrame, edition_id: int) -> DataFrame:
    """SRC-04, SRC-05, WIN-02: verse lines of paragraphs, numbered within each scene; stage directions are of the character xxx."""
    lines = verse_lines(paragraphs, "text")
    n = F.row_number().over(W.partitionBy("oss_work_id", "section", "chapter").orderBy("paragraph_num", "pos"))
    stage = F.col("char_id") == "xxx"
    return lines.withColumn("line_number", n).select(
        line_id("oss_work_id", F.lit(edition_id), "paragraph_id", "pos").alias("id"), "oss_work_id", F.lit(edition_id).cast("long").alias("edition_id"), F.col("section").alias("act"), F.col("chapter").alias("scene"), "line_number",
        F.col("char_id").alias("char_name"), F.col("line").alias("content"), content_type(F.coalesce(stage, F.lit(False))).alias("content_type"), word_count(F.col("line")).alias("word_count"),
    )


def _lines(parsed: DataFrame, edition_id: Column, number: Column) -> DataFrame:
    return parsed.select(
        line_id("work_id", edition_id, "act", "scene", "pos").alias("id"), "work_id", edition_id.cast("long").alias("edition_id"), "act", "scene", number.cast("int").alias("line_number"),
        F.col("character").alias("char_name"), F.col("text").alias("content"), content_type(F.col("is_stage")).alias("content_type"), word_count(F.col("text")).alias("word_count"),
    )


def globe_plays(files: DataFrame, edition_id: int) -> DataFrame:
    """SRC-14, SRC-16, SCL-20: TEI plays whose milestones give some line numbers; the others are interpolated within each scene. files:
    work_id, xml."""
    parsed = markup.parse_files(files, "xml", markup.TeiPlay, ["work_id"]).withColumnRenamed("line_number", "mark")
    numbered = markup.interpolate_numbers(parsed, "mark", ["work_id", "act", "scene"], ["pos"], "is_stage")
    return _lines(numbered, F.lit(edition_id), F.col("line_number"))


def folio_plays(files: DataFrame, edition_id: int) -> DataFrame:
    """SRC-17, SRC-18: line numbers run over the whole play."""
    parsed = markup.parse_files(files, "xml", markup.TeiPlay, ["work_id"])
    return _lines(parsed, F.lit(edition_id), F.row_number().over(W.partitionBy("work_id").orderBy("pos")))


def word_plays(files: DataFrame, edition_id: int) -> tuple[DataFrame, DataFrame]:
    """SRC-19, SRC-20: (lines, word annotations): lines without a number take the largest so far in their scene; words count from 1."""
    parsed = markup.parse_files(files, "xml", markup.WordsPlay, ["work_id"])
    lines = _lines(parsed, F.lit(edition_id), markup.fill_running_max(F.col("line_number"), ["work_id", "act", "scene"], ["pos"]))
    ids = parsed.select(line_id("work_id", F.lit(edition_id), "act", "scene", "pos").alias("line_id"), F.posexplode("words").alias("p", "w"))
    return lines, ids.select("line_id", (F.col("p") + 1).alias("position"), "w.word", "w.lemma", "w.pos")


def quarto_plays(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-21, SRC-22: (editions, lines): one edition for each file, q1_{oss_id}_{year}. files: work_id, oss_id, year, xml."""
    code = F.concat(F.lit("q1_"), "oss_id", F.lit("_"), F.col("year").cast("string"))
    coded = files.withColumn("short_code", code).withColumn("edition_id", F.xxhash64("short_code"))
    parsed = markup.parse_files(coded.select("work_id", "edition_id", "xml"), "xml", markup.QuartoPlay, ["work_id", "edition_id"])
    lines = _lines(parsed, F.col("edition_id"), F.row_number().over(W.partitionBy("edition_id").orderBy("pos")))
    return coded.select(F.col("edition_id").alias("id"), "short_code", "year").distinct(), lines


def xhtml_plays(files: DataFrame, edition_id: int) -> DataFrame:
    """SRC-10: plays as JSON objects of file name -> XHTML, files in the order of their names. files: work_id, json."""
    acts = files.select("work_id", F.explode(F.from_json("json", "map<string,string>")).alias("file", "html"))
    parsed = markup.parse_files(acts, "html", markup.XhtmlPlay, ["work_id", "file"])
    order = F.row_number().over(W.partitionBy("work_id").orderBy("file", "pos"))
    return _lines(parsed.withColumn("pos", order), F.lit(edition_id), F.col("line_number"))


def xhtml_poetry(files: DataFrame, articles: DataFrame, edition_id: int) -> DataFrame:
    """SRC-11..13: lines of poems (act and scene null) and sonnets (scene is the number, act null). files: html; articles: article, work_id
    (article sonnet for all sonnets)."""
    parsed = markup.parse_files(files, "html", markup.XhtmlPoems, [])
    key = F.when(F.col("sonnet").isNotNull(), F.lit("sonnet")).otherwise(F.col("article"))
    placed = parsed.withColumn("key", key).join(articles.withColumnRenamed("article", "key"), "key")
    return placed.select(line_id("work_id", F.lit(edition_id), "article", "line").alias("id"), "work_id", F.lit(edition_id).cast("long").alias("edition_id"), F.lit(None).cast("int").alias("act"), F.col("sonnet").alias("scene"), F.col("line").alias("line_number"), F.col("text").alias("content"), "stanza")


def tei_poem(text: str) -> Iterator[tuple[int, int, str]]:
    """SRC-15: (section or sonnet, line number, text) of a TEI poem: sonnets are div1 elements of that type with Roman or Arabic numbers, each
    counted from 1; other poems count on over their sections. A line's own number, where it has one, is taken and counted on from."""
    root = markup.parse_xml(text)
    number = 0

    def verses(e: ET.Element) -> Iterator[ET.Element]:
        for c in e:
            if c.tag == "l":
                yield c
            else:
                yield from verses(c)

    for body in root.iter("body"):
        for div in body.findall("div1"):
            n, sonnet = div.get("n") or "", div.get("type") == "sonnet"
            section = int(n) if n.isdigit() else roman_value(n) if sonnet else 0
            if sonnet:
                number = 0
                if not section:
                    continue
            for v in verses(div):
                if t := markup.text_of(v):
                    own = v.get("n") or ""
                    number = int(own) if own.isdigit() and int(own) else number + 1
                    yield section, number, t


@udtf(returnType="section int, line_number int, text string")
class TeiPoem:
    def eval(self, text: str):
        yield from tei_poem(text)


def tei_poems(files: DataFrame, edition_id: int) -> DataFrame:
    """SRC-15, SRC-16: act 1, scene the section or sonnet. files: work_id, xml."""
    parsed = markup.parse_files(files, "xml", TeiPoem, ["work_id"])
    return parsed.select(line_id("work_id", F.lit(edition_id), "section", "line_number", "text").alias("id"), "work_id", F.lit(edition_id).cast("long").alias("edition_id"), F.lit(1).alias("act"), F.col("section").alias("scene"), "line_number", F.col("text").alias("content"))
