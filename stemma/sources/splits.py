"""Large text files by splits: lines in their order, and SQL dumps whose statements cross the splits (SRC-01..03, SRC-23..26).

What a character of a dump means depends on all before it: a quote may open or close a string. So each split is first lexed for every state
that it may begin in, which leaves one small row: the state at its end and the statements ended, for each state at its beginning. The
rows of a file are followed in order, which gives each split its true state, and a second pass cuts statements. The pieces of those
that cross splits are put together by their number. No task reads more than its splits, and the result does not depend on where they end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from stemma.operators.scan import dealt, running
from stemma.session import checkpointed
from stemma.sources.sqldump import insert_rows, insert_table


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start, row, line of the text files at a path: in a file, lines are ordered by the start of their split, then row."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))


def numbered_lines(spark: SparkSession, path: str, one: bool = False) -> DataFrame:
    """volume, line_no from 0, line (without a carriage return at its end) of the text files at a path. one: the files at a path are one volume
    in the order of their names, named by the path."""
    order = ["start", "row"]
    lines = split_lines(spark, path)
    if one:
        lines, order = lines.withColumnsRenamed({"file": "part"}).withColumn("file", F.lit(path)), ["part", *order]
    lines = running(dealt(lines, ["file"], order), ["file"], order, {"n": ("count", F.lit(1))})
    return lines.select(F.col("file").alias("volume"), (F.col("n") - 1).cast("int").alias("line_no"), F.regexp_replace("line", r"\r$", "").alias("line"))


# ---- the lexer

PLAIN, SINGLE, DOUBLE, TICK, COMMENT = range(5)
#: From within each state, what ends it. Possessive: a string that goes on in the next chunk is not taken to end at a doubled quote.
_INSIDE = {SINGLE: r"(?:[^'\\]++|\\.|'')*+'", DOUBLE: r'(?:[^"\\]++|\\.)*+"', TICK: r"[^`]*+`", COMMENT: r"(?:[^*]++|\*(?!/))*+\*/"}
_ENDS = {s: re.compile(p, re.DOTALL) for s, p in _INSIDE.items()}
_OPENERS = {"'": SINGLE, '"': DOUBLE, "`": TICK, "/*": COMMENT}
_TOKEN = re.compile(
    rf"(?P<kept>'{_INSIDE[SINGLE]}|\"{_INSIDE[DOUBLE]}|`{_INSIDE[TICK]}|[^'\"`;#/-]++)|(?P<end>;)|(?P<left>--[^\n]*+|\#[^\n]*+|/\*{_INSIDE[COMMENT]})|(?P<open>'|\"|`|/\*)|(?P<one>.)", re.DOTALL
)


def lex(chunk: str, state: int) -> tuple[list[str | None], int]:
    """(text in order, None where a statement ends; the state at the end) of whole lines that begin in a state. Comments are left out."""
    out: list[str | None] = []
    at = 0
    if state != PLAIN:
        m = _ENDS[state].match(chunk)
        if not m:
            return [] if state == COMMENT else [chunk], state
        at = m.end()
        if state != COMMENT:
            out.append(chunk[:at])
    for m in _TOKEN.finditer(chunk, at):
        kind = m.lastgroup
        if kind == "end":
            out.append(None)
        elif kind == "open":
            state = _OPENERS[m[0]]
            return out if state == COMMENT else [*out, chunk[m.start() :]], state
        elif kind != "left":
            out.append(m[0])
    return out, PLAIN


def _chunks(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """(file, start, other columns, text) of runs of lines of one split, in order."""
    for b in batches:
        files, starts, lines = (b.column(c).to_pylist() for c in ("file", "start", "line"))
        others = [b.column(c).to_pylist() for c in more]
        a = 0
        for k in range(1, len(lines) + 1):
            if k == len(lines) or (files[k], starts[k]) != (files[a], starts[a]):
                yield (files[a], starts[a], *(o[a] for o in others), "\n".join(lines[a:k]) + "\n")
                a = k


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: the state at its end and the statements ended, by the state at its beginning."""
    names = ["file", "start", "states", "ended"]
    held, now, ended = None, list(range(5)), [0] * 5

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]], pa.int64()), pa.array([now], pa.list_(pa.int32())), pa.array([ended], pa.list_(pa.int64()))], names=names)

    for file, start, chunk in _chunks(batches):
        if held != (file, start):
            if held is not None:
                yield row()
            held, now, ended = (file, start), list(range(5)), [0] * 5
        found = {s: lex(chunk, s) for s in set(now)}  # states soon agree
        ended = [n + found[s][0].count(None) for n, s in zip(ended, now, strict=True)]
        now = [found[s][1] for s in now]
    if held is not None:
        yield row()


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Through the splits of a file in order: the state that each begins in, and the statements ended before it."""
    file, state, n = None, PLAIN, 0
    for b in batches:
        states, before = [], []
        for f, to, ended in zip(*(b.column(c).to_pylist() for c in ("file", "states", "ended")), strict=True):
            if f != file:
                file, state, n = f, PLAIN, 0
            states.append(state)
            before.append(n)
            state, n = to[state], n + ended[state]
        yield pa.RecordBatch.from_arrays([b.column("file"), b.column("start"), pa.array(states, pa.int32()), pa.array(before, pa.int64())], names=["file", "start", "state", "before"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, number, start, whole, text: statements that lie within a split as wholes, others as pieces."""
    held, state, number, text, first = None, PLAIN, 0, [], True
    out: dict[str, list] = {c: [] for c in ("file", "number", "start", "whole", "text")}

    def put(whole: bool) -> None:
        body = "".join(text)
        text.clear()
        if body.strip() or not whole and body:
            for c, x in zip(out, (held[0], number, held[1], whole, body), strict=True):
                out[c].append(x)

    def batch() -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        made = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))
        for v in out.values():
            v.clear()
        return made

    for file, start, begins, before, chunk in _chunks(batches, "state", "before"):
        if held != (file, start):
            if held is not None:
                put(False)
            held, state, number, first = (file, start), begins, before, True
        found, state = lex(chunk, state)
        for x in found:
            if x is None:
                put(not first)  # a split's first statement may have begun before it
                number, first = number + 1, False
            else:
                text.append(x)
        yield batch()
    if held is not None:
        put(False)
        yield batch()


def statements_by_split(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: file, number, statement of the dumps at a path, without comments, numbered from 0 in each file; empty ones have no row. A
    string or comment that nothing ends goes on to the end of the file."""
    lines = split_lines(spark, path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    maps = lines.select("file", "start", "line").mapInArrow(_transitions, "file string, start long, states array<int>, ended array<long>")
    begins = checkpointed(maps.repartition(n, "file").sortWithinPartitions("file", "start").mapInArrow(_followed, "file string, start long, state int, before long"))
    pieces = checkpointed(_with_states(lines, begins).mapInArrow(_pieces, "file string, number long, start long, whole boolean, text string"))
    crossing = pieces.where("NOT whole").groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p"))
    joined = crossing.select("file", "number", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    both = pieces.where("whole").select("file", "number", "text").unionByName(joined)
    return both.select("file", "number", F.regexp_replace("text", r"^\s+|\s+$", "").alias("statement")).where("statement <> ''")


def _with_states(lines: DataFrame, begins: DataFrame, few: int = 200_000) -> DataFrame:
    """Lines in order with the state and number of their split, of which begins has a row each."""
    if begins.limit(few + 1).count() <= few:
        return lines.join(F.broadcast(begins), ["file", "start"])  # lines stay where and as they are read
    return lines.join(begins, ["file", "start"]).sortWithinPartitions("file", "start", "row")


@udtf(returnType="table_name string, place int, row array<string>")
class StatementRows:
    """The rows that a statement inserts."""

    def eval(self, statement: str):
        name = insert_table(statement or "")
        if name:
            for k, row in enumerate(insert_rows(statement)):
                yield name, k, row


def read_dump_by_split(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01..03: file, table_name, ordinal (from 0 in each file), row of the dumps at a path."""
    found = statements_by_split(spark, path).lateralJoin(StatementRows(F.col("statement").outer())).select("file", "number", "place", "table_name", "row")
    rows = checkpointed(found)
    counts = rows.groupBy("file", "number").agg(F.count("*").alias("n"))
    before = running(dealt(counts, ["file"], ["number"]), ["file"], ["number"], {"upto": ("sum", F.col("n"))}).select("file", "number", (F.col("upto") - F.col("n")).alias("before"))
    return rows.join(before, ["file", "number"]).select("file", "table_name", (F.col("before") + F.col("place")).cast("int").alias("ordinal"), "row")
