"""SQL dumps as tables (SRC-01..05)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_PIECE = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|#[^\n]*|/\*.*?\*/|;|[^'\"`;#/-]+|.", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
_INSERT = re.compile(r"\s*INSERT\s+INTO\s+`?(\w+)`?", re.IGNORECASE)
_VALUE = re.compile(r"\s*(?:'((?:[^'\\]|\\.|'')*)'|([^,()'\s][^,()']*))\s*(,|\)|$)", re.DOTALL)


def statements(sql: str) -> Iterator[str]:
    """SRC-01: statements of a dump, without comments; semicolons in quotes do not end one."""
    held = []
    for m in _PIECE.finditer(sql):
        piece = m[0]
        if piece == ";":
            s = "".join(held).strip()
            held = []
            if s:
                yield s
        elif not piece.startswith(("--", "#", "/*")) or piece in ("-", "/", "#"):
            held.append(piece)
    if s := "".join(held).strip():
        yield s


def insert_table(statement: str) -> str | None:
    """SRC-03: the table that a statement inserts into."""
    m = _INSERT.match(statement)
    return m[1] if m else None


def _plain(quoted: str) -> str:
    return re.sub(r"\\(.)|''", lambda m: "'" if m[1] is None else _ESCAPES.get(m[1], m[1]), quoted, flags=re.DOTALL)


def insert_rows(statement: str) -> Iterator[list[str | None]]:
    """SRC-02: rows of INSERT ... VALUES (...), (...): strings without their quotes, other values as written, NULL as null."""
    m = re.search(r"\bVALUES\b", statement, re.IGNORECASE)
    at = m.end() if m else len(statement)
    while (at := statement.find("(", at)) >= 0:
        at, row = at + 1, []
        while v := _VALUE.match(statement, at):
            at = v.end()
            row.append(_plain(v[1]) if v[1] is not None else None if v[2].strip().upper() == "NULL" else v[2].strip())
            if v[3] != ",":
                break
        yield row


@udtf(returnType="table_name string, ordinal int, row array<string>")
class DumpRows:
    """All inserted rows of a dump's text."""

    def eval(self, text: str):
        k = 0
        for s in statements(text or ""):
            name = insert_table(s)
            if name:
                for row in insert_rows(s):
                    yield name, k, row
                    k += 1


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """table_name, ordinal, row of the dumps at a path (each file is one text)."""
    texts = spark.read.text(path, wholetext=True)
    return texts.lateralJoin(DumpRows(F.col("value").outer())).select("table_name", "ordinal", "row")


def dump_table(rows: DataFrame, name: str, columns: dict[str, str], width: int) -> DataFrame:
    """SRC-04: one table of a dump: rows of at least width values; columns: name -> type, by place."""
    r = rows.where((F.col("table_name") == name) & (F.size("row") >= width))
    return r.select("ordinal", *[F.get("row", F.lit(k)).try_cast(t).alias(c) for k, (c, t) in enumerate(columns.items())])


def verse_lines(df: DataFrame, column: str) -> DataFrame:
    """SRC-05: a row for each verse line of a paragraph (parts between newline and [p]), trimmed, empty ones dropped; pos from 0."""
    parts = F.transform(F.split(column, r"\n\[p\]"), lambda x: F.trim(x))
    return df.select("*", F.posexplode(F.array_remove(parts, "")).alias("pos", "line"))


def document_lines(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Lines of plain texts: key, line_no from 1, line; blank lines count but have no row."""
    lines = df.select(key, F.posexplode(F.split(column, "\n")).alias("p", "line"))
    return lines.where(F.trim("line") != "").select(key, (F.col("p") + 1).alias("line_no"), "line")
