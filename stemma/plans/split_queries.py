"""Dumps and long texts that are read by splits (SRC-01..03, SRC-23..26)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.operators.scan import parts_for
from stemma.plans.registry import Tables, query
from stemma.session import scratch
from stemma.sources import ocr, splits


def _dump(t: Tables) -> str:
    """A dump of documents, five to a statement, with comments between them, in several files."""
    quoted = F.concat(F.lit("'"), F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))
    row = F.concat(F.lit("("), F.col("doc_id").cast("string"), F.lit(",'"), F.coalesce("lang", F.lit("")), F.lit("',"), F.coalesce(quoted, F.lit("NULL")), F.lit(")"))
    rows = t.documents.select(F.floor(F.col("doc_id") / 5).alias("g"), "doc_id", row.alias("row")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("doc_id", "row"))).alias("r"))
    text = F.concat(F.lit("-- documents; it's \"one\" of them\nINSERT INTO `documents` VALUES "), F.array_join(F.transform("r", lambda x: x["row"]), ",\n"), F.lit("; /* a ' and ; */"))
    path = scratch(t.spark, "dump")
    rows.select(text).write.text(path)
    return path


@query("SELECT doc_id, lang, text FROM documents")
def dump_by_split(t: Tables) -> DataFrame:
    """SRC-01..04: documents written as a dump and read back by splits, whatever quotes, semicolons and line ends are in their texts."""
    rows = splits.read_dump_by_split(t.spark, _dump(t)).where("table_name = 'documents'")
    return rows.select(F.get("row", F.lit(0)).try_cast("long").alias("doc_id"), F.get("row", F.lit(1)).alias("lang"), F.get("row", F.lit(2)).alias("text"))


VOLUME = """WITH l AS (SELECT o_orderkey * 2 AS k, 'w' || chr((97 + o_orderkey % 26)::INT) || 'x: see ' || o_orderpriority AS line FROM orders
UNION ALL SELECT o_orderkey * 2 + 1, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 1000)::VARCHAR ELSE '  and ' || o_orderpriority END FROM orders)"""


@query(f"""{VOLUME}, n AS (SELECT *, line LIKE 'w_x: see %' AS s FROM l WHERE NOT regexp_full_match(trim(line), '[0-9]+')),
e AS (SELECT k, line, sum(s::INT) OVER (ORDER BY k, line ROWS UNBOUNDED PRECEDING) AS entry FROM n)
SELECT substr(min(line) FILTER (line LIKE 'w_x: see %'), 1, 3) AS headword, regexp_replace(string_agg(line, chr(10) ORDER BY k, line), '^\\s+|\\s+$', '', 'g') AS raw_text FROM e GROUP BY entry""")
def volume_entries(t: Tables) -> DataFrame:
    """SRC-23, OTH-01, OTH-02: one long volume made of orders, written as text in files that follow each other, read by splits, its lines numbered and cut into entries."""
    key, note = F.col("o_orderkey"), F.col("o_orderpriority")
    head = t.orders.select((key * 2).alias("k"), F.concat(F.lit("w"), F.chr(97 + key % 26), F.lit("x: see "), note).alias("line"))
    more = t.orders.select((key * 2 + 1).alias("k"), F.when(key % 3 == 0, (key % 1000).cast("string")).otherwise(F.concat(F.lit("  and "), note)).alias("line"))
    path = scratch(t.spark, "volume")
    lines = head.unionByName(more)
    lines.repartitionByRange(parts_for(lines), "k", "line").sortWithinPartitions("k", "line").select("line").write.text(path)
    return ocr.reference_entries(splits.numbered_lines(t.spark, path, one=True), "glossary").select("headword", "raw_text")
