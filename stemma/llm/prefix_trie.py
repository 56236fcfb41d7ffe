"""Conversation prefix trie: how much of a corpus's turns conversations share, by leaf-peeling message passing.

Conversations are rebuilt with a head that they share with the first of their hundred, and every distinct beginning of the rebuilt ones is
a node. A node is named by its depth and the xor of 128-bit hashes of (depth, turn) along it, a running value that is taken over parts of
bounded length, so a long conversation is no task of its own. Nodes that belong to one conversation (their smallest member) follow each
other: they are a path that hangs on a node of another path. The trie is peeled by paths: a path holds a counter of the paths on it that
have not ended; when it is zero, the path sends its totals to the path above. Rounds end when the root's path has ended, after as many
as paths hang on each other, not as many as turns. A node's totals are then sums from the end of its path, messages included.

Hot beginnings are one row after a combining aggregate, and what is joined with them has been written before, so that adaptive execution
can split it. Digests of ids are made from runs of bounded length that are sorted over all tasks, then pass one task in order.

Defined cases: a null role or text is empty; turns go by turn, nulls first, ties by the MD5 digest of role and text; equal rows are turns
each; rows without a conv_id take no part; a conversation that has no turns after rebuilding belongs to the root alone; no
conversation at all gives no rows; other columns, whatever their names, are ignored. Sequences are compared by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import discard, materialize, tidy, to_batch
from stemma.operators.scan import PART, dealt, running

#: Turns of a conversation, or nodes of a path, whose running values one task takes; ids that are digested as one string.
STEP, RUN = 1024, 4096
#: A conversation takes at most GROUP - 1 others' head; the head has fewer turns than HEADS.
GROUP, HEADS = 100, 6


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text)))


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos from 1, digest, chars of each turn in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", _digest(role, text).alias("digest"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    order = ["turn", "digest", "row"]
    tables: list[DataFrame] = []

    def cut(df: DataFrame) -> DataFrame:
        tables.append(materialize(df, "turns"))
        return tables[-1]

    out = materialize(running(dealt(rows, ["conv_id"], order, cut), ["conv_id"], order, {"pos": ("count", F.lit(1))}).select("conv_id", "pos", "digest", "chars"), "placed")
    discard(*tables)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, length; their turns: conv_id, depth, digest, chars) with shared heads. turns: of placed_turns(), written."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    first = turns.where("pos = 1").select("conv_id", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    heads = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "base")
    known = heads.groupBy("base").agg(F.max("pos").alias("known"))
    convs = materialize(first.join(known, "base", "left").withColumn("shared", F.least("head", F.coalesce("known", F.lit(0)))).select("conv_id", "base", "head", "shared"), "convs")
    shared = convs.join(heads, "base").where("pos <= shared").select("conv_id", F.col("pos").alias("depth"), "digest", "chars")
    own = turns.join(convs, "conv_id").where("pos > head").select("conv_id", (F.col("pos") - F.col("head") + F.col("shared")).alias("depth"), "digest", "chars")
    return convs, shared.unionByName(own)


def trie(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: conv_id, depth, parent_conv_id, n_convs, chars; ends: conv_id and depth of each conversation's last node, member), both
    written. rows: conv_id, depth, digest, chars; convs: conv_id."""
    x = rows.select("conv_id", "depth", "chars", F.xxhash64("depth", "digest").alias("x1"), F.xxhash64("digest", "depth").alias("x2"), F.floor(F.col("depth") / STEP).alias(PART))
    x = materialize(x, "hashes")
    keyed = running(x, ["conv_id"], ["depth"], {"k1": ("xor", F.col("x1")), "k2": ("xor", F.col("x2"))}, few=False)
    keyed = materialize(keyed.select("conv_id", "depth", "chars", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2")), "keys")
    name = ["depth", "k1", "k2"]
    nodes = materialize(keyed.groupBy(*name).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.first("p1").alias("p1"), F.first("p2").alias("p2")), "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    root = convs.agg(F.min("conv_id").alias("id"), F.count("*").alias("n")).first()  # two numbers
    root_id = F.lit(root["id"]).cast("long")
    kept = ["conv_id", "depth", "parent_conv_id", "n_convs", "chars"]
    tree = nodes.where("depth > 1").join(above, ["depth", "p1", "p2"]).select(*kept)
    tree = tree.unionByName(nodes.where("depth = 1").withColumn("parent_conv_id", root_id).select(*kept))
    top = [(root["id"], 0, None, root["n"], 0)] if root["n"] else []
    tree = tree.unionByName(convs.sparkSession.createDataFrame(top, "conv_id long, depth long, parent_conv_id long, n_convs long, chars long"))
    last = materialize(keyed.groupBy("conv_id").agg(F.max(F.struct(*name)).alias("end")).select(F.col("conv_id").alias("member"), "end.*"), "last")
    ends = last.join(nodes.select(*name, "conv_id"), name).select("conv_id", "depth", "member")
    bare = convs.select(F.col("conv_id").alias("member")).join(last.select("member"), "member", "left_anti")
    ends = ends.unionByName(bare.select(root_id.alias("conv_id"), F.lit(0).cast("long").alias("depth"), "member"))
    out = materialize(tree, "tree"), materialize(ends, "ends")
    discard(x, keyed, nodes, last)
    return out


def peel(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, leaves, saved: what the paths that hang on a node send to it. nodes: conv_id, depth, parent_conv_id, own_leaves, own_saved."""
    paths = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "parent_conv_id")).alias("top"), F.sum("own_leaves").alias("leaves"), F.sum("own_saved").alias("saved"))
    paths = materialize(paths.select("conv_id", F.col("top.parent_conv_id").alias("above"), (F.col("top.depth") - 1).alias("at"), "leaves", "saved"), "paths")
    hang = paths.where("above IS NOT NULL").groupBy("above").agg(F.count("*").alias("open")).withColumnRenamed("above", "conv_id")
    waiting = materialize(paths.join(hang, "conv_id", "left").select(*paths.columns, F.coalesce("open", F.lit(0)).cast("long").alias("open")), "waiting")
    discard(paths)
    sent = None
    while True:
        done = materialize(waiting.where("open = 0 AND above IS NOT NULL").select("above", "at", "leaves", "saved"), "messages")
        rest = waiting.where("open > 0")
        if done.isEmpty():
            return sent if sent is not None else done.select(F.col("above").alias("conv_id"), F.col("at").alias("depth"), "leaves", "saved")
        got = done.groupBy("above").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("ended")).withColumnRenamed("above", "conv_id")
        plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
        left = rest.join(got, "conv_id", "left").select("conv_id", "above", "at", plus("leaves", "more_leaves"), plus("saved", "more_saved"), (F.col("open") - F.coalesce("ended", F.lit(0))).alias("open"))
        waiting, before = materialize(left, "waiting"), waiting
        discard(before)
        each = done.groupBy(F.col("above").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        sent = each if sent is None else sent.unionByName(each)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (conv_id, depth, member) as strings of at most RUN ids."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), (PART, pa.int32()), ("seq", pa.int64()), ("ids", pa.string())])
    held, ids, part, seq = None, [], 0, 0

    def flush() -> pa.RecordBatch:
        return to_batch({"conv_id": [held[0]], "depth": [held[1]], PART: [part], "seq": [seq], "ids": [",".join(ids)]}, schema)

    for b in batches:
        for c, d, m, p in zip(*(b.column(x).to_pylist() for x in ("conv_id", "depth", "member", PART)), strict=True):
            if held is not None and (held != (c, d) or len(ids) == RUN):
                yield flush()
                ids, seq = [], seq + 1
            held, part = (c, d), p
            ids.append(str(m))
    if held is not None:
        yield flush()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the runs of each node in order, joined by commas."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    held, state = None, None
    for b in batches:
        out = []
        for c, d, ids in zip(*(b.column(x).to_pylist() for x in ("conv_id", "depth", "ids")), strict=True):
            if held != (c, d):
                if held is not None:
                    out.append((*held, state.hexdigest()))
                held, state = (c, d), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield to_batch({f.name: [x[k] for x in out] for k, f in enumerate(schema)}, schema)
    if held is not None:
        yield to_batch({"conv_id": [held[0]], "depth": [held[1]], "ends_sha256": [state.hexdigest()]}, schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the ids of the conversations that end at each node."""
    n, order = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["conv_id", "depth", "member"]
    runs = ends.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(PART, F.spark_partition_id()).mapInArrow(tidy(_runs), f"conv_id long, depth long, {PART} int, seq long, ids string")
    return runs.repartition(n, "conv_id", "depth").sortWithinPartitions("conv_id", "depth", PART, "seq").mapInArrow(tidy(_hashed), "conv_id long, depth long, ends_sha256 string")


def trie_report(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    turns = placed_turns(conversations)
    convs, rows = rebuilt(turns)
    tree, ends = trie(rows, convs)
    discard(turns)
    children = tree.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    own = tree.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    own = materialize(own.withColumn("own_leaves", (F.col("n_children") == 0).cast("long")).withColumn("own_saved", (F.col("n_convs") - 1) * F.col("chars")), "own")
    discard(tree)
    both = own.join(peel(own).groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), ["conv_id", "depth"], "left")
    up = both.withColumn("up", -F.col("depth")).withColumn(PART, F.floor(-F.col("depth") / STEP))
    total = lambda a, b: ("sum", F.col(a) + F.coalesce(F.col(b), F.lit(0)))
    summed = running(materialize(up, "up"), ["conv_id"], ["up"], {"n_leaves": total("own_leaves", "leaves"), "saved_tokens": total("own_saved", "saved")}, few=False)
    out = summed.join(end_digests(ends), ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


#: CRC-32 of decimal digits, bit by bit.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({x}, ''), lambda c: ord(c)::UBIGINT)), lambda a, b:
 list_reduce(list_prepend(xor(a, b), range(8)::UBIGINT[]), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))))"""

ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT conv_id, list({{'r': r, 't': t}} ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || ':' || t)) AS s FROM c GROUP BY 1),
h AS (SELECT conv_id, s, ({CRC.format(x='conv_id::VARCHAR')} % 6)::INT AS h FROM b),
r AS (SELECT x.conv_id, list_concat(CASE WHEN y.conv_id IS NULL THEN [] ELSE y.s[1:x.h] END, x.s[x.h + 1:]) AS s FROM h x LEFT JOIN b y ON y.conv_id = x.conv_id - x.conv_id % 100),
p AS (SELECT conv_id, len(s) AS l, unnest(range(0, len(s) + 1)) AS depth, s FROM r),
n AS (SELECT s[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(any_value(length(s[depth]['t'])), 0) AS own,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (l = depth), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
k AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
t AS (SELECT a.p, count(*) FILTER (NOT EXISTS (SELECT 1 FROM k WHERE k.p = d.p)) AS n_leaves, sum(d.own) AS saved FROM n a JOIN n d ON d.depth >= a.depth AND d.p[1:a.depth] = a.p GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, t.n_leaves, t.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN t ON t.p = n.p LEFT JOIN k ON k.p = n.p LEFT JOIN n u ON n.depth > 0 AND u.p = n.p[1:n.depth - 1]
"""
