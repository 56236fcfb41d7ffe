"""Conversation structure repair: the cheapest edits that give each conversation an order of speakers, by a time-major tensor program.

A row may be kept, rewritten to another role or deleted, and empty turns may be inserted; what is left must read (system)? (user
assistant)+, or nothing. Costs are those of four states: nothing yet, after the system's turn, after a user's, after an assistant's.
Conversations of a task are bucketed by length into arrays (turn, conversation); all states of a bucket go back one turn at a time, costs
are stored, and edits are traced forward, all conversations at once.

Rows are dealt to range partitions of conversation and turn, so a conversation of any size is spread. Conversations that lie within one
partition are repaired where they lie. Those at its edges, or over SEGMENT rows, become segments of bounded rows and bytes: a segment's
costs are a matrix from entry to exit states under (min, +), matrices are applied from the last to the first, each segment is then
traced for all four entry states, and the states are followed from the first to the last. Only these small rows, and the repaired
text for its digest, pass through one task for each conversation, as streams.

Defined cases: a null role or text is one space, in the key of the damage a null id or turn too; turns go by turn, nulls first, ties by
the MD5 digest of the damaged role and text; equal rows are turns each; rows with a null conv_id are one conversation; an id of which all
rows were dropped is returned with zeros; empty tables give no rows; other columns, whatever their names, are ignored. Roles and texts
are compared by their 128-bit digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import materialize, tidy, to_batch

#: Rows and bytes of a segment; rows and bytes that are repaired at once.
SEGMENT, SEGMENT_BYTES = 4096, 2_000_000
BLOCK, BLOCK_BYTES = 32_768, 16_000_000

#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. An inserted or rewritten turn leads to STEP; keeping a row of
#: initial s, u, a or another one leads to KEEP, -1 where it may not stand; from a state at the end, END is what inserted turns cost.
STEP, END = np.array([2, 2, 3, 2]), np.array([0, 4, 2, 0])
KEEP = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
NEVER = 1 << 40
WHITE = " \t\n\x0b\x0c\r"

ROW = "turn long, digest binary, role string, text string, initial int, blank boolean, cut boolean"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = ", ".join(["key string", *[f"{c} long" for c in COUNTS], "audit string", "repaired_sha256 string"])


# ---- rows


def damaged(conversations: DataFrame) -> DataFrame:
    """key (the id, or a space), turn, role, text, gone (of a dropped row) of the rows after damage by the checksum of id and turn."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    rows = conversations.select(some("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), some("role").alias("role"), some("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    again = F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1)))
    return rows.select("key", "turn", role.alias("role"), text.alias("text"), (F.col("code") == 0).alias("gone"), again.alias("_copy")).drop("_copy")


def _described(rows: DataFrame) -> DataFrame:
    """Rows with what the program asks of each: its digest, its initial as a number, whether it is blank or cut off."""
    stripped = F.rtrim("text", F.lit(WHITE))
    initial: Column = F.coalesce(F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1)), F.lit(0)).cast("int")
    return rows.select(
        "key", "turn", F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))).alias("digest"), "role", "text", F.when(initial == 0, 3).otherwise(initial - 1).alias("initial"),
        (stripped == "").alias("blank"), (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("cut"), "gone", F.monotonically_increasing_id().alias("row"),
    )


# ---- the program on one bucket: arrays (turn, conversation), padded at their ends


def costs(initial: np.ndarray, dead: np.ndarray, cut: np.ndarray, pad: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What is still to pay before each turn in each state, (turn + 1, conversation, state); end: after the last turn."""
    t, n = initial.shape
    v = np.empty((t + 1, n, 4), dtype=np.int64)
    v[t] = end
    for k in range(t - 1, -1, -1):
        after = v[k + 1]
        to = KEEP[initial[k]]
        kept = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 1), NEVER)
        stay = np.minimum(kept, after[:, STEP] + 2) + cut[k][:, None]
        b = np.minimum(after + 3, np.where(dead[k][:, None], NEVER, stay))
        b = np.minimum(b, np.minimum(b[:, STEP] + 2, b[:, STEP[STEP]] + 4))
        v[k] = np.where(pad[k][:, None], after, b)
    return v


def trace(v: np.ndarray, initial: np.ndarray, dead: np.ndarray, cut: np.ndarray, pad: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edits as letters, (turn, conversation, 3), 0 where there is none; the states at the end): of the cheapest edits the least ones."""
    t, n = initial.shape
    out, at = np.zeros((t, n, 3), dtype=np.uint8), np.arange(n)
    state = state.copy()
    for k in range(t):
        now, after, open_ = v[k], v[k + 1], ~pad[k]
        for j in range(3):
            left = now[at, state]
            drop = open_ & (after[at, state] + 3 == left)
            put = open_ & ~drop & (now[at, STEP[state]] + 2 == left) if j < 2 else np.zeros(n, dtype=bool)
            out[k, put, j] = ord("I")
            to = KEEP[initial[k], state]
            use = open_ & ~drop & ~put
            keep = use & ~dead[k] & (to >= 0) & (after[at, np.maximum(to, 0)] + cut[k] == left)
            out[k, drop, 2], out[k, keep, 2], out[k, use & ~keep, 2] = ord("D"), ord("K"), ord("R")
            state = np.where(keep, to, np.where(put | (use & ~keep), STEP[state], state))
            open_ = put
            if not put.any():
                break
    return out, state


class Rows:
    """Rows of several conversations, one after the other, with their faults."""

    def __init__(self, table: pa.StructArray | pa.Table, lengths: np.ndarray, seen: list[set[bytes]] | None = None):
        get = (lambda c: table.column(c).combine_chunks()) if isinstance(table, pa.Table) else table.field
        self.n, self.lengths, self.starts = len(table), lengths, np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
        whose = np.repeat(np.arange(len(lengths)), lengths)
        self.initial = get("initial").to_numpy(zero_copy_only=False).astype(np.int64)
        self.blank = get("blank").to_numpy(zero_copy_only=False).astype(bool)
        self.role, self.text, self.turn = get("role"), get("text"), get("turn")
        digests = get("digest").to_pylist()
        first: dict[tuple[int, bytes], int] = {}
        again = np.fromiter((first.setdefault((w, d), k) != k or bool(seen) and d in seen[w] for k, (w, d) in enumerate(zip(whose.tolist(), digests, strict=True))), dtype=bool, count=self.n)
        self.again = again & ~self.blank
        self.cut = get("cut").to_numpy(zero_copy_only=False).astype(bool) & ~self.blank & ~self.again
        self.dead = self.blank | self.again

    def buckets(self, copies: int = 1) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
        """(conversations, their arrays) by length up to a power of two; each conversation stands there so many times."""
        size = np.ceil(np.log2(np.maximum(self.lengths, 1))).astype(int)
        for s in np.unique(size):
            which = np.flatnonzero(size == s)
            t = int(self.lengths[which].max())
            place = np.arange(t)[:, None]
            pad = place >= self.lengths[which][None, :]
            index = np.where(pad, 0, self.starts[which][None, :] + place)
            pick = (lambda x: np.repeat(x[index] if self.n else np.zeros(index.shape, x.dtype), copies, axis=1))  # noqa: E731, B023
            yield which, (pick(self.initial), pick(self.dead), pick(self.cut), np.repeat(pad, copies, axis=1))

    def counts(self, k: int) -> dict:
        """Faults of a conversation's rows, and what is needed to count over its borders."""
        a, b = int(self.starts[k]), int(self.starts[k] + self.lengths[k])
        i = self.initial[a:b]
        pairs = i[:-1] * 4 + i[1:]
        turns = [x for x in self.turn.slice(a, b - a).to_pylist() if x is not None]
        out = {"blank": int(self.blank[a:b].sum()), "duplicate": int(self.again[a:b].sum()), "truncated": int(self.cut[a:b].sum()), "illegal": int((~np.isin(pairs, LEGAL)).sum())}
        return out | {"first_turn": min(turns, default=None), "last_turn": max(turns, default=None), "turns": len(set(turns)), "first": int(i[0]) if b > a else None, "last": int(i[-1]) if b > a else None}

    def repaired(self, k: int, audit: str, state: int) -> list[str]:
        """The turns that the edits leave, as role:text."""
        out, at = [], int(self.starts[k])
        for edit in audit:
            if edit == "D":
                at += 1
                continue
            keep = edit == "K"
            state = int(KEEP[self.initial[at], state] if keep else STEP[state])
            role = self.role[at].as_py() if keep else "assistant" if state == 3 else "user"
            out.append(f"{role}:{'' if edit == 'I' else self.text[at].as_py()}")
            at += edit != "I"
        return out


LEGAL = [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]


def letters(edits: np.ndarray) -> list[str]:
    """The edits of each conversation as a string."""
    flat = np.ascontiguousarray(edits.transpose(1, 0, 2)).reshape(edits.shape[1], -1)
    return [row.tobytes().replace(b"\0", b"").decode() for row in flat]


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else last - first + 1 - turns


def solve(table: pa.Table, lengths: np.ndarray) -> list[dict]:
    """Results of whole conversations."""
    rows = Rows(table, lengths)
    out: list[dict] = [{}] * len(lengths)
    for which, (initial, dead, cut, pad) in rows.buckets():
        start = np.zeros(len(which), dtype=np.int64)
        v = costs(initial, dead, cut, pad, END)
        edits, state = trace(v, initial, dead, cut, pad, start)
        for k, w, text, q in zip(range(len(which)), which.tolist(), letters(edits), state.tolist(), strict=True):
            audit = text + "I" * int(END[q] // 2)
            c = rows.counts(w)
            body = "\n".join(rows.repaired(w, audit, 0))
            out[w] = {x: c.get(x) for x in COUNTS} | {"gaps": _gaps(c["first_turn"], c["last_turn"], c["turns"]), "cost": int(v[0, k, 0]), "audit": audit, "repaired_sha256": hashlib.sha256(body.encode()).hexdigest()}
    return out


# ---- first pass: what lies within a partition is solved, the rest becomes segments

FIELDS = ["turn", "digest", "role", "text", "initial", "blank", "cut"]
FIRST = RESULT + f", part int, seq long, rows array<struct<{ROW}>>"


def _first_pass(schema: pa.Schema) -> Callable:
    row_type = schema.field("rows").type.value_type
    row_schema = pa.schema(list(row_type))

    def batch(**columns: list | pa.Array) -> pa.RecordBatch:
        n = len(columns["key"])
        return to_batch({f.name: columns.get(f.name, [None] * n) for f in schema}, schema)

    def segment(key: str, part: int, seq: int, rows: pa.Table) -> pa.RecordBatch:
        values = pa.StructArray.from_arrays([rows.column(f.name).combine_chunks().cast(f.type) for f in row_schema], fields=list(row_schema))
        return batch(key=[key], part=[part], seq=[seq], rows=pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(schema.field("rows").type))

    def pieces(rows: pa.Table) -> Iterator[pa.Table]:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(rows.column("text")), 0).to_numpy().astype(np.int64) + 64)
        a = 0
        while a < rows.num_rows:
            over = int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + SEGMENT_BYTES, side="right"))
            b = max(a + 1, min(over, a + SEGMENT))
            yield rows.slice(a, b - a)
            a = b
        if not rows.num_rows:
            yield rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        edge, seq = None, 0  # the conversation that is in segments: the first of the partition, and any that was cut

        def work(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, edge, seq
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column("key").to_pylist()
            bounds = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            edge = keys[0] if edge is None else edge
            whole: list[tuple[int, int]] = []
            held = []
            for a, b in zip(bounds, bounds[1:], strict=False):
                rows, last = table.slice(a, b - a), b == len(keys)
                if last and not final and keys[a] != edge and rows.num_rows < SEGMENT and rows.nbytes < SEGMENT_BYTES:
                    held = rows.to_batches()
                elif last or keys[a] == edge or rows.num_rows > SEGMENT or rows.nbytes > SEGMENT_BYTES:
                    edge = keys[a]
                    for x in pieces(rows.filter(pc.invert(rows.column("gone")))):
                        yield segment(keys[a], rows.column("part")[0].as_py(), seq, x)
                        seq += 1
                else:
                    whole.append((a, b))
            if whole:
                live = pc.invert(table.column("gone")).to_numpy().astype(bool)
                mask = np.zeros(table.num_rows, dtype=bool)
                for a, b in whole:
                    mask[a:b] = live[a:b]
                lengths = np.array([mask[a:b].sum() for a, b in whole], dtype=np.int64)
                own = table.filter(pa.array(mask)).select(FIELDS)
                found = solve(own, lengths)
                yield batch(key=[keys[a] for a, _ in whole], **{c: [x[c] for x in found] for c in (*COUNTS, "audit", "repaired_sha256")})

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= BLOCK or sum(x.nbytes for x in held) >= BLOCK_BYTES:
                yield from work(False)
        if held:
            yield from work(True)

    return run


# ---- conversations in segments

PLACE = ["key", "part", "seq"]


def _listed(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def _segments(b: pa.RecordBatch) -> Rows:
    """The segments of a batch as rows, with what earlier segments hold."""
    lists = b.column("rows")
    lengths = np.array([len(x) for x in lists.to_pylist()] if lists.null_count else np.diff(lists.offsets.to_numpy()), dtype=np.int64)
    return Rows(lists.flatten(), lengths, [set(x or ()) for x in b.column("seen").to_pylist()])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's costs from entry state (row) to exit state (column)."""
    for b in batches:
        rows = _segments(b)
        out: list[list[int]] = [[]] * b.num_rows
        for which, arrays in rows.buckets(4):
            end = np.where(np.eye(4, dtype=bool), 0, NEVER)  # a copy for each exit state
            v = costs(*arrays, np.tile(end, (len(which), 1)))[0].reshape(len(which), 4, 4).transpose(0, 2, 1)
            for k, w in enumerate(which):
                out[w] = np.minimum(v[k], NEVER).ravel().tolist()
        yield pa.RecordBatch.from_arrays([b.column(c) for c in PLACE] + [_listed(out, pa.int64())], names=[*PLACE, "matrix"])


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a conversation's last segment to its first: what is to pay after each."""
    held, v = None, END
    for b in batches:
        after = []
        for key, m in zip(b.column("key").to_pylist(), b.column("matrix").to_pylist(), strict=True):
            if key != held:
                held, v = key, END
            after.append(v.tolist())
            v = np.minimum((np.array(m).reshape(4, 4) + v[None, :]).min(axis=1), NEVER)
        yield pa.RecordBatch.from_arrays([b.column(c) for c in PLACE] + [_listed(after, pa.int64())], names=[*PLACE, "after"])


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits, exit state and cost of each segment for each entry state."""
    for b in batches:
        rows, after = _segments(b), np.array(b.column("after").to_pylist(), dtype=np.int64)
        audits, exits, due = ([[]] * b.num_rows for _ in range(3))
        for which, arrays in rows.buckets(4):
            v = costs(*arrays, np.repeat(after[which], 4, axis=0))
            edits, state = trace(v, *arrays, np.tile(np.arange(4), len(which)))
            text = letters(edits)
            for k, w in enumerate(which):
                audits[w], exits[w], due[w] = text[4 * k : 4 * k + 4], state[4 * k : 4 * k + 4].tolist(), np.diagonal(v[0, 4 * k : 4 * k + 4]).tolist()
        yield pa.RecordBatch.from_arrays([b.column(c) for c in PLACE] + [_listed(audits, pa.string()), _listed(exits, pa.int64()), _listed(due, pa.int64())], names=[*PLACE, "audits", "exits", "due"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the first segment to the last: the state in which each is entered, its edits, and the conversation's cost at its first."""
    held, q = None, 0
    for b in batches:
        entry, audit, cost = [], [], []
        for key, audits, exits, due in zip(*(b.column(c).to_pylist() for c in ("key", "audits", "exits", "due")), strict=True):
            cost.append(0 if key == held else due[0])
            if key != held:
                held, q = key, 0
            entry.append(q)
            audit.append(audits[q])
            q = exits[q]
        yield pa.RecordBatch.from_arrays([b.column(c) for c in PLACE] + [pa.array(entry, pa.int32()), pa.array(audit, pa.string()), pa.array(cost, pa.int64())], names=[*PLACE, "entry", "audit", "cost"])


FACTS = {"blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "first_turn": pa.int64(), "last_turn": pa.int64(), "turns": pa.int64(), "first": pa.int64(), "last": pa.int64()}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns and the counts of each segment."""
    for b in batches:
        rows = _segments(b)
        facts = [rows.counts(k) for k in range(b.num_rows)]
        bodies = [rows.repaired(k, a, q) for k, (a, q) in enumerate(zip(b.column("audit").to_pylist(), b.column("entry").to_pylist(), strict=True))]
        text = pa.array([None if not x else "\n".join(x) for x in bodies], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(c) for c in (*PLACE, "entry", "audit", "cost")] + [text, *[pa.array([f[c] for f in facts], t) for c, t in FACTS.items()]], names=[*PLACE, "entry", "audit", "cost", "body", *FACTS])


def _joined(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A conversation's pieces in order: digest, edits and counts as one row. Of its texts one piece at a time is held."""
        one: dict | None = None

        def result() -> dict:
            ends = "I" * int(END[one["state"]] // 2)
            for turn in [] if not ends else ["assistant:"] if one["state"] == 2 else ["user:", "assistant:"]:
                add(turn)
            return {c: one[c] for c in ("key", "blank", "duplicate", "truncated", "illegal", "cost")} | {"gaps": _gaps(one["low"], one["high"], one["turns"]), "audit": "".join(one["audit"]) + ends, "repaired_sha256": one["hash"].hexdigest()}

        def add(body: str) -> None:
            one["hash"].update(b"\n" * one["any"] + body.encode())
            one["any"] = True

        for b in batches:
            out = []
            for x in b.to_pylist():
                if one is None or x["key"] != one["key"]:
                    if one is not None:
                        out.append(result())
                    one = {"key": x["key"], "audit": [], "hash": hashlib.sha256(), "any": False, "low": None, "high": None, "turns": 0, "last": None, "state": 0} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
                for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    one[c] += x[c]
                one["audit"].append(x["audit"])
                if x["body"] is not None:
                    add(x["body"])
                if x["first"] is not None:
                    one["illegal"] += one["last"] is not None and one["last"] * 4 + x["first"] not in LEGAL
                    one["last"] = x["last"]
                if x["first_turn"] is not None:
                    one["turns"] += x["turns"] - (one["high"] == x["first_turn"])
                    one["low"] = x["first_turn"] if one["low"] is None else one["low"]
                    one["high"] = x["last_turn"]
                one["state"] = x["exit"]
            yield to_batch({f.name: [x[f.name] for x in out] for f in schema}, schema)
        if one is not None:
            last = result()
            yield to_batch({f.name: [last[f.name]] for f in schema}, schema)

    return run


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _in_segments(segments: DataFrame) -> DataFrame:
    """Results of the conversations that are in segments: key, part, seq, rows."""
    spark = segments.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.struct("part", "seq")
    digests = segments.select(*PLACE, F.explode(F.array_distinct(F.transform("rows", lambda r: r["digest"]))).alias("digest"))
    firsts = digests.groupBy("key", "digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "digest", "first")
    seen = digests.join(materialize(firsts, "firsts"), ["key", "digest"]).where(order > F.col("first")).groupBy(*PLACE).agg(F.collect_list("digest").alias("seen"))
    known = materialize(segments.join(seen, PLACE, "left"), "segments")
    stream = lambda df, *by: df.repartition(n, "key").sortWithinPartitions(*by)
    place = "key string, part int, seq long, "
    matrices = known.select(*PLACE, "rows", "seen").mapInArrow(tidy(_matrices, 64), place + "matrix array<long>")
    after = stream(matrices, "key", F.desc("part"), F.desc("seq")).mapInArrow(tidy(_backward), place + "after array<long>")
    traced = known.join(after, PLACE).mapInArrow(tidy(_traces, 64), place + "audits array<string>, exits array<long>, due array<long>")
    traced = materialize(traced, "traces")
    chosen = materialize(stream(traced, *PLACE).mapInArrow(tidy(_forward), place + "entry int, audit string, cost long"), "edits")
    exits = traced.join(chosen.select(*PLACE, "entry"), PLACE).select(*PLACE, F.get("exits", F.col("entry")).cast("int").alias("exit"))
    kinds = ", ".join(f"{c} long" for c in FACTS)
    pieces = known.join(chosen, PLACE).mapInArrow(tidy(_pieces, 64), place + f"entry int, audit string, cost long, body string, {kinds}").join(exits, PLACE)
    return stream(pieces, *PLACE).mapInArrow(tidy(_joined(_arrow(spark, RESULT)), 16), RESULT)


def repair_report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each damaged conversation."""
    spark = conversations.sparkSession
    n, order = int(spark.conf.get("spark.sql.shuffle.partitions")), ["key", "turn", "digest", "row"]
    rows = _described(damaged(conversations)).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).drop("row")
    first = materialize(rows.mapInArrow(tidy(_first_pass(_arrow(spark, FIRST))), FIRST), "first-pass")
    whole = [c.split()[0] for c in RESULT.split(", ")]
    done = first.where("rows IS NULL").select(*whole)
    rest = _in_segments(first.where("rows IS NOT NULL").select(*PLACE, "rows"))
    return done.unionByName(rest).select(F.expr("try_cast(key AS bigint)").alias("conv_id"), *whole[1:])


def _plus(s: str, cost: str, letter: str) -> str:
    return f"(lpad((substr({s}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({s}, 10) || '{letter}')"


def _closed(s: str) -> dict[str, str]:
    """The four states' least (cost, audit), with turns inserted."""
    two = f"least({s}.s2, {_plus(s + '.s0', '2', 'I')}, {_plus(s + '.s1', '2', 'I')})"
    return {"i0": f"{s}.s0", "i1": f"{s}.s1", "i2": f"least({two}, {_plus(s + '.s3', '2', 'I')})", "i3": f"least({s}.s3, {_plus(two, '2', 'I')})"}


def oracle() -> str:
    from stemma.llm.prefix_trie import CRC

    live = lambda x: f"CASE WHEN NOT dead THEN {x} END"
    front = "least(i0, i1, i3)"
    return f"""
WITH RECURSIVE w AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS x FROM conversations),
c AS (SELECT *, ({CRC.format(x='x')} % 20)::INT AS code FROM w),
m AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || ':' || text)) AS k, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM m),
p AS (SELECT *, t = '' AS blank, t <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS dup, substr(role, 1, 1) AS x FROM o),
f AS (SELECT *, blank OR dup AS dead, NOT blank AND NOT dup AND substr(t, length(t), 1) NOT IN ('.', '!', '?') AS cut FROM p),
a AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, '000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM conversations
 UNION ALL SELECT conv_id, k, {_plus('i0', '3', 'D')}, least({_plus('i1', '3', 'D')}, {live("CASE WHEN x = 's' THEN " + _plus('i0', 'cut::INT', 'K') + " END")}),
  least({_plus('i2', '3', 'D')}, {live("CASE WHEN x = 'u' THEN " + _plus(front, 'cut::INT', 'K') + " END")}, {live(_plus(front, '(2 + cut::INT)', 'R'))}),
  least({_plus('i3', '3', 'D')}, {live("CASE WHEN x = 'a' THEN " + _plus('i2', 'cut::INT', 'K') + " END")}, {live(_plus('i2', '(2 + cut::INT)', 'R'))})
 FROM (SELECT f.*, {", ".join(f"{v} AS {k}" for k, v in _closed('a').items())} FROM a JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id AND f.k = a.k + 1)),
z AS (SELECT conv_id, least({_closed('a')['i0']}, {_closed('a')['i3']}) AS best FROM a QUALIFY k = max(k) OVER (PARTITION BY conv_id)),
e AS (SELECT conv_id, substr(best, 10) AS audit, unnest(range(1, length(best) - 8)) AS j FROM z),
g AS (SELECT e.conv_id, j, substr(audit, j, 1) AS edit, length(replace(substr(audit, 1, j), 'D', '')) AS place, f.role, f.text, f.x FROM e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.k = length(replace(substr(audit, 1, j), 'I', ''))),
s AS (SELECT conv_id, count(*) AS s FROM g WHERE place = 1 AND edit = 'K' AND x = 's' GROUP BY 1),
h AS (SELECT g.conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - coalesce(s, 0)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS body FROM g LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM g.conv_id WHERE edit <> 'D' GROUP BY 1),
q AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS dup, count(*) FILTER (cut) AS cut FROM f GROUP BY 1),
l AS (SELECT conv_id, count(*) AS illegal FROM (SELECT conv_id, x || lead(x) OVER (PARTITION BY conv_id ORDER BY k) AS pair, lead(k) OVER (PARTITION BY conv_id ORDER BY k) AS nx FROM f) WHERE nx IS NOT NULL AND pair NOT IN ('su', 'ua', 'au') GROUP BY 1)
SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(q.blank, 0)::BIGINT AS blank, coalesce(dup, 0)::BIGINT AS duplicate, coalesce(q.cut, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, substr(best, 1, 9)::BIGINT AS cost, substr(best, 10) AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM z LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM z.conv_id
"""
