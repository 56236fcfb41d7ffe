"""Exact n-gram Jaccard join by universe partition and the pigeonhole principle.

A document's set holds the hashes of its distinct word shingles. Sets whose similarity reaches the bound differ in at most
H tokens, H = (x + y) / 9 for sizes x <= y <= x / 0.8. For each band of sizes the universe of tokens is dealt into
segments by hash. A segment has threshold 0 (its subset is indexed) or 1 (its one-deletion neighbourhood is indexed too);
thresholds t with sum(t + 1) = H + 1 + slack make any similar pair agree, within its threshold, on segments of weight
slack + 1 at least. allocate() chooses the thresholds of a band by the signatures that they send. The slack lets every set drop its most frequent signatures, up to that weight: the rarest signature that a
pair shares is among the most frequent of neither, so no pair is lost.

Equal sets are one class from the start, named by 64 bits of their digest; signatures go to shards in packed batches, and a
shard groups its signatures by sorting. What is left after the drop makes groups. Groups of up to GROUP classes give their
pairs. In larger ones a task draws in a block of classes at a time, then one class of each component is compared with one of another,
links between components are contracted each time, and what is still apart within a group is compared in blocks. Pairs are screened by parity bitmaps, a bound that loses none, and verified
on the whole sets; only pairs known to be connected are left out.

Defined cases: null, empty and blank texts have empty sets and link with nothing; texts of fewer words than a shingle have
one shingle; rows with a null doc_id are returned with a null component and link with nothing; equal rows are returned each;
an empty table gives no rows; other columns are ignored or, by keep_first(), kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.llm.common import discard, materialize, small_side, tidy, tidy_group, to_batch
from stemma.llm.components import components

WORDS = 5
#: Groups of up to so many classes give all their pairs; larger ones go the way of memberships.
GROUP = 8
#: Classes in a block of the last comparison, bytes of signatures in a shard, and bits of a parity bitmap.
BLOCK, SHARD_BYTES, BITS = 512, 12_000_000, 2048
#: Rounds in which components within large groups are compared by stars before they are compared by blocks.
STARS = 2
#: Classes that one task draws in, with their whole sets; sets of so many tokens (800 KB) wait for the stars.
DRAWN, LONG = 128, 100_000
#: Classes whose ids may be broadcast (8 MB of ids); above that the join is shuffled.
BROADCAST_IDS = 500_000
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text: A-Z in lower case, words apart by ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only ASCII is touched
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)
    n = len(h)
    if n < WORDS:
        return mix((h * _C[:n]).sum(dtype=np.uint64, keepdims=True), n)
    total = h[: n - WORDS + 1] * _C[0]
    for k in range(1, WORDS):
        total += h[k : n - WORDS + 1 + k] * _C[k]
    return np.unique(mix(total, WORDS))


def digest(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b""


def similar(common: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether 100 * intersection >= 80 * union."""
    return 100 * common >= 80 * (x + y - common)


# Bands of sizes: EDGES[k] <= size < EDGES[k + 1]. Sets of fewer than four tokens are similar to equal ones only.
EDGES = [4]
while EDGES[-1] < 2**40:
    EDGES.append(max(EDGES[-1] + 1, EDGES[-1] * 5 // 4))
EDGES = np.array(EDGES, dtype=np.int64)


def band_of(n) -> np.ndarray:
    return np.searchsorted(EDGES, n, side="right") - 1


def bands_of(n: int) -> range:
    """The bands of a set of n tokens: its own, and those of smaller sets that it may be similar to."""
    return range(max(0, int(band_of(-(-4 * n // 5)))), int(band_of(n)) + 1)


def allocate(band: int, sets: int) -> tuple[int, int, int]:
    """(segments of threshold 0, segments of threshold 1, slack) of a band: those that send the fewest signatures, however many sets it holds.

    Groups bound the candidates of a signature, so what is sent need not grow with the sets; signatures of threshold 1 are not dropped."""
    top = int(EDGES[band + 1]) - 1
    need = (top + top * 5 // 4) // 9 + 1
    slack = math.ceil(0.5 * need) if need > 1 else 0
    best = None
    for share in (0.0, 0.25, 0.5, 1.0):
        ones = int((need + slack) * share / 2)
        zeros = need + slack - 2 * ones
        signatures = zeros + ones * (1 + top / (zeros + ones))
        if best is None or signatures < best[0]:
            best = (signatures, zeros, ones, slack)
    return best[1:]


def signatures(s: np.ndarray, plan: dict[int, tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set and their tags (band, and 128 if it may not be dropped). The lowest bit of a signature tells
    deletions (1) from subsets (0)."""
    sigs, tags = [], []
    for band in bands_of(len(s)):
        zeros, ones, _ = plan[band]
        m = zeros + ones
        seg = mix(s, 11) % np.uint64(m)
        value = mix(s, 12)
        order = np.argsort(seg, kind="stable")
        seg, value = seg[order], value[order]
        starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        sums = np.zeros(m, dtype=np.uint64)
        sums[seg[starts]] = np.add.reduceat(value, starts)
        base = np.arange(m, dtype=np.uint64) + np.uint64(band << 40)
        sigs.append(mix(sums + mix(base, 13), 14) & ~np.uint64(1))
        tags.append(np.where(np.arange(m) < zeros, band, band | 128).astype(np.uint8))
        if ones:
            part = seg >= np.uint64(zeros)
            less = sums[seg[part]] - value[part]
            sigs.append(mix(less + mix(base[seg[part]], 13), 14) | np.uint64(1))
            tags.append(np.full(len(less), band | 128, dtype=np.uint8))
    return np.concatenate(sigs), np.concatenate(tags)


def shortened(sig: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shards, five bytes) of signatures: what the shard does not tell already, cut to 39 bits, and the lowest bit. Different signatures that
    fall together make candidates only."""
    key = sig >> np.uint64(1)
    rest = ((key // np.uint64(shards) & np.uint64(2**39 - 1)) << np.uint64(1)) | (sig & np.uint64(1))
    return (key % np.uint64(shards)).astype(np.int64), rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def restored(rest: np.ndarray, shard: int, shards: int) -> np.ndarray:
    """Signatures of one shard from their bytes: one number for each of shortened()'s, the lowest bit as it was."""
    wide = np.zeros((len(rest) // 5, 8), dtype=np.uint8)
    wide[:, :5] = rest.reshape(-1, 5)
    value = wide.view("<u8").ravel().astype(np.uint64)
    return (((value >> np.uint64(1)) * np.uint64(shards) + np.uint64(shard)) << np.uint64(1)) | (value & np.uint64(1))


# ---- passes over the documents


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])
    for batch in batches:
        sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
        yield to_batch({"doc_id": batch.column("doc_id"), "n": [len(s) for s in sets], "digest": [digest(s) for s in sets]}, schema)


def _emit(plan: dict[int, tuple[int, int, int]], shards: int):
    schema = pa.schema([("shard", pa.int32()), ("sigs", pa.binary()), ("ids", pa.binary()), ("tags", pa.binary())])

    def packed(sigs: list, ids: list, tags: list) -> pa.RecordBatch:
        sig, tag = np.concatenate(sigs), np.concatenate(tags)
        who = np.repeat(np.array(ids, dtype=np.uint64), [len(x) for x in sigs])
        shard, sig = shortened(sig, shards)
        order = np.argsort((shard << 8) | tag, kind="stable")  # equal tags in a row take no place once compressed
        sig, who, tag, shard = sig[order], who[order], tag[order], shard[order].astype(np.int32)
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        ends = np.r_[cuts[1:], len(sig)]
        return to_batch({"shard": shard[cuts], **{k: [v[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)] for k, v in (("sigs", sig), ("ids", who), ("tags", tag))}}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, ids, tags, held, seen = [], [], [], 0, set()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                s = shingle_set(text)
                if len(s) < 4:
                    continue
                i = int.from_bytes(digest(s)[:8], "little")
                if i in seen:
                    continue
                seen.add(i)
                sig, tag = signatures(s, plan)
                sigs.append(sig)
                ids.append(i)
                tags.append(tag)
                held += len(sig)
                if held > 500_000:
                    yield packed(sigs, ids, tags)
                    sigs, ids, tags, held, seen = [], [], [], 0, set()
        if sigs:
            yield packed(sigs, ids, tags)

    return run


def _groups(table: pa.Table, shards: int) -> pa.Table:
    """The signatures of one shard that two or more classes share: sig, class, size (of the group), tag."""
    join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)
    sig, who, tag = restored(join("sigs", np.uint8), table.column("shard")[0].as_py(), shards), join("ids", np.uint64), join("tags", np.uint8)
    order = np.lexsort((who, sig >> np.uint64(1)))
    sig, who, tag = sig[order], who[order], tag[order]
    key = sig >> np.uint64(1)
    # A set may meet a signature twice (its deletion and another's subset); a subset outranks a deletion. One that has fallen
    # together with another band's (or kind's) is not dropped.
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (who[1:] != who[:-1])][: len(sig)])
    deletion = np.minimum.reduceat((sig & np.uint64(1)).astype(np.uint8), first)
    low, high = (f.reduceat(tag, first) if len(tag) else tag for f in (np.minimum, np.maximum))
    key, who, tag = key[first], who[first], np.where(low == high, low, high | 128).astype(np.uint8)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    some = np.repeat((sizes > 1) & (np.minimum.reduceat(deletion, starts) == 0), sizes)  # two deletions are two apart
    return pa.table({"sig": key[some].view(np.int64), "class": who[some].view(np.int64), "size": np.repeat(sizes, sizes)[some].astype(np.int32), "tag": tag[some].astype(np.int32)})


def parity(s: np.ndarray) -> np.ndarray:
    """A bitmap whose bits tell whether an odd number of tokens falls on them: two sets differ in as many tokens at least
    as their bitmaps differ in bits."""
    return np.packbits((np.bincount((mix(s, 15) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8))


def may_be_similar(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the sizes n, m and the bitmaps (rows of x, y) leave sets a chance to be similar."""
    apart = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum(axis=-1, dtype=np.int64)
    return (9 * apart <= n + m) & (5 * n >= 4 * m) & (5 * m >= 4 * n)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("class", pa.int64()), ("digest", pa.binary()), ("set", pa.binary()), ("n", pa.int64()), ("bits", pa.binary())])
    for batch in batches:
        rows, held = {f.name: [] for f in schema}, 0
        for text in batch.column("text").to_pylist():
            s = shingle_set(text)
            d = digest(s)
            for name, v in zip(rows, (int.from_bytes(d[:8], "little", signed=True), d, s.tobytes(), len(s), parity(s).tobytes()), strict=True):
                rows[name].append(v)
            held += len(s)
            if held > 2_000_000:
                yield to_batch(rows, schema)
                rows, held = {f.name: [] for f in schema}, 0
        yield to_batch(rows, schema)


def _bitmaps(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8)


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets are similar."""
    i = np.searchsorted(x, y)
    return bool(similar(int((x[np.minimum(i, len(x) - 1)] == y).sum()), len(x), len(y)))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, perhaps more longs) whose sets are similar: bitmaps leave few pairs, and those meet with their whole sets."""
    side = lambda new, *columns: sets.select(F.col("class").alias(new), *[F.col(c).alias(f"{c}_{new}") for c in columns])
    names = pairs.columns
    schema = ", ".join(f"{c} long" for c in names)

    def screen(batches):
        for batch in batches:
            keep = may_be_similar(_bitmaps(batch.column("bits_a")), _bitmaps(batch.column("bits_b")), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    def compare(batches):
        for batch in batches:
            keep = [alike(*(np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in pair)) for pair in zip(batch.column("set_a"), batch.column("set_b"), strict=True)]
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(side("a", "n", "bits"), "a").join(side("b", "n", "bits"), "b").mapInArrow(tidy(screen), schema)
    both = left.join(side("a", "set"), "a").join(side("b", "set"), "b")
    return both.select(*names, "set_a", "set_b").mapInArrow(tidy(compare), schema)


def _block_pairs(table: pa.Table) -> pa.Table:
    """Classes of one block pair, each with the larger ones of other components to which its bitmap leaves a chance."""
    who, comp, n, bits = table.column("class").to_numpy(), table.column("comp").to_numpy(), table.column("n").to_numpy(), _bitmaps(table.column("bits"))
    first = np.unique(who, return_index=True)[1]
    who, comp, n, bits = who[first], comp[first], n[first], bits[first]
    a, partners = [], []
    for k in range(len(who) - 1):
        keep = may_be_similar(bits[k], bits[k + 1 :], n[k], n[k + 1 :]) & (comp[k + 1 :] != comp[k])
        if keep.any():
            a.append(int(who[k]))
            partners.append(who[k + 1 :][keep])
    return pa.table({"a": pa.array(a, pa.int64()), "partners": pa.array(partners, pa.list_(pa.int64()))})


def _cluster(table: pa.Table) -> pa.Table:
    """Links (a, b) and their components (ca, cb) among the classes of one block: each class in turn meets those before it that are like
    none before them, unless they are of its component already."""
    table = table.sort_by("class")
    who, comp, n = (table.column(c).to_numpy() for c in ("class", "comp", "n"))
    bits = _bitmaps(table.column("bits"))
    sets = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in table.column("set")]
    links, first, root = [], [], comp.copy()
    for k in range(len(who)):
        near = np.array(first, dtype=np.int64)
        near = near[may_be_similar(bits[k], bits[near], n[k], n[near]) & (root[near] != root[k])]
        alone = True
        for j in near.tolist():
            if root[j] != root[k] and alike(sets[k], sets[j]):
                links.append((who[j], who[k], comp[j], comp[k]))
                root[root == root[k]] = root[j]
                alone = False
        if alone:
            first.append(k)
    columns = zip(*links, strict=True) if links else ((),) * 4
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("a", "b", "ca", "cb"), columns, strict=True)})


def _joined(labelled: DataFrame, links: DataFrame) -> DataFrame:
    """Members (sig, class, size, comp) of groups that still have more than one component, after links (ca, cb) between components."""
    named = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("comp"), F.col("component").alias("_c"))
    labelled = labelled.join(small_side(named, BROADCAST_IDS), "comp", "left").select("sig", "class", "size", F.coalesce("_c", "comp").alias("comp"))
    mixed = materialize(labelled.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig"), "mixed")
    return materialize(labelled.join(small_side(mixed, BROADCAST_IDS), "sig", "left_semi"), "apart")


def links_in_groups(members: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that connect what is similar within large groups (sig, class, size), and the links known."""
    labelled = _joined(members.select("sig", "class", "size", F.col("class").alias("comp")), links.select(F.col("a").alias("ca"), F.col("b").alias("cb")))
    if not labelled.take(1):
        return links.select("a", "b")
    # A task draws in each block of classes of one group; a class goes with its largest group.
    largest = labelled.groupBy("class", "comp").agg(F.max(F.struct("size", "sig")).alias("g"))
    block = F.pmod(F.xxhash64("class"), F.ceil(F.col("g.size") / DRAWN).cast("long"))
    held = largest.select("class", "comp", F.xxhash64("g.sig", block).alias("block")).join(sets.where(F.col("n") < LONG), "class")
    found = [links, materialize(held.groupBy("block").applyInArrow(tidy_group(_cluster), "a long, b long, ca long, cb long"), "drawn")]
    for k in range(STARS):  # then one class of each component of a group meets one of another
        before, labelled = labelled, _joined(labelled, found[-1])
        discard(before)
        ends = (F.max, F.min) if k % 2 else (F.min, F.max)
        pivot = labelled.groupBy("sig").agg(ends[0](F.struct("class", "comp")).alias("p")).select("sig", F.col("p.class").alias("p"), F.col("p.comp").alias("cp"))
        star = labelled.groupBy("sig", "comp").agg(ends[1]("class").alias("class")).join(small_side(materialize(pivot, "pivots"), BROADCAST_IDS), "sig").where("comp <> cp")
        pick = lambda x, y: F.when(F.col("class") < F.col("p"), F.col(x)).otherwise(F.col(y))
        pairs = star.select(pick("class", "p").alias("a"), pick("p", "class").alias("b"), pick("comp", "cp").alias("ca"), pick("cp", "comp").alias("cb")).distinct()
        found.append(materialize(verified(pairs, sets), "found"))
        if not found[-1].take(1):
            break
    else:
        before, labelled = labelled, _joined(labelled, found[-1])
        discard(before)
    links = found[0].select("a", "b")
    for more in found[1:]:
        links = links.unionByName(more.select("a", "b"))
    if not labelled.take(1):
        return links
    # Blocks: a component with many classes in a group has blocks of its own, the others share blocks.
    counts = labelled.groupBy("sig", "comp").agg(F.count("*").alias("n"))
    counts = materialize(counts.withColumn("own", F.col("n") > BLOCK // 2), "counts")
    shared = materialize(counts.where("not own").groupBy("sig").agg(F.sum("n").alias("rest")), "shared")
    placed = labelled.join(small_side(counts, BROADCAST_IDS), ["sig", "comp"]).join(small_side(shared, BROADCAST_IDS), "sig", "left")
    slot = F.pmod(F.xxhash64("class"), F.ceil(F.when(F.col("own"), F.col("n")).otherwise(F.col("rest")) / (BLOCK // 2)).cast("long"))
    placed = materialize(placed.select("sig", "class", "comp", F.when(F.col("own"), F.col("comp")).alias("only"), slot.alias("slot")), "placed")
    blocks = placed.select("sig", "only", "slot").distinct()
    # A block meets each block of its group once; two blocks of one component do not meet.
    other = blocks.select("sig", F.col("only").alias("only2"), F.col("slot").alias("slot2"))
    order = F.struct(F.coalesce(F.col("only"), F.lit(-(2**63))), F.col("only").isNull(), F.col("slot")) <= F.struct(F.coalesce(F.col("only2"), F.lit(-(2**63))), F.col("only2").isNull(), F.col("slot2"))
    meet = blocks.join(other, "sig").where(order & (F.col("only").isNull() | F.col("only2").isNull() | (F.col("only") != F.col("only2"))))
    meet = meet.withColumn("task", F.xxhash64("sig", "only", "slot", "only2", "slot2"))
    ends = meet.select("task", "sig", "only", "slot").union(meet.select("task", "sig", "only2", "slot2")).distinct()
    placed = placed.withColumns({"k": F.xxhash64("sig", "only", "slot")})
    ends = ends.select("task", F.xxhash64("sig", "only", "slot").alias("k"))
    work = ends.join(placed.select("k", "class", "comp"), "k").join(sets.select("class", "n", "bits"), "class")
    near = work.groupBy("task").applyInArrow(tidy_group(_block_pairs), "a long, partners array<long>")
    rest = materialize(near.select("a", F.explode("partners").alias("b")).distinct(), "rest")
    return links.unionByName(verified(rest, sets))


def classes_and_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, n, digest), (classes: digest, class, first), (links: a, b between classes' first doc_ids)."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(d.mapInArrow(tidy(_sizes), "doc_id long, n long, digest binary"), "sizes")
    to_class = lambda batches: (to_batch({"digest": b.column("digest"), "first": b.column("first"), "n": b.column("n"), "class": [int.from_bytes(x[:8], "little", signed=True) for x in b.column("digest").to_pylist()]}, pa.schema([("digest", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("class", pa.int64())])) for b in batches)
    classes = rows.where("doc_id IS NOT NULL AND n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), F.any_value("n").alias("n"))
    classes = materialize(classes.mapInArrow(tidy(to_class), "digest binary, first long, n long, class long"), "classes")
    # Bounded: one row for each band of sizes (under 130, whatever the corpus).
    sizes = classes.where("n >= 4").groupBy(F.floor(F.log(1.25, "n")).alias("k")).agg(F.count("*").alias("sets"), F.min("n").alias("lo"), F.max("n").alias("hi")).collect()
    held: dict[int, int] = {}
    for r in sizes:
        for b in range(bands_of(r["lo"]).start, int(band_of(r["hi"])) + 1):
            held[b] = held.get(b, 0) + r["sets"]
    plan = {b: allocate(b, n) for b, n in held.items()}
    total = sum(held[b] * (z + o * (1 + EDGES[b + 1] / (z + o))) for b, (z, o, _) in plan.items())
    shards = max(8, int(total * 17 / SHARD_BYTES) + 1)
    packed = d.where("doc_id IS NOT NULL").select("text").mapInArrow(tidy(_emit(plan, shards)), "shard int, sigs binary, ids binary, tags binary")
    # Two shards to a partition, however many there are: a partition is sorted in memory, and nothing is spilled.
    packed = packed.repartition(shards // 2, "shard")
    found = packed.groupBy("shard").applyInArrow(tidy_group(lambda one: _groups(one, shards)), "sig long, class long, size int, tag int").withColumns({"band": F.col("tag").bitwiseAND(127), "droppable": F.col("tag") < 128})
    slack = F.element_at(F.create_map(*[F.lit(v) for b, p in (plan or {0: (0, 0, 0)}).items() for v in (b, p[2])]), F.col("band"))
    rank = F.row_number().over(W.partitionBy("class", "band").orderBy(F.col("droppable").desc(), F.col("size").desc(), "sig"))
    kept = materialize(found.withColumn("rank", rank).where(~F.col("droppable") | (F.col("rank") > slack)).select("sig", "class"), "kept")
    # Written first, so that the join has no aggregate beside it: adaptive execution can then split a hot signature.
    sizes = materialize(kept.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    members = materialize(kept.join(small_side(sizes, BROADCAST_IDS), "sig"), "members")
    discard(kept, sizes)
    wanted = materialize(members.select("class").distinct(), "wanted")
    wanted = classes.join(wanted, "class").select(F.col("first").alias("_first"), F.col("digest").alias("_digest"))
    texts = d.join(small_side(materialize(wanted.select("_first").distinct(), "firsts"), BROADCAST_IDS), F.col("doc_id") == F.col("_first"), "left_semi").select("text")
    sets = texts.mapInArrow(tidy(_sets), "class long, digest binary, set binary, n long, bits binary").join(wanted, F.col("digest") == F.col("_digest"), "left_semi")
    sets = materialize(sets.groupBy("digest").agg(*[F.any_value(c).alias(c) for c in ("class", "set", "n", "bits")]).drop("digest"), "sets")
    # Small groups give all their pairs.
    group = members.where(F.col("size") <= GROUP).groupBy("sig").agg(F.array_sort(F.collect_list("class")).alias("g"))
    pair = group.select("g", F.posexplode("g").alias("i", "a")).select("a", F.explode(F.slice("g", F.col("i") + 2, GROUP)).alias("b"))
    links = materialize(verified(pair.distinct(), sets), "links")
    large = members.where(F.col("size") > GROUP)
    if large.take(1):
        links = links_in_groups(large, links, sets)
    name = small_side(classes.select("class", "first"), BROADCAST_IDS)
    links = links.join(name.select(F.col("class").alias("a"), F.col("first").alias("x")), "a").join(name.select(F.col("class").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return rows, classes, links


def component_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text)."""
    rows, classes, links = classes_and_links(docs)
    comp = components(links)
    named = classes.join(comp, F.col("first") == F.col("node"), "left").select(F.col("digest").alias("_d"), F.coalesce("component", "first").alias("_c"))
    out = rows.join(named, F.col("digest") == F.col("_d"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the smallest doc_id of their component; of rows with that doc_id all stay that are equal to it.

    Rows with a null doc_id link with nothing, and stay."""
    later = materialize(component_report(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("__stemma_id")).distinct(), "later")
    return docs.join(small_side(later, BROADCAST_IDS), F.col("doc_id").cast("long") == F.col("__stemma_id"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
