"""Where passages stand in documents, and which documents are editions of one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.session import checkpointed, small_side
from stemma.sources.sqldump import document_lines

GRAM, TRIGRAM = 4, 3


def plain_norm(c: Column) -> Column:
    """Lower case, letters and digits, single spaces."""
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]+", "")
    return F.trim(F.regexp_replace(kept, r"\s{2,}|[\t\n\x0B\f\r]", " "))  # spaces that are single stay


def plain_norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\s]+', '', 'g'), '\s+', ' ', 'g'))"


def grams(words: Column) -> Column:
    """All runs of GRAM words, as hashes."""
    heads = F.slice(words, 1, F.greatest(F.size(words) - GRAM + 1, F.lit(0)))
    return F.transform(heads, lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, GRAM)]))


def find_passages(passages: DataFrame, lines: DataFrame) -> DataFrame:
    """Tiers 1a and 1c of the cascade: for each passage and document the first line that holds the passage, or that holds it together with
    the next line. passages: item_id, norm; lines: doc_id, line_no, norm.

    The second to fifth words of a passage stand between spaces, so they are whole words of the line: their hash is an equi-key, and only
    lines with it are tested. Passages of three to five words meet lines by their second word. Those of one or two may stand within words:
    they meet lines by their first three characters, and passages of fewer characters than that meet nothing."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    followed = lambda df: df.withColumn("ord", F.row_number().over(w)).withColumn("next", F.lead("norm").over(w))
    two = followed(lines)
    p = passages.withColumn("w", F.split("norm", " "))
    long = p.where(F.size("w") >= GRAM + 2).select("item_id", F.col("norm").alias("passage"), F.xxhash64(*[F.get("w", F.lit(k + 1)) for k in range(GRAM)]).alias("key"))
    short = p.where(F.size("w").between(3, GRAM + 1)).select("item_id", F.col("norm").alias("passage"), F.xxhash64(F.get("w", F.lit(1))).alias("key"))
    # Only keys are exploded. A key stands in the line, or crosses into the next one; its passage begins there or in the line before.
    reach = two.select("doc_id", "ord", F.split("norm", " ").alias("own"), F.split(F.concat_ws(" ", "norm", F.substring_index("next", " ", GRAM - 1)), " ").alias("both"))
    hits = reach.select("doc_id", "ord", F.explode(F.array_distinct(grams(F.col("both")))).alias("key")).join(long, "key")
    if short.take(1):
        hits = hits.unionByName(reach.select("doc_id", "ord", F.explode(F.array_distinct(F.transform("own", lambda x: F.xxhash64(x)))).alias("key")).join(short, "key"))
    head = F.substring("norm", 1, TRIGRAM)
    tiny = p.where((F.size("w") < 3) & (F.length("norm") >= TRIGRAM)).select("item_id", F.col("norm").alias("passage"), F.xxhash64(head).alias("key"))
    if tiny.take(1):
        text = two.select("doc_id", "ord", F.concat_ws(" ", "norm", "next").alias("text"))
        places = F.sequence(F.lit(1), F.greatest(F.length("text") - TRIGRAM + 1, F.lit(1)))
        hits = hits.unionByName(text.select("doc_id", "ord", F.explode(F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.substring("text", i, F.lit(TRIGRAM)))))).alias("key")).join(tiny, "key"))
    starts = hits.select("item_id", "passage", "doc_id", F.explode(F.array("ord", F.col("ord") - 1)).alias("ord")).distinct()
    # Read again are the lines of documents with hits only; if these are few, no other line is shuffled a second time.
    starts = checkpointed(starts)
    own = followed(lines.join(small_side(starts.select("doc_id").distinct(), 1_000_000), "doc_id", "left_semi"))
    met = small_side(starts, 100_000).join(own, ["doc_id", "ord"])
    tier = F.when(F.contains("norm", F.col("passage")), 1).when(F.contains(F.concat_ws(" ", "norm", "next"), F.col("passage")), 3)
    first = met.withColumn("tier", tier).where("tier IS NOT NULL").groupBy("item_id", "doc_id").agg(F.min(F.struct("tier", "line_no")).alias("m"))
    return first.select("item_id", "doc_id", F.col("m.line_no").alias("line_no"), F.lit("exact_quote").alias("match_type"), F.when(F.col("m.tier") == 1, 1.0).otherwise(0.95).alias("confidence"))


def line_hashes(lines: DataFrame, length: int = 30) -> DataFrame:
    """doc_id, h: the lines that are longer than length characters, as 64-bit hashes."""
    return lines.where(F.length("line") > length).select("doc_id", F.xxhash64("line").alias("h"))


def edition_pairs_by_lines(lines: DataFrame, shared: int = 3, length: int = 30) -> DataFrame:
    """JN-08: pairs of documents that share so many distinct lines, each longer than length characters. lines: doc_id, line."""
    return pairs_by_hashes(line_hashes(lines, length).distinct(), shared)


def pairs_by_hashes(held: DataFrame, shared: int = 3) -> DataFrame:
    """a, b, shared: pairs of documents that share so many hashes. held: doc_id, h, distinct.

    Exact, however many documents hold a line. Documents with equal sets of lines are one class; pairs of classes are expanded to pairs of
    their members. Each class drops its shared - 1 most frequent lines from the join: two classes with shared lines in common still meet by
    the rarest of them, and their whole sets are counted. Lines are compared by 64-bit hash."""
    counts = held.groupBy("h").agg(F.count("*").alias("n")).where("n >= 2")
    sets = held.join(counts, "h").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "h"))), lambda x: x["h"]).alias("held")).where(F.size("held") >= shared)
    docs = sets.withColumn("sig", F.sha2(F.array_join(F.transform("held", lambda x: x.cast("string")), ","), 256))
    reps = docs.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("held").alias("held"))
    members = docs.select("doc_id", "sig").join(reps.select("sig", "rep", F.size("held").cast("long").alias("shared")), "sig").drop("sig")
    # Written, so that the join can be split where a line is in very many classes.
    met = checkpointed(reps.select("rep", F.explode(F.slice("held", 1, F.size("held") - (shared - 1))).alias("h")))
    near = met.withColumnRenamed("rep", "p").join(met.withColumnRenamed("rep", "q"), "h").where("p < q").select("p", "q").distinct()
    one = lambda c: reps.select(F.col("rep").alias(c), F.col("held").alias(f"held_{c}"))
    near = near.join(one("p"), "p").join(one("q"), "q").select("p", "q", F.size(F.array_intersect("held_p", "held_q")).cast("long").alias("shared")).where(F.col("shared") >= shared)
    side = lambda c, d: members.select(F.col("rep").alias(c), F.col("doc_id").alias(d))
    across = near.join(side("p", "x"), "p").join(side("q", "y"), "q").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared")
    within = members.select("rep", F.col("doc_id").alias("a"), "shared").join(members.select("rep", F.col("doc_id").alias("b")), "rep").where("a < b").select("a", "b", "shared")
    return across.unionByName(within)


def edition_classes(lines: DataFrame) -> DataFrame:
    """JN-08: doc_id, rep: documents whose lines are equal, each under its number, and the smallest of them. lines: doc_id, line_no, line.

    Lines are summed up by the xor of two 64-bit hashes of each, so no document's lines are gathered."""
    digest = lines.groupBy("doc_id").agg(F.bit_xor(F.xxhash64("line_no", "line")).alias("h1"), F.bit_xor(F.xxhash64("line", "line_no")).alias("h2"), F.count("*").alias("n"))
    digest = checkpointed(digest)
    keys = ["h1", "h2", "n"]
    return digest.join(digest.groupBy(*keys).agg(F.min("doc_id").alias("rep")), keys).select("doc_id", "rep")


def class_pairs(lines: DataFrame, classes: DataFrame, shared: int = 3, length: int = 30) -> DataFrame:
    """JN-08: p, q, shared: pairs of classes whose documents share so many lines, p <= q: a class of several documents pairs with itself.
    As many rows as there are different texts that pair, however many copies they have."""
    reps = classes.where("doc_id = rep").select("doc_id")
    own = line_hashes(lines, length).join(reps, "doc_id", "left_semi").distinct()  # hashes are shuffled, not lines
    across = pairs_by_hashes(own, shared).select(F.col("a").alias("p"), F.col("b").alias("q"), "shared")
    several = classes.where("doc_id <> rep").select(F.col("rep").alias("doc_id")).distinct()
    within = own.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("shared")).where(F.col("shared") >= shared)
    return across.unionByName(within.select(F.col("doc_id").alias("p"), F.col("doc_id").alias("q"), "shared"))


def expanded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, shared: the pairs of documents, a < b, that pairs of classes stand for."""
    side = lambda rep, doc: classes.select(F.col("rep").alias(rep), F.col("doc_id").alias(doc))
    both = pairs.join(side("p", "x"), "p").join(side("q", "y"), "q").where("p <> q OR x < y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared")


def directed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: the orders in which classes of pairs meet, a being the class of the document with the smaller id."""
    last = classes.groupBy("rep").agg(F.max("doc_id").alias("last"))
    both = pairs.select(F.col("p").alias("a"), F.col("q").alias("b")).unionByName(pairs.where("p <> q").select(F.col("q").alias("a"), F.col("p").alias("b")))
    return both.join(last.withColumnRenamed("rep", "b"), "b").where("a < last").select("a", "b")  # a class's name is its smallest id


def pair_lines(pairs: DataFrame, lines: DataFrame, side: str) -> DataFrame:
    """The lines of one side of each pair: a, b, line_no, line."""
    return small_side(pairs.select("a", "b"), 1_000_000).join(lines, F.col(side) == F.col("doc_id")).select("a", "b", "line_no", "line")


def line_table(documents: DataFrame) -> DataFrame:
    return document_lines(documents)
