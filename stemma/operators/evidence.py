"""Which lines may hold a passage, exactly and without comparing all of them (RES-07).

A line whose words have a Jaccard similarity over t with a passage of n words shares more than t n of them, so it holds one of the
n - ceil(t n) + 1 rarest: lines meet passages by those only. Rarity is counted in the lines, in one table of their words. A long passage
meets lines by the rarest of its inner words, which stand whole in a line or the next. The words of a short one may stand within words: its
longest is looked up in the table of words, and lines meet it by those that hold it. What meets is compared whole, once for all tiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.functions.similarity import jaccard, words
from stemma.operators.fts import grams
from stemma.session import checkpointed, small_side

SLACK = 1e-9
#: Words of a quote that may stand apart in a line.
FEW, MANY = 2, 6


def vocabulary(lines: DataFrame) -> DataFrame:
    """word, df: the words of lines, and how many lines hold each. lines: words, distinct within a line."""
    return checkpointed(lines.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")))


def rare_words(passages: DataFrame, df: DataFrame, least: float) -> DataFrame:
    """item_id, n, word: the rarest words of each passage, one of which every line over least holds. passages: item_id, words; df as
    vocabulary() gives it."""
    each = passages.select("item_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    w = W.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "word")
    ranked = each.join(df, "word", "left").withColumn("place", F.row_number().over(w))
    return ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - SLACK) + 1).where("df IS NOT NULL").select("item_id", "n", "word")


def _near(least: float) -> tuple[Column, Column]:
    """How few and how many words a line over least of a passage of n words has."""
    return F.col("n") * least - SLACK, F.col("n") / least + SLACK


def fuzzy_candidates(passages: DataFrame, lines: DataFrame, least: float) -> DataFrame:
    """item_id, doc_id, line_no of the lines that are compared with each passage. lines: doc_id, line_no, words."""
    keys = small_side(checkpointed(rare_words(passages, vocabulary(lines), least)), 1_000_000)
    held = lines.select("doc_id", "line_no", F.size("words").alias("m"), F.explode("words").alias("word"))
    return held.join(keys, "word").where(F.col("m").between(*_near(least))).select("item_id", "doc_id", "line_no").distinct()


def fuzzy_pairs(passages: DataFrame, lines: DataFrame, least: float) -> DataFrame:
    """item_id, doc_id, line_no, similarity of all lines over least."""
    met = fuzzy_candidates(passages, lines, least).join(lines, ["doc_id", "line_no"])
    met = met.join(passages.select("item_id", F.col("words").alias("own")), "item_id").withColumn("similarity", jaccard(F.col("words"), F.col("own")))
    return met.where(F.col("similarity") > least).select("item_id", "doc_id", "line_no", "similarity")


def words_around(passages: DataFrame, df: DataFrame) -> DataFrame:
    """item_id, word: the words of a vocabulary in which the longest word of each passage stands. passages: item_id, own. A word has no space,
    so it stands in a line within one word of it. Words meet by first letters, up to three."""
    longest = F.array_max(F.transform("own", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    parts = checkpointed(passages.where(F.size("own") > 0).select("item_id", longest.alias("part")).withColumn("key", F.substring("part", 1, 3)))
    met = passages.join(df.where("false"), F.lit(True)).select("item_id", "word")
    for size in sorted(r[0] for r in parts.select(F.length("key")).distinct().collect()):  # 1, 2 or 3
        held = df.select("word", F.explode(grams(F.col("word"), size)).alias("key"))
        one = held.join(parts.where(F.length("key") == size), "key").where(F.contains("word", F.col("part")))
        met = met.unionByName(one.select("item_id", "word"))
    return met


def scattered(passages: DataFrame, lines: DataFrame) -> DataFrame:
    """item_id, doc_id, line_no of the lines in which every word of a short quote stands, apart or within other words. passages: item_id,
    norm; lines: doc_id, line_no, norm."""
    quotes = checkpointed(passages.select("item_id", F.array_remove(F.split("norm", " "), "").alias("own")).where(F.size("own").between(FEW, MANY)))
    held = checkpointed(lines.select("doc_id", "line_no", "norm", words(F.col("norm")).alias("words")))
    keys = small_side(checkpointed(words_around(quotes, vocabulary(held))), 1_000_000)
    met = held.select("doc_id", "line_no", F.explode("words").alias("word")).join(keys, "word").select("item_id", "doc_id", "line_no").distinct()
    whole = met.join(held, ["doc_id", "line_no"]).join(quotes, "item_id")
    return whole.where(F.forall("own", lambda w: F.contains("norm", w))).select("item_id", "doc_id", "line_no")


def evidence(passages: DataFrame, lines: DataFrame, least: float = 0.5) -> DataFrame:
    """item_id, doc_id: documents that hold a passage in a line or two, all words of a short one in a line, or a line over least. Passages of
    one or two words and fewer than three characters count by their words alone, as for find_passages()."""
    order = W.partitionBy("doc_id").orderBy("line_no")
    held = lines.select("doc_id", "norm", words(F.col("norm")).alias("words"), F.row_number().over(order).alias("ord"), F.lead("norm").over(order).alias("next"))
    held = checkpointed(held)  # read for the vocabulary, for its keys and for what meets
    df = vocabulary(held)
    own = F.array_remove(F.split("norm", " "), "")
    findable = (F.size(F.split("norm", " ")) > 2) | (F.length("norm") > 2)
    p = checkpointed(passages.select("item_id", F.col("norm").alias("passage"), own.alias("own"), words(F.col("norm")).alias("asked"), findable.alias("findable")))
    alike = rare_words(p.select("item_id", F.col("asked").alias("words")), df, least).select("item_id", "word", "n")
    inner = p.where(F.size("own") > MANY).select("item_id", F.explode(F.array_distinct(F.slice("own", 2, F.size("own") - 2))).alias("word")).join(df, "word", "left")
    inner = inner.groupBy("item_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("r")).select("item_id", "r.word")
    whole = inner.unionByName(words_around(p.where(F.size("own") <= MANY), df))
    keys = small_side(checkpointed(alike.unionByName(whole.withColumn("n", F.lit(None).cast("int")))), 1_000_000)
    # Words of likeness have an n. Of n and m words over least * (n + m) / (1 + least) are shared, and all but the rare ones may be.
    m, n = F.col("m"), F.col("n")
    rare = F.ceil(n * least - SLACK) - 1
    hits = held.select("doc_id", "ord", F.size("words").alias("m"), F.explode("words").alias("word")).join(keys, "word").where(n.isNull() | m.between(*_near(least)))
    # A passage over two lines has its key in either: the line before is then met too.
    at = F.when(n.isNull(), F.array("ord", F.col("ord") - 1)).otherwise(F.array("ord"))
    met = hits.select("item_id", "doc_id", F.explode(at).alias("ord"), "n", ((n + m) * (least / (1 + least)) - rare - SLACK).alias("need"))
    met = met.groupBy("item_id", "doc_id", "ord").agg(F.count("n").alias("rare"), F.max("need").alias("need"), F.count("*").alias("all")).where("all > rare OR rare > need")
    met = met.select("item_id", "doc_id", "ord").join(held, ["doc_id", "ord"]).join(small_side(p, 100_000), "item_id")
    exact = F.col("findable") & F.contains(F.concat_ws(" ", "norm", "next"), F.col("passage"))
    apart = F.size("own").between(FEW, MANY) & F.forall("own", lambda w: F.contains("norm", w))
    return met.where(exact | apart | (jaccard(F.col("words"), F.col("asked")) > least)).select("item_id", "doc_id").distinct()
