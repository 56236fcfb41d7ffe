"""Ranked full-text search over postings tables (FTS-01..09).

A postings table has a row for each (term, document, field) with its frequency and positions; statistics are columns of small
tables. Queries join the few postings of their terms, so the work grows with the postings read, not with the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from stemma.session import checkpointed

K1, B = 1.2, 0.75

# ---- tokens

_VOWEL = re.compile(r"[aeiou]|(?<![aeiou])y")
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _forms(w: str) -> str:
    """A word as c and v, runs as one letter (Porter 1980)."""
    out = ""
    for k, c in enumerate(w):
        vowel = c in "aeiou" or c == "y" and k > 0 and w[k - 1] not in "aeiou" and out[-1:] == "c"
        out += ("v" if vowel else "c") if out[-1:] != ("v" if vowel else "c") else ""
    return out


def _measure(w: str) -> int:
    return _forms(w).count("vc")


def _has_vowel(w: str) -> bool:
    return "v" in _forms(w)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiou"


def _cvc(w: str) -> bool:
    is_c = lambda k: _forms(w[: k + 1])[-1] == "c"
    return len(w) > 2 and is_c(len(w) - 1) and not is_c(len(w) - 2) and is_c(len(w) - 3) and w[-1] not in "wxy"


@lru_cache(100_000)
def porter(w: str) -> str:
    """The stem of a lower-case English word by Porter's algorithm of 1980."""
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        suffix = max((s for s in table if w.endswith(s)), key=len, default=None)
        if suffix and _measure(w[: -len(suffix)]) > 0:
            w = w[: -len(suffix)] + table[suffix]
    suffix = max((s for s in (*STEP_4, "ion") if w.endswith(s)), key=len, default=None)
    if suffix and _measure(w[: -len(suffix)]) > 1 and (suffix != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(suffix)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


TOKEN = re.compile(r"[^\W_]+")


def tokens(s: str | None, stem: bool = True) -> list[str]:
    """FTS-02: case folded, accents removed, letters and digits, stemmed."""
    s = s or ""
    folded = (s if s.isascii() else "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))).lower()
    found = TOKEN.findall(folded)
    return [porter(t) for t in found] if stem else found


@F.pandas_udf(ArrayType(StringType()))
def stemmed_tokens(s: pd.Series) -> pd.Series:
    return s.map(tokens)


def plain_tokens(c):
    """Tokens by built-in functions, without stems: runs of ASCII letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


# ---- the index


@dataclass
class Index:
    """postings: term, doc, field, tf, positions; docs: doc, dl; stats: n, avgdl (one row)."""

    postings: DataFrame
    docs: DataFrame
    stats: DataFrame
    stem: bool = True


def build_index(df: DataFrame, key: str, fields: list[str], stem: bool = True) -> Index:
    """FTS-01: one explode and one aggregate by (term, doc, field); lengths come from the token arrays, without a shuffle."""
    token = stemmed_tokens if stem else plain_tokens
    t = df.select(F.col(key).alias("doc"), *[token(F.col(f)).alias(f) for f in fields])
    if stem:  # in Python: written, so that a search that reads the index several times makes the stems once
        t = checkpointed(t)
    each = None
    for f in fields:
        part = t.select("doc", F.lit(f).alias("field"), F.posexplode(f).alias("pos", "term"))
        each = part if each is None else each.unionByName(part)
    postings = each.groupBy("term", "doc", "field").agg(F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    docs = t.select("doc", sum((F.size(f) for f in fields), F.lit(0)).cast("long").alias("dl"))
    stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return Index(postings, docs, stats, stem)


def bm25(index: Index, terms: list[str], must: bool = True, prefix_last: bool = False) -> DataFrame:
    """FTS-04 and FTS-06: doc, score: BM25 of the documents with all terms (must) or any; the last term may be a prefix. Scores are
    positive; larger is better. Terms are tokens of the index."""
    if not terms:
        return index.docs.select("doc", F.lit(0.0).alias("score")).limit(0)
    p = index.postings
    slot = None
    for k, t in enumerate(terms):
        hit = F.startswith("term", F.lit(t)) if prefix_last and k == len(terms) - 1 else F.col("term") == t
        slot = F.when(hit, F.array(F.lit(k))).otherwise(F.array().cast("array<int>")) if slot is None else F.array_union(slot, F.when(hit, F.array(F.lit(k))).otherwise(F.array().cast("array<int>")))
    wanted = None
    for k, t in enumerate(terms):
        c = F.startswith("term", F.lit(t)) if prefix_last and k == len(terms) - 1 else F.col("term") == t
        wanted = c if wanted is None else wanted | c
    hits = p.where(wanted).withColumn("slot", F.explode(slot)).groupBy("slot", "doc").agg(F.sum("tf").alias("tf"))
    df = hits.groupBy("slot").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "slot").join(index.docs, "doc")  # df has a row for each term of the query
    n, avgdl = index.stats.select("n").scalar(), index.stats.select("avgdl").scalar()
    idf = F.greatest(F.lit(1e-6), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    out = scored.groupBy("doc").agg(F.sum(weight).alias("score"), F.count("*").alias("_hit"))
    return (out.where(F.col("_hit") == len(terms)) if must else out).select("doc", "score")


def phrase(index: Index, terms: list[str], in_field: str | None = None) -> DataFrame:
    """FTS-05: doc of the documents in which the terms follow each other: positions less the term's place agree for all terms."""
    p = index.postings.where(F.col("term").isin(terms)) if terms else index.postings.limit(0)
    p = p.where(F.col("field") == in_field) if in_field else p
    at = None
    for k, t in enumerate(terms):
        part = p.where(F.col("term") == t).select("doc", "field", F.explode("positions").alias("pos")).select("doc", "field", (F.col("pos") - k).alias("start"), F.lit(k).alias("k"))
        at = part if at is None else at.unionByName(part)
    if at is None:
        return p.select("doc")
    return at.groupBy("doc", "field", "start").agg(F.count_distinct("k").alias("n")).where(F.col("n") == len(terms)).select("doc").distinct()


# ---- query strings


@dataclass
class Query:
    """any of clauses, each all of its parts: (field or None, terms, is phrase, last is prefix)."""

    clauses: list[list[tuple[str | None, list[str], bool, bool]]] = field(default_factory=list)


PART = re.compile(r'(?:(\w+):)?(?:"([^"]*)"|(\S+))')


def parse_query(q: str, stem: bool = True) -> Query:
    """Implicit and explicit AND, OR between clauses, "phrases", field:term and prefix*. Other operators are dropped."""
    out = Query([[]])
    for m in PART.finditer(q or ""):
        in_field, quoted, word = m.groups()
        if word == "OR" and not in_field:
            out.clauses.append([])
            continue
        if word == "AND" and not in_field:
            continue
        prefix = bool(word and word.endswith("*"))
        found = tokens(quoted if quoted is not None else word, stem=stem and not prefix)
        if found:
            out.clauses[-1].append((in_field, found, quoted is not None or len(found) > 1, prefix))
    out.clauses = [c for c in out.clauses if c]
    return out


def search(index: Index, q: str) -> DataFrame:
    """doc, score of a query string: scores of the clauses that match, the best of them."""
    out = None
    for clause in parse_query(q, index.stem).clauses:
        docs = None
        for in_field, terms, is_phrase, prefix in clause:
            own = Index(index.postings.where(F.col("field") == in_field) if in_field else index.postings, index.docs, index.stats, index.stem)
            hit = bm25(own, terms, prefix_last=prefix)
            if is_phrase:
                hit = hit.join(phrase(index, terms, in_field), "doc", "left_semi")
            docs = hit if docs is None else docs.join(hit.withColumnRenamed("score", "_s"), "doc").select("doc", (F.col("score") + F.col("_s")).alias("score"))
        out = docs if out is None else out.unionByName(docs)
    if out is None:
        return index.docs.select("doc", F.lit(0.0).alias("score")).limit(0)
    return out.groupBy("doc").agg(F.max("score").alias("score"))


def trigram_search(df: DataFrame, column: str, q: str) -> DataFrame:
    """FTS-03: rows whose column holds q as a substring, without regard to case; q has three characters or more, else none."""
    return df.where(F.contains(F.lower(column), F.lit(q.lower()))) if len(q) >= 3 else df.limit(0)


def grams(text: Column, size: int) -> Column:
    """The distinct runs of so many characters, in one pass over a text: substring() would look for each place from the beginning."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1)))


def trigram_postings(df: DataFrame, key: str, column: str) -> DataFrame:
    """gram, doc: the distinct trigrams of each text, a prefilter for substring search on large tables."""
    return df.where(F.length(column) >= 3).select(F.col(key).alias("doc"), F.explode(grams(F.lower(column), 3)).alias("gram"))


def grouped(scored: DataFrame, entries: DataFrame, key: str = "base_key") -> DataFrame:
    """FTS-07: the best document of each key. entries: doc and key."""
    joined = scored.join(entries, "doc")
    return joined.groupBy(key).agg(F.max_by(F.struct("doc", "score"), F.struct("score", -F.col("doc"))).alias("b")).select(key, "b.doc", "b.score")


def page(df: DataFrame, order: list, limit: int = 50, offset: int = 0, most: int = 100) -> DataFrame:
    """SRT-02: one page of a total order, with the limit clamped."""
    n = limit if 0 < limit <= most else 50
    return df.orderBy(*order).offset(max(0, offset)).limit(n)


def relevance_tier(key: str, q: str):
    """SRT-05: 0 for keys equal to the query, 1 for those that begin with it, 2 for others."""
    low = F.lower(key)
    return F.when(low == q.lower(), 0).when(F.startswith(low, F.lit(q.lower())), 1).otherwise(2)


def tiered_page(df: DataFrame, key: str, q: str, score: str = "score", limit: int = 50, offset: int = 0) -> DataFrame:
    """SRT-05: a page of the results by tier, then score, then key."""
    return page(df.withColumn("tier", relevance_tier(key, q)), [F.col("tier"), F.col(score).desc(), F.col(key)], limit, offset)
