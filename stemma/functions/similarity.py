"""Similarity of lines: word-set Jaccard, byte-trigram cosine, their hybrid, and the alignment thresholds."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaccard(a: Column, b: Column) -> Column:
    """SIM-01 of two arrays of distinct words: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))


def words(norm: Column) -> Column:
    """SCL-02: the distinct words of a normalised text."""
    return F.array_distinct(F.array_remove(F.split(norm, " "), ""))


def jaccard_sets(a: frozenset | set, b: frozenset | set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def trigrams(norm: str) -> Counter:
    """Byte trigrams of a normalised text without its spaces; shorter ones are one gram."""
    raw = norm.replace(" ", "").encode("utf-8")
    if not raw:
        return Counter()
    return Counter(raw[k : k + 3] for k in range(len(raw) - 2)) if len(raw) >= 3 else Counter([raw])


def cosine_counts(a: Counter, b: Counter) -> float:
    if not a or not b:
        return float(not a and not b)
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    dot = sum(n * large[g] for g, n in small.items() if g in large)
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def cosine_text(a: str, b: str) -> float:
    return cosine_counts(trigrams(a), trigrams(b))


@F.pandas_udf(DoubleType())
def trigram_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """SIM-02 of normalised texts."""
    return pd.Series([cosine_text(x or "", y or "") for x, y in zip(a, b, strict=True)])


def trigram_cosine_builtin(a: Column, b: Column) -> Column:
    """SIM-02 for ASCII texts by built-in functions, for texts of three letters and more: counts are matched gram by gram."""

    def grams(s: Column) -> Column:
        t = F.replace(s, F.lit(" "), F.lit(""))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3)))

    def norm2(g: Column) -> Column:
        return F.aggregate(F.array_distinct(g), F.lit(0.0), lambda acc, x: acc + F.pow(F.size(F.filter(g, lambda y: y == x)).cast("double"), F.lit(2.0)))

    ga, gb = grams(a), grams(b)
    dot = F.aggregate(F.array_intersect(ga, gb), F.lit(0.0), lambda acc, x: acc + F.size(F.filter(ga, lambda y: y == x)) * F.size(F.filter(gb, lambda y: y == x)))
    return dot / F.sqrt(norm2(ga) * norm2(gb))


def hybrid(jac: Column, cosine: Column, words_a: Column, words_b: Column, few: int = 3) -> Column:
    """SIM-03: short lines (the smaller word set has up to few words) may be alike by their letters."""
    return F.when(F.least(F.size(words_a), F.size(words_b)) <= few, F.greatest(jac, cosine)).otherwise(jac)


def with_affinity(similarity: Column, line_a: Column, line_b: Column, bonus: float) -> Column:
    """SIM-04: equal line numbers add bonus, numbers up to three apart half of it; both must be numbers above 0."""
    apart = F.abs(line_a - line_b)
    extra = F.when((line_a > 0) & (line_b > 0), F.when(apart == 0, F.lit(bonus)).when(apart <= 3, F.lit(bonus / 2)).otherwise(0.0)).otherwise(0.0)
    return F.least(F.lit(1.0), similarity + F.coalesce(extra, F.lit(0.0)))


def aligned_threshold(type_a: Column, type_b: Column, words_a: Column, words_b: Column) -> Column:
    """SIM-05: the similarity from which a pair counts as aligned."""
    least = F.least(F.size(words_a), F.size(words_b))
    stage = (type_a == "stage_direction") | (type_b == "stage_direction")
    return F.when(stage | (least <= 2), F.lit(0.1)).when(least <= 4, F.lit(0.15)).otherwise(F.lit(0.2))


def threshold(type_a: str, type_b: str, least: int) -> float:
    if "stage_direction" in (type_a, type_b) or least <= 2:
        return 0.1
    return 0.15 if least <= 4 else 0.2
