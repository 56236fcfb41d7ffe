"""String functions of the engine, as columns wherever built-in functions can express them."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Edges of words in the ASCII sense: \\b would take accented letters for word characters.
NOT_AFTER, NOT_BEFORE = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"


def contains_normalized(text: Column, needle: Column, raw_needle: Column) -> Column:
    """SCL-03: the normalised needle lies in the normalised text; an empty raw needle never does."""
    return (F.length(raw_needle) > 0) & F.contains(text, needle)


def contains_word_prefix(words: Column, prefix: Column) -> Column:
    """SCL-04: a word begins with the prefix, which has four bytes or more."""
    return (F.octet_length(prefix) >= 4) & F.exists(words, lambda w: F.startswith(w, prefix))


def contains_stem_prefix(words: Column, word: Column) -> Column:
    """SCL-05: another word begins with the word less its last letter; the word has four bytes or more."""
    stem = F.substring(word, F.lit(1), F.length(word) - 1)
    return (F.octet_length(word) >= 4) & F.exists(words, lambda w: F.startswith(w, stem) & (w != word))


def strip_sense_number(key: Column) -> Column:
    """SCL-06: the key without digits at its end, unless there is nothing else."""
    return F.when(F.rlike(key, F.lit(r"^\p{Nd}*$")), key).otherwise(F.regexp_replace(key, r"\p{Nd}+$", ""))


def split_sense_key(key: Column) -> tuple[Column, Column]:
    """SCL-07: (base key, sense group): A1 is A and 1; no digits, or only digits, leave the key and null."""
    base = F.regexp_extract(key, r"^(.*?[^0-9])[0-9]+$", 1)
    number = F.regexp_extract(key, r"[^0-9]([0-9]+)$", 1)
    return F.when(base != "", base).otherwise(key), F.try_to_number(F.nullif(number, F.lit("")), F.lit("999999999")).cast("int")


def slugify(title: Column) -> Column:
    """SCL-08: letters and digits in lower case, everything between them one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{Nd}]+", "-"), "^-+|-+$", "")


_ENTITY = re.compile(r"&#(?:[xX]([0-9a-fA-F]+)|([0-9]+));")


def decode_entities_text(s: str) -> str:
    """Numeric HTML entities as characters; numbers that are no character stay."""

    def one(m):
        n = int(m[1], 16) if m[1] else int(m[2])
        return chr(n) if 0 < n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else m[0]

    return _ENTITY.sub(one, s)


@F.pandas_udf(StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    """SCL-09 over Arrow batches."""
    return s.map(decode_entities_text, na_action="ignore")


def clean_text(s: Column) -> Column:
    """SCL-10: Unicode white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def normalize_ligatures(s: Column) -> Column:
    """SCL-11."""
    for old, new in (("æ", "ae"), ("Æ", "Ae"), ("œ", "oe"), ("Œ", "Oe"), ("ſ", "s")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def folio_text(s: Column) -> Column:
    """SCL-12: long s as s, white space collapsed."""
    return clean_text(F.replace(s, F.lit("ſ"), F.lit("s")))


ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_value(s: str | None) -> int:
    """The value of a Roman number in either case, 0 for anything else."""
    values = [ROMAN.get(c, 0) for c in (s or "").strip().upper()]
    return 0 if 0 in values else sum(-v if any(w > v for w in values[k + 1 : k + 2]) else v for k, v in enumerate(values))


def roman_to_int(s: Column) -> Column:
    """SCL-13 as a fold from the right: a digit smaller than the one after it is taken away."""
    value = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    digits = F.transform(F.split(F.reverse(F.upper(F.trim(s))), ""), lambda c: F.try_element_at(value, c))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    total = F.aggregate(digits, start, lambda acc, v: F.struct((acc["sum"] + F.when(v < acc["last"], -v).otherwise(v)).alias("sum"), v.alias("last")))["sum"]
    return F.when(is_roman(F.trim(s)), total).otherwise(F.lit(0))


def is_roman(s: Column) -> Column:
    """SCL-14."""
    return F.coalesce(F.rlike(s, F.lit("^[IVXLCDMivxlcdm]+$")), F.lit(False))


def strict_atoi(s: Column) -> Column:
    """SCL-15: digits only, else 0."""
    return F.coalesce(F.when(F.rlike(s, F.lit("^[0-9]+$")), s.try_cast("int")), F.lit(0))


def trailing_number(s: Column) -> Column:
    """SCL-16: the last word that is a whole number, or null."""
    return F.try_element_at(F.filter(F.transform(F.split(F.trim(s), r"\s+"), lambda x: x.try_cast("int")), lambda x: x.isNotNull()), F.lit(-1))


def folger_line(n: Column) -> Column:
    """SCL-17: the third part of act.scene.line; stage directions (SD...) and others are 0."""
    part = F.split_part(n, F.lit("."), F.lit(3))
    return F.when(F.upper(n).startswith("SD"), F.lit(0)).otherwise(strict_atoi(part))


def word_count(s: Column) -> Column:
    """SCL-18."""
    return F.size(F.array_remove(F.split(F.coalesce(s, F.lit("")), r"(?U)\s+"), ""))


#: Letters whose upper case is several letters, and the one letter that stands for it: as in SQL, or the letter itself.
_SEVERAL = "".join(c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1)
_ONE = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _SEVERAL)


def first_letter(s: Column) -> Column:
    """SCL-19: the first character after spaces of any kind, in upper case if it is a letter, else ?."""
    first = F.substring(F.regexp_replace(s, r"^\p{Zs}+", ""), 1, 1)
    c = F.when(F.contains(F.lit(_SEVERAL), first), F.translate(first, _SEVERAL, _ONE)).otherwise(F.upper(first))
    return F.when(F.rlike(c, F.lit(r"^\p{L}$")), c).otherwise(F.lit("?"))


def is_all_caps(s: Column) -> Column:
    """SCL-19: it has a letter, and no letter in lower case."""
    return F.rlike(s, F.lit(r"\p{L}")) & (F.upper(s) == s)


def is_page_number(s: Column) -> Column:
    """SCL-19: one to four digits alone on a line."""
    return F.rlike(F.trim(s), F.lit("^[0-9]{1,4}$"))


def split_ellipsis(s: Column) -> Column:
    """SCL-21: the parts between ... or …, trimmed, empty ones dropped."""
    return F.array_remove(F.transform(F.split(s, r"\.\.\.|…"), lambda x: F.trim(x)), "")


def expand_quote_text(quote: str | None, headword: str | None) -> str | None:
    """The quote with its first abbreviation of the headword written out, or null if it has none: --suffix is the headword and the
    suffix; else x. after a space, comma, colon, semicolon, bracket or nothing, where x are its first one to three letters, is all of it."""
    if not quote or not headword:
        return None
    head = headword.lower()
    if "--" in quote:
        return re.sub(r"--(?=([^ ,.;:!?]*))", lambda m: head, quote, count=1)
    for n in range(1, min(3, len(head) - 1) + 1):
        m = re.search(re.escape(head[:n] + "."), quote.lower())
        if m and (m.start() == 0 or quote[m.start() - 1] in " ,;:("):
            return quote[: m.start()] + head + quote[m.end() :]
    return None


def expand_definition_text(text: str, headword: str) -> str:
    """Write out --suffix in a definition by the rules of inflection: y gives way to ies and ied, a final e to ed, ing, er and est."""
    if not text or not headword:
        return text or ""

    def full(m):
        tail = m[1]
        if headword.endswith("y") and tail in ("ies", "ied"):
            return headword[:-1] + tail
        if headword.endswith("e") and tail in ("ed", "ing", "er", "est"):
            return headword[:-1] + tail
        return headword + tail

    return re.sub(r"--([a-z]+)", full, text)


@F.pandas_udf(StringType())
def expand_quote(quote: pd.Series, headword: pd.Series) -> pd.Series:
    """SCL-22 over Arrow batches."""
    return pd.Series([expand_quote_text(q, h) or q for q, h in zip(quote, headword, strict=True)])


@F.pandas_udf(StringType())
def expand_definition(text: pd.Series, headword: pd.Series) -> pd.Series:
    """SCL-23 over Arrow batches."""
    return pd.Series([expand_definition_text(t, h) for t, h in zip(text, headword, strict=True)])


def clean_definition(s: Column) -> Column:
    """SCL-24: no empty parentheses, no space before punctuation, no doubled punctuation or spaces."""
    s = F.regexp_replace(s, r"\(\s*[,;:.]*\s*\)", "")
    s = F.regexp_replace(s, r"\s+([,;:.!?)])", "$1")
    s = F.regexp_replace(s, r"([,;:])(\s*[,;:])+", "$1")
    return clean_text(s)


def sanitize_search(q: Column) -> Column:
    """SCL-25: trimmed, without the operators of search expressions."""
    return F.trim(F.translate(F.trim(q), '"*-+', ""))


def truncate(s: Column, n: int) -> Column:
    """SCL-26: at most n characters, and an ellipsis if there were more."""
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)


def translate_abbreviation(df, key: str, dim, abbreviation: str, value: str):
    """SCL-28: the value of an abbreviation by a dimension table, or the abbreviation itself; without its spaces where only that matches."""
    d = dim.select(F.col(abbreviation).alias("_abbr"), F.col(value).alias("_value")).dropDuplicates(["_abbr"])
    first = df.join(d, F.col(key) == F.col("_abbr"), "left").drop("_abbr").withColumnRenamed("_value", "_first")
    second = first.join(d, F.regexp_replace(F.col(key), r"\s+", "") == F.col("_abbr"), "left").drop("_abbr")
    return second.withColumn("resolved", F.coalesce("_first", "_value", F.col(key))).drop("_first", "_value")


def clean_ui_word(s: Column) -> Column:
    """SCL-29: a clicked word in lower case, without punctuation at its ends."""
    return F.regexp_replace(F.lower(s), r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", "")


def key_matches(word: Column, key: Column) -> Column:
    """SCL-29: a word and a key belong together if they are equal but for case and sense number, or one begins with the other."""
    w, k = clean_ui_word(word), strip_sense_number(F.lower(key))
    return (w == k) | ((F.length(k) >= 4) & F.startswith(w, k)) | ((F.length(w) >= 4) & F.startswith(k, w))


def reference_label(abbreviation: Column, act: Column, scene: Column, line: Column) -> Column:
    """SCL-30: Ham. 3.1.56, leaving out what is null."""
    return F.concat_ws(" ", abbreviation, F.nullif(F.concat_ws(".", act.cast("string"), scene.cast("string"), line.cast("string")), F.lit("")))


def unescape_html(s: str) -> str:
    return html.unescape(s)
