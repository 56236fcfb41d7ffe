"""Serving views (API-02..22): stats, works, editions, scenes side by side, lexicon entries, references, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.functions.text import slugify, strip_sense_number, truncate
from stemma.operators.align import symmetric

PLAY_TYPES, VERSE_TYPES = ("play", "comedy", "tragedy", "history", "apocrypha"), ("poem", "sonnet_sequence")


def stats_row(**tables: DataFrame) -> DataFrame:
    """API-02, AGG-01: one row with the number of rows of each table, as scalar subqueries."""
    spark = next(iter(tables.values())).sparkSession
    return spark.range(1).select(*[t.agg(F.count("*")).scalar().alias(name) for name, t in tables.items()])


def table_counts(**tables: DataFrame) -> DataFrame:
    """SET-02: table_name, n of each table."""
    out = None
    for name, t in tables.items():
        row = t.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def version(log: DataFrame) -> DataFrame:
    """API-01."""
    return log.agg(F.max("timestamp").alias("built_at"))


def footer_attributions(attributions: DataFrame, sources: DataFrame, editions: DataFrame, lines: DataFrame, also: list[str] | None = None) -> DataFrame:
    """API-03: attributions of the sources whose editions have lines, and of those named besides; required ones first."""
    used = editions.join(lines.select(F.col("edition_id").alias("id")).distinct(), "id", "left_semi").select("source_id")
    named = sources.where(F.col("short_code").isin(also or [])).select(F.col("id").alias("source_id"))
    wanted = used.union(named).distinct()
    return attributions.join(sources.select(F.col("id").alias("source_id"), "name", "short_code"), "source_id").join(wanted, "source_id", "left_semi").orderBy(F.col("required").desc(), "name")


def works_list(works: DataFrame) -> DataFrame:
    """API-04, FLT-19: works with slug and kind (plays, poetry); other types are left out."""
    kind = F.when(F.col("work_type").isin(*PLAY_TYPES), "plays").when(F.col("work_type").isin(*VERSE_TYPES), "poetry")
    return works.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("slug", slugify(F.col("title"))).orderBy("kind", "title")


def find_work(works: DataFrame, key: str) -> DataFrame:
    """API-07: the work with this id or slug."""
    return works.withColumn("slug", slugify(F.col("title"))).where((F.col("slug") == key) | (F.col("id").cast("string") == key))


def table_of_contents(divisions: DataFrame, lines: DataFrame) -> DataFrame:
    """API-05, AGG-19: divisions of each work's lowest edition, with their lines counted anew."""
    lowest = divisions.groupBy("work_id").agg(F.min("edition_id").alias("edition_id"))
    mine = divisions.join(lowest, ["work_id", "edition_id"], "left_semi").select("work_id", "edition_id", "act", "scene")
    counted = lines.groupBy("work_id", "edition_id", "act", "scene").agg(F.count("*").alias("n"))
    l = counted.select(*[F.col(c).alias(f"_{c}") for c in counted.columns])
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("work_id", "edition_id", "act", "scene")]
    return mine.join(l, on, "left").select("work_id", "edition_id", "act", "scene", F.coalesce("_n", F.lit(0)).alias("line_count"))


def divisions(lines: DataFrame) -> DataFrame:
    """AGG-13: lines of each (work, edition, act, scene)."""
    return lines.groupBy("work_id", "edition_id", "act", "scene").agg(F.count("*").alias("line_count"))


def editions_of_works(editions: DataFrame, sources: DataFrame, lines: DataFrame) -> DataFrame:
    """API-06: editions with lines, by work."""
    held = lines.select("work_id", F.col("edition_id").alias("id")).distinct()
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return held.join(editions, "id").join(s, "source_id", "left").orderBy("work_id", "id")


def letters(entries: DataFrame) -> DataFrame:
    """API-09, AGG-03."""
    return entries.groupBy("letter").agg(F.count("*").alias("n")).orderBy("letter")


def adjacent_scenes(scenes: DataFrame) -> DataFrame:
    """API-19, WIN-09: the scene before and after each."""
    w = W.partitionBy("work_id").orderBy("act", "scene")
    place = F.struct("act", "scene")
    return scenes.select("work_id", "act", "scene", F.lag(place).over(w).alias("previous"), F.lead(place).over(w).alias("next"))


def scene_view(lines: DataFrame, mappings: DataFrame, anchor: DataFrame) -> DataFrame:
    """API-12 and API-13: the rows of each scene side by side: work_id, act, scene, row_line (an anchor line, or the anchor line after
    which a gap line stands), gap, position, editions (map of edition to line). anchor: work_id, edition_id of the work's anchor edition.

    Each other edition's lines come through the symmetric mappings; those without an anchor line stand after the last anchor line before
    them (WIN-10). All windows are within one scene and pair of editions."""
    a = anchor.select("work_id", F.col("edition_id").alias("from_edition"))
    mine = lines.join(a, (lines["work_id"] == a["work_id"]) & (lines["edition_id"] == a["from_edition"])).select(lines["work_id"], F.coalesce("act", F.lit(0)).alias("act"), F.coalesce("scene", F.lit(0)).alias("scene"), F.col("id").alias("row_line"), F.col("edition_id").alias("edition"), F.col("id").alias("line_id"))
    sym = symmetric(mappings).join(a, ["work_id", "from_edition"])
    w = W.partitionBy("work_id", "act", "scene", "from_edition", "to_edition").orderBy("align_order").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = sym.withColumn("after", F.last("from_line", ignorenulls=True).over(w)).where("to_line IS NOT NULL")
    mapped = placed.where("from_line IS NOT NULL").select("work_id", "act", "scene", F.col("from_line").alias("row_line"), F.lit(0).alias("gap"), F.lit(0).alias("position"), F.col("to_edition").alias("edition"), F.col("to_line").alias("line_id"))
    gaps = placed.where("from_line IS NULL").select("work_id", "act", "scene", F.col("after").alias("row_line"), F.col("to_edition").cast("int").alias("gap"), F.col("align_order").alias("position"), F.col("to_edition").alias("edition"), F.col("to_line").alias("line_id"))
    own = mine.select("work_id", "act", "scene", "row_line", F.lit(0).alias("gap"), F.lit(0).alias("position"), "edition", "line_id")
    every = own.unionByName(mapped).unionByName(gaps).dropDuplicates(["work_id", "act", "scene", "row_line", "gap", "position", "edition"])
    return every.groupBy("work_id", "act", "scene", "row_line", "gap", "position").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("edition", "line_id")))).alias("editions"))


def visible_editions(view: DataFrame) -> DataFrame:
    """API-13: the editions that appear in a row of a scene."""
    return view.select("work_id", "act", "scene", F.explode(F.map_keys("editions")).alias("edition_id")).distinct()


def scenes_seen(mappings: DataFrame) -> DataFrame:
    """API-13: edition_a_id, edition_b_id, act, scene, seen: whether edition b shows a line beside edition a in a scene. Where a is the anchor,
    visible_editions() of scene_view() is these, and a itself; no line is placed to tell."""
    return mappings.groupBy("edition_a_id", "edition_b_id", "act", "scene").agg((F.count("line_b_id") > 0).alias("seen"))


def first_per_group(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """AGG-09: of each group the row that comes first: what a query with bare columns means here."""
    rest = [c for c in df.columns if c not in group]
    return df.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*group, *[F.col(f"_r.{c}").alias(c) for c in rest])


def best_match(matches: DataFrame, first_edition: int | None = None) -> DataFrame:
    """JN-04: one match for each citation: the preferred edition first, then confidence, then the smallest line."""
    prefer = F.when(F.col("edition_id") == first_edition, 0).otherwise(1) if first_edition is not None else F.lit(0)
    order = F.struct(prefer, -F.col("confidence"), F.col("edition_id"), F.col("text_line_id"))
    cols = [c for c in matches.columns if c != "citation_id"]
    return matches.groupBy("citation_id").agg(F.min_by(F.struct(*cols), order).alias("m")).select("citation_id", *[F.col(f"m.{c}").alias(c) for c in cols])


def revalidated(entry_citations: DataFrame, lines: DataFrame, reach: int = 10) -> DataFrame:
    """API-10: for each matched citation the nearest line, within reach in the same edition and scene, that has a word beginning with the
    headword; the one before first. entry_citations: citation_id, headword, text_line_id."""
    at = lines.select(F.col("id").alias("text_line_id"), "work_id", "edition_id", "act", "scene", F.col("line_number").alias("n"))
    near = lines.select("work_id", "edition_id", F.col("act").alias("a2"), F.col("scene").alias("s2"), F.col("line_number").alias("n2"), F.col("id").alias("near_line"), "content")
    here = entry_citations.join(at, "text_line_id").withColumn("n2", F.explode(F.sequence(F.col("n") - reach, F.col("n") + reach)))
    both = here.join(near, ["work_id", "edition_id", "n2"]).where(F.col("act").eqNullSafe(F.col("a2")) & F.col("scene").eqNullSafe(F.col("s2")))
    head = F.lower(strip_sense_number(F.col("headword")))
    hit = both.where(F.contains(F.concat(F.lit(" "), F.regexp_replace(F.lower("content"), r"[^\p{L}\p{Nd}]+", " ")), F.concat(F.lit(" "), head)))
    apart = F.abs(F.col("n2") - F.col("n"))
    return hit.groupBy("citation_id").agg(F.min_by("near_line", F.struct(apart, F.col("n2"), F.col("near_line"))).alias("valid_line"))


def entry_documents(entries: DataFrame, senses: DataFrame, citations: DataFrame, matches: DataFrame, references: DataFrame) -> DataFrame:
    """API-10 and API-11: one nested row for each base key: entries, senses, citations deduplicated by place with their best match, and the
    reference works that have the headword."""
    key = entries.select(F.col("id").alias("entry_id"), "base_key", "key", "full_text")
    e = key.groupBy("base_key").agg(F.array_sort(F.collect_list(F.struct("key", "entry_id", "full_text"))).alias("entries"))
    s = senses.join(key.select("entry_id", "base_key"), "entry_id").groupBy("base_key").agg(F.array_sort(F.collect_list(F.struct("entry_id", "sense_number", "sub_sense", "definition_text"))).alias("senses"))
    c = citations.join(key.select("entry_id", "base_key"), "entry_id")
    c = first_per_group(c.select("base_key", "work_id", "act", "scene", "line", F.col("id").alias("citation_id"), "quote_text", "display_text"), ["base_key", "work_id", "act", "scene", "line"], ["citation_id"])
    c = c.join(best_match(matches).select("citation_id", "text_line_id", "match_type", "confidence"), "citation_id", "left")
    c = c.groupBy("base_key").agg(F.array_sort(F.collect_list(F.struct("work_id", "act", "scene", "line", "citation_id", "quote_text", "display_text", "text_line_id", "match_type", "confidence"))).alias("citations"))
    r = references.groupBy(F.lower("headword").alias("_k")).agg(F.array_sort(F.collect_list(F.struct("source", "headword", truncate(F.col("raw_text"), 300).alias("text")))).alias("references"))
    return e.join(s, "base_key", "left").join(c, "base_key", "left").join(r, F.lower("base_key") == F.col("_k"), "left").drop("_k")


def capped_documents(docs: DataFrame, column: str = "references", most: int = 90_000) -> DataFrame:
    """API-21: JSON documents of at most so many bytes: the list in column is halved until they fit (or it is empty). The halvings are
    tried in the row, smallest document last."""
    n = F.size(F.coalesce(column, F.array().cast(docs.schema[column].dataType)))
    others = [c for c in docs.columns if c != column]
    sized = lambda k: F.to_json(F.struct(*others, F.slice(column, 1, k).alias(column)))
    kept = F.array(*[F.floor(n / F.lit(2**k)).cast("int") for k in range(12)], F.lit(0))
    tries = F.transform(kept, sized)
    fits = F.try_element_at(F.filter(tries, lambda t: F.octet_length(t) <= most), F.lit(1))
    return docs.select(*others[:1], F.coalesce(fits, F.element_at(tries, -1)).alias("data"))


def span_documents(entries: DataFrame, spans: Column) -> DataFrame:
    """API-22: citation spans of each reference entry as JSON. spans: a column of arrays of spans over raw_text."""
    return entries.select("id", "source", "headword", F.to_json(F.struct(spans.alias("spans"))).alias("citation_spans"))


def line_references(matches: DataFrame, citations: DataFrame, entries: DataFrame, ref_matches: DataFrame, ref_citations: DataFrame, ref_entries: DataFrame) -> DataFrame:
    """API-14: for each line the lexicon and reference entries that cite it, once each."""
    lex = matches.select("citation_id", "text_line_id").join(citations.select(F.col("id").alias("citation_id"), "entry_id"), "citation_id").join(entries.select(F.col("id").alias("entry_id"), F.col("key").alias("headword")), "entry_id").select("text_line_id", F.lit("lexicon").alias("source"), "entry_id", "headword")
    ref = ref_matches.select("citation_id", "text_line_id").join(ref_citations.select(F.col("id").alias("citation_id"), "entry_id"), "citation_id").join(ref_entries.select(F.col("id").alias("entry_id"), "source", "headword"), "entry_id").select("text_line_id", "source", "entry_id", "headword")
    return lex.unionByName(ref).distinct().groupBy("text_line_id").agg(F.array_sort(F.collect_list(F.struct("source", "headword", "entry_id"))).alias("references"))


def row_references(view: DataFrame, references: DataFrame) -> DataFrame:
    """API-17: references of all lines of a row, each entry once."""
    each = view.select("work_id", "act", "scene", "row_line", "position", F.explode("editions").alias("edition", "line_id"))
    r = references.select(F.col("text_line_id").alias("line_id"), F.explode("references").alias("r"))
    return each.join(r, "line_id").select("work_id", "act", "scene", "row_line", "position", "r.source", "r.entry_id", "r.headword").distinct()


def locate(rows: DataFrame, reach: int = 5) -> DataFrame:
    """API-18: the row of a headword: the cited line, else a row within reach, else any in the scene. rows: request, line, row_line,
    line_number, has_word."""
    apart = F.abs(F.col("line_number") - F.col("line"))
    tier = F.when((apart == 0) & F.col("has_word"), 1).when((apart <= reach) & F.col("has_word"), 2).when(F.col("has_word"), 3)
    return rows.withColumn("tier", tier).where("tier IS NOT NULL").groupBy("request").agg(F.min_by(F.struct("row_line", "tier"), F.struct("tier", apart, F.col("line_number") > F.col("line"), "row_line")).alias("b")).select("request", "b.row_line", "b.tier")


def reverse_lookup(matches: DataFrame, citations: DataFrame, entries: DataFrame) -> DataFrame:
    """API-20: lines with the entries that cite them."""
    return matches.join(citations.select(F.col("id").alias("citation_id"), "entry_id"), "citation_id").join(entries.select(F.col("id").alias("entry_id"), "key"), "entry_id").select("text_line_id", "key", "match_type", "confidence")


def passage(lines: DataFrame, at: DataFrame, reach: int = 5) -> DataFrame:
    """API-20: the lines around given ones, in their edition and scene. at: line_id."""
    here = lines.join(at.select(F.col("line_id").alias("id")), "id").select(F.col("id").alias("line_id"), "work_id", "edition_id", "act", "scene", F.explode(F.sequence(F.col("line_number") - reach, F.col("line_number") + reach)).alias("line_number"))
    near = lines.select("work_id", "edition_id", F.col("act").alias("_a"), F.col("scene").alias("_s"), "line_number", F.col("id").alias("near_id"), "content")
    return here.join(near, ["work_id", "edition_id", "line_number"]).where(F.col("act").eqNullSafe(F.col("_a")) & F.col("scene").eqNullSafe(F.col("_s"))).select("line_id", "near_id", "line_number", "content")


def cross_search(entries: DataFrame, references: DataFrame, q: str) -> DataFrame:
    """SET-01, FTS-08: lexicon and reference entries whose headword holds the query, in one order."""
    lex = entries.select(F.lit("lexicon").alias("source"), F.col("base_key").alias("headword"), truncate(F.col("full_text"), 200).alias("text")).dropDuplicates(["headword"])
    ref = references.select("source", "headword", truncate(F.col("raw_text"), 200).alias("text"))
    return lex.unionByName(ref).where(F.contains(F.lower("headword"), F.lit(q.lower()))).orderBy(F.lower("headword"), "source")


def source_counts(entries: DataFrame, references: DataFrame, sources: DataFrame) -> DataFrame:
    """API-16, AGG-04: entries of each source."""
    lex = entries.agg(F.lit("lexicon").alias("source"), F.count_distinct("base_key").alias("n"))
    ref = references.join(sources.select(F.col("short_code").alias("source")), "source").groupBy("source").agg(F.count("*").alias("n"))
    return lex.unionByName(ref)


def build_summary(lines: DataFrame, editions: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """OTH-12, AGG-06: (lines by edition, matches by type with their mean confidence)."""
    by_edition = lines.groupBy("edition_id").agg(F.count("*").alias("lines")).join(editions.select(F.col("id").alias("edition_id"), "short_code"), "edition_id")
    return by_edition, matches.groupBy("match_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))


def title_slugs(abbreviations: DataFrame, works: DataFrame) -> DataFrame:
    """OTH-10: abbreviation -> title -> slug. abbreviations: abbrev, schmidt_abbrev; works: schmidt_abbrev, title."""
    w = works.select("schmidt_abbrev", "title")
    return abbreviations.join(w, "schmidt_abbrev", "left").withColumn("slug", slugify(F.col("title")))
