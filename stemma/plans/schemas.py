"""Schemas of the engine's tables."""

from __future__ import annotations

TABLES = {
    "sources": "id long, name string, short_code string, url string, license string, license_url string, attribution_text string, attribution_required boolean, notes string",
    "works": "id long, oss_id string, title string, short_title string, schmidt_abbrev string, work_type string, genre_type string, perseus_id string",
    "characters": "id long, work_id long, char_id string, name string, abbrev string",
    "editions": "id long, name string, short_code string, source_id long, year int, editors string, description string, source_key string, license_tier string",
    "attributions": "id long, source_id long, required boolean, display_context string, format string, text string",
    "text_lines": "id long, work_id long, edition_id long, act int, scene int, line_number int, char_name string, content string, content_type string, word_count int",
    "text_divisions": "id long, work_id long, edition_id long, act int, scene int, description string, line_count int",
    "lexicon_entries": "id long, key string, base_key string, sense_group int, letter string, full_text string",
    "lexicon_senses": "id long, entry_id long, sense_number int, sub_sense string, definition_text string",
    "lexicon_citations": "id long, entry_id long, sense_id long, work_id long, work_abbrev string, act int, scene int, line int, quote_text string, display_text string, raw_bibl string, headword string",
    "citation_matches": "citation_id long, text_line_id long, edition_id long, match_type string, confidence double, matched_text string",
    "line_mappings": "work_id long, act int, scene int, align_order int, edition_a_id long, edition_b_id long, line_a_id long, line_b_id long, match_type string, similarity double",
    "import_log": "timestamp timestamp, phase string, count long, seconds double",
    "reference_entries": "id long, source string, headword string, letter string, raw_text string",
    "word_annotations": "line_id long, position int, word string, lemma string, pos string",
    "reference_citations": "id long, entry_id long, source string, work_id long, act int, scene int, line int",
    "reference_citation_matches": "citation_id long, text_line_id long, edition_id long, match_type string, confidence double, matched_text string",
}
