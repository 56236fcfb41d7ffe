"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stemma.llm import bitsliced, byte_bpe, dedup_units, jaccard, licenses, packing, pii, prefix_trie, pstable, quality, repair, secrets, warc_zip


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def tokenizer_file(name: str) -> str:
    """A public vocabulary file of this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def queries() -> dict:
    return {
        "op1_unit_dedup": lambda s, d: dedup_units.repeat_report(_read(s, d, "documents", "doc_id", "text")),
        "op2_warc_zip": lambda s, d: warc_zip.round_trip_report(_read(s, d, "pages", "page_id", "url", "html")),
        "op3_host_quality": lambda s, d: quality.quality_report(_read(s, d, "documents", "doc_id", "text", "source")),
        "op4_lexical_packing": lambda s, d: packing.pack_documents(_read(s, d, "documents", "doc_id", "text"), tokenizer_file("word_bpe_49k.json")),
        "op5_secret_battery": lambda s, d: secrets.secret_report(_read(s, d, "documents", "doc_id", "text")),
        "op6_byte_bpe": lambda s, d: byte_bpe.encode_report(_read(s, d, "documents", "doc_id", "text"), tokenizer_file("byte_bpe_50k.tiktoken"), pattern()),
        "op7_jaccard_join": lambda s, d: jaccard.component_report(_read(s, d, "documents", "doc_id", "text")),
        "op8_bit_sliced_topk": lambda s, d: bitsliced.search_report(_read(s, d, "embeddings", "vec_id", "embedding")),
        "op9_license_digests": lambda s, d: licenses.license_scan(_read(s, d, "documents", "doc_id", "text")),
        "op10_semi_crf_pii": lambda s, d: pii.pii_report(_read(s, d, "documents", "doc_id", "text")),
        "op11_prefix_trie": lambda s, d: prefix_trie.trie_report(_read(s, d, "conversations", "conv_id", "turn", "role", "text")),
        "op12_conversation_repair": lambda s, d: repair.repair_report(_read(s, d, "conversations", "conv_id", "turn", "role", "text")),
        "op13_pstable_neighbours": lambda s, d: pstable.neighbour_report(_read(s, d, "embeddings", "vec_id", "embedding")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_zip": warc_zip.ORACLE,
        "op3_host_quality": quality.ORACLE,
        "op7_jaccard_join": jaccard.ORACLE,
        "op8_bit_sliced_topk": bitsliced.ORACLE,
        "op9_license_digests": licenses.oracle(),
        "op11_prefix_trie": prefix_trie.ORACLE,
        "op12_conversation_repair": repair.oracle(),
    }
