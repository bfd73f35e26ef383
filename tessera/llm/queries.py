"""The registered queries of the subpackage: one ``opN_<name>`` per operator,
each over its whole table, with production parameters."""

from __future__ import annotations

from tessera.llm import (collocations, manifest, near_dups, packing, passages, pii, quality, sharding, substrings, tiling,
                         token_counts, toxicity, warc)
from tessera.sources.tables import read_table


def _table(spark, sf_dir, name):
    return read_table(spark, sf_dir, name, spread_rows=False)


def op2_minhash_near_dedup(spark, sf_dir):
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_quality_rules(spark, sf_dir):
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_warc(spark, sf_dir):
    return (warc.archive_pages(_table(spark, sf_dir, "pages"))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op5_compact_windows(spark, sf_dir):
    return passages.passage_duplicates(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    return substrings.substring_dedup(_table(spark, sf_dir, "documents"))


def op7_label_propagation(spark, sf_dir):
    return sharding.balanced_shards(_table(spark, sf_dir, "documents"))


def op8_pii(spark, sf_dir):
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op9_string_tiling(spark, sf_dir):
    return tiling.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark, sf_dir):
    return manifest.tampering_audit(_table(spark, sf_dir, "documents"))


def op12_token_counts(spark, sf_dir):
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op13_phrase_collocations(spark, sf_dir):
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_warc": op4_warc,
    "op5_compact_windows": op5_compact_windows,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_label_propagation": op7_label_propagation,
    "op8_pii": op8_pii,
    "op9_string_tiling": op9_string_tiling,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_counts": op12_token_counts,
    "op13_phrase_collocations": op13_phrase_collocations,
}

SQL: dict[str, str] = {
    "op1_quality_rules": quality.SQL,
    "op11_merkle_manifest": manifest.SQL,
    "op13_phrase_collocations": collocations.SQL,
}
