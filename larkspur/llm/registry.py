"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, divergence, embedding_dedup, language_id, multi_index, oracle, packing, panes, pii, quality, secrets, simhash, substring_dedup, suffix_array


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_simhash": simhash.op2_simhash,
        "op3_pii": pii.op3_pii,
        "op4_byte_bpe": byte_bpe.op4_byte_bpe,
        "op5_packing": packing.op5_packing,
        "op6_quality": quality.op6_quality,
        "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
        "op8_secrets": secrets.op8_secrets,
        "op9_suffix_array": suffix_array.op9_suffix_array,
        "op10_multi_index": multi_index.op10_multi_index,
        "op11_divergence": divergence.op11_divergence,
        "op12_panes": panes.op12_panes,
        "op13_language_id": language_id.op13_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
