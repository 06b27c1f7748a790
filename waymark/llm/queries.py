"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from waymark.llm import bpe, context_tree, divergence, exact_dedup, html_extraction, image_copies, language_id, mixing, prefix_trie, quality_rules, simhash, token_store, warc


def queries() -> dict:
    return {
        "op1_token_store": token_store.op1_token_store,
        "op2_warc": warc.op2_warc,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_image_copies": image_copies.op4_image_copies,
        "op5_simhash_dedup": simhash.op5_simhash_dedup,
        "op6_mixing": mixing.op6_mixing,
        "op7_context_tree": context_tree.op7_context_tree,
        "op8_bpe": bpe.op8_bpe,
        "op9_html_extraction": html_extraction.op9_html_extraction,
        "op10_language_id": language_id.op10_language_id,
        "op11_exact_dedup": exact_dedup.op11_exact_dedup,
        "op12_divergence": divergence.op12_divergence,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.OP2_SQL,
        "op3_quality_rules": quality_rules.OP3_SQL,
        "op6_mixing": mixing.OP6_SQL,
        "op11_exact_dedup": exact_dedup.OP11_SQL,
        "op12_divergence": divergence.OP12_SQL,
        "op13_prefix_trie": prefix_trie.OP13_SQL,
    }
