"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from loomgraph.llm import op01_mixing, op02_embeddings, op03_chat, op04_packing, op05_jaccard, op06_toxicity, op07_urls, op08_secrets, op09_substrings, op10_decontamination, op11_best_fit, op12_resampling, op13_alignment


def queries() -> dict:
    return {
        "op1_mix_sources": op01_mixing.query,
        "op2_embedding_forest": op02_embeddings.query,
        "op3_chat_tree": op03_chat.query,
        "op4_packed_tokens": op04_packing.query,
        "op5_jaccard_trie": op05_jaccard.query,
        "op6_toxic_segments": op06_toxicity.query,
        "op7_url_rules": op07_urls.query,
        "op8_secret_formats": op08_secrets.query,
        "op9_suffix_levels": op09_substrings.query,
        "op10_benchmark_leaks": op10_decontamination.query,
        "op11_best_fit_rounds": op11_best_fit.query,
        "op12_target_resampling": op12_resampling.query,
        "op13_group_alignment": op13_alignment.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {"op1_mix_sources": op01_mixing.SQL, "op7_url_rules": op07_urls.SQL, "op12_target_resampling": op12_resampling.SQL}
