"""Queries of the training-data operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from . import decontaminate, language, masked, neardup, neighbours, packing, phrases, regions, repeats, rules, store, toxicity, whitening


def queries() -> dict:
    return {
        "op1_language_id": language.query,
        "op2_toxicity": toxicity.query,
        "op3_quality_classifier": neighbours.query,
        "op4_content_addressed_store": store.query,
        "op5_quality_rules": rules.query,
        "op6_suffix_array_dedup": repeats.query,
        "op7_minhash_near_dedup": neardup.query,
        "op8_lm_scoring": masked.query,
        "op9_benchmark_decontamination": decontaminate.query,
        "op10_best_fit_packing": packing.query,
        "op11_phrase_collocations": phrases.query,
        "op12_ngram_jaccard_join": regions.query,
        "op13_embedding_whitening": whitening.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_quality_rules": rules.SQL,
        "op7_minhash_near_dedup": neardup.SQL,
        "op9_benchmark_decontamination": decontaminate.SQL,
        "op11_phrase_collocations": phrases.SQL,
        "op12_ngram_jaccard_join": regions.SQL,
    }
