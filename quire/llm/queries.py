"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quire.llm import bpe, decontamination, erasure, language, language_model, mixing, quality, secrets, similar_texts, suffix_dedup, toxicity, urls, whitening

QUERIES = {
    "op2_similar_texts": similar_texts.op2_similar_texts,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_lm_scores": language_model.op7_lm_scores,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op1_toxicity": toxicity.op1_toxicity,
    "op3_language_id": language.op3_language_id,
    "op10_quality_rules": quality.op10_quality_rules,
    "op4_decontaminate": decontamination.op4_decontaminate,
    "op5_fair_mix": mixing.op5_fair_mix,
    "op8_url_filter": urls.op8_url_filter,
    "op11_whitening": whitening.op11_whitening,
    "op12_erasure": erasure.op12_erasure,
    "op13_bpe": bpe.op13_bpe,
}
ORACLE_SQL = {
    "op4_decontaminate": decontamination.OP4_SQL,
    "op5_fair_mix": mixing.OP5_SQL,
    "op8_url_filter": urls.OP8_SQL,
}
