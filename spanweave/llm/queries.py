"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chunks, decontam, lexical, packing, quality, roles, secret_scan, simhash, spelling, suffix, suffix_states, telephony, toxicity

QUERIES = {f.__name__: f for f in (telephony.op1_telephony, roles.op2_role_repair, suffix.op3_suffix_dedup, toxicity.op4_noisy_channel, secret_scan.op5_secret_forest, chunks.op6_gear_chunks, simhash.op7_simhash, decontam.op8_decontaminate, quality.op9_rule_quality, packing.op10_curve_packing, spelling.op11_spelling_variants, lexical.op12_windowed_search, suffix_states.op13_suffix_tree_scores)}


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
ORACLES: dict[str, str] = {"op12_windowed_search": lexical.SQL}
