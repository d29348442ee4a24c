"""Queries of the corpus operators, and SQL for those that it can express."""

from __future__ import annotations

from auditspark.llm import alignment, exact_dedup, importance, language_id, media_columns, near_dedup, neighbours, packing, piece_codec, stages, token_counts, toxicity, url_rules, warc_bundles

QUERIES = {
    "op1_sentencepiece": piece_codec.op1_sentencepiece,
    "op2_warc": warc_bundles.op2_warc,
    "op3_media": media_columns.op3_media,
    "op4_language": language_id.op4_language,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_url_rules": url_rules.op9_url_rules,
    "op10_packing": packing.op10_packing,
    "op11_alignment": alignment.op11_alignment,
    "op12_neighbours": neighbours.op12_neighbours,
    "op13_importance": importance.op13_importance,
    "pipeline": stages.run,
}
ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc_bundles.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
}
