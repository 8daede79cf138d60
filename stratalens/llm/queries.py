"""The registry of this subpackage: name to query, and name to oracle SQL."""

from __future__ import annotations

from stratalens.llm import bpe, exact_dedup, html_model, language, licences, media, packing, quality, simhash, token_counts

QUERIES = {
    f.__name__: f
    for f in (
        html_model.op1_html_tree_model,
        exact_dedup.op2_exact_dedup,
        media.op3_telephony_media,
        language.op4_language_id,
        quality.op5_quality_compression,
        bpe.op6_bpe_round_trip,
        packing.op7_best_fit_packing,
        licences.op8_licence_scan,
        simhash.op9_covering_simhash,
        token_counts.op10_token_counts,
    )
}
ORACLES = {"op2_exact_dedup": exact_dedup.OP2_SQL, "op8_licence_scan": licences.OP8_SQL}
