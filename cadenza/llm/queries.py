"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, clustering, divergence, exact_dedup, language_id, license_scan, line_dedup, mixing, near_dedup, packing, token_count, topk, toxicity

QUERIES = {
    "op1_token_counts": token_count.op1_token_counts,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_bpe": bpe.op4_bpe,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_language_id": language_id.op7_language_id,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_topk": topk.op10_topk,
    "op11_clustering": clustering.op11_clustering,
    "op12_divergence": divergence.op12_divergence,
    "op13_packing": packing.op13_packing,
}

SQL = {
    "op3_near_dedup": near_dedup.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op6_license_scan": license_scan.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op10_topk": topk.SQL,
    "op11_clustering": clustering.SQL,
    "op12_divergence": divergence.SQL,
}
