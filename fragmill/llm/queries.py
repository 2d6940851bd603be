"""The corpus operators' queries, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from . import ann, licenses, packing, pieces, secrets, simhash, token_counts, token_io, topk, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_exact_top_k": topk.op4_exact_top_k,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_token_binary": token_io.op8_token_binary,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_one_bit_ann": ann.op10_one_bit_ann,
}

SQL = {"op4_exact_top_k": topk.OP4_SQL}
