"""The subpackage's queries, each over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from seqloom.llm import ann, bpe, exact_dedup, html_text, langid, packing, pii, secrets_scan, simhash, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_secret_scan": secrets_scan.query,
    "op3_pii": pii.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_byte_bpe": bpe.query,
    "op6_html_text": html_text.query,
    "op7_toxicity": toxicity.query,
    "op8_nearest_neighbours": ann.query,
    "op9_language_id": langid.query,
    "op10_simhash_near_dedup": simhash.query,
}

SQL = {"op4_exact_dedup": exact_dedup.SQL}
