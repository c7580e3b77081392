"""The subpackage's register: queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, exact_dedup, fingerprints, html_text, jaccard_join, licenses, lm_score, packing, quality, warc

QUERIES = {
    "op1_jaccard_join": jaccard_join.query,
    "op2_byte_bpe": bpe.query,
    "op3_order_minhash": fingerprints.query,
    "op4_best_fit_packing": packing.query,
    "op5_html_text": html_text.query,
    "op6_exact_dedup": exact_dedup.query,
    "op10_quality": quality.query,
    "op7_license_scan": licenses.query,
    "op8_lm_score": lm_score.query,
    "op9_warc": warc.query,
}
ORACLE_SQL = {"op6_exact_dedup": exact_dedup.ORACLE, "op7_license_scan": licenses.ORACLE, "op9_warc": warc.ORACLE}
