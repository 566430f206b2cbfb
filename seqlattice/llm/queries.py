"""The queries of this subpackage, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from . import bpe, codebooks, importance, line_dedup, mixing, near_dedup, quality, secrets_scan, simhash, substrings, token_counts, topk, url_filter

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_near": near_dedup.op2_near,
    "op3_mixing": mixing.op3_mixing,
    "op4_tokens": token_counts.op4_tokens,
    "op5_simhash": simhash.op5_simhash,
    "op6_secrets": secrets_scan.op6_secrets,
    "op7_quality": quality.op7_quality,
    "op8_lines": line_dedup.op8_lines,
    "op9_urls": url_filter.op9_urls,
    "op10_bpe": bpe.op10_bpe,
    "op11_importance": importance.op11_importance,
    "op12_substrings": substrings.op12_substrings,
    "op13_codes": codebooks.op13_codes,
}
ORACLE_SQL = {
    "op1_topk": topk.OP1_SQL,
    "op2_near": near_dedup.OP2_SQL,
    "op6_secrets": secrets_scan.OP6_SQL,
    "op9_urls": url_filter.OP9_SQL,
    "op12_substrings": substrings.OP12_SQL,
    "op13_codes": codebooks.OP13_SQL,
}
