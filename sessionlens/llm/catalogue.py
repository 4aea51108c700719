"""The subpackage's registered queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, fim, golden, html_text, lattice, mixing, near_dedup, pii, quality, substrings, topk, toxicity, warc

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_pii": pii.op2_pii,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_quality": quality.op5_quality,
    "op6_mixing": mixing.op6_mixing,
    "op7_html": html_text.op7_html,
    "op8_substrings": substrings.op8_substrings,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_warc": warc.op10_warc,
    "op11_embedding_dedup": lattice.op11_embedding_dedup,
    "op12_fim": fim.op12_fim,
    "op13_golden": golden.op13_golden,
}

ORACLE_SQL = {
    "op1_topk": topk.ORACLE,
    "op10_warc": warc.ORACLE,
    "op12_fim": fim.ORACLE,
    "op13_golden": golden.ORACLE,
}
