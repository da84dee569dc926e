"""The queries of the corpus operators."""

from __future__ import annotations

from . import bpe, chaining, exact_dedup, html, lm, mixing, resampling, runs, secret_spans, simhash, suffix, topk, toxicity

QUERIES = {
    "op1_html": html.op1_html,
    "op2_mixing": mixing.op2_mixing,
    "op3_lm": lm.op3_lm,
    "op4_suffix": suffix.op4_suffix,
    "op5_bpe": bpe.op5_bpe,
    "op6_chaining": chaining.op6_chaining,
    "op7_topk": topk.op7_topk,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_simhash": simhash.op9_simhash,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_secrets": secret_spans.op11_secrets,
    "op12_resampling": resampling.op12_resampling,
    "op13_runs": runs.op13_runs,
}
ORACLES = {
    "op7_topk": topk.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
