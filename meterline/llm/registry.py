"""The registered queries of this subpackage and the DuckDB statements of those that SQL can express."""

from meterline.llm import (align, chaining, cotraining, fingerprints, mixing, pieces, quality_rules, runs, simhash, suffixes, token_counts,
                           toxic_spans, treescore)

QUERIES = {
    "op1_suffix_dedup": suffixes.query,
    "op2_token_counts": token_counts.query,
    "op3_sentencepiece": pieces.query,
    "op4_quality_rules": quality_rules.query,
    "op5_source_mixing": mixing.query,
    "op6_tree_score": treescore.query,
    "op7_chaining": chaining.query,
    "op8_order_minhash": fingerprints.query,
    "op9_cotraining": cotraining.query,
    "op10_simhash": simhash.query,
    "op11_periodic_runs": runs.query,
    "op12_toxic_spans": toxic_spans.query,
    "op13_token_alignment": align.query,
}
ORACLES: dict[str, str] = {}
