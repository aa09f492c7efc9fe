"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tabforge.llm import decontaminate, jaccard, license, mtree, packing, quality, rollup, substring, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_license_scan": license.op4_license_scan,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_warc": warc.op6_warc,
    "op7_exact_top_k": mtree.op7_exact_top_k,
    "op8_quality_cotraining": quality.op8_quality_cotraining,
    "op9_token_rollup": rollup.op9_token_rollup,
    "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
}
SQL = {
    "op4_license_scan": license.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op6_warc": warc.SQL,
    "op7_exact_top_k": mtree.SQL,
}
