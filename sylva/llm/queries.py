"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from sylva.llm import capture_index, decontamination, jaccard_join, line_dedup, packing, paragraphs, quality_rules, secrets, toxicity, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_warc_index_merge": capture_index.op4_warc_index_merge,
    "op5_substring_dedup": paragraphs.op5_substring_dedup,
    "op6_benchmark_decontamination": decontamination.op6_benchmark_decontamination,
    "op7_url_filters": url_filter.op7_url_filters,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_secret_scans": secrets.op9_secret_scans,
    "op10_ngram_jaccard_join": jaccard_join.op10_ngram_jaccard_join,
}
SQL: dict[str, str] = {"op1_line_dedup": line_dedup.SQL, "op4_warc_index_merge": capture_index.SQL, "op7_url_filters": url_filter.SQL, "op9_secret_scans": secrets.SQL}
