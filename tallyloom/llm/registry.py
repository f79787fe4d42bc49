"""The training-data queries by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from tallyloom.llm import backoff, decontaminate, discriminant, packing, quality, secrets, simhash, substrings, urls, warc

QUERIES = {
    "op1_lm_scoring": backoff.op1_lm_scoring,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_secret_scans": secrets.op4_secret_scans,
    "op5_warc": warc.op5_warc,
    "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
    "op7_url_filters": urls.op7_url_filters,
    "op8_quality_classifier": discriminant.op8_quality_classifier,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_packing": packing.op10_packing,
}

SQL: dict[str, str] = {
    "op1_lm_scoring": backoff.OP1_SQL,
    "op2_substring_dedup": substrings.OP2_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_benchmark_decontamination": decontaminate.OP6_SQL,
    "op7_url_filters": urls.OP7_SQL,
}
