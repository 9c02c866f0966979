"""The queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from ledgerloom.llm import (
    decontamination,
    filter_audit,
    language_id,
    line_cleaning,
    lm_scoring,
    mixing,
    packing,
    quality_qda,
    secret_scan,
    sharding,
    simhash_dedup,
    source_divergence,
    suffix_dedup,
)

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_ppm": lm_scoring.op2_ppm,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_language_mixture": language_id.op4_language_mixture,
    "op5_simhash": simhash_dedup.op5_simhash,
    "op6_mix": mixing.op6_mix,
    "op7_qda": quality_qda.op7_qda,
    "op8_line_cleaning": line_cleaning.op8_line_cleaning,
    "op9_decontaminate": decontamination.op9_decontaminate,
    "op10_rendezvous": sharding.op10_rendezvous,
    "op11_source_divergence": source_divergence.op11_source_divergence,
    "op12_packing": packing.op12_packing,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

SQL = {
    "op6_mix": mixing.SQL,
    "op8_line_cleaning": line_cleaning.SQL,
    "op9_decontaminate": decontamination.SQL,
    "op11_source_divergence": source_divergence.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
