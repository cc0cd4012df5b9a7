"""The dealt operators as queries over the driver's tables, and their oracle SQL."""

from __future__ import annotations

from . import (
    alignment, decontamination, licences, line_dedup, mixing, near_dup, pii, quality_model, quality_rules, simhash, spelling, suffix_dedup,
    url_filter,
)

QUERIES = {
    "op1_pii": pii.op1,
    "op2_url_filter": url_filter.op2,
    "op3_quality_rules": quality_rules.op3,
    "op4_decontamination": decontamination.op4,
    "op5_licences": licences.op5,
    "op6_source_mixing": mixing.op6,
    "op7_near_dup": near_dup.op7,
    "op8_line_dedup": line_dedup.op8,
    "op9_quality_model": quality_model.op9,
    "op10_suffix_dedup": suffix_dedup.op10,
    "op11_simhash": simhash.op11,
    "op12_spelling": spelling.op12,
    "op13_alignment": alignment.op13,
}

ORACLES = {
    "op2_url_filter": url_filter.ORACLE,
    "op3_quality_rules": quality_rules.ORACLE,
    "op4_decontamination": decontamination.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
}
