"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (
    op1_near_duplicates,
    op2_decontamination,
    op3_toxicity,
    op4_token_counts,
    op5_packing,
    op6_sharding,
    op7_quality_rules,
    op8_quality_classifier,
    op9_line_dedup,
    op10_substring_dedup,
)

#: Modules that register a query: NAME, query(spark, sf_dir) and, where SQL can express it, ORACLE_SQL.
MODULES = (
    op1_near_duplicates,
    op2_decontamination,
    op3_toxicity,
    op4_token_counts,
    op5_packing,
    op6_sharding,
    op7_quality_rules,
    op8_quality_classifier,
    op9_line_dedup,
    op10_substring_dedup,
)


def queries():
    return {m.NAME: m.query for m in MODULES}


def oracle_sql():
    return {m.NAME: m.ORACLE_SQL for m in MODULES if getattr(m, "ORACLE_SQL", None)}
