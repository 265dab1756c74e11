"""Queries of this subpackage, by the names under which they are registered."""

from __future__ import annotations

from . import decontamination, license_scan, line_dedup, lm_scoring, near_dedup, packing, quality, quality_rules, secret_scan, sharding

MODULES = {
    "op1_lm_scoring": lm_scoring,
    "op2_license_scan": license_scan,
    "op3_line_dedup": line_dedup,
    "op4_secret_scan": secret_scan,
    "op5_near_dedup": near_dedup,
    "op6_quality": quality,
    "op7_sharding": sharding,
    "op8_packing": packing,
    "op9_quality_rules": quality_rules,
    "op10_decontamination": decontamination,
}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """Only operators that SQL can express have one; the others are tested in ``tests/llm``."""
    return {name: module.SQL for name, module in MODULES.items() if getattr(module, "SQL", None)}
