"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: module -> names of its queries
_MODULES = {
    "near_dedup": ["op1_near_dedup"],
    "decontaminate": ["op2_decontaminate"],
    "quality": ["op3_quality"],
    "substring_dedup": ["op5_substring_dedup"],
    "pii": ["op4_pii"],
    "secrets": ["op9_secrets"],
    "warc": ["op10_warc"],
    "sharding": ["op6_sharding"],
    "exact_dedup": ["op7_exact_dedup"],
    "packing": ["op8_packing"],
    "spelling": ["op11_spelling"],
    "line_dedup": ["op12_line_dedup"],
    "fill_middle": ["op13_fill_middle"],
}


def queries() -> dict:
    found = {}
    for module, names in _MODULES.items():
        loaded = importlib.import_module(f"{__package__}.{module}")
        found |= {name: getattr(loaded, name) for name in names}
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _MODULES:
        found |= getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", {})
    return found
