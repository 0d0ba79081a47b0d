"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "packing", "mixing", "hamming", "near_dups", "secrets", "toxicity", "token_counts", "tiff", "html_text", "url_filter", "clusters", "bin_completion", "divergence",
)

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"orrery.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= getattr(_module, "ORACLE_SQL", {})
