"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("p1_syntax", "p2_credentials", "p3_tokens", "p4_answers", "p5_origin", "p6_leaks", "p7_mixture", "p8_sentences")
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"lodestack.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= getattr(_module, "SQL", {})
