"""The queries of this subpackage and their SQL, gathered from its modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ["sharding", "mixing", "neardup", "mih", "quality", "packing", "fixity", "toxicity", "secrets_scan", "setjoin"]

QUERIES: dict = {}
ORACLES: dict = {}
for _m in MODULES:
    _mod = import_module(f"scholium.llm.{_m}")
    QUERIES |= _mod.QUERIES
    ORACLES |= getattr(_mod, "ORACLES", {})
