"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("alignment", "bpe", "chat", "divergence", "html", "language", "mixing", "quality", "simhash", "substring", "suffixes", "urls", "winnowing")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in _MODULES:
    _module = import_module(f"meibo.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
