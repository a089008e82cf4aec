"""The registered queries of the company jobs and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("list_queries", "text_queries", "job_queries", "io_queries", "page_queries", "name_queries", "board_queries", "office_queries", "candidate_queries")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in _MODULES:
    _module = import_module(f"meibo.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
