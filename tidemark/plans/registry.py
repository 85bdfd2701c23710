"""The core's query modules, each with QUERIES (name -> callable) and SQL (name -> DuckDB text)."""

from __future__ import annotations

import importlib

MODULES = ["interval_queries", "text_queries", "segment_queries", "claim_queries", "retrieval_queries", "store_queries", "misc_queries"]


def _collect(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"tidemark.plans.{name}"), what)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("SQL")
