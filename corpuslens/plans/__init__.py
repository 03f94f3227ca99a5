"""The registered queries."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES, Tables

MODULES = [
    "inventory_queries",
    "scan_queries",
    "property_queries",
    "classify_queries",
    "statistics_queries",
    "report_queries",
    "text_queries",
    "rule_queries",
    "snapshot_queries",
    "scanner_queries",
    "similarity_queries",
    "file_queries",
    "stream_queries",
    "corpus_queries",
    "store_queries",
]


def load_queries():
    """Import every query module, which registers its queries, and return the register."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES


__all__ = ["MODULES", "ORACLES", "QUERIES", "Tables", "load_queries"]
