"""Operators of a training-data pipeline over text and embedding tables.

Nothing else in the library imports this subpackage. ``load_queries`` gives the registered
queries, one ``opN_<name>`` per operator, and the SQL twins of those that have one.
"""

from __future__ import annotations

from . import queries as _queries


def load_queries():
    """``(queries, oracles)``: callables of (spark, folder), and SQL by the same names."""
    return dict(_queries.QUERIES), dict(_queries.ORACLES)
