"""Registered queries: compositions of the operators over the given tables, each with its SQL."""

from __future__ import annotations


def _loaded():
    from . import articles, book, decisions, ladder, learning, market, news, registry, scans, stack, streams, tables  # noqa: F401

    return registry


def queries() -> dict:
    return dict(_loaded().QUERIES)


def oracle_sql() -> dict:
    return dict(_loaded().SQL)
