"""Queries of the library's own operators, and their SQL."""

from __future__ import annotations

from tidemark.plans import market, texts


def queries() -> dict:
    return {**market.QUERIES, **texts.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**market.SQL, **texts.SQL}
