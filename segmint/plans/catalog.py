"""All registered queries and their SQL oracles."""

from __future__ import annotations

from . import batch, streams


def queries() -> dict:
    return {**batch.Q, **streams.Q}


def oracle_sql() -> dict:
    return {**batch.SQL, **streams.SQL}
