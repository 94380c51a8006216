"""All registered queries, imported for their registration side effect."""

from __future__ import annotations

from quantloom.plans import (q_decisions, q_env, q_intake, q_io, q_memory, q_metrics, q_more, q_news,  # noqa: F401
                             q_portfolio, q_retrieval, q_stream, q_text)
from quantloom.plans.registry import REGISTRY


def queries():
    return {name: fn for name, (fn, _sql) in REGISTRY.items()}


def oracle_sql():
    return {name: sql for name, (_fn, sql) in REGISTRY.items() if sql is not None}
