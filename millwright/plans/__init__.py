"""Registered queries (one per operator of the inventory) and their DuckDB oracles."""

from __future__ import annotations


def load_all():
    """Import every query module and return ``(QUERIES, ORACLES)``."""
    from millwright.plans import fleet_queries  # noqa: F401
    from millwright.plans import risk_queries  # noqa: F401
    from millwright.plans import request_queries  # noqa: F401
    from millwright.plans import ml_queries  # noqa: F401
    from millwright.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
