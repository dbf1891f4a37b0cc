"""Every registered query of the library, with its SQL twin where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from gavel.registry import ORACLES, QUERIES, Query

FLAGSHIP = "flagship"
MODULES = ["feature_queries", "explore_queries", "market_queries", "bidding_queries", "metric_queries", "debias_queries", "source_queries", "stream_queries"]


def _load() -> None:
    for m in MODULES:
        import_module(f"gavel.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
