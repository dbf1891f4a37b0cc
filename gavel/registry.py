"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.tables import BIDS_CTE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, bids: bool = True) -> Callable[[Query], Query]:
    """Register a query; sql is its twin over the `bids` view (or over the plain tables, with bids=False)."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"{BIDS_CTE}{sql}" if bids else sql
        return f

    return add


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, as the twins round theirs."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
