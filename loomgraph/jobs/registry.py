"""Where queries over the derived tables register themselves, each with the SQL that DuckDB answers it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of the derived tables as a query, with its SQL."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(T.Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return put
