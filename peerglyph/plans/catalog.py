"""The list of driver queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, text: str) -> DataFrame:
    """The lines of a small fixed text, as a text source would give them."""
    return spark.createDataFrame([(x,) for x in text.strip("\n").split("\n")], "value string")


def all_queries() -> tuple[dict[str, Query], dict[str, str]]:
    from . import filejobs, fontjobs, scorejobs, textjobs  # noqa: F401  they register their queries

    return QUERIES, ORACLE_SQL
