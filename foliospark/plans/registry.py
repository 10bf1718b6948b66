"""Registration of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL that gives the same rows where SQL can."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def columns(name: str, source: str, keys: list[str], cols: dict, where: str | None = None, base=None, base_sql: str | None = None) -> None:
    """A query of key columns and computed columns over a whole table: {alias: (function that gives the Spark column, SQL expression)}."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, source)
        if where:
            df = df.where(where)
        if base:
            df = base(df)
        return df.select(*keys, *(c().alias(a) for a, (c, _) in cols.items()))

    sql = f"SELECT {', '.join(keys)}, " + ", ".join(f"{e} AS {a}" for a, (_, e) in cols.items()) + f" FROM {base_sql or source}"
    QUERIES[name] = run
    ORACLES[name] = sql + (f" WHERE {where}" if where else "")
