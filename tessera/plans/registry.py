"""Where the queries register, each with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.tables import VIEWS, read_table, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, *tables: str):
    """Registers f(*tables) under its name; a table is a view of the model or a file."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(view(spark, sf_dir, t) if t in VIEWS else read_table(spark, sf_dir, t) for t in tables))
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return wrap
