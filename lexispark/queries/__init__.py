"""The registered queries: each has a DataFrame form and, where it can be told, the same result as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import ship
from ..plans.keep import spread

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def put(function: Query) -> Query:
        _queries[function.__name__] = function
        if sql:
            _sql[function.__name__] = sql
        return function

    return put


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table; with ``columns`` only these, dealt over all cores if the table is small."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(frame.select(*columns)) if columns else frame


def all_queries() -> dict[str, Query]:
    from . import context, core, scalars, votes  # noqa: F401 - they register on import

    return {name: _shipped(function) for name, function in _queries.items()}


def _shipped(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return function(spark, sf_dir)

    run.__name__ = function.__name__
    return run


def all_sql() -> dict[str, str]:
    all_queries()
    return dict(_sql)


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """A VALUES table in SQL."""
    cell = lambda v: "NULL" if v is None else quoted(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS {names}"
