"""Queries of the library's own operators over the driver's tables, and DuckDB SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "hybrid_search"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """t.orders reads the table of that name."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with its SQL if it has one."""

    def register(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


from . import access, code, graphs, memory, retrieval, team, texts, turns, usage  # noqa: E402, F401
