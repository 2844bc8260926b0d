"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadgrain.plans import engine, problems, reference  # noqa: F401  engine registers its queries
from roadgrain.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def shipped(f: Query) -> Query:
    """The query, with the package's code sent to the Python workers first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(ship(spark), sf_dir)

    run.__name__ = f.__name__
    run.__doc__ = f.__doc__
    return run


def queries() -> dict[str, Query]:
    return {k: shipped(f) for k, f in (reference.Q | problems.queries()).items()}


def oracle_sql() -> dict[str, str]:
    return reference.SQL | problems.oracle_sql()
