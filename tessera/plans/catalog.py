"""Named queries of the core and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import answering, history, operations, search

_MODULES = (search, answering, operations, history)


def flagship(spark: SparkSession, root: str) -> DataFrame:
    return answering.o103_answers(spark, root)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
