"""All queries of the analytics engine, by name, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles, parts, parts_sql
from . import queries as q


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.citation_distribution(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in [*q.ALL, *parts.ALL]}


def oracle_sql() -> dict[str, str]:
    return oracles.ALL | parts_sql.ALL
