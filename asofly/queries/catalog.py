"""Registry of named queries over the given tables, with the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from asofly.queries import aggregates, base, core, io, research, statistics  # noqa: F401  the modules register their queries
from asofly.queries.base import Query


def queries() -> dict[str, Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["D15_factor_evaluation"](spark, sf_dir)
