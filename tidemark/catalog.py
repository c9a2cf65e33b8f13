"""All registered queries of the lineage engine and the relational surface, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column lineage of the sample project, from SQL text to mappings."""
    return QUERIES["lineage_column_mappings"](spark, sf_dir)


from tidemark.functions import queries as _functions  # noqa: E402,F401
from tidemark.operators import queries as _operators  # noqa: E402,F401
from tidemark.plans import queries as _plans  # noqa: E402,F401
from tidemark.streaming import queries as _streaming  # noqa: E402,F401
