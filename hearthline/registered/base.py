"""Registry and small helpers for queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Added before rounding on both sides, so that exact decimal ties round the same way in every engine.
TIE_SHIFT = "0.00000000013"


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Rounds double columns, so that summation order does not show; counts become bigint."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("double", "float"):
            columns.append((F.round(F.col(field.name).cast("double") + F.lit(float(TIE_SHIFT)), special.get(field.name, digits)) + F.lit(0.0)).alias(field.name))
        elif kind in ("byte", "short", "integer"):
            columns.append(F.col(field.name).cast("bigint").alias(field.name))
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)


def r(expression: str, alias: str, digits: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE) + CAST({TIE_SHIFT} AS DOUBLE), {digits}) + 0.0 AS {alias}"


def n(expression: str, alias: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {alias}"
