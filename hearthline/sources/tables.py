"""CSV and multi-run readers, and the sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline import schemas


class MissingColumns(ValueError):
    """A table lacks columns that its contract names."""


def read_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """CSV with header; a leading byte-order mark is dropped by the reader."""
    return spark.read.csv(path, header=True, schema=ddl, enforceSchema=False, encoding="UTF-8")


def read_labels(spark: SparkSession, path: str, columns: Sequence[str] = schemas.LABEL_COLUMNS) -> DataFrame:
    """Label table; every contract column must be in the header, others are dropped."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    names = {c.lstrip("﻿"): c for c in raw.columns}
    missing = [c for c in columns if c not in names]
    if missing:
        raise MissingColumns(f"{path}: missing columns {', '.join(missing)}")
    key, *labels = columns
    return raw.select(F.col(names[key]).alias(key), *[F.col(names[c]).try_cast("int").alias(c) for c in labels])


def read_run_metrics(spark: SparkSession, glob: str, ddl: str = schemas.METRIC_DDL, pattern: str = r"seed_?(\d+)") -> DataFrame:
    """Metric files of many runs in one read, with the seed taken from the path; a path without one is an error."""
    rows = spark.read.csv(glob, header=True, schema=ddl).withColumn("path", F.col("_metadata.file_path"))
    seed = F.regexp_extract("path", pattern, 1)
    checked = F.when(seed == "", F.raise_error(F.concat(F.lit("no seed in path "), F.col("path")))).otherwise(seed.cast("int"))
    return rows.withColumn("seed", checked).drop("path")


def write_jsonl(df: DataFrame, path: str, append: bool = False, rows_per_file: int | None = None) -> None:
    writer = df.write.mode("append" if append else "overwrite")
    if rows_per_file is not None:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Artifact for people; features are kept as Parquet so that values survive unchanged."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_features(df: DataFrame, path: str, partition_by: Sequence[str] = ("split",)) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


REQUEST_FILE_ROWS = 5000


def write_requests(requests: DataFrame, path: str) -> None:
    """Request documents as text, one folder per set-up, at most 5,000 lines per file."""
    requests.select("config", F.col("request").alias("value")).write.mode("overwrite").partitionBy("config").option(
        "maxRecordsPerFile", REQUEST_FILE_ROWS
    ).text(path)
