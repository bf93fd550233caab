"""JSON-lines readers with an explicit schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline import config, schemas
from hearthline.functions.listing import poi_column


class BadRecords(ValueError):
    """Input that a strict read does not accept."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file_path"))
    return lines.filter(F.trim("value") != "")


def parsed_lines(lines: DataFrame, ddl: str) -> DataFrame:
    """Adds record and bad: a line that is not one well-formed JSON object is bad."""
    schema = f"{ddl}, _broken string"
    record = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    looks = F.col("value").rlike(r"^\s*\{")
    parsed = lines.withColumn("record", record)
    return parsed.withColumn("bad", ~looks | F.col("record").isNull() | F.col("record._broken").isNotNull())


def record_columns(ddl_frame: DataFrame) -> list[Column]:
    names = [f.name for f in ddl_frame.schema["record"].dataType.fields if f.name != "_broken"]
    return [F.col("record")[name].alias(name) for name in names]


def read_strict(spark: SparkSession, path: str, ddl: str, with_file: bool = False) -> DataFrame:
    """All records in one pass; a bad line fails the read with its file and text, an input without records fails at once.

    Use ``line_number`` to find the line of such an error.
    """
    parsed = parsed_lines(_lines(spark, path), ddl)
    if not _lines(spark, path).head(1):
        raise BadRecords(f"{path}: no records")
    message = F.concat(F.col("file_path"), F.lit(": not a JSON object: "), F.col("value"))
    checked = parsed.filter(F.when(F.col("bad"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    return checked.select(*record_columns(checked), *(["file_path"] if with_file else []))


def line_number(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """(file_path, line, value) of the bad lines of files; lines are numbered from 1, blank ones too. Only the files that hold
    a bad line are read whole, a file in one task."""
    files = [r["file_path"] for r in parsed_lines(_lines(spark, path), ddl).filter("bad").select("file_path").distinct().collect()]
    if not files:
        return spark.createDataFrame([], "file_path string, line int, value string")
    whole = spark.read.text(files, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.posexplode(F.split("value", "\r?\n")).alias("at", "value"))
    numbered = whole.select("file_path", (F.col("at") + 1).alias("line"), "value").filter(F.trim("value") != "")
    return parsed_lines(numbered, ddl).filter("bad").select("file_path", "line", "value")


def read_tolerant(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """(records, quarantined lines)."""
    parsed = parsed_lines(_lines(spark, path), ddl)
    return parsed.filter(~F.col("bad")).select(*record_columns(parsed)), parsed.filter("bad").select("file_path", "value")


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    return read_strict(spark, path, schemas.LISTING_DDL)


def flatten_communities(records: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """community_id plus one count column per facility category; non-numeric counts become 0."""
    counts = [F.coalesce(F.col("poi_summary")[t].try_cast("double"), F.lit(0.0)).alias(poi_column(t)) for t in config.POI_TYPES]
    return records.select(*extra, "community_id", "extracted_at", *counts)


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    return flatten_communities(read_strict(spark, path, schemas.COMMUNITY_DDL))


def read_region_communities(spark: SparkSession, glob: str, suffix: str = "_communities.jsonl") -> DataFrame:
    """Communities of many region files; the region is the file name without the suffix."""
    records = read_strict(spark, glob, schemas.COMMUNITY_DDL, with_file=True)
    region = F.regexp_extract("file_path", r"([^/]+)" + suffix.replace(".", r"\.") + "$", 1)
    return flatten_communities(records.withColumn("region_slug", region), extra=["region_slug"])


def flatten_crawl(records: DataFrame) -> DataFrame:
    """Nested crawl records as flat listings with the status of their community link."""
    house = [f.name for f in records.schema["house"].dataType.fields if f.name not in ("prop_url", "community_id")]
    return records.select(
        "region", "list_page_no", "prop_url", *[F.col("house")[c].alias(c) for c in house],
        F.coalesce("house.community_id", "community_ref.community_id").alias("community_id"), F.col("community_ref.status").alias("link_status"),
    )


def flatten_sidecar(records: DataFrame) -> DataFrame:
    counts = [F.coalesce(F.element_at("poi.summary", t), F.lit(0)).cast("double").alias(poi_column(t)) for t in config.POI_TYPES]
    return records.select("community_id", "community.*", *counts)


def explode_links(index: DataFrame) -> DataFrame:
    return index.select("region", F.explode("links").alias("l")).select("region", "l.*")


def explode_progress(progress: DataFrame) -> DataFrame:
    """region, kind, key of everything already processed."""
    houses = progress.select("region", F.lit("house").alias("kind"), F.explode("processed_houses").alias("key"))
    communities = progress.select("region", F.lit("community").alias("kind"), F.explode("processed_communities").alias("key"))
    return houses.unionByName(communities)


def explode_facilities(communities: DataFrame) -> DataFrame:
    rows = communities.select("community_id", F.explode("poi_details").alias("category", "items"))
    return rows.select("community_id", "category", F.explode("items").alias("f")).select("community_id", "category", "f.*")
