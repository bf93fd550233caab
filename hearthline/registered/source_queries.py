"""Readers and sinks over files that are first written from the driver tables (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.registered import views as v
from hearthline.registered.base import n, query, r, rounded, table
from hearthline.session import scratch_path
from hearthline.sources import jsonl, tables

LISTING_DDL = "house_id bigint, region_slug string, total_price_wan double, area_sqm double, floor_level string"
LISTING_SQL = f"WITH {v.LISTING} SELECT house_id, region_slug, {r('total_price_wan', 'total_price_wan')}, {r('area_sqm', 'area_sqm')}, floor_level FROM v_listing"
COLUMNS = ["house_id", "region_slug", "total_price_wan", "area_sqm", "floor_level"]


@query("a1_strict_jsonl", LISTING_SQL)
def a1(spark, folder):
    path = scratch_path(spark, "listings")
    tables.write_jsonl(v.listings(spark, folder).select(*COLUMNS), path)
    return rounded(jsonl.read_strict(spark, path, LISTING_DDL))


@query(
    "a2_tolerant_jsonl",
    f"SELECT CASE WHEN event_type IN ('click', 'view') THEN 'quarantined' ELSE 'read' END AS outcome, {n('count(*)', 'n')}, {n("sum(CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE event_id END)", 'id_sum')} FROM events GROUP BY 1",
)
def a2(spark, folder):
    """One event per line; clicks are cut off and views are arrays, so both kinds go to quarantine."""
    document = F.to_json(F.struct("event_id", "event_type"))
    line = F.when(F.col("event_type") == "click", F.expr("left(to_json(struct(event_id, event_type)), 9)")).when(
        F.col("event_type") == "view", F.concat(F.lit("["), document, F.lit("]"))
    ).otherwise(document)
    path = scratch_path(spark, "events")
    table(spark, folder, "events").select(line.alias("value")).write.text(path)
    good, bad = jsonl.read_tolerant(spark, path, "event_id bigint, event_type string")
    rows = good.select(F.lit("read").alias("outcome"), "event_id").unionByName(bad.select(F.lit("quarantined").alias("outcome"), F.lit(0).cast("bigint").alias("event_id")))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


@query("a4_csv_round_trip", LISTING_SQL)
def a4(spark, folder):
    path = scratch_path(spark, "csv")
    tables.write_csv(v.listings(spark, folder).select(*COLUMNS), path)
    return rounded(tables.read_csv(spark, path, LISTING_DDL))


@query("a5_label_contract", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, {n('quality', 'quality')}, {n('toxic', 'toxic')} FROM labels")
def a5(spark, folder):
    path = scratch_path(spark, "labels")
    tables.write_csv(table(spark, folder, "labels").withColumn("note", F.lit("x")), path)
    return rounded(tables.read_labels(spark, path, ["doc_id", "quality", "toxic"]))


@query("a6_region_from_path", f"WITH {v.LISTING} SELECT region_slug, {n('count(*)', 'n')}, {r('sum(total_price_wan)', 'total', 3)} FROM v_listing GROUP BY 1")
def a6(spark, folder):
    """One folder per region; the region is read from the path only."""
    path = scratch_path(spark, "regions")
    v.priced(spark, folder).select("house_id", "total_price_wan", F.col("region_slug").alias("region")).write.partitionBy("region").json(path)
    rows = jsonl.read_strict(spark, f"{path}/*/*.json", "house_id bigint, total_price_wan double", with_file=True)
    region = F.regexp_extract("file_path", "region=([^/]+)/", 1)
    return rounded(rows.groupBy(region.alias("region_slug")).agg(F.count("*").alias("n"), F.sum("total_price_wan").alias("total")), 3)


@query("a8_append_sink", f"SELECT event_type, {n('count(*)', 'n')} FROM events GROUP BY 1")
def a8(spark, folder):
    """Two appends of disjoint halves by event type; together they are the whole table."""
    path = scratch_path(spark, "appended")
    events = table(spark, folder, "events").select("event_id", "event_type")
    failed = F.col("event_type") == "error"
    tables.write_jsonl(events.filter(failed), path, append=True)
    tables.write_jsonl(events.filter(~failed), path, append=True)
    return jsonl.read_strict(spark, path, "event_id bigint, event_type string").groupBy("event_type").agg(F.count("*").alias("n"))


@query("a10_bounded_files", f"SELECT {n('count(*)', 'rows')}, true AS bounded FROM documents, range(4)")
def a10(spark, folder):
    """Annotation requests written as text files of at most 5,000 lines."""
    from hearthline.operators.requests import request_table
    from hearthline.registered.cleaning_queries import REQUEST_PROMPTS

    path = scratch_path(spark, "requests")
    tables.write_requests(request_table(v.titles(spark, folder), "doc_id", "text", REQUEST_PROMPTS, (0.0, 0.5), "annotator", 512), path)
    per_file = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("lines"))
    return per_file.agg(F.sum("lines").alias("rows"), F.bool_and(F.col("lines") <= tables.REQUEST_FILE_ROWS).alias("bounded"))
