"""Completeness, readiness and facility tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline import config
from hearthline.functions import pages as px
from hearthline.functions.listing import poi_column


def filled(column: Column) -> Column:
    """Null and blank text count as missing."""
    return F.coalesce(F.trim(column.cast("string")) != "", F.lit(False))


def row_completeness(fields: Mapping[str, Sequence[str]]) -> Column:
    """Share of required fields present; each field may come from several alternative columns."""
    present = [F.coalesce(*[F.when(filled(F.col(c)), F.lit(1)) for c in names], F.lit(0)) for names in fields.values()]
    return sum(present, F.lit(0)) / F.lit(float(len(present)))


def present_categories(types: Sequence[str] = config.POI_TYPES, details: str | None = None) -> Column:
    """Facility categories with a positive count or a non-empty detail list."""
    checks = []
    for poi in types:
        has = F.coalesce(F.col(poi_column(poi)) > 0, F.lit(False))
        if details is not None:
            has = has | (F.coalesce(F.size(F.element_at(F.col(details), poi)), F.lit(0)) > 0)
        checks.append(F.when(has, F.lit(poi)))
    return F.array_compact(F.array(*checks))


def choose_counts(df: DataFrame, types: Sequence[str], first: str, second: str) -> DataFrame:
    """Per row, the first set of counts unless it sums to 0, else the second; columns are prefix + type."""
    size = sum((F.coalesce(F.col(f"{first}{t}"), F.lit(0)) for t in types), F.lit(0))
    picked = {poi_column(t): F.when(size > 0, F.coalesce(F.col(f"{first}{t}"), F.lit(0))).otherwise(F.coalesce(F.col(f"{second}{t}"), F.lit(0))) for t in types}
    return df.withColumns(picked)


def region_rates(df: DataFrame, ok: Column, covered: Column, region: str = "region_slug", min_success: float = 0.90, min_coverage: float = 0.95) -> DataFrame:
    """Per region: success rate, field coverage of successful rows, and whether both reach their thresholds."""
    rows = df.select(region, ok.alias("_ok"), F.when(ok, covered).alias("_cov"))
    rates = rows.groupBy(region).agg(
        F.count("*").alias("n"), F.avg(F.col("_ok").cast("int")).alias("success_rate"), F.avg("_cov").alias("field_coverage")
    )
    return rates.withColumn(
        "passed", F.coalesce((F.col("success_rate") >= min_success) & (F.col("field_coverage") >= min_coverage), F.lit(False))
    )


def readiness(df: DataFrame, completeness: Column, linked: Column, facilities_pass: Column) -> DataFrame:
    """One row: average completeness and whether every row is complete, linked and has enough facility categories."""
    rows = df.select(completeness.alias("c"), linked.alias("l"), facilities_pass.alias("f"))
    return rows.agg(
        F.count("*").alias("n"), F.avg("c").alias("average_completeness"), F.bool_and(F.col("c") >= 1.0).alias("all_complete"),
        F.bool_and("l").alias("all_linked"), F.bool_and("f").alias("all_facilities"),
    ).withColumn("ready", F.col("all_complete") & F.col("all_linked") & F.col("all_facilities"))


def facility_rows(pages: DataFrame, key: str = "community_id", html: str = "html") -> DataFrame:
    """One row per facility list item of a page, with type, name, distance, coordinate and sub-type."""
    items = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(px.ITEM_PATTERN), F.lit(1))).alias("item_no", "item"))
    item = F.col("item")
    texts = items.withColumn("text", px.squeeze(px.unescape(px.strip_tags(item)))).filter(F.length("text") > 0)
    text = F.col("text")
    typed = texts.withColumns(
        {
            "type": px.facility_type(item, text),
            "name": px.facility_name(item, text),
            "distance": px.facility_distance(item, text),
            "coordinate": px.facility_coordinate(item),
            "sub_type": px.facility_sub_type(text),
        }
    )
    return typed.filter((F.col("type") != "unknown") & F.col("name").isNotNull()).select(
        key, "item_no", "type", "name", "distance", "coordinate", "sub_type"
    )


def distinct_facilities(
    rows: DataFrame, key: str = "community_id", noise: Sequence[str] = config.POI_NOISE_NAMES, with_sub_type: bool = False
) -> DataFrame:
    """First row per (page, type, name, distance[, sub_type]); noise and blank names drop out.

    The first row is a min over a struct, so copies fold before the shuffle however many a page has.
    """
    named = rows.filter(filled(F.col("name")) & ~F.col("name").isin(*noise))
    keys = [key, "type", F.trim("name").alias("name"), F.when(filled(F.col("distance")), F.trim("distance")).alias("distance")]
    others = ["coordinate"] if with_sub_type else ["coordinate", "sub_type"]
    if with_sub_type:
        keys.append(F.when(filled(F.col("sub_type")), F.trim("sub_type")).alias("sub_type"))
    first = F.min_by(F.struct(*others), F.col("item_no"))
    return named.groupBy(*keys).agg(F.min("item_no").alias("item_no"), first.alias("_f")).select("*", "_f.*").drop("_f")


def facility_counts(rows: DataFrame, types: Sequence[str] = config.POI_TYPES, key: str = "community_id") -> DataFrame:
    """Wide counts per key; absent categories are 0."""
    return rows.groupBy(key).agg(*[F.count_if(F.col("type") == t).alias(poi_column(t)) for t in types])


def page_facility_counts(pages: DataFrame, key: str = "community_id", html: str = "html", keywords: Mapping[str, str] = config.POI_KEYWORDS) -> DataFrame:
    """Counts from distinct list items; a category without items falls back to keyword occurrences in the page."""
    counts = facility_counts(distinct_facilities(facility_rows(pages, key, html), key), list(keywords), key)
    mentions = pages.select(
        key, *[F.size(F.regexp_extract_all(html, F.lit(w), F.lit(0))).cast("bigint").alias(f"_m_{t}") for t, w in keywords.items()]
    )
    joined = mentions.join(counts, key, "left")
    return joined.select(
        key, *[F.when(F.coalesce(F.col(poi_column(t)), F.lit(0)) > 0, F.col(poi_column(t))).otherwise(F.col(f"_m_{t}")).alias(poi_column(t)) for t in keywords]
    )
