"""Failure, retry and run logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.operators.cleaning import keep_one


def with_failure_id(log: DataFrame) -> DataFrame:
    """Failures of old logs have no id; theirs follows from the target."""
    derived = F.when(F.col("record_type") == "failure", F.md5(F.coalesce("target_url", F.lit(""))))
    return log.withColumn("failure_id", F.coalesce("failure_id", derived))


def open_failures(log: DataFrame, target_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Latest failure per id joined with its latest retry update; resolved ids drop out.

    ``log`` mixes record_type 'failure' and 'retry_update'. Events are ordered by time, then content. Fields that old
    records lack take defaults.
    """
    failures = keep_one(
        with_failure_id(log.filter(F.col("record_type") == "failure")),
        "failure_id", [F.col("failed_at").desc_nulls_last(), F.col("error_message").desc_nulls_last()],
    )
    updates = keep_one(
        log.filter((F.col("record_type") == "retry_update") & F.col("failure_id").isNotNull()),
        "failure_id", [F.col("retried_at").desc_nulls_last(), F.col("resolved").desc_nulls_last()],
    ).select("failure_id", F.col("retry_count").alias("_count"), F.col("resolved").alias("_resolved"), F.col("error_message").alias("_message"))
    joined = failures.join(updates, "failure_id", "left")
    kind = F.coalesce("target_type", F.lit("prop"))
    rows = joined.withColumns(
        {
            "target_type": kind,
            "retry_count": F.coalesce("_count", "retry_count", F.lit(0)),
            "error_message": F.coalesce("_message", "error_message"),
            "resolved": F.coalesce("_resolved", "resolved", F.lit(False)),
        }
    ).filter(~F.col("resolved"))
    if target_type is not None:
        rows = rows.filter(F.col("target_type") == target_type)
    rows = rows.select("failure_id", "target_type", "target_url", "failed_at", "retry_count", "error_message")
    return rows if limit is None else rows.orderBy(F.col("failed_at").asc_nulls_first(), "failure_id").limit(limit)


def last_failed_url(log: DataFrame, prefix: str) -> DataFrame:
    """One row: the most recent failed URL with the given start."""
    kept = log.filter((F.col("record_type") == "failure") & F.col("target_url").startswith(prefix))
    return kept.agg(F.max_by("target_url", F.struct("failed_at", "target_url")).alias("target_url"), F.max("failed_at").alias("failed_at"))


def latest_counters(events: DataFrame) -> DataFrame:
    """Counters are cumulative snapshots, so the largest one per run, region, phase and metric is the current one."""
    exploded = events.select("run_id", "region", "phase", F.explode("metrics").alias("metric", "c"))
    return exploded.groupBy("run_id", "region", "phase", "metric").agg(
        F.max("c.total").alias("total"), F.max("c.success").alias("success"), F.max("c.failed").alias("failed")
    )


def retry_accounting(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Retries, successes, failures and distinct targets of the retry updates."""
    updates = log.filter(F.col("record_type") == "retry_update")
    per_id = updates.groupBy(*(by or []), "failure_id").agg(F.count("*").alias("t"), F.count_if("success").alias("s"))
    return per_id.groupBy(*(by or [])).agg(
        F.sum("t").alias("total"), F.sum("s").alias("success"), (F.sum("t") - F.sum("s")).alias("failed"),
        F.count("*").alias("distinct_targets"), F.count_if(F.col("s") > 0).alias("recovered_targets"),
    )


def completed_events(events: DataFrame, name: str = "model_completed") -> DataFrame:
    return events.filter(F.col("event") == name)


def link_status(listings: DataFrame, load_ok: Column) -> DataFrame:
    """Status of each listing's community link.

    A failed page gives prop_failed and no community id gives missing. The first listing whose community loads fetches
    it and every later one finds it in the cache; a listing whose load failed leaves the fetch to the next.
    Only first fetchers are ranked, so a community with very many listings costs one row per task.
    """
    rows = listings.withColumn("_ok", load_ok)
    fetchable = rows.filter(F.col("is_valid") & F.col("community_id").isNotNull() & F.col("_ok"))
    first = fetchable.groupBy("community_id").agg(F.min(F.struct("list_page_no", "prop_url")).alias("_first"))
    joined = rows.join(first, "community_id", "left")
    here = F.struct("list_page_no", "prop_url")
    status = (
        F.when(~F.col("is_valid"), "prop_failed")
        .when(F.col("community_id").isNull(), "missing")
        .when(F.col("_first").isNotNull() & (here > F.col("_first")), "linked_from_cache")
        .when(F.col("_first").isNotNull() & (here == F.col("_first")), "linked_new_fetch")
        .otherwise("community_failed")
    )
    return joined.withColumn("link_status", status).drop("_ok", "_first")


def backfill_labels(titles: DataFrame, labels: DataFrame, fresh: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(titles still to annotate, labels with fresh rows added, latest load wins)."""
    todo = titles.join(labels.select(key), key, "left_anti")
    merged = labels.withColumn("load_no", F.lit(0)).unionByName(fresh.withColumn("load_no", F.lit(1)))
    columns = [c for c in labels.columns if c != key]
    latest = merged.groupBy(key).agg(*[F.max_by(c, "load_no").alias(c) for c in columns])
    return todo, latest

