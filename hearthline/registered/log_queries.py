"""Incremental operators, run as streams in several batches and with a restart, and their batch forms (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline import schemas
from hearthline.functions.labels import keyword_labels
from hearthline.operators import cleaning, logs
from hearthline.registered import views as v
from hearthline.registered.base import n, query, r, rounded, table
from hearthline.session import scratch_path
from hearthline.streaming import ingest


@query(
    "k1_landed_events",
    f"SELECT event_type, {n('count(*)', 'n')}, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, {r('sum(value)', 'total', 3)} FROM events GROUP BY 1",
)
def k1(spark, folder):
    """Events read as an available-now stream into Parquet, then summed; equals a plain read of the input."""
    landed = ingest.land_table(spark, folder, "events", ["event_id", "ts", "event_type", "value"])
    return rounded(landed.groupBy("event_type").agg(F.count("*").alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_at"), F.sum("value").alias("total")), 3)


DAMAGED_DDL = "event_id bigint, event_type string, user_id bigint, ts string, value double"


def event_files(spark, folder):
    """Events as JSON lines in eight files: clicks are cut off, views lack their first column, sign-ups their key."""
    record = F.struct(
        F.when(F.col("event_type") != "view", F.col("event_id")).alias("event_id"), "event_type", F.when(F.col("event_type") != "signup", F.col("user_id")).alias("user_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "value",
    )
    line = F.when(F.col("event_type") == "click", F.expr("left(to_json(struct(event_type, event_id)), 9)")).otherwise(F.to_json(record))
    path = scratch_path(spark, "event-lines")
    table(spark, folder, "events").select("event_id", line.alias("value")).repartition(8, "event_id").select("value").write.text(path)
    return path


@query(
    "k1_streamed_records",
    f"""SELECT CASE WHEN event_type = 'click' THEN 'quarantined' ELSE event_type END AS outcome, {n('count(*)', 'n')}, {n("count(CASE WHEN event_type NOT IN ('click', 'view') THEN 1 END)", 'with_id')} FROM events GROUP BY 1""",
)
def k1_streamed(spark, folder):
    """Two files a batch, then a restart that adds nothing; broken lines go to quarantine, records with a null first column stay."""
    source, base = event_files(spark, folder), scratch_path(spark, "landed-records")
    for _ in range(2):
        ingest.land_records(ingest.line_stream(spark, source, DAMAGED_DDL, 2), f"{base}/good", f"{base}/bad", f"{base}/progress").awaitTermination()
    good = spark.read.parquet(f"{base}/good").select(F.col("event_type").alias("outcome"), "event_id")
    bad = spark.read.parquet(f"{base}/bad").select(F.lit("quarantined").alias("outcome"), F.lit(None).cast("bigint").alias("event_id"))
    return good.unionByName(bad).groupBy("outcome").agg(F.count("*").alias("n"), F.count("event_id").alias("with_id"))


@query(
    "k2_streamed_first_seen",
    f"SELECT DISTINCT CASE WHEN event_type <> 'signup' THEN user_id END AS user_id, {n('1', 'rows_kept')} FROM events WHERE event_type <> 'click'",
)
def k2_streamed(spark, folder):
    """One row per key over all batches; the null key is one key."""
    source, base = event_files(spark, folder), scratch_path(spark, "first-seen")
    for _ in range(2):
        ingest.land_first_seen(ingest.record_stream(spark, source, DAMAGED_DDL, 2), f"{base}/rows", f"{base}/progress", "user_id", "ts").awaitTermination()
    return spark.read.parquet(f"{base}/rows").groupBy("user_id").agg(F.count("*").alias("rows_kept"))


@query(
    "k4_streamed_open_failures",
    f"""WITH {v.EVENTS}, l AS (SELECT * REPLACE (CASE WHEN record_type = 'failure' AND event_id % 7 = 0 THEN md5(target_url) ELSE failure_id END AS failure_id) FROM v_log),
    f AS (SELECT failure_id, {n("count(*)", "k")} FROM l WHERE record_type = 'failure' GROUP BY 1), u AS (SELECT failure_id, arg_max(resolved, retried_at) AS resolved FROM l WHERE record_type = 'retry_update' GROUP BY 1)
    SELECT f.failure_id FROM f LEFT JOIN u USING (failure_id) WHERE NOT coalesce(u.resolved, false)""",
)
def k4_streamed(spark, folder):
    """Failures and retries in four batches and a restart; every seventh failure comes without an id."""
    log = v.event_log(spark, folder).filter(F.col("record_type") != "counter")
    idless = (F.col("record_type") == "failure") & (F.col("event_id") % 7 == 0)
    columns = ["record_type", "target_type", "target_url", "error_message", "failed_at", "retry_count", "resolved", "retried_at", "success"]
    base = scratch_path(spark, "failure-lines")
    record = F.to_json(F.struct(F.when(~idless, F.col("failure_id")).alias("failure_id"), *columns))
    log.select("event_id", record.alias("value")).repartition(4, "event_id").select("value").write.text(f"{base}/lines")
    for _ in range(2):
        ingest.fold_failures(ingest.record_stream(spark, f"{base}/lines", schemas.FAILURE_DDL, 1), f"{base}/log", f"{base}/open", f"{base}/progress").awaitTermination()
    return ingest.current_open_failures(spark, f"{base}/open").select("failure_id")


@query(
    "k2_first_seen",
    f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) SELECT user_id, event_id, event_type FROM k WHERE rn = 1",
)
def k2(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_id", "event_type", "ts")
    return cleaning.keep_one(rows, "user_id", [F.col("ts").asc(), F.col("event_id").asc()]).drop("ts")


@query(
    "k3_progress",
    f"SELECT strftime(ts, '%Y-%m-%d') AS region, {n('count(DISTINCT user_id)', 'processed')}, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_updated FROM events GROUP BY 1",
)
def k3(spark, folder):
    seen = table(spark, folder, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("region"), "user_id").agg(F.max("ts").alias("ts"))
    return seen.groupBy("region").agg(F.count("*").alias("processed"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_updated"))


@query(
    "k4_open_failure_counts",
    f"""WITH {v.EVENTS}, f AS (SELECT failure_id, max(day) AS day FROM v_log WHERE record_type = 'failure' GROUP BY 1), u AS (SELECT failure_id, arg_max(resolved, retried_at) AS resolved FROM v_log WHERE record_type = 'retry_update' GROUP BY 1)
    SELECT substr(f.failure_id, strpos(f.failure_id, '_') + 1) AS day, {n('count(*)', 'open_failures')} FROM f LEFT JOIN u USING (failure_id) WHERE NOT coalesce(u.resolved, false) GROUP BY 1""",
)
def k4(spark, folder):
    rows = logs.open_failures(v.event_log(spark, folder))
    return rows.groupBy(F.substring_index("failure_id", "_", -1).alias("day")).agg(F.count("*").alias("open_failures"))


@query(
    "k5_latest_counters",
    f"""WITH {v.EVENTS}, m AS (SELECT day AS run_id, CAST(user_id AS VARCHAR) AS region, event_type AS phase, 'k' AS metric, CAST(json_extract_string(props, '$.k') AS BIGINT) AS total, CAST(floor(value) AS BIGINT) AS success FROM v_log)
    SELECT run_id, region, phase, metric, {n('max(total)', 'total')}, {n('max(success)', 'success')}, {n('max(total - success)', 'failed')} FROM m GROUP BY 1, 2, 3, 4""",
)
def k5(spark, folder):
    total = F.get_json_object("props", "$.k").cast("bigint")
    success = F.floor("value").cast("bigint")
    counters = F.create_map(F.lit("k"), F.struct(total.alias("total"), success.alias("success"), (total - success).alias("failed")))
    events = v.event_log(spark, folder).select(F.col("day").alias("run_id"), F.col("user_id").cast("string").alias("region"), F.col("event_type").alias("phase"), counters.alias("metrics"))
    return logs.latest_counters(events)


@query(
    "k6_retry_accounting",
    f"""WITH {v.EVENTS} SELECT day, {n('count(*)', 'total')}, {n('count(*) FILTER (WHERE success)', 'success')}, {n('count(*) FILTER (WHERE NOT success)', 'failed')}, {n('count(DISTINCT failure_id)', 'distinct_targets')},
    {n('count(DISTINCT failure_id) FILTER (WHERE success)', 'recovered_targets')} FROM v_log WHERE record_type = 'retry_update' GROUP BY 1""",
)
def k6(spark, folder):
    return logs.retry_accounting(v.event_log(spark, folder), ["day"])


def backfill(spark, folder):
    docs = v.titles(spark, folder)
    labels = table(spark, folder, "labels")
    fresh = docs.select("doc_id", *[c.alias(k) for k, c in keyword_labels("text", {k: v.KEYWORDS[k] for k in ("quality", "toxic")}).items()])
    return logs.backfill_labels(docs.select("doc_id", "lang"), labels, fresh, "doc_id")


@query("k7_backfill_targets", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def k7_targets(spark, folder):
    return backfill(spark, folder)[0]


@query(
    "k7_backfilled_labels",
    f"""WITH {v.RULES}, f AS (SELECT doc_id, quality, toxic FROM v_rules)
    SELECT doc_id, {n('coalesce(f.quality, l.quality)', 'quality')}, {n('coalesce(f.toxic, l.toxic)', 'toxic')} FROM labels l FULL JOIN f USING (doc_id)""",
)
def k7(spark, folder):
    return rounded(backfill(spark, folder)[1])
