"""The driver tables in the roles of listings, communities, titles, predictions, metrics and logs.

Each view exists as a DataFrame function and as a SQL common table expression of the same meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions import listing as fx
from hearthline.functions.hashing import hash_key
from hearthline.operators import cleaning
from hearthline.operators.errors import regression_metrics
from hearthline.registered.base import table
from hearthline.session import materialise

# Facility categories and weights of the driver tables: part types in the role of facility types.
TYPES = ("economy", "large", "medium", "promo", "small", "standard")
WEIGHTS = {"economy": 0.6, "large": 1.0, "medium": 1.5, "promo": 1.4, "small": 0.7, "standard": 0.8}
FLOORS = (("F", 0.2), ("O", 0.5), ("P", 0.8))
MODELS = ("global_mean", "priority_mean", "region_mean")
SEEDS = (7, 21, 42, 84, 168)

# Title labels of the driver documents.
KEYWORDS = {
    "quality": ["Das ", "Eau", "the "],
    "toxic": ["###", "$$$", "%%%"],
    "english": ["the ", "The ", " of "],
    "french": [" le ", " la ", "Elle"],
    "german": [" der ", " die ", " das "],
    "spanish": [" el ", " los ", " que "],
}

COUNTS = [fx.poi_column(t) for t in TYPES]


def priced(spark: SparkSession, folder: str) -> DataFrame:
    """Listings without the columns that need the order lines."""
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("o_orderkey").alias("house_id"), F.col("o_custkey").alias("community_id"), F.col("n_name").alias("region_slug"),
        (F.col("o_totalprice") / 1000.0).alias("total_price_wan"), F.col("o_orderstatus").alias("floor_level"),
        F.col("o_orderpriority").alias("decoration_type"), F.col("o_orderdate").cast("timestamp_ntz").alias("extracted_at"),
    )


def listings(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("house_id")).agg(
        F.sum("l_quantity").alias("area_sqm"),
        F.count("*").cast("double").alias("room_count"),
        F.count_distinct("l_suppkey").cast("double").alias("hall_count"),
        F.count_if(F.col("l_returnflag") == "R").cast("double").alias("bath_count"),
    )
    joined = priced(spark, folder).join(items, "house_id", "left")
    return joined.select(
        "house_id", "community_id", "region_slug", "total_price_wan", "area_sqm", "room_count", "hall_count", "bath_count",
        "floor_level", "decoration_type", "extracted_at",
    )


LISTING = """v_listing AS (
  SELECT o_orderkey AS house_id, o_custkey AS community_id, n_name AS region_slug, o_totalprice / 1000.0 AS total_price_wan,
         area_sqm, room_count, hall_count, bath_count, o_orderstatus AS floor_level, o_orderpriority AS decoration_type,
         CAST(o_orderdate AS TIMESTAMP) AS extracted_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS area_sqm, CAST(count(*) AS DOUBLE) AS room_count,
                    CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS hall_count,
                    CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS bath_count
             FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""


def communities(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with the number of parts of each type they ordered."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, folder, "part").select("p_partkey", "p_type")
    bought = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    counts = bought.groupBy("o_custkey").agg(
        *[F.count_if(F.col("p_type") == t.upper()).cast("double").alias(fx.poi_column(t)) for t in TYPES]
    )
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("community_id"))
    joined = customers.join(counts, F.col("community_id") == F.col("o_custkey"), "left")
    return joined.select("community_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in COUNTS])


COMMUNITY = f"""v_community AS (
  SELECT c_custkey AS community_id, {', '.join(f"coalesce({c}, 0.0) AS {c}" for c in COUNTS)}
  FROM customer LEFT JOIN (
    SELECT o_custkey, {', '.join(f"CAST(count(*) FILTER (WHERE p_type = '{t.upper()}') AS DOUBLE) AS {fx.poi_column(t)}" for t in TYPES)}
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey) ON c_custkey = o_custkey)"""


def valid_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Written once per query: trimming and binning scan it several times, a column or two at a time."""
    return materialise(listings(spark, folder).filter(cleaning.is_usable()))


VALID = """valid AS (
  SELECT * FROM v_listing WHERE total_price_wan > 0 AND area_sqm > 0 AND region_slug IS NOT NULL
    AND room_count IS NOT NULL AND hall_count IS NOT NULL AND bath_count IS NOT NULL)"""


def trimmed_listings(spark: SparkSession, folder: str) -> DataFrame:
    valid = valid_listings(spark, folder)
    return valid.filter(cleaning.within_bounds(cleaning.trim_bounds(valid)))


TRIMMED = """bounds AS (
  SELECT quantile_cont(total_price_wan, 0.01) AS pl, quantile_cont(total_price_wan, 0.99) AS ph,
         quantile_cont(area_sqm, 0.01) AS al, quantile_cont(area_sqm, 0.99) AS ah FROM valid),
trimmed AS (
  SELECT valid.* FROM valid, bounds WHERE total_price_wan BETWEEN pl AND ph AND area_sqm BETWEEN al AND ah)"""


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Trimmed listings with facility counts and the row-level features."""
    joined = cleaning.join_community(trimmed_listings(spark, folder), communities(spark, folder))
    return joined.withColumns(
        {
            "house_layout": fx.layout_text(),
            "floor_level_score": fx.floor_score(scores=FLOORS),
            "poi_total_count": fx.poi_total(TYPES),
            "accessibility_index": fx.accessibility_index(WEIGHTS),
            "poi_balance_score": fx.balance_entropy(TYPES),
        }
    )


ACCESS_SQL = " + ".join(f"{w} * ln(1 + {fx.poi_column(t)})" for t, w in WEIGHTS.items())
TOTAL_SQL = " + ".join(COUNTS)
LAYOUT_SQL = "concat(CAST(room_count AS INT), '室', CAST(hall_count AS INT), '厅', CAST(bath_count AS INT), '卫')"


def share_sql(column: str) -> str:
    return f"({column} / greatest({TOTAL_SQL}, 1.0))"


ENTROPY_SQL = "(" + " + ".join(f"CASE WHEN {share_sql(c)} > 0 THEN -{share_sql(c)} * ln({share_sql(c)}) ELSE 0 END" for c in COUNTS) + f") / ln({len(TYPES)})"
FLOOR_SQL = "CASE floor_level WHEN 'F' THEN 0.2 WHEN 'O' THEN 0.5 WHEN 'P' THEN 0.8 ELSE 0.5 END"

FEATURES = f"""feat AS (
  SELECT trimmed.*, {', '.join(COUNTS)}, {LAYOUT_SQL} AS house_layout, {FLOOR_SQL} AS floor_level_score,
         {TOTAL_SQL} AS poi_total_count, {ACCESS_SQL} AS accessibility_index, {ENTROPY_SQL} AS poi_balance_score
  FROM trimmed LEFT JOIN v_community USING (community_id))"""

LISTING_FEATURES = f"WITH {LISTING}, {VALID}, {TRIMMED}, {COMMUNITY}, {FEATURES}"
LISTING_TRIMMED = f"WITH {LISTING}, {VALID}, {TRIMMED}"
LISTING_VALID = f"WITH {LISTING}, {VALID}"


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Three mean predictors of the price, as one long table with errors rounded to six digits."""
    rows = priced(spark, folder).select(
        "house_id", "region_slug", "decoration_type", "extracted_at", F.col("total_price_wan").alias("actual_price_wan")
    )
    overall = rows.agg(F.round(F.avg("actual_price_wan"), 4).alias("m")).scalar()
    by_region = rows.groupBy("region_slug").agg(F.round(F.avg("actual_price_wan"), 4).alias("region_mean"))
    by_priority = rows.groupBy("decoration_type").agg(F.round(F.avg("actual_price_wan"), 4).alias("priority_mean"))
    wide = rows.join(by_region, "region_slug").join(by_priority, "decoration_type").withColumn("global_mean", overall)
    items = F.array(*[F.struct(F.lit(m).alias("model_name"), F.col(m).alias("predicted_price_wan")) for m in MODELS])
    long = wide.select("house_id", "region_slug", "decoration_type", "extracted_at", "actual_price_wan", F.explode(items).alias("p"))
    return long.select(
        "p.model_name", "house_id", "region_slug", "decoration_type", "extracted_at", "actual_price_wan", "p.predicted_price_wan",
        F.round(F.abs(F.col("actual_price_wan") - F.col("p.predicted_price_wan")), 6).alias("absolute_error_wan"),
    )


PREDICTION = f"""{LISTING}, means AS (
  SELECT house_id, region_slug, decoration_type, extracted_at, total_price_wan AS actual_price_wan,
         round(avg(total_price_wan) OVER (), 4) AS global_mean,
         round(avg(total_price_wan) OVER (PARTITION BY decoration_type), 4) AS priority_mean,
         round(avg(total_price_wan) OVER (PARTITION BY region_slug), 4) AS region_mean FROM v_listing),
v_pred AS (
  SELECT model_name, house_id, region_slug, decoration_type, extracted_at, actual_price_wan, predicted_price_wan,
         round(abs(actual_price_wan - predicted_price_wan), 6) AS absolute_error_wan
  FROM means UNPIVOT (predicted_price_wan FOR model_name IN (global_mean, priority_mean, region_mean)))"""


def seeded_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Every listing belongs to one of five seeded groups, so the groups together cover the whole table."""
    group = F.pmod(hash_key("house_id", "seed"), F.lit(len(SEEDS))).cast("int") + 1
    return predictions(spark, folder).withColumn("seed", F.element_at(F.array(*[F.lit(s) for s in SEEDS]), group))


def hash_sql(column: str, seed: int | str) -> str:
    return f"CAST(concat('0x', substr(md5(concat_ws('_', {column}, '{seed}')), 1, 15)) AS BIGINT)"


SEEDED = f"""{PREDICTION}, v_seeded AS (
  SELECT *, list_extract([{', '.join(str(s) for s in SEEDS)}], CAST({hash_sql('house_id', 'seed')} % {len(SEEDS)} AS INT) + 1) AS seed FROM v_pred)"""

METRIC_SQL = """avg(abs(actual_price_wan - predicted_price_wan)) AS mae,
  sqrt(avg((actual_price_wan - predicted_price_wan) * (actual_price_wan - predicted_price_wan))) AS rmse,
  1 - sum((actual_price_wan - predicted_price_wan) * (actual_price_wan - predicted_price_wan)) / (var_pop(actual_price_wan) * count(*)) AS r2,
  avg(abs(actual_price_wan - predicted_price_wan) / greatest(actual_price_wan, 1e-6)) AS mape"""


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    return regression_metrics(seeded_predictions(spark, folder), by=["model_name", "seed"])


METRIC = f"""{SEEDED}, v_metric AS (
  SELECT model_name, seed, count(*) AS n, {METRIC_SQL} FROM v_seeded GROUP BY model_name, seed)"""


def titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def label_sql(words: list[str], text: str = "text") -> str:
    return "CAST(coalesce(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ", false) AS BIGINT)"


RULES = "v_rules AS (SELECT doc_id, lang, source, n_chars, " + ", ".join(f"{label_sql(w)} AS {k}" for k, w in KEYWORDS.items()) + " FROM documents)"


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a failure log: errors are failures, purchases and sign-ups are retries that succeed and fail."""
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    kind = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type").isin("purchase", "signup"), "retry_update").otherwise("counter")
    retry = F.col("event_type").isin("purchase", "signup")
    return events.withColumn("record_type", kind).select(
        "record_type", "event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.concat_ws("_", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("failure_id"),
        F.when(F.col("value") > 20, "community").when(F.col("value") > 1, "prop").alias("target_type"),
        F.concat(F.lit("https://example.com/prop/view/"), F.col("event_id").cast("string")).alias("target_url"),
        F.concat(F.lit("code "), F.get_json_object("props", "$.k")).alias("error_message"),
        F.when(F.col("event_type") == "error", F.col("ts")).alias("failed_at"),
        F.when(retry, F.col("ts")).alias("retried_at"),
        F.when(retry, F.get_json_object("props", "$.k").cast("int")).alias("retry_count"),
        F.when(retry, F.col("event_type") == "purchase").alias("resolved"),
        F.when(retry, F.col("event_type") == "purchase").alias("success"),
        F.col("event_type"), F.col("value"), F.col("ts"), "props",
    )


EVENTS = """v_log AS (
  SELECT CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type IN ('purchase', 'signup') THEN 'retry_update' ELSE 'counter' END AS record_type,
    event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, concat(user_id, '_', strftime(ts, '%Y-%m-%d')) AS failure_id,
    CASE WHEN value > 20 THEN 'community' WHEN value > 1 THEN 'prop' END AS target_type,
    concat('https://example.com/prop/view/', event_id) AS target_url,
    concat('code ', json_extract_string(props, '$.k')) AS error_message,
    CASE WHEN event_type = 'error' THEN ts END AS failed_at,
    CASE WHEN event_type IN ('purchase', 'signup') THEN ts END AS retried_at,
    CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(json_extract_string(props, '$.k') AS INT) END AS retry_count,
    CASE WHEN event_type IN ('purchase', 'signup') THEN event_type = 'purchase' END AS resolved,
    CASE WHEN event_type IN ('purchase', 'signup') THEN event_type = 'purchase' END AS success,
    event_type, value, ts, props FROM events)"""
