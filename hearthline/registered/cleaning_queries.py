"""Sources, filters, cleaning and joins (A, B, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline import config
from hearthline.functions import listing as fx
from hearthline.functions import pages as px
from hearthline.operators import cleaning, errors, keys, quality
from hearthline.operators.requests import request_table
from hearthline.registered import views as v
from hearthline.registered.base import n, query, r, rounded, table
from hearthline.session import materialise, scratch_path
from hearthline.sources import jsonl, tables


@query("a3_community_counts", f"WITH {v.COMMUNITY} SELECT community_id, {', '.join(v.COUNTS)} FROM v_community")
def a3(spark, folder):
    """Counts as text in nested records, written as JSON lines and read by the nested reader."""
    path = scratch_path(spark, "communities")
    names = config.POI_TYPES[: len(v.COUNTS)]
    summary = F.struct(*[F.col(c).cast("bigint").cast("string").alias(t) for t, c in zip(names, v.COUNTS)])
    tables.write_jsonl(v.communities(spark, folder).select(F.col("community_id").cast("string").alias("community_id"), summary.alias("poi_summary"), F.lit("2026-01-01T00:00:00").alias("extracted_at")), path)
    read = jsonl.read_communities(spark, path)
    return read.select(F.col("community_id").cast("bigint").alias("community_id"), *[F.col(fx.poi_column(t)).alias(c) for t, c in zip(names, v.COUNTS)])


@query("a7_seed_union", f"WITH {v.METRIC} SELECT model_name, {n('seed', 'seed')}, {n('n', 'n')}, {r('mae', 'mae')}, {r('r2', 'r2')} FROM v_metric")
def a7(spark, folder):
    """One folder of metric files for each run; the seed is read from its name."""
    path = scratch_path(spark, "runs")
    v.metrics(spark, folder).select("model_name", "n", "mae", "r2", F.col("seed").alias("seed_")).write.partitionBy("seed_").csv(path, header=True)
    read = tables.read_run_metrics(spark, f"{path}/seed_=*", "model_name string, n bigint, mae double, r2 double", r"seed_=(\d+)")
    return rounded(read.select("model_name", "seed", "n", "mae", "r2"))


REQUEST_PROMPTS = {
    "baseline": ("Read the title. Answer with JSON.", "Title: {title}"),
    "strict": ("Use only what the title says. Answer with JSON.", "Title: {title} JSON only."),
}


@query(
    "a11_annotation_requests",
    """WITH setups AS (
      SELECT * FROM (VALUES ('baseline_t0p0', 'Read the title. Answer with JSON.', 'Title: {title}', 0.0),
        ('baseline_t0p5', 'Read the title. Answer with JSON.', 'Title: {title}', 0.5),
        ('strict_t0p0', 'Use only what the title says. Answer with JSON.', 'Title: {title} JSON only.', 0.0),
        ('strict_t0p5', 'Use only what the title says. Answer with JSON.', 'Title: {title} JSON only.', 0.5)) AS t(config, system, usr, temperature))
    SELECT config, CAST(doc_id AS VARCHAR) AS custom_id, 'POST' AS method, 'annotator' AS model, CAST(temperature AS DOUBLE) AS temperature,
      system AS system_text, md5(replace(usr, '{title}', text)) AS user_md5, CAST(512 AS BIGINT) AS max_tokens
    FROM documents, setups""",
)
def a11(spark, folder):
    made = request_table(v.titles(spark, folder), "doc_id", "text", REQUEST_PROMPTS, (0.0, 0.5), "annotator", 512)
    shape = (
        "struct<custom_id:string,method:string,url:string,body:struct<model:string,"
        "messages:array<struct<role:string,content:string>>,temperature:double,max_tokens:bigint>>"
    )
    read = made.select("config", F.from_json("request", shape).alias("q"))
    return read.select(
        "config", "q.custom_id", "q.method", "q.body.model", "q.body.temperature", F.col("q.body.messages")[0]["content"].alias("system_text"),
        F.md5(F.col("q.body.messages")[1]["content"]).alias("user_md5"), "q.body.max_tokens",
    )


@query(
    "a12_prediction_errors",
    f"WITH {v.PREDICTION} SELECT model_name, house_id, {r('actual_price_wan', 'actual_price_wan')}, {r('predicted_price_wan', 'predicted_price_wan')}, {r('absolute_error_wan', 'absolute_error_wan')} FROM v_pred",
)
def a12(spark, folder):
    wide = errors.wide_predictions(v.predictions(spark, folder), v.MODELS)
    return rounded(errors.long_predictions(wide, v.MODELS))


@query(
    "b1_numeric_coercion",
    f"SELECT event_id, {r('TRY_CAST(json_extract_string(props, chr(36) || chr(46) || chr(107)) AS DOUBLE)', 'k_number')}, {r('TRY_CAST(event_type AS DOUBLE)', 'type_number')} FROM events",
)
def b1(spark, folder):
    rows = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return rounded(rows.select("event_id", fx.to_number("k").alias("k_number"), fx.to_number("event_type").alias("type_number")))


@query(
    "b2_timestamp_coercion",
    """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'view' THEN 'not a time' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS TIMESTAMP) AS parsed_at FROM events""",
)
def b2(spark, folder):
    text = F.when(F.col("event_type") == "view", "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    rows = table(spark, folder, "events").withColumn("raw", text)
    return rows.select("event_id", fx.to_local_timestamp("raw").alias("parsed_at"))


@query(
    "b3_key_validity",
    f"""WITH {v.LISTING} SELECT region_slug, {n('count(*)', 'listings')}, {n("count(*) FILTER (WHERE total_price_wan > 0 AND area_sqm > 0 AND room_count IS NOT NULL)", 'valid')},
    {r("avg(CASE WHEN total_price_wan > 0 AND area_sqm > 0 AND room_count IS NOT NULL THEN 1.0 ELSE 0.0 END)", 'usable_rate')} FROM v_listing GROUP BY region_slug""",
)
def b3(spark, folder):
    usable = cleaning.is_usable()
    return rounded(
        v.listings(spark, folder).groupBy("region_slug").agg(
            F.count("*").alias("listings"), F.count_if(usable).alias("valid"), F.avg(usable.cast("int")).alias("usable_rate")
        )
    )


@query(
    "b4_quantile_trim",
    f"{v.LISTING_TRIMMED} SELECT house_id, community_id, region_slug, {r('total_price_wan', 'total_price_wan')}, {r('area_sqm', 'area_sqm')} FROM trimmed",
)
def b4(spark, folder):
    return rounded(v.trimmed_listings(spark, folder).select("house_id", "community_id", "region_slug", "total_price_wan", "area_sqm"))


@query(
    "b5_null_filling",
    f"""WITH {v.LISTING} SELECT house_id, {r('coalesce(area_sqm, 0)', 'area_sqm')}, {r('coalesce(room_count, 0)', 'room_count')},
    coalesce(CASE WHEN bath_count > 0 THEN floor_level END, 'unknown') AS floor_level FROM v_listing""",
)
def b5(spark, folder):
    rows = v.listings(spark, folder).withColumn("floor_level", F.when(F.col("bath_count") > 0, F.col("floor_level")))
    filled = rows.withColumns(fx.fill_roles(["area_sqm", "room_count"], ["floor_level"]))
    return rounded(filled.select("house_id", "area_sqm", "room_count", "floor_level"))


CONTRACT = ["house_id", "community_id", "total_price_wan", "area_sqm", "accessibility_index", "poi_balance_score", "house_layout"]


@query(
    "b6_feature_contract",
    f"{v.LISTING_FEATURES} SELECT house_id, community_id, {r('total_price_wan', 'total_price_wan')}, {r('area_sqm', 'area_sqm')}, {r('accessibility_index', 'accessibility_index')}, {r('poi_balance_score', 'poi_balance_score')}, house_layout FROM feat",
)
def b6(spark, folder):
    return rounded(v.features(spark, folder).select(*CONTRACT))


NOISE = f"""{v.LISTING_TRIMMED}, priced AS (SELECT *, total_price_wan / greatest(area_sqm, 1e-6) AS unit_price FROM trimmed),
g AS (SELECT region_slug, count(*) AS c, quantile_cont(unit_price, 0.01) AS ul, quantile_cont(unit_price, 0.99) AS uh FROM priced GROUP BY 1),
o AS (SELECT quantile_cont(unit_price, 0.01) AS gul, quantile_cont(unit_price, 0.99) AS guh, quantile_cont(total_price_wan, 0.005) AS tl,
  quantile_cont(total_price_wan, 0.995) AS th, quantile_cont(area_sqm, 0.005) AS al2, quantile_cont(area_sqm, 0.995) AS ah2 FROM priced),
noise AS (SELECT p.*, (unit_price < CASE WHEN c >= 10 THEN ul ELSE gul END OR unit_price > CASE WHEN c >= 10 THEN uh ELSE guh END) AS unit_outlier,
  (total_price_wan < tl OR total_price_wan > th) AS total_outlier, (area_sqm < al2 OR area_sqm > ah2) AS area_outlier
  FROM priced p JOIN g USING (region_slug), o)"""


def noise(spark, folder):
    return cleaning.noise_flags(v.trimmed_listings(spark, folder), "region_slug")


@query(
    "b7_label_noise_flags",
    f"{NOISE} SELECT house_id, {r('unit_price', 'unit_price')}, unit_outlier, total_outlier, area_outlier, (unit_outlier OR total_outlier OR area_outlier) AS strict_noise, (unit_outlier AND total_outlier) AS moderate_noise FROM noise",
)
def b7(spark, folder):
    return rounded(
        noise(spark, folder).select(
            "house_id", "unit_price", "unit_outlier", "total_outlier", "area_outlier", "strict_noise", "moderate_noise"
        )
    )


@query(
    "b8_cleaning_strategies",
    f"""{NOISE}, s AS (SELECT unnest(['none', 'strict', 'moderate', 'unit_only', 'total_only']) AS strategy,
      unnest([false, unit_outlier OR total_outlier OR area_outlier, unit_outlier AND total_outlier, unit_outlier, total_outlier]) AS gone FROM noise)
    SELECT strategy, {n('count(*)', 'total')}, {n('count(*) FILTER (WHERE gone)', 'removed')}, {r('avg(CASE WHEN gone THEN 1.0 ELSE 0.0 END)', 'removed_rate')} FROM s GROUP BY strategy""",
)
def b8(spark, folder):
    return rounded(cleaning.strategy_summary(noise(spark, folder)))


@query(
    "b8_kept_rows",
    f"""{NOISE} SELECT house_id, unnest(['none', 'strict', 'moderate', 'unit_only', 'total_only']) AS strategy,
      unnest([true, NOT (unit_outlier OR total_outlier OR area_outlier), NOT (unit_outlier AND total_outlier), NOT unit_outlier, NOT total_outlier]) AS keep FROM noise""",
)
def b8_rows(spark, folder):
    return cleaning.strategy_rows(noise(spark, folder))


@query(
    "b9_missing_fields",
    f"""WITH {v.LISTING}, m AS (SELECT house_id, concat_ws(',', CASE WHEN area_sqm IS NULL THEN 'area_sqm' END, CASE WHEN room_count IS NULL THEN 'room_count' END,
      CASE WHEN floor_level IS NULL OR trim(floor_level) = '' THEN 'floor_level' END) AS gaps FROM v_listing)
    SELECT house_id, gaps AS missing, gaps = '' AS is_valid, CASE WHEN gaps <> '' THEN concat('必填字段缺失(', gaps, ')') END AS error_message FROM m""",
)
def b9(spark, folder):
    gaps = px.missing_fields(["area_sqm", "room_count", "floor_level"])
    rows = v.listings(spark, folder).withColumn("gaps", gaps)
    return rows.select("house_id", F.concat_ws(",", "gaps").alias("missing"), (F.size("gaps") == 0).alias("is_valid"), px.missing_message(F.col("gaps")).alias("error_message"))


@query(
    "b10_row_completeness",
    f"""SELECT doc_id, {r('(CASE WHEN text IS NOT NULL AND trim(text) <> chr(0) AND trim(text) <> repeat(text, 0) THEN 1 ELSE 0 END + CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN toxic IS NOT NULL OR n_chars IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN lang IS NOT NULL THEN 1 ELSE 0 END) / 4.0', 'completeness')}
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def b10(spark, folder):
    rows = v.titles(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")
    fields = {"text": ["text"], "quality": ["quality"], "size": ["toxic", "n_chars"], "lang": ["lang"]}
    return rounded(rows.select("doc_id", quality.row_completeness(fields).alias("completeness")))


@query(
    "b11_facility_presence",
    f"""WITH {v.COMMUNITY}, p AS (SELECT community_id, concat_ws(',', {', '.join(f"CASE WHEN {fx.poi_column(t)} > 0 THEN '{t}' END" for t in v.TYPES)}) AS categories,
      {' + '.join(f"CAST({fx.poi_column(t)} > 0 AS INT)" for t in v.TYPES)} AS k FROM v_community)
    SELECT community_id, categories, k >= 3 AS passed FROM p""",
)
def b11(spark, folder):
    rows = v.communities(spark, folder).withColumn("found", quality.present_categories(v.TYPES))
    return rows.select("community_id", F.concat_ws(",", "found").alias("categories"), (F.size("found") >= 3).alias("passed"))


@query(
    "b12_experiment_selection",
    f"WITH {v.METRIC} SELECT model_name, {n('seed', 'seed')}, {r('mae', 'mae')} FROM v_metric WHERE regexp_matches(model_name, 'region|priority') OR model_name IN ('fwls_lite')",
)
def b12(spark, folder):
    from hearthline.operators.leaderboards import matching_rows

    chosen = matching_rows(v.metrics(spark, folder), "model_name", ["region|priority"], ["fwls_lite"])
    return rounded(chosen.select("model_name", "seed", "mae"))


@query("b13_event_filter", f"SELECT event_id, user_id, {r('value', 'value')} FROM events WHERE event_type = 'purchase'")
def b13(spark, folder):
    from hearthline.operators.logs import completed_events

    rows = table(spark, folder, "events").withColumnRenamed("event_type", "event")
    return rounded(completed_events(rows, "purchase").select("event_id", "user_id", "value"))


@query(
    "b14_feature_sets",
    f"{v.LISTING_FEATURES} SELECT house_id, {r('area_sqm', 'area_sqm')}, {r('room_count', 'room_count')}, {r('ln(1 + greatest(area_sqm, 1e-6))', 'log_area_sqm')}, {r('accessibility_index', 'accessibility_index')} FROM feat",
)
def b14(spark, folder):
    from hearthline.plans.feature_sets import project

    rows = v.features(spark, folder).withColumn("log_area_sqm", fx.log_target("area_sqm"))
    wide = project(rows, ["area_sqm", "room_count", "accessibility_index"], keep=["house_id", "area_sqm"], log_area=True)
    return rounded(wide)


@query(
    "b15_count_fallback",
    f"""WITH {v.LISTING}, {v.COMMUNITY}, ui AS (SELECT community_id, count(*) FILTER (WHERE floor_level = 'F' AND bath_count > 1) AS ui_large, count(*) FILTER (WHERE floor_level = 'O' AND bath_count > 1) AS ui_small FROM v_listing GROUP BY 1)
    SELECT community_id, CAST(CASE WHEN coalesce(ui_large, 0) + coalesce(ui_small, 0) > 0 THEN coalesce(ui_large, 0) ELSE poi_large_count END AS BIGINT) AS poi_large_count,
      CAST(CASE WHEN coalesce(ui_large, 0) + coalesce(ui_small, 0) > 0 THEN coalesce(ui_small, 0) ELSE poi_small_count END AS BIGINT) AS poi_small_count
    FROM v_community LEFT JOIN ui USING (community_id)""",
)
def b15(spark, folder):
    many = F.col("bath_count") > 1
    ui = v.listings(spark, folder).groupBy("community_id").agg(
        F.count_if((F.col("floor_level") == "F") & many).alias("ui_large"), F.count_if((F.col("floor_level") == "O") & many).alias("ui_small")
    )
    pages = v.communities(spark, folder).select("community_id", F.col("poi_large_count").alias("page_large"), F.col("poi_small_count").alias("page_small"))
    chosen = quality.choose_counts(pages.join(ui, "community_id", "left"), ["large", "small"], "ui_", "page_")
    return chosen.select("community_id", *[F.col(c).cast("bigint").alias(c) for c in ("poi_large_count", "poi_small_count")])


@query(
    "c1_community_join_rate",
    f"""{v.LISTING_TRIMMED}, {v.COMMUNITY}, c AS (SELECT * FROM v_community WHERE poi_economy_count > 0)
    SELECT region_slug, {n('count(*)', 'listings')}, {n('count(c.community_id)', 'joined')}, {r('avg(CASE WHEN c.community_id IS NOT NULL THEN 1.0 ELSE 0.0 END)', 'join_rate')}
    FROM trimmed LEFT JOIN c ON trimmed.community_id IS NOT DISTINCT FROM c.community_id GROUP BY region_slug""",
)
def c1(spark, folder):
    known = v.communities(spark, folder).filter(F.col("poi_economy_count") > 0)
    joined = cleaning.join_community(v.trimmed_listings(spark, folder), known)
    return rounded(
        joined.groupBy("region_slug").agg(
            F.count("*").alias("listings"), F.count_if("has_community").alias("joined"), F.avg(F.col("has_community").cast("int")).alias("join_rate")
        )
    )


@query(
    "c2_attach_labels",
    f"""WITH {v.RULES} SELECT doc_id, coalesce(l.quality, 0)::BIGINT AS quality, coalesce(l.toxic, 0)::BIGINT AS toxic, v_rules.quality AS quality_rule, v_rules.toxic AS toxic_rule, english
    FROM v_rules LEFT JOIN labels l USING (doc_id)""",
)
def c2(spark, folder):
    from hearthline.functions.labels import keyword_labels

    docs = v.titles(spark, folder)
    rules = docs.select("doc_id", *[c.alias(k) for k, c in keyword_labels("text", {k: v.KEYWORDS[k] for k in ("quality", "toxic", "english")}).items()])
    return rounded(keys.attach_labels(docs.select("doc_id"), table(spark, folder, "labels"), rules, "doc_id"))


@query(
    "c3_predictions_with_features",
    f"WITH {v.PREDICTION} SELECT p.model_name, p.house_id, {r('p.absolute_error_wan', 'absolute_error_wan')}, {r('l.area_sqm', 'area_sqm')} FROM v_pred p JOIN v_listing l USING (house_id)",
)
def c3(spark, folder):
    area = v.listings(spark, folder).select("house_id", "area_sqm")
    return rounded(v.predictions(spark, folder).select("model_name", "house_id", "absolute_error_wan").join(area, "house_id"))


SPLIT_SQL = """placed AS (SELECT *, row_number() OVER (ORDER BY extracted_at NULLS FIRST, house_id) AS pos, count(*) OVER () AS total FROM {source}),
split AS (SELECT *, CASE WHEN pos > total - greatest(CAST(floor(total * 0.2) AS BIGINT), 1) THEN 'test' ELSE 'train' END AS split FROM placed)"""


def time_split(df):
    from hearthline.operators.sampling import split_by_time

    return split_by_time(df, F.unix_micros(F.col("extracted_at").cast("timestamp")), "house_id", 0.2)


@query(
    "c4_reference_medians",
    f"""{v.LISTING_FEATURES}, {SPLIT_SQL.format(source='feat')},
    lay AS (SELECT house_layout, median(area_sqm) AS m FROM split WHERE split = 'train' GROUP BY 1),
    reg AS (SELECT region_slug, median(accessibility_index) AS m FROM split WHERE split = 'train' GROUP BY 1),
    g AS (SELECT median(area_sqm) AS a, median(accessibility_index) AS x FROM split WHERE split = 'train')
    SELECT house_id, split, {r('area_sqm / greatest(coalesce(lay.m, g.a), 1.0)', 'area_layout_efficiency')},
      {r('accessibility_index / greatest(coalesce(reg.m, g.x), 1e-6)', 'region_accessibility_interaction')}
    FROM split LEFT JOIN lay USING (house_layout) LEFT JOIN reg USING (region_slug), g""",
)
def c4(spark, folder):
    split = time_split(materialise(v.features(spark, folder)))
    out = cleaning.apply_reference_medians(split, split.filter(F.col("split") == "train"))
    return rounded(out.select("house_id", "split", "area_layout_efficiency", "region_accessibility_interaction"))


@query(
    "c5_group_mean_baseline",
    f"""{v.LISTING_TRIMMED}, {SPLIT_SQL.format(source='trimmed')},
    c AS (SELECT community_id, avg(total_price_wan) AS m FROM split WHERE split = 'train' GROUP BY 1),
    g AS (SELECT region_slug, avg(total_price_wan) AS m FROM split WHERE split = 'train' GROUP BY 1),
    o AS (SELECT avg(total_price_wan) AS m FROM split WHERE split = 'train')
    SELECT house_id, {r('coalesce(c.m, g.m, o.m)', 'prediction')}, {n('CASE WHEN c.m IS NOT NULL THEN 0 WHEN g.m IS NOT NULL THEN 1 ELSE 2 END', 'fallback_level')}
    FROM (SELECT * FROM split WHERE split = 'test') t LEFT JOIN c USING (community_id) LEFT JOIN g USING (region_slug), o""",
)
def c5(spark, folder):
    split = time_split(v.trimmed_listings(spark, folder))
    train, test = split.filter(F.col("split") == "train"), split.filter(F.col("split") == "test")
    out = keys.group_mean_baseline(train, test, ["community_id", "region_slug"], "total_price_wan")
    return rounded(out.select("house_id", "prediction", "fallback_level"))


@query("c6_unseen_keys", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def c6(spark, folder):
    return keys.unseen(v.titles(spark, folder), table(spark, folder, "labels"), "doc_id").select("doc_id", "lang")


@query("c7_referenced_keys", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def c7(spark, folder):
    buyers = table(spark, folder, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return keys.referenced(table(spark, folder, "customer"), buyers, "c_custkey").select("c_custkey", "c_name")


@query(
    "c8_key_reconciliation",
    """WITH e AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F'), a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
    SELECT coalesce(e.k, a.k) AS k, CASE WHEN a.k IS NULL THEN 'missing' ELSE 'extra' END AS status FROM e FULL JOIN a ON e.k = a.k WHERE e.k IS NULL OR a.k IS NULL""",
)
def c8(spark, folder):
    expected = table(spark, folder, "orders").filter(F.col("o_orderstatus") != "F").select(F.col("o_orderkey").alias("k"))
    return keys.reconcile_keys(expected, table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query(
    "c9_model_pairs",
    f"""WITH {v.PREDICTION} SELECT a.model_name AS model_a, b.model_name AS model_b, a.house_id, {r('a.absolute_error_wan - b.absolute_error_wan', 'diff')}
    FROM v_pred a JOIN v_pred b ON a.house_id = b.house_id AND a.model_name < b.model_name""",
)
def c9(spark, folder):
    from hearthline.operators.pairs import all_pairs, model_pairs

    return rounded(model_pairs(v.predictions(spark, folder), all_pairs(v.MODELS)))


JOINT = f"""WITH {v.PREDICTION}, lim AS (SELECT model_name, quantile_cont(absolute_error_wan, 0.75) AS q, avg(absolute_error_wan) AS mae FROM v_pred GROUP BY 1),
fl AS (SELECT p.*, absolute_error_wan >= q AS high, mae FROM v_pred p JOIN lim USING (model_name))
SELECT a.model_name AS model_a, b.model_name AS model_b, {r('avg(CASE WHEN a.high AND b.high THEN 1.0 ELSE 0.0 END)', 'joint_rate')}, {r('any_value(a.mae)', 'mae_a')}, {r('any_value(b.mae)', 'mae_b')}
FROM fl a JOIN fl b USING (house_id) GROUP BY 1, 2"""


@query("c10_joint_error_grid", JOINT)
def c10(spark, folder):
    return rounded(errors.joint_error(materialise(v.predictions(spark, folder)), v.MODELS))


@query(
    "c11_summary_comparison",
    f"""WITH {v.METRIC}, o AS (SELECT model_name, mae, r2 FROM v_metric WHERE seed = 7), w AS (SELECT model_name, mae, r2 FROM v_metric WHERE seed = 42 AND model_name <> 'global_mean'),
    j AS (SELECT coalesce(o.model_name, w.model_name) AS k, abs(o.mae - w.mae) AS dm, abs(o.r2 - w.r2) AS dr, (o.model_name IS NULL OR w.model_name IS NULL) AS s FROM o FULL JOIN w ON o.model_name = w.model_name),
    l AS (SELECT k, s, 'mae' AS column_name, dm AS d FROM j UNION ALL SELECT k, s, 'r2', dr FROM j)
    SELECT column_name, {r('max(d)', 'max_abs_diff')}, arg_max(k, d) AS worst_key, {n('count(*) FILTER (WHERE s)', 'one_sided_keys')} FROM l GROUP BY 1""",
)
def c11(spark, folder):
    rows = v.metrics(spark, folder)
    old = rows.filter(F.col("seed") == 7)
    new = rows.filter((F.col("seed") == 42) & (F.col("model_name") != "global_mean"))
    return rounded(keys.compare_summaries(old, new, "model_name", ["mae", "r2"]))


@query(
    "c12_agreement_profile_join",
    f"WITH {v.RULES} SELECT doc_id, quality AS quality_rule, l.quality::BIGINT AS quality_label, source, n_chars FROM v_rules JOIN labels l USING (doc_id)".replace("quality AS quality_rule", "v_rules.quality AS quality_rule"),
)
def c12(spark, folder):
    return label_pairs(spark, folder).select("doc_id", "quality_rule", F.col("quality_label"), "source", "n_chars").transform(rounded)


def label_pairs(spark, folder):
    """Rule labels and given labels of the documents that have both, with the profile columns."""
    from hearthline.functions.labels import keyword_labels

    docs = v.titles(spark, folder)
    rules = docs.select("doc_id", "lang", "source", "n_chars", *[c.alias(f"{k}_rule") for k, c in keyword_labels("text", {k: v.KEYWORDS[k] for k in ("quality", "toxic")}).items()])
    given = table(spark, folder, "labels").select("doc_id", *[F.col(c).alias(f"{c}_label") for c in ("quality", "toxic")])
    return rules.join(given, "doc_id")
