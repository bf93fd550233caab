"""Audits, metrics, profiles and summaries (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.functions import listing as fx
from hearthline.functions.labels import keyword_labels
from hearthline.operators import agreement, cleaning, errors, leaderboards, quality
from hearthline.registered import views as v
from hearthline.registered.base import n, query, r, rounded, table
from hearthline.registered.cleaning_queries import JOINT, label_pairs, time_split
from hearthline.session import materialise

REQUIRED = ("total_price_wan", "area_sqm", "region_slug", "room_count")


@query(
    "d1_dataset_audit",
    f"""{v.LISTING_TRIMMED} SELECT
    {n('(SELECT count(*) FROM v_listing)', 'raw_house_count')}, {n('(SELECT count(*) FROM v_listing)', 'deduplicated_house_count')},
    {n('(SELECT count(*) FROM v_listing)', 'raw_community_count')}, {n('(SELECT count(DISTINCT community_id) FROM v_listing)', 'deduplicated_community_count')},
    {n('(SELECT count(*) FROM trimmed)', 'usable_house_count')}, {n('(SELECT count(*) FROM v_listing) - (SELECT count(*) FROM valid)', 'removed_invalid_count')},
    {n('(SELECT count(*) FROM valid) - (SELECT count(*) FROM trimmed)', 'removed_outlier_count')},
    {r('(SELECT avg(CASE WHEN c.community_id IS NULL THEN 0.0 ELSE 1.0 END) FROM trimmed LEFT JOIN (SELECT DISTINCT community_id FROM v_listing) c USING (community_id))', 'community_join_rate')},
    {r('(SELECT count(*) FROM valid) / (SELECT count(*) FROM v_listing)', 'key_field_usable_rate')},
    {', '.join(r(f'(SELECT avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) FROM v_listing)', f'missing_{c}') for c in REQUIRED)},
    {r('pl', 'total_price_wan_low')}, {r('ph', 'total_price_wan_high')}, {r('al', 'area_sqm_low')}, {r('ah', 'area_sqm_high')} FROM bounds""",
)
def d1(spark, folder):
    raw = v.listings(spark, folder)
    houses = materialise(cleaning.keep_first(raw, "house_id", "extracted_at"))
    bounds = cleaning.trim_bounds(houses.filter(cleaning.is_usable()))
    seen = v.priced(spark, folder).select("community_id", "extracted_at")  # a community's record comes with each of its listings
    return rounded(cleaning.audit(raw, houses, bounds, cleaning.keep_first(seen, "community_id", "extracted_at"), required=REQUIRED, raw_communities=seen))


MISSING = ["area_sqm", "room_count", "hall_count", "total_price_wan"]


@query(
    "d2_missing_rates",
    f"WITH {v.LISTING} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {r(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)', 'missing_rate')} FROM v_listing" for c in MISSING)
    + " UNION ALL SELECT 'total_floors', 1.0",
)
def d2(spark, folder):
    return rounded(cleaning.missing_rates(v.listings(spark, folder), [*MISSING, "total_floors"]))


@query("d3_region_medians", f"{v.LISTING_FEATURES} SELECT region_slug, {r('median(accessibility_index)', 'region_median')} FROM feat GROUP BY 1")
def d3(spark, folder):
    return rounded(cleaning.group_medians(materialise(v.features(spark, folder).select("region_slug", "accessibility_index")), "region_slug", "accessibility_index", "region_median"))


@query("d3_layout_medians", f"{v.LISTING_TRIMMED} SELECT {v.LAYOUT_SQL} AS house_layout, {r('median(area_sqm)', 'layout_median')} FROM trimmed GROUP BY 1")
def d3_layout(spark, folder):
    rows = v.trimmed_listings(spark, folder).withColumn("house_layout", fx.layout_text())
    return rounded(cleaning.group_medians(rows, "house_layout", "area_sqm", "layout_median"))


@query(
    "d4_regression_metrics",
    f"WITH {v.PREDICTION}, m AS (SELECT model_name, count(*) AS n, {v.METRIC_SQL} FROM v_pred GROUP BY 1) SELECT model_name, {n('n', 'n')}, {r('mae', 'mae')}, {r('rmse', 'rmse')}, {r('r2', 'r2')}, {r('mape', 'mape')} FROM m",
)
def d4(spark, folder):
    return rounded(errors.regression_metrics(v.predictions(spark, folder)))


def sized_errors(spark, folder):
    sized = v.predictions(spark, folder).join(v.listings(spark, folder).select("house_id", "area_sqm"), "house_id")
    return cleaning.with_quantile_bins(materialise(sized), {"area_sqm": "area_bin", "actual_price_wan": "price_bin"})


def bin_sql(column: str, prefix: str) -> str:
    steps = " ".join(f"WHEN {column} <= {prefix}[{i + 1}] THEN {i}" for i in range(1, 5))
    return f"CASE WHEN {column} IS NULL THEN NULL {steps} END"


@query(
    "d5_error_grouping_sets",
    f"""WITH {v.PREDICTION}, s AS (SELECT p.*, l.area_sqm FROM v_pred p JOIN v_listing l USING (house_id)),
    e AS (SELECT quantile_cont(area_sqm, [0.0, 0.25, 0.5, 0.75, 1.0]) AS ea, quantile_cont(actual_price_wan, [0.0, 0.25, 0.5, 0.75, 1.0]) AS ep FROM s),
    b AS (SELECT model_name, region_slug, decoration_type, coalesce(CAST({bin_sql('area_sqm', 'ea')} AS VARCHAR), 'null') AS area_bin, coalesce(CAST({bin_sql('actual_price_wan', 'ep')} AS VARCHAR), 'null') AS price_bin,
      absolute_error_wan, actual_price_wan, predicted_price_wan FROM s, e)
    SELECT model_name, CASE WHEN grouping(region_slug) = 0 THEN 'region_slug' WHEN grouping(decoration_type) = 0 THEN 'decoration_type' WHEN grouping(area_bin) = 0 THEN 'area_bin' ELSE 'price_bin' END AS stratum,
      coalesce(region_slug, decoration_type, area_bin, price_bin) AS stratum_value, {n('count(*)', 'n')}, {r('avg(absolute_error_wan)', 'mae')}, {r('avg(actual_price_wan)', 'mean_actual')}, {r('avg(predicted_price_wan)', 'mean_predicted')}
    FROM b GROUP BY GROUPING SETS ((model_name, region_slug), (model_name, decoration_type), (model_name, area_bin), (model_name, price_bin))""",
)
def d5(spark, folder):
    return rounded(errors.error_by_strata(sized_errors(spark, folder), ["region_slug", "decoration_type", "area_bin", "price_bin"], by=["model_name"]))


@query(
    "d6_temporal_profile",
    f"""WITH {v.LISTING}, placed AS (SELECT *, row_number() OVER (ORDER BY extracted_at NULLS FIRST, house_id) AS pos, count(*) OVER () AS total FROM v_listing),
    s AS (SELECT *, CASE WHEN pos > total - greatest(CAST(floor(total * 0.2) AS BIGINT), 1) THEN 'test' ELSE 'train' END AS split FROM placed)
    SELECT coalesce(split, 'all') AS scope, {n('count(*)', 'n')}, strftime(min(extracted_at), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(extracted_at), '%Y-%m-%d %H:%M:%S') AS last_at, {n('count(DISTINCT CAST(extracted_at AS DATE))', 'distinct_days')}
    FROM s GROUP BY ROLLUP (split)""",
)
def d6(spark, folder):
    profile = errors.temporal_profile(time_split(v.priced(spark, folder)))
    return profile.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_at", "last_at")})


DESCRIBED = ["total_price_wan", "area_sqm", "room_count", "accessibility_index", "poi_total_count", "poi_balance_score"]


@query(
    "d7_descriptive_statistics",
    f"""{v.LISTING_FEATURES}, u AS (SELECT feature, value FROM (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in DESCRIBED)} FROM feat) UNPIVOT (value FOR feature IN ({', '.join(DESCRIBED)})))
    SELECT feature, {n('count(*)', 'n')}, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')}, {r('min(value)', 'min')}, {r('quantile_cont(value, 0.25)', 'p25')}, {r('median(value)', 'p50')},
      {r('quantile_cont(value, 0.75)', 'p75')}, {r('max(value)', 'max')}, {r('skewness(value)', 'skew')} FROM u GROUP BY 1""",
)
def d7(spark, folder):
    return rounded(errors.describe_columns(materialise(v.features(spark, folder).select(*DESCRIBED)), DESCRIBED))


@query(
    "d8_value_counts",
    f"WITH {v.LISTING} SELECT region_slug AS value, {n('count(*)', 'n')}, {r('count(*) * 100.0 / (SELECT count(*) FROM v_listing)', 'percent')} FROM v_listing GROUP BY 1",
)
def d8(spark, folder):
    return rounded(errors.value_counts(v.listings(spark, folder), "region_slug"))


BANDS = ("[0,60)", "[60,100)", "[100,150)", "[150,inf)", "[600,inf)")
BAND_LIMITS = ((0.0, 60.0, "[0,60)"), (60.0, 100.0, "[60,100)"), (100.0, 150.0, "[100,150)"), (600.0, None, "[600,inf)"), (150.0, None, "[150,inf)"))


@query(
    "d8_price_bands",
    f"""WITH {v.LISTING}, b AS (SELECT CASE WHEN total_price_wan >= 600 THEN '[600,inf)' WHEN total_price_wan >= 150 THEN '[150,inf)' WHEN total_price_wan >= 100 THEN '[100,150)' WHEN total_price_wan >= 60 THEN '[60,100)' WHEN total_price_wan >= 0 THEN '[0,60)' END AS band FROM v_listing),
    d AS (SELECT unnest(['[0,60)', '[60,100)', '[100,150)', '[150,inf)', '[600,inf)']) AS band)
    SELECT d.band, {n('count(b.band)', 'n')}, {r('count(b.band) * 100.0 / (SELECT count(band) FROM b)', 'percent')} FROM d LEFT JOIN b USING (band) GROUP BY 1""",
)
def d8_bands(spark, folder):
    return rounded(errors.band_counts(v.listings(spark, folder), fx.price_band("total_price_wan", BAND_LIMITS), BANDS))


CELLS = f"""{v.LISTING_TRIMMED}, e AS (SELECT quantile_cont(area_sqm, [0.0, 0.25, 0.5, 0.75, 1.0]) AS ea FROM trimmed),
c AS (SELECT region_slug, floor_level, {bin_sql('area_sqm', 'ea')} AS area_bin, total_price_wan AS p FROM trimmed, e),
cells AS (SELECT region_slug, floor_level, area_bin, count(*) AS n, avg(p) AS mean_value, stddev_pop(p) AS std_value, min(p) AS min_value, max(p) AS max_value, median(p) AS median_value, stddev_pop(p) / avg(p) AS cv
  FROM c WHERE area_bin IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 3)"""


def cells(spark, folder):
    binned = cleaning.with_quantile_bins(v.trimmed_listings(spark, folder), {"area_sqm": "area_bin"})
    return errors.cell_dispersion(binned, ["region_slug", "floor_level", "area_bin"], "total_price_wan")


@query(
    "d9_cell_dispersion",
    f"{CELLS} SELECT region_slug, floor_level, {n('area_bin', 'area_bin')}, {n('n', 'n')}, {r('mean_value', 'mean_value')}, {r('std_value', 'std_value')}, {r('min_value', 'min_value')}, {r('max_value', 'max_value')}, {r('median_value', 'median_value')}, {r('cv', 'cv')} FROM cells",
)
def d9(spark, folder):
    return rounded(cells(spark, folder))


@query(
    "d10_dispersion_summary",
    f"{CELLS} SELECT {n('count(*)', 'cells')}, {n('sum(n)', 'samples')}, {r('avg(cv)', 'mean_cv')}, {r('median(cv)', 'median_cv')}, {r('max(cv)', 'max_cv')}, {r('min(cv)', 'min_cv')}, {n('count(*) FILTER (WHERE cv > 0.10)', 'above_10')}, {n('count(*) FILTER (WHERE cv > 0.15)', 'above_15')}, {n('count(*) FILTER (WHERE cv > 0.20)', 'above_20')} FROM cells",
)
def d10(spark, folder):
    return rounded(errors.dispersion_summary(materialise(cells(spark, folder))))


@query(
    "d11_variance_decomposition",
    f"""{v.LISTING_TRIMMED}, y AS (SELECT community_id AS g, total_price_wan - (SELECT avg(total_price_wan) FROM trimmed) AS d FROM trimmed),
    p AS (SELECT g, count(*) AS c, sum(d) AS s, sum(d * d) AS q FROM y GROUP BY 1),
    t AS (SELECT CAST(sum(c) AS DOUBLE) AS nn, CAST(count(*) AS DOUBLE) AS k, sum(s * s / c) AS ssb, sum(q) AS sst, CAST(sum(c * c) AS DOUBLE) AS cc FROM p),
    u AS (SELECT *, sst - ssb AS ssw, ssb / (k - 1) AS msb, (sst - ssb) / (nn - k) AS msw, (nn - cc / nn) / (k - 1) AS n0 FROM t)
    SELECT {n('nn', 'n_rows')}, {n('k', 'n_groups')}, {r('ssb', 'ssb', 2)}, {r('ssw', 'ssw', 2)}, {r('sst', 'sst', 2)}, {r('ssb / sst', 'eta_squared')}, {r('(msb - msw) / (msb + (n0 - 1) * msw)', 'icc')} FROM u""",
)
def d11(spark, folder):
    table_ = errors.variance_decomposition(v.trimmed_listings(spark, folder), "community_id", "total_price_wan")
    return rounded(table_, ssb=2, ssw=2, sst=2)


@query(
    "d12_label_prevalence",
    f"WITH {v.RULES}, u AS (SELECT label, value FROM (SELECT {', '.join(v.KEYWORDS)} FROM v_rules) UNPIVOT (value FOR label IN ({', '.join(v.KEYWORDS)}))) SELECT label, {n('count(*)', 'n')}, {n('sum(value)', 'positives')}, {r('avg(value)', 'rate')} FROM u GROUP BY 1",
)
def d12(spark, folder):
    rows = v.titles(spark, folder).select(*[c.alias(k) for k, c in keyword_labels("text", v.KEYWORDS).items()])
    return rounded(agreement.label_prevalence(rows, list(v.KEYWORDS)))


PAIR_LABELS = ("quality", "toxic")
TABLE2X2 = f"""WITH {v.RULES}, j AS (SELECT v_rules.doc_id, lang, source, n_chars, v_rules.quality AS qr, v_rules.toxic AS tr, l.quality AS ql, l.toxic AS tl FROM v_rules JOIN labels l USING (doc_id)),
u AS (SELECT doc_id, lang, source, n_chars, 'quality' AS label, qr AS a, ql AS b FROM j UNION ALL SELECT doc_id, lang, source, n_chars, 'toxic', tr, tl FROM j),
k AS (SELECT label, CAST(count(*) AS DOUBLE) AS c, count(*) FILTER (WHERE a = 1 AND b = 1) AS n11, count(*) FILTER (WHERE a = 1 AND b = 0) AS n10, count(*) FILTER (WHERE a = 0 AND b = 1) AS n01, count(*) FILTER (WHERE a = 0 AND b = 0) AS n00 FROM u GROUP BY 1),
s AS (SELECT *, (n11 + n00) / c AS po, ((n11 + n10) / c) * ((n11 + n01) / c) + ((n01 + n00) / c) * ((n10 + n00) / c) AS pe FROM k),
agr AS (SELECT *, CASE WHEN 1 - pe >= 1e-12 THEN (po - pe) / (1 - pe) END AS kappa FROM s)"""


@query(
    "d13_annotator_tables",
    f"{TABLE2X2} SELECT label, {n('n11', 'n11')}, {n('n10', 'n10')}, {n('n01', 'n01')}, {n('n00', 'n00')}, {r('po', 'agreement')}, {r('1 - po', 'disagreement')}, {r('(n11 + n10) / c', 'rate_a')}, {r('(n11 + n01) / c', 'rate_b')}, {r('kappa', 'kappa')} FROM agr",
)
def d13(spark, folder):
    return rounded(agreement.label_agreement(label_pairs(spark, folder), PAIR_LABELS, "_rule", "_label"))


@query(
    "d14_kappa_summary",
    f"{TABLE2X2} SELECT {n('count(*)', 'labels')}, {r('avg(kappa)', 'mean_kappa')}, {r('median(kappa)', 'median_kappa')}, {r('min(kappa)', 'min_kappa')}, {r('max(kappa)', 'max_kappa')}, {r('avg(1 - po)', 'mean_disagreement')} FROM agr",
)
def d14(spark, folder):
    return rounded(agreement.agreement_summary(agreement.label_agreement(label_pairs(spark, folder), PAIR_LABELS, "_rule", "_label")))


@query(
    "d15_config_evaluation",
    f"""WITH {v.RULES}, a AS (SELECT source AS config, quality, toxic, english, n_chars < 2000 AS ok FROM v_rules)
    SELECT config, {n('count(*)', 'n')}, {r('avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)', 'parse_ok_rate')}, {r('avg(CASE WHEN ok THEN CASE WHEN quality + toxic + english > 0 THEN 1.0 ELSE 0.0 END END)', 'coverage')}, {r('avg(CASE WHEN ok THEN quality + toxic + english END)', 'mean_positives')} FROM a GROUP BY 1""",
)
def d15(spark, folder):
    names = ["quality", "toxic", "english"]
    rows = v.titles(spark, folder).select(
        F.col("source").alias("config"), (F.col("n_chars") < 2000).alias("parse_ok"), *[c.alias(k) for k, c in keyword_labels("text", {k: v.KEYWORDS[k] for k in names}).items()]
    )
    return rounded(agreement.config_evaluation(rows, names))


@query(
    "d15_config_kappa",
    f"""{TABLE2X2}, kc AS (SELECT source AS config, label, CAST(count(*) AS DOUBLE) AS c, count(*) FILTER (WHERE a = 1 AND b = 1) AS n11, count(*) FILTER (WHERE a = 1 AND b = 0) AS n10, count(*) FILTER (WHERE a = 0 AND b = 1) AS n01, count(*) FILTER (WHERE a = 0 AND b = 0) AS n00 FROM u GROUP BY 1, 2),
    sc AS (SELECT *, (n11 + n00) / c AS po, ((n11 + n10) / c) * ((n11 + n01) / c) + ((n01 + n00) / c) * ((n10 + n00) / c) AS pe FROM kc), ac AS (SELECT *, CASE WHEN 1 - pe >= 1e-12 THEN (po - pe) / (1 - pe) END AS kappa FROM sc)
    SELECT config, {n('count(*)', 'labels')}, {r('avg(kappa)', 'mean_kappa')}, {r('median(kappa)', 'median_kappa')} FROM ac GROUP BY 1""",
)
def d15_kappa(spark, folder):
    pairs = label_pairs(spark, folder).withColumnRenamed("source", "config")
    per_label = agreement.label_agreement(pairs, PAIR_LABELS, "_rule", "_label", by=["config"])
    return rounded(agreement.agreement_summary(per_label, ["config"]).select("config", "labels", "mean_kappa", "median_kappa"))


@query(
    "d16_parse_report",
    f"""WITH {v.RULES}, a AS (SELECT doc_id, n_chars < 2000 AS ok, quality + toxic AS p FROM v_rules), f AS (SELECT a.*, l.doc_id AS e FROM a FULL JOIN labels l ON a.doc_id = l.doc_id)
    SELECT {n('count(e)', 'expected')}, {n('count(doc_id)', 'answered')}, {n('count(*) FILTER (WHERE doc_id IS NULL)', 'missing')}, {n('count(*) FILTER (WHERE e IS NULL)', 'extra')}, {n('count(*) FILTER (WHERE NOT ok)', 'parse_errors')},
      {r('avg(CASE WHEN ok THEN CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END END)', 'coverage')}, {r('avg(CASE WHEN ok THEN p END)', 'mean_positives')} FROM f""",
)
def d16(spark, folder):
    labels = {k: v.KEYWORDS[k] for k in PAIR_LABELS}
    rows = v.titles(spark, folder).select("doc_id", (F.col("n_chars") < 2000).alias("parse_ok"), *[c.alias(k) for k, c in keyword_labels("text", labels).items()])
    return rounded(agreement.parse_report(rows, table(spark, folder, "labels"), "doc_id", PAIR_LABELS))


@query(
    "d17_seed_summary",
    f"""WITH {v.METRIC}, k AS (SELECT *, rank() OVER (PARTITION BY seed ORDER BY mae) AS rk FROM v_metric)
    SELECT model_name, {r('avg(mae)', 'mae_mean')}, {r('stddev_samp(mae)', 'mae_std')}, {r('min(mae)', 'mae_min')}, {r('max(mae)', 'mae_max')}, {r('avg(r2)', 'r2_mean')}, {r('avg(rk)', 'mean_rank')}, {n('count(*) FILTER (WHERE rk = 1)', 'wins')}, {n('count(DISTINCT seed)', 'seeds')} FROM k GROUP BY 1""",
)
def d17(spark, folder):
    return rounded(leaderboards.seed_summary(v.metrics(spark, folder)))


CORR_COLUMNS = ["total_price_wan", "area_sqm", "room_count", "accessibility_index"]


@query(
    "d18_pearson_matrix",
    f"{v.LISTING_FEATURES} " + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r(f'corr({a}, {b})', 'r')} FROM feat" for a in CORR_COLUMNS for b in CORR_COLUMNS),
)
def d18(spark, folder):
    return rounded(errors.correlation_matrix(v.features(spark, folder), CORR_COLUMNS))


SPEARMAN = ["priority_mean", "region_mean"]


@query(
    "d19_spearman_matrix",
    f"""WITH {v.PREDICTION}, k AS (SELECT model_name, house_id, rank() OVER (PARTITION BY model_name ORDER BY absolute_error_wan) + (count(*) OVER (PARTITION BY model_name, absolute_error_wan) - 1) / 2.0 AS rk FROM v_pred),
    w AS (SELECT house_id, max(rk) FILTER (WHERE model_name = 'priority_mean') AS priority_mean, max(rk) FILTER (WHERE model_name = 'region_mean') AS region_mean FROM k GROUP BY 1) """
    + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r(f'corr({a}, {b})', 'r')} FROM w" for a in SPEARMAN for b in SPEARMAN),
)
def d19(spark, folder):
    rows = v.predictions(spark, folder).filter(F.col("model_name").isin(SPEARMAN))
    return rounded(errors.spearman_matrix(rows, SPEARMAN, "absolute_error_wan"))


@query("d20_joint_error_rates", JOINT)
def d20(spark, folder):
    return rounded(errors.joint_error(materialise(v.predictions(spark, folder)), v.MODELS))


@query(
    "d21_price_segments",
    f"""WITH {v.PREDICTION}, q AS (SELECT quantile_cont(actual_price_wan, 0.33) AS q1, quantile_cont(actual_price_wan, 0.67) AS q2 FROM v_pred),
    s AS (SELECT *, CASE WHEN actual_price_wan <= q1 THEN 'low' WHEN actual_price_wan <= q2 THEN 'mid' ELSE 'high' END AS segment FROM v_pred, q)
    SELECT model_name, segment, {n('count(*)', 'n')}, {r('avg(actual_price_wan)', 'mean_price')}, {r('stddev_samp(actual_price_wan)', 'std_price')}, {r('avg(absolute_error_wan)', 'mae')} FROM s GROUP BY 1, 2""",
)
def d21(spark, folder):
    return rounded(errors.segment_distribution(errors.price_segments(materialise(v.predictions(spark, folder))), by=["model_name", "segment"]))


def cost_events(spark, folder):
    """Metric rows with made-to-measure cost columns: rows as seconds, spread as prediction time."""
    return v.metrics(spark, folder).select(F.concat_ws("__", F.col("seed").cast("string"), "model_name").alias("model_name"), "mae", "r2", F.col("n").cast("double").alias("train_seconds"), (F.col("rmse") / 1000).alias("predict_seconds"))


@query(
    "d22_cost_table",
    f"""WITH {v.METRIC}, e AS (SELECT concat(seed, '__', model_name) AS model_name, mae, CAST(n AS DOUBLE) AS ts, rmse / 1000 AS ps FROM v_metric), b AS (SELECT ts AS bt, mae AS bm FROM e WHERE model_name = '42__global_mean')
    SELECT model_name, {r('mae', 'mae')}, {r('ts', 'train_seconds')}, {r('ps', 'predict_seconds')}, {r('ps * 1000.0 / 1383', 'latency_ms_per_row')}, {r('ts / bt', 'relative_train_cost')}, {r('(bm - mae) / bm * 100.0', 'mae_gain_percent')} FROM e, b""",
)
def d22(spark, folder):
    return rounded(leaderboards.cost_table(cost_events(spark, folder), "42__global_mean", 1383))


@query(
    "d23_metric_deltas",
    f"""WITH {v.METRIC} SELECT a.model_name, {r('a.mae', 'mae')}, {r('a.r2', 'r2')}, {r('a.mae - b.mae', 'mae_delta')}, {r('a.r2 - b.r2', 'r2_delta')}
    FROM v_metric a LEFT JOIN (SELECT * FROM v_metric WHERE seed = 7 AND model_name <> 'region_mean') b ON a.model_name = b.model_name WHERE a.seed = 42""",
)
def d23(spark, folder):
    rows = v.metrics(spark, folder)
    previous = rows.filter((F.col("seed") == 7) & (F.col("model_name") != "region_mean"))
    out = leaderboards.delta_to_previous(rows.filter(F.col("seed") == 42), previous)
    return rounded(out.select("model_name", "mae", "r2", "mae_delta", "r2_delta"))


@query(
    "d24_method_contrast",
    f"""WITH {v.METRIC} SELECT {n('seed', 'seed')}, {r("max(mae) FILTER (WHERE model_name = 'region_mean')", 'region_mean_mae')}, {r("max(mae) FILTER (WHERE model_name = 'global_mean')", 'global_mean_mae')},
    {r("max(mae) FILTER (WHERE model_name = 'region_mean') - max(mae) FILTER (WHERE model_name = 'global_mean')", 'delta')} FROM v_metric GROUP BY seed
    HAVING count(*) FILTER (WHERE model_name = 'region_mean') = 1 AND count(*) FILTER (WHERE model_name = 'global_mean') = 1""",
)
def d24(spark, folder):
    return rounded(leaderboards.method_contrast(v.metrics(spark, folder), "seed", "model_name", "region_mean", "global_mean"))


@query(
    "d25_best_model",
    f"WITH {v.METRIC}, m AS (SELECT model_name, avg(mae) AS mae FROM v_metric WHERE model_name <> 'global_mean' GROUP BY 1) SELECT arg_min(model_name, mae) AS model_name, {r('min(mae)', 'mae')} FROM m",
)
def d25(spark, folder):
    means = v.metrics(spark, folder).groupBy("model_name").agg(F.avg("mae").alias("mae"))
    return rounded(leaderboards.best_model(means, exclude=["global_mean"]))


@query(
    "d26_experiment_summary",
    f"WITH {v.METRIC} SELECT CAST(seed AS VARCHAR) AS experiment, arg_min(model_name, mae) AS best_model, {r('min(mae)', 'mae')}, {r('arg_min(r2, mae)', 'r2')}, {n('count(*)', 'models')}, {r('min(mae) - 125.0', 'delta_to_baseline')} FROM v_metric GROUP BY 1",
)
def d26(spark, folder):
    return rounded(leaderboards.experiment_summary(cost_events(spark, folder), 125.0))


@query(
    "d27_region_rates",
    f"""WITH {v.LISTING}, f AS (SELECT region_slug, area_sqm IS NOT NULL AS ok, (CAST(hall_count IS NOT NULL AS INT) + CAST(coalesce(bath_count, 0) > 0 AS INT)) / 2.0 AS cov FROM v_listing),
    a AS (SELECT region_slug, count(*) AS c, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS s, avg(CASE WHEN ok THEN cov END) AS v FROM f GROUP BY 1)
    SELECT region_slug, {n('c', 'n')}, {r('s', 'success_rate')}, {r('v', 'field_coverage')}, coalesce(s >= 0.98 AND v >= 0.8, false) AS passed FROM a""",
)
def d27(spark, folder):
    covered = (F.col("hall_count").isNotNull().cast("int") + (F.coalesce("bath_count", F.lit(0.0)) > 0).cast("int")) / 2.0
    rates = quality.region_rates(v.listings(spark, folder), F.col("area_sqm").isNotNull(), covered, min_success=0.98, min_coverage=0.8)
    return rounded(rates)


@query(
    "d28_readiness",
    f"""WITH {v.LISTING}, {v.COMMUNITY}, f AS (SELECT (2 + CAST(area_sqm IS NOT NULL AS INT) + CAST(room_count IS NOT NULL AS INT)) / 4.0 AS c, k.community_id IS NOT NULL AS l,
      coalesce({' + '.join(f"CAST({fx.poi_column(t)} > 0 AS INT)" for t in v.TYPES)}, 0) >= 3 AS f FROM v_listing LEFT JOIN v_community k USING (community_id))
    SELECT {n('count(*)', 'n')}, {r('avg(c)', 'average_completeness')}, bool_and(c >= 1) AS all_complete, bool_and(l) AS all_linked, bool_and(f) AS all_facilities, bool_and(c >= 1) AND bool_and(l) AND bool_and(f) AS ready FROM f""",
)
def d28(spark, folder):
    rows = cleaning.join_community(v.listings(spark, folder), v.communities(spark, folder))
    complete = quality.row_completeness({c: [c] for c in ("house_id", "total_price_wan", "area_sqm", "room_count")})
    return rounded(quality.readiness(rows, complete, F.col("has_community"), F.size(quality.present_categories(v.TYPES)) >= 3))


@query("d29_facility_counts", f"WITH {v.COMMUNITY} SELECT community_id, {', '.join(n(c, c) for c in v.COUNTS)} FROM v_community WHERE {' + '.join(v.COUNTS)} > 0")
def d29(spark, folder):
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_type").alias("type"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey").join(parts, "l_partkey")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("community_id"))
    return quality.facility_counts(lines.join(orders, "l_orderkey"), v.TYPES)


@query(
    "d30_information_ceiling",
    f"""{CELLS}, s AS (SELECT median(cv) AS m, count(*) FILTER (WHERE cv > 0.15) / count(*) AS h FROM cells)
    SELECT {r('greatest(0.0, 1 - m * m)', 'dispersion_ceiling')}, {r('0.3 + 0.75 * (0.2 - 0.05) + 0.3 * (0.3 - 0.2)', 'gain_ceiling')}, {r('h', 'high_dispersion_share')},
      {r('least(0.70, greatest(0.32, least(greatest(0.0, 1 - m * m), 0.3 + 0.75 * 0.15 + 0.03) - 0.05 * h))', 'estimated_ceiling')} FROM s""",
)
def d30(spark, folder):
    summary = errors.dispersion_summary(materialise(cells(spark, folder)))
    return rounded(errors.information_ceiling(summary, best_r2=0.3, base_r2=0.05, enhanced_r2=0.2))


@query(
    "d31_disagreement_profile",
    f"""{TABLE2X2}, top AS (SELECT label, 1 - po AS dis FROM agr ORDER BY dis DESC, label LIMIT 5), dr AS (SELECT u.* FROM u JOIN top USING (label) WHERE a <> b),
    m AS (SELECT label, median(n_chars) AS med FROM dr GROUP BY 1), c AS (SELECT label, lang, count(*) AS k, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, lang) AS rk FROM dr GROUP BY 1, 2)
    SELECT label, {r('dis', 'disagreement')}, {r('med', 'median_price')}, {r('(SELECT median(n_chars) FROM j)', 'overall_median_price')}, {n('rk', 'region_rank')}, lang AS region, {n('k', 'rows')} FROM c JOIN m USING (label) JOIN top USING (label) WHERE rk <= 3""",
)
def d31(spark, folder):
    return rounded(agreement.disagreement_profile(materialise(label_pairs(spark, folder)), PAIR_LABELS, "_rule", "_label", "n_chars", "lang"))


@query(
    "d31_label_redundancy",
    f"WITH {v.RULES} SELECT {n('count(*)', 'n')}, {r('avg(CASE WHEN english = 1 THEN CASE WHEN lang = chr(101) || chr(110) THEN 1.0 ELSE 0.0 END END)', 'field_given_label')}, {r('avg(CASE WHEN english = 0 THEN CASE WHEN lang = chr(101) || chr(110) THEN 1.0 ELSE 0.0 END END)', 'field_given_no_label')} FROM v_rules",
)
def d31_redundancy(spark, folder):
    rows = v.titles(spark, folder).select("lang", keyword_labels("text", {"english": v.KEYWORDS["english"]})["english"].alias("english"))
    return rounded(agreement.redundancy(rows, "english", F.col("lang") == "en"))
