"""Windows, sorts, set operations, samples and splits (E, F, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.functions.labels import keyword_labels
from hearthline.operators import agreement, cleaning, errors, leaderboards, logs, sampling
from hearthline.operators.ranking import average_ranks, exact_quantiles, null_safe_join
from hearthline.registered import views as v
from hearthline.registered.aggregate_queries import PAIR_LABELS, TABLE2X2, bin_sql
from hearthline.registered.base import n, query, r, rounded, table
from hearthline.registered.cleaning_queries import label_pairs, time_split
from hearthline.registered.views import hash_sql


def lines(spark, folder):
    """Lineitem copies of one order line: the key is not unique, the other columns order the copies."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp_ntz").alias("l_shipdate"), "l_extendedprice", "l_partkey", "l_suppkey"
    )


LINE_OUT = f"l_orderkey, {n('l_linenumber', 'l_linenumber')}, {r('l_extendedprice', 'l_extendedprice')}, l_partkey, l_suppkey"


@query(
    "e1_keep_first",
    f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_extendedprice, l_partkey, l_suppkey) AS rn FROM lineitem) SELECT {LINE_OUT} FROM k WHERE rn = 1",
)
def e1(spark, folder):
    order = [F.col(c).asc() for c in ("l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey")]
    return rounded(cleaning.keep_one(lines(spark, folder), ["l_orderkey", "l_linenumber"], order).drop("l_shipdate"))


@query(
    "e1_keep_last",
    f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) SELECT {LINE_OUT} FROM k WHERE rn = 1",
)
def e1_last(spark, folder):
    order = [F.col(c).desc() for c in ("l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey")]
    return rounded(cleaning.keep_one(lines(spark, folder), ["l_orderkey", "l_linenumber"], order).drop("l_shipdate"))


@query(
    "e2_group_transform",
    f"{v.LISTING_TRIMMED} SELECT house_id, {r('median(area_sqm) OVER (PARTITION BY region_slug)', 'region_median_area')}, {n('count(area_sqm) OVER (PARTITION BY region_slug)', 'region_rows')} FROM trimmed",
)
def e2(spark, folder):
    rows = v.trimmed_listings(spark, folder).select("house_id", "region_slug", "area_sqm")
    medians = exact_quantiles(rows, "area_sqm", {"region_median_area": 0.5}, by=["region_slug"])
    return rounded(null_safe_join(rows, medians, ["region_slug"]).select("house_id", "region_median_area", F.col("n_values").alias("region_rows")))


@query("e3_seed_rank", f"WITH {v.METRIC} SELECT model_name, {n('seed', 'seed')}, {r('mae', 'mae')}, {n('rank() OVER (PARTITION BY seed ORDER BY mae)', 'seed_rank')} FROM v_metric")
def e3(spark, folder):
    return rounded(leaderboards.with_seed_rank(v.metrics(spark, folder)).select("model_name", "seed", "mae", "seed_rank"))


@query(
    "e4_time_holdout",
    f"""WITH {v.LISTING}, p AS (SELECT house_id, row_number() OVER (ORDER BY extracted_at NULLS FIRST, house_id) AS pos, count(*) OVER () AS total FROM v_listing)
    SELECT house_id, CASE WHEN pos > total - greatest(CAST(floor(total * 0.2) AS BIGINT), 1) THEN 'test' ELSE 'train' END AS split FROM p""",
)
def e4(spark, folder):
    return time_split(v.priced(spark, folder)).select("house_id", "split")


@query(
    "e5_quantile_bins",
    f"""{v.LISTING_TRIMMED}, e AS (SELECT quantile_cont(room_count, [0.0, 0.25, 0.5, 0.75, 1.0]) AS er, quantile_cont(total_price_wan, [0.0, 0.25, 0.5, 0.75, 1.0]) AS ep FROM trimmed),
    d AS (SELECT er, ep, list_sort(list_distinct(er)) AS dr FROM e)
    SELECT house_id, {n('CASE WHEN room_count <= dr[2] THEN 1 WHEN room_count <= dr[3] THEN 2 WHEN room_count <= dr[4] THEN 3 WHEN room_count <= dr[5] THEN 4 END', 'room_bin')}, {n(bin_sql('total_price_wan', 'ep'), 'price_bin')} FROM trimmed, d""",
)
def e5(spark, folder):
    binned = cleaning.with_quantile_bins(v.trimmed_listings(spark, folder), {"room_count": "room_bin", "total_price_wan": "price_bin"})
    return rounded(binned.select("house_id", "room_bin", "price_bin"))


@query(
    "e6_average_ranks",
    f"""SELECT l_returnflag, {r('l_quantity', 'l_quantity')}, {n('count(*)', 'ties')}, {r('sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - count(*) + (count(*) + 1) / 2.0', 'avg_rank')}
    FROM lineitem GROUP BY l_returnflag, l_quantity""",
)
def e6(spark, folder):
    return rounded(average_ranks(table(spark, folder, "lineitem").select("l_returnflag", "l_quantity"), "l_quantity", by=["l_returnflag"]))


@query(
    "e8_open_failures",
    f"""WITH {v.EVENTS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY failure_id ORDER BY failed_at DESC, error_message DESC) AS rn FROM v_log WHERE record_type = 'failure') WHERE rn = 1),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY failure_id ORDER BY retried_at DESC, resolved DESC) AS rn FROM v_log WHERE record_type = 'retry_update') WHERE rn = 1)
    SELECT f.failure_id, coalesce(f.target_type, 'prop') AS target_type, f.target_url, strftime(f.failed_at, '%Y-%m-%d %H:%M:%S') AS failed_at, {n('coalesce(u.retry_count, f.retry_count, 0)', 'retry_count')}, coalesce(u.error_message, f.error_message) AS error_message
    FROM f LEFT JOIN u USING (failure_id) WHERE NOT coalesce(u.resolved, f.resolved, false) AND coalesce(f.target_type, 'prop') = 'prop'""",
)
def e8(spark, folder):
    rows = logs.open_failures(v.event_log(spark, folder), "prop")
    return rounded(rows.withColumn("failed_at", F.date_format("failed_at", "yyyy-MM-dd HH:mm:ss")))


@query(
    "e9_last_failed_url",
    f"WITH {v.EVENTS} SELECT arg_max(target_url, failed_at) AS target_url, strftime(max(failed_at), '%Y-%m-%d %H:%M:%S') AS failed_at FROM v_log WHERE record_type = 'failure' AND starts_with(target_url, 'https://example.com/prop/view/1')",
)
def e9(spark, folder):
    row = logs.last_failed_url(v.event_log(spark, folder), "https://example.com/prop/view/1")
    return row.withColumn("failed_at", F.date_format("failed_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "e10_delta_to_first",
    f"WITH {v.PREDICTION}, m AS (SELECT model_name, {v.METRIC_SQL} FROM v_pred GROUP BY 1) SELECT model_name, {r('mae', 'mae')}, {r('r2', 'r2')}, {r('mae - first_value(mae) OVER (ORDER BY model_name)', 'delta_mae')}, {r('r2 - first_value(r2) OVER (ORDER BY model_name)', 'delta_r2')} FROM m",
)
def e10(spark, folder):
    rows = errors.regression_metrics(v.predictions(spark, folder)).select("model_name", "mae", "r2")
    return rounded(leaderboards.delta_to_first(rows, "model_name", ["mae", "r2"]))


@query(
    "e11_link_status",
    f"""WITH {v.LISTING}, l AS (SELECT house_id, community_id, floor_level <> 'F' OR area_sqm > 20 AS is_valid, CASE WHEN decoration_type <> '5-LOW' THEN community_id END AS cid, coalesce(bath_count, 0) > 0 AS ok FROM v_listing),
    f AS (SELECT cid, min(house_id) AS first_id FROM l WHERE coalesce(is_valid, false) AND cid IS NOT NULL AND ok GROUP BY 1)
    SELECT house_id, CASE WHEN NOT coalesce(is_valid, false) THEN 'prop_failed' WHEN l.cid IS NULL THEN 'missing' WHEN house_id > first_id THEN 'linked_from_cache' WHEN house_id = first_id THEN 'linked_new_fetch' ELSE 'community_failed' END AS link_status
    FROM l LEFT JOIN f ON l.cid = f.cid""",
)
def e11(spark, folder):
    rows = v.listings(spark, folder).select(
        "house_id", F.coalesce((F.col("floor_level") != "F") | (F.col("area_sqm") > 20), F.lit(False)).alias("is_valid"),
        F.when(F.col("decoration_type") != "5-LOW", F.col("community_id")).alias("community_id"),
        F.lit(1).alias("list_page_no"), F.col("house_id").alias("prop_url"), (F.coalesce("bath_count", F.lit(0.0)) > 0).alias("loads"),
    )
    return logs.link_status(rows, F.col("loads")).select("house_id", "link_status")


@query("f1_leaderboard", f"WITH {v.METRIC} SELECT model_name, {n('seed', 'seed')}, {r('mae', 'mae')} FROM v_metric ORDER BY mae, model_name")
def f1(spark, folder):
    return rounded(leaderboards.leaderboard(v.metrics(spark, folder)).select("model_name", "seed", "mae"))


@query("f2_top_layouts", f"{v.LISTING_VALID} SELECT {v.LAYOUT_SQL} AS house_layout, {n('count(*)', 'n')} FROM valid GROUP BY 1 ORDER BY n DESC, house_layout LIMIT 10")
def f2(spark, folder):
    from hearthline.functions.listing import layout_text

    counts = v.valid_listings(spark, folder).groupBy(layout_text().alias("house_layout")).agg(F.count("*").alias("n"))
    return leaderboards.top_rows(counts, "n", 10, "house_layout")


@query("f3_top_disagreement_labels", f"{TABLE2X2} SELECT label, {r('1 - po', 'disagreement')} FROM agr ORDER BY 1 - po DESC, label LIMIT 5")
def f3(spark, folder):
    stats = agreement.label_agreement(label_pairs(spark, folder), PAIR_LABELS, "_rule", "_label")
    return rounded(leaderboards.top_rows(stats, "disagreement", 5, "label").select("label", "disagreement"))


@query(
    "f3_top_regions_per_floor",
    f"WITH {v.LISTING}, c AS (SELECT floor_level, region_slug, count(*) AS k, row_number() OVER (PARTITION BY floor_level ORDER BY count(*) DESC, region_slug) AS rk FROM v_listing GROUP BY 1, 2) SELECT floor_level, region_slug, {n('k', 'n')}, {n('rk', 'position')} FROM c WHERE rk <= 3",
)
def f3_regions(spark, folder):
    counts = v.listings(spark, folder).groupBy("floor_level", "region_slug").agg(F.count("*").alias("n"))
    return rounded(leaderboards.top_per_group(counts, "floor_level", "n", 3, "region_slug"))


@query(
    "f4_blend_members",
    f"WITH {v.METRIC} SELECT model_name, {r('avg(mae)', 'cv_mae_mean')} FROM v_metric WHERE model_name <> 'mean_baseline' GROUP BY 1 ORDER BY avg(mae), model_name LIMIT 3",
)
def f4(spark, folder):
    means = v.metrics(spark, folder).groupBy("model_name").agg(F.avg("mae").alias("cv_mae_mean"))
    return rounded(leaderboards.best_models(means, 3))


@query(
    "f5_top_absolute",
    f"WITH {v.LISTING}, c AS (SELECT region_slug, corr(area_sqm, total_price_wan) AS c FROM v_listing GROUP BY 1) SELECT region_slug, {r('c', 'importance')} FROM c ORDER BY abs(c) DESC, region_slug LIMIT 15",
)
def f5(spark, folder):
    rows = v.listings(spark, folder).groupBy("region_slug").agg(F.corr("area_sqm", "total_price_wan").alias("importance"))
    return rounded(leaderboards.top_rows(rows, "importance", 15, "region_slug", absolute=True))


@query(
    "f6_retry_limit",
    f"""WITH {v.EVENTS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY failure_id ORDER BY failed_at DESC, error_message DESC) AS rn FROM v_log WHERE record_type = 'failure') WHERE rn = 1),
    u AS (SELECT failure_id, arg_max(resolved, retried_at) AS resolved FROM v_log WHERE record_type = 'retry_update' GROUP BY 1)
    SELECT f.failure_id, target_url, strftime(failed_at, '%Y-%m-%d %H:%M:%S') AS failed_at FROM f LEFT JOIN u USING (failure_id) WHERE NOT coalesce(u.resolved, false) ORDER BY f.failed_at, failure_id LIMIT 25""",
)
def f6(spark, folder):
    rows = logs.open_failures(v.event_log(spark, folder), limit=25)
    return rows.select("failure_id", "target_url", F.date_format("failed_at", "yyyy-MM-dd HH:mm:ss").alias("failed_at"))


@query(
    "f7_best_config",
    f"""WITH {v.RULES}, a AS (SELECT source AS config, avg(CASE WHEN n_chars < 2000 THEN 1.0 ELSE 0.0 END) AS ok, avg(quality) AS k FROM v_rules GROUP BY 1)
    SELECT config, {r('ok', 'parse_ok_rate')}, {r('k', 'mean_kappa')} FROM a ORDER BY ok DESC, k DESC, config DESC LIMIT 1""",
)
def f7(spark, folder):
    rows = v.titles(spark, folder).select("source", "n_chars", keyword_labels("text", {"q": v.KEYWORDS["quality"]})["q"].alias("q"))
    rates = rows.groupBy(F.col("source").alias("config")).agg(F.avg((F.col("n_chars") < 2000).cast("int")).alias("parse_ok_rate"), F.avg("q").alias("mean_kappa"))
    best = rates.agg(F.max_by(F.struct("config", "parse_ok_rate", "mean_kappa"), F.struct("parse_ok_rate", "mean_kappa", "config")).alias("b"))
    return rounded(best.select("b.*"))


@query(
    "f8_union_of_profiles",
    f"""WITH {v.LISTING} SELECT 'region' AS kind, region_slug AS value, {n('count(*)', 'n')}, CAST(NULL AS BIGINT) AS rooms FROM v_listing GROUP BY 2
    UNION ALL SELECT 'floor', floor_level, count(*), CAST(sum(room_count) AS BIGINT) FROM v_listing GROUP BY 2""",
)
def f8(spark, folder):
    rows = v.listings(spark, folder)
    regions = rows.groupBy(F.col("region_slug").alias("value")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("region"))
    floors = rows.groupBy(F.col("floor_level").alias("value")).agg(F.count("*").alias("n"), F.sum("room_count").cast("bigint").alias("rooms"))
    return regions.unionByName(floors.withColumn("kind", F.lit("floor")), allowMissingColumns=True)


@query("f9_except_keys", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def f9(spark, folder):
    return table(spark, folder, "documents").select("doc_id").exceptAll(table(spark, folder, "labels").select("doc_id"))


@query("f9_intersect_keys", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def f9_intersect(spark, folder):
    return table(spark, folder, "documents").select("doc_id").intersect(table(spark, folder, "labels").select("doc_id"))


@query("h1_exact_sample", f"SELECT o_orderkey, o_orderstatus FROM orders ORDER BY {hash_sql('o_orderkey', 42)}, o_orderkey LIMIT 200")
def h1(spark, folder):
    return sampling.sample_exact(table(spark, folder, "orders"), "o_orderkey", 200, 42).select("o_orderkey", "o_orderstatus")


@query(
    "h2_random_holdout",
    f"""WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY {hash_sql('o_orderkey', 42)}, o_orderkey) AS pos, count(*) OVER () AS total FROM orders)
    SELECT o_orderkey, CASE WHEN pos > total - greatest(CAST(floor(total * 0.2) AS BIGINT), 1) THEN 'test' ELSE 'train' END AS split FROM p""",
)
def h2(spark, folder):
    return sampling.split_random(table(spark, folder, "orders"), "o_orderkey", 0.2, 42).select("o_orderkey", "split")


def strata_sql(size: int) -> str:
    return f"""WITH s AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, {hash_sql('o_orderkey', 42)} AS h FROM orders),
    q AS (SELECT o_orderstatus, o_orderpriority, count(*) AS c, least(count(*), greatest(1, CAST(round_even(count(*) * {size}.0 / (SELECT count(*) FROM orders), 0) AS BIGINT))) AS quota FROM s GROUP BY 1, 2),
    k AS (SELECT s.*, quota, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY h, o_orderkey) AS rn FROM s JOIN q USING (o_orderstatus, o_orderpriority))"""


@query(
    "h3_stratified_sample",
    f"""{strata_sql(500)}, tot AS (SELECT sum(quota) AS t FROM q), chosen AS (SELECT o_orderkey, {hash_sql('o_orderkey', '42_trim')} AS ht FROM k WHERE rn <= quota),
    trimmed AS (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY ht, o_orderkey) AS z FROM chosen) WHERE z <= 500),
    extra AS (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {hash_sql('o_orderkey', '42_fill')}, o_orderkey) AS z FROM k WHERE rn > quota), tot WHERE z <= 500 - t)
    SELECT o_orderkey FROM trimmed UNION ALL SELECT o_orderkey FROM extra""",
)
def h3(spark, folder):
    return sampling.sample_stratified(table(spark, folder, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"], 500, 42).select("o_orderkey")


@query("h4_stratified_without_top_up", f"{strata_sql(333)} SELECT o_orderkey, o_orderstatus, o_orderpriority FROM k WHERE rn <= quota")
def h4(spark, folder):
    chosen = sampling.sample_stratified(table(spark, folder, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"], 333, 42, top_up=False)
    return chosen.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(
    "h5_sample_with_replacement",
    f"""WITH p AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS position FROM nation), d AS (SELECT {hash_sql('i', 42)} % (SELECT count(*) FROM nation) + 1 AS position FROM range(1, 61) t(i))
    SELECT {n('n_nationkey', 'n_nationkey')}, {n('count(*)', 'draws')} FROM d JOIN p USING (position) GROUP BY 1""",
)
def h5(spark, folder):
    return rounded(sampling.sample_with_replacement(table(spark, folder, "nation"), "n_nationkey", 60, 42).select("n_nationkey", "draws"))


@query("h6_group_folds", f"WITH {v.LISTING} SELECT house_id, {n(hash_sql('community_id', 7) + ' % 3', 'fold')} FROM v_listing")
def h6(spark, folder):
    return rounded(sampling.group_folds(v.listings(spark, folder), "community_id", 3, 7).select("house_id", "fold"))


@query(
    "h6_balanced_group_folds",
    f"""WITH RECURSIVE {v.LISTING}, g AS (SELECT community_id, {n('count(*)', 'k')}, row_number() OVER (ORDER BY count(*) DESC, CAST(community_id AS VARCHAR)) AS pos FROM v_listing GROUP BY 1),
    w AS (SELECT CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, CAST(0 AS BIGINT) AS z, -1 AS fold UNION ALL
      SELECT pos, x + CASE WHEN f = 0 THEN k ELSE 0 END, y + CASE WHEN f = 1 THEN k ELSE 0 END, z + CASE WHEN f = 2 THEN k ELSE 0 END, f
      FROM (SELECT g.pos, k, x, y, z, CASE WHEN x <= y AND x <= z THEN 0 WHEN y <= z THEN 1 ELSE 2 END AS f FROM w JOIN g ON g.pos = w.pos + 1))
    SELECT house_id, {n('fold', 'fold')} FROM v_listing JOIN g USING (community_id) JOIN w USING (pos)""",
)
def h6_balanced(spark, folder):
    return rounded(sampling.balanced_group_folds(v.listings(spark, folder), "community_id", 3).select("house_id", "fold"))


@query("h7_row_folds", f"SELECT o_orderkey, {n(hash_sql('o_orderkey', 11) + ' % 5', 'fold')} FROM orders")
def h7(spark, folder):
    return rounded(sampling.row_folds(table(spark, folder, "orders"), "o_orderkey", 5, 11).select("o_orderkey", "fold"))


DRAWN_SQL = f"""WITH {v.PREDICTION}, k AS (SELECT r AS replicate, {hash_sql('r', '42_a')} % {sampling.PRIME - 1} + 1 AS a, {hash_sql('r', '42_b')} % {sampling.PRIME} AS b FROM range(1, 1001) t(r)),
    x AS (SELECT model_name, absolute_error_wan AS e, {hash_sql('house_id', 42)} % {sampling.PRIME} AS h FROM v_pred),
    u AS (SELECT model_name, replicate, e, (a * h + b) % {sampling.PRIME} AS u FROM x, k),
    w AS (SELECT model_name, replicate, e, {' + '.join(f'(u >= {limit})::INT' for limit in sampling.bootstrap_limits())} AS w FROM u),
    s AS (SELECT model_name, replicate, sum(w) AS weight, sum(w * e) AS total FROM w GROUP BY 1, 2)"""


@query("h8_bootstrap_replicates", f"{DRAWN_SQL} SELECT model_name, {n('replicate', 'replicate')}, {n('weight', 'weight')}, {r('total / weight', 'mean', 4)} FROM s")
def h8_replicates(spark, folder):
    """How many rows each of 1,000 replicates drew for each model, and the mean error of the draw."""
    sums = sampling.bootstrap_sums(v.predictions(spark, folder), "absolute_error_wan", "house_id", ["model_name"])
    return rounded(sums.select("model_name", "replicate", "weight", (F.col("total") / F.col("weight")).alias("mean")), 4)


@query(
    "h8_bootstrap_interval",
    f"""{DRAWN_SQL}, c AS (SELECT model_name, quantile_cont(total / weight, 0.025) AS low, quantile_cont(total / weight, 0.975) AS high FROM s GROUP BY 1)
    SELECT model_name, {r('m', 'mean', 4)}, {r('low', 'ci_low', 4)}, {r('high', 'ci_high', 4)} FROM c JOIN (SELECT model_name, avg(absolute_error_wan) AS m FROM v_pred GROUP BY 1) USING (model_name)""",
)
def h8(spark, folder):
    """Poisson bootstrap of the mean error per model, 1,000 replicates."""
    return rounded(sampling.bootstrap_mean_ci(v.predictions(spark, folder), "absolute_error_wan", "house_id", ["model_name"]), 4)


@query(
    "h9_fixed_holdout_cleaning",
    f"""WITH {v.LISTING}, p AS (SELECT *, row_number() OVER (ORDER BY extracted_at NULLS FIRST, house_id) AS pos, count(*) OVER () AS total FROM v_listing),
    s AS (SELECT *, CASE WHEN pos > total - greatest(CAST(floor(total * 0.2) AS BIGINT), 1) THEN 'test' ELSE 'train' END AS split FROM p)
    SELECT split, {n('count(*)', 'n')} FROM s WHERE split = 'test' OR area_sqm > 0 GROUP BY 1""",
)
def h9(spark, folder):
    split = time_split(v.listings(spark, folder))
    kept = split.filter((F.col("split") == "test") | F.coalesce(F.col("area_sqm") > 0, F.lit(False)))
    return kept.groupBy("split").agg(F.count("*").alias("n"))
