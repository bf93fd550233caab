"""Scalar features, labels and page reading (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.functions import labels as lx
from hearthline.functions import listing as fx
from hearthline.functions import pages as px
from hearthline.operators import quality
from hearthline.registered import views as v
from hearthline.registered.base import n, query, r, rounded, table

BASE_SQL = v.LISTING_FEATURES


@query("g1_keyword_labels", f"WITH {v.RULES} SELECT doc_id, {', '.join(v.KEYWORDS)} FROM v_rules")
def g1(spark, folder):
    return rounded(v.titles(spark, folder).select("doc_id", *[c.alias(k) for k, c in lx.keyword_labels("text", v.KEYWORDS).items()]))


@query(
    "g2_layout_text",
    f"WITH {v.LISTING} SELECT house_id, concat(CAST(coalesce(room_count, 0) AS INT), '室', CAST(coalesce(hall_count, 0) AS INT), '厅', CAST(coalesce(bath_count, 0) AS INT), '卫') AS house_layout FROM v_listing",
)
def g2(spark, folder):
    return v.listings(spark, folder).select("house_id", fx.layout_text().alias("house_layout"))


FLOOR_TEXT = "CASE l_linestatus WHEN 'O' THEN concat('中高层', l_linenumber) WHEN 'F' THEN concat(l_returnflag, '低层') END"


@query(
    "g3_floor_score",
    f"SELECT l_linestatus, l_returnflag, {n('l_linenumber', 'l_linenumber')}, {n('count(*)', 'n')}, {r('avg(CASE l_linestatus WHEN chr(79) THEN 0.5 WHEN chr(70) THEN 0.2 ELSE 0.5 END)', 'floor_level_score')} FROM lineitem GROUP BY 1, 2, 3",
)
def g3(spark, folder):
    text = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("中高层"), "l_linenumber")).when(F.col("l_linestatus") == "F", F.concat("l_returnflag", F.lit("低层")))
    rows = table(spark, folder, "lineitem").withColumn("floor_level", text).withColumn("score", fx.floor_score())
    return rounded(rows.groupBy("l_linestatus", "l_returnflag", "l_linenumber").agg(F.count("*").alias("n"), F.avg("score").alias("floor_level_score")))


@query(
    "g4_certificate_years",
    f"""WITH t AS (SELECT CASE l_returnflag WHEN 'A' THEN concat('满', CAST(l_quantity AS INT), '年') WHEN 'N' THEN concat('满', l_linenumber) ELSE concat(' ', CAST(l_quantity AS INT) * 3, '年 ') END AS certificate FROM lineitem),
    y AS (SELECT certificate, TRY_CAST(regexp_extract(trim(certificate), '^满?([0-9]+)年?$', 1) AS INT) AS y FROM t)
    SELECT certificate, {n('count(*)', 'n')}, {r("max(CASE WHEN y IN (2, 5) OR (trim(certificate) LIKE '%年' AND y BETWEEN 1 AND 70) THEN y ELSE 0 END)", 'years')} FROM y GROUP BY 1""",
)
def g4(spark, folder):
    quantity = F.col("l_quantity").cast("int")
    text = (
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("满"), quantity, F.lit("年")))
        .when(F.col("l_returnflag") == "N", F.concat(F.lit("满"), "l_linenumber"))
        .otherwise(F.concat(F.lit(" "), quantity * 3, F.lit("年 ")))
    )
    counts = table(spark, folder, "lineitem").groupBy(text.alias("certificate")).agg(F.count("*").alias("n"))
    return rounded(counts.withColumn("years", fx.certificate_years("certificate")))


@query(
    "g5_url_parts",
    """WITH u AS (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) AS bare, regexp_extract(html, 'href="([^"]*)"', 1) AS link FROM pages)
    SELECT page_id, bare AS bare_url, CASE WHEN regexp_extract(url, '/en/([^/?#]+)', 1) <> '' THEN regexp_extract(url, '/en/([^/?#]+)', 1) END AS page_key,
      CASE WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN link WHEN starts_with(link, '/') THEN concat(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), link)
        ELSE concat(regexp_extract(url, '^([a-z]+://[^?#]*/)', 1), link) END AS first_link FROM u""",
)
def g5(spark, folder):
    pages = table(spark, folder, "pages")
    link = F.regexp_extract("html", r'href="([^"]*)"', 1)
    return pages.select(
        "page_id", px.bare_url(F.col("url")).alias("bare_url"), px.group(F.col("url"), "/en/([^/?#]+)").alias("page_key"),
        px.absolute_url(F.col("url"), link).alias("first_link"),
    )


@query(
    "g6_price_bands",
    f"WITH {v.LISTING} SELECT house_id, CASE WHEN total_price_wan >= 150 THEN '[150,inf)' WHEN total_price_wan >= 100 THEN '[100,150)' WHEN total_price_wan >= 60 THEN '[60,100)' WHEN total_price_wan >= 0 THEN '[0,60)' END AS band FROM v_listing",
)
def g6(spark, folder):
    return v.listings(spark, folder).select("house_id", fx.price_band("total_price_wan").alias("band"))


EQUAL = {t: 1.0 for t in v.TYPES}


@query(
    "g7_accessibility_index",
    f"WITH {v.COMMUNITY} SELECT community_id, {r(v.ACCESS_SQL, 'expert_index')}, {r(' + '.join(f'ln(1 + {c})' for c in v.COUNTS), 'equal_index')} FROM v_community",
)
def g7(spark, folder):
    rows = v.communities(spark, folder)
    return rounded(rows.select("community_id", fx.accessibility_index(v.WEIGHTS).alias("expert_index"), fx.accessibility_index(EQUAL).alias("equal_index")))


K = len(v.TYPES)


@query(
    "g8_balance_scores",
    f"""WITH {v.COMMUNITY}, s AS (SELECT community_id, {v.TOTAL_SQL} AS total, {v.ENTROPY_SQL} AS entropy, list_sort([{', '.join(v.share_sql(c) for c in v.COUNTS)}]) AS p FROM v_community)
    SELECT community_id, {r('entropy', 'entropy')}, {r(f'CASE WHEN total > 0 THEN (1 - list_sum(list_transform(p, lambda x: x * x))) / (1 - 1.0 / {K}) ELSE 0 END', 'herfindahl')},
      {r('CASE WHEN total > 0 THEN 1 - (' + ' + '.join(f'p[{i}] * {2 * i - K - 1}' for i in range(1, K + 1)) + f') / ({K} * list_sum(p)) ELSE 0 END', 'gini')} FROM s""",
)
def g8(spark, folder):
    return rounded(v.communities(spark, folder).select("community_id", *[build(v.TYPES).alias(name) for name, build in fx.BALANCE_BUILDERS.items()]))


@query(
    "g9_ratio_features",
    f"""{BASE_SQL} SELECT house_id, {r('area_sqm / greatest(room_count, 1)', 'area_per_room')}, {r('(room_count + hall_count + bath_count) / greatest(area_sqm, 1)', 'layout_density')},
    {r('(poi_large_count + 2 * poi_medium_count) / (poi_standard_count + 1)', 'transit_medical_ratio')}, {r('poi_promo_count / (poi_small_count + poi_economy_count + 1)', 'education_commerce_ratio')},
    {r('room_count * (area_sqm / greatest(room_count, 1))', 'room_area_interaction')}, {r('bath_count / greatest(room_count, 1)', 'bath_room_ratio')}, {r('floor_level_score * ln(1 + area_sqm)', 'floor_area_interaction')} FROM feat""",
)
def g9(spark, folder):
    roles = {"poi_bus_count": "poi_large_count", "poi_subway_count": "poi_medium_count", "poi_hospital_count": "poi_standard_count",
             "poi_school_count": "poi_promo_count", "poi_restaurant_count": "poi_small_count", "poi_shop_count": "poi_economy_count"}
    rows = v.features(spark, folder).withColumnsRenamed({old: new for new, old in roles.items()})
    return rounded(rows.select("house_id", *[c.alias(k) for k, c in fx.ratio_features().items()]))


@query(
    "g10_target_transforms",
    f"WITH {v.LISTING} SELECT house_id, {r('ln(1 + greatest(total_price_wan, 1e-6))', 'log_price')}, {r('greatest(exp(ln(1 + greatest(total_price_wan, 1e-6))) - 1, 100.0)', 'restored')} FROM v_listing",
)
def g10(spark, folder):
    rows = v.listings(spark, folder).withColumn("log_price", fx.log_target("total_price_wan"))
    return rounded(rows.select("house_id", "log_price", fx.unlog_target(F.col("log_price"), 100.0).alias("restored")))


POLY = ("area_sqm", "accessibility_index", "poi_balance_score", "room_count")


@query(
    "g11_pairwise_products",
    f"{BASE_SQL} SELECT house_id, {', '.join(r(f'{a} * {b}', f'poly__{a}_x_{b}') for i, a in enumerate(POLY) for b in POLY[i + 1:])} FROM feat",
)
def g11(spark, folder):
    return rounded(v.features(spark, folder).select("house_id", *[c.alias(k) for k, c in fx.pairwise_products(POLY).items()]))


# Answers made from the event properties: a fence, prose around the object, a cut-off object, an array.
def answers(spark, folder):
    props = F.col("props")
    raw = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), props, F.lit("\n```")))
        .when(F.col("event_type") == "view", F.concat(F.lit("Here it is: "), props, F.lit(" done")))
        .when(F.col("event_type") == "error", F.expr("left(props, length(props) - 1)"))
        .when(F.col("event_type") == "signup", F.lit("[1, 2]"))
        .otherwise(props)
    )
    return table(spark, folder, "events").select("event_id", "event_type", raw.alias("raw"))


@query(
    "g12_answer_parsing",
    """WITH a AS (SELECT event_id, event_type NOT IN ('error', 'signup') AS parse_ok, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
    SELECT event_id, parse_ok, CAST(CASE WHEN parse_ok THEN CASE WHEN k <> 0 THEN 1 ELSE 0 END END AS BIGINT) AS k_label, CAST(CASE WHEN parse_ok THEN 0 END AS BIGINT) AS absent_label FROM a""",
)
def g12(spark, folder):
    rows = answers(spark, folder).withColumn("parsed", lx.parsed_object(F.col("raw")))
    return rounded(
        rows.select(
            "event_id", lx.parse_ok(F.col("parsed")).alias("parse_ok"), lx.answer_value(F.col("parsed"), "k").alias("k_label"),
            lx.answer_value(F.col("parsed"), "absent").alias("absent_label"),
        )
    )


@query(
    "g13_response_paths",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS VARCHAR) END AS k FROM events""",
)
def g13(spark, folder):
    message = F.struct(F.lit("assistant").alias("role"), F.col("props").alias("content"))
    body = F.struct(F.array(F.struct(message.alias("message"))).alias("choices"))
    line = F.to_json(
        F.struct(
            F.col("event_id").alias("custom_id"), F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"),
            F.struct(body.alias("body")).alias("response"),
        )
    )
    rows = table(spark, folder, "events").select("event_id", line.alias("line"))
    content = lx.response_content(F.col("line"))
    return rows.select("event_id", F.get_json_object(content, "$.k").alias("k"))


ENTITY_SQL = "replace(replace(replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"
STRIP_SQL = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
COMPACT_SQL = f"regexp_replace({ENTITY_SQL.format(STRIP_SQL)}, '\\s+', ' ', 'g')"


@query("g14_page_text", f"SELECT page_id, {COMPACT_SQL} AS page_text FROM pages")
def g14(spark, folder):
    return table(spark, folder, "pages").select("page_id", px.compact_text(F.col("html")).alias("page_text"))


@query(
    "g15_page_title",
    "SELECT page_id, trim(split_part(trim(regexp_replace(regexp_extract(html, '(?is)<title>\\s*(.*?)\\s*</title>', 1), '\\s+', ' ', 'g')), '_', 1)) AS title FROM pages",
)
def g15(spark, folder):
    return table(spark, folder, "pages").select("page_id", px.page_title(F.col("html")).alias("title"))


@query("g16_listing_attributes")
def g16(spark, folder):
    """Every listing field read from every page; the driver pages are not listing pages, so most fields are null."""
    pages = table(spark, folder, "pages")
    return pages.select("page_id", *[c.alias(k) for k, c in px.listing_attributes().items()])


@query(
    "g17_community_link",
    """SELECT page_id, CASE WHEN regexp_extract(html, '(?is)<a[^>]+href="([^"]*)"[^>]*>(.*?)</a>', 1) <> '' THEN regexp_extract(html, '(?is)<a[^>]+href="([^"]*)"[^>]*>(.*?)</a>', 1) END AS link,
      trim(regexp_replace(regexp_extract(html, '(?is)<a[^>]+href="([^"]*)"[^>]*>(.*?)</a>', 2), '<[^>]+>', '', 'g')) AS name FROM pages""",
)
def g17(spark, folder):
    """Link and name of the first anchor; the community form of the pattern is tested on listing pages."""
    anchor = r'(?is)<a[^>]+href="([^"]*)"[^>]*>(.*?)</a>'
    html = F.col("html")
    name = px.squeeze(F.regexp_replace(F.regexp_extract(html, anchor, 2), r"<[^>]+>", ""))
    return table(spark, folder, "pages").select("page_id", px.group(html, anchor, 1).alias("link"), name.alias("name"))


@query(
    "g18_page_links",
    f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS raw, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS i FROM pages),
    f AS (SELECT page_id, {ENTITY_SQL.format('raw')} AS link, min(i) AS i FROM l GROUP BY 1, 2)
    SELECT page_id, link, {n('row_number() OVER (PARTITION BY page_id ORDER BY i) - 1', 'link_no')} FROM f""",
)
def g18(spark, folder):
    links = px.page_links(F.col("html"), r'href="([^"]*)"')
    return rounded(table(spark, folder, "pages").select("page_id", F.posexplode(links).alias("link_no", "link")))


# Words of the driver pages in the role of facility keywords.
PAGE_KEYWORDS = {"bank": "the", "bus": "le", "school": "der", "shop": "el"}


@query(
    "g19_facility_rows",
    f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1)) AS item, generate_subscripts(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1), 1) - 1 AS i FROM pages),
    t AS (SELECT *, trim(regexp_replace({ENTITY_SQL.format("regexp_replace(item, '<[^>]+>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS txt FROM l),
    c AS (SELECT *, CASE WHEN contains(concat(item, ' ', txt), 'the') THEN 'bank' WHEN contains(concat(item, ' ', txt), 'le') THEN 'bus' WHEN contains(concat(item, ' ', txt), 'der') THEN 'school' WHEN contains(concat(item, ' ', txt), 'el') THEN 'shop' END AS type FROM t WHERE txt <> '')
    SELECT page_id, {n('i', 'item_no')}, type, txt AS name FROM c WHERE type IS NOT NULL""",
)
def g19(spark, folder):
    pages = table(spark, folder, "pages")
    items = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(px.ITEM_PATTERN), F.lit(1))).alias("item_no", "item"))
    texts = items.withColumn("text", px.squeeze(px.unescape(px.strip_tags(F.col("item"))))).filter(F.length("text") > 0)
    typed = texts.select("page_id", "item_no", px.facility_type(F.col("item"), F.col("text"), PAGE_KEYWORDS).alias("type"), px.facility_name(F.col("item"), F.col("text")).alias("name"))
    return rounded(typed.filter(F.col("type") != "unknown"))


@query(
    "g20_distinct_facilities",
    f"""SELECT {n('l_suppkey', 'community_id')}, lower(p_type) AS type, p_name AS name, concat(p_size, '米') AS distance, {n('min(l_partkey)', 'item_no')}
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name NOT IN ('red widget', 'small ring') GROUP BY 1, 2, 3, 4""",
)
def g20(spark, folder):
    parts = table(spark, folder, "part")
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.select(
        F.col("l_suppkey").alias("community_id"), F.lower("p_type").alias("type"), F.col("p_name").alias("name"), F.concat("p_size", F.lit("米")).alias("distance"),
        F.col("l_partkey").alias("item_no"), F.lit(None).cast("string").alias("coordinate"), F.lit(None).cast("string").alias("sub_type"),
    )
    return quality.distinct_facilities(rows, noise=("red widget", "small ring")).select("community_id", "type", "name", "distance", "item_no")


@query(
    "g21_relabelling",
    f"WITH {v.LISTING} SELECT CASE floor_level WHEN 'F' THEN 'low' WHEN 'O' THEN 'middle' ELSE floor_level END AS floor_level, concat(CAST(coalesce(room_count, 0) AS INT), 'R', CAST(coalesce(hall_count, 0) AS INT), 'H', CAST(coalesce(bath_count, 0) AS INT), 'B') AS layout_code, {n('count(*)', 'n')} FROM v_listing GROUP BY 1, 2",
)
def g21(spark, folder):
    rows = v.listings(spark, folder).withColumn("house_layout", fx.layout_text())
    return rows.groupBy(fx.relabel("floor_level", {"F": "low", "O": "middle"}).alias("floor_level"), fx.layout_code().alias("layout_code")).agg(F.count("*").alias("n"))


@query("g22_row_label_counts", f"WITH {v.RULES} SELECT doc_id, {n(' + '.join(v.KEYWORDS), 'positives')}, {n('CAST(' + ' + '.join(v.KEYWORDS) + ' > 0 AS INT)', 'any_label')} FROM v_rules")
def g22(spark, folder):
    rows = v.titles(spark, folder).select("doc_id", *[c.alias(k) for k, c in lx.keyword_labels("text", v.KEYWORDS).items()])
    return rounded(rows.select("doc_id", lx.positive_count(list(v.KEYWORDS)).alias("positives"), lx.any_positive(list(v.KEYWORDS)).alias("any_label")))


@query("g23_distance_metres", f"SELECT p_partkey, {r('CASE WHEN p_size > 25 THEN p_retailprice * 1000.0 ELSE p_retailprice END', 'metres')} FROM part")
def g23(spark, folder):
    parts = table(spark, folder, "part")
    text = F.concat(F.format_string("%.2f", "p_retailprice"), F.when(F.col("p_size") > 25, " 公里").otherwise("米"))
    return rounded(parts.select("p_partkey", px.distance_metres(text).alias("metres")))
