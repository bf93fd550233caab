"""Column builders, one case per semantic trap."""

import math

import pytest
from pyspark.sql import functions as F

from hearthline import config
from hearthline.functions import labels as lx
from hearthline.functions import listing as fx
from hearthline.functions import pages as px


def values(spark, ddl, rows, column):
    return [row["x"] for row in spark.createDataFrame(rows, ddl).coalesce(1).select(column.alias("x")).collect()]


def test_certificate_years(spark):
    texts = ["满二", "满2年", "满五", "满五年", "满24", "满十年", "满十五年", "5", None, " 满两年 ", "", "abc", "满71年", "满70年", "满二十"]
    want = [2.0, 2.0, 5.0, 5.0, 0.0, 10.0, 15.0, 5.0, 0.0, 2.0, 0.0, 0.0, 0.0, 70.0, 0.0]
    assert values(spark, "t string", [(t,) for t in texts], fx.certificate_years("t")) == want


def test_floor_score_takes_first_token_in_order(spark):
    texts = ["低层", "中高层", "高层", "顶层", None, "高低层"]
    assert values(spark, "t string", [(t,) for t in texts], fx.floor_score("t")) == [0.2, 0.5, 0.8, 0.5, 0.5, 0.2]


def test_lower_clip_keeps_null(spark):
    assert values(spark, "v double", [(None,), (0.0,), (3.0,)], fx.at_least(F.col("v"), 1)) == [None, 1.0, 3.0]


def test_coercion(spark):
    assert values(spark, "v string", [("1.5",), ("x",), (None,), ("",)], fx.to_number("v")) == [1.5, None, None, None]
    got = values(spark, "v string", [("2026-01-02T03:04:05",), ("bad",)], fx.to_local_timestamp("v"))
    assert str(got[0]) == "2026-01-02 03:04:05" and got[1] is None


def test_role_filling_and_flags(spark):
    df = spark.createDataFrame([(None, None, True), ("2", "a", None)], "n string, c string, b boolean")
    rows = df.withColumn("b", fx.flag_text("b")).withColumns(fx.fill_roles(["n"], ["c", "b"])).orderBy("n").collect()
    assert [tuple(r) for r in rows] == [(0.0, "unknown", "True"), (2.0, "a", "unknown")]


def test_balance_scores(spark):
    ddl = ", ".join(f"{fx.poi_column(t)} double" for t in config.POI_TYPES)
    rows = [tuple([0.0] * 7), tuple([1.0] * 7), (5.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    entropy = values(spark, ddl, rows, fx.balance_entropy())
    assert entropy[0] == 0.0 and math.copysign(1, entropy[0]) == 1.0
    assert entropy[1] == pytest.approx(1.0) and entropy[2] == 0.0
    assert values(spark, ddl, rows, fx.balance_herfindahl()) == pytest.approx([0.0, 1.0, 0.0])
    assert values(spark, ddl, rows, fx.balance_gini()) == pytest.approx([0.0, 1.0, 1 / 7])


def test_accessibility_index(spark):
    ddl = ", ".join(f"{fx.poi_column(t)} double" for t in config.POI_TYPES)
    counts = (3.0, 10.0, 1.0, 4.0, 20.0, 8.0, 2.0)
    want = sum(w * math.log1p(n) for w, n in zip(config.POI_WEIGHTS.values(), counts))
    assert values(spark, ddl, [counts], fx.accessibility_index()) == pytest.approx([want])


def test_price_bands_are_left_closed(spark):
    got = values(spark, "p double", [(0.0,), (60.0,), (99.9,), (150.0,), (-1.0,), (None,)], fx.price_band("p"))
    assert got == ["[0,60)", "[60,100)", "[60,100)", "[150,inf)", None, None]


def test_bins_are_right_closed_and_drop_duplicate_edges(spark):
    edges = [F.lit(e) for e in (1.0, 1.0, 2.0, 3.0, 5.0)]
    got = values(spark, "v double", [(1.0,), (2.0,), (2.5,), (5.0,), (6.0,), (None,)], fx.right_closed_bin(F.col("v"), edges))
    assert got == [1, 1, 2, 3, None, None]


def test_log_and_products(spark):
    got = values(spark, "p double", [(0.0,), (99.0,)], fx.log_target("p"))
    assert got == pytest.approx([math.log1p(1e-6), math.log(100.0)])
    assert values(spark, "p double", [(0.0,)], fx.unlog_target(F.lit(-5.0))) == [1.0]
    assert len(fx.pairwise_products()) == 15 and "poly__area_sqm_x_room_count" in fx.pairwise_products()


def test_layout_text_and_code(spark):
    ddl = "room_count double, hall_count double, bath_count double"
    assert values(spark, ddl, [(3.0, 2.0, None)], fx.layout_text()) == ["3室2厅0卫"]
    assert values(spark, "house_layout string", [("3室2厅1卫",)], fx.layout_code()) == ["3R2H1B"]
    assert values(spark, "c string", [("a",), ("z",)], fx.relabel("c", {"a": "b"})) == ["b", "z"]


def test_keyword_labels_are_case_sensitive(spark):
    rows = [("复式 loft 近地铁",), ("LOFT",), (None,), ("",)]
    assert values(spark, "t string", rows, lx.keyword_labels("t")["duplex"]) == [1, 0, 0, 0]
    assert values(spark, "t string", rows, lx.keyword_labels("t")["subway"]) == [1, 0, 0, 0]
    assert len(config.TITLE_KEYWORDS) == 29 and len(config.ANNOTATED_LABELS) == 28


def test_answer_parsing(spark):
    raws = ['```json\n{"a": 1}\n```', '\n\n{"a": 0}', 'Sure: {"a": "0", "b": true} ok', "[1, 2]", '{"a": 1', '{"a": "1"}', "", None, '{"b": 2}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").withColumn("p", lx.parsed_object(F.col("raw")))
    rows = df.orderBy("i").select(lx.parse_ok(F.col("p")).alias("ok"), lx.answer_value(F.col("p"), "a").alias("a"), lx.answer_value(F.col("p"), "b").alias("b")).collect()
    assert [r["ok"] for r in rows] == [True, True, True, False, False, True, False, False, True]
    assert [r["a"] for r in rows] == [1, 0, 0, None, None, 1, None, None, 0]
    assert [r["b"] for r in rows] == [0, 0, 1, None, None, 0, None, None, 1]


def test_response_content_prefers_error(spark):
    good = '{"custom_id":"1","error":null,"response":{"body":{"choices":[{"message":{"content":"{\\"a\\":1}"}}]}}}'
    bad = '{"custom_id":"2","error":"timeout","response":{"body":{"choices":[{"message":{"content":"x"}}]}}}'
    assert values(spark, "l string", [(good,), (bad,)], lx.response_content(F.col("l"))) == ['{"a":1}', None]


LISTING_PAGE = """<html><head><title> 阳光城 三房_南昌二手房 </title><script>var x = "无电梯";</script></head><body>
<a class="c" href="/community/view/8812?from=x"> <b>阳光城</b> 小区 </a> 总价 128.5 万
<div class="maininfo-model-item maininfo-model-item-1"><div class="maininfo-model-strong">3室 2厅 1卫</div>
<div class="maininfo-model-weak">高层(共33层)</div></div>
<div class="maininfo-model-item maininfo-model-item-2"><div class="maininfo-model-strong">89.6㎡</div> <div class="maininfo-model-weak">精装修</div></div>
<div class="maininfo-model-item maininfo-model-item-3"><div class="maininfo-model-strong">南北</div> <div class="maininfo-model-weak">2015年</div></div>
<p>满五年 非唯一 有电梯</p></body></html>"""


def test_listing_page(spark):
    url = "https://nc.example.com/prop/view/A100?x=1"
    df = spark.createDataFrame([(url, LISTING_PAGE), ("https://nc.example.com/prop/view/B2", "<html><body>empty</body></html>")], "url string, html string")
    full, empty = df.select(*[c.alias(k) for k, c in px.listing_attributes().items()]).orderBy("house_id").collect()
    assert (full["house_id"], full["title"], full["total_price_wan"], full["area_sqm"]) == ("A100", "阳光城 三房", 128.5, 89.6)
    assert (full["room_count"], full["hall_count"], full["bath_count"]) == (3, 2, 1)
    assert (full["floor_level"], full["total_floors"], full["decoration_type"], full["orientation"]) == ("高层", 33, "精装修", "南北")
    assert (full["house_certificate_years"], full["is_unique_housing"], full["has_elevator"]) == ("满五年", False, True)
    assert (full["community_url"], full["community_id"], full["community_name"]) == ("https://nc.example.com/community/view/8812?from=x", "8812", "阳光城 小区")
    assert empty["house_id"] == "B2" and all(empty[c] is None for c in ("title", "total_price_wan", "room_count", "has_elevator", "community_id"))


def test_missing_fields_message(spark):
    df = spark.createDataFrame([("t", 1.0, None), (" ", None, "x")], "title string, price double, name string").withColumn("m", px.missing_fields(["title", "price", "name"]))
    rows = df.select("m", px.missing_message(F.col("m")).alias("e")).collect()
    assert [(r["m"], r["e"]) for r in rows] == [(["name"], "必填字段缺失(name)"), (["title", "price"], "必填字段缺失(title,price)")]


def test_page_links_keep_order_and_drop_repeats(spark):
    html = "<a href='/prop/view/2?a=1&amp;b=2'></a><a href=\"/prop/view/1\"></a><a href='/prop/view/2?a=1&amp;b=2'></a><a href='/other'></a>"
    assert values(spark, "h string", [(html,)], px.page_links(F.col("h"))) == [["/prop/view/2?a=1&b=2", "/prop/view/1"]]


def test_urls(spark):
    base = F.lit("https://a.example.com/x/y.html?q=1")
    rows = [("/p",), ("z",), ("https://b.example.com/",), ("//c.example.com/d",)]
    assert values(spark, "l string", rows, px.absolute_url(base, F.col("l"))) == [
        "https://a.example.com/p", "https://a.example.com/x/z", "https://b.example.com/", "https://c.example.com/d",
    ]
    assert values(spark, "u string", [("https://a/b?c#d",)], px.bare_url(F.col("u"))) == ["https://a/b"]


def test_text_helpers(spark):
    assert values(spark, "h string", [("<p>a&amp;lt;b</p><style>x{}</style>  c",)], px.compact_text(F.col("h"))) == [" a&lt;b c"]
    assert values(spark, "d string", [("500米",), ("1.2 公里",), ("近",)], px.distance_metres(F.col("d"))) == [500.0, 1200.0, None]
    assert values(spark, "t string", [("市第一小学",), ("医科大学",), ("银行",)], px.school_sub_type(F.col("t"))) == ["小学", "高等院校", None]
    assert values(spark, "h string", [("<title>_x</title>",), ("<p>",)], px.community_title(F.col("h"), F.lit("7"))) == ["community_7", "community_7"]


def test_lineage_covers_the_built_features(spark):
    from hearthline.functions.lineage import lineage_table

    rows = {r["name"]: r for r in lineage_table(spark).collect()}
    assert set(config.DERIVED_NUMERIC) <= set(rows) and {r["stage"] for r in rows.values()} == {"base", "derived"}
    assert rows["area_per_room"]["sources"] == ["area_sqm", "room_count"] and not any(r["depends_on_target"] for r in rows.values())
    assert set(rows["transit_medical_ratio"]["sources"]) == {"poi_bus_count", "poi_subway_count", "poi_hospital_count"}
    assert config.TARGET not in " ".join(r["formula"] for r in rows.values())
