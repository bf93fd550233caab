"""Page reading with built-in regular expressions. Most suit engines with RE2 too; the main-item pattern repeats more often
than RE2 allows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline import config

# Entities and patterns that results depend on.
ENTITIES = {
    "&nbsp;": " ",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&middot;": "·",
    "&copy;": "©",
    "&amp;": "&",
}
PRICE_PATTERN = r"(\d+(?:\.\d+)?)\s*万"
AREA_PATTERN = r"(\d+(?:\.\d+)?)\s*(?:㎡|平米|平方米)"
LAYOUT_PATTERN = r"(\d+)\s*室\s*(\d+)\s*厅\s*(\d+)\s*卫"
FLOOR_PATTERN = r"([低中高][楼层]{0,2}|底层|顶层)\s*[（(]\s*共\s*(\d+)\s*层\s*[)）]"
CERTIFICATE_TEXT_PATTERN = r"(满[二三四五六七八九十\d]+(?:年)?)"
DISTANCE_PATTERN = r"(\d+(?:\.\d+)?)\s*(米|公里)"
COMMUNITY_LINK_PATTERN = r"""(?is)<a[^>]+href=["']([^"']*/community/view/[^"']*)["'][^>]*>(.*?)</a>"""
LISTING_LINK_PATTERN = r"""href=["']([^"']*/prop/view/[^"']*)["']"""
ITEM_PATTERN = r"(?is)<li[^>]*>(.*?)</li>"


def unescape(text: Column) -> Column:
    """Ampersand last, so that '&amp;lt;' stays '&lt;'."""
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]+>", " ")


def compact_text(html: Column) -> Column:
    body = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    body = F.regexp_replace(body, r"(?is)<style.*?</style>", " ")
    return F.regexp_replace(unescape(strip_tags(body)), r"\s+", " ")


def group(text: Column, pattern: str, index: int = 1) -> Column:
    """A capture group, null when the pattern does not match."""
    found = F.regexp_extract(text, pattern, index)
    return F.when(F.length(found) > 0, found)


def page_title(html: Column) -> Column:
    """Title text up to the first underscore."""
    raw = squeeze(F.regexp_extract(html, r"(?is)<title>\s*(.*?)\s*</title>", 1))
    return F.when(F.length(raw) > 0, F.trim(F.split_part(raw, F.lit("_"), F.lit(1))))


def community_title(html: Column, community_id: Column) -> Column:
    title = page_title(html)
    return F.when(F.length(title) > 0, title).otherwise(F.concat(F.lit("community_"), community_id))


def url_id(url: Column, kind: str) -> Column:
    """Id segment after /prop/view/ or /community/view/."""
    return group(url, f"/{kind}/view/([^/?#]+)")


def bare_url(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_extract(url, r"^([^?#]*)", 1)


def absolute_url(base: Column, link: Column) -> Column:
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)", 1)
    return (
        F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(F.when(F.length(folder) > 0, folder).otherwise(F.concat(root, F.lit("/"))), link))
    )


def page_links(html: Column, pattern: str = LISTING_LINK_PATTERN) -> Column:
    """Links in page order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda link: unescape(link)))


def _main_item(html: Column, number: int, part: int) -> Column:
    pattern = (
        f'(?is)maininfo-model-item-{number}"?[^>]*>.{{0,1800}}?maininfo-model-strong[^>]*>(.*?)</div>\\s*'
        '<div[^>]*class="[^"]*maininfo-model-weak[^"]*"[^>]*>(.*?)</div>'
    )
    text = F.trim(compact_text(F.regexp_extract(html, pattern, part)))
    return F.when(F.length(text) > 0, text)


def _tri_state(text: Column, no: Sequence[str], yes: Sequence[str]) -> Column:
    chain = F
    for phrase in no:
        chain = chain.when(text.contains(phrase), F.lit(False))
    for phrase in yes:
        chain = chain.when(text.contains(phrase), F.lit(True))
    return chain.otherwise(F.lit(None).cast("boolean"))


def listing_attributes(url: str = "url", html: str = "html") -> dict[str, Column]:
    """All fields that a listing page yields; a field the page lacks is null."""
    page, link = F.col(html), F.col(url)
    text = compact_text(page)
    layout_source = F.coalesce(_main_item(page, 1, 1), page)
    floor_source = F.coalesce(_main_item(page, 1, 2), text)
    community_link = unescape(group(page, COMMUNITY_LINK_PATTERN, 1))
    community_url = absolute_url(link, community_link)
    community_name = squeeze(F.regexp_replace(F.regexp_extract(page, COMMUNITY_LINK_PATTERN, 2), r"<[^>]+>", ""))
    return {
        "house_id": url_id(link, "prop"),
        "title": page_title(page),
        "total_price_wan": group(page, PRICE_PATTERN).try_cast("double"),
        "area_sqm": group(F.coalesce(_main_item(page, 2, 1), text), AREA_PATTERN).try_cast("double"),
        "room_count": group(layout_source, LAYOUT_PATTERN, 1).try_cast("int"),
        "hall_count": group(layout_source, LAYOUT_PATTERN, 2).try_cast("int"),
        "bath_count": group(layout_source, LAYOUT_PATTERN, 3).try_cast("int"),
        "decoration_type": _main_item(page, 2, 2),
        "floor_level": group(floor_source, FLOOR_PATTERN, 1),
        "total_floors": group(floor_source, FLOOR_PATTERN, 2).try_cast("int"),
        "orientation": _main_item(page, 3, 1),
        "house_certificate_years": group(text, CERTIFICATE_TEXT_PATTERN),
        "is_unique_housing": _tri_state(text, ("非唯一", "不唯一"), ("唯一",)),
        "has_elevator": _tri_state(text, ("无电梯", "电梯:无", "电梯：无"), ("有电梯", "电梯:有", "电梯：有")),
        "community_url": community_url,
        "community_id": url_id(community_url, "community"),
        "community_name": F.when(F.length(community_name) > 0, community_name),
    }


def missing_fields(fields: Sequence[str] = config.REQUIRED_LISTING_FIELDS) -> Column:
    """Names of required fields that are null or blank, in the given order."""
    checks = [F.when(F.col(name).isNull() | (F.trim(F.col(name).cast("string")) == ""), F.lit(name)) for name in fields]
    return F.array_compact(F.array(*checks))


def missing_message(missing: Column) -> Column:
    return F.when(F.size(missing) > 0, F.concat(F.lit("必填字段缺失("), F.concat_ws(",", missing), F.lit(")")))


def facility_type(item: Column, text: Column, keywords: Mapping[str, str] = config.POI_KEYWORDS) -> Column:
    """First category, in fixed order, whose keyword occurs."""
    source = F.concat_ws(" ", item, text)
    chain = F
    for poi, word in keywords.items():
        chain = chain.when(source.contains(word), F.lit(poi))
    return chain.otherwise(F.lit("unknown"))


def facility_name(item: Column, text: Column) -> Column:
    by_title = F.trim(unescape(group(item, r"""(?i)title=["']([^"']+)["']""")))
    anchor = squeeze(unescape(strip_tags(F.regexp_extract(item, r"(?is)<a[^>]*>(.*?)</a>", 1))))
    by_text = group(text, r"([一-龥A-Za-z0-9（）()·-]{2,40})")
    return F.coalesce(by_title, F.when(F.length(anchor) > 0, anchor), by_text)


def facility_distance(item: Column, text: Column) -> Column:
    found = group(F.concat_ws(" ", item, text), r"(\d+(?:\.\d+)?\s*(?:米|公里))")
    return F.replace(found, F.lit(" "), F.lit(""))


def facility_coordinate(item: Column) -> Column:
    text = F.trim(unescape(group(item, r"""(?i)data-address=["']([^"']+)["']""")))
    return F.when(text.contains(","), text)


def facility_sub_type(text: Column) -> Column:
    return group(text, "(" + "|".join(config.POI_SUB_TYPES) + ")")


def school_sub_type(text: Column) -> Column:
    return (
        F.when(text.contains("幼儿园"), "幼儿园")
        .when(text.contains("小学"), "小学")
        .when(text.contains("中学"), "中学")
        .when(text.contains("大学") | text.contains("学院") | text.contains("高等"), "高等院校")
    )


def distance_metres(text: Column) -> Column:
    value = F.regexp_extract(text, DISTANCE_PATTERN, 1).try_cast("double")
    unit = F.regexp_extract(text, DISTANCE_PATTERN, 2)
    return F.when(unit == "公里", value * 1000.0).when(unit == "米", value)
