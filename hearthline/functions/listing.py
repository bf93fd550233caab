"""Listing features as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline import config


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda left, right: left + right, columns)


def to_number(name: str) -> Column:
    """Unparseable values become null."""
    return F.col(name).try_cast("double")


def to_local_timestamp(name: str) -> Column:
    """Zone-less ISO text to a zone-less timestamp; unparseable text becomes null."""
    return F.col(name).try_cast("timestamp_ntz")


def at_least(column: Column, floor: float) -> Column:
    """Lower clip that keeps null as null (greatest() would skip it)."""
    return F.when(column.isNotNull(), F.greatest(column, F.lit(float(floor))))


def fill_roles(numeric: Sequence[str], categorical: Sequence[str]) -> dict[str, Column]:
    """Numbers fall back to 0 and categories to 'unknown'; booleans read True/False."""
    filled = {name: F.coalesce(to_number(name), F.lit(0.0)) for name in numeric}
    filled |= {name: F.coalesce(F.col(name).cast("string"), F.lit("unknown")) for name in categorical}
    return filled


def flag_text(name: str) -> Column:
    return F.initcap(F.col(name).cast("string"))


def layout_text(room: str = "room_count", hall: str = "hall_count", bath: str = "bath_count") -> Column:
    def whole(name: str) -> Column:
        return F.coalesce(to_number(name), F.lit(0.0)).cast("int").cast("string")

    return F.concat(whole(room), F.lit("室"), whole(hall), F.lit("厅"), whole(bath), F.lit("卫"))


def layout_code(layout: str = "house_layout") -> Column:
    """3室2厅1卫 becomes 3R2H1B."""
    return F.regexp_replace(layout, r"(\d+)室(\d+)厅(\d+)卫", "$1R$2H$3B")


def relabel(column: str, mapping: Mapping[str, str]) -> Column:
    """Small fixed category map; unmapped values stay as they are."""
    pairs = [F.lit(text) for item in mapping.items() for text in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(column)), F.col(column))


def floor_score(
    column: str = "floor_level",
    scores: Sequence[tuple[str, float]] = config.FLOOR_SCORES,
    default: float = config.FLOOR_DEFAULT,
) -> Column:
    """First token found wins, in the given order."""
    chain = F
    for token, score in scores:
        chain = chain.when(F.col(column).contains(token), F.lit(score))
    return chain.otherwise(F.lit(default))


def certificate_years(column: str = "house_certificate_years") -> Column:
    text = F.trim(F.col(column).cast("string"))
    token = F.regexp_extract(text, config.CERTIFICATE_PATTERN, 1)
    digits = F.create_map(*[F.lit(x) for pair in config.CN_DIGITS.items() for x in pair])
    years = (
        F.when(token.rlike("^[0-9]+$"), token.try_cast("int"))
        .when(F.length(token) == 1, F.element_at(digits, token))
        .when(token.startswith("十"), F.lit(10) + F.element_at(digits, F.substring(token, 2, 1)))
    )
    accepted = years.isin(2, 5) | (text.endswith("年") & years.between(1, 70))
    return F.when(F.coalesce(accepted, F.lit(False)), years.cast("double")).otherwise(F.lit(0.0))


def poi_column(poi: str) -> str:
    return f"poi_{poi}_count"


def poi_total(types: Sequence[str] = config.POI_TYPES) -> Column:
    return total([F.col(poi_column(poi)) for poi in types])


def accessibility_index(weights: Mapping[str, float] = config.POI_WEIGHTS) -> Column:
    return total([F.log1p(F.coalesce(to_number(poi_column(poi)), F.lit(0.0))) * F.lit(float(w)) for poi, w in weights.items()])


def _shares(types: Sequence[str]) -> list[Column]:
    size = F.greatest(poi_total(types), F.lit(1.0))
    return [F.col(poi_column(poi)) / size for poi in types]


def balance_entropy(types: Sequence[str] = config.POI_TYPES) -> Column:
    terms = [F.when(share > 0, -share * F.ln(share)).otherwise(F.lit(0.0)) for share in _shares(types)]
    return total(terms) / F.lit(math.log(len(types)))


def balance_herfindahl(types: Sequence[str] = config.POI_TYPES) -> Column:
    """One minus concentration, scaled so that even shares give 1; no facility at all gives 0."""
    k = len(types)
    concentration = total([share * share for share in _shares(types)])
    score = (F.lit(1.0) - concentration) / F.lit(1.0 - 1.0 / k)
    return F.when(poi_total(types) > 0, score).otherwise(F.lit(0.0))


def balance_gini(types: Sequence[str] = config.POI_TYPES) -> Column:
    """One minus the Gini coefficient of the facility shares; no facility at all gives 0."""
    k = len(types)
    ordered = F.array_sort(F.array(*_shares(types)))
    weighted = F.aggregate(
        F.zip_with(ordered, F.sequence(F.lit(1), F.lit(k)), lambda share, rank: share * (2 * rank - k - 1)),
        F.lit(0.0),
        lambda acc, item: acc + item,
    )
    share_sum = total(_shares(types))
    return F.when(poi_total(types) > 0, F.lit(1.0) - weighted / (F.lit(k) * share_sum)).otherwise(F.lit(0.0))


BALANCE_BUILDERS = {"entropy": balance_entropy, "gini": balance_gini, "herfindahl": balance_herfindahl}


def ratio_features() -> dict[str, Column]:
    """Features that need only the row itself."""
    room, hall, bath, area = (F.col(name) for name in ("room_count", "hall_count", "bath_count", "area_sqm"))
    return {
        "area_per_room": area / at_least(room, 1),
        "layout_density": (room + hall + bath) / at_least(area, 1),
        "transit_medical_ratio": (F.col("poi_bus_count") + 2.0 * F.col("poi_subway_count")) / (F.col("poi_hospital_count") + 1.0),
        "education_commerce_ratio": F.col("poi_school_count") / (F.col("poi_restaurant_count") + F.col("poi_shop_count") + 1.0),
        "room_area_interaction": room * (area / at_least(room, 1)),
        "bath_room_ratio": bath / at_least(room, 1),
        "floor_area_interaction": F.col("floor_level_score") * F.log1p(area),
    }


def log_target(column: str) -> Column:
    return F.log1p(F.greatest(F.col(column), F.lit(1e-6)))


def unlog_target(column: Column, floor: float | None = 1.0) -> Column:
    restored = F.expm1(column)
    return restored if floor is None else F.greatest(restored, F.lit(floor))


def pairwise_products(columns: Sequence[str] = config.POLYNOMIAL_CORE) -> dict[str, Column]:
    return {f"poly__{a}_x_{b}": F.col(a) * F.col(b) for a, b in combinations(columns, 2)}


def price_band(column: str, bands: Sequence[tuple[float, float | None, str]] = config.PRICE_BANDS) -> Column:
    """Left-closed bands; null and out-of-range values get no band."""
    value = F.col(column)
    chain = F
    for low, high, name in bands:
        inside = value >= low if high is None else (value >= low) & (value < high)
        chain = chain.when(inside, F.lit(name))
    return chain.otherwise(F.lit(None).cast("string"))


def right_closed_bin(value: Column, edges: Sequence[Column]) -> Column:
    """Bin number of a value for ascending edges; the lowest edge belongs to bin 1, duplicate edges collapse."""
    chain = F.when(value.isNull() | (value < edges[0]) | (value > edges[-1]), F.lit(None).cast("int"))
    for i in range(1, len(edges)):
        distinct_edges = [F.when(edges[j] > edges[j - 1], 1).otherwise(0) for j in range(1, i + 1)]
        chain = chain.when(value <= edges[i], F.greatest(total(distinct_edges), F.lit(1)).cast("int"))
    return chain
