"""Deduplication, validity, trimming, feature building and audit of listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline import config
from hearthline.functions import listing as fx
from hearthline.operators.ranking import exact_quantiles, null_safe_join, quantile_bounds
from hearthline.session import materialise


def keep_one(df: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (null keys count as one key).

    Spark applies the rank limit before the shuffle, so a hot key sends one row per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") == 1).drop("_rn")


def content_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(c) for c, kind in df.dtypes if not kind.startswith("map")])


def keep_first(df: DataFrame, key: str | Sequence[str], time: str) -> DataFrame:
    """Earliest record wins, ties by content."""
    return keep_one(df, key, [F.col(time).asc_nulls_last(), content_hash(df).asc()])


def keep_last(df: DataFrame, key: str | Sequence[str], sequence: str) -> DataFrame:
    """Latest load wins, ties by content."""
    return keep_one(df, key, [F.col(sequence).desc_nulls_last(), content_hash(df).desc()])


def coerce_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({name: fx.to_number(name) for name in columns if name in df.columns})


def is_usable(
    positive: Sequence[str] = ("total_price_wan", "area_sqm"),
    present: Sequence[str] = ("region_slug", "room_count", "hall_count", "bath_count"),
) -> Column:
    checks = [F.coalesce(F.col(name) > 0, F.lit(False)) for name in positive] + [F.col(name).isNotNull() for name in present]
    return reduce(lambda a, b: a & b, checks)


TRIM_PROBS = {"low": 0.01, "high": 0.99}


def trim_bounds(valid: DataFrame, columns: Sequence[str] = ("total_price_wan", "area_sqm")) -> dict[str, dict[str, float]]:
    return quantile_bounds(valid, columns, TRIM_PROBS)


def within_bounds(bounds: Mapping[str, Mapping[str, float]]) -> Column:
    """Both ends belong to the range; the literals can be pushed into the scan."""
    return reduce(lambda a, b: a & b, [F.col(c).between(F.lit(b["low"]), F.lit(b["high"])) for c, b in bounds.items()])


def join_community(listings: DataFrame, communities: DataFrame, key: str = "community_id", marker: str = "has_community") -> DataFrame:
    """Left join in which a null key meets the null-key community; ``marker`` tells whether a row matched.

    The strategy is left to adaptive execution: the community side grows with the data.
    """
    marked = communities.withColumn(marker, F.lit(True))
    joined = null_safe_join(listings, marked, [key], "left")
    return joined.withColumn(marker, F.coalesce(F.col(marker), F.lit(False)))


def clean_listings(listings: DataFrame, communities: DataFrame) -> DataFrame:
    """Dedupe, coerce, validate, trim, join."""
    numeric = ["total_price_wan", "area_sqm", "room_count", "hall_count", "bath_count", "total_floors"]
    houses = coerce_numbers(keep_first(listings, "house_id", "extracted_at"), numeric)
    valid = materialise(houses.filter(is_usable()))
    trimmed = valid.filter(within_bounds(trim_bounds(valid)))
    return join_community(trimmed, community_counts(keep_first(communities, "community_id", "extracted_at")))


def community_counts(communities: DataFrame, types: Sequence[str] = config.POI_TYPES) -> DataFrame:
    """Facility counts with missing or non-numeric values as 0; carries only the key and the counts."""
    return communities.select(
        "community_id", *[F.coalesce(fx.to_number(fx.poi_column(t)), F.lit(0.0)).alias(fx.poi_column(t)) for t in types]
    )


def audit(
    raw: DataFrame, deduplicated: DataFrame, bounds: Mapping[str, Mapping[str, float]], communities: DataFrame,
    key: str = "house_id", required: Sequence[str] = ("total_price_wan", "area_sqm", "region_slug", "room_count", "hall_count", "bath_count"), raw_communities: DataFrame | None = None,
) -> DataFrame:
    """One row: counts, rates, missing shares and bounds, from one pass over the flagged listings. ``communities`` may be given
    with repeats; ``raw_communities`` is that table before anything was dropped."""
    flagged = join_community(deduplicated, communities.select("community_id").distinct())
    flagged = flagged.withColumn("_valid", is_usable())
    flagged = flagged.withColumn("_kept", F.col("_valid") & F.coalesce(within_bounds(bounds), F.lit(False)))
    missing = [F.avg(F.col(c).isNull().cast("int")).alias(f"missing_{c}") for c in required]
    summary = flagged.agg(
        F.count("*").alias("deduplicated_house_count"),
        F.count_if("_kept").alias("usable_house_count"),
        F.count_if(~F.col("_valid")).alias("removed_invalid_count"),
        F.count_if(F.col("_valid") & ~F.col("_kept")).alias("removed_outlier_count"),
        F.avg(F.when(F.col("_kept"), F.col("has_community").cast("int"))).alias("community_join_rate"),
        F.avg(F.col("_valid").cast("int")).alias("key_field_usable_rate"),
        *missing,
    )
    limits = [F.lit(b[side]).alias(f"{c}_{side}") for c, b in bounds.items() for side in ("low", "high")]
    raw_count = raw.agg(F.count("*").alias("n")).scalar()
    before = (communities if raw_communities is None else raw_communities).agg(F.count("*").alias("n")).scalar()
    after = communities.select("community_id").distinct().agg(F.count("*").alias("n")).scalar()
    return summary.select(raw_count.alias("raw_house_count"), before.alias("raw_community_count"), after.alias("deduplicated_community_count"), "*", *limits)


def missing_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, missing_rate; an absent column counts as wholly missing."""
    rates = [
        F.avg(F.col(c).isNull().cast("int")) if c in df.columns else F.lit(1.0) for c in columns
    ]
    wide = df.agg(*[rate.alias(f"m{i}") for i, rate in enumerate(rates)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing_rate")) for i, c in enumerate(columns)])
    return wide.select(F.explode(pairs).alias("p")).select("p.*")


def build_features(df: DataFrame) -> DataFrame:
    """The 38-column feature contract; the two group-relative columns start from whole-table medians."""
    counts = {fx.poi_column(t): F.coalesce(fx.to_number(fx.poi_column(t)), F.lit(0.0)) for t in config.POI_TYPES}
    base = coerce_numbers(df, config.RAW_NUMERIC).withColumns(counts).withColumns(
        {
            "extracted_at": F.col("extracted_at").cast("string").try_cast("timestamp_ntz"),
            "house_layout": fx.layout_text(),
            "floor_level_score": fx.floor_score(),
            "house_certificate_years": fx.certificate_years(),
            "has_elevator": fx.flag_text("has_elevator"),
            "is_unique_housing": fx.flag_text("is_unique_housing"),
        }
    )
    scored = base.withColumns(
        {
            "floor_ratio_proxy": F.col("floor_level_score"),
            "poi_total_count": fx.poi_total(),
            "accessibility_index": fx.accessibility_index(),
            "poi_balance_score": fx.balance_entropy(),
            **fx.ratio_features(),
        }
    )
    scored = scored.withColumns({"area_layout_efficiency": F.lit(None).cast("double"), "region_accessibility_interaction": F.lit(None).cast("double")})
    return scored.withColumns(fx.fill_roles(config.NUMERIC, config.CATEGORICAL)).select(*config.FEATURE_COLUMNS)


def group_medians(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    return exact_quantiles(df, value, {name: 0.5}, by=[group]).drop("n_values")


def with_fallback_reference(df: DataFrame, reference: DataFrame, key: str, name: str, fallback: float, floor: float) -> DataFrame:
    """Looks ``name`` up by ``key``; unseen keys take the fallback; the result is clipped from below."""
    joined = null_safe_join(df, reference, [key], "left")
    return joined.withColumn(name, F.greatest(F.coalesce(F.col(name), F.lit(fallback)), F.lit(floor)))


def apply_reference_medians(
    df: DataFrame, train: DataFrame, region_medians: DataFrame | None = None
) -> DataFrame:
    """Group-relative features from training listings and an external region table (region_slug, region_median)."""
    with ThreadPoolExecutor(2) as pool:  # passes over the same rows that do not wait for each other
        layout = pool.submit(group_medians, train, "house_layout", "area_sqm", "layout_median")
        if region_medians is None:
            found = pool.submit(group_medians, train, "region_slug", "accessibility_index", "region_median")
            overall = quantile_bounds(train, ["area_sqm", "accessibility_index"], {"m": 0.5})
            region_medians, region_fallback = found.result(), overall["accessibility_index"]["m"]
        else:
            found = pool.submit(quantile_bounds, region_medians, ["region_median"], {"m": 0.5})
            overall = quantile_bounds(train, ["area_sqm"], {"m": 0.5})
            region_fallback = found.result()["region_median"]["m"]
        layout = layout.result()
    layout_global = overall["area_sqm"]["m"]
    out = with_fallback_reference(df, layout, "house_layout", "layout_median", layout_global, 1.0)
    out = with_fallback_reference(out, region_medians, "region_slug", "region_median", region_fallback, 1e-6)
    return out.withColumns(
        {
            "area_layout_efficiency": F.col("area_sqm") / F.col("layout_median"),
            "region_accessibility_interaction": F.col("accessibility_index") / F.col("region_median"),
        }
    ).drop("layout_median", "region_median")


NOISE_GROUP_PROBS = {"unit_low": 0.01, "unit_high": 0.99}
NOISE_GLOBAL_PROBS = {**NOISE_GROUP_PROBS, "low": 0.005, "high": 0.995}


def noise_flags(df: DataFrame, group: str, price: str = "total_price_wan", area: str = "area_sqm", min_group: int = 10) -> DataFrame:
    """Adds unit_outlier, total_outlier, area_outlier, strict_noise and moderate_noise.

    Reads ``df`` several times for bounds, two columns at a time: pass a written table.
    """
    priced = df.withColumn("unit_price", F.col(price) / F.greatest(F.col(area), F.lit(1e-6)))
    per_group = exact_quantiles(priced, "unit_price", NOISE_GROUP_PROBS, by=[group])
    bounds = quantile_bounds(priced, ["unit_price", price, area], NOISE_GLOBAL_PROBS)
    overall = bounds["unit_price"]
    joined = null_safe_join(priced, per_group, [group], "left")
    big = F.coalesce(F.col("n_values") >= min_group, F.lit(False)) & F.col(group).isNotNull()
    low = F.when(big, F.col("unit_low")).otherwise(F.lit(overall["unit_low"]))
    high = F.when(big, F.col("unit_high")).otherwise(F.lit(overall["unit_high"]))

    def outside(column: Column, lower: Column, upper: Column) -> Column:
        return F.coalesce((column < lower) | (column > upper), F.lit(False))

    flagged = joined.withColumns(
        {
            "unit_outlier": outside(F.col("unit_price"), low, high),
            "total_outlier": outside(F.col(price), F.lit(bounds[price]["low"]), F.lit(bounds[price]["high"])),
            "area_outlier": outside(F.col(area), F.lit(bounds[area]["low"]), F.lit(bounds[area]["high"])),
        }
    )
    return flagged.withColumns(
        {
            "strict_noise": F.col("unit_outlier") | F.col("total_outlier") | F.col("area_outlier"),
            "moderate_noise": F.col("unit_outlier") & F.col("total_outlier"),
        }
    ).drop("n_values", "unit_low", "unit_high")




def cleaning_strategies() -> dict[str, Column]:
    """Strategy name -> keep predicate over the noise flags."""
    return {
        "none": F.lit(True),
        "strict": ~F.col("strict_noise"),
        "moderate": ~F.col("moderate_noise"),
        "unit_only": ~F.col("unit_outlier"),
        "total_only": ~F.col("total_outlier"),
    }


def strategy_summary(flagged: DataFrame) -> DataFrame:
    """strategy, total, removed, removed_rate in one pass."""
    strategies = cleaning_strategies()
    wide = flagged.agg(F.count("*").alias("total"), *[F.count_if(~keep).alias(name) for name, keep in strategies.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(n).alias("removed")) for n in strategies])
    return wide.select("total", F.explode(pairs).alias("p")).select(
        "p.strategy", "total", "p.removed", (F.col("p.removed") / F.col("total")).alias("removed_rate")
    )


def strategy_rows(flagged: DataFrame, key: str = "house_id") -> DataFrame:
    """Long table key, strategy, keep."""
    pairs = F.array(*[F.struct(F.lit(n).alias("strategy"), keep.alias("keep")) for n, keep in cleaning_strategies().items()])
    return flagged.select(key, F.explode(pairs).alias("p")).select(key, "p.strategy", "p.keep")


def with_quantile_bins(df: DataFrame, names: Mapping[str, str], bins: int = 4) -> DataFrame:
    """Adds a bin number per column (column -> new name); all edges come from one pair of passes."""
    probs = {f"e{i}": i / bins for i in range(bins + 1)}
    edges = quantile_bounds(df, list(names), probs)
    return df.withColumns(
        {name: fx.right_closed_bin(F.col(column), [F.lit(edges[column][f"e{i}"]) for i in range(bins + 1)]) for column, name in names.items()}
    )
