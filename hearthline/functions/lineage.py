"""Feature registry: one place that builds the derived columns and describes them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline import config
from hearthline.functions import listing as fx


@dataclass(frozen=True)
class Feature:
    """A derived column with the raw fields it reads; ``stage`` is base, derived or label."""

    name: str
    column: Column
    sources: tuple[str, ...]
    stage: str
    depends_on_target: bool = False


def _sources(column: Column) -> tuple[str, ...]:
    """Input names that occur in the expression text, in the order of the known columns."""
    known = [*config.RAW_NUMERIC, "floor_level", "house_certificate_years", "title", *[fx.poi_column(t) for t in config.POI_TYPES], "floor_level_score", "area_per_room"]
    words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", str(column)))
    return tuple(name for name in known if name in words)


def feature_registry() -> list[Feature]:
    base = {
        "house_layout": fx.layout_text(), "floor_level_score": fx.floor_score(), "house_certificate_years": fx.certificate_years(),
        "poi_total_count": fx.poi_total(), "accessibility_index": fx.accessibility_index(),
    }
    ratios = fx.ratio_features()
    base |= {name: ratios[name] for name in ("area_per_room", "layout_density")}
    derived = {"poi_balance_score": fx.balance_entropy(), **{k: c for k, c in ratios.items() if k not in base}}
    made = [Feature(name, column, _sources(column), "base") for name, column in base.items()]
    made += [Feature(name, column, _sources(column), "derived") for name, column in derived.items()]
    # The two group-relative features divide by reference medians that a lookup join supplies.
    relative = {
        "area_layout_efficiency": (F.col("area_sqm") / F.col("layout_median"), ("area_sqm", "house_layout")),
        "region_accessibility_interaction": (F.col("accessibility_index") / F.col("region_median"), ("accessibility_index", "region_slug")),
    }
    return made + [Feature(name, column, sources, "derived") for name, (column, sources) in relative.items()]


def lineage_table(spark: SparkSession) -> DataFrame:
    """name, formula, sources, stage, depends_on_target."""
    rows = [(f.name, re.sub(r"^Column<'(.*)'>$", r"\1", str(f.column)), list(f.sources), f.stage, f.depends_on_target) for f in feature_registry()]
    return spark.createDataFrame(rows, "name string, formula string, sources array<string>, stage string, depends_on_target boolean")
