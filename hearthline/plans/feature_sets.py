"""Named feature sets as column lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from hearthline import config

FEATURE_SETS: dict[str, tuple[Sequence[str], Sequence[str]]] = {
    "raw": (config.RAW_NUMERIC, tuple(c for c in config.CATEGORICAL if c != "house_layout")),
    "base": (config.BASE_NUMERIC, config.CATEGORICAL),
    "enhanced": (config.NUMERIC, config.CATEGORICAL),
}

LABEL_SETS = ("none", "rule", "annotated", "rule_annotated")


def label_columns(kind: str) -> list[str]:
    """Columns of a label source; names in both sources carry the suffix _rule on the rule side."""
    annotated = list(config.ANNOTATED_LABELS)
    rules = [f"{c}_rule" if c in annotated else c for c in config.TITLE_KEYWORDS]
    return {"none": [], "rule": rules, "annotated": annotated, "rule_annotated": annotated + rules}[kind]


def numeric_columns(base: Sequence[str], labels: str = "none", log_area: bool = False) -> list[str]:
    """Numeric inputs of a variant; ``log_area`` swaps the area for its logarithm."""
    swapped = ["log_area_sqm" if c == "area_sqm" and log_area else c for c in base]
    return swapped + label_columns(labels)


def project(df: DataFrame, base: Sequence[str], keep: Sequence[str] = (), labels: str = "none", log_area: bool = False) -> DataFrame:
    return df.select(*keep, *[c for c in numeric_columns(base, labels, log_area) if c not in keep])
