"""Experiment grids: each is a list of variants over one prepared table with a fixed holdout."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline import config
from hearthline.functions import listing as fx
from hearthline.operators import cleaning, errors
from hearthline.plans.feature_sets import FEATURE_SETS, LABEL_SETS, label_columns, numeric_columns
from hearthline.plans.oof import fit_members, oof_table
from hearthline.plans.study import Inputs, data_driven_weights, two_stage
from hearthline.plans.zoo import RESIDUAL, Spec

#: Variants that are fitted at the same time.
AT_ONCE = 4


@dataclass(frozen=True)
class Variant:
    """One cell of an experiment; ``keep`` cleans training rows only."""

    name: str
    numeric: Sequence[str]
    categorical: Sequence[str]
    log_target: bool = False
    keep: Callable[[], Column] | None = None
    floor: float | None = None
    residual_stage: bool = False
    residual_settings: Mapping[str, float] | None = None
    prepare: Callable[[DataFrame], DataFrame] | None = None


def run_variant(table: DataFrame, variant: Variant, specs: Sequence[Spec], target: str = config.TARGET) -> DataFrame:
    """Long predictions named variant__member, on the original price scale."""
    ready = variant.prepare(table) if variant.prepare else table
    train, test = ready.filter(F.col("split") == "train"), ready.filter(F.col("split") == "test")
    if variant.keep is not None:
        train = train.filter(variant.keep())
    goal = "_goal"
    make = fx.log_target(target) if variant.log_target else F.col(target)
    train = train.withColumn(goal, make)
    _, (scored,) = fit_members(train, [test], specs, variant.numeric, variant.categorical, goal)
    scored = scored.drop("features")
    names = [s.name for s in specs]
    if variant.residual_stage:
        inputs = Inputs(variant.numeric, variant.categorical, goal)
        folds = sorted(row["fold"] for row in train.select("fold").distinct().collect())
        oof = oof_table(train, specs[:1], variant.numeric, variant.categorical, goal, folds)
        scored = two_stage(train, scored, oof, names[0], inputs, variant.residual_settings or RESIDUAL)
        names = [*names, "two_stage_residual"]

    def restore(column: Column) -> Column:
        if variant.log_target:
            return fx.unlog_target(column, variant.floor)
        return column if variant.floor is None else F.greatest(column, F.lit(variant.floor))

    wide = scored.select("house_id", F.col(target).alias("actual_price_wan"), *[restore(F.col(n)).alias(f"{variant.name}__{n}") for n in names])
    return errors.long_predictions(wide, [f"{variant.name}__{n}" for n in names])


def run_variants(table: DataFrame, variants: Sequence[Variant], specs: Sequence[Spec], target: str = config.TARGET) -> DataFrame:
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return reduce(DataFrame.unionByName, list(pool.map(lambda v: run_variant(table, v, specs, target), variants)))


def feature_set_variants(
    two_stage_too: bool = True, sets: Mapping[str, tuple[Sequence[str], Sequence[str]]] = FEATURE_SETS
) -> list[Variant]:
    return [Variant(name, numeric, categorical, residual_stage=two_stage_too) for name, (numeric, categorical) in sets.items()]


def target_variants(numeric: Sequence[str], categorical: Sequence[str]) -> list[Variant]:
    """Raw target, log target, log target with log area."""
    def with_log(df: DataFrame) -> DataFrame:
        return df.withColumn("log_area_sqm", fx.log_target("area_sqm"))

    return [
        Variant("raw_target", numeric, categorical),
        Variant("log_target", numeric, categorical, log_target=True, floor=1.0),
        Variant("log_target_log_area", numeric_columns(numeric, log_area=True), categorical, log_target=True, floor=1.0, prepare=with_log),
    ]


def flag_training_noise(table: DataFrame, group: str = "region_slug") -> DataFrame:
    """Noise flags from training rows; test rows carry no flag, so cleaning never touches them."""
    train = cleaning.noise_flags(table.filter(F.col("split") == "train"), group).drop("unit_price")
    flags = [c for c in train.columns if c not in table.columns]
    test = table.filter(F.col("split") != "train").withColumns({c: F.lit(False) for c in flags})
    return train.unionByName(test)


def cleaning_variants(numeric: Sequence[str], categorical: Sequence[str]) -> list[Variant]:
    return [Variant(f"clean_{name}", numeric, categorical, keep=lambda n=name: cleaning.cleaning_strategies()[n]) for name in ("none", "strict", "moderate", "unit_only", "total_only")]


def log_by_clean_variants(numeric: Sequence[str], categorical: Sequence[str]) -> list[Variant]:
    def strict() -> Column:
        return cleaning.cleaning_strategies()["strict"]

    return [
        Variant("baseline", numeric, categorical),
        Variant("log_only", numeric, categorical, log_target=True, floor=1.0),
        Variant("clean_only", numeric, categorical, keep=strict),
        Variant("combined", numeric, categorical, log_target=True, floor=1.0, keep=strict),
    ]


def polynomial_variants(numeric: Sequence[str], categorical: Sequence[str], core: Sequence[str] = config.POLYNOMIAL_CORE) -> list[Variant]:
    products = fx.pairwise_products(core)

    def expand(df: DataFrame) -> DataFrame:
        return df.withColumns(products)

    return [
        Variant("original", numeric, categorical),
        Variant("poly_enhanced", [*numeric, *products], categorical, prepare=expand),
        Variant("poly_only", list(products), categorical, prepare=expand),
    ]


def label_variants(
    numeric: Sequence[str], categorical: Sequence[str], sources: Mapping[str, Sequence[str]] | None = None
) -> list[Variant]:
    """Target x cleaning x label source, twelve cells."""
    def strict() -> Column:
        return cleaning.cleaning_strategies()["strict"]

    sources = sources if sources is not None else {name: label_columns(name) for name in LABEL_SETS}
    cells = []
    for prefix, log, keep in (("", False, None), ("combined_", True, strict), ("log_", True, None)):
        for source, columns in sources.items():
            name = f"{prefix}{source if source != 'none' else 'original'}"
            cells.append(Variant(name, [*numeric, *columns], categorical, log_target=log, floor=1.0, keep=keep))
    return cells


def title_variants(numeric: Sequence[str], categorical: Sequence[str], labels: Sequence[str]) -> list[Variant]:
    return [
        Variant("original", numeric, categorical),
        Variant("title_enhanced", [*numeric, *labels], categorical),
        Variant("title_only", list(labels), []),
    ]


def sensitivity_variants(
    numeric: Sequence[str], categorical: Sequence[str], types: Sequence[str], weights: Mapping[str, Mapping[str, float] | None]
) -> list[Variant]:
    """Index weights and balance constructs; a weight set of None drops the index."""
    def with_index(chosen: Mapping[str, float]) -> Callable[[DataFrame], DataFrame]:
        return lambda df: df.withColumn("accessibility_index", fx.accessibility_index(chosen))

    def with_balance(name: str) -> Callable[[DataFrame], DataFrame]:
        return lambda df: df.withColumn("poi_balance_score", fx.BALANCE_BUILDERS[name](types))

    index_columns = ("accessibility_index", "region_accessibility_interaction")
    cells = []
    for name, chosen in weights.items():
        if chosen is None:
            cells.append(Variant(f"index_{name}", [c for c in numeric if c not in index_columns], categorical))
        else:
            cells.append(Variant(f"index_{name}", numeric, categorical, prepare=with_index(chosen)))
    return cells + [Variant(f"balance_{name}", numeric, categorical, prepare=with_balance(name)) for name in fx.BALANCE_BUILDERS]


def weight_sets(train: DataFrame, types: Sequence[str], expert: Mapping[str, float]) -> dict[str, Mapping[str, float] | None]:
    return {"expert": expert, "equal": {t: 1.0 for t in types}, "data_driven": data_driven_weights(train, types), "none": None}
