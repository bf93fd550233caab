"""The main study: clean, join, features, split, members, ensembles, metrics."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline import config
from hearthline.functions import listing as fx
from hearthline.functions.hashing import hash_key
from hearthline.operators import cleaning, errors, leaderboards, sampling
from hearthline.operators.ranking import positions
from hearthline.plans import ensembles, trees
from hearthline.plans.oof import beside, cross_validation, fit_members, oof_table
from hearthline.plans.zoo import GROWN_KINDS, RESIDUAL, Fitted, Spec, grow, model_zoo
from hearthline.session import materialise

#: Fits or folds of a nested validation that are worked on at the same time.
AT_ONCE = 8


@dataclass(frozen=True)
class Inputs:
    """Columns of a study."""

    numeric: Sequence[str] = config.NUMERIC
    categorical: Sequence[str] = config.CATEGORICAL
    target: str = config.TARGET
    key: str = "house_id"
    group: str = "community_id"


def prepare(
    listings: DataFrame, communities: DataFrame, settings: config.StudyConfig, region_medians: DataFrame | None = None
) -> DataFrame:
    """Feature table with split and fold columns, written once and reused by every experiment."""
    features = cleaning.build_features(cleaning.clean_listings(listings, communities))
    if settings.sample_limit is not None:
        features = sampling.sample_exact(features, "house_id", settings.sample_limit, settings.seed)
    return split_and_reference(features, settings, region_medians)


def split_and_reference(features: DataFrame, settings: config.StudyConfig, region_medians: DataFrame | None = None) -> DataFrame:
    fixed = materialise(features)
    if settings.split_mode == "time":
        order_id = "house_id" if dict(fixed.dtypes)["house_id"] in ("bigint", "int") else None
        if order_id is None:
            placed = positions(fixed.select("house_id", "extracted_at"), ["extracted_at", "house_id"])
            n = placed.count()
            last = n - sampling.holdout_size(n, settings.test_size)
            split = placed.select("house_id", F.when(F.col("position") <= last, "train").otherwise("test").alias("split"))
            fixed = fixed.join(split, "house_id")
        else:
            fixed = sampling.split_by_time(fixed, F.unix_micros(F.col("extracted_at").cast("timestamp")), order_id, settings.test_size)
    else:
        fixed = sampling.split_random(fixed, "house_id", settings.test_size, settings.seed)
    train = fixed.filter(F.col("split") == "train")
    adjusted = cleaning.apply_reference_medians(fixed, train, region_medians)
    return materialise(sampling.cv_folds(adjusted, "house_id", "community_id", settings.folds, settings.seed))


@dataclass
class Study:
    """Results of one run; all tables are DataFrames."""

    oof: DataFrame
    cv: DataFrame
    test: DataFrame
    members: list[str]
    models: list[str]
    combiner: ensembles.Combiner

    def predictions(self) -> DataFrame:
        return errors.long_predictions(self.test, self.models)

    def metrics(self) -> DataFrame:
        return errors.regression_metrics(self.predictions()).join(self.cv, "model_name", "left")


def residual_rows(train: DataFrame, oof: DataFrame, first: str, inputs: Inputs) -> DataFrame:
    """Training rows with the out-of-fold residual of a member."""
    return train.join(oof.select(inputs.key, (F.col("actual") - F.col(first)).alias("_residual")), inputs.key)


def two_stage(
    train: DataFrame, test: DataFrame, oof: DataFrame, first: str, inputs: Inputs, settings: Mapping[str, float] = RESIDUAL, seed: int = 42, second: Spec | None = None
) -> DataFrame:
    """Residual model on the out-of-fold residuals of the best member; test gains two_stage_residual."""
    spec = second or Spec("residual", "boosted", {**settings, "seed": seed})
    rows = residual_rows(train, oof, first, inputs)
    _, (staged,) = fit_members(rows, [test], [Spec("_stage2", spec.kind, spec.settings)], inputs.numeric, inputs.categorical, "_residual", inputs.key)
    return staged.withColumn("two_stage_residual", F.col(first) + F.col("_stage2")).drop("_stage2", "features")


def nested_two_stage_cv(
    train: DataFrame, spec: Spec, inputs: Inputs, folds: Sequence[int], settings: Mapping[str, float] = RESIDUAL, seed: int = 42
) -> DataFrame:
    """Held-out two-stage predictions: inside each outer fold the first stage is itself out of fold.

    A member without folds a and b scores b inside outer fold a, and a inside outer fold b, so it is fitted once for both; such
    fits are made at the same time. Then all outer folds follow beside each other: the first stage on the whole of an outer
    fold's rows is fitted while its residual trees are grown. First stages of trees are grown together, for all outer and
    inner fits.
    """
    pairs = [tuple(sorted((o, i))) for o in folds for i in folds if o < i]
    models: trees.Models = {}
    if spec.kind in GROWN_KINDS:
        models = grow([spec], train, inputs.target, inputs.numeric, inputs.categorical, [*[(o,) for o in folds], *pairs], "fold", inputs.key)

    def first_stage(*without: int) -> DataFrame:
        """Rows of the given folds, scored by the member that is fitted on the rows of the others."""
        rest, held = (reduce(DataFrame.filter, tests, train) for tests in ([F.col("fold") != f for f in without], [F.col("fold").isin(*without)]))
        if models:
            return trees.scored(held, [(spec.name, models[spec.name, without])])
        _, (scored,) = fit_members(rest, [held], [spec], inputs.numeric, inputs.categorical, inputs.target, inputs.key)
        return scored.drop("features")

    def inner_rows(pair: tuple[int, ...]) -> DataFrame:
        return materialise(first_stage(*pair).select(inputs.key, "fold", F.col(inputs.target).alias("actual"), spec.name))

    def staged(outer: int) -> DataFrame:
        inner_oof = reduce(DataFrame.unionByName, [waiting[tuple(sorted((outer, i)))].result().filter(F.col("fold") == i) for i in folds if i != outer])
        rows = residual_rows(train.filter(F.col("fold") != outer), inner_oof, spec.name, inputs)
        residual = Spec("_stage2", "boosted", {**settings, "seed": seed})
        second, scored = beside(lambda: grow([residual], rows, "_residual", inputs.numeric, inputs.categorical, key=inputs.key), lambda: first_stage(outer))
        both = trees.scored(scored, [("_stage2", second["_stage2", ()])]).withColumn("two_stage_residual", F.col(spec.name) + F.col("_stage2"))
        return materialise(both.select(inputs.key, "fold", F.col(inputs.target).alias("actual"), "two_stage_residual"))

    with ThreadPoolExecutor(AT_ONCE) as pool:
        waiting = {pair: pool.submit(inner_rows, pair) for pair in pairs}  # first in line: outer folds wait for them
        parts = list(pool.map(staged, folds))
    return reduce(DataFrame.unionByName, parts)


def run_study(
    table: DataFrame, settings: config.StudyConfig, inputs: Inputs = Inputs(), specs: Sequence[Spec] | None = None,
    stack_members: Sequence[str] | None = None, residual: Mapping[str, float] = RESIDUAL,
) -> Study:
    """Members, stacking, blend of the three best, and the two-stage model, from one out-of-fold table."""
    zoo = model_zoo(settings.seed)
    specs = list(specs) if specs is not None else [s for s in zoo.values() if s.name != "median_boosting"]
    names = [s.name for s in specs]
    linear = ("mean_baseline", "ridge", "lasso")
    stack_members = list(stack_members) if stack_members is not None else [n for n in names if n not in linear]
    train, test = table.filter(F.col("split") == "train"), table.filter(F.col("split") == "test")
    folds = sorted(row["fold"] for row in train.select("fold").distinct().collect())

    def on_test() -> DataFrame:
        _, (scored,) = fit_members(train, [test], specs, inputs.numeric, inputs.categorical, inputs.target)
        return materialise(scored.drop("features").withColumn("actual_price_wan", F.col(inputs.target)))

    oof, scored = beside(lambda: oof_table(train, specs, inputs.numeric, inputs.categorical, inputs.target, folds), on_test)
    cv = cross_validation(oof, names)
    ranked = [row["model_name"] for row in leaderboards.best_models(cv, 3).collect()]
    combiner = ensembles.ridge(ensembles.moments(oof, stack_members), 1.0)
    combined = scored.withColumns({"stacking_ridge": combiner.column(), "blend_top3": ensembles.row_mean(ranked)})
    full = two_stage(train, combined, oof, ranked[0], inputs, residual, settings.seed)
    models = [*names, "stacking_ridge", "blend_top3", "two_stage_residual"]
    kept = [inputs.key, "actual_price_wan", *dict.fromkeys([*inputs.categorical, "area_sqm"]), *models]
    return Study(oof, cv, materialise(full.select(*[c for c in kept if c in full.columns])), names, models, combiner)


def best_predictions(predictions: DataFrame, best: str) -> DataFrame:
    """Rows of one model with the signed residual."""
    return predictions.filter(F.col("model_name") == best).withColumn("residual_wan", F.col("actual_price_wan") - F.col("predicted_price_wan"))


def affine_pairs(n: int, repeats: int, seed: int) -> list[tuple[int, int]]:
    """(a, b) of each repeat: row p meets row (a p + b) mod n, which is a permutation as a and n share no factor."""
    rng, out = random.Random(seed), []
    while len(out) < repeats:
        a, b = rng.randrange(1, min(n, 1 << 31) + 1), rng.randrange(n)
        if math.gcd(a, n) == 1:
            out.append((a, b))
    return out


def permutation_importance(
    member: Fitted, test: DataFrame, columns: Sequence[str], target: str, repeats: int = 5, seed: int = 42, key: str = "house_id", prepared: PipelineModel | None = None
) -> DataFrame:
    """Rise of the mean absolute error when one column takes the values of shuffled rows: mean and std over repeats.

    Rows are numbered once, in an order that is a hash; a repeat pairs numbers by an affine map, so one sort serves all
    repeats. A linear member's prediction is a sum over columns, so a pair gives the errors of all columns at once; for
    trees, each task scores its pairs column by column and sends sums only. ``prepared`` is a linear member's preprocessing.
    """
    rows = test.where(F.col(target).isNotNull())
    order = positions(rows.select(key, hash_key(key, seed).alias("_h")), ["_h", key]).select(F.col(key).alias("_key"), (F.col("position") - 1).alias("_p"))
    numbered = materialise(rows.join(order, F.col(key) == F.col("_key")).drop("_key"))
    n = numbered.count()
    if not n:
        return test.sparkSession.createDataFrame([], "column_name string, importance_mean double, importance_std double")
    slim, errors_of = _linear_parts(prepared, member, numbered, columns, target) if prepared is not None else _tree_parts(member.model, numbered, columns, target)
    slim = materialise(slim)
    meets = F.explode(F.array(*[F.struct(F.lit(k).alias("repeat"), F.pmod(F.col("_p") * F.lit(a) + F.lit(b), F.lit(n)).alias("other")) for k, (a, b) in enumerate(affine_pairs(n, repeats, seed))]))
    lent = slim.select(F.col("_p").alias("_lent"), F.col("parts").alias("lent"))
    maes = errors_of(slim.withColumn("m", meets).join(lent, F.col("m.other") == F.col("_lent")).withColumn("repeat", F.col("m.repeat")))
    base = slim.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    return maes.groupBy("column_name").agg(F.avg(F.col("mae") - base).alias("importance_mean"), F.stddev_pop("mae").alias("importance_std"))


def _linear_parts(prepared: PipelineModel, member: Fitted, rows: DataFrame, columns: Sequence[str], target: str):
    """What each column adds to a linear prediction, and the errors of all columns when parts are lent."""
    numeric, categorical = prepared.stages[0].getInputCols(), prepared.stages[2].getInputCols() if len(prepared.stages) > 3 else []
    sizes = [1] * len(numeric) + (prepared.stages[3].categorySizes if categorical else [])
    weights, intercept = member.model.coefficients.toArray(), member.model.intercept
    starts = [sum(sizes[:k]) for k in range(len(sizes))]
    place = {c: k for k, c in enumerate([*numeric, *categorical])}

    @F.arrow_udf("array<double>")
    def contributions(x: pa.Array) -> pa.Array:
        values = x.flatten().to_numpy().reshape(len(x), -1) * weights
        parts = np.add.reduceat(values, starts, axis=1) if len(x) else values[:, : len(starts)]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(starts), pa.int32()), pa.array(parts.ravel()))

    ready = prepared.transform(rows).select("_p", F.col(target).cast("double").alias("y"), contributions(vector_to_array("features")).alias("parts"))
    slim = ready.withColumn("prediction", F.lit(float(intercept)) + F.aggregate("parts", F.lit(0.0), lambda s, x: s + x))

    def errors_of(pairs: DataFrame) -> DataFrame:
        change = lambda c: F.avg(F.abs(F.col("prediction") - F.col("parts")[place[c]] + F.col("lent")[place[c]] - F.col("y")))
        wide = pairs.groupBy("repeat").agg(*[change(c).alias(f"e{k}") for k, c in enumerate(columns)])
        return wide.select("repeat", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"e{k}").alias("mae")) for k, c in enumerate(columns)])).alias("e")).select("repeat", "e.*")

    return slim, errors_of


def _tree_parts(model: trees.Grown, rows: DataFrame, columns: Sequence[str], target: str):
    """A row's inputs, and the errors when one of them is lent."""
    bins = model.bins
    shared = rows.sparkSession.sparkContext.broadcast(model)
    numbers, texts = bins.inputs()
    place = {c: k for k, c in enumerate([*bins.numeric, *bins.categorical])}
    slim = trees.scored(rows, [("prediction", model)]).select("_p", F.col(target).cast("double").alias("y"), "prediction", F.struct(numbers.alias("numbers"), texts.alias("texts")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, str], list[float]] = {}
        grown, single, most = shared.value, bins.one_against_rest(), int(bins.sizes.max(initial=0))
        values = [np.asarray(tree.value) for tree in grown.trees]
        asking = {c: [t for t, tree in enumerate(grown.trees) if place[c] in tree.column] for c in columns}
        scale = 1 / max(len(values), 1) if grown.growth.kind == "forest" else grown.growth.step
        for batch in batches:
            repeat, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own, lent = (bins.codes(part.field(0), part.field(1)).astype(np.min_scalar_type(most)) for part in (batch.column(2), batch.column(3)))
            parts = [value.take(tree.leaves(own, single, most)) for value, tree in zip(values, grown.trees, strict=True)]
            prediction = (0.0 if grown.growth.kind == "forest" else grown.start) + scale * sum(parts, np.zeros(len(y)))
            for c in columns:
                # Only trees that ask for the column and rows whose bin changes predict anew.
                rows = np.flatnonzero(own[:, place[c]] != lent[:, place[c]])
                mixed, change = own[rows], np.zeros(len(rows))
                mixed[:, place[c]] = lent[rows, place[c]]
                for t in asking[c]:
                    change += values[t].take(grown.trees[t].leaves(mixed, single, most)) - parts[t].take(rows)
                moved = prediction.copy()
                moved[rows] += scale * change
                error = np.abs(moved - y)
                for k in np.unique(repeat).tolist():
                    total = sums.setdefault((k, c), [0.0, 0])
                    total[0] += float(error[repeat == k].sum())
                    total[1] += int((repeat == k).sum())
        for (k, c), (error, count) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([c]), pa.array([error]), pa.array([count], pa.int64())], names=["repeat", "column_name", "error", "rows"])

    def errors_of(pairs: DataFrame) -> DataFrame:
        parts = pairs.select("repeat", "y", "parts", "lent").mapInArrow(run, "repeat int, column_name string, error double, rows bigint")
        return parts.groupBy("repeat", "column_name").agg((F.sum("error") / F.sum("rows")).alias("mae"))

    return slim, errors_of


def learning_curve(train: DataFrame, checks: Mapping[str, DataFrame], target: str, specs: Sequence[Spec], numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """data, model_name, iteration, mae after every round of each boosted member, in one pass over each table."""
    models = grow(specs, train, target, numeric, categorical)
    named = {spec.name: models[spec.name, ()] for spec in specs}
    curves = [trees.staged_errors(df, named, target).select(F.lit(name).alias("data"), F.col("model").alias("model_name"), "iteration", "mae") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, curves)


def data_driven_weights(train: DataFrame, types: Sequence[str] = config.POI_TYPES, price: str = config.TARGET, alpha: float = 1.0) -> dict[str, float]:
    """Facility weights from a ridge of log price on standardised log counts: clipped at 0, scaled to mean 1."""
    logged = train.select(F.log1p(price).alias("_y"), *[F.log1p(fx.poi_column(t)).alias(t) for t in types])
    facts = logged.agg(*[F.avg(t).alias(f"m_{t}") for t in types], *[F.stddev_pop(t).alias(f"s_{t}") for t in types]).first()
    scaled = [((F.col(t) - F.lit(facts[f"m_{t}"])) / F.lit(facts[f"s_{t}"] or 1.0)).alias(t) for t in types]
    data = ensembles.moments(logged.select(F.lit(0).alias("fold"), F.col("_y").alias("actual"), *scaled), list(types))
    weights = [max(float(w), 0.0) for w in ensembles.ridge(data, alpha).weights]
    if sum(weights) <= 0:
        return {t: 1.0 for t in types}
    mean = sum(weights) / len(weights)
    return {t: w / mean for t, w in zip(types, weights)}

