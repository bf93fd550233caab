"""Member models: linear ones as Spark ML estimators over an assembled vector, trees over binned columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Model
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.operators.ranking import null_safe_join
from hearthline.plans import trees
from hearthline.plans.moments import Moments, assembled_moments, lasso_path, lasso_strengths, ridge, vector_moments

# Member settings.
RIDGE_ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
FOREST = {"numTrees": 180, "maxDepth": 14, "minInstancesPerNode": 3}
BOOSTED = {
    "gradient_boosting": {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1},
    "boosted_histogram": {"maxIter": 240, "maxDepth": 5, "stepSize": 0.055, "penalty": 0.05},
    "boosted_depth4": {"maxIter": 220, "maxDepth": 4, "stepSize": 0.045, "subsamplingRate": 0.85, "featureSubsetStrategy": "0.85"},
    "boosted_leaves31": {"maxIter": 260, "maxDepth": 5, "stepSize": 0.045, "subsamplingRate": 0.85, "featureSubsetStrategy": "0.85"},
    "boosted_depth6": {"maxIter": 260, "maxDepth": 6, "stepSize": 0.045},
}
RESIDUAL = {"maxIter": 160, "maxDepth": 4, "stepSize": 0.045, "penalty": 0.1}
MEMBERS = ("random_forest", *BOOSTED)
GROWN_KINDS = ("forest", "boosted", "median")
LINEAR_KINDS = ("ridge", "lasso")


@dataclass(frozen=True)
class Spec:
    """One member: its kind and the settings of its estimator."""

    name: str
    kind: str
    settings: dict = field(default_factory=dict)


def model_zoo(seed: int = 42, scale: float = 1.0) -> dict[str, Spec]:
    """All members; ``scale`` shrinks the number of trees for trial runs."""

    def sized(settings: dict) -> dict:
        trees = "numTrees" if "numTrees" in settings else "maxIter"
        return {**settings, trees: max(2, round(settings[trees] * scale)), "seed": seed}

    zoo = {
        "mean_baseline": Spec("mean_baseline", "mean"),
        "ridge": Spec("ridge", "ridge", {"alphas": RIDGE_ALPHAS}),
        "lasso": Spec("lasso", "lasso", {"steps": 100}),
        "random_forest": Spec("random_forest", "forest", sized(FOREST)),
        "median_boosting": Spec("median_boosting", "median", sized(BOOSTED["boosted_leaves31"])),
    }
    zoo |= {name: Spec(name, "boosted", sized(settings)) for name, settings in BOOSTED.items()}
    return zoo


def preprocessing(numeric: Sequence[str], categorical: Sequence[str]) -> Pipeline:
    """Standardised numbers and one-hot categories; values unseen in training get their own slot."""
    stages = [
        VectorAssembler(inputCols=list(numeric), outputCol="_numeric", handleInvalid="keep"),
        StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True, withStd=True),
    ]
    parts = ["_scaled"]
    if categorical:
        indexed, encoded = [f"_i_{c}" for c in categorical], [f"_o_{c}" for c in categorical]
        stages += [
            StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, handleInvalid="keep"),
        ]
        parts += encoded
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return Pipeline(stages=stages)


@dataclass
class GroupMeans:
    """Means of groups of training rows, and the mean of all for other groups."""

    table: DataFrame
    keys: Sequence[str]
    fallback: float


@dataclass
class Fitted:
    """A fitted member; ``predict`` adds one prediction column."""

    name: str
    model: Model | trees.Grown | GroupMeans | float
    selected: float | None = None

    def predict(self, df: DataFrame, column: str | None = None) -> DataFrame:
        name = column or self.name
        if isinstance(self.model, float):
            return df.withColumn(name, F.lit(self.model))
        if isinstance(self.model, trees.Grown):
            return trees.scored(df, [(name, self.model)])
        if isinstance(self.model, GroupMeans):
            known = null_safe_join(df, self.model.table, self.model.keys)
            return known.withColumn(name, F.coalesce("_mean", F.lit(self.model.fallback))).drop("_mean")
        return self.model.copy({self.model.predictionCol: name}).transform(df)


def _linear(reg: float, l1: float, target: str, iterations: int = 200) -> LinearRegression:
    return LinearRegression(
        featuresCol="features", labelCol=target, regParam=reg, elasticNetParam=l1, standardization=False, solver="auto", maxIter=iterations
    )


def strength_folds() -> Column:
    return F.pmod(F.xxhash64("house_id"), F.lit(3))


def _best_strength(train: DataFrame, target: str, spec: Spec, data: Moments | None = None) -> float:
    """Grid value with the least squared error over three hash folds of the training rows, all from one pass."""
    grid = spec.settings.get("alphas", ())
    if len(grid) == 1:
        return grid[0]
    data = data or vector_moments(train, target, strength_folds())
    if spec.kind == "lasso":
        grid = lasso_strengths(data, spec.settings["steps"])
    error = dict.fromkeys(grid, 0.0)
    for fold, held in data.per_fold.items():
        built = lasso_path(data, grid, fold) if spec.kind == "lasso" else (ridge(data, a, fold) for a in grid)
        for model in built:
            error[model.alpha] += model.squared_error(held)
    return min(grid, key=error.get)


def fit(spec: Spec, train: DataFrame, target: str, numeric: Sequence[str] = (), categorical: Sequence[str] = (), data: Moments | None = None) -> Fitted:
    """Fits one member on assembled rows; trees read the named columns instead of the vector. ``data`` are the products of
    the vectors, if they are known."""
    if spec.kind == "mean":
        return Fitted(spec.name, float(train.agg(F.avg(target)).first()[0]))
    if spec.kind == "group_mean":
        keys = spec.settings["keys"]
        return Fitted(spec.name, GroupMeans(train.groupBy(*keys).agg(F.avg(target).alias("_mean")), keys, float(train.agg(F.avg(target)).first()[0])))
    if spec.kind == "ridge":
        # Penalty alpha on the centred least-squares sum, in the scale of this estimator.
        facts = train.select(target).agg(F.count("*").alias("n"), F.stddev_pop(target).alias("s")).first()
        factor = facts["s"] / facts["n"]
        alpha = _best_strength(train, target, spec, data)
        return Fitted(spec.name, _linear(alpha * factor, 0.0, target).fit(train), alpha)
    if spec.kind == "lasso":
        strength = _best_strength(train, target, spec, data)
        return Fitted(spec.name, _linear(strength, 1.0, target).fit(train), strength)
    if spec.kind in GROWN_KINDS:
        return Fitted(spec.name, grow([spec], train, target, numeric, categorical)[spec.name, ()])
    raise ValueError(f"unknown kind of member: {spec.kind}")


def fit_linear(specs: Sequence[Spec], train: DataFrame, ready: DataFrame, model: PipelineModel, target: str) -> list[Fitted]:
    """Linear members on the assembled rows ``ready`` of ``train``; strengths of all come from one pass over its columns."""
    data = None
    if any(len(spec.settings.get("alphas", ())) != 1 for spec in specs):
        middle = train.agg(F.avg(target)).first()[0] or 0.0
        data = assembled_moments(train, model, target, middle, strength_folds())
    return [fit(spec, ready, target, data=data) for spec in specs]


def grow(
    specs: Sequence[Spec], train: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], held: Sequence[tuple[int, ...]] = ((),), fold: str | None = None, key: str = "house_id"
) -> trees.Models:
    """Tree members by (name, left-out folds), all grown together. Bins come from all given rows and never read the target."""
    bins = trees.fit_bins(train, numeric, categorical)
    return trees.grow_members(train, {s.name: trees.Growth.of(s.kind, s.settings) for s in specs}, bins, target, held, fold, key)


def assemble(train: DataFrame, others: Sequence[DataFrame], numeric: Sequence[str], categorical: Sequence[str]) -> tuple[PipelineModel, list[DataFrame]]:
    """Fits the preprocessing on ``train`` only and applies it everywhere."""
    model = preprocessing(numeric, categorical).fit(train)
    dropped = ["_numeric", "_scaled", *[f"_i_{c}" for c in categorical], *[f"_o_{c}" for c in categorical]]
    return model, [model.transform(df).drop(*dropped) for df in (train, *others)]


def clipped(prediction: Column, floor: float | None) -> Column:
    return prediction if floor is None else F.greatest(prediction, F.lit(floor))
