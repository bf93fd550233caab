"""Tree members and their stack as Spark ML estimators: usable in pipelines, saved and loaded with their trees."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions.listing import log_target, unlog_target
from hearthline.operators.sampling import row_folds
from hearthline.plans import trees
from hearthline.plans.moments import Combiner, moments, ridge
from hearthline.plans.zoo import Spec, grow, model_zoo

TREES = "member int, tree int, col array<int>, split array<int>, l array<int>, r array<int>, value array<double>"


class _Shared(HasLabelCol, HasPredictionCol, HasSeed):
    """Input columns, member names, and how predictions become prices."""

    numericCols = Param(Params._dummy(), "numericCols", "numeric columns", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "categorical columns", TypeConverters.toListString)
    members = Param(Params._dummy(), "members", "names of the stacked members", TypeConverters.toListString)
    scale = Param(Params._dummy(), "scale", "share of the members' trees that is grown", TypeConverters.toFloat)
    folds = Param(Params._dummy(), "folds", "folds of the out-of-fold predictions", TypeConverters.toInt)
    keyCol = Param(Params._dummy(), "keyCol", "id of a row, which decides its fold and draws", TypeConverters.toString)
    logTarget = Param(Params._dummy(), "logTarget", "whether the logarithm of 1 + label is learned, and predictions are turned back", TypeConverters.toBoolean)
    floor = Param(Params._dummy(), "floor", "least prediction", TypeConverters.toFloat)
    alpha = Param(Params._dummy(), "alpha", "ridge penalty of the combiner", TypeConverters.toFloat)

    def _defaults(self) -> None:
        self._setDefault(numericCols=[], categoricalCols=[], members=["gradient_boosting"], scale=1.0, folds=3, keyCol="house_id", logTarget=False, alpha=1.0, labelCol="total_price_wan", predictionCol="prediction", seed=42)


class StackedTrees(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Tree members, combined by a ridge on their out-of-fold predictions; a single member is used as it is."""

    @keyword_only
    def __init__(self, *, numericCols: Sequence[str] = (), categoricalCols: Sequence[str] = (), members: Sequence[str] = ("gradient_boosting",), scale: float = 1.0, folds: int = 3, keyCol: str = "house_id",
                 logTarget: bool = False, floor: float | None = None, alpha: float = 1.0, labelCol: str = "total_price_wan", predictionCol: str = "prediction", seed: int = 42) -> None:
        super().__init__()
        self._defaults()
        given = {k: list(v) if isinstance(v, tuple) else v for k, v in self._input_kwargs.items() if v is not None}
        self._set(**given)

    def _specs(self) -> list[Spec]:
        zoo = model_zoo(self.getOrDefault("seed"), self.getOrDefault("scale"))
        return [zoo[name] for name in self.getOrDefault("members")]

    def _fit(self, dataset: DataFrame) -> StackedTreesModel:
        p = self.getOrDefault
        goal, specs, key = "_goal", self._specs(), p("keyCol")
        made = log_target(p("labelCol")) if p("logTarget") else F.col(p("labelCol")).cast("double")
        train = row_folds(dataset.withColumn(goal, made).where(F.col(goal).isNotNull()), key, p("folds"), p("seed"), "_fold")
        held = [()] if len(specs) == 1 else [(), *[(f,) for f in range(p("folds"))]]
        models = grow(specs, train, goal, p("numericCols"), p("categoricalCols"), held, "_fold", key)
        names = [s.name for s in specs]
        combiner = Combiner(names, 0.0, np.ones(1))
        if len(specs) > 1:
            by_fold = [(n, {f: models[n, (f,)] for f in range(p("folds"))}) for n in names]
            combiner = ridge(moments(trees.scored(train, by_fold, "_fold"), names, goal, "_fold"), p("alpha"))
        model = StackedTreesModel([models[n, ()] for n in names], combiner)
        return self._copyValues(model)


class StackedTreesModel(Model, _Shared, MLReadable, MLWritable):
    def __init__(self, grown: Sequence[trees.Grown] = (), combiner: Combiner | None = None) -> None:
        super().__init__()
        self._defaults()
        self.grown, self.combiner = list(grown), combiner

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = [f"_member_{k}" for k in range(len(self.grown))]
        scored = trees.scored(dataset, list(zip(names, self.grown, strict=True)))
        raw = reduce(lambda s, x: s + x, [F.lit(float(w)) * F.col(n) for w, n in zip(self.combiner.weights, names, strict=True)], F.lit(float(self.combiner.intercept)))
        floor = self.getOrDefault("floor") if self.isDefined("floor") else None
        price = unlog_target(raw, floor) if self.getOrDefault("logTarget") else raw if floor is None else F.greatest(raw, F.lit(floor))
        return scored.withColumn(self.getOrDefault("predictionCol"), price).drop(*names)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: StackedTreesModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        """Params, bins and combiner as metadata, trees as a table."""
        model, spark = self.model, SparkSession.active()
        bins = model.grown[0].bins
        kept = {
            "bins": {"numeric": bins.numeric, "categorical": bins.categorical, "cuts": [c.tolist() for c in bins.cuts], "levels": bins.levels},
            "growths": [vars(g.growth) for g in model.grown], "starts": [g.start for g in model.grown],
            "columns": model.combiner.columns, "intercept": float(model.combiner.intercept), "weights": [float(w) for w in model.combiner.weights],
        }
        DefaultParamsWriter.saveMetadata(model, path, spark, extraMetadata={"stack": kept})
        ints = lambda x: [int(v) for v in x]
        rows = [(m, t, ints(x.column), ints(x.split), ints(x.left), ints(x.right), [float(v) for v in x.value]) for m, g in enumerate(model.grown) for t, x in enumerate(g.trees)]
        spark.createDataFrame(rows, TREES).write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> StackedTreesModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        kept = metadata["stack"]
        b = kept["bins"]
        bins = trees.Bins(tuple(b["numeric"]), tuple(b["categorical"]), tuple(np.array(c, dtype=np.float64) for c in b["cuts"]), tuple(tuple(v) for v in b["levels"]))
        grown = [trees.Grown(bins, trees.Growth(**g), start, []) for g, start in zip(kept["growths"], kept["starts"], strict=True)]
        for row in spark.read.schema(TREES).parquet(f"{path}/trees").orderBy("member", "tree").collect():
            grown[row["member"]].trees.append(trees.Tree(row["col"], row["split"], row["l"], row["r"], row["value"]))
        model = StackedTreesModel(grown, Combiner(kept["columns"], kept["intercept"], np.array(kept["weights"])))
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
