"""Stacked trees as a pipeline stage: the same as the functions they are made of, and the same after saving and loading."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from hearthline.plans import trees
from hearthline.plans.estimators import StackedTrees, StackedTreesModel
from hearthline.plans.moments import moments, ridge
from hearthline.plans.zoo import grow


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    x, c = rng.normal(size=400), rng.choice(["u", "v"], 400)
    y = 60 + 9 * x + np.where(c == "u", 5.0, 0.0) + rng.normal(size=400)
    return spark.createDataFrame([(i, float(a), str(b), float(t)) for i, (a, b, t) in enumerate(zip(x, c, y))], "house_id bigint, x double, c string, total_price_wan double").cache()


def predictions(model, rows):
    return {r["house_id"]: r["prediction"] for r in model.transform(rows).select("house_id", "prediction").collect()}


def test_stack_in_a_pipeline_saved_and_loaded(spark, rows, tmp_path):
    stage = StackedTrees(numericCols=["x"], categoricalCols=["c"], members=["gradient_boosting", "boosted_depth4", "random_forest"], scale=0.05, alpha=2.0)
    fitted = Pipeline(stages=[stage]).fit(rows)
    got = predictions(fitted, rows)
    specs = stage._specs()
    train = stages_fold(rows, stage)
    models = grow(specs, train, "total_price_wan", ["x"], ["c"], [(), (0,), (1,), (2,)], "_fold")
    oof = trees.scored(train, [(s.name, {f: models[s.name, (f,)] for f in range(3)}) for s in specs], "_fold")
    combiner = ridge(moments(oof, [s.name for s in specs], "total_price_wan", "_fold"), 2.0)
    want = trees.scored(rows, [(s.name, models[s.name, ()]) for s in specs]).withColumn("p", combiner.column())
    assert all(got[r["house_id"]] == pytest.approx(r["p"]) for r in want.collect())
    fitted.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert isinstance(again.stages[0], StackedTreesModel) and predictions(again, rows) == got
    assert again.stages[0].getOrDefault("alpha") == 2.0 and again.stages[0].getOrDefault("numericCols") == ["x"]


def stages_fold(rows, stage):
    from hearthline.operators.sampling import row_folds

    return row_folds(rows, "house_id", 3, stage.getOrDefault("seed"), "_fold")


def test_log_target_is_turned_back(spark, rows, tmp_path):
    stage = StackedTrees(numericCols=["x"], categoricalCols=["c"], scale=0.1, logTarget=True, floor=55.0)
    stage.save(str(tmp_path / "stage"))
    model = StackedTrees.load(str(tmp_path / "stage")).fit(rows)
    model.save(str(tmp_path / "one"))
    got = predictions(StackedTreesModel.load(str(tmp_path / "one")), rows)
    assert got == predictions(model, rows) and min(got.values()) >= 55.0
    error = rows.select("house_id", "total_price_wan").collect()
    assert np.mean([abs(got[r["house_id"]] - r["total_price_wan"]) for r in error]) < rows.agg(F.stddev("total_price_wan")).first()[0]
