"""Ensembles on a small table, and the shapes of physical plans."""

import threading

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from hearthline import config
from hearthline.functions.hashing import hash_key
from hearthline.operators.ranking import positions
from hearthline.plans import ensembles, oof, study
from hearthline.plans.oof import cross_validation, oof_table
from hearthline.plans.zoo import Spec, assemble, fit, fit_linear, model_zoo
from hearthline.registered import catalog


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 600
    x1, x2, c = rng.normal(size=n), rng.normal(size=n), rng.choice(["u", "v", "w"], n)
    y = 50 + 8 * x1 - 5 * x2 + np.where(c == "u", 6.0, 0.0) + rng.normal(size=n)
    rows = [(int(i), float(a), float(b), str(k), float(t), int(i % 3), "train" if i < 480 else "test", int(i % 40)) for i, (a, b, k, t) in enumerate(zip(x1, x2, c, y))]
    return spark.createDataFrame(rows, "house_id bigint, x1 double, x2 double, c string, total_price_wan double, fold int, split string, community_id int").cache()


INPUTS = study.Inputs(("x1", "x2"), ("c",))
SPECS = [Spec("mean_baseline", "mean"), Spec("ridge", "ridge", {"alphas": (1.0,)}), Spec("boosted", "boosted", {"maxIter": 10, "maxDepth": 3, "seed": 1})]


@pytest.fixture(scope="module")
def result(table):
    return study.run_study(table, config.StudyConfig(), INPUTS, SPECS, stack_members=["ridge", "boosted"], residual={"maxIter": 5, "maxDepth": 2, "stepSize": 0.1})


def test_out_of_fold_covers_every_row_once(table, result):
    train = table.filter("split = 'train'")
    assert result.oof.count() == train.count() == result.oof.select("house_id").distinct().count()
    means = {r["fold"]: r["m"] for r in result.oof.groupBy("fold").agg(F.avg("mean_baseline").alias("m")).collect()}
    for fold, mean in means.items():
        assert mean == pytest.approx(train.filter(F.col("fold") != fold).agg(F.avg("total_price_wan")).first()[0])


def test_ensembles_beat_the_mean(result):
    mae = {r["model_name"]: r["mae"] for r in result.metrics().collect()}
    assert set(mae) == {"mean_baseline", "ridge", "boosted", "stacking_ridge", "blend_top3", "two_stage_residual"}
    assert mae["stacking_ridge"] < 0.5 * mae["mean_baseline"] and mae["two_stage_residual"] < mae["mean_baseline"]
    cv = {r["model_name"]: r for r in result.cv.collect()}
    assert cv["ridge"]["cv_mae_mean"] < cv["mean_baseline"]["cv_mae_mean"] and cv["ridge"]["cv_mae_std"] >= 0


def test_meta_learners_on_moments(result):
    data = ensembles.moments(result.oof, ["ridge", "boosted"])
    frame = result.oof.toPandas()
    x, y = frame[["ridge", "boosted"]].to_numpy(), frame["actual"].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
    assert np.allclose(ensembles.ridge(data, 1.0).weights, want, rtol=1e-8)
    lasso = ensembles.elastic_net(data, 1.0, 1.0)
    other = LinearRegression(featuresCol="f", labelCol="actual", regParam=1.0, elasticNetParam=1.0, standardization=False, tol=1e-12, maxIter=1000)
    from pyspark.ml.feature import VectorAssembler

    fitted = other.fit(VectorAssembler(inputCols=["ridge", "boosted"], outputCol="f").transform(result.oof))
    assert np.allclose(lasso.weights, fitted.coefficients.toArray(), atol=1e-3)
    weights = ensembles.convex(data).weights
    assert weights.min() >= 0 and weights.sum() == pytest.approx(1.0)
    grid = [np.mean((y - x @ np.array([a, 1 - a])) ** 2) for a in np.linspace(0, 1, 201)]
    assert np.mean((y - x @ weights) ** 2) <= min(grid) + 1e-9
    combiners, grids = ensembles.meta_variants(data, compact=["boosted"])
    assert "stacking_lasso_cv" in combiners and len(grids["stacking_elasticnet_cv"]) == 18


def test_ridge_penalty_scale(table):
    train = table.filter("split = 'train'")
    _, (ready,) = assemble(train, [], ("x1", "x2"), ())
    model = fit(Spec("ridge", "ridge", {"alphas": (25.0,)}), ready, "total_price_wan").model
    frame = ready.toPandas()
    x, y = np.array([v.toArray() for v in frame["features"]]), frame["total_price_wan"].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(model.coefficients.toArray(), np.linalg.solve(xc.T @ xc + 25.0 * np.eye(2), xc.T @ yc), rtol=1e-5)


def test_strengths_from_products_equal_refitting(table):
    train = table.filter("split = 'train'")
    _, (ready,) = assemble(train, [], ("x1", "x2"), ("c",))
    frame = ready.withColumn("f", F.pmod(F.xxhash64("house_id"), F.lit(3))).toPandas()
    x, y, f = np.array([v.toArray() for v in frame["features"]]), frame["total_price_wan"].to_numpy(), frame["f"].to_numpy()
    alphas = (0.1, 10.0, 1000.0)
    errors = []
    for a in alphas:
        e = 0.0
        for k in range(3):
            xt, yt = x[f != k], y[f != k]
            w = np.linalg.solve((xt - xt.mean(0)).T @ (xt - xt.mean(0)) + a * np.eye(x.shape[1]), (xt - xt.mean(0)).T @ (yt - yt.mean()))
            e += ((y[f == k] - yt.mean() - (x[f == k] - xt.mean(0)) @ w) ** 2).sum()
        errors.append(e)
    assert fit(Spec("ridge", "ridge", {"alphas": alphas}), ready, "total_price_wan").selected == alphas[int(np.argmin(errors))]
    lasso = fit(Spec("lasso", "lasso", {"steps": 100}), ready, "total_price_wan")
    top = np.abs((x - x.mean(0)).T @ (y - y.mean())).max() / len(y)
    assert top * 1e-3 * 0.999 < lasso.selected < 0.1 * top


def test_unseen_category_and_experts(table):
    train = table.filter("split = 'train'").withColumns({"region_slug": F.col("c"), "area_sqm": F.col("x1")})
    test = train.limit(5).withColumn("c", F.lit("never"))
    scored, profile = ensembles.mixture_of_experts(train, test.withColumn("region_slug", F.lit("u")), SPECS[1], "total_price_wan", ("x1", "x2"), ("c",), min_rows=50)
    assert scored.count() == 5 and scored.filter("moe_region_area is null").count() == 0
    assert profile.agg(F.sum("n")).first()[0] == train.count()


def test_median_member_halves_skewed_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=3000)
    y = 20 * np.exp(0.5 * x) * rng.lognormal(0, 1, 3000)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "house_id bigint, x1 double, total_price_wan double")
    train, test = rows.filter("house_id % 3 > 0"), rows.filter("house_id % 3 = 0")
    spec = Spec("m", "median", {"maxIter": 40, "maxDepth": 3, "stepSize": 0.1, "seed": 1})
    test = test.withColumn("region", F.floor((F.col("x1") + 1).cast("double")).cast("int")).where("region between -1 and 2")
    scored = fit(spec, train, "total_price_wan", ("x1",)).predict(test)
    below, off = scored.select(F.avg((F.col("total_price_wan") < F.col("m")).cast("double")), F.avg(F.abs(F.col("m") - 20 * F.exp(0.5 * F.col("x1"))) / (20 * F.exp(0.5 * F.col("x1"))))).first()
    assert 0.46 < below < 0.54 and off < 0.15
    shares = scored.groupBy("region").agg(F.avg((F.col("total_price_wan") < F.col("m")).cast("double")).alias("s")).collect()
    assert all(0.42 < r["s"] < 0.58 for r in shares)


def _prediction_without(frame, member, column, partner):
    """The member's predictions when one column takes the partner's value."""
    mixed = frame.copy()
    mixed[column] = frame[column].to_numpy()[partner]
    return member(mixed)


@pytest.mark.parametrize("kind", ["ridge", "boosted"])
def test_permutation_importance_by_hand(spark, table, kind):
    train, test = table.filter("split = 'train'"), table.filter("split = 'test'")
    model, (ready,) = assemble(train, [], ("x1", "x2"), ("c",))
    member = fit(SPECS[1], ready, "total_price_wan") if kind == "ridge" else fit(SPECS[2], train, "total_price_wan", ("x1", "x2"), ("c",))
    got = {r["column_name"]: r for r in study.permutation_importance(member, test, ["x1", "x2", "c"], "total_price_wan", repeats=3, prepared=model if kind == "ridge" else None).collect()}
    n = test.count()
    order = positions(test.select("house_id", hash_key("house_id", 42).alias("_h")), ["_h", "house_id"])
    frame = test.join(order, "house_id").orderBy("position").select("house_id", "x1", "x2", "c", "total_price_wan").toPandas()

    def predicted(mixed):
        df = spark.createDataFrame(mixed)
        scored = member.predict(model.transform(df) if kind == "ridge" else df, "p")
        return scored.select("house_id", "p").toPandas().set_index("house_id").loc[mixed["house_id"], "p"].to_numpy()

    y = frame["total_price_wan"].to_numpy()
    base = np.abs(predicted(frame) - y).mean()
    for column in ("x1", "x2", "c"):
        rises = [np.abs(_prediction_without(frame, predicted, column, (a * np.arange(n) + b) % n) - y).mean() - base for a, b in study.affine_pairs(n, 3, 42)]
        assert got[column]["importance_mean"] == pytest.approx(np.mean(rises), abs=1e-9) and got[column]["importance_std"] == pytest.approx(np.std(rises), abs=1e-9)
    assert got["x1"]["importance_mean"] > got["c"]["importance_mean"] > 0
    assert study.permutation_importance(member, test.limit(0), ["x1"], "total_price_wan", prepared=model if kind == "ridge" else None).count() == 0


def test_affine_pairs_are_permutations():
    for n in (1, 2, 12, 97, 360):
        assert all(sorted((a * p + b) % n for p in range(n)) == list(range(n)) for a, b in study.affine_pairs(n, 5, 1))


def test_zoo_has_all_members():
    zoo = model_zoo()
    assert set(zoo) >= {"mean_baseline", "ridge", "lasso", "random_forest", "gradient_boosting", "boosted_depth6", "median_boosting"}
    assert zoo["random_forest"].settings["numTrees"] == 180 and zoo["median_boosting"].kind == "median" and zoo["median_boosting"].settings["maxIter"] == 260


def test_data_driven_weights(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50, 400), rng.integers(0, 50, 400)
    price = np.exp(3 + 0.5 * np.log1p(a) - 0.2 * np.log1p(b)) - 1
    df = spark.createDataFrame([(float(x), float(y), float(p)) for x, y, p in zip(a, b, price)], "poi_a_count double, poi_b_count double, total_price_wan double")
    assert study.data_driven_weights(df, ("a", "b")) == {"a": pytest.approx(2.0), "b": 0.0}


def test_nested_cv_and_oof_table(table):
    train = table.filter("split = 'train'")
    nested = study.nested_two_stage_cv(train, SPECS[1], INPUTS, [0, 1, 2], {"maxIter": 2, "maxDepth": 2, "stepSize": 0.1})
    assert nested.count() == train.count()
    oof = oof_table(train, SPECS[:1], INPUTS.numeric, INPUTS.categorical, INPUTS.target, [0, 1, 2])
    assert cross_validation(oof, ["mean_baseline"]).count() == 1


@pytest.mark.parametrize("kind", ["ridge", "boosted"])
def test_nested_cv_fits_a_member_once_for_each_set_of_folds(table, kind, monkeypatch):
    """Every set of left-out folds is fitted once, and predictions are those of outer folds that are worked on one by one."""
    train, settings = table.filter("split = 'train'"), {"maxIter": 4, "maxDepth": 2, "stepSize": 0.1}
    spec = SPECS[1] if kind == "ridge" else SPECS[2]
    want = {}
    for outer in (0, 1, 2):
        inner, held = train.filter(F.col("fold") != outer), train.filter(F.col("fold") == outer)
        models = study.grow([spec], train, INPUTS.target, INPUTS.numeric, INPUTS.categorical, [(outer,), *[tuple(sorted((outer, i))) for i in (0, 1, 2) if i != outer]], "fold") if kind == "boosted" else None
        if models:
            inner_oof = study.trees.scored(inner, [(spec.name, {i: models[spec.name, tuple(sorted((outer, i)))] for i in (0, 1, 2) if i != outer})], "fold").withColumn("actual", F.col(INPUTS.target))
            scored = study.trees.scored(held, [(spec.name, models[spec.name, (outer,)])])
        else:
            inner_oof = oof_table(inner, [spec], INPUTS.numeric, INPUTS.categorical, INPUTS.target, [f for f in (0, 1, 2) if f != outer])
            _, (scored,) = oof.fit_members(inner, [held], [spec], INPUTS.numeric, INPUTS.categorical, INPUTS.target)
            scored = scored.drop("features")
        staged = study.two_stage(inner, scored, inner_oof, spec.name, INPUTS, settings)
        want |= {r["house_id"]: (r["fold"], r[INPUTS.target], r["two_stage_residual"]) for r in staged.collect()}
    fitted = []

    def seen(specs, rows, *args):
        fitted.append(frozenset(r["fold"] for r in rows.select("fold").distinct().collect()))
        return fit_linear(specs, rows, *args)

    monkeypatch.setattr(oof, "fit_linear", seen)
    got = {r["house_id"]: (r["fold"], r["actual"], r["two_stage_residual"]) for r in study.nested_two_stage_cv(train, spec, INPUTS, [0, 1, 2], settings).collect()}
    assert sorted(map(sorted, fitted)) == ([[0], [0, 1], [0, 2], [1], [1, 2], [2]] if kind == "ridge" else [])
    assert got.keys() == want.keys() and len(got) == train.count()
    assert all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2], rel=1e-9) for k in want)


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounds_reach_the_scan(spark, folder):
    plan = plan_text(catalog.queries()["b4_quantile_trim"](spark, folder))
    assert "GreaterThanOrEqual(total_price_wan" in plan


def test_keep_one_limits_before_the_shuffle(spark, folder):
    plan = plan_text(catalog.queries()["e1_keep_first"](spark, folder))
    assert plan.index("row_number(), 1, Final") < plan.index("Exchange") < plan.index("row_number(), 1, Partial")


def test_scans_read_only_needed_columns(spark, folder):
    plan = plan_text(catalog.queries()["d8_value_counts"](spark, folder))
    assert "ReadSchema: struct<o_custkey:bigint>" in plan or "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_grouping_sets_scan_once(spark, folder):
    plan = plan_text(catalog.queries()["d5_error_grouping_sets"](spark, folder))
    assert plan.count("Expand") == 1 and plan.count("FileScan") == 1


def test_registered_models_have_full_settings(spark, folder, monkeypatch):
    """All trees, strengths, rounds, members, gates and columns, as the queries hand them on."""
    from hearthline.plans import zoo
    from hearthline.registered import model_queries as mq

    class Seen(Exception):
        pass

    def seen(*args, **settings):
        raise Seen(args, settings)

    def call(target, name, run):
        with monkeypatch.context() as patch, pytest.raises(Seen) as caught:
            patch.setattr(target, name, seen)
            patch.setattr(mq, "_tables", {})
            run(spark, folder)
        return caught.value.args

    full = zoo.model_zoo(seed=42)
    assert full == mq.ZOO and set(mq.ALL) == set(full) - {"median_boosting"}
    (_, specs, *_), _ = call(mq, "oof_table", mq.oof)
    assert {s.name: s for s in specs} == {k: full[k] for k in mq.ALL}
    with monkeypatch.context() as patch:
        patch.setattr(mq, "oof", lambda *_: None)
        (_, columns), _ = call(mq.ensembles, "moments", mq.j11)
        assert tuple(columns) == zoo.MEMBERS and len(columns) == 6
    with monkeypatch.context() as patch:
        patch.setattr(mq, "scored_test", lambda *_: None)
        patch.setattr(mq, "oof", lambda *_: None)
        assert call(mq.study, "two_stage", mq.j15)[0][-1] == zoo.RESIDUAL
    specs = call(mq.study, "learning_curve", mq.j28)[0][3]
    assert len(specs) == 5 and all(s == full[s.name] for s in specs)
    for run in (mq.j27, mq.j27_trees):
        args, settings = call(mq.study, "permutation_importance", run)
        assert set(args[2]) == {*mq.NUMERIC, *mq.CATEGORICAL} and settings.get("repeats", 5) == 5
    (train, _, spec, *_), _ = call(mq.ensembles, "mixture_of_experts", mq.j18_moe)
    assert spec == full["boosted_histogram"] and train.where("region_slug <> floor_level").count() > 0


def test_products_of_many_columns_are_one_matrix(spark, monkeypatch):
    """Each pair of columns was once a sum of its own; a product with a null counts as none, one with NaN as NaN."""
    from hearthline.plans import moments as m

    def never(*_):
        raise AssertionError("a sum for each pair")

    monkeypatch.setattr(m.F, "sum", never)
    nan = float("nan")
    rows = [(0, 1.0, 2.0, 3.0), (0, None, 5.0, 1.0), (1, 2.0, nan, 4.0), (1, None, 1.0, 2.0), (None, 1.0, 1.0, 1.0), (2, None, 1.0, 1.0)]
    found = m.moments(spark.createDataFrame(rows, "fold int, a double, b double, actual double").repartition(3), ["a", "b"]).per_fold
    want = {
        0: [[2, 1, 7, 4], [1, 1, 2, 3], [7, 2, 29, 11], [4, 3, 11, 10]], None: np.ones((4, 4)),
        1: [[2, 2, nan, 6], [2, 4, nan, 8], [nan, nan, nan, nan], [6, 8, nan, 20]], 2: [[1, nan, 1, 1], [nan] * 4, [1, nan, 1, 1], [1, nan, 1, 1]],
    }
    assert set(found) == set(want) and all(np.allclose(found[k], want[k], equal_nan=True) for k in want)


def test_variants_are_fitted_at_the_same_time(spark, monkeypatch):
    """Variants once followed each other, so that their many short jobs left cores idle."""
    from hearthline.plans import experiments

    both = threading.Barrier(2)
    monkeypatch.setattr(experiments, "run_variant", lambda table, variant, *_: (both.wait(20), table.withColumn("v", F.lit(variant)))[1])
    assert [r["v"] for r in experiments.run_variants(spark.range(1), ["a", "b"], []).collect()] == ["a", "b"]


def test_labelled_rows_are_written_once(spark, folder):
    """Every pass of every variant once searched all texts for words and joined them again."""
    from hearthline.registered import model_queries

    rows, _ = model_queries.labelled(spark, folder)
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
