"""Trees on binned columns: splits against an exhaustive search, the distributed way against the one in a task."""

import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearthline.plans import ensembles, study, trees
from hearthline.plans.moments import assembled_moments, grouped_ridges, vector_moments
from hearthline.plans.oof import beside, fit_members
from hearthline.plans.zoo import Spec, assemble


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    n = 500
    x1, x2, c = rng.integers(0, 40, n), rng.normal(size=n).round(2), rng.choice(["u", "v", "w", "only"], n, p=[0.4, 0.3, 0.29, 0.01])
    y = 3 * (x1 > 20) + np.where(c == "u", 4, 0) + (x2 * 5).astype(int) + rng.integers(0, 3, n)
    rows = [(int(i), None if i % 17 == 0 else float(a), float(b), None if i % 23 == 0 else str(k), float(t), int(i % 3)) for i, (a, b, k, t) in enumerate(zip(x1, x2, c, y))]
    return spark.createDataFrame(rows, "house_id bigint, x1 double, x2 double, c string, y double, fold int").repartition(5).cache()


@pytest.fixture(scope="module")
def bins(frame):
    return trees.fit_bins(frame, ["x1", "x2"], ["c"], bins=16)


def arrays(frame, bins):
    numbers, texts = bins.inputs()
    table = frame.select(F.xxhash64("house_id").alias("id"), "y", "fold", numbers.alias("n"), texts.alias("t")).orderBy("id").toArrow().combine_chunks()
    codes = bins.codes(table.column("n").combine_chunks(), table.column("t").combine_chunks())
    return table.column("id").to_numpy(), table.column("y").to_numpy(), codes, table.column("fold").to_numpy()


def brute_tree(rows, y, codes, bins, depth, least, penalty):
    """A tree as nested tuples, by trying every column and bin on every node."""
    value = y[rows].sum() / (len(rows) + penalty)
    if not depth:
        return value
    single, best = bins.one_against_rest(), (rows_gain(y[rows], penalty) * (1 + 1e-9) + 1e-12, None)
    for column in range(codes.shape[1]):
        for split in range(int(bins.sizes[column])):
            at = codes[rows, column]
            left = at == split if single[column] else at <= split
            if min(left.sum(), (~left).sum()) < least:
                continue
            gain = rows_gain(y[rows[left]], penalty) + rows_gain(y[rows[~left]], penalty)
            if gain > best[0] + 1e-9:
                best = gain, (column, split, left)
    if best[1] is None:
        return value
    column, split, left = best[1]
    return column, split, brute_tree(rows[left], y, codes, bins, depth - 1, least, penalty), brute_tree(rows[~left], y, codes, bins, depth - 1, least, penalty)


def rows_gain(y, penalty):
    return y.sum() ** 2 / (len(y) + penalty)


def nested(tree, node=0):
    if tree.column[node] < 0:
        return tree.value[node]
    return int(tree.column[node]), int(tree.split[node]), nested(tree, tree.left[node]), nested(tree, tree.right[node])


def same(a, b):
    if not isinstance(a, tuple) or not isinstance(b, tuple):
        return not isinstance(a, tuple) and not isinstance(b, tuple) and a == pytest.approx(b)
    return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])


def test_bins(frame, bins):
    _, _, codes, _ = arrays(frame, bins)
    assert bins.levels == (("only", "u", "v", "w"),) and codes.max(axis=0)[2] == 4
    assert (codes[:, 0] == 0).sum() == 30 and (codes[:, 2] == 0).sum() == 22
    unseen = bins.codes(pa.array([[1e9, float("nan")], [None, -1e9]], pa.list_(pa.float64())), pa.array([["new"], [None]], pa.list_(pa.string())))
    assert unseen.tolist() == [[len(bins.cuts[0]) + 1, 0, 0], [0, 1, 0]]


@pytest.mark.parametrize("penalty, least", [(0.0, 1), (0.5, 7)])
def test_tree_equals_exhaustive_search(frame, bins, penalty, least):
    _, y, codes, _ = arrays(frame, bins)
    growth = trees.Growth("boosted", 1, 4, 1.0, least, penalty)
    tree = trees.grow_tree(codes + bins.offsets[:-1], y, None, bins, growth, 0)
    assert same(nested(tree), brute_tree(np.arange(len(y)), y, codes, bins, 4, least, penalty))


SETTINGS = {
    "boosted": {"maxIter": 4, "maxDepth": 3, "stepSize": 0.5, "seed": 3},
    "sampled": {"maxIter": 3, "maxDepth": 2, "stepSize": 0.5, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.67", "seed": 4},
    "median": {"maxIter": 3, "maxDepth": 2, "stepSize": 0.5, "seed": 5},
    "forest": {"numTrees": 4, "maxDepth": 5, "minInstancesPerNode": 3, "seed": 6},
}
GROWTHS = {name: trees.Growth.of(name if name in ("median", "forest") else "boosted", s) for name, s in SETTINGS.items()}


def test_growing_over_all_tasks_equals_growing_in_one(frame, bins, monkeypatch):
    monkeypatch.setattr(trees, "WRITTEN", 2)
    held = [(), (1,)]
    small = trees.grow_members(frame, GROWTHS, bins, "y", held, "fold")
    large = trees.grow_members(frame, GROWTHS, bins, "y", held, "fold", local=0)
    assert set(small) == set(large) == {(n, h) for n in GROWTHS for h in held}
    _, _, codes, _ = arrays(frame, bins)
    for key, model in small.items():
        assert len(model.trees) == len(large[key].trees) == model.growth.trees and model.start == pytest.approx(large[key].start)
        assert all(same(nested(a), nested(b)) for a, b in zip(model.trees, large[key].trees)), key
        assert np.allclose(model.raw(codes), large[key].raw(codes))


def test_units_do_not_depend_on_partitions(frame, bins):
    a = trees.grow_members(frame, GROWTHS, bins, "y")
    b = trees.grow_members(frame.repartition(2, "x1"), GROWTHS, bins, "y")
    _, _, codes, _ = arrays(frame, bins)
    assert all((a[k].raw(codes) == b[k].raw(codes)).all() for k in a)


def test_boosting_by_hand(frame, bins):
    """Start, residuals, leaf means and steps against plain loops."""
    _, y, codes, fold = arrays(frame, bins)
    rows = np.flatnonzero(fold != 1)
    prediction = np.full(len(y), y[rows].mean())

    def leaf(tree, code):
        while isinstance(tree, tuple):
            at = code[tree[0]]
            tree = tree[2] if (at == tree[1] if bins.one_against_rest()[tree[0]] else at <= tree[1]) else tree[3]
        return tree

    for _ in range(4):
        tree = brute_tree(rows, y - prediction, codes, bins, 3, 1, 0.0)
        prediction = prediction + 0.5 * np.array([leaf(tree, c) for c in codes])
    model = trees.grow_members(frame, {"boosted": GROWTHS["boosted"]}, bins, "y", [(1,)], "fold")["boosted", (1,)]
    assert np.allclose(model.raw(codes), prediction)


def test_median_leaves_and_forest_weights(frame, bins):
    ids, y, codes, _ = arrays(frame, bins)
    model = trees.grow_members(frame, {"median": GROWTHS["median"]}, bins, "y")["median", ()]
    assert model.start == np.median(y)
    leaf = model.trees[0].leaves(codes, bins.one_against_rest())
    for node in np.unique(leaf):
        assert model.trees[0].value[node] == pytest.approx(np.median((y - model.start)[leaf == node]))
    weights = np.array([GROWTHS["forest"].weights(ids, t) for t in range(40)])
    assert 0.97 < weights.mean() < 1.03 and 0.9 < weights.var() < 1.1 and not (weights[0] == weights[1]).all()


def test_scores_by_fold_and_stages(frame, bins):
    held = [(0,), (1,), (2,)]
    models = trees.grow_members(frame, {"boosted": GROWTHS["boosted"]}, bins, "y", held, "fold")
    by_fold = {f: models["boosted", (f,)] for f in range(3)}
    got = {r["house_id"]: r["p"] for r in trees.scored(frame, [("p", by_fold)], "fold").select("house_id", "p").collect()}
    for f in range(3):
        rows = trees.scored(frame.where(F.col("fold") == f), [("q", by_fold[f])]).select("house_id", "q").collect()
        assert all(got[r["house_id"]] == r["q"] for r in rows)
    curve = study.learning_curve(frame, {"check": frame}, "y", [Spec("b", "boosted", SETTINGS["boosted"]), Spec("f", "forest", SETTINGS["forest"])], ["x1", "x2"], ["c"])
    last = {r["model_name"]: r["mae"] for r in curve.where("iteration = 4").collect()}
    models = trees.grow_members(frame, {"b": GROWTHS["boosted"], "f": GROWTHS["forest"]}, trees.fit_bins(frame, ["x1", "x2"], ["c"]), "y")
    for name in ("b", "f"):
        mae = trees.scored(frame, [("p", models[name, ()])]).agg(F.avg(F.abs(F.col("p") - F.col("y")))).first()[0]
        assert curve.where(F.col("model_name") == name).count() == 4 and last[name] == pytest.approx(mae)


def test_grouped_ridges_equal_one_by_one(frame):
    rows = frame.fillna(0.0).withColumn("gate", F.when(F.col("c") != "only", F.col("c")))
    _, (ready,) = assemble(rows, [], ["x1", "x2"], [])
    got = {r["gate"]: r for r in grouped_ridges(ready, "gate", F.col("fold"), "y", (0.1, 10.0, 1000.0)).collect()}
    table = ready.toPandas()
    for gate, part in table.groupby("gate", dropna=False):
        x, y, f = np.array([v.toArray() for v in part["features"]]), part["y"].to_numpy(), part["fold"].to_numpy()

        def solve(rows, a):
            xm, ym = x[rows].mean(0), y[rows].mean()
            w = np.linalg.solve((x[rows] - xm).T @ (x[rows] - xm) + a * np.eye(2), (x[rows] - xm).T @ (y[rows] - ym))
            return ym - xm @ w, w

        def error(a):
            total = 0.0
            for k in range(3):
                b, w = solve(f != k, a)
                total += ((y[f == k] - b - x[f == k] @ w) ** 2).sum()
            return total

        found = got[gate if isinstance(gate, str) else None]
        assert found["alpha"] == min((0.1, 10.0, 1000.0), key=error)
        b, w = solve(np.ones(len(y), dtype=bool), found["alpha"])
        assert found["intercept"] == pytest.approx(b) and np.allclose(found["weights"], w)
    assert set(got) == {"u", "v", "w", None}


@pytest.mark.parametrize("local", [trees.LOCAL, 60])
def test_tree_experts(frame, local, monkeypatch):
    """Experts equal models of their gates alone, in a task or over all tasks; small gates use the model of all rows."""
    rows = frame.withColumns({"region_slug": F.coalesce("c", F.lit("none")), "area_sqm": F.coalesce("x1", F.lit(0.0))})
    train, test = rows.where("fold < 2"), rows.where("fold = 2")
    spec = Spec("b", "boosted", SETTINGS["boosted"])
    monkeypatch.setattr(ensembles._tree_experts, "__defaults__", (local,))
    scored, profile = ensembles.mixture_of_experts(train, test, spec, "y", ["x1", "x2"], ["c"], min_rows=30)
    got = {r["house_id"]: (r["gate"], r["moe_region_area"]) for r in scored.collect()}
    assert len(got) == test.count()
    uses = {r["gate"]: r["uses_expert"] for r in profile.collect()}
    gated, cuts = ensembles.gates(train)
    own = gated.join(profile.where("uses_expert"), "gate", "left_semi")
    own_bins = trees.fit_bins(own, ["x1", "x2"], ["c"])
    asked, _ = ensembles.gates(test, cuts=cuts)
    growth = trees.Growth.of("boosted", SETTINGS["boosted"])
    chosen = [g for g, u in sorted(uses.items()) if u]
    assert 3 <= len(chosen) < len(uses)
    for gate in chosen[:3]:
        model = trees.grow_members(own.where(F.col("gate") == gate), {"b": growth}, own_bins, "y")["b", ()]
        for r in trees.scored(asked.where(F.col("gate") == gate), [("p", model)]).collect():
            assert got[r["house_id"]] == (gate, pytest.approx(r["p"]))
    whole = trees.grow_members(train, {"b": growth}, trees.fit_bins(train, ["x1", "x2"], ["c"]), "y")["b", ()]
    for r in trees.scored(asked, [("p", whole)]).collect():
        if not uses.get(r["gate"]):
            assert got[r["house_id"]][1] == pytest.approx(r["p"])
    errors = {r["gate"]: r for r in ensembles.gate_errors(scored, profile, "y").collect()}
    assert sum(r["n"] for r in errors.values()) == len(got) and all(r["uses_expert"] == uses.get(g, False) for g, r in errors.items())


def test_large_gates_are_grown_in_one_job(frame, monkeypatch):
    """Gates of many rows once followed each other, each in a job of its own that read all rows."""
    calls, plain = [], trees.grow_members
    monkeypatch.setattr(trees, "grow_members", lambda *a, **k: (calls.append(a), plain(*a, **k))[1])
    rows = frame.withColumn("gate", F.coalesce("c", F.lit("none")))
    own = ensembles._tree_experts(rows, rows, Spec("b", "boosted", SETTINGS["boosted"]), "y", ["x1", "x2"], ["c"], "house_id", 20)
    got = {r["house_id"]: r["_own"] for r in own.collect()}
    assert not calls and len(got) == rows.count()
    own_bins = trees.fit_bins(rows, ["x1", "x2"], ["c"])
    model = plain(rows.where("gate = 'none'"), {"b": GROWTHS["boosted"]}, own_bins, "y")["b", ()]
    for r in trees.scored(rows.where("gate = 'none'"), [("p", model)]).collect():
        assert got[r["house_id"]] == pytest.approx(r["p"])


@pytest.mark.parametrize("few", [trees.FEW, 8])
def test_boosted_units_are_grown_by_all_tasks_together(frame, bins, few, monkeypatch):
    """A unit was once a single task however many rows it had, and a job for every level where its rows did not fit."""
    def never(*_):
        raise AssertionError("grown level by level, or in one task")

    boosted = {name: g for name, g in GROWTHS.items() if g.kind != "forest"}
    held = [(), (1,)]
    small = trees.grow_members(frame, boosted, bins, "y", held, "fold")
    for name, value in {"SPREAD": 0, "FEW": few, "grow_large": never, "grow_unit": never}.items():
        monkeypatch.setattr(trees, name, value)
    _, _, codes, _ = arrays(frame, bins)
    for local in (trees.LOCAL, 100):  # few units, and rows that do not fit into a task
        together = trees.grow_members(frame, boosted, bins, "y", held, "fold", local=local)
        assert set(together) == set(small)
        for key, model in small.items():
            assert model.start == pytest.approx(together[key].start)
            assert all(same(nested(a), nested(b)) for a, b in zip(model.trees, together[key].trees, strict=True)), key
            assert np.allclose(model.raw(codes), together[key].raw(codes))


def test_middle_values_of_all_tasks(tmp_path):
    """Medians by exchanged bytes, with ties, signs, both zeros and tasks without rows, against sorting."""
    rng = np.random.default_rng(5)
    groups = [rng.normal(size=1001), rng.integers(-3, 3, 500).astype(float), np.array([-0.0, 0.0]), np.array([-1e300]), np.array([]), np.array([-5.0, -1.0, np.inf, 1e-310])]
    shares = [[g[k::3] for g in groups] for k in range(3)]
    found = [None] * 3

    def task(k):
        found[k] = trees.middle_values(shares[k], trees.Exchange(str(tmp_path / "x"), k, 3, patience=30.0).add)

    threads = [threading.Thread(target=task, args=(k,)) for k in range(3)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert found[0] == found[1] == found[2] == [float(np.median(g)) if len(g) else None for g in groups]
    assert len(list((tmp_path / "x").iterdir())) <= 3  # files are deleted as soon as all have read them


def test_sums_wait_for_all_tasks_and_not_for_ever(tmp_path):
    with pytest.raises(TimeoutError):
        trees.Exchange(str(tmp_path), 0, 2, patience=0.05).add(np.ones(3))


def test_many_rows_by_difference(frame, bins):
    """Joint histograms, sisters as differences and small nodes in batches give the trees of plain sums."""
    ids, y, codes, _ = arrays(frame, bins)
    rng = np.random.default_rng(3)
    place = rng.integers(0, len(y), 30_000)
    ids, y, codes = np.arange(30_000), y[place] + rng.integers(0, 5, 30_000), codes[place]
    for kind in ("boosted", "forest", "median"):
        growth = trees.Growth(kind, 4, 6, 0.5, 3.0, 0.1, 0.8 if kind != "forest" else 1.0, 0.9, 7)
        unit = trees.Unit("m", (), growth, 0, growth.trees)
        plain, packed = (trees.Grown(bins, growth, *trees.grow_unit(unit, ids, y, c, bins, direct)) for c, direct in ((codes, 1 << 40), (codes.astype(np.uint16), 0)))
        assert np.allclose(plain.raw(codes), packed.raw(codes), rtol=0, atol=1e-9)
        assert [list(t.column) for t in plain.trees] == [list(t.column) for t in packed.trees]


def test_table_of_many_rows_is_grown_by_units(spark, monkeypatch):
    """More than 262,144 rows once led to a job for every level of every round."""
    def never(*_):
        raise AssertionError("grown level by level")

    monkeypatch.setattr(trees, "grow_large", never)
    rows = spark.range(300_000, numPartitions=4).select(F.col("id").alias("house_id"), F.pmod("id", F.lit(50)).cast("double").alias("x"), F.pmod("id", F.lit(3)).alias("c"), (F.pmod("id", F.lit(50)) * 2 + F.pmod("id", F.lit(3))).cast("double").alias("y"), F.pmod("id", F.lit(2)).alias("fold"))
    bins = trees.fit_bins(rows, ["x"], ["c"])
    models = trees.grow_members(rows, {"b": trees.Growth("boosted", 3, 8), "f": trees.Growth("forest", 2, 8)}, bins, "y", [(), (1,)], "fold")
    scored = trees.scored(rows, [("b", models["b", ()]), ("f", models["f", (1,)])])
    error = scored.where("fold = 0").agg(F.avg(F.abs(F.col("b") - F.col("y"))), F.avg(F.abs(F.col("f") - F.col("y")))).first()
    assert error[0] < 1.0 and error[1] < 1.0


def test_every_unit_has_its_own_task(frame, bins, monkeypatch):
    """Units once met by chance in one task; the longest are dealt to the first tasks."""
    dealt = []
    plain = type(frame).repartitionById

    def noted(df, number, column):
        out = plain(df, number, column)
        dealt.append((number, out.select("unit", F.spark_partition_id().alias("part")).distinct().collect()))
        return out

    monkeypatch.setattr(type(frame), "repartitionById", noted)
    growths = {"few": trees.Growth("boosted", 2, 2), "f": trees.Growth("forest", 2 * trees.FOREST_RUN, 2), "many": trees.Growth("boosted", 40, 3)}
    models = trees.grow_members(frame, growths, bins, "y", [(0,), (1,)], "fold")
    ((number, rows),) = dealt
    assert number == 8 and {r["unit"]: r["part"] for r in rows} == {k: k for k in range(8)} and len(rows) == 8
    assert {k: len(m.trees) for k, m in models.items()} == {(n, (f,)): g.trees for n, g in growths.items() for f in (0, 1)}


def test_products_without_vectors(frame, monkeypatch):
    """Sums by category slot are the products of the assembled vectors, with missing and unseen texts; no rows are cached."""
    filled = frame.fillna({"x1": 3.0}).withColumn("d", F.when(F.col("house_id") % 5 == 0, None).otherwise((F.col("house_id") % 4).cast("string")))
    known = filled.where("house_id % 4 <> 3")
    for categorical in (["c", "d"], ["c"], []):
        model, (_, ready) = assemble(known, [filled], ["x1", "x2"], categorical)
        fold, middle = F.col("fold"), filled.agg(F.avg("y")).first()[0]
        plain, sums = vector_moments(ready, "y", fold), assembled_moments(filled, model, "y", middle, fold)
        assert plain.columns == sums.columns and sorted(plain.per_fold) == sorted(sums.per_fold) == [0, 1, 2]
        for k, matrix in plain.per_fold.items():
            assert np.allclose(matrix, sums.per_fold[k], rtol=1e-9, atol=1e-9)

    def never(*_):
        raise AssertionError("rows cached")

    monkeypatch.setattr(type(frame), "persist", never)
    (member,), (scored,) = fit_members(known, [filled], [Spec("ridge", "ridge", {"alphas": (0.1, 10.0)})], ["x1", "x2"], ["c", "d"], "y")
    assert member.selected in (0.1, 10.0) and scored.where("ridge is null").count() == 0


def test_tables_are_made_beside_each_other():
    both = threading.Barrier(2)
    assert beside(lambda: both.wait(10) >= 0, lambda: both.wait(10) >= 0) == [True, True]


def test_registered_tables_are_made_beside_each_other(monkeypatch):
    """The out-of-fold table and the scored test rows once followed each other."""
    from hearthline.registered import model_queries as m

    both, begun = threading.Barrier(2), []
    monkeypatch.setattr(m, "prepared", lambda *_: begun.append("rows"))
    monkeypatch.setattr(m, "oof", lambda *_: (both.wait(10), "oof")[1])
    monkeypatch.setattr(m, "scored_test", lambda *_: (both.wait(10), "test")[1])
    assert m.oof_and_test(None, "") == ["oof", "test"] and begun == ["rows"]


def test_bins_are_cut_at_counted_ranks(spark):
    """Cuts are values of wanted ranks, whatever the chunks; with few points a cut is off by a rank in as many at most."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=6000).round(4)
    rows = [(float(v), None if i % 7 == 0 else float(i % 5), float("nan") if i % 3 == 0 else 1.0, None if i % 11 == 0 else "abé"[i % 3]) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "x double, few double, same double, c string").repartition(4)
    exact = trees.fit_bins(frame, ["x", "few", "same"], ["c"], bins=16, chunk=500)
    ranked = np.sort(x)
    want = np.unique([ranked[int(np.ceil(k / 16 * len(x))) - 1] for k in range(1, 16)])
    assert exact.cuts[0].tolist() == want[want < ranked[-1]].tolist()
    assert exact.cuts[1].tolist() == [0.0, 1.0, 2.0, 3.0] and exact.cuts[2].tolist() == []
    assert exact.levels == (("a", "b", "é"),)
    near = trees.fit_bins(frame, ["x"], [], bins=16, points=200, chunk=1000)
    off = np.searchsorted(ranked, near.cuts[0], side="right") - np.ceil(np.arange(1, 16) / 16 * len(x))
    assert np.abs(off).max() <= len(x) / 200 + 4 and near.levels == ()
    nothing = trees.fit_bins(frame.limit(0), ["x"], ["c"])
    assert nothing.cuts[0].tolist() == [] and nothing.levels == ((),)


def test_leaves_by_table_equal_leaves_by_steps(frame, bins):
    ids, y, codes, _ = arrays(frame, bins)
    growth = trees.Growth("boosted", 3, 4, 0.3, columns_share=0.7)
    most = int(bins.sizes.max())
    for tree in trees.grow_unit(trees.Unit("m", (), growth, 0, 3), ids, y, codes, bins)[1]:
        steps = tree.leaves(codes, bins.one_against_rest())
        many = np.tile(codes, (8, 1)).astype(np.uint8)
        assert np.array_equal(tree.leaves(many, bins.one_against_rest(), most), np.tile(steps, 8))


def test_forest_runs_of_many_rows(frame, bins, monkeypatch):
    """A forest of many rows is dealt in runs, and its rows travel as a byte a column."""
    monkeypatch.setattr(trees, "DIRECT", 50)
    assert trees.coded(frame, bins, "y", None, "house_id").selectExpr("max(length(codes)) m").first()["m"] == len(bins.sizes)
    growth = trees.Growth("forest", 2 * trees.FOREST_RUN, 3, least=2)
    found = trees.grow_members(frame, {"f": growth}, bins, "y")["f", ()]
    ids, y, codes, _ = arrays(frame, bins)
    _, want = trees.grow_unit(trees.Unit("f", (), growth, 0, growth.trees), ids, y, codes, bins)
    assert [list(t.column) for t in found.trees] == [list(t.column) for t in want]


def test_importance_of_a_tree_member_by_hand(frame, bins):
    """Scoring only trees that ask for a column, on rows whose bin changes, gives the errors of scoring all of them."""
    for kind, settings in (("boosted", {"maxIter": 6, "maxDepth": 3}), ("forest", {"numTrees": 4, "maxDepth": 3})):
        member = fit_members(frame, [], [Spec("m", kind, settings)], ["x1", "x2"], ["c"], "y")[0][0]
        got = {r["column_name"]: r for r in study.permutation_importance(member, frame, ["x1", "x2", "c"], "y", repeats=2).collect()}
        numbers, texts = member.model.bins.inputs()
        order = study.positions(frame.select("house_id", study.hash_key("house_id", 42).alias("_h")), ["_h", "house_id"])
        table = frame.join(order, "house_id").select("position", "y", numbers.alias("n"), texts.alias("t")).orderBy("position").toArrow().combine_chunks()
        codes = member.model.bins.codes(table.column("n").combine_chunks(), table.column("t").combine_chunks())
        y = table.column("y").to_numpy()
        base = np.abs(member.model.raw(codes) - y).mean()
        for place, column in enumerate(["x1", "x2", "c"]):
            rises = []
            for a, b in study.affine_pairs(len(y), 2, 42):
                mixed = codes.copy()
                mixed[:, place] = codes[(np.arange(len(y)) * a + b) % len(y), place]
                rises.append(np.abs(member.model.raw(mixed) - y).mean() - base)
            assert got[column]["importance_mean"] == pytest.approx(np.mean(rises), abs=1e-9)
            assert got[column]["importance_std"] == pytest.approx(np.std(rises), abs=1e-9)
