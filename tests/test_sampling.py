"""Properties of samples, splits and folds."""

import pytest
from pyspark.sql import functions as F

from hearthline.operators import sampling


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(5000).select(
        F.col("id"), F.when(F.col("id") < 3500, "hot").when(F.col("id") < 4990, "mid").when(F.col("id") < 4999, "few").alias("s"),
        F.pmod(F.col("id") * 37, F.lit(90)).alias("g"), (F.col("id") / 100).cast("int").alias("t"),
    ).cache()


@pytest.mark.parametrize("n", [1, 10, 777, 4999, 5000, 9000])
def test_exact_sample(rows, n):
    chosen = sampling.sample_exact(rows, "id", n, 3)
    assert chosen.count() == min(n, 5000) == chosen.select("id").distinct().count()


def test_samples_do_not_depend_on_partitioning(rows):
    a = sampling.sample_exact(rows, "id", 500, 3).select("id").collect()
    b = sampling.sample_exact(rows.repartition(7), "id", 500, 3).select("id").collect()
    assert sorted(a) == sorted(b)


@pytest.mark.parametrize("n", [4, 50, 333, 2500])
def test_stratified_sample(rows, n):
    chosen = sampling.sample_stratified(rows, "id", ["s"], n, 1)
    assert chosen.count() == n == chosen.select("id").distinct().count()
    free = sampling.sample_stratified(rows, "id", ["s"], n, 1, top_up=False)
    counts = {r["s"]: r["count"] for r in free.groupBy("s").count().collect()}
    sizes = {"hot": 3500, "mid": 1490, "few": 9, None: 1}
    assert counts == {k: min(c, max(1, round(c * n / 5000))) for k, c in sizes.items()}


def test_replacement_draws(rows):
    few = rows.filter("id < 20")
    drawn = sampling.sample_with_replacement(few, "id", 75, 2)
    assert drawn.agg(F.sum("draws")).first()[0] == 75
    assert sampling.sample_with_replacement(few, "id", 5, 2).count() == 5


@pytest.mark.parametrize("split", ["time", "random"])
def test_splits_partition_the_rows(rows, split):
    out = sampling.split_by_time(rows, F.col("t"), "id", 0.2) if split == "time" else sampling.split_random(rows, "id", 0.2, 9)
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 4000, "test": 1000}
    if split == "time":
        assert out.filter("split = 'train'").agg(F.max("t")).first()[0] <= out.filter("split = 'test'").agg(F.min("t")).first()[0]


def test_holdout_guard():
    assert sampling.holdout_size(3, 0.2) == 1
    with pytest.raises(ValueError):
        sampling.holdout_size(2, 0.5)


def test_folds_never_split_a_group(rows):
    for out in (sampling.group_folds(rows, "g", 3, 1), sampling.balanced_group_folds(rows, "g", 3)):
        assert out.count() == 5000
        assert out.groupBy("g").agg(F.count_distinct("fold").alias("f")).filter("f > 1").count() == 0
    sizes = [r["count"] for r in sampling.balanced_group_folds(rows, "g", 3).groupBy("fold").count().collect()]
    assert len(sizes) == 3 and max(sizes) - min(sizes) < 200


def test_folds_are_filled_from_the_largest_group(spark, rows, monkeypatch):
    skewed = rows.withColumn("g", F.when(F.col("id") % 10 < 7, F.lit("huge")).otherwise((F.col("id") % 301).cast("string")))
    for large in (2_000, 20):
        monkeypatch.setattr(sampling, "LARGE_GROUPS", large)
        sizes = sorted(r["count"] for r in sampling.balanced_group_folds(skewed, "g", 3).groupBy("fold").count().collect())
        huge = skewed.filter("g = 'huge'").count()
        assert sizes[2] == huge and abs(sizes[0] - (5000 - huge) / 2) < 15


def test_poisson_counts_have_the_whole_tail():
    assert sampling.POISSON_CUMULATIVE[9] == pytest.approx(0.9999998885745217, abs=1e-15) and len(sampling.POISSON_CUMULATIVE) > 15
    assert sampling.POISSON_CUMULATIVE[-1] >= 1 - 2.0**-52


def test_fold_fallback_when_groups_are_few(rows):
    lone = rows.withColumn("g", F.lit("only"))
    folds = sampling.cv_folds(lone, "id", "g", 3, 1).select("fold").distinct().count()
    assert folds == 2
    nulls = sampling.group_folds(rows.withColumn("g", F.lit(None).cast("string")), "g", 3, 1)
    assert nulls.select("fold").distinct().count() == 1


def test_bootstrap_interval_covers_the_mean(spark, rows):
    df = rows.withColumn("x", F.col("id") % 11)
    row = sampling.bootstrap_mean_ci(df, "x", "id", replicates=200).first()
    assert row["ci_low"] < row["mean"] < row["ci_high"]
    assert row["ci_high"] - row["ci_low"] == pytest.approx(2 * 1.96 * 3.162 / 5000**0.5, rel=0.25)


def test_bootstrap_draws_each_id_once(spark, monkeypatch):
    """Weights equal the remainders and limits spelled out, rows of one id share them, and totals hold for every group."""
    import numpy as np

    a, b = (np.array(x, dtype=np.int64) for x in sampling.bootstrap_factors(40, 42))
    limits = np.array(sampling.bootstrap_limits(), dtype=np.int64)
    key = np.array([0, 1, 5, sampling.PRIME - 1, *range(10**9, 10**9 + 300)], dtype=np.int64)
    plain = np.searchsorted(limits, (key[:, None] * a + b) % sampling.PRIME, side="right")
    assert (sampling.bootstrap_weights(key, a, b, limits) == plain).all()

    data = [(k % 3 and f"m{k % 3}", k // 3, None if k == 7 else float(k % 11)) for k in range(900)] + [("m1", 4, 2.0)]
    df = spark.createDataFrame([(str(m) if m else None, i, x) for m, i, x in data], "model string, id bigint, x double").coalesce(1)
    hashed = {r["id"]: r["k"] for r in df.select("id", F.pmod(sampling.hash_key("id", 42), F.lit(sampling.PRIME)).alias("k")).distinct().collect()}
    expected = {}
    for m, i, x in data:
        if x is not None:
            weight = np.searchsorted(limits, (hashed[i] * a + b) % sampling.PRIME, side="right")
            total = expected.setdefault(str(m) if m else None, np.zeros((2, 40)))
            total += [weight, weight * x]
    got = sampling.bootstrap_sums(df, "x", "id", ["model"], 40).collect()
    assert len(got) == 40 * len(expected)
    for row in got:
        assert [row["weight"], row["total"]] == pytest.approx(expected[row["model"]][:, row["replicate"] - 1].tolist())
