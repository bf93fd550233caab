"""Order statistics against brute force, with the small-group shortcut switched off as well."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearthline.functions.hashing import hash_key
from hearthline.operators import ranking

PROBS = {"p0": 0.0, "p01": 0.01, "p33": 0.33, "p50": 0.5, "p99": 0.99, "p100": 1.0}


@pytest.fixture(scope="module")
def skewed():
    """One group holds most rows, one value a third of them, and there are nulls and tiny groups."""
    rng = np.random.default_rng(7)
    n = 6000
    value = np.round(rng.lognormal(3, 1, n), 2)
    value[rng.random(n) < 0.33] = 17.0
    frame = pd.DataFrame({"id": np.arange(n), "g": np.where(rng.random(n) < 0.8, "hot", rng.choice(list("abc"), n)), "v": value})
    frame.loc[rng.random(n) < 0.05, "v"] = np.nan
    tail = pd.DataFrame({"id": [n, n + 1, n + 2], "g": ["one", None, "none"], "v": [5.0, 6.0, np.nan]})
    return pd.concat([frame, tail], ignore_index=True)


def to_spark(spark, frame):
    rows = [tuple(None if pd.isna(x) else x for x in r) for r in frame.itertuples(index=False, name=None)]
    return spark.createDataFrame([(int(i), g, v) for i, g, v in rows], "id bigint, g string, v double").repartition(5)


@pytest.mark.parametrize("small,accuracy", [(20_000, 50_000), (100, 200)])
def test_grouped_quantiles(spark, skewed, monkeypatch, small, accuracy):
    monkeypatch.setattr(ranking, "SMALL_GROUP", small)
    got = {r["g"]: r for r in ranking.exact_quantiles(to_spark(spark, skewed), "v", PROBS, by=["g"], accuracy=accuracy).collect()}
    groups = {k if isinstance(k, str) else None: d["v"].dropna() for k, d in skewed.groupby("g", dropna=False)}
    assert set(got) == {k for k, d in groups.items() if len(d)}
    for key, row in got.items():
        assert row["n_values"] == len(groups[key])
        for name, p in PROBS.items():
            assert row[name] == pytest.approx(groups[key].quantile(p), rel=1e-12)


@pytest.mark.parametrize("small,accuracy", [(20_000, 50_000), (100, 200)])
def test_global_quantiles_and_bounds(spark, skewed, monkeypatch, small, accuracy):
    monkeypatch.setattr(ranking, "SMALL_GROUP", small)
    df = to_spark(spark, skewed)
    row = ranking.exact_quantiles(df, "v", PROBS, accuracy=accuracy).first()
    bounds = ranking.quantile_bounds(df, ["v", "id"], PROBS, accuracy)
    for name, p in PROBS.items():
        assert row[name] == pytest.approx(skewed["v"].quantile(p), rel=1e-12)
        assert bounds["v"][name] == pytest.approx(skewed["v"].quantile(p), rel=1e-12)
        assert bounds["id"][name] == pytest.approx(skewed["id"].quantile(p), rel=1e-12)


def test_brackets_are_narrowed_and_widened(spark, skewed, monkeypatch):
    df = to_spark(spark, skewed)
    monkeypatch.setattr(ranking, "SMALL_GROUP", 50)
    column = next(c for c, t in df.dtypes if t == "double")
    for most, wider in ((2_000_000, (1, None)), (40, (1, 20, None)), (40, (0, None))):
        monkeypatch.setattr(ranking, "MOST_INSIDE", most)
        monkeypatch.setattr(ranking, "WIDER", wider)
        got = ranking.exact_quantiles(df, column, {"low": 0.01, "mid": 0.5, "high": 0.99}, accuracy=100).first()
        want = skewed[column].dropna().quantile([0.01, 0.5, 0.99]).tolist()
        assert [got["low"], got["mid"], got["high"]] == pytest.approx(want, rel=1e-12)


def test_rows_are_not_exchanged_on_the_group(spark, skewed):
    rows = to_spark(spark, skewed).select("g", F.col("v").alias("_v"))
    plan = ranking._bracketed_counts(rows, ["g"], [0.5], 1000)._jdf.queryExecution().sparkPlan().toString()
    joined = plan[plan.index("BroadcastHashJoin") :]
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in joined


def test_bounds_of_an_all_null_column(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert ranking.quantile_bounds(df, ["a", "b"], {"m": 0.5}) == {"a": {"m": None}, "b": {"m": 1.5}}


@pytest.mark.parametrize("rank", [1, 200, 3000, 5999])
def test_order_cutoff_with_ties_and_nulls(spark, skewed, monkeypatch, rank):
    monkeypatch.setattr(ranking, "SMALL_GROUP", 100)
    keep = ranking.order_cutoff(to_spark(spark, skewed), F.col("v"), "id", rank, len(skewed), int(skewed["v"].isna().sum()))
    got = {r["id"] for r in to_spark(spark, skewed).filter(keep).select("id").collect()}
    want = skewed.sort_values(["v", "id"], na_position="first").head(rank)["id"]
    assert got == set(want)


def test_positions_and_average_ranks(spark, skewed):
    df = to_spark(spark, skewed)
    placed = ranking.positions(df.select("id", "g", "v"), ["v", "id"], by=["g"]).toPandas()
    want = skewed.sort_values(["g", "v", "id"], na_position="first")
    want["position"] = want.groupby("g", dropna=False).cumcount() + 1
    merged = placed.merge(want, on="id")
    assert (merged["position_x"] == merged["position_y"]).all() and len(merged) == len(skewed)
    ranks = ranking.average_ranks(df.filter("v is not null and g = 'hot'"), "v").toPandas().set_index("v")["avg_rank"]
    hot = skewed[(skewed["g"] == "hot") & skewed["v"].notna()]
    assert np.allclose(hot["v"].map(ranks), hot["v"].rank())


def test_lowest_hash_cutoffs(spark):
    df = spark.range(20_000).withColumn("g", F.when(F.col("id") < 15_000, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))))
    quotas = df.groupBy("g").agg(F.count("*").alias("_size")).withColumn("_quota", F.floor(F.col("_size") * 0.4) + 1)
    cuts = ranking.lowest_hash_cutoffs(df, "id", 5, quotas, ["g"])
    key = hash_key("id", 5)
    kept = df.join(cuts, "g").filter((key < F.col("_cut_hash")) | ((key == F.col("_cut_hash")) & (F.col("id") <= F.col("_cut_id"))))
    counts = {r["g"]: r["count"] for r in kept.groupBy("g").count().collect()}
    assert counts == {r["g"]: r["_quota"] for r in quotas.collect()}


def test_null_keys_meet_null_keys(spark):
    left = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "z")], "i int, k string")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, x int")
    assert sorted((r["i"], r["x"]) for r in ranking.null_safe_join(left, right, ["k"]).collect()) == sorted([(1, 10), (2, 20), (3, 10), (4, None)], key=lambda t: t[0])
