"""Published aggregates recomputed from published inputs (numbers transcribed)."""

import math

import pytest
from pyspark.sql import functions as F

from hearthline.operators import agreement, errors, leaderboards, pairs
from hearthline.operators.pairs import normal_p, signed_rank_z, student_p


def test_student_and_wilcoxon_tails(spark):
    rows = [
        (1383, 3.3851938517637308, 0.0007312214216851326, 418824.0, 5.859599561837357e-05),
        (1383, 4.557969362725783, 5.621221286492483e-06, 405972.0, 1.0419426036838876e-06),
        (1383, -5.50563663373393, 4.379763168051239e-08, 396625.0, 3.5325993572534916e-08),
        (1383, 1.4569962608006812, 0.14534457792085131, 453522.0, 0.09244389264207846),
        (1383, -0.3654554719617246, 0.7148273645544289, 474817.5, 0.803279618497667),
    ]
    df = spark.createDataFrame(rows, "n bigint, t double, t_p double, w double, w_p double")
    total = F.col("n") * (F.col("n") + 1) / 2
    tested = df.withColumns({"n_used": F.col("n"), "w_plus": F.col("w"), "w_minus": total - F.col("w"), "tie_sum": F.lit(0.0), "zero_count": F.lit(0)})
    got = tested.withColumn("z", signed_rank_z()).select("t_p", "w_p", student_p("t", "n").alias("a"), normal_p("z").alias("b")).collect()
    for row in got:
        assert row["a"] == pytest.approx(row["t_p"], rel=1e-9)
        assert row["b"] == pytest.approx(row["w_p"], rel=1e-6)


HOLM = [
    ("a", 0.7276173271926327, 0.8207683184331885), ("b", 5.102056943418599e-08, 4.081645554734879e-07),
    ("c", 1.880704313949471e-15, 2.0687747453444184e-14), ("d", 1.5034337047373254e-25, 2.255150557105988e-24),
    ("e", 2.268770791900442e-23, 3.1762791086606186e-22), ("f", 1.450375233150144e-05, 0.00010152626632051008),
    ("g", 3.124774617789011e-11, 3.1247746177890107e-10), ("h", 7.358911998758987e-11, 6.623020798883088e-10),
    ("i", 1.930762131676552e-16, 2.3169145580118622e-15), ("j", 0.0052302170361462836, 0.020920868144585134),
    ("k", 0.013570533971044617, 0.04071160191313385), ("l", 1.0272542962242073e-17, 1.3354305850914695e-16),
    ("m", 0.41038415921659427, 0.8207683184331885), ("n", 0.0036461198440542984, 0.018230599220271492),
    ("o", 8.495207938971714e-05, 0.0005097124763383028),
]


def test_holm(spark):
    df = spark.createDataFrame(HOLM, "name string, p double, want double")
    for row in pairs.holm(df, "p", "adjusted", ["name"]).collect():
        assert row["adjusted"] == pytest.approx(row["want"], rel=1e-12)
        assert row["adjusted"] >= row["p"]


def test_kappa(spark):
    rows = [
        ("below_market", 0, 0, 18, 7122, 0.997479, 0.0), ("board_building", 24, 2, 12, 7102, 0.998039, 0.773235),
        ("bus_hub", 0, 1083, 0, 6057, 0.848319, 0.0), ("direct_seller", 25, 5, 138, 6972, 0.979972, 0.253771),
        ("double_bath", 864, 710, 1262, 4304, 0.723810, 0.286194), ("never", 0, 0, 0, 50, 1.0, None),
    ]
    df = spark.createDataFrame(rows, "label string, n11 bigint, n10 bigint, n01 bigint, n00 bigint, want double, k double")
    for row in df.withColumns(agreement.agreement_statistics()).collect():
        assert row["agreement"] == pytest.approx(row["want"], abs=1e-6)
        assert row["kappa"] == (pytest.approx(row["k"], abs=1e-6) if row["k"] is not None else None)


def test_seed_summary(spark):
    rows = [
        (7, "stacking_ridge", 20.852870593145582, 0.3028446977994199), (7, "two_stage_residual", 20.953482009171143, 0.29201327767790675), (7, "catboost", 21.795344217921503, 0.2531532208783013),
        (21, "stacking_ridge", 20.64768961531967, 0.3106326337170463), (21, "catboost", 21.7316328309253, 0.25079875490321635), (21, "two_stage_residual", 21.785941822244542, 0.23876669554169438),
        (84, "stacking_ridge", 20.67805371904453, 0.3096990851025513), (84, "catboost", 21.02427777429878, 0.29759099156877744), (84, "two_stage_residual", 21.850279145553962, 0.23723200422336566),
        (168, "stacking_ridge", 20.205200888101132, 0.3321571376861775), (168, "two_stage_residual", 20.913045877017918, 0.30238464011867283), (168, "catboost", 21.605340096991675, 0.2619293265462199),
        (42, "two_stage_residual", 20.41957944835916, 0.3162809938716954), (42, "stacking_ridge", 20.493576857966044, 0.31859280288289427), (42, "catboost", 21.403880511989342, 0.26904642256079103),
    ]
    got = {r["model_name"]: r for r in leaderboards.seed_summary(spark.createDataFrame(rows, "seed int, model_name string, mae double, r2 double")).collect()}
    best = got["stacking_ridge"]
    assert best["mae_mean"] == pytest.approx(20.575478334715392, rel=1e-9) and best["mae_std"] == pytest.approx(0.24315421182795025, rel=1e-6)
    assert (best["mean_rank"], best["wins"], best["seeds"]) == (pytest.approx(1.2), 4, 5)
    assert got["two_stage_residual"]["mae_std"] == pytest.approx(0.6158640746131583, rel=1e-6) and got["two_stage_residual"]["wins"] == 1
    assert got["catboost"]["r2_mean"] == pytest.approx(0.26650374329146115, rel=1e-6)


def test_cost_table(spark):
    rows = [("catboost", 21.403880511989342, 5.145339499998954, 0.015030499998829328), ("stacking_ridge", 20.493576857966044, 107.2944065000047, 0.1024226000008639), ("lightgbm", 21.86119897776148, 3.9926891999930376, 0.01867429999401793)]
    got = {r["model_name"]: r for r in leaderboards.cost_table(spark.createDataFrame(rows, "model_name string, mae double, train_seconds double, predict_seconds double"), "catboost", 1383).collect()}
    assert got["stacking_ridge"]["relative_train_cost"] == pytest.approx(20.852736053670803)
    assert got["stacking_ridge"]["latency_ms_per_row"] == pytest.approx(0.07405827910402306)
    assert got["lightgbm"]["relative_train_cost"] == pytest.approx(0.7759816820627383)


def test_method_contrast(spark):
    rows = [("full", "stacking", 20.493576857966044), ("full", "voting", 22.35219200539636), ("without_catboost", "stacking", 20.970342698657664), ("without_catboost", "voting", 22.59973636119481), ("odd", "voting", 1.0), ("twice", "voting", 1.0), ("twice", "voting", 2.0), ("twice", "stacking", 2.0)]
    out = leaderboards.method_contrast(spark.createDataFrame(rows, "combination string, method string, mae double"), "combination", "method", "voting", "stacking")
    assert {r["combination"]: r["delta"] for r in out.collect()} == {"full": pytest.approx(1.8586151474303172), "without_catboost": pytest.approx(1.6293936625371472)}


def test_deltas_and_ceiling(spark):
    rows = [(0, "raw", 28.464897174108927, -0.2976783494079136), (1, "base", 25.035005644324453, 0.02974375315206701), (2, "stage3", 22.901699204971774, 0.17512635632786155)]
    df = spark.createDataFrame(rows, "step int, feature_set string, mae double, r2 double")
    got = {r["feature_set"]: r for r in leaderboards.delta_to_first(df, "step", ["mae", "r2"]).collect()}
    assert got["base"]["delta_r2"] == pytest.approx(0.3274221025599806) and got["stage3"]["delta_mae"] == pytest.approx(-5.563197969137153)
    summary = spark.createDataFrame([(214, 156, 0.21065616087320221)], "cells bigint, above_15 bigint, median_cv double")
    ceiling = errors.information_ceiling(summary, 0.30586988768649703, 0.02974375315206701, 0.17512635632786155).first()
    assert ceiling["high_dispersion_share"] == pytest.approx(0.7289719626168224) and ceiling["estimated_ceiling"] == pytest.approx(0.41768, abs=1e-4)


def test_variance_decomposition_identity(spark):
    assert 5524492.688806 / 8395272.703602 == pytest.approx(0.658048, abs=1e-6)
    rows = [("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 7.0), ("b", 6.0), ("c", 3.0), (None, 9.0), ("c", None)]
    row = errors.variance_decomposition(spark.createDataFrame(rows, "g string, y double"), "g", "y").first()
    values = {"a": [1, 2], "b": [5, 7, 6], "c": [3]}
    flat = [y for v in values.values() for y in v]
    mean = sum(flat) / len(flat)
    sst = sum((y - mean) ** 2 for y in flat)
    ssb = sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in values.values())
    n0 = (6 - (4 + 9 + 1) / 6) / 2
    msb, msw = ssb / 2, (sst - ssb) / 3
    assert (row["n_rows"], row["n_groups"]) == (6, 3) and row["sst"] == pytest.approx(sst) and row["ssb"] == pytest.approx(ssb)
    assert row["icc"] == pytest.approx((msb - msw) / (msb + (n0 - 1) * msw)) and row["ssb"] + row["ssw"] == pytest.approx(row["sst"])


def test_skew_is_bias_adjusted(spark):
    xs = [1.0, 2.0, 3.0, 10.0]
    row = errors.describe_columns(spark.createDataFrame([(x,) for x in xs], "x double"), ["x"]).first()
    n, m = 4, 4.0
    m2, m3 = sum((x - m) ** 2 for x in xs) / n, sum((x - m) ** 3 for x in xs) / n
    assert row["skew"] == pytest.approx(m3 / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2)) and row["p25"] == pytest.approx(1.75)


def test_signed_ranks_by_hand(spark):
    diffs = [1.0, -1.0, 2.0, 0.0, 3.0, 0.0, -4.0]
    df = spark.createDataFrame([("a", "b", i, d) for i, d in enumerate(diffs)], "model_a string, model_b string, house_id int, diff double")
    drop = pairs.signed_ranks(df).first()
    assert (drop["n_used"], drop["w_plus"], drop["w_minus"], drop["tie_sum"]) == (5, 1.5 + 3 + 4, 1.5 + 5, 6.0)
    split = pairs.signed_ranks(df, zero_method="zsplit").first()
    assert (split["n_used"], split["zero_count"]) == (7, 2) and split["w_plus"] + split["w_minus"] == 28
    assert split["w_plus"] == 3.5 + 5 + 6 + 1.5
