"""Paired significance tests over a long prediction table.

Row-level work (differences, ranks, sums) is a set of distributed aggregates; the tail probabilities need only the
resulting pair table, whose size is the number of model pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.operators.ranking import average_ranks
from hearthline.operators.sampling import bootstrap_mean_ci


def model_pairs(predictions: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = (), key: str = "house_id") -> DataFrame:
    """by + model_a, model_b, key, diff: one row per pair and listing where both models are present.

    The table is pivoted to one column per model, so rows meet their partners without a self-join.
    """
    models = sorted({m for pair in pairs for m in pair})
    keys = [*by, key]
    wide = predictions.groupBy(*keys).agg(
        *[F.max(F.when(F.col("model_name") == m, F.col("absolute_error_wan"))).alias(m) for m in models]
    )
    items = F.array(
        *[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), (F.col(a) - F.col(b)).alias("diff")) for a, b in pairs]
    )
    long = wide.select(*keys, F.explode(items).alias("p"))
    return long.select(*by, "p.model_a", "p.model_b", key, "p.diff").filter(F.col("diff").isNotNull())


def all_pairs(models: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(sorted(models), 2))


def paired_t(diffs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by + pair: n, mean_diff, t_statistic."""
    spread = F.stddev_samp("diff") / F.sqrt(F.count("diff").cast("double"))
    return diffs.groupBy(*by, "model_a", "model_b").agg(
        F.count("diff").alias("n"), F.avg("diff").alias("mean_diff"), F.when(spread > 0, F.avg("diff") / spread).alias("t_statistic")
    )


def signed_ranks(diffs: DataFrame, by: Sequence[str] = (), zero_method: str = "wilcox", digits: int | None = None) -> DataFrame:
    """by + pair: n_used, w_plus, w_minus, tie_sum (sum of t^3 - t), zero_count.

    ``wilcox`` drops zero differences; ``zsplit`` ranks them and gives half of their ranks to each side.
    ``digits`` rounds differences first, so that values equal but for the last bits tie.
    """
    if zero_method not in ("wilcox", "zsplit"):
        raise ValueError("zero_method must be 'wilcox' or 'zsplit'")
    keys = [*by, "model_a", "model_b"]
    diff = F.col("diff") if digits is None else F.round("diff", digits)
    rows = diffs.select(*keys, diff.alias("diff"))
    if zero_method == "wilcox":
        rows = rows.filter(F.col("diff") != 0)
    sized = rows.select(*keys, F.abs("diff").alias("size"), F.signum("diff").alias("sign"))
    ranks = average_ranks(sized, "size", by=keys, extra={"up": F.count_if(F.col("sign") > 0), "down": F.count_if(F.col("sign") < 0)})
    level = F.col("ties") - F.col("up") - F.col("down")
    t = F.col("ties").cast("double")
    return ranks.groupBy(*keys).agg(
        F.sum("ties").alias("n_used"),
        F.sum(F.col("avg_rank") * (F.col("up") + level / 2.0)).alias("w_plus"),
        F.sum(F.col("avg_rank") * (F.col("down") + level / 2.0)).alias("w_minus"),
        F.sum(F.when(F.col("size") > 0, t * t * t - t).otherwise(F.lit(0.0))).alias("tie_sum"),
        F.sum(level).alias("zero_count"),
    )


def signed_rank_z() -> Column:
    """Normal approximation without continuity correction; zero ranks leave the tie term like any other tie."""
    n = F.col("n_used").cast("double")
    zeros = F.col("zero_count").cast("double")
    ties = F.col("tie_sum") + (zeros * zeros * zeros - zeros)
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0
    centre = n * (n + 1) / 4.0
    return F.when(variance > 0, (F.least("w_plus", "w_minus") - centre) / F.sqrt(variance))


def _student_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t by the continued fraction of the incomplete beta function."""
    if t is None or math.isnan(t) or df <= 0:
        return math.nan
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    if x <= 0.0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            c = 1.0 + numerator / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            break
    return value


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a paired t statistic over n pairs; used on pair tables only."""
    return pd.Series([_student_tail(a, b - 1) for a, b in zip(t.astype(float), n.astype(float))])


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided normal tail; used on pair tables only."""
    return z.astype(float).map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)))


def holm(df: DataFrame, p: str, name: str, tie: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p values over a small table of tests."""
    order = [F.col(p).asc(), *[F.col(c) for c in tie]]
    family = Window.partitionBy(*by)
    ordered = df.withColumn("_m", F.count(p).over(family)).withColumn("_rk", F.row_number().over(family.orderBy(*order)))
    step = F.least((F.col("_m") - F.col("_rk") + 1) * F.col(p), F.lit(1.0))
    running = family.orderBy("_rk").rowsBetween(Window.unboundedPreceding, 0)
    return ordered.withColumn("_s", step).withColumn(name, F.max("_s").over(running)).drop("_m", "_rk", "_s")


def significance(diffs: DataFrame, by: Sequence[str] = (), zero_method: str = "wilcox", level: float = 0.05, digits: int | None = None) -> DataFrame:
    """Both tests with raw and adjusted p per pair; significant when both adjusted p fall below ``level``."""
    keys = [*by, "model_a", "model_b"]
    tested = paired_t(diffs, by).join(signed_ranks(diffs, by, zero_method, digits), keys, "left")
    tested = tested.withColumn("z_statistic", signed_rank_z())
    tested = tested.withColumn("t_p", student_p("t_statistic", "n")).withColumn("wilcoxon_p", normal_p("z_statistic"))
    tested = holm(tested, "t_p", "t_p_holm", keys, by)
    tested = holm(tested, "wilcoxon_p", "wilcoxon_p_holm", keys, by)
    return tested.withColumn("significant", (F.col("t_p_holm") < level) & (F.col("wilcoxon_p_holm") < level))


def reference_significance(predictions: DataFrame, reference: str, baselines: Sequence[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Each baseline against one reference model, with a bootstrap interval of the mean difference."""
    diffs = model_pairs(predictions, [(b, reference) for b in baselines])
    tests = significance(diffs, zero_method="zsplit")
    interval = bootstrap_mean_ci(diffs, "diff", "house_id", ["model_a", "model_b"], replicates, seed).drop("mean")
    return tests.join(interval, ["model_a", "model_b"])


def seed_comparison(predictions: DataFrame, first: str, second: str, seed: str = "seed") -> DataFrame:
    """Per seed: MAE of two variants paired on listing id, their difference and the paired t statistic."""
    diffs = model_pairs(predictions, [(first, second)], by=[seed])
    return paired_t(diffs, [seed])

