"""Summaries over metric tables (one row per model, experiment or seed)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leaderboard(metrics: DataFrame, by: str = "mae", name: str = "model_name", descending: bool = False) -> DataFrame:
    return metrics.orderBy(F.desc(by) if descending else F.asc(by), name)


def best_models(metrics: DataFrame, k: int, by: str = "cv_mae_mean", exclude: Sequence[str] = ("mean_baseline",)) -> DataFrame:
    return metrics.filter(~F.col("model_name").isin(*exclude)).orderBy(by, "model_name").limit(k)


def best_model(metrics: DataFrame, by: str = "mae", exclude: Sequence[str] = ()) -> DataFrame:
    kept = metrics.filter(~F.col("model_name").isin(*exclude)) if exclude else metrics
    return kept.agg(F.min_by("model_name", F.struct(by, "model_name")).alias("model_name"), F.min(by).alias(by))


def with_seed_rank(metrics: DataFrame, seed: str = "seed", by: str = "mae") -> DataFrame:
    """Rank within a seed; equal values share the smaller rank."""
    return metrics.withColumn("seed_rank", F.rank().over(Window.partitionBy(seed).orderBy(by)))


def seed_summary(metrics: DataFrame, seed: str = "seed") -> DataFrame:
    """model_name with mean, sample std, min and max MAE, mean R2, mean rank, wins and seeds."""
    return with_seed_rank(metrics, seed).groupBy("model_name").agg(
        F.avg("mae").alias("mae_mean"), F.stddev_samp("mae").alias("mae_std"), F.min("mae").alias("mae_min"),
        F.max("mae").alias("mae_max"), F.avg("r2").alias("r2_mean"), F.avg("seed_rank").alias("mean_rank"),
        F.count_if(F.col("seed_rank") == 1).alias("wins"), F.count_distinct(seed).alias("seeds"),
    )


def cost_table(events: DataFrame, baseline: str, rows: int) -> DataFrame:
    """Latency per row, training cost and accuracy gain relative to one baseline model."""
    base = events.filter(F.col("model_name") == baseline)
    base_train = base.agg(F.max("train_seconds")).scalar()
    base_mae = base.agg(F.max("mae")).scalar()
    return events.select(
        "model_name", "mae", "train_seconds", "predict_seconds",
        (F.col("predict_seconds") * 1000.0 / F.lit(rows)).alias("latency_ms_per_row"),
        (F.col("train_seconds") / base_train).alias("relative_train_cost"),
        ((base_mae - F.col("mae")) / base_mae * 100.0).alias("mae_gain_percent"),
    )


def delta_to_previous(metrics: DataFrame, previous: DataFrame, columns: Sequence[str] = ("mae", "r2"), key: str = "model_name") -> DataFrame:
    """Adds <column>_delta against a named earlier value; models without one keep null."""
    before = previous.select(key, *[F.col(c).alias(f"_p_{c}") for c in columns])
    joined = metrics.join(before, key, "left")
    return joined.withColumns({f"{c}_delta": F.col(c) - F.col(f"_p_{c}") for c in columns}).drop(*[f"_p_{c}" for c in columns])


def method_contrast(results: DataFrame, group: str, method: str, first: str, second: str, value: str = "mae") -> DataFrame:
    """One row per group that has exactly one row of each method: both values and first - second."""
    def count(name: str):
        return F.count_if(F.col(method) == name)

    def pick(name: str):
        return F.max(F.when(F.col(method) == name, F.col(value)))

    wide = results.groupBy(group).agg(
        count(first).alias("_n1"), count(second).alias("_n2"), pick(first).alias(f"{first}_{value}"), pick(second).alias(f"{second}_{value}")
    )
    kept = wide.filter((F.col("_n1") == 1) & (F.col("_n2") == 1)).drop("_n1", "_n2")
    return kept.withColumn("delta", F.col(f"{first}_{value}") - F.col(f"{second}_{value}"))


def experiment_summary(metrics: DataFrame, baseline_mae: float, separator: str = "__") -> DataFrame:
    """Best model per experiment (name before the separator) and its distance to a baseline."""
    named = metrics.withColumns(
        {
            "experiment": F.split_part("model_name", F.lit(separator), F.lit(1)),
            "model": F.split_part("model_name", F.lit(separator), F.lit(2)),
        }
    )
    best = named.groupBy("experiment").agg(
        F.min_by("model", F.struct("mae", "model")).alias("best_model"), F.min("mae").alias("mae"),
        F.min_by("r2", F.struct("mae", "model")).alias("r2"), F.count("*").alias("models"),
    )
    return best.withColumn("delta_to_baseline", F.col("mae") - F.lit(baseline_mae))


def delta_to_first(df: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """Adds delta_<column> against the first row of a short ordered table."""
    window = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({f"delta_{c}": F.col(c) - F.first(c).over(window) for c in columns})


def matching_rows(df: DataFrame, column: str, patterns: Sequence[str] = (), values: Sequence[str] = ()) -> DataFrame:
    """Rows whose column matches any pattern or equals any value."""
    keep = F.col(column).isin(*values) if values else F.lit(False)
    for pattern in patterns:
        keep = keep | F.col(column).rlike(pattern)
    return df.filter(keep)


def top_rows(df: DataFrame, by: str, k: int, tie: str, absolute: bool = False) -> DataFrame:
    order = F.abs(F.col(by)) if absolute else F.col(by)
    return df.orderBy(order.desc(), tie).limit(k)


def top_per_group(df: DataFrame, group: str, by: str, k: int, tie: str) -> DataFrame:
    window = Window.partitionBy(group).orderBy(F.desc(by), tie)
    return df.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= k)
