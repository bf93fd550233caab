"""Key-set operators: resume, reconciliation, referential checks and lookups with fallback chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.operators.ranking import null_safe_join


def unseen(candidates: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not processed yet."""
    return candidates.join(seen.select(key), key, "left_anti")


def referenced(df: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    return df.join(targets.select(key), key, "left_semi")


def reconcile_keys(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, status in {missing, extra} for keys on one side only."""
    left = expected.select(key).distinct().withColumn("_e", F.lit(True))
    right = actual.select(key).distinct().withColumn("_a", F.lit(True))
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra")
    return left.join(right, key, "full_outer").select(key, status.alias("status")).filter(F.col("status").isNotNull())


def attach_labels(df: DataFrame, labels: DataFrame, rule_labels: DataFrame, key: str) -> DataFrame:
    """Left-joins two label tables; names in both get the suffix _rule on the rule side; gaps become 0."""
    annotated = [c for c in labels.columns if c != key]
    clashes = {c: f"{c}_rule" for c in rule_labels.columns if c in annotated}
    rules = rule_labels.withColumnsRenamed(clashes)
    joined = df.join(labels, key, "left").join(rules, key, "left")
    filled = annotated + [c for c in rules.columns if c != key]
    return joined.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in filled})


def group_mean_baseline(train: DataFrame, test: DataFrame, chain: Sequence[str], target: str) -> DataFrame:
    """Predicts the mean of the first group in ``chain`` seen in training, else the training mean.

    Adds prediction and fallback_level (0 = first group, len(chain) = global). Means are partial aggregates, so a hot
    group costs one row per task; null groups never match.
    """
    out = test
    for i, group in enumerate(chain):
        means = train.filter(F.col(group).isNotNull()).groupBy(group).agg(F.avg(target).alias(f"_m{i}"))
        out = out.join(means, group, "left")
    overall = train.agg(F.avg(target).alias("m")).first()["m"]
    levels = [F.col(f"_m{i}") for i in range(len(chain))]
    level = F
    for i, mean in enumerate(levels):
        level = level.when(mean.isNotNull(), F.lit(i))
    return out.withColumns(
        {"prediction": F.coalesce(*levels, F.lit(overall)), "fallback_level": level.otherwise(F.lit(len(chain)))}
    ).drop(*[f"_m{i}" for i in range(len(chain))])


def compare_summaries(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Outer comparison: per column the largest absolute difference and its key, plus keys on one side only."""
    left = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns]).withColumn("_l", F.lit(1))
    right = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns]).withColumn("_r", F.lit(1))
    joined = null_safe_join_outer(left, right, key)
    items = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.abs(F.col(f"_o_{c}") - F.col(f"_n_{c}")).alias("diff")) for c in columns]
    )
    long = joined.select(key, (F.col("_l").isNull() | F.col("_r").isNull()).alias("one_sided"), F.explode(items).alias("i"))
    return long.groupBy(F.col("i.column_name").alias("column_name")).agg(
        F.max("i.diff").alias("max_abs_diff"),
        F.max_by(key, F.struct(F.col("i.diff"), F.col(key))).alias("worst_key"),
        F.count_if("one_sided").alias("one_sided_keys"),
    )


def null_safe_join_outer(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    renamed = right.withColumnRenamed(key, "_key")
    joined = left.join(renamed, F.col(key).eqNullSafe(F.col("_key")), "full_outer")
    return joined.withColumn(key, F.coalesce(F.col(key), F.col("_key"))).drop("_key")


def lookup(df: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    return null_safe_join(df, reference, keys, "left")
