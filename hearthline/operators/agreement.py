"""Label prevalence and annotator agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.operators.ranking import exact_quantiles


def long_labels(df: DataFrame, key: str, labels: Sequence[str], value: str = "value") -> DataFrame:
    """key, label, value."""
    items = F.array(*[F.struct(F.lit(name).alias("label"), F.col(name).cast("int").alias(value)) for name in labels])
    return df.select(key, F.explode(items).alias("i")).select(key, "i.label", f"i.{value}")


def label_prevalence(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """label, n, positives, rate; one pass over the wide table."""
    wide = df.agg(F.count("*").alias("_n"), *[F.sum(F.coalesce(F.col(c).cast("bigint"), F.lit(0))).alias(f"_p{i}") for i, c in enumerate(labels)])
    items = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"_p{i}").alias("positives")) for i, c in enumerate(labels)])
    return wide.select("_n", F.explode(items).alias("i")).select(
        "i.label", F.col("_n").alias("n"), "i.positives", (F.col("i.positives") / F.col("_n")).alias("rate")
    )


def kappa(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Chance-corrected agreement; undefined (null) when chance agreement is total."""
    n = (n11 + n10 + n01 + n00).cast("double")
    observed = (n11 + n00) / n
    chance = ((n11 + n10) / n) * ((n11 + n01) / n) + ((n01 + n00) / n) * ((n10 + n00) / n)
    return F.when(F.lit(1.0) - chance >= 1e-12, (observed - chance) / (F.lit(1.0) - chance))


def agreement_statistics() -> dict[str, Column]:
    """Columns derived from n11, n10, n01, n00."""
    n11, n10, n01, n00 = (F.col(c) for c in ("n11", "n10", "n01", "n00"))
    n = n11 + n10 + n01 + n00
    return {
        "agreement": (n11 + n00) / n,
        "disagreement": (n10 + n01) / n,
        "rate_a": (n11 + n10) / n,
        "rate_b": (n11 + n01) / n,
        "kappa": kappa(n11, n10, n01, n00),
    }


def paired_tables(pairs: DataFrame, labels: Sequence[str], suffix_a: str, suffix_b: str, by: Sequence[str] = ()) -> DataFrame:
    """Per label (and group) the 2x2 counts of two annotators, from one aggregate over the joined wide table.

    Rows in which either side is null do not count.
    """
    cells = []
    for i, name in enumerate(labels):
        a, b = F.col(f"{name}{suffix_a}").cast("int"), F.col(f"{name}{suffix_b}").cast("int")
        for code, left, right in (("n11", 1, 1), ("n10", 1, 0), ("n01", 0, 1), ("n00", 0, 0)):
            cells.append(F.count_if((a == left) & (b == right)).alias(f"{code}_{i}"))
    wide = pairs.groupBy(*by).agg(*cells)
    items = F.array(
        *[
            F.struct(F.lit(name).alias("label"), *[F.col(f"{code}_{i}").alias(code) for code in ("n11", "n10", "n01", "n00")])
            for i, name in enumerate(labels)
        ]
    )
    return wide.select(*by, F.explode(items).alias("i")).select(*by, "i.*")


def label_agreement(pairs: DataFrame, labels: Sequence[str], suffix_a: str, suffix_b: str, by: Sequence[str] = ()) -> DataFrame:
    return paired_tables(pairs, labels, suffix_a, suffix_b, by).withColumns(agreement_statistics())


def agreement_summary(per_label: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, lowest and highest kappa and mean disagreement over labels; undefined kappas do not count."""
    return per_label.groupBy(*by).agg(
        F.count("*").alias("labels"), F.avg("kappa").alias("mean_kappa"), F.percentile("kappa", 0.5).alias("median_kappa"),
        F.min("kappa").alias("min_kappa"), F.max("kappa").alias("max_kappa"), F.avg("disagreement").alias("mean_disagreement"),
    )


def config_evaluation(answers: DataFrame, labels: Sequence[str], by: str = "config") -> DataFrame:
    """Per annotation set-up: rows, parse rate, coverage and positives over parsed rows."""
    positives = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in labels), F.lit(0))
    return answers.withColumn("_pos", F.when(F.col("parse_ok"), positives)).groupBy(by).agg(
        F.count("*").alias("n"), F.avg(F.col("parse_ok").cast("int")).alias("parse_ok_rate"),
        F.avg((F.col("_pos") > 0).cast("int")).alias("coverage"), F.avg("_pos").alias("mean_positives"),
    )


def parse_report(answers: DataFrame, expected: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """One row: answers, parse errors, missing and extra keys, coverage and positives."""
    positives = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in labels), F.lit(0))
    have = answers.select(key, "parse_ok", positives.alias("_pos")).withColumn("_a", F.lit(1))
    want = expected.select(key).distinct().withColumn("_e", F.lit(1))
    return have.join(want, key, "full_outer").agg(
        F.count_if(F.col("_e").isNotNull()).alias("expected"),
        F.count_if(F.col("_a").isNotNull()).alias("answered"),
        F.count_if(F.col("_a").isNull()).alias("missing"),
        F.count_if(F.col("_e").isNull()).alias("extra"),
        F.count_if(~F.col("parse_ok")).alias("parse_errors"),
        F.avg(F.when(F.col("parse_ok"), (F.col("_pos") > 0).cast("int"))).alias("coverage"),
        F.avg(F.when(F.col("parse_ok"), F.col("_pos"))).alias("mean_positives"),
    )


def disagreement_profile(
    pairs: DataFrame, labels: Sequence[str], suffix_a: str, suffix_b: str, price: str, region: str, top_labels: int = 5, top_regions: int = 3
) -> DataFrame:
    """For the labels with most disagreement: median price of disagreeing rows and of all rows, and their top regions."""
    ranked = label_agreement(pairs, labels, suffix_a, suffix_b).orderBy(F.desc("disagreement"), "label").limit(top_labels)
    items = F.array(
        *[F.struct(F.lit(c).alias("label"), (F.col(f"{c}{suffix_a}") != F.col(f"{c}{suffix_b}")).alias("differs")) for c in labels]
    )
    rows = pairs.select(price, region, F.explode(items).alias("i")).filter("i.differs").select(price, region, "i.label")
    rows = rows.join(ranked.select("label", "disagreement"), "label")
    medians = exact_quantiles(rows, price, {"median_price": 0.5}, by=["label"]).drop("n_values")
    overall = exact_quantiles(pairs, price, {"m": 0.5}).select("m").scalar()
    counts = rows.groupBy("label", region).agg(F.count("*").alias("rows"))
    order = Window.partitionBy("label").orderBy(F.desc("rows"), region)
    best = counts.withColumn("region_rank", F.row_number().over(order)).filter(F.col("region_rank") <= top_regions)
    return (
        best.join(ranked.select("label", "disagreement"), "label").join(medians, "label")
        .withColumn("overall_median_price", overall)
        .select("label", "disagreement", "median_price", "overall_median_price", "region_rank", F.col(region).alias("region"), "rows")
    )


def redundancy(df: DataFrame, label: str, field_holds: Column) -> DataFrame:
    """How often a label repeats a structured field: one row with counts and the two conditional rates."""
    both = df.select(F.col(label).cast("int").alias("l"), field_holds.cast("int").alias("f"))
    return both.agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("l") == 1, F.col("f"))).alias("field_given_label"),
        F.avg(F.when(F.col("l") == 0, F.col("f"))).alias("field_given_no_label"),
    )
