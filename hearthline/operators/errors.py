"""Regression metrics and error profiles over one long prediction table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.operators.ranking import average_ranks, exact_quantiles, null_safe_join


def metric_columns(actual: str = "actual_price_wan", predicted: str = "predicted_price_wan") -> dict[str, Column]:
    """mae, rmse, r2, mape as aggregates of one pass; r2 compares with the evaluated rows' own mean."""
    y, e = F.col(actual).cast("double"), F.col(actual).cast("double") - F.col(predicted)
    spread = F.var_pop(y) * F.count(y)
    return {
        "mae": F.avg(F.abs(e)),
        "rmse": F.sqrt(F.avg(e * e)),
        "r2": F.when(spread > 0, F.lit(1.0) - F.sum(e * e) / spread),
        "mape": F.avg(F.abs(e) / F.greatest(y, F.lit(1e-6))),
    }


def regression_metrics(predictions: DataFrame, by: Sequence[str] = ("model_name",), **names: str) -> DataFrame:
    return predictions.groupBy(*by).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in metric_columns(**names).items()])


def long_predictions(wide: DataFrame, models: Sequence[str], key: str = "house_id", actual: str = "actual_price_wan") -> DataFrame:
    """One row per (model, listing) with the absolute error."""
    items = F.array(*[F.struct(F.lit(m).alias("model_name"), F.col(m).cast("double").alias("predicted_price_wan")) for m in models])
    long = wide.select(key, F.col(actual).alias("actual_price_wan"), F.explode(items).alias("p"))
    return long.select(
        "p.model_name", key, "actual_price_wan", "p.predicted_price_wan",
        F.abs(F.col("actual_price_wan") - F.col("p.predicted_price_wan")).alias("absolute_error_wan"),
    )


def wide_predictions(predictions: DataFrame, models: Sequence[str], value: str = "predicted_price_wan", key: str = "house_id") -> DataFrame:
    """One row per listing with a column per model; listings that lack a model keep null there."""
    picked = [F.max(F.when(F.col("model_name") == m, F.col(value))).alias(m) for m in models]
    return predictions.groupBy(key).agg(F.max("actual_price_wan").alias("actual_price_wan"), *picked)


def error_by_strata(df: DataFrame, strata: Sequence[str], error: str = "absolute_error_wan", by: Sequence[str] = ()) -> DataFrame:
    """by + stratum, value, n, mae, median-free error profile of every stratifier from one scan with grouping sets."""
    text = {s: F.coalesce(F.col(s).cast("string"), F.lit("null")) for s in strata}
    cells = df.withColumns(text).groupingSets([[*map(F.col, by), F.col(s)] for s in strata], *[F.col(s) for s in [*by, *strata]]).agg(
        *[F.grouping(s).alias(f"_g_{s}") for s in strata],
        F.count("*").alias("n"),
        F.avg(error).alias("mae"),
        F.avg("actual_price_wan").alias("mean_actual"),
        F.avg("predicted_price_wan").alias("mean_predicted"),
    )
    name = value = F
    for s in strata:
        name = name.when(F.col(f"_g_{s}") == 0, F.lit(s))
        value = value.when(F.col(f"_g_{s}") == 0, F.col(s))
    return cells.select(*by, name.alias("stratum"), value.alias("stratum_value"), "n", "mae", "mean_actual", "mean_predicted")


def temporal_profile(df: DataFrame, time: str = "extracted_at", scope: str = "split") -> DataFrame:
    """n, first and last time and distinct days for all rows and per split.

    Days are counted from day-level partial sums, so no distinct set is built in one task.
    """
    daily = df.groupBy(scope, F.to_date(time).alias("day")).agg(
        F.count("*").alias("n"), F.min(time).alias("first_at"), F.max(time).alias("last_at")
    )
    both = daily.withColumn("scope", F.explode(F.array(F.lit("all"), F.col(scope))))
    per_day = both.groupBy("scope", "day").agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    return per_day.groupBy("scope").agg(
        F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
        F.count("day").alias("distinct_days"),
    )


def describe_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, n, mean, std (sample), min, p25, p50, p75, max, skew (bias-adjusted)."""
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.explode(items).alias("i")).select("i.feature", "i.value").filter(F.col("value").isNotNull())
    n = F.count("value")
    adjust = F.sqrt((n * (n - 1)).cast("double")) / (n - 2)
    moments = long.groupBy("feature").agg(
        n.alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.when(n > 2, F.skewness("value") * adjust).alias("skew"),
    )
    cuts = exact_quantiles(long, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, by=["feature"]).drop("n_values")
    return moments.join(cuts, "feature")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n, percent; null counts as its own value."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).withColumn(
        "percent", F.col("n") * 100.0 / total
    )


def band_counts(df: DataFrame, band: Column, bands: Sequence[str]) -> DataFrame:
    """Counts for a fixed band list, empty bands included."""
    wide = df.select(band.alias("_b")).agg(
        F.count("_b").alias("_t"), *[F.count_if(F.col("_b") == b).alias(f"_c{i}") for i, b in enumerate(bands)]
    )
    items = F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"_c{i}").alias("n")) for i, b in enumerate(bands)])
    return wide.select("_t", F.explode(items).alias("i")).select(
        "i.band", "i.n", F.when(F.col("_t") > 0, F.col("i.n") * 100.0 / F.col("_t")).alias("percent")
    )


def cell_dispersion(df: DataFrame, cells: Sequence[str], value: str, min_rows: int = 3) -> DataFrame:
    """Per cell: n, mean, population std, coefficient of variation, min, max, median; null cells and small cells drop out."""
    present = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cells]))
    stats = present.groupBy(*cells).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean_value"), F.stddev_pop(value).alias("std_value"),
        F.min(value).alias("min_value"), F.max(value).alias("max_value"),
    ).filter(F.col("n") >= min_rows)
    medians = exact_quantiles(present, value, {"median_value": 0.5}, by=cells).drop("n_values")
    return null_safe_join(stats, medians, list(cells), "inner").withColumn(
        "cv", F.when(F.col("mean_value") > 0, F.col("std_value") / F.col("mean_value"))
    )


def dispersion_summary(cells: DataFrame) -> DataFrame:
    """One row over the cell table: cells, samples, cv statistics and counts above fixed levels."""
    median = exact_quantiles(cells, "cv", {"median_cv": 0.5}).select("median_cv").scalar()
    return cells.agg(
        F.count("*").alias("cells"), F.sum("n").alias("samples"), F.avg("cv").alias("mean_cv"),
        F.max("cv").alias("max_cv"), F.min("cv").alias("min_cv"),
        F.count_if(F.col("cv") > 0.10).alias("above_10"), F.count_if(F.col("cv") > 0.15).alias("above_15"),
        F.count_if(F.col("cv") > 0.20).alias("above_20"),
    ).withColumn("median_cv", median)


def variance_decomposition(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: rows, groups, ssb, ssw, sst, eta squared and the unbalanced one-way intraclass correlation."""
    present = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("_y"))
    centre = present.agg(F.avg("_y").alias("m")).first()["m"]
    shifted = present.withColumn("_d", F.col("_y") - F.lit(centre))
    per_group = shifted.groupBy(group).agg(F.count("*").alias("n"), F.sum("_d").alias("s"), F.sum(F.col("_d") ** 2).alias("q"))
    sums = per_group.agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.sum(F.col("s") ** 2 / F.col("n")).alias("ssb"),
        F.sum("q").alias("sst"), F.sum((F.col("n") * F.col("n")).cast("double")).alias("_nn"),
    )
    ssw = F.col("sst") - F.col("ssb")
    msb = F.col("ssb") / (F.col("n_groups") - 1)
    msw = ssw / (F.col("n_rows") - F.col("n_groups"))
    n0 = (F.col("n_rows") - F.col("_nn") / F.col("n_rows")) / (F.col("n_groups") - 1)
    return sums.select(
        "n_rows", "n_groups", "ssb", ssw.alias("ssw"), "sst", (F.col("ssb") / F.col("sst")).alias("eta_squared"),
        ((msb - msw) / (msb + (n0 - 1) * msw)).alias("icc"),
    )


def correlation_matrix(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_a, column_b, r for every ordered pair, from one aggregate over the wide table."""
    pairs = [(a, b) for a in columns for b in columns]
    row = wide.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    items = F.array(
        *[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    )
    return row.select(F.explode(items).alias("p")).select("p.*")


def rank_columns(predictions: DataFrame, value: str = "predicted_price_wan", key: str = "house_id") -> DataFrame:
    """model_name, key, avg_rank: each model's values ranked with ties averaged."""
    ranks = average_ranks(predictions.select("model_name", value), value, by=["model_name"])
    return predictions.join(ranks, ["model_name", value]).select("model_name", key, "actual_price_wan", "avg_rank")


def spearman_matrix(predictions: DataFrame, models: Sequence[str], value: str = "predicted_price_wan") -> DataFrame:
    return correlation_matrix(wide_predictions(rank_columns(predictions, value), models, "avg_rank"), models)


def joint_error(predictions: DataFrame, models: Sequence[str]) -> DataFrame:
    """Ordered model pairs: share of listings in both models' top error quarter, and both MAEs."""
    limits = exact_quantiles(predictions, "absolute_error_wan", {"limit": 0.75}, by=["model_name"]).drop("n_values")
    flagged = predictions.join(limits, "model_name").withColumn("high", (F.col("absolute_error_wan") >= F.col("limit")).cast("int"))
    flags = wide_predictions(flagged, models, "high")
    pairs = [(a, b) for a in models for b in models]
    flag_row = flags.agg(*[F.avg((F.col(a) * F.col(b)).cast("double")).alias(f"j{i}") for i, (a, b) in enumerate(pairs)])
    items = F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"j{i}").alias("joint_rate")) for i, (a, b) in enumerate(pairs)])
    grid = flag_row.select(F.explode(items).alias("p")).select("p.*")
    mae = predictions.groupBy("model_name").agg(F.avg("absolute_error_wan").alias("mae"))
    return grid.join(mae.select(F.col("model_name").alias("model_a"), F.col("mae").alias("mae_a")), "model_a").join(
        mae.select(F.col("model_name").alias("model_b"), F.col("mae").alias("mae_b")), "model_b"
    )


def price_segments(df: DataFrame, price: str = "actual_price_wan", probs: tuple[float, float] = (0.33, 0.67)) -> DataFrame:
    """Adds segment low/mid/high with right-closed cuts at the two quantiles."""
    cuts = exact_quantiles(df, price, {"q1": probs[0], "q2": probs[1]}).first()
    segment = F.when(F.col(price) <= F.lit(cuts["q1"]), "low").when(F.col(price) <= F.lit(cuts["q2"]), "mid").when(F.col(price).isNotNull(), "high")
    return df.withColumn("segment", segment)


def segment_distribution(df: DataFrame, price: str = "actual_price_wan", by: Sequence[str] = ("segment",)) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(price).alias("mean_price"), F.stddev_samp(price).alias("std_price"),
        F.avg("absolute_error_wan").alias("mae"),
    )


# Fixed values of the ceiling heuristic.
CEILING_PARAMETERS = {"feature_gain": 0.75, "ensemble_gain": 0.3, "share_penalty": 0.05, "least_headroom": 0.02, "limit": 0.70}


def information_ceiling(
    summary: DataFrame, best_r2: float, base_r2: float, enhanced_r2: float, parameters: Mapping[str, float] = CEILING_PARAMETERS
) -> DataFrame:
    """Upper estimate of reachable r2 from the one-row dispersion summary and the gains seen so far."""
    by_dispersion = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("median_cv") * F.col("median_cv"))
    gains = parameters["feature_gain"] * (enhanced_r2 - base_r2) + parameters["ensemble_gain"] * (best_r2 - enhanced_r2)
    share = F.when(F.col("cells") > 0, F.col("above_15") / F.col("cells")).otherwise(F.lit(0.0))
    estimate = F.least(by_dispersion, F.lit(best_r2 + gains)) - F.lit(parameters["share_penalty"]) * share
    return summary.select(
        by_dispersion.alias("dispersion_ceiling"),
        F.lit(best_r2 + gains).alias("gain_ceiling"),
        share.alias("high_dispersion_share"),
        F.least(
            F.lit(parameters["limit"]), F.greatest(F.lit(best_r2 + parameters["least_headroom"]), estimate)
        ).alias("estimated_ceiling"),
    )
