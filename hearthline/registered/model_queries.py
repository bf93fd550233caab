"""Members, ensembles and experiments over the driver tables (J).

Members, strengths and boosting rounds are those of a full study, the defaults of ``plans.zoo``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline import config
from hearthline.functions.labels import keyword_labels
from hearthline.operators import cleaning, errors, leaderboards
from hearthline.plans import ensembles, experiments, study
from hearthline.plans.oof import beside, cross_validation, fit_members, oof_table
from hearthline.plans.zoo import MEMBERS, RESIDUAL, assemble, fit, fit_linear, model_zoo
from hearthline.registered import views as v
from hearthline.registered.base import n, query, r, rounded, table
from hearthline.registered.views import hash_sql

NUMERIC = (
    "area_sqm", "room_count", "hall_count", "bath_count", "floor_level_score", *v.COUNTS, "poi_total_count",
    "accessibility_index", "poi_balance_score", "area_layout_efficiency", "region_accessibility_interaction",
)
CATEGORICAL = ("region_slug", "decoration_type", "floor_level", "house_layout")
INPUTS = study.Inputs(NUMERIC, CATEGORICAL)
SETTINGS = config.StudyConfig(folds=3)
ZOO = model_zoo(seed=42)
#: All members of the out-of-fold table; MEMBERS, those that are not linear, are stacked.
ALL = tuple(name for name in ZOO if name != "median_boosting")
COMPACT = ("random_forest", "boosted_histogram", "boosted_depth4")

_tables: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, folder: str, kind: str, build) -> DataFrame:
    """Materialised intermediate tables are written once per application and folder."""
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _tables:
        _tables[key] = build()
    return _tables[key]


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "prepared", lambda: study.split_and_reference(v.features(spark, folder), SETTINGS))


def parts(spark, folder) -> tuple[DataFrame, DataFrame]:
    rows = prepared(spark, folder)
    return rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "test")


def oof(spark, folder) -> DataFrame:
    def build():
        train, _ = parts(spark, folder)
        return oof_table(train, [ZOO[m] for m in ALL], NUMERIC, CATEGORICAL, config.TARGET, [0, 1, 2], keep=["area_sqm", "poi_balance_score", "poi_medium_count"])

    return _once(spark, folder, "oof", build)


def scored_test(spark, folder) -> DataFrame:
    def build():
        train, test = parts(spark, folder)
        _, (scored,) = fit_members(train, [test], [ZOO[m] for m in ALL], NUMERIC, CATEGORICAL, config.TARGET)
        return study.materialise(scored.drop("features").withColumn("actual_price_wan", F.col(config.TARGET)))

    return _once(spark, folder, "scored", build)


def oof_and_test(spark, folder) -> list[DataFrame]:
    prepared(spark, folder)  # both read it
    return beside(lambda: oof(spark, folder), lambda: scored_test(spark, folder))


def member_predictions(spark, folder, *names: str) -> DataFrame:
    train, test = parts(spark, folder)
    specs = [ZOO[name] for name in names]
    _, (scored,) = fit_members(train, [test], specs, NUMERIC, CATEGORICAL, config.TARGET)
    return rounded(scored.select("house_id", F.col(config.TARGET).alias("actual_price_wan"), *names))


@query("j1_preprocessed_rows")
def j1(spark, folder):
    """Width and filled slots of every assembled vector; fitted on training rows only."""
    train, test = parts(spark, folder)
    _, (_, held) = assemble(train, [test], NUMERIC, CATEGORICAL)
    from pyspark.ml.functions import vector_to_array

    values = vector_to_array("features")
    return held.select("house_id", F.size(values).cast("bigint").alias("width"), F.size(F.filter(values, lambda x: x != 0)).cast("bigint").alias("filled"))


FOLD_SQL = f"{hash_sql('community_id', 42)} % 3"


@query(
    "j2_mean_baseline",
    f"""{v.LISTING_TRIMMED}, f AS (SELECT house_id, total_price_wan AS y, {FOLD_SQL} AS fold FROM trimmed), g AS (SELECT fold, sum(y) AS s, count(*) AS c FROM f GROUP BY 1), t AS (SELECT sum(s) AS s, sum(c) AS c FROM g)
    SELECT house_id, {n('fold', 'fold')}, {r('(t.s - g.s) / (t.c - g.c)', 'prediction')} FROM f JOIN g USING (fold), t""",
)
def j2(spark, folder):
    from hearthline.operators.sampling import group_folds

    rows = group_folds(v.trimmed_listings(spark, folder), "community_id", 3, 42)
    sums = rows.groupBy("fold").agg(F.sum(config.TARGET).alias("s"), F.count("*").alias("c")).collect()
    total, count = sum(x["s"] for x in sums), sum(x["c"] for x in sums)
    means = F.create_map(*[F.lit(x) for s in sums for x in (s["fold"], (total - s["s"]) / (count - s["c"]))])
    return rounded(rows.select("house_id", "fold", F.element_at(means, F.col("fold")).alias("prediction")))


@query("j3_ridge")
def j3(spark, folder):
    return member_predictions(spark, folder, "ridge")


@query("j4_lasso")
def j4(spark, folder):
    return member_predictions(spark, folder, "lasso")


@query("j5_random_forest")
def j5(spark, folder):
    return member_predictions(spark, folder, "random_forest")


@query("j6_gradient_boosting")
def j6(spark, folder):
    return member_predictions(spark, folder, "gradient_boosting")


@query("j7_boosted_members")
def j7(spark, folder):
    return member_predictions(spark, folder, "boosted_histogram", "boosted_depth4", "boosted_leaves31", "boosted_depth6")


@query("j8_median_boosting")
def j8(spark, folder):
    """With fewer rounds the median is not reached."""
    train, test = parts(spark, folder)
    _, (scored,) = fit_members(train, [test], [ZOO["median_boosting"]], NUMERIC, CATEGORICAL, config.TARGET)
    return rounded(scored.select("house_id", F.col(config.TARGET).alias("actual_price_wan"), "median_boosting"))


@query("j9_cross_validation")
def j9(spark, folder):
    return rounded(cross_validation(oof(spark, folder), ALL))


@query("j10_out_of_fold_table")
def j10(spark, folder):
    return rounded(oof(spark, folder).select("house_id", "fold", "actual", *ALL))


@query("j11_stacking")
def j11(spark, folder):
    out_of_fold, scored = oof_and_test(spark, folder)
    combiner = ensembles.ridge(ensembles.moments(out_of_fold, MEMBERS), 1.0)
    return rounded(scored.select("house_id", "actual_price_wan", combiner.column().alias("stacking_ridge")))


@query("j12_meta_variants")
def j12(spark, folder):
    out_of_fold, scored = oof_and_test(spark, folder)
    combiners, _ = ensembles.meta_variants(ensembles.moments(out_of_fold, ("ridge", *MEMBERS)), compact=COMPACT)
    wide = scored.select("house_id", "actual_price_wan", *[c.column().alias(name) for name, c in combiners.items()])
    return rounded(errors.regression_metrics(errors.long_predictions(wide, list(combiners))))


@query("j12_meta_coefficients")
def j12_coefficients(spark, folder):
    combiners, _ = ensembles.meta_variants(ensembles.moments(oof(spark, folder), ("ridge", *MEMBERS)), compact=COMPACT)
    return rounded(ensembles.coefficient_table(spark, combiners))


@query("j12_alpha_search")
def j12_alphas(spark, folder):
    _, grids = ensembles.meta_variants(ensembles.moments(oof(spark, folder), ("ridge", *MEMBERS)))
    return rounded(ensembles.alpha_table(spark, grids))


@query("j13_feature_weighted_stacking")
def j13(spark, folder):
    products = ensembles.weighted_inputs(MEMBERS, ["area_sqm", "poi_balance_score", "poi_medium_count"])
    out_of_fold, scored = oof_and_test(spark, folder)
    combiner, _ = ensembles.search(ensembles.moments(out_of_fold.withColumns(products), list(products)), "ridge")
    return rounded(scored.withColumns(products).select("house_id", "actual_price_wan", combiner.column().alias("fwls_lite")))


@query("j14_super_learner")
def j14(spark, folder):
    out_of_fold, scored = oof_and_test(spark, folder)
    combiner = ensembles.convex(ensembles.moments(out_of_fold, MEMBERS))
    return rounded(scored.select("house_id", "actual_price_wan", combiner.column().alias("super_learner")))


@query("j15_two_stage")
def j15(spark, folder):
    train, _ = parts(spark, folder)
    out_of_fold, scored = oof_and_test(spark, folder)
    return rounded(study.two_stage(train, scored, out_of_fold, "boosted_depth4", INPUTS, RESIDUAL).select("house_id", "actual_price_wan", "boosted_depth4", "two_stage_residual"))


@query("j15_two_stage_nested_cv")
def j15_nested(spark, folder):
    train, _ = parts(spark, folder)
    return rounded(study.nested_two_stage_cv(train, ZOO["ridge"], INPUTS, [0, 1, 2], RESIDUAL))


BLEND_SQL = f"""WITH {v.PREDICTION}, m AS (SELECT model_name FROM v_pred WHERE model_name <> 'mean_baseline' GROUP BY 1 ORDER BY avg(absolute_error_wan), model_name LIMIT {{k}})
SELECT house_id, {r('any_value(actual_price_wan)', 'actual_price_wan')}, {r('avg(predicted_price_wan)', '{name}')} FROM v_pred JOIN m USING (model_name) GROUP BY 1"""


@query("j16_blend_of_best", BLEND_SQL.format(k=2, name="blend"))
def j16(spark, folder):
    rows = v.predictions(spark, folder)
    scores = rows.groupBy("model_name").agg(F.avg("absolute_error_wan").alias("cv_mae_mean"))
    members = [row["model_name"] for row in leaderboards.best_models(scores, 2).collect()]
    wide = errors.wide_predictions(rows.filter(F.col("model_name").isin(members)), members)
    return rounded(wide.select("house_id", "actual_price_wan", ensembles.row_mean(members).alias("blend")))


@query("j17_voting", BLEND_SQL.format(k=3, name="voting"))
def j17(spark, folder):
    wide = errors.wide_predictions(v.predictions(spark, folder), v.MODELS)
    return rounded(wide.select("house_id", "actual_price_wan", ensembles.row_mean(v.MODELS).alias("voting")))


@query(
    "j18_gate_profile",
    f"""{v.LISTING_TRIMMED}, q AS (SELECT quantile_cont(area_sqm, 0.33) AS q1, quantile_cont(area_sqm, 0.67) AS q2 FROM trimmed)
    SELECT concat(region_slug, '_area_', CASE WHEN area_sqm < q1 THEN 0 WHEN area_sqm < q2 THEN 1 ELSE 2 END) AS gate, {n('count(*)', 'n')}, count(*) >= 80 AS uses_expert FROM trimmed, q GROUP BY 1""",
)
def j18(spark, folder):
    gated, _ = ensembles.gates(v.trimmed_listings(spark, folder))
    return ensembles.gate_profile(gated)


@query("j18_mixture_of_experts")
def j18_moe(spark, folder):
    scored, _ = experts(spark, folder, "boosted_histogram")
    return rounded(scored.select("house_id", "gate", F.col(config.TARGET).alias("actual_price_wan"), "moe_region_area"))


def experts(spark, folder, member: str) -> tuple[DataFrame, DataFrame]:
    train, test = parts(spark, folder)
    return ensembles.mixture_of_experts(train, test, ZOO[member], config.TARGET, NUMERIC, CATEGORICAL)


@query("j18_gate_errors")
def j18_errors(spark, folder):
    return rounded(ensembles.gate_errors(*experts(spark, folder, "boosted_histogram"), config.TARGET))


@query("j18_linear_experts")
def j18_linear(spark, folder):
    scored, _ = experts(spark, folder, "ridge")
    return rounded(scored.select("house_id", "gate", F.col(config.TARGET).alias("actual_price_wan"), "moe_region_area"))


@query("j19_member_ablation")
def j19(spark, folder):
    out_of_fold, scored = oof_and_test(spark, folder)
    columns = ensembles.ablation_columns(ensembles.moments(out_of_fold, MEMBERS), MEMBERS)
    names = {f"{method}__{name}": column for (name, method), column in columns.items()}
    wide = scored.select("house_id", "actual_price_wan", *[c.alias(k) for k, c in names.items()])
    metrics = errors.regression_metrics(errors.long_predictions(wide, list(names)))
    split = metrics.select(F.split_part("model_name", F.lit("__"), F.lit(1)).alias("method"), F.split_part("model_name", F.lit("__"), F.lit(2)).alias("combination"), "mae")
    return rounded(leaderboards.method_contrast(split, "combination", "method", "stacking_ridge", "voting"))


def experiment(spark, folder, variants, rows=None, specs=(ZOO["ridge"],)):
    data = prepared(spark, folder) if rows is None else rows
    return rounded(errors.regression_metrics(experiments.run_variants(data, variants, list(specs))))


@query("j20_feature_sets")
def j20(spark, folder):
    raw = ("area_sqm", "room_count", "hall_count", "bath_count")
    base = (*raw, "floor_level_score", *v.COUNTS, "poi_total_count", "accessibility_index")
    sets = {"raw": (raw, CATEGORICAL[:3]), "base": (base, CATEGORICAL), "enhanced": (NUMERIC, CATEGORICAL)}
    variants = experiments.feature_set_variants(sets=sets, two_stage_too=False)
    return experiment(spark, folder, variants)


@query("j21_target_transforms")
def j21(spark, folder):
    return experiment(spark, folder, experiments.target_variants(NUMERIC, CATEGORICAL))


@query("j22_cleaning_dose")
def j22(spark, folder):
    flagged = experiments.flag_training_noise(prepared(spark, folder))
    return experiment(spark, folder, experiments.cleaning_variants(NUMERIC, CATEGORICAL), flagged)


@query("j22_log_by_cleaning")
def j22_grid(spark, folder):
    flagged = experiments.flag_training_noise(prepared(spark, folder))
    return experiment(spark, folder, experiments.log_by_clean_variants(NUMERIC, CATEGORICAL), flagged)


@query("j23_polynomial")
def j23(spark, folder):
    core = ("area_sqm", "poi_medium_count", "accessibility_index", "poi_balance_score", "room_count", "floor_level_score")
    return experiment(spark, folder, experiments.polynomial_variants(NUMERIC, CATEGORICAL, core))


def labelled(spark, folder) -> tuple[DataFrame, dict[str, list[str]]]:
    """Listings with the labels of the document that has their number; other listings have none. Written once: every
    variant reads the rows several times, and texts are searched for words once."""
    docs = v.titles(spark, folder)
    rules = docs.select(F.col("doc_id").alias("house_id"), *[c.alias(f"{k}_rule") for k, c in keyword_labels("text", v.KEYWORDS).items()])
    given = table(spark, folder, "labels").select(F.col("doc_id").alias("house_id"), F.col("quality").alias("quality_label"), F.col("toxic").alias("toxic_label"))
    names = {"rule": [f"{k}_rule" for k in v.KEYWORDS], "annotated": ["quality_label", "toxic_label"]}
    rows = experiments.flag_training_noise(prepared(spark, folder)).join(rules, "house_id", "left").join(given, "house_id", "left")
    filled = study.materialise(rows.fillna(0, subset=names["rule"] + names["annotated"]))
    return filled, {"none": [], **names, "rule_annotated": names["rule"] + names["annotated"]}


@query("j24_label_variants")
def j24(spark, folder):
    rows, sources = labelled(spark, folder)
    return experiment(spark, folder, experiments.label_variants(NUMERIC, CATEGORICAL, sources), rows)


@query("j24_title_variants")
def j24_titles(spark, folder):
    rows, sources = labelled(spark, folder)
    return experiment(spark, folder, experiments.title_variants(NUMERIC, CATEGORICAL, sources["rule"]), rows)


@query("j25_index_sensitivity")
def j25(spark, folder):
    train, _ = parts(spark, folder)
    weights = experiments.weight_sets(train, v.TYPES, v.WEIGHTS)
    return experiment(spark, folder, experiments.sensitivity_variants(NUMERIC, CATEGORICAL, v.TYPES, weights))


@query("j26_data_driven_weights")
def j26(spark, folder):
    rows = cleaning.join_community(v.trimmed_listings(spark, folder), v.communities(spark, folder))
    weights = study.data_driven_weights(rows, v.TYPES)
    return rounded(spark.createDataFrame([(t, float(w)) for t, w in weights.items()], "poi string, weight double"))


@query("j27_permutation_importance")
def j27(spark, folder):
    train, test = parts(spark, folder)
    model, (ready,) = assemble(train, [], NUMERIC, CATEGORICAL)
    (member,) = fit_linear([ZOO["ridge"]], train, ready, model, config.TARGET)
    return rounded(study.permutation_importance(member, test, [*NUMERIC, *CATEGORICAL], config.TARGET, prepared=model))


@query("j27_tree_importance")
def j27_trees(spark, folder):
    train, test = parts(spark, folder)
    member = fit(ZOO["boosted_histogram"], train, config.TARGET, NUMERIC, CATEGORICAL)
    return rounded(study.permutation_importance(member, test, [*NUMERIC, *CATEGORICAL], config.TARGET))


@query("j28_learning_curve")
def j28(spark, folder):
    """Errors after every round of several boosted members."""
    train, test = parts(spark, folder)
    specs = [ZOO[m] for m in ("gradient_boosting", "boosted_histogram", "boosted_depth4", "boosted_leaves31", "boosted_depth6")]
    checks = {"validation": train.filter(F.col("fold") == 0), "test": test}
    return rounded(study.learning_curve(train.filter(F.col("fold") != 0), checks, config.TARGET, specs, NUMERIC, CATEGORICAL))


DIAGNOSED = ("priority_mean", "region_mean")


@query(
    "j29_prediction_correlations",
    f"""WITH {v.PREDICTION}, w AS (SELECT house_id, max(predicted_price_wan) FILTER (WHERE model_name = 'priority_mean') AS priority_mean, max(predicted_price_wan) FILTER (WHERE model_name = 'region_mean') AS region_mean FROM v_pred GROUP BY 1) """
    + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r(f'corr({a}, {b})', 'r')} FROM w" for a in DIAGNOSED for b in DIAGNOSED),
)
def j29(spark, folder):
    return rounded(errors.correlation_matrix(errors.wide_predictions(v.predictions(spark, folder), DIAGNOSED), DIAGNOSED))


@query(
    "j30_best_model_predictions",
    f"""WITH {v.PREDICTION}, b AS (SELECT arg_min(model_name, m) AS best FROM (SELECT model_name, avg(absolute_error_wan) AS m FROM v_pred GROUP BY 1))
    SELECT model_name, house_id, {r('actual_price_wan', 'actual_price_wan')}, {r('predicted_price_wan', 'predicted_price_wan')}, {r('actual_price_wan - predicted_price_wan', 'residual_wan')} FROM v_pred JOIN b ON model_name = best""",
)
def j30(spark, folder):
    rows = v.predictions(spark, folder)
    best = leaderboards.best_model(errors.regression_metrics(rows)).first()["model_name"]
    return rounded(study.best_predictions(rows, best).select("model_name", "house_id", "actual_price_wan", "predicted_price_wan", "residual_wan"))


@query("j31_whole_study")
def j31(spark, folder):
    """Members, stacking, blend and two-stage model of one run, with cross-validation and holdout metrics."""
    result = study.run_study(prepared(spark, folder), SETTINGS, INPUTS)
    return rounded(result.metrics())

