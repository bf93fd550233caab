"""Ensembles over members that are group means (J9-J12, J14, J15): the same code as for trained members, with SQL
counterparts in closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline import config
from hearthline.operators.sampling import group_folds
from hearthline.plans import ensembles, study
from hearthline.plans.oof import cross_validation, fit_members, oof_table
from hearthline.plans.zoo import RIDGE_ALPHAS, Spec
from hearthline.registered import views as v
from hearthline.registered.base import n, query, r, rounded
from hearthline.registered.views import hash_sql

REGION, PRIORITY = Spec("region_mean", "group_mean", {"keys": ("region_slug",)}), Spec("priority_mean", "group_mean", {"keys": ("decoration_type",)})
INPUTS = ("region_mean", "priority_mean")
FOLDS = [0, 1, 2]


def rows(spark, folder):
    return group_folds(v.trimmed_listings(spark, folder), "community_id", len(FOLDS), 42)


def oof(spark, folder):
    return oof_table(rows(spark, folder), [REGION, PRIORITY, Spec("mean_baseline", "mean")], (), (), config.TARGET, FOLDS)


ROWS_SQL = f"{v.LISTING_TRIMMED}, f AS (SELECT house_id, region_slug AS a, decoration_type AS b, total_price_wan AS y, {hash_sql('community_id', 42)} % 3 AS fold FROM trimmed)"


def out_of_fold_sql(source: str = "f", prefix: str = "") -> str:
    """Each row's means over the rows of other folds, by either key, and of all of them."""
    p = prefix
    return f"""{p}k AS (SELECT DISTINCT fold FROM {source}),
    {p}ga AS (SELECT k.fold, s.a, avg(s.y) AS m FROM {source} s JOIN {p}k k ON s.fold <> k.fold GROUP BY 1, 2),
    {p}gb AS (SELECT k.fold, s.b, avg(s.y) AS m FROM {source} s JOIN {p}k k ON s.fold <> k.fold GROUP BY 1, 2),
    {p}g0 AS (SELECT k.fold, avg(s.y) AS m FROM {source} s JOIN {p}k k ON s.fold <> k.fold GROUP BY 1),
    {p}o AS (SELECT s.house_id, s.fold, s.a, s.b, s.y, coalesce(x.m, z.m) AS p, coalesce(w.m, z.m) AS q, z.m AS base FROM {source} s JOIN {p}g0 z USING (fold)
      LEFT JOIN {p}ga x ON x.fold = s.fold AND x.a IS NOT DISTINCT FROM s.a LEFT JOIN {p}gb w ON w.fold = s.fold AND w.b IS NOT DISTINCT FROM s.b)"""


OOF_SQL = f"{ROWS_SQL}, {out_of_fold_sql()}"


@query("j10_mean_out_of_fold", f"{OOF_SQL} SELECT house_id, {n('fold', 'fold')}, {r('y', 'actual')}, {r('p', 'region_mean')}, {r('q', 'priority_mean')}, {r('base', 'mean_baseline')} FROM o")
def j10_means(spark, folder):
    return rounded(oof(spark, folder).select("house_id", "fold", "actual", *INPUTS, "mean_baseline"))


@query(
    "j9_mean_cross_validation",
    f"""{OOF_SQL}, e AS (SELECT fold, avg(abs(p - y)) AS region_mean, avg(abs(q - y)) AS priority_mean, avg(abs(base - y)) AS mean_baseline FROM o GROUP BY 1)
    SELECT model_name, {r('avg(mae)', 'cv_mae_mean')}, {r('stddev_pop(mae)', 'cv_mae_std')} FROM e UNPIVOT (mae FOR model_name IN (region_mean, priority_mean, mean_baseline)) GROUP BY 1""",
)
def j9_means(spark, folder):
    return rounded(cross_validation(oof(spark, folder), [*INPUTS, "mean_baseline"]))


def sums_sql(source: str, by: str = "") -> str:
    pairs = {"n": "1.0", "p": "p", "q": "q", "y": "y", "pp": "p * p", "pq": "p * q", "qq": "q * q", "py": "p * y", "qy": "q * y", "yy": "y * y"}
    return f"SELECT {by}{', '.join(f'sum({x}) AS s{k}' for k, x in pairs.items())} FROM {source}" + (" GROUP BY 1" if by else "")


def ridge_sql(alpha: str) -> str:
    """Weights and intercept of a ridge on two inputs from columns of sums."""
    return f"""cpp + {alpha} AS g11, cqq + {alpha} AS g22, cpq AS g12, cpy AS c1, cqy AS c2, g11 * g22 - g12 * g12 AS det, (g22 * c1 - g12 * c2) / det AS w1, (g11 * c2 - g12 * c1) / det AS w2,
    sy / sn - w1 * sp / sn - w2 * sq / sn AS w0"""


CENTRED = "spp - sp * sp / sn AS cpp, sqq - sq * sq / sn AS cqq, spq - sp * sq / sn AS cpq, spy - sp * sy / sn AS cpy, sqy - sq * sy / sn AS cqy"


@query("j11_mean_stacking", f"{OOF_SQL}, s AS ({sums_sql('o')}), c AS (SELECT *, {CENTRED} FROM s), w AS (SELECT {ridge_sql('1.0')} FROM c) SELECT house_id, {r('y', 'actual')}, {r('w0 + w1 * p + w2 * q', 'stacking_ridge', 4)} FROM o, w")
def j11_means(spark, folder):
    table = oof(spark, folder)
    combiner = ensembles.ridge(ensembles.moments(table, INPUTS), 1.0)
    return rounded(table.select("house_id", "actual", combiner.column().alias("stacking_ridge")), 6, stacking_ridge=4)


GRID = ", ".join(f"({a})" for a in RIDGE_ALPHAS)


@query(
    "j12_mean_alpha_search",
    f"""{OOF_SQL}, sf AS ({sums_sql('o', 'fold, ')}), s AS (SELECT h.fold, {', '.join(f'sum(x.s{k}) AS s{k}' for k in ('n', 'p', 'q', 'y', 'pp', 'pq', 'qq', 'py', 'qy', 'yy'))} FROM sf h JOIN sf x ON x.fold <> h.fold GROUP BY 1),
    c AS (SELECT *, {CENTRED} FROM s), w AS (SELECT fold, alpha, {ridge_sql('alpha')} FROM c, (VALUES {GRID}) t(alpha))
    SELECT {r('alpha', 'alpha')}, {r('sqrt(avg((w0 + w1 * p + w2 * q - y) ** 2))', 'cv_rmse', 4)} FROM o JOIN w USING (fold) GROUP BY alpha""",
)
def j12_means(spark, folder):
    """Held-out error of each ridge strength, from products of one pass."""
    _, grid = ensembles.search(ensembles.moments(oof(spark, folder), INPUTS), "ridge")
    return rounded(ensembles.alpha_table(spark, {"ridge": grid}).select("alpha", "cv_rmse"), 6, cv_rmse=4)


@query(
    "j14_mean_super_learner",
    f"{OOF_SQL}, w AS (SELECT greatest(0.0, least(1.0, sum((p - q) * (y - q)) / sum((p - q) * (p - q)))) AS w FROM o) SELECT house_id, {r('y', 'actual')}, {r('w * p + (1 - w) * q', 'super_learner', 4)} FROM o, w",
)
def j14_means(spark, folder):
    table = oof(spark, folder)
    combiner = ensembles.convex(ensembles.moments(table, INPUTS))
    return rounded(table.select("house_id", "actual", combiner.column().alias("super_learner")), 6, super_learner=4)


@query(
    "j15_mean_two_stage",
    f"""{ROWS_SQL}, t AS (SELECT * FROM f WHERE fold <> 0), {out_of_fold_sql('t')}, m1 AS (SELECT a, avg(y) AS m FROM t GROUP BY 1), m0 AS (SELECT avg(y) AS m FROM t),
    r1 AS (SELECT b, avg(y - p) AS m FROM o GROUP BY 1), r0 AS (SELECT avg(y - p) AS m FROM o)
    SELECT house_id, {r('y', 'actual')}, {r('coalesce(m1.m, m0.m)', 'region_mean')}, {r('coalesce(m1.m, m0.m) + coalesce(r1.m, r0.m)', 'two_stage_residual')} FROM f CROSS JOIN m0 CROSS JOIN r0
    LEFT JOIN m1 ON m1.a IS NOT DISTINCT FROM f.a LEFT JOIN r1 ON r1.b IS NOT DISTINCT FROM f.b WHERE fold = 0""",
)
def j15_means(spark, folder):
    """Region means, then means of their out-of-fold residuals by priority, for a held-out fold."""
    table = rows(spark, folder)
    train, test = table.filter("fold <> 0"), table.filter("fold = 0")
    inner = oof_table(train, [REGION], (), (), config.TARGET, FOLDS[1:])
    _, (scored,) = fit_members(train, [test], [REGION], (), (), config.TARGET)
    staged = study.two_stage(train, scored, inner, "region_mean", study.Inputs((), ()), second=Spec("residual", "group_mean", {"keys": ("decoration_type",)}))
    return rounded(staged.select("house_id", F.col(config.TARGET).alias("actual"), "region_mean", "two_stage_residual"))
