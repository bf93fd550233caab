"""One out-of-fold prediction table that every ensemble reuses."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.plans import trees
from hearthline.plans.zoo import GROWN_KINDS, LINEAR_KINDS, Fitted, Spec, assemble, fit, fit_linear, grow
from hearthline.session import materialise


def beside(*jobs: Callable[[], object]) -> list:
    """Tables or members made at the same time: where the last trees of one keep few cores, those of the next are grown."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [waiting.result() for waiting in [pool.submit(job) for job in jobs]]


def fit_members(
    train: DataFrame, others: Sequence[DataFrame], specs: Sequence[Spec], numeric: Sequence[str], categorical: Sequence[str], target: str, key: str = "house_id"
) -> tuple[list[Fitted], list[DataFrame]]:
    """Members fitted on ``train``; the other frames come back with one prediction column per member. Trees are grown beside
    the fits of the other members."""
    linear, grown = [s for s in specs if s.kind in LINEAR_KINDS], [s for s in specs if s.kind in GROWN_KINDS]
    with ThreadPoolExecutor(1) as pool:
        growing = pool.submit(grow, grown, train, target, numeric, categorical, key=key) if grown else None
        members, rest = {spec.name: fit(spec, train, target) for spec in specs if spec not in linear and spec not in grown}, list(others)
        if linear:
            model, (ready, *rest) = assemble(train, others, numeric, categorical)
            members |= {member.name: member for member in fit_linear(linear, train, ready, model, target)}
        models = growing.result() if growing else {}
    scored = [reduce(lambda df, member: member.predict(df), members.values(), df) for df in rest]
    if grown:
        members |= {spec.name: Fitted(spec.name, models[spec.name, ()]) for spec in grown}
        scored = [trees.scored(df, [(spec.name, models[spec.name, ()]) for spec in grown]) for df in scored]
    return [members[spec.name] for spec in specs], scored


def oof_table(
    train: DataFrame, specs: Sequence[Spec], numeric: Sequence[str], categorical: Sequence[str], target: str,
    folds: Sequence[int], fold: str = "fold", keep: Sequence[str] = (), key: str = "house_id",
) -> DataFrame:
    """key, fold, actual, kept columns and one out-of-fold prediction per member; every training row once.

    Trees of all members and folds are grown together, while the other members of all folds are fitted beside them. Each fold
    is written as it is done, so later ensembles read predictions and never refit members.
    """
    others, grown = [s for s in specs if s.kind not in GROWN_KINDS], [s for s in specs if s.kind in GROWN_KINDS]
    with ThreadPoolExecutor(max(len(folds), 1)) as pool:
        waiting = [pool.submit(fit_members, train.filter(F.col(fold) != f), [train.filter(F.col(fold) == f)], others, numeric, categorical, target, key) for f in folds]
        models = grow(grown, train, target, numeric, categorical, [(f,) for f in folds], fold, key) if grown else {}
        fitted = [job.result() for job in waiting]
    parts = []
    for value, (_, (scored,)) in zip(folds, fitted, strict=True):
        scored = trees.scored(scored, [(s.name, models[s.name, (value,)]) for s in grown])
        columns = [key, fold, F.col(target).alias("actual"), *[c for c in keep if c not in (key, fold)], *[s.name for s in specs]]
        parts.append(materialise(scored.select(*columns)))
    return reduce(DataFrame.unionByName, parts)


def cross_validation(oof: DataFrame, members: Sequence[str], fold: str = "fold") -> DataFrame:
    """model_name, cv_mae_mean, cv_mae_std (population) over folds, for all members in one pass."""
    per_fold = oof.groupBy(fold).agg(*[F.avg(F.abs(F.col(m) - F.col("actual"))).alias(m) for m in members])
    items = F.array(*[F.struct(F.lit(m).alias("model_name"), F.col(m).alias("mae")) for m in members])
    long = per_fold.select(F.explode(items).alias("i")).select("i.*")
    return long.groupBy("model_name").agg(F.avg("mae").alias("cv_mae_mean"), F.stddev_pop("mae").alias("cv_mae_std"))
