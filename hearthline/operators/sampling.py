"""Deterministic samples, holdouts and folds; membership depends on ids and seed only."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.hashing import HASH_HEX_DIGITS, hash_fold, hash_key
from hearthline.operators.ranking import lowest_hash_cutoffs, null_safe_join, order_cutoff, positions, running_totals
from hearthline.session import materialise



def holdout_size(n: int, test_size: float) -> int:
    size = max(int(n * test_size), 1)
    if n - size < 2:
        raise ValueError(f"too few rows for a holdout: {n}")
    return size


def _hash_predicate(df: DataFrame, id_col: str, seed: int | str, quota: int, total: int) -> Column:
    """Predicate for the ``quota`` rows with the lowest (hash, id)."""
    if quota >= total:
        return F.lit(True)
    one = df.sparkSession.range(1).select(F.lit(1).alias("_g"), F.lit(total).alias("_size"), F.lit(quota).alias("_quota"))
    cut = lowest_hash_cutoffs(df.select(F.lit(1).alias("_g"), id_col), id_col, seed, one, ["_g"]).first()
    key = hash_key(id_col, seed)
    return (key < cut["_cut_hash"]) | ((key == cut["_cut_hash"]) & (F.col(id_col) <= F.lit(cut["_cut_id"])))


def sample_exact(df: DataFrame, id_col: str, n: int, seed: int | str, total: int | None = None) -> DataFrame:
    """Exactly ``n`` rows (all when there are fewer), by a cut-off on the hash of the unique id; nothing is sorted."""
    return df.filter(_hash_predicate(df, id_col, seed, n, df.count() if total is None else total))


def sample_with_replacement(df: DataFrame, id_col: str, k: int, seed: int | str) -> DataFrame:
    """k draws; without replacement while k fits, else each draw hashes onto a position."""
    n = df.count()
    if k <= n:
        return sample_exact(df, id_col, k, seed).withColumn("draws", F.lit(1).cast("bigint"))
    spots = positions(df.select(id_col), [id_col])
    draws = df.sparkSession.range(1, k + 1).select((F.pmod(hash_key("id", seed), F.lit(n)) + 1).alias("position"))
    counted = draws.groupBy("position").agg(F.count("*").alias("draws"))
    chosen = spots.join(counted, "position").select(id_col, "draws")
    return df.join(chosen, id_col)


def split_by_time(df: DataFrame, time: Column, id_col: str, test_size: float) -> DataFrame:
    """Adds split: the last rows by (time nulls first, id) are 'test'."""
    facts = df.agg(F.count("*").alias("n"), F.count_if(time.isNull()).alias("nulls")).first()
    first = order_cutoff(df, time, id_col, facts["n"] - holdout_size(facts["n"], test_size), facts["n"], facts["nulls"])
    return df.withColumn("split", F.when(first, "train").otherwise("test"))


def split_random(df: DataFrame, id_col: str, test_size: float, seed: int | str) -> DataFrame:
    n = df.count()
    first = _hash_predicate(df, id_col, seed, n - holdout_size(n, test_size), n)
    return df.withColumn("split", F.when(first, "train").otherwise("test"))


def sample_stratified(df: DataFrame, id_col: str, strata: Sequence[str], n: int, seed: int | str, top_up: bool = True) -> DataFrame:
    """Proportional sample with at least one row per stratum; with top_up trimmed or filled to exactly ``n``.

    Quotas round half to even. Only per-stratum counters and a narrow band of hash keys are shuffled, so a stratum that
    holds most of the table is as cheap as any other.
    """
    sizes = materialise(df.groupBy(*strata).agg(F.count("*").alias("_size")))
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    share = F.bround(F.col("_size") * F.lit(float(n)) / F.lit(float(max(total, 1))), 0).cast("bigint")
    quotas = sizes.withColumn("_quota", F.least(F.col("_size"), F.greatest(F.lit(1), share)))
    cutoffs = materialise(lowest_hash_cutoffs(df, id_col, seed, quotas, strata))
    key = hash_key(id_col, seed)
    marked = null_safe_join(df, cutoffs, list(strata), "left").withColumn(
        "_in", (key < F.col("_cut_hash")) | ((key == F.col("_cut_hash")) & (F.col(id_col) <= F.col("_cut_id")))
    ).drop("_cut_hash", "_cut_id")
    chosen, rest = marked.filter("_in").drop("_in"), marked.filter(~F.col("_in")).drop("_in")
    if not top_up:
        return chosen
    size = quotas.agg(F.sum("_quota")).first()[0] or 0
    if size > n:
        return sample_exact(chosen, id_col, n, f"{seed}_trim", size)
    if size < n:
        return chosen.unionByName(sample_exact(rest, id_col, n - size, f"{seed}_fill", total - size))
    return chosen


def fold_count(groups: int, folds: int) -> int:
    return min(folds, max(2, groups))


def group_folds(df: DataFrame, group: str, folds: int, seed: int | str = "group", name: str = "fold") -> DataFrame:
    """All rows of a group share a fold; null groups form the group 'unknown'. No shuffle."""
    return df.withColumn(name, hash_fold(F.coalesce(F.col(group).cast("string"), F.lit("unknown")), folds, seed))


#: Groups that are placed one by one; the rest are small beside a fold and are dealt in snake order.
LARGE_GROUPS = 2_000


def balanced_group_folds(df: DataFrame, group: str, folds: int, name: str = "fold") -> DataFrame:
    """Groups by falling size go to the fold with the fewest rows, ties to the lower fold.

    The LARGE_GROUPS largest are placed one by one. The others differ little from their neighbours in size, so they fill
    what room the folds have left: each takes the fold whose share of the remaining rows its place falls into.
    """
    keyed = df.withColumn("_g", F.coalesce(F.col(group).cast("string"), F.lit("unknown")))
    sizes = materialise(keyed.groupBy("_g").agg((-F.count("*")).alias("_neg_size")))
    largest = sizes.orderBy("_neg_size", "_g").limit(LARGE_GROUPS).collect()
    load, placed = [0] * folds, []
    for row in largest:
        fold = min(range(folds), key=lambda k: (load[k], k))
        load[fold] -= row["_neg_size"]
        placed.append((row["_g"], fold))
    spark = df.sparkSession
    one_by_one = spark.createDataFrame(placed, f"_g string, {name} int")
    rest = sizes.join(one_by_one.select("_g"), "_g", "left_anti")
    left = -(rest.agg(F.sum("_neg_size")).first()[0] or 0)
    dealt = one_by_one
    if left:
        level = _water_level(load, left)
        # Rows before each group, largest first, tell whose room it takes.
        at, chain, upto = F.col("_before"), F, 0
        for k, full in enumerate(load):
            upto += max(level - full, 0)
            chain = chain.when(at < upto, F.lit(k))
        spread = running_totals(rest, ["_neg_size", "_g"], {"_before": -F.col("_neg_size")})
        dealt = dealt.unionByName(spread.select("_g", chain.otherwise(F.lit(folds - 1)).cast("int").alias(name)))
    return keyed.join(dealt, "_g").drop("_g")


def _water_level(load: list[int], rows: int) -> float:
    """The level to which `rows` more rows fill up the folds."""
    filled, level = sorted(load), 0.0
    for k in range(1, len(filled) + 1):
        level = (sum(filled[:k]) + rows) / k
        if k == len(filled) or level <= filled[k]:
            break
    return level


def row_folds(df: DataFrame, id_col: str, folds: int, seed: int | str, name: str = "fold") -> DataFrame:
    return df.withColumn(name, hash_fold(id_col, folds, seed))


def cv_folds(df: DataFrame, id_col: str, group: str, folds: int, seed: int | str) -> DataFrame:
    """Balanced group folds when there are enough groups, else row folds."""
    groups = df.select(F.coalesce(F.col(group).cast("string"), F.lit("unknown")).alias("g")).distinct().limit(folds).count()
    k = fold_count(groups, folds)
    return balanced_group_folds(df, group, k) if groups >= k else row_folds(df, id_col, k, seed)


def _poisson_cumulative() -> list[float]:
    """Cumulative probabilities of a Poisson(1) count, up to where a 53-bit uniform has nothing left."""
    out, term, total = [], math.exp(-1), 0.0
    while term > 2.0**-54:
        total += term
        out.append(total)
        term /= len(out)
    return out


POISSON_CUMULATIVE = _poisson_cumulative()


#: Draws are (a x + b) mod PRIME of a row's hash x, with a and b of the replicate.
PRIME = (1 << 31) - 1


def bootstrap_limits() -> list[int]:
    """A draw's weight is the number of these limits that it reaches: a Poisson(1) count."""
    return [limit for limit in (int(c * PRIME) for c in POISSON_CUMULATIVE) if limit < PRIME]


def bootstrap_factors(replicates: int, seed: int) -> tuple[list[int], list[int]]:
    """a and b of replicates 1 to ``replicates``, from md5 of "replicate_seed_a" and "replicate_seed_b"."""
    draw = lambda r, part: int(hashlib.md5(f"{r}_{seed}_{part}".encode()).hexdigest()[:HASH_HEX_DIGITS], 16)
    return [draw(r, "a") % (PRIME - 1) + 1 for r in range(1, replicates + 1)], [draw(r, "b") % PRIME for r in range(1, replicates + 1)]


def bootstrap_weights(key: np.ndarray, a: np.ndarray, b: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """(keys, replicates): how often each replicate draws each key. PRIME is 2**31 - 1, so the remainder of a product is the
    sum of its low and high 31 bits, and limits are compared one by one; both run over whole registers."""
    product = key[:, None] * a + b
    drawn = ((product & PRIME) + (product >> 31)).astype(np.uint32)
    drawn -= (drawn >= PRIME) * np.uint32(PRIME)
    weight = np.zeros(drawn.shape, dtype=np.uint8)
    for limit in limits.astype(np.uint32):
        weight += drawn >= limit
    return weight


def bootstrap_sums(df: DataFrame, value: str, id_col: str, by: Sequence[str], replicates: int = 1000, seed: int = 42, rows_at_once: int = 128) -> DataFrame:
    """by + replicate, weight, total: how often rows were drawn, and the sum of their values, by Poisson bootstrap.

    A task adds its rows to one array of sums a group; what is shuffled is the replicates of each group and task, and no
    row is copied. Rows of one id, such as those of several models, are drawn once and share their weights. Draws depend on the row's id, the seed and the replicate only; null values are not drawn.
    """
    by = list(by)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    factors = [np.array(x, dtype=np.int64) for x in bootstrap_factors(replicates, seed)]
    limits = np.array(bootstrap_limits(), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        types = None
        for batch in batches:
            if not len(batch):
                continue
            types = [batch.schema.field(k).type for k in range(len(by))]
            encoded = [batch.column(k).dictionary_encode() for k in range(len(by))]
            codes = np.stack([e.indices.fill_null(-1).to_numpy() for e in encoded], axis=1)
            groups, place = np.unique(codes, axis=0, return_inverse=True)
            place = place.ravel()
            x, key = batch.column(len(by)).to_numpy(), batch.column(len(by) + 1).to_numpy()
            names = [tuple(None if c < 0 else e.dictionary[c].as_py() for c, e in zip(row, encoded, strict=True)) for row in groups.tolist()]
            keys, at = np.unique(key, return_inverse=True)
            order = np.argsort(at, kind="stable")
            ends = np.searchsorted(at[order], np.arange(len(keys) + rows_at_once, step=rows_at_once))
            found = np.zeros((2 * len(names), replicates))
            for k, a in enumerate(range(0, len(keys), rows_at_once)):
                some = order[ends[k] : ends[k + 1]]
                drawn = bootstrap_weights(keys[a : a + rows_at_once], *factors, limits).astype(np.float64)
                cell = place[some] * drawn.shape[0] + at[some] - a
                for part, each in enumerate((None, x[some])):
                    shares = np.bincount(cell, each, minlength=len(names) * drawn.shape[0]).reshape(len(names), -1)
                    found[part :: 2] += shares @ drawn
            for g, name in enumerate(names):
                total = sums.setdefault(name, np.zeros((2, replicates)))
                total += found[2 * g : 2 * g + 2]
        for name, total in sums.items():
            columns = [pa.array([v] * replicates, t) for v, t in zip(name, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(1, replicates + 1, dtype=np.int32)), pa.array(total[0].astype(np.int64)), pa.array(total[1])], names=[*by, "replicate", "weight", "total"])

    slim = df.select(*by, F.col(value).cast("double").alias("_x"), F.pmod(hash_key(id_col, seed), F.lit(PRIME)).alias("_k")).where("_x is not null")
    parts = slim.mapInArrow(run, f"{kinds}, replicate int, weight bigint, total double")
    return parts.groupBy(*by, "replicate").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))


def bootstrap_mean_ci(df: DataFrame, value: str, id_col: str, by: Sequence[str] = (), replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Poisson bootstrap of a mean: by + mean, ci_low, ci_high (2.5 % and 97.5 %)."""
    if not by:
        return bootstrap_mean_ci(df.withColumn("_all", F.lit(1)), value, id_col, ["_all"], replicates, seed).drop("_all")
    by = list(by)
    means = bootstrap_sums(df, value, id_col, by, replicates, seed).where("weight > 0").withColumn("_m", F.col("total") / F.col("weight"))
    interval = means.groupBy(*by).agg(F.percentile("_m", 0.025).alias("ci_low"), F.percentile("_m", 0.975).alias("ci_high"))
    mean = df.groupBy(*by).agg(F.avg(value).alias("mean"))
    return null_safe_join(mean, interval, by, "inner")
