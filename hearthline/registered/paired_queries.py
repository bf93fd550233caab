"""Paired significance tests (E7, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.operators import pairs
from hearthline.registered import views as v
from hearthline.registered.base import n, query, r, rounded

DIFFS = f"""WITH {v.SEEDED}, d AS (SELECT a.seed, a.model_name AS model_a, b.model_name AS model_b, round(a.absolute_error_wan - b.absolute_error_wan, 6) AS diff
  FROM v_seeded a JOIN v_seeded b ON a.house_id = b.house_id AND a.model_name < b.model_name)"""


def diffs(spark, folder, by=()):
    rows = pairs.model_pairs(v.seeded_predictions(spark, folder), pairs.all_pairs(v.MODELS), by)
    return rows.withColumn("diff", F.round("diff", 6))


@query(
    "i1_paired_t",
    f"{DIFFS} SELECT model_a, model_b, {n('count(*)', 'n')}, {r('avg(diff)', 'mean_diff')}, {r('avg(diff) / (stddev_samp(diff) / sqrt(count(*)))', 't_statistic')} FROM d GROUP BY 1, 2",
)
def i1(spark, folder):
    return rounded(pairs.paired_t(diffs(spark, folder)))


def ranks_sql(zero_method: str) -> str:
    keep = "WHERE diff <> 0" if zero_method == "wilcox" else ""
    return f"""{DIFFS}, k AS (SELECT *, abs(diff) AS size, rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY model_a, model_b, abs(diff)) - 1) / 2.0 AS rk FROM d {keep}),
    t AS (SELECT model_a, model_b, size, count(*) AS c FROM k GROUP BY 1, 2, 3),
    ts AS (SELECT model_a, model_b, sum(CASE WHEN size > 0 THEN c * 1.0 * c * c - c ELSE 0 END) AS tie_sum FROM t GROUP BY 1, 2),
    w AS (SELECT model_a, model_b, count(*) AS n_used, sum(CASE WHEN diff > 0 THEN rk WHEN diff = 0 THEN rk / 2 ELSE 0 END) AS w_plus, sum(CASE WHEN diff < 0 THEN rk WHEN diff = 0 THEN rk / 2 ELSE 0 END) AS w_minus,
      count(*) FILTER (WHERE diff = 0) AS zero_count FROM k GROUP BY 1, 2)
    SELECT model_a, model_b, {n('n_used', 'n_used')}, {r('w_plus', 'w_plus', 3)}, {r('w_minus', 'w_minus', 3)}, {r('tie_sum', 'tie_sum', 3)}, {n('zero_count', 'zero_count')} FROM w JOIN ts USING (model_a, model_b)"""


@query("i2_wilcoxon_drop_zeros", ranks_sql("wilcox"))
def i2(spark, folder):
    return rounded(pairs.signed_ranks(diffs(spark, folder)), 3)


@query("i2_wilcoxon_split_zeros", ranks_sql("zsplit"))
def i2_split(spark, folder):
    return rounded(pairs.signed_ranks(diffs(spark, folder), zero_method="zsplit"), 3)


@query(
    "e7_holm_adjustment",
    f"""{DIFFS}, t AS (SELECT seed, model_a, model_b, 1.0 / (1 + abs(avg(diff) / (stddev_samp(diff) / sqrt(count(*))))) AS p FROM d GROUP BY 1, 2, 3),
    o AS (SELECT *, row_number() OVER (ORDER BY p, seed, model_a, model_b) AS rk, count(*) OVER () AS m FROM t)
    SELECT {n('seed', 'seed')}, model_a, model_b, {r('p', 'p')}, {r('max(least((m - rk + 1) * p, 1.0)) OVER (ORDER BY rk ROWS UNBOUNDED PRECEDING)', 'p_holm')} FROM o""",
)
def e7(spark, folder):
    """Step-down adjustment over 15 tests, with a monotone stand-in for the tail probability."""
    tests = pairs.paired_t(diffs(spark, folder, ["seed"]), ["seed"]).withColumn("p", F.lit(1.0) / (1 + F.abs("t_statistic")))
    return rounded(pairs.holm(tests, "p", "p_holm", ["seed", "model_a", "model_b"]).select("seed", "model_a", "model_b", "p", "p_holm"))


@query("i3_significance_matrix")
def i3(spark, folder):
    """All model pairs with both tests, adjusted p values and the verdict; tail probabilities are beyond plain SQL."""
    return rounded(pairs.significance(diffs(spark, folder)), 6)


@query("i4_reference_significance")
def i4(spark, folder):
    """Two baselines against the region means, with a bootstrap interval."""
    return rounded(pairs.reference_significance(v.predictions(spark, folder), "region_mean", ["global_mean", "priority_mean"]))


@query(
    "i5_seed_comparison",
    f"""{DIFFS} SELECT {n('seed', 'seed')}, model_a, model_b, {n('count(*)', 'n')}, {r('avg(diff)', 'mean_diff')}, {r('avg(diff) / (stddev_samp(diff) / sqrt(count(*)))', 't_statistic')} FROM d WHERE model_a = 'global_mean' AND model_b = 'region_mean' GROUP BY 1, 2, 3""",
)
def i5(spark, folder):
    return rounded(pairs.seed_comparison(v.seeded_predictions(spark, folder), "global_mean", "region_mean"))
