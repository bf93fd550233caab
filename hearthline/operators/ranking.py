"""Exact order statistics without collecting a group or the whole table in one task.

* ``exact_quantiles``: a mergeable sketch brackets each wanted rank, everything outside the brackets collapses to a
  few counters before the shuffle, and only the distinct values inside the brackets are ordered.
* ``running_totals``: range partitioning plus per-partition offsets, for when every row needs its position.
* ``order_cutoff``: the row at a given position of a two-key order, as two bracketed selections.
* ``lowest_hash_cutoffs``: the same for md5 order keys, whose known uniform law replaces the sketch.

Sketch bounds are checked against exact counts; a rank outside its bracket is sought again in a wider one, up to the whole
range, so it never gives a wrong row and no size stops a query. A bracket with too many rows to order is narrowed first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.functions.hashing import HASH_SPACE, hash_key
from hearthline.session import materialise

SKETCH_ACCURACY = 50_000
#: Groups up to this size have one bracket from end to end.
SMALL_GROUP = 20_000
#: Rows of a global bracket that are ordered at once; a bracket with more is narrowed by another pass.
MOST_INSIDE = 2_000_000
#: Groups whose sketches are broadcast, some 200 bytes each; with more of them the join is left to adaptive execution.
BROADCAST_GROUPS = 20_000
#: Factors by which brackets are widened when a rank was missed; the last takes the whole range.
WIDER = (1, 20, 400, None)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join where null keys meet null keys; the right keys are dropped."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    condition = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_right_{key}")) for key in keys])
    return left.join(renamed, condition, how).drop(*[f"_right_{key}" for key in keys])


def _bracket_ends(probs: Sequence[float], accuracy: int, wider: int | None = 1) -> list[tuple[float, float]]:
    """Sketch error plus at least two ranks on each side, for any group larger than SMALL_GROUP."""
    margin = 1.0 if wider is None else wider * (1.0 / accuracy + 2.5 / SMALL_GROUP)
    return [(max(p - margin, 0.0), min(p + margin, 1.0)) for p in probs]


def _sketch(value: Column, ends: list[tuple[float, float]], accuracy: int) -> Column:
    return F.struct(
        F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.percentile_approx(value, [e for pair in ends for e in pair], accuracy).alias("edges"),
    )


def _bracket_key(value: Column, n: Column, least: Column, most: Column, edges: Sequence[Column], ends: list[tuple[float, float]]) -> Column:
    """struct(k, o): the value itself with o = 0 inside a bracket, else the end of the last bracket below with o = 1.

    Groups up to SMALL_GROUP rows have one bracket from end to end.
    """
    small = n <= SMALL_GROUP
    previous = F.when(F.lit(False), least)
    chain = F
    for i, (low_p, high_p) in enumerate(ends):
        low = least if low_p <= 0 else F.when(small, least).otherwise(edges[2 * i])
        high = most if high_p >= 1 else F.when(small, most).otherwise(edges[2 * i + 1])
        chain = chain.when(value < low, F.struct(previous.alias("k"), F.lit(1).alias("o")))
        chain = chain.when(value <= high, F.struct(value.alias("k"), F.lit(0).alias("o")))
        previous = high
    return chain.otherwise(F.struct(previous.alias("k"), F.lit(1).alias("o")))


def _running_counts(tagged: DataFrame, by: list[str]) -> DataFrame:
    """Counts per (group, key) and their running totals; ``tagged`` has by, _n and the key struct _b."""
    flat = tagged.select(*by, "_n", F.col("_b.k").alias("_k"), F.col("_b.o").alias("_o"))
    counted = flat.groupBy(*by, "_n", "_k", "_o").agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*by).orderBy(F.col("_k").asc_nulls_first(), "_o")
    return counted.withColumn("_cum", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _bracketed_counts(rows: DataFrame, by: list[str], probs: Sequence[float], accuracy: int, wider: int | None = 1) -> DataFrame:
    """Counts per (group, value) inside the brackets and per gap outside them, with running totals per group.

    The rows are never exchanged on the group: the sketches, one row per group, go to them.
    """
    ends = _bracket_ends(probs, accuracy, wider)
    value = F.col("_v")
    if not by:
        facts = _narrowed(rows, rows.agg(_sketch(value, ends, accuracy).alias("s")).first()["s"].asDict(), probs, ends, accuracy)
        return _running_counts(rows.select(F.lit(facts["n"]).alias("_n"), _literal_key(value, facts, ends, rows.schema["_v"].dataType).alias("_b")), by)
    summary = materialise(rows.groupBy(*by).agg(_sketch(value, ends, accuracy).alias("_s")))
    side = F.broadcast(summary) if summary.count() <= BROADCAST_GROUPS else summary
    joined = null_safe_join(rows, side, by, "inner")
    edges = [F.element_at("_s.edges", i + 1) for i in range(2 * len(ends))]
    key = _bracket_key(value, F.col("_s.n"), F.col("_s.least"), F.col("_s.most"), edges, ends)
    return _running_counts(joined.select(*by, F.col("_s.n").alias("_n"), key.alias("_b")), by)


def _narrowed(rows: DataFrame, facts: dict, probs: Sequence[float], ends: list[tuple[float, float]], accuracy: int) -> dict:
    """Brackets of a whole table hold a share of it; where that is more than MOST_INSIDE rows, a sketch of the rows inside
    gives closer edges. Edges only move while the wanted ranks stay strictly between them."""
    n, edges = facts["n"], list(facts["edges"] or [])
    value = F.col("_v")
    for i, p in enumerate(probs if edges else ()):
        low_p, high_p = ends[i]
        while (high_p - low_p) * n > MOST_INSIDE and n > SMALL_GROUP:
            low = edges[2 * i] if low_p > 0 else facts["least"]
            high = edges[2 * i + 1] if high_p < 1 else facts["most"]
            inside = value.between(F.lit(low), F.lit(high))
            counts = rows.agg(F.count_if(value < F.lit(low)).alias("below"), F.count_if(inside).alias("inside")).first()
            size, at = counts["inside"], (n - 1) * p - counts["below"]
            if size <= MOST_INSIDE or not 0 <= at < size:
                break
            near = [max((at - 3) / size - 2.0 / accuracy, 0.0), min((at + 4) / size + 2.0 / accuracy, 1.0)]
            closer = rows.filter(inside).agg(F.percentile_approx(value, near, accuracy).alias("e")).first()["e"]
            if closer == [low, high]:
                break  # few distinct values, which fold into few counters
            edges[2 * i], edges[2 * i + 1] = closer
            ends[i] = low_p, high_p = max(low_p, 1e-12), min(high_p, 1 - 1e-12)
            if near[1] - near[0] >= 0.5:
                break
    return facts | {"edges": edges or None}


def _literal_key(value: Column, facts, ends: list[tuple[float, float]], kind: T.DataType = T.DoubleType()) -> Column:
    """Key struct from a fetched sketch row."""
    edges = [F.lit(e).cast(kind) for e in (facts["edges"] or [None] * (2 * len(ends)))]
    return _bracket_key(value, F.lit(facts["n"]), F.lit(facts["least"]).cast(kind), F.lit(facts["most"]).cast(kind), edges, ends)


def _value_at(rank: Column) -> tuple[Column, Column]:
    """Aggregates: the value at a 1-based rank of a running count, and whether a gap counter holds that rank."""
    reached = F.col("_cum") >= rank
    inside = reached & (F.col("_o") == 0)
    hit = F.min(F.when(inside, F.col("_cum")))
    return F.min(F.when(inside, F.col("_k"))), ~hit.eqNullSafe(F.min(F.when(reached, F.col("_cum"))))


def exact_quantiles(
    df: DataFrame, value: str | Column, probs: Mapping[str, float], by: Sequence[str] = (), accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """Linear-interpolated quantiles per group (null groups kept, null values ignored): by + n_values + one column per name."""
    by = list(by)
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    ordered, out = sorted(set(probs.values())), None
    for wider in WIDER:
        found = materialise(_interpolated(_bracketed_counts(rows, by, ordered, accuracy, wider), by, probs, ordered))
        done = found.filter(~F.col("_missed")).drop("_missed")
        out = done if out is None else out.unionByName(done)
        missed = found.filter("_missed").select(*by, F.lit(True).alias("_again"))
        if missed.isEmpty():
            break
        rows = null_safe_join(rows, missed, by, "inner").drop("_again") if by else rows
    return out


def _interpolated(counts: DataFrame, by: list[str], probs: Mapping[str, float], ordered: Sequence[float]) -> DataFrame:
    picks, missed = [], []
    for i, p in enumerate(ordered):
        at = (F.col("_n") - 1) * F.lit(float(p))
        for name, rank in ((f"_l{i}", F.floor(at) + 1), (f"_h{i}", F.ceil(at) + 1)):
            found, outside = _value_at(rank)
            picks.append(found.alias(name))
            missed.append(outside)
    picked = counts.groupBy(*by).agg(F.first("_n").alias("n_values"), *picks, reduce(lambda a, b: a | b, missed).alias("_missed"))
    columns = []
    for name, p in probs.items():
        i = ordered.index(p)
        at = (F.col("n_values") - 1) * F.lit(float(p))
        columns.append((F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (at - F.floor(at))).alias(name))
    # An aggregate without groups has a row even for an empty table.
    return picked.select(*by, "n_values", *columns, (F.col("_missed") & F.col("n_values").isNotNull()).alias("_missed"))


def quantile_bounds(
    df: DataFrame, columns: Sequence[str], probs: Mapping[str, float], accuracy: int = SKETCH_ACCURACY
) -> dict[str, dict[str, float | None]]:
    """Exact global quantiles of several columns in two passes, fetched as one small row per column for use as literals."""
    ordered, wanted, found = sorted(set(probs.values())), list(columns), {}
    for wider in WIDER:
        ends = _bracket_ends(ordered, accuracy, wider)
        values = {c: F.col(c).cast("double") for c in wanted}
        sketches = df.agg(*[_sketch(value, ends, accuracy).alias(f"s{i}") for i, value in enumerate(values.values())]).first()
        items = []
        for i, (c, value) in enumerate(values.items()):
            own = list(ends)
            facts = _narrowed(df.select(value.alias("_v")), sketches[f"s{i}"].asDict(), ordered, own, accuracy)
            items.append(F.struct(F.lit(c).alias("measure"), F.lit(facts["n"]).alias("_n"), value.alias("_v"), _literal_key(value, facts, own).alias("_b")))
        long = df.select(F.explode(F.array(*items)).alias("m")).select("m.*").filter(F.col("_v").isNotNull())
        rows = _interpolated(_running_counts(long, ["measure"]), ["measure"], probs, ordered).collect()
        found |= {row["measure"]: {name: row[name] for name in probs} for row in rows if not row["_missed"]}
        wanted = [row["measure"] for row in rows if row["_missed"]]
        if not wanted:
            break
    return {c: found.get(c, dict.fromkeys(probs)) for c in columns}


def select_rank(df: DataFrame, value: str, rank: int, total: int, accuracy: int = SKETCH_ACCURACY) -> tuple[object, int, int]:
    """The value at a 1-based rank of a non-null orderable number, the rows strictly below it, and the rows equal to it."""
    rows = df.select(F.col(value).alias("_v"))
    at_rank = (F.col("_cum") >= rank) & (F.col("_cum") - F.col("_c") < rank)
    for wider in WIDER:
        counts = _bracketed_counts(rows, [], [(rank - 0.5) / total], accuracy, wider)
        row = counts.filter(at_rank).select("_k", "_o", "_c", (F.col("_cum") - F.col("_c")).alias("below")).first()
        if row is not None and row["_o"] == 0:
            return row["_k"], row["below"], row["_c"]
    raise ArithmeticError(f"there is no rank {rank} of {total}")


def order_cutoff(df: DataFrame, key: Column, tie: str, rank: int, total: int, nulls: int) -> Column:
    """Predicate for the first ``rank`` rows in (key nulls first, tie) order; tie is a unique integer id.

    ``total`` and ``nulls`` are the row count and the count of null keys.
    """
    slim = df.select(key.alias("_key"), F.col(tie).alias("_tie"))
    if rank <= nulls:
        last_tie, _, _ = select_rank(slim.filter(F.col("_key").isNull()), "_tie", rank, nulls)
        return key.isNull() & (F.col(tie) <= F.lit(last_tie))
    present = slim.filter(F.col("_key").isNotNull())
    last_key, below, ties = select_rank(present, "_key", rank - nulls, total - nulls)
    if rank - nulls == below + ties:
        return key.isNull() | (key <= F.lit(last_key))
    last_tie, _, _ = select_rank(present.filter(F.col("_key") == F.lit(last_key)), "_tie", rank - nulls - below, ties)
    return key.isNull() | (key < F.lit(last_key)) | ((key == F.lit(last_key)) & (F.col(tie) <= F.lit(last_tie)))


def lowest_hash_cutoffs(df: DataFrame, id_col: str, seed: int | str, quotas: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group (by, _size, _quota given) the last (hash, id) pair among the ``_quota`` lowest.

    Hash keys are uniform, so the cut lies within a narrow band around quota/size: rows below the band fold into one
    counter per task and only band rows are ordered. A band that misses the cut fails the query.
    """
    by = list(by)
    margin = 10.0 * F.sqrt("_quota") + 100.0
    step = F.lit(HASH_SPACE) / F.col("_size")
    keyed = null_safe_join(df.select(*by, F.col(id_col).alias("_id"), hash_key(id_col, seed).alias("_h")), quotas, by, "inner")
    reached = keyed.filter(F.col("_h") <= (F.col("_quota") + margin) * step)
    in_band = F.col("_h") >= (F.col("_quota") - margin) * step
    folded = reached.select(*by, "_quota", F.when(in_band, F.col("_h")).alias("_h"), F.when(in_band, F.col("_id")).alias("_id"))
    counted = folded.groupBy(*by, "_quota", "_h", "_id").agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*by).orderBy(F.col("_h").asc_nulls_first(), "_id").rowsBetween(Window.unboundedPreceding, 0)
    at_cut = (F.col("_cum") == F.col("_quota")) & F.col("_h").isNotNull()
    last = counted.withColumn("_cum", F.sum("_c").over(order)).groupBy(*by, "_quota").agg(
        F.max(F.when(at_cut, F.col("_h"))).alias("_cut_hash"), F.max(F.when(at_cut, F.col("_id"))).alias("_cut_id")
    )
    checked = F.when((F.col("_quota") > 0) & F.col("_cut_hash").isNull(), F.raise_error(F.lit("hash band missed the cut")))
    return last.select(*by, F.coalesce(checked.cast("bigint"), F.col("_cut_hash")).alias("_cut_hash"), "_cut_id")


def running_totals(df: DataFrame, order: Sequence[str], sums: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Adds, per name, the sum over all earlier rows of the group; ``by + order`` must be unique.

    Rows are range-partitioned (a hot group spreads over many partitions), written once so that the boundaries are
    fixed, and completed with per-partition offsets; no task sees more than its range.
    """
    by, order = list(by), list(order)
    values = df.withColumns({f"_s_{name}": column for name, column in sums.items()})
    ranged = materialise(values.repartitionByRange(*[F.col(c) for c in by + order]).withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy("_pid", *by).agg(*[F.sum(f"_s_{name}").alias(f"_t_{name}") for name in sums])
    earlier = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid", *by, *[F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_b_{name}") for name in sums]
    )
    inside = Window.partitionBy("_pid", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumns({f"_w_{name}": F.coalesce(F.sum(f"_s_{name}").over(inside), F.lit(0)) for name in sums})
    joined = null_safe_join(placed, offsets, ["_pid", *by], "inner")
    return joined.select(*df.columns, *[(F.col(f"_w_{name}") + F.col(f"_b_{name}")).alias(name) for name in sums])


def positions(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "position") -> DataFrame:
    """1-based position of every row in a total order."""
    placed = running_totals(df, order, {"_before": F.lit(1)}, by)
    return placed.withColumn(name, F.col("_before") + 1).drop("_before")


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per distinct value: by + value + ties + avg_rank (+ extra aggregates over the tied rows)."""
    tied = df.groupBy(*by, value).agg(F.count("*").alias("ties"), *[c.alias(n) for n, c in (extra or {}).items()])
    placed = running_totals(tied, [value], {"_before": F.col("ties")}, by)
    return placed.withColumn("avg_rank", F.col("_before") + (F.col("ties") + 1) / 2.0).drop("_before")
