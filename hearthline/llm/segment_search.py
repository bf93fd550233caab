"""Exact top-k by inner product, pruned with segment means and deviations from coarse to fine.

A vector is cut into segments. For a segment of length L with means a, b and standard deviations s, t of the query and a
candidate, the distance has the lower bound L * ((a - b)^2 + (s - t)^2); since the squared lengths of both vectors are
known exactly, that is the upper bound sum(L * (a * b + s * t)) of their inner product, which is used here directly. Bounds
are taken for few long segments first, then for more and shorter ones; a candidate is dropped as soon as its bound is
below the k-th best score found for the query. Survivors get the exact integer product. Bounds carry a margin for
rounding, so no candidate of the result can be dropped.

Queries are handled in blocks of bounded size, which are sent to all tasks; each block scans the candidates once and leaves
at most k rows for each query and task, so nothing like queries x candidates is shuffled. A block's result is written
before the next one starts.

Defined results: vectors that are null or empty or hold null or non-finite components take no part, neither as queries
nor as candidates; only vectors of the query's length are candidates; a row with the query's id is not a candidate;
repeated candidate rows keep a rank each, repeated query rows are one query; ties go to the smaller id. Components are
floor(1024 * x) held as integers; a vector with one beyond 2^40 is scored with unbounded integers, and scores saturate
at the range of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import columns_only, materialise, scratch_path

SCALE = 1024
#: Queries in a block; rows of candidates handled at a time.
QUERIES, ROWS = 4096, 2048
LEVELS = (4, 8, 16)
#: Products of vectors with components up to this are exact in 64-bit floats for any length up to 2^13.
SAFE = 1 << 20
TOP, BOTTOM = (1 << 63) - 1, -(1 << 63)


def whole_numbers(batch: pa.RecordBatch, ids: str, vectors: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and floor(1024 * x) of the usable rows, as 64-bit floats that hold integers."""
    column, keys = batch.column(batch.schema.get_field_index(vectors)), batch.column(batch.schema.get_field_index(ids))
    out: dict[int, tuple[list, list]] = {}
    offsets = column.offsets.to_numpy()
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    valid = column.is_valid().to_numpy(zero_copy_only=False) & keys.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for n in np.unique(lengths[valid]).tolist():
        if n:
            rows = np.flatnonzero(valid & (lengths == n))
            block = values[offsets[rows][:, None] + np.arange(n)]
            fine = np.isfinite(block).all(axis=1)
            out[n] = (keys.take(pa.array(rows[fine])).to_numpy().astype(np.int64), np.floor(block[fine] * SCALE))
    return out


def statistics(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows of sqrt(L) * mean and sqrt(L) * deviation of each segment: a product of two such rows is the bound."""
    cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    size = np.diff(cuts)
    sums = np.add.reduceat(x, cuts[:-1], axis=1)
    means = sums / size
    spread = np.sqrt(np.maximum(np.add.reduceat((x - np.repeat(means, size, axis=1)) ** 2, cuts[:-1], axis=1), 0))
    return np.concatenate([means * np.sqrt(size), spread], axis=1)


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.k, self.score = k, np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), TOP)

    def offer(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Adds (query place, id, score) entries; per query only the k best by (score, smaller id) stay."""
        if not len(query):
            return
        touched = np.unique(query)
        rows = np.concatenate([np.repeat(touched, self.k), query])
        score = np.concatenate([self.score[touched].ravel(), score])
        ids = np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((ids, -score, rows))
        rows, score, ids = rows[order], score[order], ids[order]
        starts = np.searchsorted(rows, touched)
        take = starts[:, None] + np.arange(self.k)
        self.score[touched], self.ids[touched] = score[take], ids[take]


def search_block(best: Best, queries: np.ndarray, own: np.ndarray, levels: list[np.ndarray], ids: np.ndarray, x: np.ndarray) -> None:
    """Coarse to fine over one run of candidates."""
    floor = best.score[:, -1]
    norms = np.sqrt((queries**2).sum(axis=1))
    pairs = None
    for parts, stats in zip(LEVELS, levels, strict=True):
        mine = statistics(x, parts)
        margin = 1e-9 * norms.max(initial=0) * np.sqrt((x**2).sum(axis=1)).max(initial=0) + 1e-6
        if pairs is None:
            pairs = np.nonzero(stats @ mine.T + margin >= floor[:, None])
        else:
            bound = np.einsum("ij,ij->i", stats[pairs[0]], mine[pairs[1]])
            keep = bound + margin >= floor[pairs[0]]
            pairs = pairs[0][keep], pairs[1][keep]
        if not len(pairs[0]):
            return
        if len(pairs[0]) > 0.2 * len(queries) * len(x):
            break  # too many survive for pairwise work: exact products of whole blocks are cheaper
    if len(pairs[0]) > 0.2 * len(queries) * len(x):
        score = (queries @ x.T)[pairs]
    else:
        score = np.concatenate([np.einsum("ij,ij->i", queries[pairs[0][k : k + 65_536]], x[pairs[1][k : k + 65_536]]) for k in range(0, len(pairs[0]), 65_536)])
    keep = (score >= floor[pairs[0]]) & (own[pairs[0]] != ids[pairs[1]])
    best.offer(pairs[0][keep], ids[pairs[1]][keep], score[keep])


def exact_scores(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """For vectors beyond the exact range of floats: integers without bound, saturated at the end."""
    whole = [[int(v) for v in row] for row in x]
    for i, q in enumerate(queries):
        q = [int(v) for v in q]
        scores = ((sum(a * b for a, b in zip(q, row, strict=True)), int(c)) for row, c in zip(whole, ids, strict=True) if c != own[i])
        for score, c in sorted(scores, key=lambda s: (-s[0], s[1]))[:k]:
            yield i, c, min(max(score, BOTTOM), TOP)


def scan(candidates: DataFrame, block, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each task's candidates; `block` is a broadcast of {length: (ids, vectors)}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = {n: (own, q, np.abs(q).max(initial=0), [statistics(q, p) for p in LEVELS], Best(q, k)) for n, (own, q) in block.value.items()}
        extra: list[tuple[int, int, int]] = []
        for batch in batches:
            for n, (ids, x) in whole_numbers(batch, "vec_id", "embedding").items():
                if n not in queries:
                    continue
                own, q, top, levels, best = queries[n]
                for a in range(0, len(ids), ROWS):
                    part, names = x[a : a + ROWS], ids[a : a + ROWS]
                    large = np.abs(part).max(axis=1) > SAFE
                    if top > SAFE or n > 1 << 13:
                        large[:] = True
                    if large.any():
                        extra += [(int(own[i]), c, s) for i, c, s in exact_scores(q, own, names[large], part[large], k)]
                    if not large.all():
                        search_block(best, q, own, levels, names[~large], part[~large])
        rows = [(np.repeat(own, k), best.ids.ravel(), best.score.ravel()) for own, _, _, _, best in queries.values()]
        query, ids, score = (np.concatenate(c) for c in zip(*rows, strict=True)) if rows else (np.zeros(0),) * 3
        found = np.isfinite(score)
        yield pa.RecordBatch.from_arrays([pa.array(query[found].astype(np.int64)), pa.array(ids[found].astype(np.int64)), pa.array(score[found].astype(np.int64))], names=["query_id", "vec_id", "score"])
        if extra:
            yield pa.RecordBatch.from_arrays([pa.array([e[j] for e in extra], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long")


def usable(vectors: DataFrame) -> DataFrame:
    """Without ids or vectors that are null, and vectors that are empty or hold null or non-finite components."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return columns_only(vectors, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & ~bad)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_size: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each row of `queries` with the rows of `vectors`."""
    spark = vectors.sparkSession
    candidates = usable(vectors)
    asked = usable(queries).dropDuplicates(["vec_id"])
    total = asked.count()
    path = scratch_path(spark, "top_k")
    number = -(-total // block_size) or 1
    placed = materialise(asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(number))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for part in range(number):
        rows = placed.where(F.col("part") == part).select("vec_id", "embedding").toArrow()  # about block_size rows
        block: dict[int, list] = {}
        for batch in rows.to_batches():
            for n, (ids, q) in whole_numbers(batch, "vec_id", "embedding").items():
                block.setdefault(n, []).append((ids, q))
        shared = spark.sparkContext.broadcast({n: (np.concatenate([i for i, _ in b]), np.concatenate([q for _, q in b])) for n, b in block.items()})
        ranked = scan(candidates, shared, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)


def oracle(k: int = 10) -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""
