"""Near copies by min-max hashing, exact links and connected components.

A text's set is its distinct word shingles, as 64-bit hashes. Each of 64 permutations gives two signature values, the
smallest and the largest image of the set, so 64 evaluations make 128 values; both ends agree between two sets with the
probability of their similarity. 32 bands of four values each are matched: at similarity 0.8 a pair misses all bands with
a probability below 1e-7.

Texts with one set are one class, so copies never meet as pairs. Links between classes of a bucket are confirmed on full
sets, in two rounds:
 1. Each class is compared with two leaders of its buckets, and linked classes are joined to components.
 2. In buckets that still hold several components, classes outside the largest one are compared with all classes of other
    components. They meet in packed blocks of bounded size, whose intersections are counted at once; no pair becomes a row
    unless it is a link.
Pairs within a component need no comparison, since only components are returned; no link between components is lost.

Nothing is collected and no group is held by one task: classes and leaders are partial aggregates, blocks of a bucket
have bounded size, and joins on hot buckets can be split by adaptive execution.

Defined results: null, empty and blank texts have an empty set, are linked with nothing and form their own component;
a text with fewer words than a shingle has its whole sequence as one shingle; repeated rows share a class; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import columns_only, materialise, mix, release, shingle_sets

PERMUTATIONS, BANDS = 64, 32
#: Hashes and sets in a block of full sets, about.
BLOCK, BLOCK_SETS = 24_000, 400

_U = np.uint64
_RANDOM = np.random.default_rng(10).integers(1, 1 << 63, (2, PERMUTATIONS), dtype=np.uint64)
_FACTORS, _SHIFTS = _RANDOM[0] * _U(2) + _U(1), _RANDOM[1]
_PLACES = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64)) | _U(1)


def min_max(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(sets, 2 * PERMUTATIONS) signature values; every set has at least one hash. Work is done in runs that fit caches."""
    sets = len(bounds) - 1
    out = np.empty((2 * PERMUTATIONS, sets), dtype=np.uint64)
    first = 0
    while first < sets:
        end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + 32_768, side="right")) - 1)
        part, starts = hashes[bounds[first] : bounds[end]], bounds[first:end] - bounds[first]
        for k in range(PERMUTATIONS):
            image = part * _FACTORS[k] + _SHIFTS[k]
            out[2 * k, first:end] = np.minimum.reduceat(image, starts)
            out[2 * k + 1, first:end] = np.maximum.reduceat(image, starts)
        first = end
    return out.T


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(sets, BANDS) 64-bit keys; the band's number is part of its key."""
    rows = 2 * PERMUTATIONS // BANDS
    keyed = mix(signature * _PLACES).reshape(len(signature), BANDS, rows)
    return mix(keyed.sum(axis=2, dtype=np.uint64) + _PLACES[:BANDS])


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, f1, f2, bands): set size, a 128-bit fingerprint of the set, and its band keys (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for first, end, hashes, bounds in shingle_sets(batch.column(1), size):
                n = np.diff(bounds)
                full = np.flatnonzero(n > 0)
                f1, f2 = np.zeros((2, len(n)), dtype=np.uint64)
                keys = np.zeros((0, BANDS), dtype=np.uint64)
                if len(full):
                    starts = bounds[:-1][full]
                    f1[full] = np.add.reduceat(hashes, starts)
                    f2[full] = np.add.reduceat(mix(hashes + _U(1)), starts)
                    keys = band_keys(min_max(hashes, np.append(starts, bounds[-1])))
                lengths = np.where(n > 0, BANDS, 0)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), bands], names=["doc_id", "n", "f1", "f2", "bands"])

    return columns_only(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(cls, hashes) of each row, with cls its doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for first, end, hashes, bounds in shingle_sets(batch.column(1), size):
                sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), sets], names=["cls", "hashes"])

    return columns_only(docs, "doc_id", "text").mapInArrow(run, "cls bigint, hashes array<bigint>")


def similar(shared: Column, a: Column, b: Column, percent: int) -> Column:
    return shared * 100 >= (a + b - shared) * percent


def sizes_allow(a: Column, b: Column, percent: int) -> Column:
    """Necessary for a link: the smaller set has the needed share of the larger."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node reachable over `edges` (a, b), by alternating large and small stars.

    Each step sends the neighbours of a node to the smallest of them. Hubs are partial aggregates joined back.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b").distinct())
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        small = materialise(small.where("a <> b").distinct())
        count = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if count(small) == count(edges):
            return small.select(F.col("a").alias("node"), F.col("b").alias("component"))
        edges = small


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links on full sets."""
    left = sets.select(F.col("cls").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("cls").alias("b"), F.col("hashes").alias("hb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    return both.where(similar(shared, F.size("ha"), F.size("hb"), percent)).select("a", "b")


def block_links(left: tuple, right: tuple, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the links between two blocks of sets; a block is (hashes, bounds)."""
    (ha, ba), (hb, bb) = left, right
    na, nb = np.diff(ba), np.diff(bb)
    both = np.intersect1d(ha, hb)
    if not len(both):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def matrix(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
        rows = np.repeat(np.arange(len(n)), n)
        at = np.minimum(np.searchsorted(both, hashes), len(both) - 1)
        hit = both[at] == hashes
        m = np.zeros((len(n), len(both)), dtype=np.float32)
        m[rows[hit], at[hit]] = 1
        return m

    shared = (matrix(ha, na) @ matrix(hb, nb).T).astype(np.int64)  # sets are far below 2^24 here or alone in their block
    return np.nonzero(shared * 100 >= (na[:, None] + nb[None, :] - shared) * percent)


def remaining_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of a bucket. members: (bucket, cls, n, component), of which buckets with one
    component only are already done."""
    prints = [F.bit_xor(F.xxhash64("cls", F.lit(k))).alias(f"p{k}") for k in range(2)]
    mixed = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("k"), *prints).where("low < high")
    mixed = mixed.groupBy("k", "p0", "p1").agg(F.min("bucket").alias("bucket")).select("bucket")  # one of the buckets with the same classes
    left = materialise(members.join(mixed, "bucket"))
    counts = left.groupBy("bucket", "component").agg(F.count("*").alias("k"), F.sum("n").alias("hashes"))
    main = counts.groupBy("bucket").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("hashes").alias("hashes"), F.sum("k").alias("k"))
    chunk = F.pmod(F.xxhash64("cls"), F.greatest(F.ceil(F.col("hashes") / F.lit(BLOCK)), F.ceil(F.col("k") / F.lit(BLOCK_SETS)))).cast("int")
    placed = left.join(main, "bucket").select("bucket", "cls", "component", (F.col("component") != F.col("main")).alias("aside"), chunk.alias("chunk"))
    filled = placed.join(sets, "cls")
    blocks = materialise(filled.groupBy("bucket", "chunk", "aside").agg(F.collect_list(F.struct("cls", "component", "hashes")).alias("block")))
    ones = blocks.where("aside").select("bucket", F.col("chunk").alias("c1"), F.col("block").alias("one"))
    others = blocks.select("bucket", F.col("chunk").alias("c2"), F.col("aside").alias("aside2"), F.col("block").alias("other"))
    pairs = ones.join(others, "bucket").where("not aside2 or c1 <= c2").select("one", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        def unpack(column: pa.Array, i: int) -> tuple:
            block = column.slice(i, 1).flatten()
            cls, component, hashes = (block.field(k) for k in range(3))
            return cls.to_numpy(), component.to_numpy(), (hashes.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(hashes.value_lengths().to_numpy())]))

        for batch in batches:
            for i in range(len(batch)):
                a, ca, sa = unpack(batch.column(0), i)
                b, cb, sb = unpack(batch.column(1), i)
                x, y = block_links(sa, sb, percent)
                across = ca[x] != cb[y]
                yield pa.RecordBatch.from_arrays([pa.array(a[x[across]]), pa.array(b[y[across]]), pa.array(ca[x[across]]), pa.array(cb[y[across]])], names=["a", "b", "ca", "cb"])

    return pairs.mapInArrow(run, "a bigint, b bigint, ca bigint, cb bigint")


def near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row: the smallest doc_id reachable over links."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    rows = materialise(sketch(docs, size))
    classes = materialise(rows.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("cls")))
    heads = rows.where("n > 0").join(classes.select("cls", F.col("f1").alias("c1"), F.col("f2").alias("c2")), (F.col("doc_id") == F.col("cls")) & (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2")))
    placed = materialise(heads.select("cls", "n", F.explode("bands").alias("bucket")))
    crowds = placed.groupBy("bucket").agg(F.min("cls").alias("leader"), F.max("cls").alias("last")).where("leader < last")
    members = materialise(placed.join(crowds.select("bucket", "leader"), "bucket").dropDuplicates(["bucket", "cls"]))
    sizes = materialise(members.select("cls", "n").distinct())
    sets = materialise(full_sets(docs.join(sizes, docs["doc_id"] == sizes["cls"], "left_semi"), size).dropDuplicates(["cls"]))
    stars = members.where("leader < cls").groupBy("cls").agg(F.min("leader").alias("l1"), F.max("leader").alias("l2"))
    stars = stars.select("cls", F.explode(F.array_distinct(F.array("l1", "l2"))).alias("leader"))
    stars = stars.join(sizes, "cls").join(sizes.select(F.col("cls").alias("leader"), F.col("n").alias("m")), "leader")
    pairs = stars.where(sizes_allow(F.col("n"), F.col("m"), percent)).select(F.col("cls").alias("a"), F.col("leader").alias("b"))
    joined = materialise(components(confirm(pairs, sets, percent)))
    labelled = members.join(joined, members["cls"] == joined["node"], "left").select("bucket", "cls", "n", F.coalesce("component", "cls").alias("component"))
    more = materialise(remaining_links(labelled, sets, percent).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    again = components(more).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    known = joined.join(again, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    heads_of = again.select(F.col("component").alias("node"), F.col("whole").alias("component"))
    found = known.unionByName(heads_of).groupBy("node").agg(F.min("component").alias("component"))
    labels = classes.join(found, classes["cls"] == found["node"], "left").select("f1", "f2", F.coalesce("component", "cls").alias("component"))
    out = rows.where("n > 0").join(labels, ["f1", "f2"]).select("doc_id", "n", "component")
    out = out.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without near copies of a smaller doc_id, with all their columns. Rows of one doc_id stay or go
    together; rows without a doc_id stay."""
    gone = near_copies(docs, size, percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def oracle(size: int, percent: int) -> str:
    """Every pair of texts that share a shingle, counted and linked, then the smallest id reachable."""
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
 ELSE list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' ')) END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * k >= {percent} * (na + nb - k)),
reach AS (SELECT doc_id, doc_id AS c FROM sets UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.c) AS component_id, s.doc_id = min(r.c) AS kept FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.s"""
