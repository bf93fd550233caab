"""Ranked lexical search over all documents by presence masks.

Items are asked in blocks whose distinct terms have a bound. One pass counts, for the terms of a block, the documents that
hold them, besides the numbers of documents and terms of the whole table; a second pass ranks. In it a run of documents
is a bitmap for each term. For an item, the bitmaps of its terms are turned into one mask for each document, and documents
with equal masks form a group. The highest score a group can have follows from its mask, the largest occurrences of each
term in the run and the smallest length in the group. Groups are evaluated by descending highest score, exactly, until the
next one lies below the item's k-th best score so far; that score is carried from run to run, so most groups are never
evaluated. Groups that could still tie are evaluated, since a smaller id ranks first.

Each task hands on k rows for each item, ranked again after a shuffle. Terms are compared as 64-bit hashes; weights and
scores are 64-bit integers. Defined results: null and empty texts have no terms and are not ranked; repeated rows are
documents of their own; rows without an id count and rank after equal scores with an id. Items without terms or matches
have no rows; rows of one item_id are ranked each by its own text, and equal rows once; an empty table gives an empty
table. Texts and items may be of any length; columns other than ids and texts are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import byte_values, columns_only, hash_words, release, scratch_path, slices, text_bytes

#: Distinct terms at which a block of items is closed, and its most items.
TERMS, ITEMS = 20_000, 4_000
#: Bytes of text in a run, and cells of its table of terms by documents.
RUN, CELLS = 8 << 20, 16 << 20
NO_ID = np.iinfo(np.int64).max


def _between() -> np.ndarray:
    """Bytes that stand between terms: ASCII other than digits and letters."""
    inside = np.zeros(256, dtype=bool)
    for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        inside[low : high + 1] = True
    return ~inside


_VALUES = byte_values(_between())


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of many texts, and the texts' bounds."""
    return hash_words(data, offsets, _VALUES)


@dataclass
class Items:
    """A block of items: ids, the places of each one's terms in the sorted vocabulary, and the terms' weights."""

    ids: list[int | None]
    places: list[np.ndarray]
    vocabulary: np.ndarray
    weights: np.ndarray | None = None
    documents: int = 0
    occurrences: int = 0


def item_blocks(items: DataFrame, most: int = TERMS, at_once: int = ITEMS) -> Iterator[Items]:
    """Items with terms, read through the driver one partition at a time."""
    ids: list[int | None] = []
    sets: list[np.ndarray] = []
    known = 0
    for row in columns_only(items, "item_id", "text").where("text is not null").distinct().toLocalIterator():
        raw = np.frombuffer(row["text"].encode(), dtype=np.uint8)
        found = np.unique(terms(raw, np.array([0, len(raw)]))[0])
        if len(found):
            ids.append(row["item_id"])
            sets.append(found)
            known += len(found)
        if known >= most or len(ids) >= at_once:
            yield _block(ids, sets)
            ids, sets, known = [], [], 0
    if ids:
        yield _block(ids, sets)


def _block(ids: list[int | None], sets: list[np.ndarray]) -> Items:
    vocabulary = np.unique(np.concatenate(sets))
    return Items(ids, [np.searchsorted(vocabulary, s) for s in sets], vocabulary)


def occurrences(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms in each text), and (text, place in the vocabulary, occurrences) of the vocabulary's terms in them."""
    found, bounds = terms(data, offsets)
    lengths = np.diff(bounds)
    place = np.minimum(np.searchsorted(vocabulary, found), len(vocabulary) - 1)
    hit = vocabulary[place] == found
    cell, times = np.unique(np.repeat(np.arange(len(lengths)), lengths)[hit] * len(vocabulary) + place[hit], return_counts=True)
    return lengths, cell // len(vocabulary), cell % len(vocabulary), times


def count_documents(docs: DataFrame, shared) -> DataFrame:
    """(place, documents, terms): documents with each term of the block; place -1 holds all documents with a term, and all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        vocabulary = shared.value.vocabulary
        held, documents, total = np.zeros(len(vocabulary), dtype=np.int64), 0, 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for start, end in slices(offsets, RUN):
                lengths, _, place, _ = occurrences(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start], vocabulary)
                held += np.bincount(place, minlength=len(vocabulary))
                documents, total = documents + int((lengths > 0).sum()), total + int(lengths.sum())
        some = np.flatnonzero(held)
        columns = [np.append(some, -1), np.append(held[some], documents), np.append(np.zeros(len(some), dtype=np.int64), total)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["place", "documents", "terms"])

    counts = docs.mapInArrow(run, "place long, documents long, terms long")
    return counts.groupBy("place").agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms"))


def weighted(block: Items, counts: DataFrame) -> Items:
    """The block with its terms' weights; `counts` has one row for each term of the block."""
    rows = counts.toArrow()
    held = dict(zip(rows.column("place").to_pylist(), rows.column("documents").to_pylist(), strict=True))
    documents = held.get(-1, 0)
    total = dict(zip(rows.column("place").to_pylist(), rows.column("terms").to_pylist(), strict=True)).get(-1, 0)
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(k, 0) + 1))) for k in range(len(block.vocabulary))]
    return Items(block.ids, block.places, block.vocabulary, np.array(weights, dtype=np.int64), documents, total)


def gain(times: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What occurrences of a term are worth in a text whose relative length is given; grows with the former only."""
    return 1_000_000_000 * times // (1000 * times + 20 * length)


class Best:
    """An item's k best documents so far; equal scores by ascending id."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    @property
    def floor(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        order = order[scores[order] > 0]
        self.scores, self.ids = scores[order], ids[order]


class Run:
    """Documents as columns: occurrences of each term and its bitmap."""

    def __init__(self, ids: np.ndarray, relative: np.ndarray, text: np.ndarray, place: np.ndarray, times: np.ndarray, size: int) -> None:
        self.ids, self.relative = ids, relative
        self.times = np.zeros((size, len(ids)), dtype=np.int32)
        self.times[place, text] = times
        self.most = self.times.max(axis=1, initial=0).astype(np.int64)
        self.bitmaps = np.packbits(self.times > 0, axis=1)

    def masks(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct masks over an item's terms as rows of bits, the documents with any of them ordered by mask, and the
        bounds of the groups."""
        bitmaps = self.bitmaps[places]
        some = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bitmaps, axis=0), count=len(self.ids)))
        bits = np.unpackbits(bitmaps, axis=1, count=len(self.ids))[:, some].T
        packed = np.packbits(bits, axis=1)
        words = np.zeros((len(some), -(-packed.shape[1] // 8) * 8), dtype=np.uint8)
        words[:, : packed.shape[1]] = packed
        words = words.view(np.uint64)
        order = np.lexsort(words.T)
        ordered = words[order]
        starts = np.flatnonzero(np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)])) if len(some) else np.zeros(0, dtype=np.int64)
        return bits[order[starts]], some[order], np.append(starts, len(some))

    def rank(self, places: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Groups by descending highest score, until none can enter."""
        places, weights = places[self.most[places] > 0], weights[self.most[places] > 0]
        if not len(places):
            return
        masks, documents, bounds = self.masks(places)
        shortest = np.minimum.reduceat(self.relative[documents], bounds[:-1])
        highest = np.zeros(len(masks), dtype=np.int64)
        for k, w in enumerate(weights.tolist()):
            highest += masks[:, k] * (w * gain(self.most[places[k]], shortest))
        order = np.argsort(-highest, kind="stable")
        sizes = np.diff(bounds)[order]
        reach = np.cumsum(sizes)
        at, want = 0, 2 * best.k
        while at < len(order) and highest[order[at]] >= best.floor:
            last = int(np.searchsorted(-highest[order], -best.floor, side="right"))
            end = min(last, max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + want, side="right"))))
            chosen = np.concatenate([documents[bounds[g] : bounds[g + 1]] for g in order[at:end]])
            best.offer((weights[:, None] * gain(self.times[np.ix_(places, chosen)].astype(np.int64), self.relative[chosen])).sum(axis=0), self.ids[chosen])
            at, want = end, 2 * want


def relative_lengths(lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """50 plus 50 times the length over the mean length, rounded down, in integers without bound."""
    distinct, place = np.unique(lengths, return_inverse=True)
    return np.array([50 + 50 * n * documents // max(total, 1) for n in distinct.tolist()], dtype=np.int64)[place]


def scan(docs: DataFrame, shared, k: int) -> DataFrame:
    """(place, item_id, doc_id, score): each task's k best documents of each item of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        block: Items = shared.value
        best = [Best(k) for _ in block.ids]
        rows = max(1, CELLS // len(block.vocabulary))
        for batch in batches:
            keys = batch.column(0).fill_null(NO_ID).to_numpy()
            data, offsets = text_bytes(batch.column(1))
            for start, end in slices(offsets, RUN):
                for a in range(start, end, rows):
                    b = min(a + rows, end)
                    lengths, text, place, times = occurrences(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], block.vocabulary)
                    part = Run(keys[a:b], relative_lengths(lengths, block.documents, block.occurrences), text, place, times, len(block.vocabulary))
                    for places, found in zip(block.places, best, strict=True):
                        part.rank(places, block.weights[places], found)
        sizes = [len(f.ids) for f in best]
        ids = np.concatenate([f.ids for f in best])
        names = pa.array(block.ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(best)), sizes)))
        columns = [pa.array(np.repeat(np.arange(len(best), dtype=np.int32), sizes)), names, pa.array(ids, mask=ids == NO_ID), pa.array(np.concatenate([f.scores for f in best]))]
        yield pa.RecordBatch.from_arrays(columns, names=["place", "item_id", "doc_id", "score"])

    return docs.mapInArrow(run, "place int, item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, most: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0."""
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    items = items.select(items["item_id"].cast("long").alias("item_id"), items["text"])
    path = scratch_path(spark, "ranked")
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    schema = "item_id long, rank int, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for block in item_blocks(items, most):
        asked = spark.sparkContext.broadcast(block)
        shared = spark.sparkContext.broadcast(weighted(block, count_documents(docs, asked)))
        found = scan(docs, shared, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score").write.mode("append").parquet(path)
        asked.unpersist()
        shared.unpersist()
    return spark.read.schema(schema).parquet(path)


def oracle(k: int = 50) -> str:
    found = lambda text: rf"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {found("text")} AS t FROM documents),
facts AS (SELECT count(*) FILTER (len(t) > 0) AS docs, CAST(sum(len(t)) AS HUGEINT) AS total FROM d),
asked AS (SELECT DISTINCT item_id, unnest({found("text")}) AS term FROM benchmark),
held AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY 1), facts),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + CAST((50 * CAST(n AS HUGEINT) * docs) // total AS BIGINT))))) AS BIGINT) AS score
 FROM asked JOIN held USING (term) JOIN weights USING (term), facts GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= {k}"""
