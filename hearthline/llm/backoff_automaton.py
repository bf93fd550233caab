"""Word-bigram scores with a weighted backoff automaton, learned from the whole corpus.

A word is a state with an arc for each word that has followed it in the training texts; its failure arc goes to the root
state, which has an arc for every training word and one for unknown words. Weights are log10 of interpolated absolute
discounting: P(w|h) = max(c(hw) - D, 0) / c(h) + D * N(h) / c(h) * P(w), and P(w) = (c(w) - D) / N for training words, with
the discounted mass D * V / N for unknown ones, so that all probabilities of a state sum to one. A text is read once
from left to right: the state is the last word, an arc is taken or the failure weight is paid, and the text's end is a
word of its own.

Counts cover all training texts and grow with them, so no task holds the model. Texts are packed into blocks of bounded
size. A block asks for the distinct words and bigrams it holds, in sorted runs of numbers: one shuffle brings the
requests to buckets, where training counts of all blocks are summed, and one brings the answers back, so a block gets
exactly the part of the automaton that its texts can visit. A word that is very frequent is one entry in each block, and the
bigrams of very frequent contexts are dealt over all buckets. Words are 64-bit hashes; within a bucket contexts are told
apart by 64 bits and their followers by 40.

Defined results: null and empty texts are the end alone; repeated rows count and are scored each; a null doc_id is a
training row; without training rows both scores are 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import columns_only, hash_words, materialise, mix, slices, text_bytes

DISCOUNT = 0.75
#: Bytes of text in a block; bytes of requests in a bucket.
BLOCK, BUCKET = 16 << 20, 12 << 20
_U = np.uint64
#: The state before a text and the word that ends it.
START, END = mix(np.array([11, 13], dtype=np.uint64))


def squeezed(values: np.ndarray, width: int) -> bytes:
    """Whole numbers of `width` bytes as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8)[:, :width].T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def widened(data: bytes, width: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True), dtype=np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def every_seventh_held(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def pack_blocks(docs: DataFrame, held_out: Callable[[int | None], bool]) -> DataFrame:
    """One row for each block of texts: ids, held-out marks, distinct word hashes in order, training counts of the words,
    and each token as its word's place, with START not stored and END after each text."""

    def packed(key: int, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        held = np.array([held_out(i) for i in ids.to_pylist()], dtype=bool)
        words, bounds = hash_words(data, offsets)
        n = np.diff(bounds) + 1
        ends = np.cumsum(n)
        stream = np.empty(int(ends[-1]), dtype=np.uint64)
        inner = np.ones(len(stream), dtype=bool)
        inner[ends - 1] = False
        stream[inner], stream[~inner] = words, END
        distinct, place = np.unique(stream, return_inverse=True)
        train = np.bincount(place[np.repeat(~held, n)], minlength=len(distinct))
        row = {
            "block": [key], "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "held": pa.array([held.tolist()], pa.list_(pa.bool_())), "texts": pa.array([int((~held).sum())], pa.int64()),
            "n_words": [len(distinct)], "n_tokens": [len(stream)], "trained": pa.array([int(train.sum())], pa.int64()), "words": [squeezed(distinct, 8)], "counts": [squeezed(train, 4)],
            "tokens": [squeezed(place, 4)], "lengths": [squeezed(n, 8)],
        }
        return pa.RecordBatch.from_pydict(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, waiting, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for first, end in slices(offsets, BLOCK):
                waiting.append(batch.slice(first, end - first))
                size += int(offsets[end] - offsets[first])
                if size >= BLOCK // 2:
                    whole = pa.Table.from_batches(waiting).combine_chunks()
                    yield packed(made, whole.column(0).combine_chunks(), *text_bytes(whole.column(1).combine_chunks()))
                    made, waiting, size = made + 1, [], 0
        if waiting:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            if len(whole):
                yield packed(made, whole.column(0).combine_chunks(), *text_bytes(whole.column(1).combine_chunks()))

    schema = "block long, ids array<long>, held array<boolean>, texts long, n_words long, n_tokens long, trained long, words binary, counts binary, tokens binary, lengths binary"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def ask_words(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, n, words, counts): the sorted words of a block cut by bucket, with training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = widened(row["words"], 8, row["n_words"]), widened(row["counts"], 4, row["n_words"])
                cuts = np.searchsorted(words, _bucket_starts(buckets))
                cuts = np.append(cuts, len(words))
                parts = [(b, a, z) for b, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([p[0] for p in parts], pa.int64()), "block": pa.array([row["block"]] * len(parts), pa.int64()), "n": pa.array([int(z - a) for _, a, z in parts], pa.int64()), "words": pa.array([squeezed(words[a:z], 8) for _, a, z in parts], pa.binary()), "counts": pa.array([squeezed(counts[a:z], 4) for _, a, z in parts], pa.binary())})

    return blocks.select("block", "n_words", "words", "counts").mapInArrow(run, "bucket long, block long, n long, words binary, counts binary")


def _bucket_starts(buckets: int) -> np.ndarray:
    return np.array([(k << 64) // buckets for k in range(buckets)], dtype=np.uint64)


def answer_words(asked: DataFrame, hot_from: int) -> DataFrame:
    """(block, kind, bucket, n, first): training counts of the words of each request; rows of block -1 hold the number of
    training words of the bucket in `n`, and its hot words (at least `hot_from` tokens) in `first`."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        words = np.concatenate([widened(w, 8, n) for w, n in zip(frame["words"], frame["n"], strict=True)])
        counts = np.concatenate([widened(c, 4, n) for c, n in zip(frame["counts"], frame["n"], strict=True)])
        distinct, place = np.unique(words, return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.uint64)
        mine, cuts = total[place], np.cumsum(frame["n"].to_numpy())[:-1]
        hot = distinct[total >= hot_from]
        out = [(b, "w", k, n, squeezed(x, 5)) for b, k, n, x in zip(frame["block"], frame["bucket"], frame["n"], np.split(mine, cuts), strict=True)]
        out.append((-1, "w", frame["bucket"].iloc[0], int((total > 0).sum()), hot.tobytes()))
        return pd.DataFrame(out, columns=["block", "kind", "bucket", "n", "first"])

    return asked.groupBy("bucket").applyInPandas(run, "block long, kind string, bucket long, n long, first binary")


@dataclass
class Bigrams:
    """The distinct bigrams of a block in the order of their requests."""

    context: np.ndarray
    word: np.ndarray
    train: np.ndarray
    cuts: np.ndarray
    place: np.ndarray


def block_words(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of the block with START as one more at the end, contexts and words of all tokens as places)."""
    words = widened(row["words"], 8, row["n_words"])
    tokens = widened(row["tokens"], 4, row["n_tokens"]).astype(np.int64)
    lengths = widened(row["lengths"], 8, len(row["ids"])).astype(np.int64)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = len(words)
    return np.append(words, START), before, tokens


def block_bigrams(row: dict, hot: np.ndarray, buckets: int) -> Bigrams:
    """Counts each bigram of the block, and orders them by bucket, then context and word. A context's bucket follows from
    its hash; the bigrams of a hot one are dealt by both hashes."""
    words, before, tokens = block_words(row)
    keys, place = np.unique(before.astype(np.uint64) << _U(32) | tokens.astype(np.uint64), return_inverse=True)
    lengths = widened(row["lengths"], 8, len(row["ids"])).astype(np.int64)
    train = np.bincount(place[np.repeat(~np.asarray(row["held"], dtype=bool), lengths)], minlength=len(keys))
    context, word = words[(keys >> _U(32)).astype(np.int64)], words[(keys & _U(0xFFFFFFFF)).astype(np.int64)]
    spread = np.where(np.isin(context, hot), mix(context ^ mix(word)), mix(context))
    bucket = (spread % _U(buckets)).astype(np.int64)
    order = np.lexsort((context, bucket))
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return Bigrams(context[order], word[order], train[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), back[place])


def _runs(context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of neighbouring bigrams and how many each has."""
    starts = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, dtype=np.int64)
    return context[starts], np.diff(np.append(starts, len(context)))


def ask_bigrams(blocks: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, block, n, heads, contexts, sizes, followers, counts) of each block and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                b = block_bigrams(row, hot, buckets)
                out = []
                for k, (a, z) in enumerate(zip(b.cuts[:-1], b.cuts[1:], strict=True)):
                    if z > a:
                        heads, sizes = _runs(b.context[a:z])
                        out.append((k, row["block"], int(z - a), len(heads), heads.tobytes(), squeezed(sizes, 4), squeezed(b.word[a:z], 5), squeezed(b.train[a:z], 4)))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 4 + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["bucket", "block", "n", "heads", "contexts", "sizes", "followers", "counts"])

    needed = blocks.select("block", "ids", "held", "n_words", "n_tokens", "words", "tokens", "lengths")
    return needed.mapInArrow(run, "bucket long, block long, n long, heads long, contexts binary, sizes binary, followers binary, counts binary")


def answer_bigrams(asked: DataFrame, hot: np.ndarray) -> DataFrame:
    """(block, kind, bucket, n, first, second): training counts of the bigrams of each request, and for each of its contexts
    the number of different training followers in this bucket; rows of block -1 hold hot contexts and those numbers."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        heads = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in frame["contexts"]])
        sizes = np.concatenate([widened(x, 4, n) for x, n in zip(frame["sizes"], frame["heads"], strict=True)]).astype(np.int64)
        owner = np.repeat(heads, sizes)
        followers = np.concatenate([widened(x, 5, n) for x, n in zip(frame["followers"], frame["n"], strict=True)])
        counts = np.concatenate([widened(x, 4, n) for x, n in zip(frame["counts"], frame["n"], strict=True)])
        distinct, first, place = np.unique(mix(owner ^ mix(followers)), return_index=True, return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.uint64)
        seen, kinds = np.unique(owner[first[total > 0]], return_counts=True)
        at = np.minimum(np.searchsorted(seen, heads), max(len(seen) - 1, 0))
        types = np.where(seen[at] == heads, kinds[at], 0) if len(seen) else np.zeros(len(heads), dtype=np.int64)
        pairs = np.split(total[place], np.cumsum(frame["n"].to_numpy())[:-1])
        tops = np.split(types, np.cumsum(frame["heads"].to_numpy())[:-1])
        out = [(b, "b", k, n, squeezed(x, 5), squeezed(y, 5)) for b, k, n, x, y in zip(frame["block"], frame["bucket"], frame["n"], pairs, tops, strict=True)]
        mine = np.isin(seen, hot)
        out.append((-1, "b", frame["bucket"].iloc[0], int(mine.sum()), seen[mine].tobytes(), kinds[mine].astype(np.int64).tobytes()))
        return pd.DataFrame(out, columns=["block", "kind", "bucket", "n", "first", "second"])

    return asked.groupBy("bucket").applyInPandas(run, "block long, kind string, bucket long, n long, first binary, second binary")


@dataclass
class Automaton:
    """The part of the automaton that a block can visit. Arcs are its distinct bigrams; weights are log10."""

    arcs: np.ndarray
    has_arc: np.ndarray
    failure: np.ndarray
    root: np.ndarray

    def traverse(self, steps: np.ndarray, state: np.ndarray, word: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of many texts read from left to right. The state before each token is the token before it, so all steps of
        all texts are taken at once: the arc's weight, or the state's failure weight and the root's arc."""
        weights = np.where(self.has_arc[steps], self.arcs[steps], self.failure[state] + self.root[word])
        return np.add.reduceat(weights, np.append(0, ends[:-1]))


def compile_part(words: np.ndarray, counts: np.ndarray, b: Bigrams, pair_counts: np.ndarray, types: np.ndarray, hot: dict[int, int], total: int, kinds: int) -> Automaton:
    """counts: training count of each word of the block, with that of START at the end."""
    d = DISCOUNT
    with np.errstate(divide="ignore", invalid="ignore"):
        known = np.maximum(counts[:-1] - d, 0) / total if total else np.zeros(len(counts) - 1)
        base = np.where(counts[:-1] > 0, known, d * kinds / total if total else 1.0)
        for h, n in hot.items():
            types[words == _U(h)] = n
        back = np.where(counts > 0, d * types / counts, 1.0)
        context, word = np.searchsorted(words[:-1], b.context), np.searchsorted(words[:-1], b.word)
        context = np.where(b.context == START, len(words) - 1, context)
        p = np.maximum(pair_counts - d, 0) / counts[context] + back[context] * base[word]
        return Automaton(np.log10(p), pair_counts > 0, np.log10(back), np.log10(base))


def score_texts(docs: DataFrame, held_out: Callable[[int | None], bool] = every_seventh_held) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    spark = docs.sparkSession
    blocks = materialise(pack_blocks(columns_only(docs, "doc_id", "text"), held_out))
    sums = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("trained", "texts", "n_words", "n_tokens")]).first()
    total, texts = sums["trained"], sums["texts"]
    word_buckets = max(8, -(-sums["n_words"] * 10 // BUCKET))
    pair_buckets = max(16, -(-sums["n_tokens"] * 6 // BUCKET))
    asked = ask_words(blocks, word_buckets)
    words = materialise(answer_words(asked, max(2, total // (16 * pair_buckets))))  # so there are at most 16 * pair_buckets hot words
    tops = words.where("block = -1").select("n", "first").collect()
    kinds = sum(r["n"] for r in tops)
    hot = np.unique(np.concatenate([np.frombuffer(r["first"], dtype=np.uint64) for r in tops] + [np.array([START], dtype=np.uint64)]))
    pairs = materialise(answer_bigrams(ask_bigrams(blocks, hot, pair_buckets), hot))
    hot_types: dict[int, int] = {}
    for r in pairs.where("block = -1").select("first", "second").collect():
        for h, n in zip(np.frombuffer(r["first"], dtype=np.uint64).tolist(), np.frombuffer(r["second"], dtype=np.int64).tolist(), strict=True):
            hot_types[h] = hot_types.get(h, 0) + n
    shared = spark.sparkContext.broadcast((hot, hot_types))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0].to_dict()
        hot, hot_types = shared.value
        states, before, tokens = block_words(row)
        b = block_bigrams(row, hot, pair_buckets)
        counts, types = np.zeros(len(states)), np.zeros(len(states))
        counts[-1] = texts
        pair_counts = np.zeros(len(b.context))
        starts = np.append(np.searchsorted(states[:-1], _bucket_starts(word_buckets)), len(states) - 1)
        for kind, k, n, first, second in zip(right["kind"], right["bucket"], right["n"], right["first"], right["second"], strict=True):
            if kind == "w":
                counts[starts[k] : starts[k + 1]] = widened(first, 5, n)
            else:
                a, z = b.cuts[k], b.cuts[k + 1]
                pair_counts[a:z] = widened(first, 5, n)
                heads, _ = _runs(b.context[a:z])
                at = np.where(heads == START, len(states) - 1, np.searchsorted(states[:-1], heads))
                types[at] = widened(second, 5, len(heads))
        machine = compile_part(states, counts, b, pair_counts, types, hot_types, total, kinds)
        ends = np.cumsum(widened(row["lengths"], 8, len(row["ids"])).astype(np.int64))
        firsts = np.append(0, ends[:-1])
        base = np.log10((counts[:-1] + 1) / (total + kinds + 1))
        return pd.DataFrame({
            "doc_id": pd.array(row["ids"], dtype="Int64"), "held_out": np.asarray(row["held"], dtype=bool), "n_tokens": ends - firsts, "n_known": np.add.reduceat((counts[:-1] > 0)[tokens].astype(np.int64), firsts),
            "train_tokens": np.full(len(ends), total), "base_score": np.add.reduceat(base[tokens], firsts), "score": machine.traverse(b.place, before, tokens, ends),
        })

    answers = words.where("block >= 0").withColumn("second", F.lit(None).cast("binary")).unionByName(pairs.where("block >= 0"))
    needed = blocks.select("block", "ids", "held", "n_words", "n_tokens", "words", "tokens", "lengths")
    return needed.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

