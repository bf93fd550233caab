"""Links between the tokens of two tokenizers, and how many documents hold each pair of linked ids.

Both encodings of a text spell the same bytes, so token ends are byte offsets. Offsets where tokens of both end cut the
text into groups; within a group every token of A is linked with every token of B.

Pairs are counted on inverted bitmaps. Documents are numbered within blocks of at most 65,536; for each pair of ids a
block has one compressed bitmap for each bit of the number of links a document holds (a multiplicity plane): sorted
16-bit numbers, or 8,192 bytes once these would be longer. The documents of a pair are the planes' bits OR-ed together;
their popcount is the pair's document count in the block, and the planes' popcounts, weighted by powers of two, its link
count. Blocks hold different documents, so counts add up over blocks. The counts go back along the postings: a block gets
the count of each of its pairs once and adds it to all documents of the bitmaps. A pair that stands in a third of all
documents is one row for each block, and no row is made for a single link.

A text is encoded whole; links are expanded in runs of bounded size. What a worker holds is one block, which is closed at
a number of postings. Defined results: null and empty texts, and texts whose tokens of A or B spell other bytes than a
blank and the text, have no tokens, zeros and an empty groups_sha256; repeated rows count each as a document; equal counts
of one id of A are all its best; an empty table gives an empty table; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.byte_bpe import read_ranks
from hearthline.llm.common import columns_only, materialise, resident, slices, text_bytes

#: Documents of a block, postings at which it is closed, bytes of texts encoded at a time, links expanded at a time.
DOCUMENTS, POSTINGS, RUN, LINKS = 1 << 16, 2_000_000, 2 << 20, 1 << 20
#: Bytes of a bitmap of a whole block; a shorter one is a list of 16-bit numbers.
DENSE = DOCUMENTS // 8


@dataclass
class Side:
    """One tokenizer: the bytes of each id, their lengths, and its id in decimal before "," or the mark that ends its part."""

    spelled: list[bytes]
    lengths: np.ndarray
    written: np.ndarray

    @classmethod
    def of(cls, spelled: list[bytes], last: str) -> Side:
        written = np.array([f"{i}{mark}" for i in range(len(spelled)) for mark in (",", last)], dtype=object)
        return cls(spelled, np.array([len(s) for s in spelled], dtype=np.int64), written)


class Tokenizers:
    """Tokenizer A from a file of ranks, B from a sentencepiece model."""

    def __init__(self, ranks_file: str, pattern: str, piece_file: str) -> None:
        ranks = read_ranks(ranks_file)
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        spelled = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            spelled[rank] = token
        self.of_a, self.of_b = Side.of(spelled, "|"), Side.of([self.piece(i) for i in range(self.b.get_piece_size())], ";")

    def piece(self, i: int) -> bytes:
        text = self.b.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if self.b.is_byte(i) else text.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A for a blank and the text, and of B for the text; both empty unless they spell the same."""
        every_a = [self.a.encode_ordinary(" " + t) if t else [] for t in texts]
        every_b = self.b.encode(texts, num_threads=1) if texts else []
        for k, t in enumerate(texts):
            raw = b" " + t.encode() if t else b""
            if b"".join(map(self.of_a.spelled.__getitem__, every_a[k])) != raw or b"".join(map(self.of_b.spelled.__getitem__, every_b[k])) != raw:
                every_a[k], every_b[k] = [], []
        return every_a, every_b


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    return np.fromiter((i for x in lists for i in x), dtype=np.int64, count=int(sizes.sum())), sizes


class Groups:
    """The groups of many texts at once, as runs of tokens of both sides between common ends."""

    def __init__(self, a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray, of_a: Side, of_b: Side) -> None:
        self.a, self.b = a, b
        ends_a, ends_b = np.cumsum(of_a.lengths[a]), np.cumsum(of_b.lengths[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=len(common)), np.bincount(self.group_b, minlength=len(common))
        self.to_a, self.to_b = np.cumsum(self.in_a), np.cumsum(self.in_b)
        text_of_a = np.repeat(np.arange(len(sizes_a)), sizes_a)
        self.text = text_of_a[self.to_a - 1] if len(common) else np.zeros(0, dtype=np.int64)
        self.text_of_a, self.texts = text_of_a, len(sizes_a)

    def per_text(self) -> tuple[np.ndarray, np.ndarray]:
        """Groups and links of each text."""
        links = np.zeros(self.texts, dtype=np.int64)
        np.add.at(links, self.text, self.in_a * self.in_b)
        return np.bincount(self.text, minlength=self.texts), links

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, id of A, id of B) of all links, in runs of bounded size."""
        partners = self.in_b[self.group_a]
        first = (self.to_b - self.in_b)[self.group_a]
        for start, end in slices(np.concatenate([[0], np.cumsum(partners)]), LINKS):
            k = partners[start:end]
            left = np.repeat(np.arange(start, end), k)
            right = first[left] + np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k)
            yield self.text_of_a[left], self.a[left], self.b[right]

    def digests(self, sizes_a: np.ndarray, sizes_b: np.ndarray, of_a: Side, of_b: Side) -> list[str]:
        """sha256 of each text's groups, written as "a1,a2|b1;a3|b2,b3"; empty without tokens."""
        marks = np.empty(len(self.a) + len(self.b), dtype=object)
        i, j = np.arange(len(self.a)), np.arange(len(self.b))
        before_b, after_a = (self.to_b - self.in_b)[self.group_a], self.to_a[self.group_b]
        marks[i + before_b] = of_a.written[2 * self.a + (i + 1 == self.to_a[self.group_a])]
        marks[j + after_a] = of_b.written[2 * self.b + (j + 1 == self.to_b[self.group_b])]
        out, at = [], 0
        for size in (sizes_a + sizes_b).tolist():
            out.append(hashlib.sha256("".join(marks[at : at + size].tolist())[:-1].encode()).hexdigest() if size else "")
            at += size
        return out


class Block:
    """Postings of the documents numbered so far: keys of (pair, document) and how often each is linked."""

    def __init__(self, number: int, second: int) -> None:
        self.number, self.second = number, second
        self.documents = self.size = 0
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, first: int, groups: Groups) -> None:
        for text, a, b in groups.links():
            keys, counts = np.unique((a * self.second + b) * DOCUMENTS + (first + text), return_counts=True)
            self.keys.append(keys)
            self.counts.append(counts)
            self.size += len(keys)

    def rows(self) -> pa.RecordBatch | None:
        """One row for each pair: a, b, documents, links and the planes."""
        if not self.size:
            return None
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        keys, place = np.unique(keys, return_inverse=True)
        times = np.zeros(len(keys), dtype=np.int64)
        np.add.at(times, place, counts)
        pair, document = keys // DOCUMENTS, keys % DOCUMENTS
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        row = np.cumsum(np.concatenate([[0], pair[1:] != pair[:-1]]))
        top = int(times.max()).bit_length()
        held = [np.flatnonzero(times >> k & 1) for k in range(top)]
        plane, at = np.repeat(np.arange(top), [len(h) for h in held]), np.concatenate(held)
        order = np.lexsort((at, plane, row[at]))  # by row, plane and document
        plane, at = plane[order], at[order]
        cell = row[at] * top + plane
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        sizes = np.diff(np.append(first, len(cell)))
        planes = bitmaps(document[at].astype("<u2"), first, sizes)
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(cell[first] // top, np.arange(len(starts) + 1)), pa.int32()), planes)
        numbers = pa.ListArray.from_arrays(lists.offsets, pa.array((cell[first] % top).astype(np.int8)))
        columns = [pa.array(pair[starts] // self.second, pa.int32()), pa.array(pair[starts] % self.second, pa.int32()), pa.array(np.diff(np.append(starts, len(keys)))), pa.array(np.add.reduceat(times, starts)), numbers, lists]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), self.number)), *columns], names=["block", "a", "b", "documents", "links", "numbers", "planes"])


def bitmaps(documents: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A compressed bitmap for each run of sorted 16-bit numbers."""
    large = np.flatnonzero(2 * sizes >= DENSE)
    parts, at = [], 0
    for k in large.tolist():
        bits = np.zeros(DOCUMENTS, dtype=np.uint8)
        bits[documents[first[k] : first[k] + sizes[k]]] = 1
        parts += [documents[at : first[k]].tobytes(), np.packbits(bits, bitorder="little").tobytes()]
        at = first[k] + sizes[k]
    parts.append(documents[at:].tobytes())
    lengths = np.where(2 * sizes >= DENSE, DENSE, 2 * sizes)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(parts))])


def members(bitmap: bytes) -> np.ndarray:
    """The documents of a compressed bitmap."""
    if len(bitmap) == DENSE:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, dtype=np.uint8), bitorder="little"))
    return np.frombuffer(bitmap, dtype="<u2").astype(np.int64)


DIGEST = ("n_a", "n_b", "n_groups", "n_links")


def encoded(docs: DataFrame, ranks_file: str, pattern: str, piece_file: str) -> DataFrame:
    """Two kinds of rows from one pass over the texts: one for each document (slot is not null), with its place (block, slot)
    and its own counts, and one for each pair of a block (slot is null), with its postings."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = "slot int, " + ", ".join(f"{c} bigint" for c in DIGEST) + ", groups_sha256 string"
    schema = f"block bigint, doc_id {kind}, {own}, a int, b int, documents bigint, links bigint, numbers array<tinyint>, planes array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = resident(("alignment", ranks_file, pattern, piece_file), lambda: Tokenizers(ranks_file, pattern, piece_file))
        fields = None
        begin = TaskContext.get().partitionId() << 32
        block = Block(begin, len(coder.of_b.spelled))

        def shaped(known: dict[str, pa.Array], size: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([known[f.name].cast(f.type) if f.name in known else pa.nulls(size, f.type) for f in fields], schema=fields)

        for batch in batches:
            if fields is None:
                fields = pa.schema([("block", pa.int64()), ("doc_id", batch.column(0).type), ("slot", pa.int32()), *[(c, pa.int64()) for c in DIGEST], ("groups_sha256", pa.string()), ("a", pa.int32()), ("b", pa.int32()),
                                    ("documents", pa.int64()), ("links", pa.int64()), ("numbers", pa.list_(pa.int8())), ("planes", pa.list_(pa.binary()))])
            data, offsets = text_bytes(batch.column(1))
            for start, stop in slices(offsets, RUN):
                if block.documents + stop - start > DOCUMENTS or block.size > POSTINGS:
                    if (rows := block.rows()) is not None:
                        yield shaped(dict(zip(rows.schema.names, rows.columns, strict=True)), len(rows))
                    block = Block(block.number + 1, block.second)
                texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(start, stop)]
                (a, sizes_a), (b, sizes_b) = map(flat, coder.encode(texts))
                groups = Groups(a, sizes_a, b, sizes_b, coder.of_a, coder.of_b)
                block.add(block.documents, groups)
                n_groups, n_links = groups.per_text()
                known = {
                    "block": pa.array(np.full(len(texts), block.number)), "doc_id": batch.column(0).slice(start, stop - start), "slot": pa.array(np.arange(block.documents, block.documents + len(texts))),
                    "n_a": pa.array(sizes_a), "n_b": pa.array(sizes_b), "n_groups": pa.array(n_groups), "n_links": pa.array(n_links),
                    "groups_sha256": pa.array(groups.digests(sizes_a, sizes_b, coder.of_a, coder.of_b), pa.string()),
                }
                block.documents += len(texts)
                yield shaped(known, len(texts))
        if fields is not None and (rows := block.rows()) is not None:
            yield shaped(dict(zip(rows.schema.names, rows.columns, strict=True)), len(rows))

    return columns_only(docs, "doc_id", "text").mapInArrow(run, schema)


def pair_counts(postings: DataFrame) -> DataFrame:
    """(a, b, count, links, best): documents and links of each pair of ids over all blocks, and whether no other pair of `a`
    stands in more documents."""
    counts = postings.groupBy("a", "b").agg(F.sum("documents").alias("count"), F.sum("links").alias("links"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("a", "b", "count", "links", (F.col("count") == F.col("most")).alias("best"))


def returned(group: pa.Table) -> pa.Table:
    """(block, slot, n_best, count_sum) of a block from its postings with their pairs' counts."""
    n_best, count_sum = np.zeros((2, DOCUMENTS), dtype=np.int64)
    group = group.combine_chunks()
    numbers, planes = (group.column(c).combine_chunks() for c in ("numbers", "planes"))
    each = numbers.value_lengths().to_numpy()
    count, best = np.repeat(group.column("count").to_numpy(), each), np.repeat(group.column("best").to_numpy().astype(np.int64), each)
    power = np.int64(1) << numbers.flatten().to_numpy().astype(np.int64)
    found = [members(m) for m in planes.flatten().to_pylist()]
    sizes = [len(m) for m in found]
    at = np.concatenate(found)
    np.add.at(count_sum, at, np.repeat(count * power, sizes))
    np.add.at(n_best, at, np.repeat(best * power, sizes))
    slots = np.unique(at)
    block = group.column("block")[0].as_py()
    return pa.table({"block": pa.array(np.full(len(slots), block)), "slot": pa.array(slots, pa.int32()), "n_best": pa.array(n_best[slots]), "count_sum": pa.array(count_sum[slots])})


def align_tokens(docs: DataFrame, ranks_file: str, pattern: str, piece_file: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row."""
    both = materialise(encoded(docs, ranks_file, pattern, piece_file))
    postings = both.where("slot is null").select("block", "a", "b", "documents", "links", "numbers", "planes")
    scores = pair_counts(postings).select("a", "b", "count", "best")
    carried = postings.select("block", "a", "b", "numbers", "planes").join(scores, ["a", "b"]).select("block", "numbers", "planes", "count", "best")
    sums = carried.groupBy("block").applyInArrow(returned, "block bigint, slot int, n_best bigint, count_sum bigint")
    own = both.where("slot is not null").select("block", "slot", "doc_id", *DIGEST, "groups_sha256")
    out = own.join(sums, ["block", "slot"], "left")
    filled = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_best", "count_sum")]
    return out.select("doc_id", *DIGEST, *filled, "groups_sha256")
