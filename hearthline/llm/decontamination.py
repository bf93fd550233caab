"""Benchmark passages in documents, found within an edit budget.

Texts and items are compared as lower-cased words between single blanks. An item of m characters may differ by up to
`budget` of m edits. It is cut into one piece more than it may have edits, so at least one piece of any match stands
unchanged in the text (pigeonhole). All pieces of a block of items are found in one walk over the text with an
Aho-Corasick machine; hits of an item that point at the same place are taken together, and the stretch around them is
verified with Myers' bit-parallel distance, one machine word operation for each column and 64 rows, with free ends.

An item shorter than `least` characters stands at word boundaries: neither end of its match is inside a word. Letters of
scripts without blanks between words (Chinese, Japanese, Thai and others) have a boundary on either side. Under 20
characters the default budget leaves no edit, so these are found exactly.

Items go to all tasks in blocks of bounded size, and each block scans the documents once; documents are never shuffled.
All hits are verified: there is no limit on hits, and none on documents for an item.

Defined results: null and empty texts, and items without a word, match nothing; repeated items and documents are reported
each; two items with one id are one id in the result. Items without an id are searched when documents are cleaned; the
table of matches, which names items by id, leaves them out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hearthline.llm.common import columns_only, release, scratch_path, text_bytes

BUDGET = 0.05
#: Shorter items match at word boundaries only.
LEAST = 24
#: Characters of items in a block.
BLOCK = 4_000_000

#: Letters of scripts that are written without blanks between words.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u2e80-\u2fdf\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]")
_MARKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def normal(raw: bytes) -> str:
    """Lower-cased words between single blanks; ASCII marks count as blanks."""
    return b" ".join(raw.decode().lower().encode().translate(_MARKS).split()).decode()


def edits_allowed(length: int, budget: float = BUDGET) -> int:
    return int(length * budget)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of edits + 1 pieces of near equal length that cover the item."""
    cuts = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def boundary(text: str, at: int) -> bool:
    """Whether no word goes on across this place of a normal text."""
    if at <= 0 or at >= len(text) or text[at - 1] == " " or text[at] == " ":
        return True
    before, after = text[at - 1], text[at]
    if unicodedata.category(after)[0] == "M":
        return False  # belongs to the letter before it
    letters = (before.isalnum() or unicodedata.category(before)[0] == "M") and after.isalnum()
    return not letters or bool(_UNSPACED.match(before) or _UNSPACED.match(after))


def distance(a: str, b: str) -> int:
    """Edits between two short texts as a whole."""
    row = list(range(len(a) + 1))
    for letter in b:
        new = [row[0] + 1]
        for i, x in enumerate(a):
            new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (x != letter)))
        row = new
    return row[-1]


class Myers:
    """Distance of a pattern to its best stretch of a text; bit i of each word is row i of the table."""

    def __init__(self, pattern: str) -> None:
        self.size = len(pattern)
        self.rows: dict[str, int] = {}
        for i, letter in enumerate(pattern):
            self.rows[letter] = self.rows.get(letter, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end) of the stretch with the fewest edits, the earliest end among equals."""
        mask, top = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, distance = mask, 0, self.size
        best, end = distance, 0
        for at, letter in enumerate(text, 1):
            rows = self.rows.get(letter, 0)
            diagonal = (((rows & up) + up) ^ up) | rows | down
            right, left = down | ~(diagonal | up) & mask, up & diagonal
            if right & top:
                distance += 1
            elif left & top:
                distance -= 1
            right, left = right << 1 & mask, left << 1 & mask
            up, down = left | ~(diagonal | right) & mask, right & diagonal
            if distance < best:
                best, end = distance, at
        return best, end


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], budget: float, least: int = LEAST) -> None:
        self.least = least
        self.items = [(key, text, edits_allowed(len(text), budget)) for key, text in items]
        self.myers = [Myers(text) for _, text, _ in self.items]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, edits) in enumerate(self.items):
            for offset, piece in pieces(text, edits):
                found.setdefault(piece, []).append((n, offset))
        self.machine = ahocorasick.Automaton()
        for piece, places in found.items():
            self.machine.add_word(piece, (len(piece), places))
        self.machine.make_automaton()

    def matches(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item id, edits, item's length, end in the normal text) of the best match of each item in the text."""
        starts: dict[int, list[int]] = {}
        exact: dict[int, int] = {}
        for last, (size, places) in self.machine.iter(text) if self.items else ():
            for n, offset in places:
                _, item, edits = self.items[n]
                if edits or len(item) >= self.least:
                    starts.setdefault(n, []).append(last + 1 - size - offset)
                elif n not in exact and boundary(text, last + 1) and boundary(text, last + 1 - size):
                    exact[n] = last + 1
        out = [(self.items[n][0], 0, len(self.items[n][1]), end) for n, end in exact.items()]
        for n, found in starts.items():
            key, item, edits = self.items[n]
            if len(item) < self.least:
                best, end = self._at_words(n, found, text)
                if best <= edits:
                    out.append((key, best, len(item), end))
                continue
            best, end, done = edits + 1, 0, -1
            for start in sorted(found):
                low, high = max(0, start - edits, done - len(item) - edits), min(len(text), start + len(item) + edits)
                if high <= done:
                    continue  # inside the stretch that has been verified
                distance, at = self.myers[n].best(text[low:high])
                done = high
                if distance < best:
                    best, end = distance, low + at
                    if not best:
                        break
            if best <= edits:
                out.append((key, best, len(item), end))
        return out

    def _at_words(self, n: int, found: list[int], text: str) -> tuple[int, int]:
        """(edits, end) of the best stretch between word boundaries near the starts found; more edits than allowed if none."""
        _, item, edits = self.items[n]
        best = (edits + 1, 0)
        for start in sorted(set(found)):
            low, high = max(0, start - edits), min(len(text), start + len(item) + edits)
            if self.myers[n].best(text[low:high])[0] > edits:
                continue
            for first in range(low, start + edits + 1):
                if boundary(text, first):
                    ends = range(first + len(item) - edits, min(len(text), first + len(item) + edits) + 1)
                    best = min([best, *[(distance(item, text[first:end]), end) for end in ends if boundary(text, end)]])
        return best


def item_blocks(benchmark: DataFrame, most: int = BLOCK) -> Iterator[list[tuple[int | None, str]]]:
    """Normal items in blocks of at most about `most` characters, read through the driver one partition at a time."""
    block, size = [], 0
    for row in columns_only(benchmark, "item_id", "text").where("text is not null").toLocalIterator():
        if text := normal(row["text"].encode()):
            block.append((row["item_id"], text))
            size += len(text)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, least: int = LEAST, most: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, edits, n_chars, at) for each document and item that stands in it: the fewest edits, the item's
    length and the end of the match in the normal text."""
    docs = columns_only(docs, "doc_id", "text")
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, item_id long, edits int, n_chars int, at long"
    out = docs.sparkSession.createDataFrame([], schema)
    for number, block in enumerate(item_blocks(benchmark.where("item_id is not null"), most)):
        found = _scan(docs, docs.sparkSession.sparkContext.broadcast(block), budget, least, schema)
        out = out.unionByName(found) if number else found
    return out


def _scan(docs: DataFrame, shared, budget: float, least: int, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        matcher = Matcher(shared.value, budget, least)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            rows = [(i, *m) for i in range(len(batch)) for m in matcher.matches(normal(data[offsets[i] : offsets[i + 1]].tobytes()))]
            places = pa.array([r[0] for r in rows], pa.int64())
            columns = [batch.column(0).take(places), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32()), pa.array([r[4] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "edits", "n_chars", "at"])

    return docs.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, least: int = LEAST, most: int = BLOCK) -> DataFrame:
    """The rows of `docs` that hold no item. Each row is judged where it stands, so rows need no key and are not joined.
    Between blocks of items the rows left are written, so that a task has one block's matcher; of these tables only the
    last one stays."""
    spark = docs.sparkSession
    shared = written = None
    for block in item_blocks(benchmark, most):
        if shared is not None:
            path = scratch_path(spark, "clean")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
            shared.destroy()
            _drop(spark, written)
            written = path
        shared = spark.sparkContext.broadcast(block)
        docs = _without(docs, shared, budget, least)
    return docs


def _drop(spark: SparkSession, folder: str | None) -> None:
    if folder is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _without(docs: DataFrame, shared, budget: float, least: int) -> DataFrame:
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        matcher = Matcher(shared.value, budget, least)
        for batch in batches:
            data, offsets = text_bytes(batch.column(place))
            yield batch.filter(pa.array([not matcher.matches(normal(data[offsets[i] : offsets[i + 1]].tobytes())) for i in range(len(batch))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
