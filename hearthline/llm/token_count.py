"""Token counts of whole texts, as the tokenizers library gives them for a byte-level BPE file.

Most pre-tokens are vocabulary entries. For each entry it is proved once, on the driver, by running the merges on its
bytes, whether it encodes alone as exactly one token; the set of these strings is sent to the tasks (its size is the
vocabulary's, 50 thousand strings). A pre-token in the set counts one without any merge; only the rest is merged, and
counts of recent ones are kept in a table of bounded size.

Strings of added tokens inside a text are one token each, which is the library's default, and cut the text before the
pre-tokens are found. Defined results: null and empty texts have 0 tokens; repeated rows are counted each; long texts
and long pre-tokens are counted whole, in n log n steps.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import columns_only, slices, text_bytes

#: Remembered pre-tokens and the longest one remembered, in bytes.
REMEMBERED, SHORT = 200_000, 64


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_merges(file: str) -> tuple[dict[tuple[bytes, bytes], int], list[bytes], list[str]]:
    """(rank of each merge, vocabulary strings, added tokens) of a tokenizers file with a byte-level BPE model."""
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
    return ranks, [raw(s) for s in spec["model"]["vocab"]], [t["content"] for t in spec["added_tokens"]]


def merged(piece: bytes, ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """The pieces left when merges are applied by rank, leftmost first; a heap keeps long pieces at n log n."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    before, after = [*range(-1, len(parts) - 1)], [*range(1, len(parts) + 1)]
    heap = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if not parts[i] or j >= len(parts) or ranks.get((parts[i], parts[j])) != r:
            continue
        parts[i], parts[j] = parts[i] + parts[j], b""
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and (r := ranks.get((parts[a], parts[b]))) is not None:
                heapq.heappush(heap, (r, a))
    return [p for p in parts if p]


def whole_tokens(vocabulary: list[bytes], ranks: dict[tuple[bytes, bytes], int]) -> frozenset[str]:
    """Vocabulary strings that are proved to encode alone as one token; only whole UTF-8 strings can be pre-tokens."""
    found = []
    for raw in vocabulary:
        if len(merged(raw, ranks)) == 1:
            try:
                found.append(raw.decode())
            except UnicodeDecodeError:
                continue
    return frozenset(found)


class Counts(dict):
    """Tokens of each pre-token: one for whole tokens, by merging for the rest."""

    def __init__(self, whole: frozenset[str], ranks: dict[tuple[bytes, bytes], int]) -> None:
        super().__init__(dict.fromkeys(whole, 1))
        self.ranks, self.most = ranks, len(whole) + REMEMBERED
        self.whole = whole

    def __missing__(self, piece: str) -> int:
        raw = piece.encode()
        n = len(merged(raw, self.ranks))
        if len(raw) <= SHORT:
            if len(self) >= self.most:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[piece] = n
        return n


_LOADED: dict[str, tuple] = {}


def merges_of(file: str) -> tuple:
    """Read once per Python process; the file is part of the installation on every machine."""
    if file not in _LOADED:
        _LOADED[file] = read_merges(file)
    return _LOADED[file]


def count_tokens(docs: DataFrame, file: str, pattern: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row. One pass without a shuffle; memory is one run of texts."""
    ranks, vocabulary, added = merges_of(file)
    shared = docs.sparkSession.sparkContext.broadcast(whole_tokens(vocabulary, ranks))
    special = "|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, cut = regex.compile(pattern).findall, regex.compile(special) if special else None
        get = Counts(shared.value, merges_of(file)[0]).__getitem__
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            raw, n = data.tobytes(), np.zeros(len(batch), dtype=np.int64)
            for i in range(len(batch)):
                text, extra = raw[offsets[i] : offsets[i + 1]].decode(), 0
                parts = [text]
                if cut is not None and cut.search(text):
                    parts = cut.split(text)
                    extra = len(parts) - 1
                n[i] = extra + sum(sum(map(get, find(p))) for p in parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = columns_only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
