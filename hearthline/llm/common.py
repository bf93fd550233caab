"""Shared pieces of the text operators: word hashing over Arrow buffers, blocks of bounded size, shared-folder tables."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from hearthline.session import materialise, scratch_path

__all__ = ["byte_values", "columns_only", "hash_words", "input_bytes", "materialise", "mix", "partitions_for", "release", "resident", "scratch_path", "shingle_sets", "slices", "text_bytes", "word_shingles"]

#: Bytes hashed at a time; numpy needs about 40 bytes of working memory for each.
WINDOW = 1 << 20

_U = np.uint64
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _U(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([[_U(1)], np.full(255, _STEP)]), dtype=np.uint64)


def byte_values(blank: np.ndarray) -> np.ndarray:
    """A random odd value for each byte, one for both cases of A-Z, and 0 for bytes that stand between words."""
    return np.where(blank, _U(0), _ODD[_LOWER])


_VALUE = byte_values(_BLANK)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_RESIDENT: dict[Hashable, Any] = {}


def resident(key: Hashable, build: Callable[[], Any]) -> Any:
    """Tables that a Python worker keeps from task to task: those of one operator at a time."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def release() -> None:
    """Frees what other operators have kept in this worker."""
    _RESIDENT.clear()


def columns_only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and nothing else, so that further or clashing columns never matter."""
    return df.select(*[df[name] for name in names])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; nulls count as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=column.offset * 8)
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes; a longer row is a run of its own."""
    first, last = 0, len(offsets) - 1
    while first < last:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, min(end, last)
        first = min(end, last)


def _hash_window(data: np.ndarray, starts_row: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = (values == 0)[data]
    first = ~blank
    first[1:] &= blank[:-1] | starts_row[1:]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    top = int(lengths.max())
    powers = _POWERS if top <= len(_POWERS) else np.cumprod(np.concatenate([[_U(1)], np.full(top - 1, _STEP)]), dtype=np.uint64)
    products = values[data[starts[0] :]] * powers[place]
    return mix(np.add.reduceat(products, starts - starts[0])), starts


def hash_words(data: np.ndarray, offsets: np.ndarray, values: np.ndarray = _VALUE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of many texts and the n + 1 word offsets of the texts.

    A word is a longest run of bytes with a value, with A-Z lower-cased; by default, of those other than 0x20 and 0x09-0x0D. Bytes are read in windows
    that end at a blank, so a text of any length needs bounded memory besides its words.
    """
    blank = values == 0
    new_row = np.zeros(len(data) + 1, dtype=bool)
    new_row[offsets[:-1]] = True
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + WINDOW, len(data))
        while end < len(data) and not (blank[data[end]] or new_row[end]):
            stop = min(end + WINDOW, len(data))
            found = np.flatnonzero(blank[data[end:stop]] | new_row[end:stop])
            end = end + int(found[0]) if len(found) else stop
        h, s = _hash_window(data[at:end], new_row[at:end], values)
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets, side="left")


def word_shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within each text, and their bounds; a shorter text gives its whole sequence."""
    if not len(words):
        return words, np.zeros(len(bounds), dtype=np.int64)
    factor = mix(np.arange(1, size + 1, dtype=np.uint64) * _STEP) | _U(1)
    counts = np.diff(bounds)
    padded = np.concatenate([words, np.zeros(size, dtype=np.uint64)])
    total = np.zeros(len(words), dtype=np.uint64)
    left = np.repeat(bounds[1:], counts) - np.arange(len(words))
    for k in range(size):
        total += np.where(left > k, padded[k : k + len(words)] * factor[k], _U(0))
    total = mix(total)
    keep = left >= size
    short = (counts > 0) & (counts < size)
    keep[bounds[:-1][short]] = True
    made = np.concatenate([[0], np.cumsum(keep)])
    return total[keep], made[bounds]


def shingle_sets(column: pa.Array, size: int, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct shingle hashes, bounds) for runs of rows of about `most` bytes."""
    data, offsets = text_bytes(column)
    for first, end in slices(offsets, most):
        words, bounds = hash_words(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first])
        shingles, bounds = word_shingles(words, bounds, size)
        parts = [np.unique(shingles[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        yield first, end, np.concatenate(parts) if parts else shingles, np.concatenate([[0], np.cumsum(sizes)])


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a table's size in bytes; for sizing partitions only."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return min(int(size.toString()), 1 << 60)


def partitions_for(spark: SparkSession, size: int, each: int = 32 << 20) -> int:
    """Partitions of about `each` bytes, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-size // each))
