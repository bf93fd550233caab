"""Forests and boosted trees on binned columns, for many members and folds at once.

Columns are cut into bins once: numbers at sketched quantiles, categories one bin each (a split sets one category against
the rest, as with one-hot columns); bin 0 holds what is missing or unseen. A tree is grown level by level from sums of
gradients by (node, column, bin), so rows are never sorted.

The axis of parallel work is the unit: a member, the folds it leaves out, and for forests a run of trees. Where a unit's
rows fit into one task (``LOCAL`` rows, some 150 bytes each), all units are grown in one job, each in its own task; rows
travel in blocks, and a unit of more than ``DIRECT`` rows takes histograms of the larger of two sister nodes as differences
and of several columns at a time. Boosted members of larger tables, or of so few units that cores would be idle, are grown by all tasks
together: each holds its share of the rows for the whole job, and they exchange the histograms of a level through files of the shared
folder. What fits into neither is grown level by level for all units together: tasks add up partial histograms, these are summed by (tree, node)
in a shuffle, the reducers choose the splits, and the driver holds trees only. All ways choose the same splits from the
same sums; random choices depend on a row's id, the seed and the tree's number, never on the way or on partitions.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.operators.ranking import exact_quantiles
from hearthline.session import materialise, scratch_path

#: Bins of a numeric column besides the one for missing values.
BINS = 64
#: Values of a column that a count of CHUNK rows keeps.
POINTS, CHUNK = 50_000, 1 << 18
#: Rows of a unit that one task may hold; bytes of histograms that a task adds up at once; rounds between written predictions.
LOCAL, HISTOGRAMS, WRITTEN = 1 << 23, 128 << 20, 10
#: Rows up to which every histogram of a unit is summed from its rows; rows of a block that travels to the units.
DIRECT, BLOCK = 1 << 18, 1 << 15
#: Trees of a forest grown in one task.
FOREST_RUN = 15
#: Rows from which boosted units that leave cores idle are grown by all tasks together; tasks that do so; their deepest tree.
SPREAD, TOGETHER, SHALLOW = 1 << 19, 32, 8
#: Cells of the joint histogram of several columns, rows of a node from which it is used, cells held at once.
JOINT, FEW, CELLS = 1 << 14, 4096, 1 << 21

_U = np.uint64
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(20)])


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def uniform(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number in [0, 1) for each row id, by seed and tree."""
    salt = scrambled(np.array([(seed << 32 | tree) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))
    return (scrambled(ids.view(np.uint64) ^ salt) >> _U(11)).astype(np.float64) * 2.0**-53


@dataclass(frozen=True)
class Bins:
    """Cut points of numeric columns and known values of categorical ones."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    cuts: tuple[np.ndarray, ...]
    levels: tuple[tuple[str, ...], ...]

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.array([len(c) + 2 for c in self.cuts] + [len(v) + 1 for v in self.levels], dtype=np.int64)

    @cached_property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)])

    def one_against_rest(self) -> np.ndarray:
        return np.arange(len(self.sizes)) >= len(self.numeric)

    def inputs(self) -> tuple[Column, Column]:
        numbers = F.array(*[F.col(c).cast("double") for c in self.numeric]).cast("array<double>")
        return numbers, F.array(*[F.col(c).cast("string") for c in self.categorical]).cast("array<string>")

    def codes(self, numbers: pa.Array, texts: pa.Array) -> np.ndarray:
        """(rows, columns) bins; a number's bin is 1 plus the cuts below it."""
        rows = len(numbers)
        out = np.zeros((rows, len(self.sizes)), dtype=np.int32)
        if self.numeric:
            x = numbers.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
            for k, cuts in enumerate(self.cuts):
                out[:, k] = np.where(np.isnan(x[:, k]), 0, 1 + np.searchsorted(cuts, x[:, k], side="left"))
        if self.categorical:
            flat = texts.flatten()
            for k, levels in enumerate(self.levels):
                column = flat.take(pa.array(np.arange(rows) * len(self.categorical) + k))
                place = pc.index_in(column, value_set=pa.array(levels, pa.string()), skip_nulls=True)
                out[:, len(self.numeric) + k] = pc.fill_null(place, -1).to_numpy() + 1
        return out


def fit_bins(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], bins: int = BINS, points: int = POINTS, chunk: int = CHUNK) -> Bins:
    """Cuts from counted values, exact where no ``chunk`` rows of a column have over ``points`` values and otherwise off by at
    most a rank in ``points``; all values of categorical columns, which are dictionaries. One pass reads both."""
    empty = Bins(tuple(numeric), tuple(categorical), (), ())
    probs = np.arange(1, bins) / bins

    def summary(k: int, values: list[np.ndarray]) -> pa.RecordBatch:
        found, count = np.unique(np.concatenate(values), return_counts=True)
        if len(found) > points:  # the last value of each run of ranks stands for the run
            upto = np.cumsum(count)
            last = np.unique(np.searchsorted(upto, np.ceil(np.arange(1, points + 1) * (upto[-1] / points)).clip(max=upto[-1])))
            found, count = found[last], np.diff(upto[last], prepend=0)
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([found.tobytes()], pa.binary()), pa.array([count.astype(np.int64).tobytes()], pa.binary()), pa.array([None], pa.list_(pa.string()))], names=["k", "found", "count", "levels"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = [[] for _ in numeric]
        levels: list[set[str]] = [set() for _ in categorical]
        rows = 0
        for batch in batches:
            n = len(batch)
            if numeric:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
                for k, column in enumerate(waiting):
                    column.append(x[:, k][~np.isnan(x[:, k])])
            texts = batch.column(1).flatten()
            for k, known in enumerate(levels):
                known.update(v for v in texts.take(pa.array(np.arange(n) * len(levels) + k)).unique().to_pylist() if v is not None)
            rows += n
            if rows >= chunk:
                yield from (summary(k, column) for k, column in enumerate(waiting))
                waiting, rows = [[] for _ in numeric], 0
        if rows:
            yield from (summary(k, column) for k, column in enumerate(waiting))
        for k, known in enumerate(levels):
            yield pa.RecordBatch.from_arrays([pa.array([len(numeric) + k], pa.int32()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([sorted(known)], pa.list_(pa.string()))], names=["k", "found", "count", "levels"])

    def merge(table: pa.Table) -> pa.Table:
        k = table.column("k")[0].as_py()
        if k >= len(numeric):
            return pa.table({"k": pa.array([k], pa.int32()), "cuts": pa.array([None], pa.list_(pa.float64())), "levels": pa.array([sorted(set().union(*table.column("levels").to_pylist()))], pa.list_(pa.string()))})
        value, weight = (np.concatenate([np.frombuffer(x, dtype=kind) for x in table.column(c).to_pylist()]) for c, kind in (("found", np.float64), ("count", np.int64)))
        order = np.argsort(value, kind="stable")
        value, upto = value[order], np.cumsum(weight[order])
        cuts = np.unique(value[np.searchsorted(upto, np.ceil(probs * upto[-1]))]) if len(value) else value
        return pa.table({"k": pa.array([k], pa.int32()), "cuts": pa.array([cuts[cuts < value[-1]] if len(value) else cuts], pa.list_(pa.float64())), "levels": pa.array([None], pa.list_(pa.string()))})

    numbers, texts = empty.inputs()
    parts = train.select(numbers.alias("numbers"), texts.alias("texts")).mapInArrow(count, "k int, found binary, count binary, levels array<string>")
    made = {row["k"]: row for row in parts.groupBy("k").applyInArrow(merge, "k int, cuts array<double>, levels array<string>").collect()}  # one row for each column
    cuts = [np.array(made[k]["cuts"] if k in made else [], dtype=np.float64) for k in range(len(numeric))]
    levels = [tuple(made[len(numeric) + k]["levels"]) if len(numeric) + k in made else () for k in range(len(categorical))]
    return Bins(tuple(numeric), tuple(categorical), tuple(cuts), tuple(levels))


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf has column -1."""

    column: list[int] = field(default_factory=lambda: [-1])
    split: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def divide(self, node: int, column: int, split: int, values: tuple[float, float]) -> tuple[int, int]:
        low = len(self.column)
        self.column[node], self.split[node], self.left[node], self.right[node] = column, split, low, low + 1
        for value in values:
            self.column.append(-1)
            self.split.append(0)
            self.left.append(0)
            self.right.append(0)
            self.value.append(value)
        return low, low + 1

    def leaves(self, codes: np.ndarray, single: np.ndarray, most: int | None = None) -> np.ndarray:
        """The leaf of each row of bins; `single` marks columns that are split as one value against the rest. With the largest
        number of bins a column has, `most`, many rows follow a table of the next node for each node and bin."""
        column, split, left = (np.asarray(x, dtype=np.int64) for x in (self.column, self.split, self.left))
        inner = column >= 0
        if not inner.any():
            return np.zeros(len(codes), dtype=np.int64)
        # A row goes left if its bin lies in [low, low + span]; a leaf leads to itself.
        column = np.where(inner, column, 0)
        low = np.where(inner & single[column], split, 0)
        span = np.where(inner, split - low, np.iinfo(np.int64).max)
        left = np.where(inner, left, np.arange(len(left)))
        if most is not None and len(left) * most <= 2 * len(codes):
            return _followed(codes, column, low, span, left, most)
        out = np.empty(len(codes), dtype=np.int64)
        for a in range(0, len(codes), BLOCK):
            part = np.ascontiguousarray(codes[a : a + BLOCK])
            flat, base = part.ravel(), np.arange(len(part)) * part.shape[1]
            node = np.zeros(len(part), dtype=np.int64)
            while True:
                code = flat.take(base + column.take(node)) - low.take(node)
                after = left.take(node) + ((code < 0) | (code > span.take(node)))
                if np.array_equal(after, node):
                    break
                node = after
            out[a : a + BLOCK] = node
        return out


def _followed(codes: np.ndarray, column: np.ndarray, low: np.ndarray, span: np.ndarray, left: np.ndarray, most: int) -> np.ndarray:
    """The leaf of each row by a table of next nodes; a place in the table is `most` times the node, plus the bin."""
    code = np.arange(most) - low[:, None]
    table = ((left[:, None] + ((code < 0) | (code > span[:, None]))) * most).ravel()
    column_at = np.zeros(len(table), dtype=np.int64)
    column_at[::most] = column
    out = np.empty(len(codes), dtype=np.int64)
    for a in range(0, len(codes), BLOCK):
        part = np.ascontiguousarray(codes[a : a + BLOCK])
        flat, base = part.ravel(), np.arange(len(part)) * part.shape[1]
        place = table.take(part[:, column[0]])
        while True:
            at = column_at.take(place)
            at += base
            after = table.take(place + flat.take(at))
            if np.array_equal(after, place):
                break
            place = after
        out[a : a + BLOCK] = place // most
    return out


def best_splits(count: np.ndarray, total: np.ndarray, bins: Bins, least: float, penalty: float, allowed: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """For each node (row) of histograms over all bins of all columns: column (-1 if no split gains), split, and the rows and
    sums on the left and in the node. Of equal gains the first column and bin win."""
    offsets, single = bins.offsets, bins.one_against_rest()
    column_of = np.repeat(np.arange(len(bins.sizes)), bins.sizes)

    def left_of(x: np.ndarray) -> np.ndarray:
        running = np.cumsum(x, axis=1)
        before = np.where(offsets[:-1] > 0, running[:, offsets[:-1] - 1], 0.0)
        return np.where(single[column_of], x, running - before[:, column_of])

    n, s = left_of(count), left_of(total)
    all_n, all_s = count[:, : offsets[1]].sum(axis=1, keepdims=True), total[:, : offsets[1]].sum(axis=1, keepdims=True)
    valid = (n >= least) & (all_n - n >= least) & (n > 0) & (all_n - n > 0)
    if allowed is not None:
        valid &= allowed[column_of]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(valid, s * s / (n + penalty) + (all_s - s) ** 2 / (all_n - n + penalty), -np.inf)
        whole = (all_s * all_s / (all_n + penalty))[:, 0]
    at = gain.argmax(axis=1)
    rows = np.arange(len(count))
    better = gain[rows, at] > whole + 1e-9 * np.abs(whole) + 1e-12
    return np.where(better, column_of[at], -1), at - offsets[column_of[at]], n[rows, at], s[rows, at], all_n[:, 0], all_s[:, 0]


@dataclass(frozen=True)
class Growth:
    """How a member's trees are grown."""

    kind: str
    trees: int
    depth: int
    step: float = 1.0
    least: float = 1.0
    penalty: float = 0.0
    rows_share: float = 1.0
    columns_share: float = 1.0
    seed: int = 0

    @classmethod
    def of(cls, kind: str, settings: Mapping) -> Growth:
        share = settings.get("featureSubsetStrategy", 1.0)
        return cls(
            kind, settings.get("numTrees") or settings["maxIter"], settings["maxDepth"], 1.0 if kind == "forest" else settings.get("stepSize", 0.1), float(settings.get("minInstancesPerNode", 1)),
            float(settings.get("penalty", 0.0)), float(settings.get("subsamplingRate", 1.0)), float(share), int(settings.get("seed", 0)),
        )

    def columns(self, tree: int, number: int) -> np.ndarray | None:
        if self.columns_share >= 1.0:
            return None
        allowed = np.zeros(number, dtype=bool)
        allowed[np.random.default_rng([self.seed, tree]).permutation(number)[: max(1, round(self.columns_share * number))]] = True
        return allowed

    def weights(self, ids: np.ndarray, tree: int) -> np.ndarray | None:
        """How often each row counts in a tree: a bootstrap for forests, a share of rows for boosting."""
        if self.kind == "forest":
            return np.searchsorted(_POISSON, uniform(ids, self.seed, tree), side="right").astype(np.float64)
        if self.rows_share < 1.0:
            return (uniform(ids, self.seed, tree) < self.rows_share).astype(np.float64)
        return None

    def gradient(self, y: np.ndarray, prediction: np.ndarray) -> np.ndarray:
        return y if self.kind == "forest" else np.sign(y - prediction) if self.kind == "median" else y - prediction


def histograms(flat: np.ndarray, node: np.ndarray, nodes: int, gradient: np.ndarray, weight: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row counts and gradient sums by node and bin; `flat` holds bins that are numbered over all columns."""
    cell = (flat + (node * width)[:, None]).ravel()
    columns = flat.shape[1]
    count = np.bincount(cell, None if weight is None else np.repeat(weight, columns), minlength=nodes * width)
    total = np.bincount(cell, np.repeat(gradient if weight is None else gradient * weight, columns), minlength=nodes * width)
    return count.reshape(nodes, width).astype(np.float64), total.reshape(nodes, width)


def grow_tree(flat: np.ndarray, gradient: np.ndarray, weight: np.ndarray | None, bins: Bins, growth: Growth, tree: int) -> Tree:
    """One tree over rows that are at hand."""
    single, offsets, width = bins.one_against_rest(), bins.offsets, int(bins.offsets[-1])
    if weight is not None:
        some = np.flatnonzero(weight)
        flat, gradient, weight = flat[some], gradient[some], weight[some]
    out, allowed = Tree(), growth.columns(tree, len(bins.sizes))
    total_n, total_s = (len(gradient), gradient.sum()) if weight is None else (weight.sum(), (gradient * weight).sum())
    out.value[0] = float(total_s / (total_n + growth.penalty)) if total_n else 0.0
    rows, place, open_nodes = np.arange(len(gradient)), np.zeros(len(gradient), dtype=np.int64), [0]
    for _ in range(growth.depth):
        if not open_nodes or not len(rows):
            break
        count, total = histograms(flat[rows], place, len(open_nodes), gradient[rows], None if weight is None else weight[rows], width)
        column, split, n, s, all_n, all_s = best_splits(count, total, bins, growth.least, growth.penalty, allowed)
        after = np.full((len(open_nodes), 2), -1)
        following: list[int] = []
        for k in np.flatnonzero(column >= 0).tolist():
            values = float(s[k] / (n[k] + growth.penalty)), float((all_s[k] - s[k]) / (all_n[k] - n[k] + growth.penalty))
            after[k] = len(following), len(following) + 1
            following += out.divide(open_nodes[k], int(column[k]), int(split[k]), values)
        keep = column[place] >= 0
        rows, place = rows[keep], place[keep]
        c = column[place]
        code = flat[rows, c] - offsets[c]
        place = after[place, np.where(np.where(single[c], code == split[place], code <= split[place]), 0, 1)]
        open_nodes = following
    return out


class Packed:
    """Bins by column, and the bins of several columns as one joint number: one count of joint numbers gives the histograms
    of all columns of a group."""

    def __init__(self, codes: np.ndarray, bins: Bins):
        self.codes, self.bins, self.sizes = codes, bins, [int(x) for x in bins.sizes]
        self.groups: list[list[int]] = []
        for k in np.argsort(bins.sizes, kind="stable").tolist():
            if self.groups and np.prod([self.sizes[c] for c in self.groups[-1]]) * self.sizes[k] <= JOINT:
                self.groups[-1].append(k)
            else:
                self.groups.append([k])
        self.joint = []
        for group in self.groups:
            number = np.zeros(len(codes), dtype=np.uint16 if np.prod([self.sizes[c] for c in group]) <= 1 << 16 else np.uint32)
            for k in group:
                number *= number.dtype.type(self.sizes[k])
                number += codes[:, k].astype(number.dtype)
            self.joint.append(number)

    def histogram(self, rows: np.ndarray, gradient: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
        """(2, bins): row counts and gradient sums of the given rows, which are in ascending order."""
        out = np.zeros((2, int(self.bins.offsets[-1])))
        sums = [np.zeros((2, int(np.prod([self.sizes[c] for c in group])))) for group in self.groups]
        for a in range(0, len(rows), BLOCK):
            at = rows[a : a + BLOCK]
            run = slice(at[0], at[-1] + 1) if at[-1] - at[0] + 1 == len(at) else None  # rows that follow each other
            g, w = (None if x is None else x.take(at) if run is None else x[run] for x in (gradient, weight))
            if w is not None:
                g = g * w
            for found, joint in zip(sums, self.joint, strict=True):
                number = (joint.take(at) if run is None else joint[run]).astype(np.int64)
                found[0] += np.bincount(number, w, minlength=found.shape[1])
                found[1] += np.bincount(number, g, minlength=found.shape[1])
        for found, group in zip(sums, self.groups, strict=True):
            cube = found.reshape(2, *[self.sizes[k] for k in group])
            for axis, k in enumerate(group, 1):
                start = int(self.bins.offsets[k])
                out[:, start : start + self.sizes[k]] = cube.sum(axis=tuple(x for x in range(1, len(group) + 1) if x != axis))
        return out

    def small(self, rows: np.ndarray, place: np.ndarray, nodes: int, gradient: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Row counts and gradient sums by node and bin, a column at a time; `place` is the node of each of the rows."""
        g, w = gradient.take(rows), None if weight is None else weight.take(rows)
        if w is not None:
            g = g * w
        count, total = (np.empty((nodes, int(self.bins.offsets[-1]))) for _ in range(2))
        for k, size in enumerate(self.sizes):
            cell = place * size
            cell += self.codes[:, k].take(rows)
            own = slice(int(self.bins.offsets[k]), int(self.bins.offsets[k + 1]))
            count[:, own] = np.bincount(cell, w, minlength=nodes * size).reshape(nodes, size)
            total[:, own] = np.bincount(cell, g, minlength=nodes * size).reshape(nodes, size)
        return count, total


def grow_packed(packed: Packed, gradient: np.ndarray, weight: np.ndarray | None, growth: Growth, number: int) -> tuple[Tree, np.ndarray]:
    """One tree over many rows, and each row's leaf. Rows stay grouped by node; of two sisters the smaller is summed and the
    larger is what remains of their parent; small nodes are summed many at a time."""
    bins, codes = packed.bins, packed.codes
    single, width = bins.one_against_rest(), int(bins.offsets[-1])
    some = np.arange(len(gradient)) if weight is None else np.flatnonzero(weight)
    if weight is not None and growth.kind != "forest":
        weight_of = None  # rows of a share count once
    else:
        weight_of = weight
    out, allowed, leaf = Tree(), growth.columns(number, len(bins.sizes)), np.full(len(gradient), -1, dtype=np.int64)
    if weight_of is None:
        total_n, total_s = float(len(some)), gradient[some].sum()
    else:
        total_n, total_s = weight_of.sum(), (gradient * weight_of).sum()
    out.value[0] = float(total_s / (total_n + growth.penalty)) if total_n else 0.0
    # (node, its rows, its histogram if known)
    level: list[tuple[int, np.ndarray, np.ndarray | None]] = [(0, some, None)]
    for depth in range(growth.depth):
        following: list[tuple[int, np.ndarray, np.ndarray | None]] = []
        for batch in _batched(level, width, len(bins.sizes)):
            count, total = np.zeros((len(batch), width)), np.zeros((len(batch), width))
            few = [k for k, (_, rows, known) in enumerate(batch) if known is None and len(rows) < FEW]
            if few:
                rows = np.concatenate([batch[k][1] for k in few])
                place = np.repeat(np.arange(len(few)), [len(batch[k][1]) for k in few])
                count[few], total[few] = packed.small(rows, place, len(few), gradient, weight_of)
            for k, (_, rows, known) in enumerate(batch):
                if known is not None:
                    count[k], total[k] = known
                elif len(rows) >= FEW:
                    count[k], total[k] = packed.histogram(rows, gradient, weight_of)
            column, split, n, s, all_n, all_s = best_splits(count, total, bins, growth.least, growth.penalty, allowed)
            for k, (node, rows, _) in enumerate(batch):
                if column[k] < 0:
                    leaf[rows] = node
                    continue
                c = int(column[k])
                values = float(s[k] / (n[k] + growth.penalty)), float((all_s[k] - s[k]) / (all_n[k] - n[k] + growth.penalty))
                low, high = out.divide(node, c, int(split[k]), values)
                code = codes[:, c].take(rows)
                first = code == split[k] if single[c] else code <= split[k]
                parts = rows.compress(first), rows.compress(~first)
                if depth + 1 == growth.depth:
                    leaf[parts[0]], leaf[parts[1]] = low, high
                    continue
                known = [None, None]
                if len(rows) >= 2 * FEW:
                    less = int(len(parts[1]) < len(parts[0]))
                    known[less] = packed.histogram(parts[less], gradient, weight_of)
                    known[1 - less] = np.stack([count[k], total[k]]) - known[less]
                    known[1 - less][1][known[1 - less][0] == 0] = 0.0
                following += [(low, parts[0], known[0]), (high, parts[1], known[1])]
        level = following
    rest = np.flatnonzero(leaf < 0)
    if len(rest) and growth.kind != "forest":
        leaf[rest] = out.leaves(np.stack([codes[:, k].take(rest) for k in range(codes.shape[1])], axis=1), single, int(bins.sizes.max(initial=0)))
    return out, leaf


def _batched(level: list, width: int, columns: int) -> Iterator[list]:
    """Nodes in turn, as many as keep histograms and the bins of their rows within CELLS."""
    batch, rows = [], 0
    for item in level:
        few = len(item[1]) if item[2] is None and len(item[1]) < FEW else 0
        if batch and ((len(batch) + 1) * width > CELLS or (rows + few) * columns > CELLS):
            yield batch
            batch, rows = [], 0
        batch.append(item)
        rows += few
    if batch:
        yield batch


Add = Callable[[np.ndarray], np.ndarray]


def grow_together(packed: Packed, gradient: np.ndarray, weight: np.ndarray | None, growth: Growth, number: int, add: Add) -> tuple[Tree, np.ndarray]:
    """One boosted tree over the rows of all tasks, and the leaf of each row of this task. `add` sums an array over all tasks, once
    a level, so all choose the same splits; of two sisters with many rows the smaller is summed."""
    bins, codes = packed.bins, packed.codes
    single, width = bins.one_against_rest(), int(bins.offsets[-1])
    some = np.arange(len(gradient)) if weight is None else np.flatnonzero(weight)
    out, allowed, leaf = Tree(), growth.columns(number, len(bins.sizes)), np.full(len(gradient), -1, dtype=np.int32)
    total_n, total_s = add(np.array([len(some), gradient[some].sum()]))
    out.value[0] = float(total_s / (total_n + growth.penalty)) if total_n else 0.0
    # (node, its rows here, and for what remains of its parent: the place of its sister and the parent's histogram)
    level: list[tuple[int, np.ndarray, tuple[int, np.ndarray] | None]] = [(0, some, None)]
    for depth in range(growth.depth):
        if not level:
            break
        found = np.zeros((len(level), 2, width))
        asked = [k for k, (_, _, rest) in enumerate(level) if rest is None]
        few = [k for k in asked if len(level[k][1]) < FEW]
        for a in range(0, len(few), max(1, CELLS // width)):
            part = few[a : a + max(1, CELLS // width)]
            rows = np.concatenate([level[k][1] for k in part])
            place = np.repeat(np.arange(len(part)), [len(level[k][1]) for k in part])
            found[part, 0], found[part, 1] = packed.small(rows, place, len(part), gradient, None)
        for k in asked:
            if len(level[k][1]) >= FEW:
                found[k] = packed.histogram(level[k][1], gradient, None)
        found[asked] = add(found[asked])
        for k, (_, _, rest) in enumerate(level):
            if rest is not None:
                found[k] = rest[1] - found[rest[0]]
                found[k, 1][found[k, 0] == 0] = 0.0
        column, split, n, s, all_n, all_s = best_splits(found[:, 0], found[:, 1], bins, growth.least, growth.penalty, allowed)
        following: list[tuple[int, np.ndarray, tuple[int, np.ndarray] | None]] = []
        for k, (node, rows, _) in enumerate(level):
            if column[k] < 0:
                leaf[rows] = node
                continue
            c = int(column[k])
            values = float(s[k] / (n[k] + growth.penalty)), float((all_s[k] - s[k]) / (all_n[k] - n[k] + growth.penalty))
            low, high = out.divide(node, c, int(split[k]), values)
            code = codes[:, c].take(rows)
            first = code == split[k] if single[c] else code <= split[k]
            parts = rows.compress(first), rows.compress(~first)
            if depth + 1 == growth.depth:
                leaf[parts[0]], leaf[parts[1]] = low, high
                continue
            rest: list[tuple[int, np.ndarray] | None] = [None, None]
            if all_n[k] >= 2 * FEW:
                less = int(all_n[k] - n[k] < n[k])
                rest[1 - less] = len(following) + less, found[k]
            following += [(low, parts[0], rest[0]), (high, parts[1], rest[1])]
        level = following
    left = np.flatnonzero(leaf < 0)
    if len(left):
        leaf[left] = out.leaves(np.stack([codes[:, k].take(left) for k in range(codes.shape[1])], axis=1), single, int(bins.sizes.max(initial=0)))
    return out, leaf


def middle_values(parts: Sequence[np.ndarray], add: Add) -> list[float | None]:
    """The median of each group over the rows of all tasks, which give theirs; eight exchanges find its bytes one by one."""
    keys = []
    for part in parts:
        bits = (np.sort(part) + 0.0).view(np.uint64)  # numbers in the order of floats
        keys.append(np.where(bits >> _U(63) > 0, ~bits, bits | _U(1 << 63)))
    count = add(np.array([len(x) for x in keys], dtype=np.float64)).astype(np.int64)
    rank = np.stack([(count - 1) // 2, count // 2], axis=1)
    found = np.zeros(rank.shape, dtype=np.uint64)
    for shift in range(56, -1, -8):
        bounds = found[:, :, None] + (np.arange(256, dtype=np.uint64) << _U(shift))
        below = add(np.stack([np.searchsorted(x, b) for x, b in zip(keys, bounds, strict=True)]).astype(np.float64))
        digit = np.maximum((below <= rank[:, :, None]).sum(axis=2) - 1, 0)
        found += digit.astype(np.uint64) << _U(shift)
    bits = np.where(found >> _U(63) > 0, found ^ _U(1 << 63), ~found)
    return [float(a + b) / 2 if n else None for (a, b), n in zip(bits.view(np.float64), count, strict=True)]


def grow_shared(units: Sequence[Unit], ids: np.ndarray, fold: np.ndarray, y: np.ndarray, codes: np.ndarray, bins: Bins, add: Add) -> Iterator[tuple[int, float, list[Tree]]]:
    """(place, start, trees) of boosted units, over rows of which this task holds a share, in the order of ids; bins lie by column."""
    for held in dict.fromkeys(u.held for u in units):
        keep = ~np.isin(fold, held)
        own_ids, own_y = (ids, y) if keep.all() else (ids[keep], y[keep])
        packed = Packed(np.asfortranarray(codes if keep.all() else codes[keep]), bins)
        for place, unit in enumerate(units):
            if unit.held != held:
                continue
            growth = unit.growth
            if growth.kind == "median":
                start = middle_values([own_y], add)[0] or 0.0
            else:
                count, total = add(np.array([len(own_y), own_y.sum()]))
                start = float(total / count) if count else 0.0
            prediction, trees = np.full(len(own_y), start), []
            for number in range(growth.trees):
                weight = growth.weights(own_ids, number)
                tree, leaf = grow_together(packed, growth.gradient(own_y, prediction), weight, growth, number, add)
                if growth.kind == "median":
                    some = slice(None) if weight is None else weight > 0
                    at, rest = leaf[some], (own_y - prediction)[some]
                    by_leaf = np.argsort(at, kind="stable")
                    at, rest, ends = at[by_leaf], rest[by_leaf], np.flatnonzero(np.array(tree.column) < 0)
                    lists = [rest[a:b] for a, b in zip(np.searchsorted(at, ends), np.searchsorted(at, ends, side="right"), strict=True)]
                    for node, value in zip(ends.tolist(), middle_values(lists, add), strict=True):
                        if value is not None:
                            tree.value[node] = value
                prediction += growth.step * np.asarray(tree.value)[leaf]
                trees.append(tree)
            yield place, start, trees


def leaf_medians(tree: Tree, leaf: np.ndarray, rest: np.ndarray) -> None:
    """Each leaf's value becomes the median of what is left of its rows."""
    order = np.lexsort((rest, leaf))
    leaf, rest = leaf[order], rest[order]
    starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]])) if len(leaf) else np.zeros(0, dtype=np.int64)
    ends = np.append(starts[1:], len(leaf))
    for node, a, b in zip(leaf[starts].tolist(), starts.tolist(), ends.tolist(), strict=True):
        tree.value[node] = float(rest[(a + b - 1) // 2] + rest[(a + b) // 2]) / 2


@dataclass(frozen=True)
class Unit:
    """A member without the rows of some folds; of a forest, the trees from `first` on."""

    name: str
    held: tuple[int, ...]
    growth: Growth
    first: int = 0
    trees: int = 0


def start_value(growth: Growth, y: np.ndarray) -> float:
    return 0.0 if growth.kind == "forest" or not len(y) else float(np.median(y)) if growth.kind == "median" else float(y.mean())


def grow_unit(unit: Unit, ids: np.ndarray, y: np.ndarray, codes: np.ndarray, bins: Bins, direct: int = DIRECT) -> tuple[float, list[Tree]]:
    """All trees of a unit whose rows are at hand."""
    growth, single = unit.growth, bins.one_against_rest()
    order = np.argsort(ids, kind="stable")  # sums do not depend on how rows arrive
    ids, y, codes = ids[order], y[order], codes[order]
    if len(y) > direct:
        codes = np.asfortranarray(codes)  # many rows are read a column at a time
    packed = Packed(codes, bins) if len(y) > direct else None
    flat = codes + bins.offsets[:-1].astype(np.int32) if packed is None else None
    start = start_value(growth, y)
    prediction = np.full(len(y), start)
    trees = []
    for number in range(unit.first, unit.first + unit.trees):
        weight = growth.weights(ids, number)
        if packed is not None:
            tree, leaf = grow_packed(packed, growth.gradient(y, prediction), weight, growth, number)
        else:
            tree = grow_tree(flat, growth.gradient(y, prediction), weight, bins, growth, number)
            leaf = tree.leaves(codes, single, int(bins.sizes.max(initial=0))) if growth.kind != "forest" else None
        if growth.kind != "forest":
            if growth.kind == "median":
                some = slice(None) if weight is None else weight > 0
                leaf_medians(tree, leaf[some], (y - prediction)[some])
            prediction += growth.step * np.asarray(tree.value)[leaf]
        trees.append(tree)
    return start, trees


@dataclass
class Grown:
    """A member's trees; ``raw`` gives predictions for rows of bins, ``staged`` the running ones after each tree."""

    bins: Bins
    growth: Growth
    start: float
    trees: list[Tree]

    def raw(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        for part in self.parts(codes):
            out += part
        return out / max(len(self.trees), 1) if self.growth.kind == "forest" else self.start + self.growth.step * out

    def parts(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        single, most = self.bins.one_against_rest(), int(self.bins.sizes.max(initial=0))
        for tree in self.trees:
            yield np.asarray(tree.value).take(tree.leaves(codes, single, most))

    def staged(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        out = np.zeros(len(codes))
        for k, part in enumerate(self.parts(codes), 1):
            out += part
            yield out / k if self.growth.kind == "forest" else self.start + self.growth.step * out


Models = dict[tuple[str, tuple[int, ...]], Grown]


def _code_type(bins: Bins) -> type:
    most = bins.sizes.max(initial=0)
    return np.uint8 if most <= 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32


def coded(train: DataFrame, bins: Bins, target: str, fold: str | None, key: str) -> DataFrame:
    """(id, fold, y, codes): rows as bins, a byte a column (two if a column has over 256 bins, four over 65,535)."""
    kind = _code_type(bins)
    numbers, texts = bins.inputs()
    rows = train.select(F.xxhash64(key).alias("id"), (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"), F.col(target).cast("double").alias("y"), numbers.alias("numbers"), texts.alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = bins.codes(batch.column(3), batch.column(4)).astype(kind)
            raw = pa.Array.from_buffers(pa.binary(codes.shape[1] * codes.itemsize), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), raw], names=["id", "fold", "y", "codes"])

    return rows.where("y is not null").mapInArrow(run, "id bigint, fold int, y double, codes binary")


def decoded(column: pa.Array, bins: Bins) -> np.ndarray:
    kind = _code_type(bins)
    size = len(bins.sizes) * kind().itemsize
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)
    data = column.buffers()[2]
    if not len(column) or data is None:
        return np.zeros((len(column), len(bins.sizes)), dtype=np.int32)
    return np.frombuffer(data, dtype=kind, count=len(column) * size // kind().itemsize, offset=int(offsets[column.offset])).reshape(len(column), len(bins.sizes)).astype(np.int32)


BLOCK_SCHEMA = "fold int, part int, ids binary, y binary, codes binary"


def blocks(rows: DataFrame, bins: Bins, parts: int = 1) -> DataFrame:
    """Coded rows in blocks of one fold and of one of the parts that ids make: few long values travel, not many short rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list[tuple[np.ndarray, ...]]] = {}
        held: dict[tuple[int, int], int] = {}

        def block(key: tuple[int, int]) -> pa.RecordBatch:
            ids, y, codes = (np.concatenate(x) for x in zip(*waiting.pop(key), strict=True))
            held.pop(key)
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()) for k in key] + [pa.array([x.tobytes()], pa.binary()) for x in (ids, y, codes)], names=["fold", "part", "ids", "y", "codes"])

        for batch in batches:
            fold = batch.column(1).fill_null(-1).to_numpy()
            ids, y = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            codes = decoded(batch.column(3), bins).astype(_code_type(bins))
            part = ids % parts
            for value in np.unique(fold).tolist():
                for p in np.unique(part[fold == value]).tolist():
                    at = (fold == value) & (part == p)
                    waiting.setdefault((value, p), []).append((ids[at], y[at], codes[at]))
                    held[value, p] = held.get((value, p), 0) + int(at.sum())
                    if held[value, p] >= BLOCK:
                        yield block((value, p))
        for key in list(waiting):
            yield block(key)

    return rows.mapInArrow(run, BLOCK_SCHEMA)


UNIT_SCHEMA = "unit int, start double, tree int, col array<int>, split array<int>, l array<int>, r array<int>, value array<double>"


def grow_members(
    train: DataFrame, growths: Mapping[str, Growth], bins: Bins, target: str, held: Sequence[tuple[int, ...]] = ((),), fold: str | None = None, key: str = "house_id", local: int = LOCAL
) -> Models:
    """Each member for each set of left-out folds, from one pass over the rows."""
    rows = coded(train, bins, target, fold, key)
    count = {r["fold"]: r["count"] for r in train.where(F.col(target).isNotNull()).groupBy((F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold")).count().collect()}
    most = max((sum(c for f, c in count.items() if f not in without) for without in held), default=0)
    if most > min(SPREAD, local):
        boosted = {name: g for name, g in growths.items() if g.kind != "forest" and g.depth <= SHALLOW}
        tasks, cost = min(slots(train.sparkSession), TOGETHER), [g.trees * g.depth for g in boosted.values()]
        shared = urlparse(scratch_path(train.sparkSession, "exchange"))
        fits = tasks > 1 and bool(boosted) and sum(count.values()) <= tasks * local and shared.scheme in ("", "file")
        if most > local:
            rest = {name: g for name, g in growths.items() if not fits or name not in boosted}
            rows = materialise(rows) if rest else rows
            out = grow_spread(rows, boosted, bins, held, tasks, shared.path) if fits else {}
            return out | (grow_large(rows, rest, bins, held) if rest else {})
        if fits and len(boosted) == len(growths) and 1.25 * sum(cost) * len(held) < tasks * max(cost):
            return grow_spread(rows, boosted, bins, held, tasks, shared.path)
    units = []
    for name, growth in growths.items():
        run = growth.trees if growth.kind != "forest" else FOREST_RUN
        units += [Unit(name, without, growth, first, min(run, growth.trees - first)) for without in held for first in range(0, growth.trees, run)]
    units.sort(key=lambda u: -u.trees * u.growth.depth)  # a unit's number is its partition, and the longest start first
    wanted = F.array(*[F.struct(F.lit(k).alias("unit"), F.array(*[F.lit(f) for f in u.held]).cast("array<int>").alias("held")) for k, u in enumerate(units)])
    dealt = blocks(rows, bins).withColumn("u", F.explode(wanted)).where(~F.array_contains("u.held", F.col("fold"))).select(F.col("u.unit").alias("unit"), "ids", "y", "codes")
    return _models(units, _grown(dealt, units, bins), bins)


def grow_groups(train: DataFrame, growth: Growth, bins: Bins, target: str, group: str, number: int, key: str = "house_id") -> dict[int, Grown]:
    """A member for each of `number` groups, which the column ``group`` counts from 0: one pass over the rows, and a group's rows in
    one task."""
    units = [Unit(str(k), (), growth, 0, growth.trees) for k in range(number)]
    dealt = blocks(coded(train, bins, target, group, key), bins).select(F.col("fold").alias("unit"), "ids", "y", "codes")
    made = _models(units, _grown(dealt, units, bins), bins)
    return {k: made[str(k), ()] for k in range(number)}


def _grown(dealt: DataFrame, units: Sequence[Unit], bins: Bins) -> pa.Table:
    """Trees of all units, each in its own task, from blocks of rows that name their unit."""

    def run(table: pa.Table) -> pa.Table:
        number = table.column("unit")[0].as_py()
        ids, y, codes = (_joined(table.column(c).chunks, kind) for c, kind in (("ids", np.int64), ("y", np.float64), ("codes", _code_type(bins))))
        codes = codes.reshape(len(y), len(bins.sizes))
        start, trees = grow_unit(units[number], ids, y, codes if len(y) > DIRECT else codes.astype(np.int32), bins)
        return _as_table(number, start, units[number].first, trees)

    return dealt.repartitionById(len(units), "unit").groupBy("unit").applyInArrow(run, UNIT_SCHEMA).toArrow()


def _joined(chunks: Sequence[pa.Array], kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=kind), *[np.frombuffer(value.as_buffer(), dtype=kind) for chunk in chunks for value in chunk]])


def _as_table(number: int, start: float, first: int, trees: Sequence[Tree]) -> pa.Table:
    return pa.table({
        "unit": pa.array([number] * len(trees), pa.int32()), "start": pa.array([start] * len(trees), pa.float64()), "tree": pa.array(range(first, first + len(trees)), pa.int32()),
        **{name: pa.array([getattr(t, part) for t in trees], pa.list_(pa.int32())) for name, part in (("col", "column"), ("split", "split"), ("l", "left"), ("r", "right"))},
        "value": pa.array([t.value for t in trees], pa.list_(pa.float64())),
    })


def _models(units: Sequence[Unit], made: pa.Table, bins: Bins) -> Models:
    out: Models = {(u.name, u.held): Grown(bins, u.growth, 0.0, [Tree()] * u.growth.trees) for u in units}
    for batch in made.to_batches():
        lists = [batch.column(c) for c in ("col", "split", "l", "r", "value")]
        for k, (number, start, tree) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("unit", "start", "tree")), strict=True)):
            model = out[units[number].name, units[number].held]
            model.start = start
            model.trees[tree] = Tree(*(x[k].values.to_numpy(zero_copy_only=False).copy() for x in lists))  # type: ignore[arg-type]
    return out


def slots(spark: SparkSession) -> int:
    """Tasks that can run at the same time; none are counted on where executors come and go."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    context = spark.sparkContext._jsc.sc()
    return context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())


@dataclass
class Exchange:
    """Sums of arrays over tasks that run at the same time, through files of a folder that all can reach. A file appears whole, by
    its new name, and is deleted when all have written the next, as each has then read it."""

    folder: str
    task: int
    tasks: int
    step: int = 0
    patience: float = 1800.0

    def name(self, step: int, task: int) -> str:
        return os.path.join(self.folder, f"{step}-{task}")

    def add(self, x: np.ndarray) -> np.ndarray:
        os.makedirs(self.folder, exist_ok=True)
        mine = self.name(self.step, self.task)
        with open(f"{mine}.part", "wb") as out:
            out.write(np.ascontiguousarray(x).tobytes())
        os.rename(f"{mine}.part", mine)
        total, until = np.zeros(x.shape, dtype=x.dtype), time.monotonic() + self.patience
        for task in range(self.tasks):  # all add in the same order
            pause = 1e-4
            while not os.path.exists(self.name(self.step, task)):
                if time.monotonic() > until:
                    raise TimeoutError(f"task {task} wrote no sums of step {self.step}")
                time.sleep(pause)
                pause = min(2 * pause, 0.01)
            total += np.fromfile(self.name(self.step, task), dtype=x.dtype).reshape(x.shape)
        if self.step:
            os.remove(self.name(self.step - 1, self.task))
        self.step += 1
        return total


def _share(batches: Iterator[pa.RecordBatch], bins: Bins) -> tuple[np.ndarray, ...]:
    """ids, folds, targets and bins by column of a task's blocks, in the order of ids."""
    found = list(batches)
    ids, y, raw = (_joined([b.column(c) for b in found], kind) for c, kind in (("ids", np.int64), ("y", np.float64), ("codes", _code_type(bins))))
    length = [len(x.as_buffer()) // 8 for b in found for x in b.column("ids")]
    fold = np.repeat(np.array([f for b in found for f in b.column("fold").to_pylist()], dtype=np.int32), length)
    found.clear()
    order, raw = np.argsort(ids, kind="stable"), raw.reshape(len(y), len(bins.sizes))
    codes = np.empty(raw.shape, dtype=raw.dtype, order="F")
    for k in range(raw.shape[1]):
        codes[:, k] = raw[:, k].take(order)
    return ids[order], fold[order], y[order], codes


def grow_spread(rows: DataFrame, growths: Mapping[str, Growth], bins: Bins, held: Sequence[tuple[int, ...]], tasks: int, folder: str) -> Models:
    """Boosted members by tasks that run at the same time: each holds the rows whose ids fall to it, in memory for the whole job.
    The barrier starts them together and names the folder of this attempt; sums go through files, as its own messages take a second
    each. A lost task starts the job again."""
    units = [Unit(name, without, growth, 0, growth.trees) for name, growth in growths.items() for without in held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, share = BarrierTaskContext.get(), _share(batches, bins)
        attempt = context.allGather(uuid.uuid4().hex)[0]
        exchange = Exchange(os.path.join(folder, attempt), context.partitionId(), tasks)
        for place, start, trees in grow_shared(units, *share, bins, exchange.add):
            if not exchange.task:  # all have the same trees
                yield from _as_table(place, start, 0, trees).to_batches()

    dealt = blocks(rows, bins, tasks).repartitionById(tasks, "part")
    return _models(units, dealt.mapInArrow(run, UNIT_SCHEMA, barrier=True).toArrow(), bins)


@dataclass
class Growing:
    """A tree of a table too large for one task: nodes that may still be divided."""

    model: int
    number: int
    tree: Tree
    open_nodes: list[int]
    depth: int = 0


def grow_large(table: DataFrame, growths: Mapping[str, Growth], bins: Bins, held: Sequence[tuple[int, ...]]) -> Models:
    """Level by level with summed histograms. Boosted members of all units advance together, a round at a time; predictions
    are written every WRITTEN rounds, so a task replays a few trees only and a lost executor costs a replay."""
    names = [(name, without) for name in growths for without in held]
    models = [Grown(bins, growths[name], 0.0, []) for name, _ in names]
    boosted = [k for k, m in enumerate(models) if m.growth.kind != "forest"]
    starts = _starts(table, models, names)
    for k in boosted:
        models[k].start = starts[k]
    state = materialise(table.select("id", "fold", "y", "codes", F.array(*[F.lit(m.start) for m in models]).cast("array<double>").alias("p")))
    replay: list[tuple[int, Tree]] = []
    for number in range(max((models[k].growth.trees for k in boosted), default=0)):
        active = [Growing(k, number, Tree(), [0]) for k in boosted if number < models[k].growth.trees]
        _grow_levels(state, active, models, names, replay)
        medians = [g for g in active if models[g.model].growth.kind == "median"]
        if medians:
            _set_medians(state, medians, models, names, replay)
        for g in active:
            models[g.model].trees.append(g.tree)
            replay.append((g.model, g.tree))
        if (number + 1) % WRITTEN == 0:
            state = materialise(_advanced(state, models, replay))
            replay = []
    for k, model in enumerate(models):
        if model.growth.kind == "forest":
            batch = [Growing(k, number, Tree(), [0]) for number in range(model.growth.trees)]
            _grow_levels(state, batch, models, names, [])
            model.trees = [g.tree for g in batch]
    return dict(zip(names, models, strict=True))


def _starts(table: DataFrame, models: list[Grown], names: list[tuple[str, tuple[int, ...]]]) -> list[float]:
    out = []
    for model, (_, without) in zip(models, names, strict=True):
        rows = table.where(~F.col("fold").isin(list(without))) if without else table
        if model.growth.kind == "median":
            out.append(float(exact_quantiles(rows, "y", {"mid": 0.5}).first()["mid"]))
        else:
            out.append(float(rows.agg(F.avg("y")).first()[0]))
    return out


def _batches(batch: pa.RecordBatch, bins: Bins, models: list[Grown], replay: list[tuple[int, Tree]]) -> tuple[np.ndarray, ...]:
    """ids, folds, targets, bins and predictions of all models after the trees of `replay`."""
    ids, fold, y = (batch.column(k).to_numpy() for k in range(3))
    codes = decoded(batch.column(3), bins)
    prediction = batch.column(4).flatten().to_numpy().reshape(len(batch), -1).copy()
    single = bins.one_against_rest()
    for model, tree in replay:
        prediction[:, model] += models[model].growth.step * np.asarray(tree.value)[tree.leaves(codes, single)]
    return ids, fold, y, codes, prediction


def _advanced(state: DataFrame, models: list[Grown], replay: list[tuple[int, Tree]]) -> DataFrame:
    bins = models[0].bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prediction = _batches(batch, bins, models, replay)[4]
            p = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * len(models), pa.int32()), pa.array(prediction.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], p], names=["id", "fold", "y", "codes", "p"])

    return state.mapInArrow(run, "id bigint, fold int, y double, codes binary, p array<double>")


def _grow_levels(state: DataFrame, active: list[Growing], models: list[Grown], names: list[tuple[str, tuple[int, ...]]], replay: list[tuple[int, Tree]]) -> None:
    """Grows all given trees to their depth; each job sums histograms of as many nodes as a task may hold."""
    bins = models[0].bins
    width = int(bins.offsets[-1])
    most = max(1, HISTOGRAMS // (16 * width))
    while True:
        waiting = [(g, a) for g in active if g.depth < models[g.model].growth.depth for a in range(0, len(g.open_nodes), most)]
        if not waiting:
            return
        divided: dict[int, list[int]] = {}
        while waiting:
            job, nodes = [], 0
            while waiting and (not job or nodes + len(waiting[0][0].open_nodes[waiting[0][1] :][:most]) <= most):
                g, a = waiting.pop(0)
                job.append((g, g.open_nodes[a : a + most]))
                nodes += len(job[-1][1])
            for row in _level(state, job, models, names, replay).to_pylist():
                g = job[row["tree"]][0]
                growth, node = models[g.model].growth, job[row["tree"]][1][row["node"]]
                if node == 0:
                    g.tree.value[0] = row["all_s"] / (row["all_n"] + growth.penalty)
                if row["col"] >= 0:
                    rest_n, rest_s = row["all_n"] - row["n"], row["all_s"] - row["s"]
                    made = g.tree.divide(node, row["col"], row["split"], (row["s"] / (row["n"] + growth.penalty), rest_s / (rest_n + growth.penalty)))
                    divided.setdefault(id(g), []).extend(made)
        for g in active:
            if g.depth < models[g.model].growth.depth:
                g.open_nodes, g.depth = divided.get(id(g), []), g.depth + 1


def _level(state: DataFrame, job: list[tuple[Growing, list[int]]], models: list[Grown], names: list[tuple[str, tuple[int, ...]]], replay: list[tuple[int, Tree]]) -> pa.Table:
    """(tree, node, column, split, rows and sums) for each node of the job, summed over all tasks."""
    bins = models[0].bins
    single, offsets, width = bins.one_against_rest(), bins.offsets, int(bins.offsets[-1])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            if not len(batch):
                continue
            ids, fold, y, codes, prediction = _batches(batch, bins, models, replay)
            flat = codes + offsets[:-1].astype(np.int32)
            for k, (g, nodes) in enumerate(job):
                growth = models[g.model].growth
                place_of = np.full(len(g.tree.column), -1)
                place_of[nodes] = np.arange(len(nodes))
                place = place_of[g.tree.leaves(codes, single)]
                weight = growth.weights(ids, g.number)
                keep = (place >= 0) & ~np.isin(fold, names[g.model][1])
                if weight is not None:
                    keep &= weight > 0
                found = histograms(flat[keep], place[keep], len(nodes), growth.gradient(y, prediction[:, g.model])[keep], None if weight is None else weight[keep], width)
                sums[k] = list(found) if k not in sums else [a + b for a, b in zip(sums[k], found, strict=True)]
        for k, (count, total) in sums.items():
            some = np.flatnonzero(count[:, : offsets[1]].sum(axis=1) > 0)
            lists = [pa.array(list(x[some]), pa.list_(pa.float64())) for x in (count, total)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, dtype=np.int32)), pa.array(some.astype(np.int32)), *lists], names=["tree", "node", "count", "total"])

    def choose(table: pa.Table) -> pa.Table:
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        count, total = (np.sum([np.array(x) for x in table.column(c).to_pylist()], axis=0)[None, :] for c in ("count", "total"))
        growth = models[job[tree][0].model].growth
        column, split, n, s, all_n, all_s = best_splits(count, total, bins, growth.least, growth.penalty, growth.columns(job[tree][0].number, len(bins.sizes)))
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()), "col": pa.array(column, pa.int32()), "split": pa.array(split, pa.int32()), **{c: pa.array(x, pa.float64()) for c, x in (("n", n), ("s", s), ("all_n", all_n), ("all_s", all_s))}})

    parts = state.mapInArrow(partial, "tree int, node int, count array<double>, total array<double>")
    return parts.groupBy("tree", "node").applyInArrow(choose, "tree int, node int, col int, split int, n double, s double, all_n double, all_s double").orderBy("tree", "node").toArrow()


def _set_medians(state: DataFrame, grown: list[Growing], models: list[Grown], names: list[tuple[str, tuple[int, ...]]], replay: list[tuple[int, Tree]]) -> None:
    """Leaf values of median members as exact medians by (tree, leaf), through bracketed order statistics."""
    bins = models[0].bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fold, y, codes, prediction = _batches(batch, bins, models, replay)
            for k, g in enumerate(grown):
                weight = models[g.model].growth.weights(ids, g.number)
                keep = ~np.isin(fold, names[g.model][1]) & (True if weight is None else weight > 0)
                leaf = g.tree.leaves(codes, bins.one_against_rest())
                yield pa.RecordBatch.from_arrays([pa.array(k * (1 << 32) + leaf[keep]), pa.array((y - prediction[:, g.model])[keep])], names=["leaf", "rest"])

    left = materialise(state.mapInArrow(run, "leaf bigint, rest double"))
    for row in exact_quantiles(left, "rest", {"mid": 0.5}, ["leaf"]).collect():  # one row for each leaf
        grown[row["leaf"] >> 32].tree.value[row["leaf"] & 0xFFFFFFFF] = row["mid"]


def scored(df: DataFrame, models: Sequence[tuple[str, Grown | Mapping[int, Grown]]], fold: str | None = None) -> DataFrame:
    """Adds one prediction column for each (name, model); a mapping holds a model for each value of the fold column.

    All members of a table share its bins, and a batch of rows is cut into bins once.
    """
    if not models:
        return df
    first = models[0][1]
    bins = first.bins if isinstance(first, Grown) else next(iter(first.values())).bins
    shared = df.sparkSession.sparkContext.broadcast([m for _, m in models])
    numbers, texts = bins.inputs()

    @F.arrow_udf("array<double>")
    def score(numbers: pa.Array, texts: pa.Array, folds: pa.Array) -> pa.Array:
        codes, fold_of = bins.codes(numbers, texts).astype(_code_type(bins)), folds.to_numpy()
        out = np.full((len(codes), len(models)), np.nan)
        for k, model in enumerate(shared.value):
            if isinstance(model, Grown):
                out[:, k] = model.raw(codes)
                continue
            for value, part in model.items():
                rows = fold_of == value
                out[rows, k] = part.raw(codes[rows])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * len(models), pa.int32()), pa.array(out.ravel()))

    folds = F.col(fold).cast("int") if fold else F.lit(-1)
    return df.withColumn("_scores", score(numbers, texts, folds)).withColumns({name: F.col("_scores")[k] for k, (name, _) in enumerate(models)}).drop("_scores")


def staged_errors(df: DataFrame, models: Mapping[str, Grown], target: str) -> DataFrame:
    """(model, iteration, mae): the error after every tree of each model, as one sum for each task, model and tree."""
    bins = next(iter(models.values())).bins
    shared = df.sparkSession.sparkContext.broadcast(dict(models))
    numbers, texts = bins.inputs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {name: np.zeros(len(m.trees)) for name, m in shared.value.items()}
        rows = 0
        for batch in batches:
            codes, y = bins.codes(batch.column(0), batch.column(1)).astype(_code_type(bins)), batch.column(2).to_numpy()
            rows += len(y)
            for name, model in shared.value.items():
                sums[name] += [np.abs(p - y).sum() for p in model.staged(codes)]
        for name, found in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(np.arange(1, len(found) + 1, dtype=np.int32)), pa.array(found), pa.array(np.full(len(found), rows))], names=["model", "iteration", "error", "rows"])

    ready = df.where(F.col(target).isNotNull()).select(numbers.alias("numbers"), texts.alias("texts"), F.col(target).cast("double").alias("y"))
    parts = ready.mapInArrow(run, "model string, iteration int, error double, rows bigint")
    return parts.groupBy("model", "iteration").agg((F.sum("error") / F.sum("rows")).alias("mae"))
