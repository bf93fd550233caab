"""Linear models from sums of products: one pass over the rows, then grids and paths on a small matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.listing import total


@dataclass
class Moments:
    """Sums of products of columns and target, per fold."""

    columns: list[str]
    per_fold: dict[int, np.ndarray]

    def total(self, without: int | None = None) -> np.ndarray:
        return sum(m for f, m in self.per_fold.items() if f != without)

    def subset(self, columns: Sequence[str]) -> "Moments":
        index = [0, *[1 + self.columns.index(c) for c in columns], len(self.columns) + 1]
        return Moments(list(columns), {f: m[np.ix_(index, index)] for f, m in self.per_fold.items()})


def moments(df: DataFrame, columns: Sequence[str], target: str = "actual", fold: str = "fold") -> Moments:
    """Products of (1, columns, target) summed per fold: tasks add up products of whole batches, so a table of many columns does not
    take an aggregate of one sum for each pair. A product with a null counts as none; a pair without any is NaN."""
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in columns], F.col(target).cast("double")]
    size, kind = len(terms), df.schema[fold].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[object, list[np.ndarray]] = {}
        for batch in batches:
            if not len(batch):
                continue
            values, place = batch.column(1).flatten(), batch.column(0).dictionary_encode()
            z = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            known = values.is_valid().to_numpy(zero_copy_only=False).reshape(-1, size)
            at = place.indices.fill_null(-1).to_numpy()
            for g in np.unique(at).tolist():
                part, here = z[at == g], known[at == g]
                held = sums.setdefault(place.dictionary[g].as_py() if g >= 0 else None, [np.zeros((size, size)), np.zeros((size, size))])
                held[1] += here.T.astype(np.float64) @ here
                for i in range(size):
                    with np.errstate(invalid="ignore"):
                        product = part[:, i : i + 1] * part
                    if not here.all():
                        product[~(here[:, i : i + 1] & here)] = 0.0
                    held[0][i] = np.add.reduce(np.concatenate([held[0][i : i + 1], product]))  # row after row, as SQL adds
        for key, (total, count) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], batch.schema.field(0).type), *[pa.array([x.ravel()], pa.list_(pa.float64())) for x in (total, count)]], names=["fold", "total", "count"])

    def added(table: pa.Table) -> pa.Table:
        sums = [np.sum([np.array(x) for x in table.column(c).to_pylist()], axis=0) for c in ("total", "count")]
        return pa.table({"fold": table.column("fold").slice(0, 1), **{c: pa.array([x], pa.list_(pa.float64())) for c, x in zip(("total", "count"), sums, strict=True)}})

    schema = f"fold {kind}, total array<double>, count array<double>"
    parts = df.select(F.col(fold).alias("fold"), F.array(*terms).alias("z")).mapInArrow(run, schema)
    out = {}
    for row in parts.groupBy("fold").applyInArrow(added, schema).collect():  # one row for each fold
        total, count = (np.array(row[c]).reshape(size, size) for c in ("total", "count"))
        out[row["fold"]] = np.where(count > 0, total, np.nan)
    return Moments(list(columns), out)


def _centred(matrix: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray]:
    n, means = matrix[0, 0], matrix[0, 1:-1] / matrix[0, 0]
    y_mean = matrix[0, -1] / n
    gram = matrix[1:-1, 1:-1] - n * np.outer(means, means)
    cross = matrix[1:-1, -1] - n * means * y_mean
    return n, means, y_mean, gram, cross


@dataclass
class Combiner:
    columns: list[str]
    intercept: float
    weights: np.ndarray
    alpha: float | None = None
    l1_share: float | None = None

    def column(self) -> Column:
        return F.lit(float(self.intercept)) + total([F.lit(float(w)) * F.col(c) for w, c in zip(self.weights, self.columns)])

    def squared_error(self, matrix: np.ndarray) -> float:
        v = np.concatenate([[self.intercept], self.weights, [-1.0]])
        return float(v @ matrix @ v)


def ridge(data: Moments, alpha: float = 1.0, without: int | None = None) -> Combiner:
    n, means, y_mean, gram, cross = _centred(data.total(without))
    weights = np.linalg.solve(gram + alpha * np.eye(len(means)), cross)
    return Combiner(data.columns, y_mean - float(means @ weights), weights, alpha, 0.0)


def _descend(gram: np.ndarray, cross: np.ndarray, alpha: float, l1_share: float, weights: np.ndarray, rounds: int, enough: float) -> np.ndarray:
    """Coordinate descent from given weights; products with the weights are kept up to date, and a round leaves out weights
    that are 0 and stay so."""
    weights, fitted, scale = weights.copy(), gram @ weights, np.diag(gram)
    for _ in range(rounds):
        moved = 0.0
        for k in np.flatnonzero((scale > 0) & ((weights != 0) | (np.abs(cross - fitted) > alpha * l1_share))).tolist():
            rest = cross[k] - fitted[k] + scale[k] * weights[k]
            shrunk = math.copysign(max(abs(rest) - alpha * l1_share, 0.0), rest) / (scale[k] + alpha * (1.0 - l1_share))
            step = shrunk - weights[k]
            if step:
                weights[k] = shrunk
                fitted += gram[k] * step
                moved = max(moved, abs(step))
        if moved < enough:
            break
    return weights


def elastic_net(data: Moments, alpha: float, l1_share: float = 1.0, without: int | None = None, rounds: int = 2000) -> Combiner:
    """Coordinate descent on the small product matrix; l1_share 1 is the lasso."""
    n, means, y_mean, gram, cross = _centred(data.total(without))
    weights = _descend(gram / n, cross / n, alpha, l1_share, np.zeros(len(means)), rounds, 1e-10)
    return Combiner(data.columns, y_mean - float(means @ weights), weights, alpha, l1_share)


def lasso_strengths(data: Moments, steps: int, decades: float = 3.0) -> list[float]:
    """A falling path that starts where all weights are zero."""
    n, _, _, _, cross = _centred(data.total())
    top = float(np.abs(cross).max(initial=0.0) / n)
    return [top * 10 ** (-decades * i / max(steps - 1, 1)) for i in range(steps)]


def lasso_path(data: Moments, strengths: Sequence[float], without: int | None = None) -> Iterator[Combiner]:
    """The lasso at falling strengths, each started from the one before."""
    n, means, y_mean, gram, cross = _centred(data.total(without))
    weights = np.zeros(len(means))
    enough = 1e-5 * math.sqrt(max(data.total(without)[-1, -1] / n - y_mean**2, 0.0))
    for alpha in strengths:
        weights = _descend(gram / n, cross / n, alpha, 1.0, weights, 200, enough)
        yield Combiner(data.columns, y_mean - float(means @ weights), weights, alpha, 1.0)


def _block_products(rows: DataFrame, group: str) -> DataFrame:
    """(group, fold, i, products): rows of the matrix of products of (1, x, y), summed over all rows of a group and fold.
    Tasks add up blocks of rows; the sums of rows of the matrices are partial aggregates. rows: (group, fold, x, y)."""
    kind = rows.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        known = None
        for batch in batches:
            if not len(batch):
                continue
            known = batch.schema.field(0).type
            x = batch.column(2).flatten().to_numpy().reshape(len(batch), -1)
            z = np.column_stack([np.ones(len(x)), x, batch.column(3).to_numpy()])
            names, place = np.unique(batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(), return_inverse=True)
            dictionary, folds = batch.column(0).dictionary_encode().dictionary, batch.column(1).to_numpy()
            for g, name in enumerate(names.tolist()):
                key = dictionary[name].as_py() if name >= 0 else None
                for k in np.unique(folds[place == g]).tolist():
                    part = z[(place == g) & (folds == k)]
                    sums[key, k] = sums.get((key, k), 0.0) + part.T @ part
        for (key, k), m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(m), known), pa.array(np.full(len(m), k, dtype=np.int32)), pa.array(np.arange(len(m), dtype=np.int32)), pa.array(list(m), pa.list_(pa.float64()))], names=[group, "fold", "i", "products"])

    products = rows.select(group, F.col("fold").cast("int").alias("fold"), "x", "y").mapInArrow(run, f"{group} {kind}, fold int, i int, products array<double>")
    return products.groupBy(group, "fold", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("products"))).alias("products"))


def vector_moments(df: DataFrame, target: str, fold: Column, features: str = "features") -> Moments:
    """Products of (1, features, target) per fold for a vector column. The target is taken from its mean, and features that
    are standardised keep the sums small."""
    middle = df.agg(F.avg(target)).first()[0] or 0.0
    rows = df.select(F.lit(0).alias("g"), fold.alias("fold"), vector_to_array(features).alias("x"), (F.col(target).cast("double") - F.lit(middle)).alias("y"))
    out: dict[int, dict[int, np.ndarray]] = {}
    for row in _block_products(rows, "g").collect():  # features + 2 rows for each fold
        out.setdefault(row["fold"], {})[row["i"]] = np.array(row["products"])
    matrices = {k: np.array([m[i] for i in range(len(m))]) for k, m in out.items()}
    width = len(next(iter(matrices.values()))) - 2 if matrices else 0
    return Moments([str(i) for i in range(width)], matrices)


def assembled_moments(df: DataFrame, model: PipelineModel, target: str, middle: float, fold: Column) -> Moments:
    """Products of (1, features, target - middle) per fold for the vectors that fitted preprocessing would assemble. Rows
    travel as numbers and category texts: a product with a category's slot is a sum over its rows, so no vector is built."""
    scaler, indexer = model.stages[1], model.stages[2] if len(model.stages) > 3 else None
    numeric, categorical = model.stages[0].getInputCols(), indexer.getInputCols() if indexer else []
    labels = [list(x) for x in indexer.labelsArray] if indexer else []
    sizes = list(model.stages[3].categorySizes) if indexer else []
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    scale = np.divide(1.0, std, out=np.zeros_like(std), where=std != 0)
    k = len(numeric)
    starts = np.concatenate([[1 + k], 1 + k + np.cumsum(sizes)]).astype(int)
    width = int(starts[-1]) + 1
    plain = [*range(1 + k), width - 1]
    numbers = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in numeric]).cast("array<double>")
    texts = F.array(*[F.col(c).cast("string") for c in categorical]).cast("array<string>")
    rows = df.select(fold.cast("int").alias("fold"), numbers.alias("x"), texts.alias("texts"), (F.col(target).cast("double") - F.lit(middle)).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        known = [pa.array(x, pa.string()) for x in labels]
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            folds = batch.column(0).to_numpy()
            z = np.empty((n, k + 2))
            z[:, 0], z[:, -1] = 1.0, batch.column(3).to_numpy(zero_copy_only=False)
            if k:
                z[:, 1:-1] = (batch.column(1).flatten().to_numpy().reshape(n, k) - mean) * scale
            flat = batch.column(2).flatten()
            slots = []
            for c, values in enumerate(known):
                place = pc.index_in(flat.take(pa.array(np.arange(n) * len(known) + c)), value_set=values, skip_nulls=True)
                slots.append(pc.fill_null(place, len(values)).to_numpy().astype(np.int64))
            for value in np.unique(folds).tolist():
                at = folds == value
                m = sums.setdefault(value, np.zeros((width, width)))
                part, here = z[at], [x[at] for x in slots]
                m[np.ix_(plain, plain)] += part.T @ part
                for c, x in enumerate(here):
                    rows_of = slice(starts[c], starts[c + 1])
                    m[rows_of, plain] += np.stack([np.bincount(x, part[:, j], minlength=sizes[c])[: sizes[c]] for j in range(k + 2)], axis=1)
                    for d in range(c + 1):
                        both = np.bincount(x * (sizes[d] + 1) + here[d], minlength=(sizes[c] + 1) * (sizes[d] + 1)).reshape(sizes[c] + 1, sizes[d] + 1)
                        m[rows_of, starts[d] : starts[d + 1]] += both[: sizes[c], : sizes[d]]
        for value, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width, value, dtype=np.int32)), pa.array(np.arange(width, dtype=np.int32)), pa.array(list(m), pa.list_(pa.float64()))], names=["fold", "i", "products"])

    products = rows.mapInArrow(run, "fold int, i int, products array<double>")
    found: dict[int, dict[int, np.ndarray]] = {}
    for row in products.groupBy("fold", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("products"))).alias("products")).collect():  # features + 2 rows for each fold
        found.setdefault(row["fold"], {})[row["i"]] = np.array(row["products"])
    matrices = {}
    for value, by_row in sorted(found.items()):
        m = np.array([by_row[i] for i in range(width)])
        lower = np.zeros((width, width), dtype=bool)  # what was summed: products of plain columns, and slots with them and earlier slots
        lower[np.ix_(plain, plain)] = True
        for c in range(len(sizes)):
            lower[starts[c] : starts[c + 1], plain] = True
            lower[starts[c] : starts[c + 1], starts[0] : starts[c + 1]] = True
        matrices[value] = np.where(lower, m, m.T)
    return Moments([str(i) for i in range(width - 2)], matrices)


def best_ridge(data: Moments, alphas: Sequence[float]) -> Combiner:
    """The strength with the least squared error over held-out folds, solved on all of them."""
    if len(alphas) == 1 or len(data.per_fold) == 1:
        return ridge(data, alphas[0])
    error = {a: sum(ridge(data, a, fold).squared_error(held) for fold, held in data.per_fold.items()) for a in alphas}
    return ridge(data, min(alphas, key=error.get))


def grouped_ridges(df: DataFrame, group: str, fold: Column, target: str, alphas: Sequence[float], features: str = "features") -> DataFrame:
    """(group, alpha, intercept, weights): a ridge for each group, all from one pass. A group's matrices are summed in the
    shuffle and solved where they meet; neither rows nor matrices come to the driver, so any number of groups will do."""
    middle = df.agg(F.avg(target)).first()[0] or 0.0
    rows = df.select(group, fold.alias("fold"), vector_to_array(features).alias("x"), (F.col(target).cast("double") - F.lit(middle)).alias("y"))

    def solve(table: pa.Table) -> pa.Table:
        per_fold: dict[int, dict[int, list[float]]] = {}
        for row in table.select(["fold", "i", "products"]).to_pylist():
            per_fold.setdefault(row["fold"], {})[row["i"]] = row["products"]
        matrices = {k: np.array([m[i] for i in range(len(m))]) for k, m in sorted(per_fold.items())}
        found = best_ridge(Moments([str(i) for i in range(len(next(iter(matrices.values()))) - 2)], matrices), alphas)
        return pa.table({group: table.column(group).slice(0, 1), "alpha": [float(found.alpha)], "intercept": [float(found.intercept + middle)], "weights": pa.array([found.weights], pa.list_(pa.float64()))})

    kind = df.schema[group].dataType.simpleString()
    return _block_products(rows, group).groupBy(group).applyInArrow(solve, f"{group} {kind}, alpha double, intercept double, weights array<double>")
