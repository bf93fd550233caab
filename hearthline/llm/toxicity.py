"""Toxicity by two Kneser-Ney models of words as letter sequences, one for toxic and one for ordinary texts.

A word is read letter by letter between two marks. Each class has counts of letter n-grams; the probability of a letter is
discounted and interpolated down to a base that both classes share: how many different letters a shorter context has been
seen with, over both classes. So an expression that is rare or new in one class falls back to counts that do not favour a
class, and only what the classes really differ in moves the score. A text's evidence is the sum over its words of
log P(word | toxic) - log P(word | ordinary), normalised by length; a logistic curve with three coefficients, fitted on
training rows that the counts have not seen, maps it to 0..1.

The models are fitted on a bounded sample of labelled rows (`most` rows of each label, those of smallest hash), so their
size is bounded and they are sent to all tasks. Scoring covers all rows in one pass without a shuffle.

Defined results: null and empty texts have evidence 0 and the score of the curve there; labels that are null or other than
0 and 1, and label rows without a document, are not used; repeated rows count each; without both labels in the training
rows every score is the share of label 1 (0 without rows).
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import columns_only, materialise, release, text_bytes

ORDER = 5
DISCOUNT = 0.75
#: Evidence of a word that is taken for noise.
NOISE = 1.5
#: Sampled training rows of each label, and bytes of text read from one of them.
SAMPLE = 6_000
#: Share of the sampled rows that fit the curve and not the counts.
CURVE = 0.25
#: Longest word read as letters; a longer run of letters is scored in pieces.
WORD = 48
REMEMBERED = 200_000

_TO_BLANK = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
START, END = "\x02", "\x03"


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return raw.decode().lower().encode().translate(_TO_BLANK).split()


@dataclass
class ClassModels:
    """Both models in one table, as a backoff automaton over letters: for an n-gram the log ratio of its last letter's
    probabilities, for a context the log ratio of the shares that its classes leave to the shorter context."""

    order: int
    ratio: dict[str, float]
    backoff: dict[str, float]

    def evidence(self, word: str) -> float:
        """log P(word | toxic) - log P(word | ordinary)."""
        text, out, ratio, backoff, reach = START + word + END, 0.0, self.ratio.get, self.backoff.get, self.order - 1
        for i in range(2, len(text)):
            for k in range(i - reach if i > reach else 0, i - 1):
                found = ratio(text[k : i + 1])
                if found is not None:
                    out += found
                    break
                out += backoff(text[k:i], 0.0)
        return out


def fit_models(words: dict[str, tuple[int, int]], order: int = ORDER) -> ClassModels:
    """From word -> (rows of label 1, rows of label 0).

    Letters after one letter have a probability that the classes share, from the number of different letters an n-gram has
    been seen after; longer contexts are counted by class, discounted, and interpolated down to it. n-grams seen once are
    kept out of the table: the automaton then reads the shorter context.
    """
    grams: dict[str, complex] = defaultdict(complex)
    for word, counts in words.items():
        text, both = START + word + END, complex(*counts)
        for i in range(1, len(text)):
            for k in range(max(0, i - order + 1), i):
                grams[text[k : i + 1]] += both
    sums: dict[str, complex] = defaultdict(complex)
    types: dict[str, complex] = defaultdict(complex)
    after: Counter = Counter()
    for gram, n in grams.items():
        sums[gram[:-1]] += n
        types[gram[:-1]] += complex(n.real > 0, n.imag > 0)
        if len(gram) == 3:
            after[gram[1:]] += 1
    pairs, kinds, letters = Counter(), Counter(), Counter()
    for pair, n in after.items():
        pairs[pair[0]] += n
        kinds[pair[0]] += 1
        letters[pair[1]] += 1
    total = max(1, sum(letters.values()))

    def shared(pair: str) -> float:
        low = max(letters[pair[1]], 0.5) / total
        n = pairs[pair[0]]
        return max(after[pair] - DISCOUNT, 0) / n + DISCOUNT * kinds[pair[0]] / n * low if n else low

    d, known, ratio = DISCOUNT, {}, {}
    for gram in sorted(grams, key=len):
        if len(gram) == 2:
            p = shared(gram)
            known[gram] = (p, p)
            continue
        n, s, t, (toxic, plain) = grams[gram], sums[gram[:-1]], types[gram[:-1]], known[gram[1:]]
        if s.real:
            toxic = (max(n.real - d, 0) + d * t.real * toxic) / s.real
        if s.imag:
            plain = (max(n.imag - d, 0) + d * t.imag * plain) / s.imag
        known[gram] = (toxic, plain)
        if len(gram) == 3 or n.real + n.imag > 1:
            ratio[gram] = math.log(toxic) - math.log(plain)
    left = lambda s, t: d * t / s if s else 1.0
    backoff = {c: math.log(left(s.real, types[c].real)) - math.log(left(s.imag, types[c].imag)) for c, s in sums.items() if len(c) > 1}
    return ClassModels(order, ratio, backoff)


class Evidence(dict):
    """Evidence of each word, kept for short words up to a bound."""

    def __init__(self, models: ClassModels) -> None:
        super().__init__()
        self.models = models

    def __missing__(self, word: bytes) -> float:
        text = word.decode("utf-8", "replace")
        value = sum(self.models.evidence(text[k : k + WORD]) for k in range(0, len(text), WORD))
        if len(word) <= WORD:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


def text_features(raw: bytes, get: Evidence) -> tuple[float, float, int]:
    """(evidence, its positive part above a word's noise, words) of a text."""
    found = words_of(raw)
    values = [get[w] for w in found]
    return sum(values), sum(v - NOISE for v in values if v > NOISE), len(values)


def curve_inputs(evidence: np.ndarray, strong: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Length-normalised evidence: by the number of words and by its square root, both bounded, and an intercept."""
    n = np.maximum(n, 1)
    return np.column_stack([np.ones(len(n)), np.clip(10 * evidence / n, -8, 8), np.clip(10 * strong / n, 0, 8), np.clip(strong / np.sqrt(n), 0, 8)])


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic coefficients by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    keep = ridge * len(y) * np.eye(len(w)) / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample_rows(docs: DataFrame, labels: DataFrame, train: Column, most: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, toxic, curve), and the sizes of the labels. The rows are those of the labelled training rows, at most about `most` of each label: the share that gives
    `most` rows is taken by hash. The sampled labels are few, so the documents are not shuffled."""
    known = columns_only(labels, "doc_id", "toxic").where("toxic in (0, 1) and doc_id is not null").dropDuplicates(["doc_id"]).where(train)
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    within = [(F.col("toxic") == k) & (place < F.lit(min(1.0, most / n))) for k, n in sizes.items()]
    chosen = known.where(within[0] | within[-1]) if within else known.limit(0)
    part = (F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(1000)) < int(CURVE * 1000)).alias("curve")
    chosen = chosen.select(F.col("doc_id").alias("id"), "toxic", part)  # bounded by 2 * most rows
    docs = columns_only(docs, "doc_id", "text")
    return docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["id"]).select("doc_id", "text", "toxic", "curve"), sizes


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, ordinary): in how many rows of each label a word stands, copies within a row counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, toxic in enumerate(batch.column(1).to_pylist()):
                counts[toxic].update({w[: 4 * WORD] for w in words_of(data[offsets[i] : offsets[i + 1]].tobytes())})
        names = list(counts[0].keys() | counts[1].keys())
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in part], pa.string()), pa.array([counts[1][w] for w in part], pa.int64()), pa.array([counts[0][w] for w in part], pa.int64())], names=["word", "toxic", "ordinary"])

    return rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "word string, toxic long, ordinary long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


@dataclass
class Scorer:
    """Both models and the curve; small, and sent to all tasks."""

    models: ClassModels
    curve: np.ndarray

    def scores(self, column: pa.Array, get: Evidence) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(curve_inputs(*features(column, get)) @ self.curve, -700, 700)))


def features(column: pa.Array, get: Evidence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Evidence, its strong part and the number of words of each text."""
    data, offsets = text_bytes(column)
    rows = np.array([text_features(data[offsets[i] : offsets[i + 1]].tobytes(), get) for i in range(len(column))], dtype=float).reshape(-1, 3)
    return rows[:, 0], rows[:, 1], rows[:, 2]


def curve_rows(rows: DataFrame, shared) -> DataFrame:
    """(evidence, strong, words, toxic) of sampled rows; `shared` is a broadcast of the models."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        get = Evidence(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*map(pa.array, features(batch.column(0), get)), batch.column(1)], names=["evidence", "strong", "words", "toxic"])

    return rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "evidence double, strong double, words double, toxic int")


def fit_scorer(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, train: Column | None = None) -> Scorer:
    """Learns from at most about `most` labelled rows of each label for which `train` holds."""
    rows, sizes = sample_rows(docs, labels, F.lit(True) if train is None else train, most)
    rows = materialise(rows)
    models = fit_models({r["word"]: (r["toxic"], r["ordinary"]) for r in word_counts(rows.where("not curve")).toLocalIterator()})
    shared = docs.sparkSession.sparkContext.broadcast(models)
    fit = curve_rows(rows.where("curve"), shared).toPandas()
    y = fit["toxic"].to_numpy(dtype=float)
    if 0 < y.sum() < len(y):
        curve = fit_curve(curve_inputs(*(fit[c].to_numpy(dtype=float) for c in ("evidence", "strong", "words"))), y)
        curve[0] += math.log(sizes[1] / sizes[0]) - math.log(y.sum() / (len(y) - y.sum()))  # from the sample's shares of the labels to those of all training rows
    else:
        share = float(np.clip(sizes.get(1, 0) / max(1, sum(sizes.values())), 1e-6, 1 - 1e-6))
        curve = np.array([math.log(share / (1 - share)), 0.0, 0.0, 0.0])
    return Scorer(models, curve)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row, learned from rows that are not held out."""
    scorer = docs.sparkSession.sparkContext.broadcast(fit_scorer(docs, labels, most, ~held_out(F.col("doc_id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        get = Evidence(scorer.value.models)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.value.scores(batch.column(1), get))], names=["doc_id", "score"])

    key = docs.schema["doc_id"].dataType.simpleString()
    scored = columns_only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {key}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def ordinary_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that score below the threshold, with all their columns. Rows are judged where they stand."""
    scorer = docs.sparkSession.sparkContext.broadcast(fit_scorer(docs, labels, most))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        get = Evidence(scorer.value.models)
        for batch in batches:
            yield batch.filter(pa.array(scorer.value.scores(batch.column(place), get) < threshold))

    return docs.mapInArrow(run, docs.schema)
