"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2))

All pairwise interactions cost time linear in the features of a document, by the identity of
squares above. Features are the distinct words of the whole text, hashed into ``BUCKETS`` and weighted by
log(1 + n) at unit length, and standardised statistics of the text with its length.
Label, lang, source and doc_id are never features.

Training: AdaGrad in numpy on the driver over a sample of at most ``SAMPLE_ROWS`` labelled
documents (held-out ids left out), as sparse rows. Scoring: Arrow batches, the model
(``BUCKETS`` x (``FACTORS`` + 1) numbers) travels with the task.

Defined results: null and empty texts have no words, zero statistics and a score like any other; null ids are
not held out; equal rows score alike; an empty table gives an empty result; only ``doc_id`` and ``text`` are
read. Without labels of both values every score is the share of ones, or 0.5 without any.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsieve.llm.base import STATISTICS, bounded_collect, held_out, in_arrow, labelled_sample, raw_texts, text_statistics

BUCKETS = 1 << 13
FACTORS = 8
SAMPLE_ROWS = 4000
THRESHOLD = 0.7
REMEMBERED = 200_000
#: Counts grow without bound and enter by their logarithm.
COUNTS = np.array([name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") for name in STATISTICS])


class Features:
    """Sparse features of texts: hashed words, then the statistics."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        numbers, words, ids = text_statistics(raw)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        buckets = np.fromiter(
            (known[w] if w in known else known.setdefault(w, zlib.crc32(w) % BUCKETS) for w in words), np.int64, len(words))
        weights = np.bincount(buckets, np.bincount(ids, minlength=len(words)), BUCKETS) if len(words) else np.zeros(0)
        index = np.flatnonzero(weights)
        values = np.log1p(weights[index])
        norm = np.sqrt((values * values).sum())
        numbers = np.array(numbers)
        numbers[COUNTS] = np.log1p(numbers[COUNTS])
        return index, values / norm if norm else values, numbers


@dataclass(frozen=True)
class Machine:
    bias: float
    weight: np.ndarray  # of buckets, then statistics
    factor: np.ndarray  # one row per feature
    mean: np.ndarray
    scale: np.ndarray

    def numbers(self, x: np.ndarray) -> np.ndarray:
        """Standardised statistics, bounded so that no odd text dominates."""
        return np.clip((x - self.mean) / self.scale, -4, 4) / np.sqrt(len(self.mean))

    def score(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        index, values, at = stacked([(i, v, self.numbers(x)) for i, v, x in rows])
        linear = np.add.reduceat(self.weight[index] * values, at)
        product = self.factor[index] * values[:, None]
        total, squares = np.add.reduceat(product, at), np.add.reduceat(product * product, at)
        raw = self.bias + linear + 0.5 * (total * total - squares).sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(raw, -40, 40)))


def stacked(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all rows after each other, and where each row starts. No row is empty: all have statistics."""
    places = BUCKETS + np.arange(len(STATISTICS))
    index = np.concatenate([np.concatenate([i, places]) for i, _, _ in rows])
    values = np.concatenate([np.concatenate([v, x]) for _, v, x in rows])
    lengths = np.array([len(i) + len(places) for i, _, _ in rows])
    return index, values, np.concatenate([[0], np.cumsum(lengths)[:-1]])


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, batch: int = 64,
                rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
    rng = np.random.default_rng(seed)
    numbers = np.array([x for _, _, x in rows]).reshape(len(rows), len(STATISTICS))
    mean, scale = numbers.mean(axis=0), numbers.std(axis=0) + 1e-6
    width = BUCKETS + len(STATISTICS)
    ones = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    bias, weight = float(np.log(ones / (1 - ones))), np.zeros(width)
    factor = rng.normal(0, 0.05, (width, FACTORS))
    machine = Machine(bias, weight, factor, mean, scale)
    ready = [(i, v, machine.numbers(x)) for i, v, x in rows]
    seen_w, seen_v, seen_b = np.full(width, 1e-6), np.full((width, FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), batch):
            chosen = order[start:start + batch]
            index, values, at = stacked([ready[i] for i in chosen])
            of = np.repeat(np.arange(len(chosen)), np.diff(np.append(at, len(index))))
            product = factor[index] * values[:, None]
            total = np.add.reduceat(product, at)
            raw = bias + np.add.reduceat(weight[index] * values, at) + 0.5 * (
                total * total - np.add.reduceat(product * product, at)).sum(axis=1)
            miss = (1.0 / (1.0 + np.exp(-np.clip(raw, -40, 40))) - y[chosen]) / len(chosen)
            touched, place = np.unique(index, return_inverse=True)
            step = (miss[of] * values)[:, None]
            grad_v = np.zeros((len(touched), FACTORS))
            np.add.at(grad_v, place, step * (total[of] - product))
            grad_w = np.bincount(place, step[:, 0], len(touched)) + decay * weight[touched]
            grad_v += decay * factor[touched]
            grad_b = float(miss.sum())
            seen_w[touched] += grad_w * grad_w
            seen_v[touched] += grad_v * grad_v
            seen_b += grad_b * grad_b
            weight[touched] -= rate * grad_w / np.sqrt(seen_w[touched])
            factor[touched] -= rate * grad_v / np.sqrt(seen_v[touched])
            bias -= rate * grad_b / np.sqrt(seen_b)
    return Machine(bias, weight, factor, mean, scale)


def constant(share: float) -> Machine:
    """Without anything to learn from: the same score for every text."""
    width = BUCKETS + len(STATISTICS)
    odds = min(max(share, 1e-3), 1 - 1e-3)
    return Machine(float(np.log(odds / (1 - odds))), np.zeros(width), np.zeros((width, FACTORS)),
                   np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Machine:
    """A machine from at most ``rows`` labelled documents outside the held-out part."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        features = Features()
        found = [features(raw) for raw in raw_texts(batch.column("text"))]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()),
             *[pa.array([f[i] for f in found], pa.list_(t)) for i, t in enumerate((pa.int64(), pa.float64(), pa.float64()))]],
            ["doc_id", "label", "words", "weights", "numbers"])

    schema = "doc_id long, label int, words array<long>, weights array<double>, numbers array<double>"
    sample = bounded_collect(in_arrow(labelled_sample(docs, labels, "quality", rows), work, schema), rows)
    y = np.array([r["label"] > 0 for r in sample], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    ready = [(np.array(r["words"], np.int64), np.array(r["weights"]), np.array(r["numbers"])) for r in sample]
    return fit_machine(ready, y)


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""

    features = Features()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = machine.score([features(raw) for raw in raw_texts(batch.column("text"))])
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores)], ["doc_id", "score"])

    scored = in_arrow(docs.select("doc_id", "text"), work, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
