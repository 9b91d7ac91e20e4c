"""Quality rules: gradient-boosted trees over statistics of a document.

Trees are trained on the driver from a bounded labelled sample and flattened into five
numpy arrays (feature, threshold, left, right, value). Scoring walks all documents of a
batch through all trees at once, level by level, in Arrow batches.

Monotonic constraints: more symbols, repeated lines or repeated words never raise the score.
A split that would break one is not made, and the bounds found at a split hold below it.

Base rules come first: fewer than 50 words, or more than half of the words in repeated
three-word windows, fail whatever the trees say.

Defined results: null and empty texts have no words and fail; null ids and repeated rows
are judged row by row; an empty table gives an empty result; only ``doc_id`` and ``text``
are read by ``quality_report``, and ``keep_good`` keeps all other columns whatever their names.
Without labels of both values only the base rules decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellsieve.llm.base import STATISTICS, bounded_collect, in_arrow, labelled_sample, raw_texts, text_statistics

#: Statistics the trees see; 1 or -1: the score may only rise or fall with it.
FEATURES = {
    "symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "top_word_ratio": -1, "upper_ratio": 0,
    "digit_ratio": 0, "mark_ratio": 0, "mean_word_chars": 0, "distinct_ratio": 0, "log_words": 0,
}
COLUMNS = [STATISTICS.index(name) for name in FEATURES]
SIGNS = np.array(list(FEATURES.values()))

#: Rows of the training sample at most.
SAMPLE_ROWS = 4000
#: A document whose score is below this is rejected.
KEEP_SCORE = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Trees:
    """All trees in one set of node arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            low = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(low, self.left[node], self.right[node])
        return self.start + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw_score(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3,
              rate: float = 0.2, bins: int = 48, smooth: float = 1.0, min_rows: int = 8) -> Trees:
    """Second-order boosting of the logistic loss on binned features."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)
    rate_of_ones = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    start = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    total = np.full(n, start)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def new_node() -> int:
        at = len(value)
        feature.append(0)
        threshold.append(0.0)
        left.append(at)
        right.append(at)
        value.append(0.0)
        return at

    def leaf_weight(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + smooth), low, high))

    def best_split(rows, g, h, low, high):
        best = None
        g_all, h_all = g[rows].sum(), h[rows].sum()

        def loss(gs, hs, w):
            return gs * w + 0.5 * (hs + smooth) * w * w

        now = loss(g_all, h_all, leaf_weight(g_all, h_all, low, high))
        for f in range(width):
            size = len(cuts[f])
            if not size:
                continue
            b = binned[rows, f]
            gs = np.cumsum(np.bincount(b, g[rows], size + 1))[:-1]
            hs = np.cumsum(np.bincount(b, h[rows], size + 1))[:-1]
            ns = np.cumsum(np.bincount(b, minlength=size + 1))[:-1]
            wl = np.clip(-gs / (hs + smooth), low, high)
            wr = np.clip(-(g_all - gs) / (h_all - hs + smooth), low, high)
            gain = now - loss(gs, hs, wl) - loss(g_all - gs, h_all - hs, wr)
            allowed = (ns >= min_rows) & (len(rows) - ns >= min_rows)
            if signs[f]:
                allowed &= (wr - wl) * signs[f] >= 0
            gain = np.where(allowed, gain, -np.inf)
            at = int(np.argmax(gain))
            if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
                best = (float(gain[at]), f, at, float(wl[at]), float(wr[at]))
        return best

    def grow(at, rows, g, h, level, low, high):
        found = best_split(rows, g, h, low, high) if level < depth else None
        if found is None:
            value[at] = rate * leaf_weight(g[rows].sum(), h[rows].sum(), low, high)
            total[rows] += value[at]
            return
        _, f, cut, wl, wr = found
        feature[at], threshold[at] = f, float(cuts[f][cut])
        left[at], right[at] = new_node(), new_node()
        middle = (wl + wr) / 2
        down = binned[rows, f] <= cut
        bounds = ((low, high), (low, high))
        if signs[f] > 0:
            bounds = ((low, middle), (middle, high))
        elif signs[f] < 0:
            bounds = ((middle, high), (low, middle))
        grow(left[at], rows[down], g, h, level + 1, *bounds[0])
        grow(right[at], rows[~down], g, h, level + 1, *bounds[1])

    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-total))
        roots.append(new_node())
        grow(roots[-1], np.arange(n), p - y, p * (1 - p), 0, -np.inf, np.inf)
    return Trees(*[np.array(a) for a in (feature, threshold, left, right, value, roots)], depth, start)


def statistics_of(texts: list[bytes]) -> np.ndarray:
    found = [text_statistics(raw)[0] for raw in texts]
    return np.array(found, dtype=np.float64).reshape(len(texts), len(STATISTICS))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees | None:
    """Trees from at most ``rows`` labelled documents; None where the labels hold one value or none."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = statistics_of(raw_texts(batch.column("text")))[:, COLUMNS]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()),
             pa.array(list(found), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    sample = bounded_collect(
        in_arrow(labelled_sample(docs, labels, "quality", rows), work, "doc_id long, label int, x array<double>"), rows)
    y = np.array([r["label"] > 0 for r in sample], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return None
    return fit_trees(np.array([r["x"] for r in sample]), y, SIGNS)


def _judged(found: np.ndarray, trees: Trees | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, repeats = found[:, 0], found[:, 4]
    failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)
    score = trees.score(found[:, COLUMNS]) if trees is not None and len(found) else np.ones(len(found))
    return failed, score, ~failed & (score >= KEEP_SCORE)


def quality_report(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """``doc_id``, counts, ``base_failed``, ``kept`` and ``score`` of every document."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = statistics_of(raw_texts(batch.column("text")))
        failed, score, kept = _judged(found, trees)
        counts = [pa.array(found[:, i].astype(np.int64)) for i in range(5)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), *counts, pa.array(failed), pa.array(kept), pa.array(score)],
            ["doc_id", *STATISTICS[:5], "base_failed", "kept", "score"])

    return in_arrow(
        docs.select("doc_id", "text"), work,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """The documents that pass, with all their columns."""
    text_at = docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = statistics_of(raw_texts(batch.column(text_at)))
        return batch.filter(pa.array(_judged(found, trees)[2]))

    return in_arrow(docs, work, docs.schema, column="text")
