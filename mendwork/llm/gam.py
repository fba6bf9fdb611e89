"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is binned; cyclic boosting visits the features in turn and adds a
shallow tree over that feature's bins, times a small rate, to its lookup table
(Lou et al. 2013). The pairs of features whose two-way tables would explain
most of what is left then get tables of their own, boosted the same way with
one cut on either axis. A score is a sum of table entries.

Scale: the model is fitted on at most ``max_rows`` labelled rows, chosen by a
hash of the id (the documented bound), so labels reach the tasks as a bounded
broadcast and features of the sample reach the driver. Scoring adds table
entries where the texts are, without a shuffle.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts, filter_batches, with_columns
from .textstats import NAMES, text_stats

MAX_ROWS = 20_000
FEATURES = (
    "log_words", "word_length", "symbols_per_word", "dup_lines", "repeat_words", "words_per_line", "upper_share", "digit_share",
    "stops_per_word", "commas_per_word", "marks_per_word", "distinct_words", "doubled_words", "longest_word", "caps_words", "high_bytes", "bare_words",
)


def features(stats: np.ndarray) -> np.ndarray:
    """Rows of FEATURES from rows of textstats.NAMES; wordless texts give zeros."""
    s = {n: stats[:, i].astype(float) for i, n in enumerate(NAMES)}
    words, size, lines = (np.maximum(s[n], 1.0) for n in ("n_words", "n_bytes", "n_lines"))
    return np.column_stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_words"] / lines,
        s["n_upper"] / size, s["n_digits"] / size, s["n_stops"] / words, s["n_commas"] / words, s["n_marks"] / words, s["n_distinct"] / words ** 0.8,
        s["n_double"] / words, np.log1p(s["longest_word"]), s["n_caps_words"] / words, s["n_high_bytes"] / size, s["n_bare_words"] / words,
    ])


def text_features(column: pa.Array) -> np.ndarray:
    return features(np.array([text_stats(b) for b in byte_texts(column)], dtype=np.int64).reshape(-1, len(NAMES)))


def _cuts(weight: np.ndarray, grad: np.ndarray, leaves: int) -> np.ndarray:
    """Fitted value of each bin by a tree over ordered bins with ``leaves`` leaves."""
    segments = [(0, len(weight))]
    w, g = np.concatenate([[0.0], np.cumsum(weight)]), np.concatenate([[0.0], np.cumsum(grad)])
    fit = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1.0)
    while len(segments) < leaves:
        best = (1e-9, 0, 0)
        for k, (a, b) in enumerate(segments):
            if b - a > 1:
                mid = np.arange(a + 1, b)
                gain = fit(a, mid) + fit(mid, b) - fit(a, b)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), k, a + 1 + at)
        if not best[2]:
            break
        a, b = segments[best[1]]
        segments[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(weight))
    for a, b in segments:
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1.0)
    return out


def _quadrants(weight: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, float]:
    """Two-way table with one cut on either axis, and how much it explains."""
    w, g = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (weight, grad))
    total_w, total_g = w[-1, -1], g[-1, -1]
    parts = []
    for x in (w, g):
        a = x[1:-1, 1:-1]
        left, top = x[1:-1, -1:], x[-1:, 1:-1]
        parts.append((a, left - a, top - a, x[-1, -1] - left - top + a))
    gain = sum(gg**2 / (ww + 1.0) for ww, gg in zip(*parts)) - total_g**2 / (total_w + 1.0)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = [gg[i, j] / (ww[i, j] + 1.0) for ww, gg in zip(*parts)]
    out = np.empty(weight.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return out, float(gain[i, j])


class Gam:
    """Lookup tables over binned features; ``score`` gives the probability of label 1."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, rounds: int = 120, pairs: int = 8, pair_rounds: int = 60, rate: float = 0.2, leaves: int = 4) -> None:
        self.bins, self.pair_bins, self.rounds, self.n_pairs, self.pair_rounds, self.rate, self.leaves = bins, pair_bins, rounds, pairs, pair_rounds, rate, leaves
        self.bias, self.edges, self.coarse, self.tables, self.pairs = 0.0, [], [], [], []

    @staticmethod
    def _edges(x: np.ndarray, bins: int) -> np.ndarray:
        values = np.unique(x)
        if len(values) > bins:
            values = np.unique(np.quantile(x, np.arange(1, bins) / bins, method="lower"))
        else:
            values = (values[1:] + values[:-1]) / 2
        return values

    def _binned(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return [np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)], [np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.coarse)]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        """One class only, or no rows: the smoothed share of label 1 for all."""
        n, width = x.shape
        share = (y.sum() + 0.5) / (n + 1.0)
        self.bias = float(np.log(share / (1 - share)))
        self.edges = [self._edges(x[:, i], self.bins) if n else np.zeros(0) for i in range(width)]
        self.coarse = [self._edges(x[:, i], self.pair_bins) if n else np.zeros(0) for i in range(width)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs = []
        if not n or y.min() == y.max():
            return self
        fine, coarse = self._binned(x)
        logit = np.full(n, self.bias)
        for _ in range(self.rounds):
            for i, at in enumerate(fine):
                p = 1 / (1 + np.exp(-logit))
                m = len(self.tables[i])
                step = self.rate * _cuts(np.bincount(at, p * (1 - p), m), np.bincount(at, y - p, m), self.leaves)
                self.tables[i] += step
                logit += step[at]
        gains, p = [], 1 / (1 + np.exp(-logit))
        cells = {}
        for i, j in combinations(range(width), 2):
            a, b = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
            if a > 1 and b > 1:
                at = coarse[i] * b + coarse[j]
                _, gain = _quadrants(np.bincount(at, p * (1 - p), a * b).reshape(a, b), np.bincount(at, y - p, a * b).reshape(a, b))
                gains.append((-gain, i, j))
        for _, i, j in sorted(gains)[: self.n_pairs]:
            b = len(self.coarse[j]) + 1
            cells[i, j] = coarse[i] * b + coarse[j], np.zeros((len(self.coarse[i]) + 1, b))
        for _ in range(self.pair_rounds):
            for at, tab in cells.values():
                p = 1 / (1 + np.exp(-logit))
                step, _ = _quadrants(np.bincount(at, p * (1 - p), tab.size).reshape(tab.shape), np.bincount(at, y - p, tab.size).reshape(tab.shape))
                tab += self.rate * step
                logit += self.rate * step.ravel()[at]
        self.pairs = [(i, j, tab) for (i, j), (_, tab) in cells.items()]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        fine, coarse = self._binned(x)
        logit = np.full(len(x), self.bias)
        for tab, at in zip(self.tables, fine):
            logit += tab[at]
        for i, j, tab in self.pairs:
            logit += tab[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def fit_labels(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> Gam:
    """Fit on the labelled documents, ``max_rows`` of them at most.

    The rows with the smallest hashes of their ids are taken. Null ids and
    null labels are left out; a label given several times counts by its mean;
    a document given several times counts each time, up to the bound.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("_y")).dropna().groupBy("_id").agg((F.avg("_y") >= 0.5).cast("int").alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id")
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def measure(batches):
        for batch in batches:
            x = text_features(batch.column("_text"))
            yield pa.RecordBatch.from_arrays([batch.column("_y").cast(pa.int32()), batch.column("_id").cast(pa.string()), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "id", "x"])

    rows = joined.mapInArrow(measure, schema).orderBy(F.xxhash64("id"), "id", "y", "x").limit(max_rows).toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return Gam().fit(x, rows["y"].to_numpy(dtype=float))


def with_scores(docs: DataFrame, model: Gam, text: str = "text") -> DataFrame:
    """Append ``quality_score`` (0 to 1); null and empty texts score as texts of no words."""

    def make():
        return lambda batch: {"quality_score": pa.array(model.score(text_features(batch.column(text))))}

    return with_columns(docs, make, T.StructType([T.StructField("quality_score", T.DoubleType())]))


def above(docs: DataFrame, model: Gam, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Documents that score ``threshold`` or more; columns unchanged."""

    def make():
        return lambda batch: pa.array(model.score(text_features(batch.column(text))) >= threshold)

    return filter_batches(docs, make)
