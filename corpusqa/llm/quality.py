"""Operator 2: quality by a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins; the model is a lookup table for each feature, and one for each of a
few pairs of features. The tables are learned by cyclic boosting: round after round, each feature in turn
gets one shallow tree on its bins (at most four leaves), fitted to the current gradients and added to the
table at a low rate; then the pairs with the largest gain get four-leaf trees in the same way. A
score is a sum of table entries through the logistic curve: vectorised lookups, whatever the model's size.

It is fitted on a bounded sample of labelled documents; features are computed by Spark, over whole texts.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusqa.llm.shared import small_batches
from corpusqa.llm.toxicity import sample

FEATURES = (
    "log_words", "mean_word", "longest_word", "distinct_words", "repeated_next", "top_word", "letters", "digits", "upper", "spaces",
    "sentence_signs", "other_signs", "wide_bytes", "log_lines", "distinct_lines", "short_lines", "lines_ended", "words_with_sign",
)
_KIND = np.zeros(256, int)  # class of a byte
for _name, _class in (("0123456789", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (" \t\n\r\x0b\x0c", 3), (".,;:!?'\"-()", 4)):
    _KIND[list(_name.encode())] = _class
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = 5
_KIND[128:] = 6  # all else is 0: other signs


def features(text: str | None) -> list[float]:
    """One number for each of ``FEATURES``; a text without words gives zeros."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    share = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=7) / len(raw)
    n, counts, rows = len(words), Counter(words), [r for r in text.split("\n") if r.strip()]
    return [
        float(np.log1p(n)), len(text) / n, float(max(map(len, counts))), len(counts) / n, sum(map(operator.eq, words, words[1:])) / n,
        max(counts.values()) / n, share[5] + share[2] + share[6], share[1], share[2], share[3], share[4], share[0], share[6],
        float(np.log1p(len(rows))), len(set(rows)) / len(rows), sum(len(r) < 30 for r in rows) / len(rows),
        sum(r.rstrip()[-1] in ".!?" for r in rows) / len(rows), sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?") / n,
    ]


@dataclass
class Model:
    """``edges`` of the bins and ``tables`` by feature; ``pairs`` of features with their tables over coarse bins."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        rough = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.coarse)]
        for i, j, table in self.pairs:
            total += table[rough[i], rough[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """A tree over ordered bins as one value a bin, from sums of gradients and Hessians."""
    cuts = [0, len(g)]
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + ridge)
    while len(cuts) - 1 < leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            mid = np.arange(a + 1, b)
            mid = mid[(hs[mid] - hs[a] >= least) & (hs[b] - hs[mid] >= least)]
            if len(mid):
                won = gain(a, mid) + gain(mid, b) - gain(a, b)
                best = max(best, (float(won.max()), int(mid[won.argmax()])), key=lambda t: t[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = -(gs[b] - gs[a]) / (hs[b] - hs[a] + ridge)
    return out


def _corners(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best four-leaf tree (one cut on each axis) of a two-way table."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quarter = lambda s: (s[:-1, :-1], s[:-1, -1:] - s[:-1, :-1], s[-1:, :-1] - s[:-1, :-1], s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + s[:-1, :-1])
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    parts = list(zip(quarter(gs), quarter(hs)))
    gain = sum(a * a / (b + ridge) for a, b in parts) - gs[-1, -1] ** 2 / (hs[-1, -1] + ridge)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    value = [-a[i, j] / (b[i, j] + ridge) for a, b in parts]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gain[i, j]), out


def boost(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse: int = 12, rounds: int = 150, pair_rounds: int = 60,
          n_pairs: int = 8, rate: float = 0.1, ridge: float = 2.0) -> Model:
    """Fits a model to rows ``x`` and labels ``y`` (0, 1). Without rows or with one class: a constant."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))), [_cuts(x[:, j], bins) for j in range(x.shape[1])], [], [_cuts(x[:, j], coarse) for j in range(x.shape[1])], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not len(y) or y.min() == y.max():
        return model
    fine = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(fine[j], g, len(table)), np.bincount(fine[j], h, len(table)), 4, ridge, 1.0)
            table += step
            total += step[fine[j]]

    def two_way(i: int, j: int) -> tuple[float, np.ndarray]:
        g, h = slopes()
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        cell = rough[i] * shape[1] + rough[j]
        return _corners(np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape), ridge)

    ranked = sorted(((two_way(i, j)[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)[:n_pairs]
    model.pairs = [(i, j, np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))) for _, i, j in ranked]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            step = rate * two_way(i, j)[1]
            table += step
            total += step[rough[i], rough[j]]
    return model


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        x = [features(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])


def fit(docs: DataFrame, labels: DataFrame, hold: tuple[int, int] = (4, 2), rows: int = 20_000) -> Model:
    """Learns from ``labels`` (doc_id, quality). ``rows`` bounds the labelled documents; their features (18 numbers each)
    are all that comes to the driver."""
    got = sample(docs, labels, "quality", hold, rows).mapInArrow(_rows, "x array<double>, label int").collect()
    got.sort(key=lambda r: (r["x"], r["label"]))  # the same sums each time
    return boost(np.array([r["x"] for r in got], float).reshape(-1, len(FEATURES)), np.array([r["label"] for r in got], float))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (double, 0 to 1) and ``predicted`` (int). Whole texts are read.

    Null or empty text: the score of all features zero. Null doc_id, repeated rows: each row by itself.
    Empty table: no rows. Columns of ``docs`` with these names are replaced.
    """

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            x = np.array([features(t) for t in series], float).reshape(-1, len(FEATURES))
            yield pd.Series(model.score(x))

    out = docs.drop("score", "predicted").withColumn("score", scored(F.col("text").cast("string")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
