"""Quality scores learned from preferences: Bradley-Terry over pairs of labelled documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm import labelled
from sensorframe.llm.textscan import IS_SPACE, blocks, duplicate_lines, per_row, repeated_words

#: The score from which a document counts as good.
CUT = 0.3

N_FEATURES = 18

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&<>=~^{}[]\\")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``N_FEATURES`` numbers a text, from the whole text: shares of marks, case, repetition and length."""
    parts = []
    for b in blocks(texts):
        count = lambda flags, b=b: per_row(flags, b.bounds)
        words = b.words_per_row().astype(float)
        n = np.maximum(words, 1)
        chars = np.maximum(count(~IS_SPACE[b.data]), 1)
        upper, lower = count(_UPPER[b.data]), count(_LOWER[b.data])
        lines = np.maximum(count(b.data == 10) + 1, 1)
        shares = [
            count(_SYMBOL[b.data]) / n,
            count(b.data == ord("|")) / n,
            count(b.data == ord("!")) / n,
            upper / np.maximum(upper + lower, 1),
            repeated_words(b.word_hashes(), b.word_row, b.n_rows) / n,
            duplicate_lines(b) / lines,
            count(_DIGIT[b.data]) / chars,
            count((b.data == ord(".")) | (b.data == ord(","))) / n,
        ]
        shares = np.minimum(np.column_stack(shares), 1)
        parts.append(np.column_stack([shares, np.sqrt(shares), np.log1p(words), chars / n / 10]))
    return np.vstack(parts) if parts else np.zeros((0, N_FEATURES))


@dataclass(frozen=True)
class RankModel:
    """Strength of a document: ``weights`` times its standardised features; ``cut`` is the strength scored CUT."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_pairs(difference: np.ndarray, ridge: float = 1e-2, steps: int = 12) -> np.ndarray:
    """Bradley-Terry weights: logistic loss on (preferred minus other), no intercept, by Newton's method."""
    w = np.zeros(difference.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))
        gradient = -(difference * p[:, None]).mean(0) + ridge * w
        hessian = (difference * (p * (1 - p))[:, None]).T @ difference / len(difference) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    return w


def fit(x: np.ndarray, y: np.ndarray, sizes: dict[int, int], rounds: int = 8) -> RankModel | None:
    """Learn from labelled rows; ``sizes`` are the rows of each class there are. None if a class is missing.

    Every good row is preferred to ``rounds`` bad ones and the reverse. The cut is the quantile of the
    strengths at the share of bad rows.
    """
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return None
    centre, spread = x.mean(0), np.maximum(x.std(0), 1e-3)
    scaled = lambda v: np.clip((v - centre) / spread, -6, 6)
    n = max(len(good), len(bad))
    pick = np.random.default_rng(7)
    difference = np.vstack([
        scaled(good)[(np.arange(n) + pick.integers(n)) % len(good)] - scaled(bad)[(np.arange(n) + pick.integers(n)) % len(bad)]
        for _ in range(rounds)
    ])
    w = fit_pairs(difference)
    strength = scaled(x) @ w
    weight = np.where(y == 1, sizes[1] / len(good), sizes[0] / len(bad))
    order = np.argsort(strength)
    passed = np.cumsum(weight[order]) / weight.sum()
    at = min(int(np.searchsorted(passed, sizes[0] / (sizes[0] + sizes[1]) - 1e-9)), len(order) - 2)
    cut = float(strength[order[max(at, 0) : at + 2]].mean())
    slope = 1.0
    for _ in range(30):  # one weight: how fast the share of good rows rises with the strength
        z = np.clip(slope * (strength - cut) + np.log(CUT / (1 - CUT)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        step = (weight * (p - y) * (strength - cut)).sum() / ((weight * p * (1 - p) * (strength - cut) ** 2).sum() + 1e-6 * weight.sum())
        slope = float(np.clip(slope - np.clip(step, -0.5, 0.5), 0.2, 5))
    return RankModel(centre, spread, w, cut, slope)


def learn(documents: DataFrame, labels: DataFrame, per_class: int = 4000) -> RankModel | None:
    """Fit on at most ``per_class`` labelled rows of each class; only their features come to the driver."""
    chosen = labelled.sample(documents, labels, "quality", per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = features(b.column("text"))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * N_FEATURES), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), values], ["doc_id", "y", "x"])

    rows = chosen.mapInArrow(run, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id")
    if rows.empty:
        return None
    return fit(np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(), labelled.class_sizes(labels, "quality"))


def score(documents: DataFrame, model: RankModel | None) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document, from its text alone.

    A null text counts as empty, and an empty text gets the score of its (zero) features. Without a model,
    where a class has no labelled row, the score is 0.5. Rows are scored one by one: repeated rows stay,
    a null id stays null and counts as held out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = np.full(b.num_rows, 0.5) if model is None else model.score(features(b.column("text")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    scored = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
