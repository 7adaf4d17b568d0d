"""Quality rules: counted base rules, and a calibrated logistic regression over hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm import labelled
from sensorframe.llm.textscan import IS_SPACE, Block, blocks, duplicate_lines, per_row, repeated_words, windows

#: The base rules, and the probability below which a text is dropped.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_PROBABILITY = 0.5

BITS = 16
#: Features are shares of a text's n-grams; this brings them to a useful size.
SCALE = 40.0
#: Sparse rows that a step of the fit takes at a time.
TOGETHER = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_counts(b: Block) -> dict[str, np.ndarray]:
    """The counts of the base rules for each text of a block."""
    lead = (b.data & 0xC0) != 0x80
    return {
        "n_words": b.words_per_row(),
        "word_chars": per_row(lead & ~IS_SPACE[b.data], b.bounds),
        "n_symbols": per_row(_SYMBOL[b.data], b.bounds),
        "n_dup_lines": duplicate_lines(b),
        "n_repeat_words": repeated_words(b.word_hashes(), b.word_row, b.n_rows),
    }


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Too few words, or too large a share of words in repeated five-word windows."""
    n = counts["n_words"]
    return (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * n)


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)


def ngrams(b: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(text of the block, bucket)`` of all n-grams, first of one and two words, then of three and four characters."""
    hashes = b.word_hashes()
    at, pairs = windows(hashes, b.word_row, 2)
    yield np.concatenate([b.word_row, b.word_row[at]]), _bucket(np.concatenate([hashes, pairs]))
    points = np.frombuffer(b.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    lead = np.zeros(len(b.data) + 1, np.int64)
    np.cumsum((b.data & 0xC0) != 0x80, out=lead[1:])
    row = np.repeat(np.arange(b.n_rows), np.diff(lead[b.bounds]))
    rows, keys = [], []
    for size in (3, 4):
        n = len(points) - size + 1
        if n <= 0:
            continue
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + points[k : k + n]
        h ^= h >> np.uint64(29)
        inside = row[:n] == row[size - 1 :]
        rows.append(row[:n][inside])
        keys.append(_bucket(h[inside]))
    yield (np.concatenate(rows), np.concatenate(keys)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass(frozen=True)
class RulesModel:
    """Weights of the buckets of word and of character n-grams, an intercept, and the calibration of the margin."""

    word: np.ndarray
    char: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, b: Block) -> np.ndarray:
        margin = np.full(b.n_rows, self.intercept)
        for (row, bucket), weights in zip(ngrams(b), (self.word, self.char), strict=True):
            total = np.bincount(row, weights[bucket], minlength=b.n_rows)
            margin += SCALE * total / np.maximum(np.bincount(row, minlength=b.n_rows), 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def _sparse(b: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text of a block: the columns of its n-grams (characters after words) and their shares."""
    parts = []
    for k, (row, bucket) in enumerate(ngrams(b)):
        key, count = np.unique(row << (BITS + 1) | k << BITS | bucket, return_counts=True)
        share = SCALE * count / np.maximum(np.bincount(row, minlength=b.n_rows), 1)[key >> (BITS + 1)]
        parts.append((key, share))
    key, share = (np.concatenate(x) for x in zip(*parts, strict=True))
    for k in range(b.n_rows):
        mine = key >> (BITS + 1) == k
        yield (key[mine] & (2 ** (BITS + 1) - 1)).astype(np.int32), share[mine].astype(np.float32)


def _calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities (logistic, with targets kept off 0 and 1)."""
    n1, n0 = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.column_stack([margin, np.ones(len(margin))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - target)) + 1e-3 * (w - [1, 0])
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, gradient), -1, 1)
    return float(max(w[0], 0.05)), float(w[1])


def _parts(rows: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """TOGETHER sparse rows at a time: the first one's number, then row from there on, column and value of each entry."""
    for first in range(0, len(rows), TOGETHER):
        columns, values = zip(*rows[first : first + TOGETHER], strict=True)
        row = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
        yield first, row, np.concatenate(columns).astype(np.intp), np.concatenate(values)


def _sums(rows: list[tuple[np.ndarray, np.ndarray]], w: np.ndarray) -> np.ndarray:
    """Sum of the weighted values of each row."""
    return np.concatenate([
        np.bincount(row, value * w[column], minlength=min(TOGETHER, len(rows) - k)) for k, row, column, value in _parts(rows)
    ])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, sizes: dict[int, int], steps: int = 120, ridge: float = 1e-4) -> RulesModel | None:
    """Logistic regression on sparse rows; every fourth row is kept back for the calibration. None if a class is missing.

    A step takes TOGETHER rows at a time, so that it holds no copy of all of them.
    """
    if len(set(y.tolist())) < 2:
        return None
    apart = np.arange(len(y)) % 4 == 3
    if len(set(y[~apart].tolist())) < 2 or len(set(y[apart].tolist())) < 2:
        apart[:] = False
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) * ~apart
    weight /= weight.sum()
    w, intercept = np.zeros(2 ** (BITS + 1)), 0.0
    first, second, g0, g1 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        margin = _sums(rows, w) + intercept
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
        gradient = np.zeros_like(w)
        for k, row, column, value in _parts(rows):
            np.add.at(gradient, column, value * error[k + row])
        gradient += ridge * w
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        w = w - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-4)
        g0, g1 = 0.9 * g0 + 0.1 * error.sum(), 0.99 * g1 + 0.01 * error.sum() ** 2
        intercept -= 0.1 * (g0 / (1 - 0.9**t)) / (np.sqrt(g1 / (1 - 0.99**t)) + 1e-4)
    margin = _sums(rows, w) + intercept
    use = apart if apart.any() else ~apart
    share = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum())
    share = share * len(share) / share.sum()
    slope, shift = _calibrate(margin[use], y[use], share[use])
    return RulesModel(w[: 2**BITS].astype(np.float32), w[2**BITS :].astype(np.float32), float(intercept), slope, shift)


def learn(documents: DataFrame, labels: DataFrame, per_class: int = 1000) -> RulesModel | None:
    """Fit on at most ``per_class`` labelled rows of each class, of those that pass the base rules.

    Only the n-gram counts of these rows come to the driver.
    """
    chosen = labelled.sample(documents, labels, "quality", per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, shares = [], []
            for b in blocks(batch.column("text")):
                failed = base_failed(base_counts(b))
                for k, (c, v) in enumerate(_sparse(b)):
                    columns.append(None if failed[k] else c)
                    shares.append(None if failed[k] else v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array(columns, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
                ["doc_id", "y", "c", "v"],
            )

    rows = chosen.mapInArrow(run, "doc_id long, y int, c array<int>, v array<float>").where("c is not null").toArrow()
    if not rows.num_rows:
        return None
    order = pc.sort_indices(rows.select(["doc_id"]), [("doc_id", "ascending")]).to_pylist()
    sparse = [(rows["c"][k].values.to_numpy(), rows["v"][k].values.to_numpy()) for k in order]
    model = fit(sparse, rows["y"].to_numpy()[order], labelled.class_sizes(labels, "quality"))
    del sparse, rows
    pa.default_memory_pool().release_unused()
    return model


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, p_good double"
)


def _judged(b: Block, model: RulesModel | None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray | None]:
    """Counts, failure of the base rules, final verdict and probability of the texts of a block."""
    counts = base_counts(b)
    failed = base_failed(counts)
    p = None if model is None else model.probability(b)
    return counts, failed, ~failed if p is None else ~failed & (p >= MIN_PROBABILITY), p


def judge(documents: DataFrame, model: RulesModel | None) -> DataFrame:
    """Counts, base verdict and final verdict of every document.

    A null or empty text has no words and fails the base rules. Without a model (a class without labelled
    rows) the base rules alone decide and ``p_good`` is null. Rows are judged one by one: repeated rows and
    null ids stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text")):
                counts, failed, kept, p = _judged(b, model)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(b.first, b.n_rows), *(pa.array(c, pa.int64()) for c in counts.values()),
                     pa.array(failed), pa.array(kept), pa.nulls(b.n_rows, pa.float64()) if p is None else pa.array(p)],
                    ["doc_id", *counts, "base_failed", "kept", "p_good"],
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def keep(documents: DataFrame, model: RulesModel | None) -> DataFrame:
    """The rows whose text passes; judged where they lie, without a join. Other columns are carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text")):
                yield batch.slice(b.first, b.n_rows).filter(pa.array(_judged(b, model)[2]))

    return documents.mapInArrow(run, documents.schema)
