"""Words, lines and word hashes of many texts at once, as numpy passes over the bytes of an Arrow column.

Hashes are 64 bits wide: two different words, lines or windows of one text take the same hash with a
chance of about 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK_BYTES = 1 << 19

_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)

#: The separators of words: space and the control characters 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to differ from all columns, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown to the longest block seen."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between consecutive ``bounds``."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


@dataclass
class Block:
    """Consecutive rows of a batch: their bytes, and where rows, words and lines lie in them."""

    first: int
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word_row: np.ndarray
    sums: np.ndarray
    down: np.ndarray

    @property
    def n_rows(self) -> int:
        return len(self.bounds) - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each byte range."""
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64))

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def words_per_row(self) -> np.ndarray:
        return np.bincount(self.word_row, minlength=self.n_rows)


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES, spaces: np.ndarray = IS_SPACE) -> Iterator[Block]:
    """The rows of a string column in blocks of about ``block_bytes``; a longer text is a block of its own.

    Null texts count as empty. ``spaces`` tells which bytes separate words.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    raw = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block_bytes, "right")) - 1)
        stop = min(stop, len(texts))
        data = raw[offsets[row] : offsets[stop]]
        yield _scan(row, data, offsets[row : stop + 1] - offsets[row], spaces)
        row = stop


def _scan(first: int, data: np.ndarray, bounds: np.ndarray, spaces: np.ndarray) -> Block:
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~spaces[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    up, down = _powers.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    word_row = np.searchsorted(bounds, starts, "right") - 1
    return Block(first, data, bounds, starts, ends, word_row, sums, down)


def windows(hashes: np.ndarray, word_row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and hash of every run of ``size`` words that lies within one row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(_BASE) + hashes[k : k + n]
    at = np.flatnonzero(word_row[:n] == word_row[size - 1 :])
    return at, mix(h[at])


def repeated_words(hashes: np.ndarray, word_row: np.ndarray, n_rows: int, size: int = 5) -> np.ndarray:
    """Words per row inside windows of ``size`` words that occur more than once in the row."""
    at, h = windows(hashes, word_row, size)
    if not len(at):
        return np.zeros(n_rows, np.int64)
    key = mix(h + word_row[at].astype(np.uint64) * np.uint64(_BASE))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + size, -1)
    return np.bincount(word_row[np.cumsum(change[:-1]) > 0], minlength=n_rows)


def duplicate_lines(block: Block) -> np.ndarray:
    """Lines per row that hold a word and equal an earlier line of the row; lines end at a line feed."""
    feeds = np.flatnonzero(block.data == 10)
    starts = np.union1d(feeds + 1, block.bounds[:-1])
    starts = starts[starts < len(block.data)]
    if not len(starts):
        return np.zeros(block.n_rows, np.int64)
    stops = np.append(starts[1:], len(block.data))
    row = np.searchsorted(block.bounds, starts, "right") - 1
    ends = stops - (block.data[stops - 1] == 10)
    words = np.searchsorted(block.starts, stops) - np.searchsorted(block.starts, starts)
    starts, ends, row = starts[words > 0], ends[words > 0], row[words > 0]
    key = mix(block.hashes(starts, ends) + row.astype(np.uint64) * np.uint64(_BASE))
    _, first = np.unique(key, return_index=True)
    return np.bincount(row, minlength=block.n_rows) - np.bincount(row[first], minlength=block.n_rows)
