"""Benchmark passages in documents: CGK embedding of item-sized windows, bit-sampling LSH, exact edit distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.textscan import Block, blocks, mix, windows
from sensorframe.session import materialize

#: Largest share of an item's words that may be inserted, deleted or replaced. Items under EXACT_BELOW words must match
#: exactly; items under MIN_WORDS words are looked for only if their words hold MIN_BYTES bytes, as shorter ones match ordinary prose.
MAX_EDITS = 0.2
EXACT_BELOW = 8
MIN_WORDS = 5
MIN_BYTES = 24
GRAM = 3

#: Items of more words are embedded in equal parts of about PART words. Not all parts can have more than their share of the
#: edits, so a run within an item's edits holds a part within the part's edits.
WHOLE = 64
PART = 48

#: LSH: so many repetitions, each with its own random walk and so many sampled positions of the embedding. Of planted items
#: with none to a fifth of their words edited, sixteen repetitions find 99.8 %, eight 98.7 %.
REPETITIONS = 16
SAMPLES = 2

#: Items, and characters of items, handled in one pass over the documents. A larger benchmark takes several passes.
ITEMS_PER_PASS = 20_000
CHARS_PER_PASS = 8_000_000

#: Scripts written without spaces between words; each of their characters counts as a word.
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"

_BITMAP = 22
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _blocks(texts: pa.Array) -> Iterator[Block]:
    """Words are runs of letters and digits, compared in lower case, or single characters of scripts without spaces."""
    texts = pc.utf8_lower(texts)
    if pc.any(pc.match_substring_regex(texts, _UNSPACED)).as_py():
        texts = pc.replace_substring_regex(texts, _UNSPACED, r" \1 ")
    return blocks(texts, 1 << 20, _SEPARATOR)


def edits(n: int) -> int:
    return int(MAX_EDITS * n + 1e-9) if n >= EXACT_BELOW else 0


def _parts(n: int) -> list[tuple[int, int]]:
    """First word and end of the parts in which an item of ``n`` words is embedded."""
    count = 1 if n <= WHOLE else ceil(n / PART)
    return [(n * k // count, n * (k + 1) // count) for k in range(count)]


@dataclass(frozen=True)
class _Class:
    """Parts of similar length, and what their windows need: words, shared grams, sampled steps and walk bits."""

    size: int
    grams: int
    steps: np.ndarray
    bits: np.ndarray
    keys: np.ndarray
    owner: np.ndarray


def _embed(words: np.ndarray, start: np.ndarray, stop: np.ndarray, steps: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """LSH keys of word windows, one column a repetition.

    In a repetition the walk reads the word it stands on, emits it, and moves on if a random bit of the
    step and the word says so: edits shift two walks apart, and chance brings them together again, after
    which they emit the same words. The key is the hash of the words emitted at the sampled steps.
    """
    padded = np.append(words, np.uint64(0))
    at = np.repeat(start[:, None], len(steps), axis=1)
    keys = np.repeat(np.arange(1, len(steps) + 1, dtype=np.uint64)[None], len(start), axis=0)
    for j in range(steps.max() + 1):
        word = padded[np.where(at < stop[:, None], at, len(words))]
        here = (steps == j).any(axis=1)
        keys[:, here] = mix(keys[:, here] * np.uint64(31) + word[:, here])
        at += ((word * bits[:, j]) >> np.uint64(63)).astype(np.int64)
    return keys


class Index:
    """The items of one pass: their grams, the LSH keys of their parts by length class, and the short items by hash."""

    def __init__(self, item_ids: list[int], texts: list[str]):
        words, ids = [], []
        self.short: dict[int, dict[int, list[int]]] = {}
        for b in _blocks(pa.array(texts, pa.string())):
            h, size = b.word_hashes(), np.bincount(b.word_row, b.ends - b.starts, b.n_rows)
            for k in range(b.n_rows):
                own = h[b.word_row == k]
                if len(own) >= MIN_WORDS or size[k] >= MIN_BYTES:
                    if len(own) < MIN_WORDS:
                        key = windows(own, np.zeros(len(own), np.int64), len(own))[1][0]
                        self.short.setdefault(len(own), {}).setdefault(int(key), []).append(len(words))
                    words.append(own)
                    ids.append(item_ids[b.first + k])
        self.item_ids, self.words = np.array(ids, np.int64), words
        grams = [windows(own, np.zeros(len(own), np.int64), GRAM)[1] for own in words if len(own) >= MIN_WORDS]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
        self.bitmap = np.zeros(1 << _BITMAP, bool)
        self.bitmap[self.grams >> np.uint64(64 - _BITMAP)] = True
        parts = [(item, *part) for item, own in enumerate(words) if len(own) >= MIN_WORDS for part in _parts(len(own))]
        self.item, self.begin, self.end = (np.array(c, np.int64) for c in (zip(*parts, strict=True) if parts else ((), (), ())))
        self.classes = list(self._classify())

    def _classify(self) -> Iterator[_Class]:
        sizes = self.end - self.begin
        # below EXACT_BELOW each length is a class; above, a class spans a fifth
        level = np.array([n if n < EXACT_BELOW else 1000 + int(np.log(n) / np.log(1.2)) for n in sizes], int)
        for at in np.unique(level):
            parts = np.flatnonzero(level == at)
            shortest, longest = sizes[parts].min(), sizes[parts].max()
            draw = np.random.default_rng(int(at))
            steps = np.array([np.sort(draw.choice(2 * shortest, SAMPLES, replace=False)) for _ in range(REPETITIONS)])
            bits = draw.integers(0, 2**63, (REPETITIONS, 2 * shortest), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            flat = np.concatenate([self.words[self.item[p]][self.begin[p] : self.end[p]] for p in parts])
            stop = np.cumsum(sizes[parts])
            keys = _embed(flat, stop - sizes[parts], stop, steps, bits)
            order = np.argsort(keys.ravel(), kind="stable")
            yield _Class(
                int(longest + edits(longest)), int(min(n - GRAM + 1 - GRAM * edits(n) for n in sizes[parts])),
                steps, bits, keys.ravel()[order], np.repeat(parts, REPETITIONS)[order],
            )

    def search(self, b: Block) -> Iterator[tuple[int, int, int, int, int]]:
        """``(text of the block, item, edits, first word, end)`` of every item found in a text, at its best place."""
        h = b.word_hashes()
        row_end = np.cumsum(b.words_per_row())
        base = row_end - b.words_per_row()
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for row, item, *place in (*self._exact(h, b.word_row), *self._verify(h, b.word_row, self._stretches(h, b.word_row, base, row_end))):
            if (row, item) not in best or tuple(place[:2]) < best[row, item][:2]:
                best[row, item] = tuple(place)
        for (row, item), (distance, begin, end) in sorted(best.items()):
            yield row, item, distance, begin - int(base[row]), end - int(base[row])

    def _exact(self, h: np.ndarray, word_row: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Places ``(text, item, 0, first word, end)`` of the short items."""
        for n, items in self.short.items():
            at, keys = windows(h, word_row, n)
            hit = np.flatnonzero(np.isin(keys, np.array(list(items), np.uint64)))
            for k, key in zip(at[hit].tolist(), keys[hit].tolist(), strict=True):
                for item in items[key]:
                    yield int(word_row[k]), item, 0, k, k + n

    def _stretches(self, h: np.ndarray, word_row: np.ndarray, base: np.ndarray, row_end: np.ndarray) -> list[tuple[int, int, int]]:
        """``(item, first word, end)`` of the stretches of a text in which an item may lie, as one of its parts has a key there."""
        at, grams = windows(h, word_row, GRAM)
        maybe = np.flatnonzero(self.bitmap[grams >> np.uint64(64 - _BITMAP)])
        maybe = maybe[np.isin(grams[maybe], self.grams)]
        if not len(maybe):
            return []
        hits = np.zeros(len(h) + 1, np.int64)
        hits[at[maybe] + 1] = 1
        hits = np.cumsum(hits)
        found = set()
        for c in self.classes:
            last = np.minimum(np.arange(len(h)) + c.size - GRAM + 1, len(h))
            start = np.flatnonzero(hits[last] - hits[: len(h)] >= c.grams)
            if not len(start):
                continue
            row = word_row[start]
            stop = np.minimum(start + c.size, row_end[row])
            keys = _embed(h, start, stop, c.steps, c.bits)
            low, high = (np.searchsorted(c.keys, keys, side) for side in ("left", "right"))
            for w, r in zip(*np.nonzero(high > low), strict=True):
                for part in np.unique(c.owner[low[w, r] : high[w, r]]).tolist():
                    item, n = int(self.item[part]), len(self.words[self.item[part]])
                    before, after = int(self.begin[part]), n - int(self.end[part])
                    slack = edits(n) if before or after else 0
                    found.add((item, max(int(base[row[w]]), int(start[w]) - before - slack), min(int(row_end[row[w]]), int(stop[w]) + after + slack)))
        return sorted(found)

    def _verify(self, h: np.ndarray, word_row: np.ndarray, stretches: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        """``(text, item, edits, first word, end)`` of the best place in each run of an item's stretches that overlap, by the exact distance."""
        k, of, mask = 0, None, {}
        while k < len(stretches):
            item, begin, end = stretches[k]
            k += 1
            while k < len(stretches) and stretches[k][0] == item and stretches[k][1] < end and word_row[stretches[k][1]] == word_row[begin]:
                end = max(end, stretches[k][2])
                k += 1
            own = self.words[item]
            if of != item:
                of, mask = item, {}
                for j, w in enumerate(own.tolist()):
                    mask[w] = mask.get(w, 0) | 1 << j
            n = len(own)
            distance, last = best_end(mask, n, h[begin:end].tolist())
            if distance <= edits(n):
                yield int(word_row[begin]), item, distance, begin + max(last - n, 0), begin + last


def best_end(mask: dict[int, int], n: int, words: list[int]) -> tuple[int, int]:
    """Smallest edit distance of an ``n``-word pattern to any run of ``words``, and the end of the first such run.

    Myers' bit-vector recurrence; ``mask`` gives the pattern positions of a word as bits.
    """
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, (n, 0)
    for k, w in enumerate(words, 1):
        eq = mask.get(w, 0)
        d0 = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(d0 | up) & full, up & d0
        score += bool(right & top) - bool(left & top)
        right, left = right << 1 & full, left << 1 & full
        up, down = left | ~(d0 | right) & full, right & d0
        if score < best[0]:
            best = score, k
    return best


def indexes(benchmark: DataFrame, per_pass: int = ITEMS_PER_PASS) -> tuple[int, Iterator[Index]]:
    """The number of passes, of about ``per_pass`` items or CHARS_PER_PASS characters, and their indexes one by one.

    Null ids and null texts are left out, equal rows count once.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    passes = max(1, ceil(size["n"] / per_pass), ceil(size["chars"] / CHARS_PER_PASS))

    def built() -> Iterator[Index]:
        for k in range(passes):
            rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text").collect()
            yield Index([r["item_id"] for r in rows], [r["text"] for r in rows])

    return passes, built()


SCHEMA = "doc_id long, item_id long, edits long, first_word long, end_word long"


def matches(documents: DataFrame, benchmark: DataFrame, per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """``(doc_id, item_id, edits, first_word, end_word)``, a row for each item found in a document.

    An item is found where a run of words is at most a fifth of the item's words away in edits. Only
    windows that share the number of three-word grams that such a run must share are embedded; no match is
    lost by that. LSH finds nearly all of the rest, and its candidates are verified by their exact distance. Long items
    are found by their parts, so they are found no worse than short ones; items under MIN_WORDS words
    must match exactly and hold MIN_BYTES bytes. In scripts without spaces each character counts as a word.
    Of several places in a document the one with the fewest edits, then the first, is reported. Null and
    empty texts match nothing; rows with a null id are left out; rows with the same id are one document; of
    items with the same id the best match counts. A benchmark of several passes has the matches of each written
    before the next begins, so that one index is alive at a time.
    """
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    passes, built = indexes(benchmark, per_pass)
    found = None
    for index in built:
        part = docs.mapInArrow(_finder(index), SCHEMA)
        if passes > 1:
            part = materialize(part, "matches")
        found = part if found is None else found.union(part)
        del index
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "first_word", "end_word")).alias("m"))
    return best.select("doc_id", "item_id", "m.*")


def _finder(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for b in _blocks(batch.column("text")):
                rows += [(ids[b.first + row].as_py(), int(index.item_ids[item]), *rest) for row, item, *rest in index.search(b)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

    return run


def clean(documents: DataFrame, benchmark: DataFrame, per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """The documents in which no item is found, judged where they lie, without a join or shuffle.

    Rows with null or empty texts or null ids stay, as do repeated rows; columns are carried along. A benchmark of several
    passes has the rest of the documents written after each, so that one index is alive at a time.
    """
    passes, built = indexes(benchmark, per_pass)
    for index in built:
        documents = documents.mapInArrow(_keeper(index, documents.columns.index("text")), documents.schema)
        if passes > 1:
            documents = materialize(documents, "clean")
        del index
    return documents


def _keeper(index: Index, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for b in _blocks(batch.column(at)):
                keep[[b.first + row for row, *_ in index.search(b)]] = False
            yield batch.filter(pa.array(keep))

    return run
