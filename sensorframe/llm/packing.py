"""Packing of token sequences into windows of fixed length by the sum-of-squares rule."""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WINDOW = 4096
END_ID = 2
#: Fill levels are counted in steps of so many tokens. A piece that overruns a window by less is cut there.
GRAIN = 32
#: Bytes of texts tokenized together; a longer text is tokenized by itself.
TOGETHER = 4 << 20

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class WordTokenizer:
    """Ids of texts as little-endian 32-bit numbers, word by word with a cache.

    For tokenizers that lower-case, whose pre-tokenizer never joins what ASCII white space separates nor a
    letter with a following full stop or comma, and that mark the last token of a word: the ids of a text
    are then those of its parts. Each distinct word of a call is looked up once.
    """

    WORD_END = "</w>"

    def __init__(self, path: str, cached: int = 1 << 18):
        self.tokenizer, self.cache = Tokenizer.from_file(path), {b"": b""}
        self.cached = cached
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(self.WORD_END)]] = True
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # such words need no normalizer, and of letters only no pre-tokenizer
        self.split, self.model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        plain, letters = "".join(map(chr, [*range(0x21, 0x41), *range(0x5B, 0x7F)])), "abcdefghijklmnopqrstuvwxyz"
        as_is = self.tokenizer.normalizer is None or self.tokenizer.normalizer.normalize_str(plain) == plain
        self.direct = as_is and self.split is not None and self.split.pre_tokenize_str(letters) == [(letters, (0, 26))]
        apart = self.direct and [x for x, _ in self.split.pre_tokenize_str(f"a{_MARKS}")] == ["a", _MARKS]
        apart = apart and not any(set(s) & set(_MARKS.encode()) for s in self.special)
        self.marks = (_MARKS if apart else ".,").encode()

    def _one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        raw = pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary())
        return self.encode_column(raw.view(pa.large_string()))

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """Of each text; a null one counts as empty."""
        n = len(texts)
        texts = texts.take(pa.array(np.arange(n)))  # ascii_lower goes wrong on what cast makes of a slice
        raw = pc.fill_null(texts.cast(pa.large_string(), safe=False), "")
        low = pc.ascii_lower(raw)  # A-Z only; the names of special tokens keep their case
        for s in self.special:
            low = pc.if_else(pc.match_substring(low, s.decode(), ignore_case=True), raw, low)
        words = pc.ascii_split_whitespace(low)
        del texts, raw, low  # each step's columns go before the next one's come
        first = words.offsets.to_numpy() - words.offsets[0].as_py()
        each = words.flatten().dictionary_encode()
        del words
        often = np.bincount(each.indices.to_numpy(), minlength=len(each.dictionary)) > 1
        ids = self._ids(each.dictionary.cast(pa.large_binary()).to_pylist(), often.tolist())
        ids = pa.array(ids, pa.large_binary()).take(each.indices)
        del each
        _, ends, data = ids.buffers()
        if data is None:
            return [b""] * n
        bounds = np.frombuffer(ends, np.int64)[first + ids.offset].tolist()
        data = memoryview(data)
        return [bytes(data[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]

    def _ids(self, words: list[bytes], often: list[bool]) -> list[bytes]:
        """Ids of distinct words, an empty one included. Of letters and marks behind them, the letters alone are kept in the cache.

        Only words that are met ``often`` are kept, so that the many that a text alone has take no room.
        """
        known = self.cache.get
        parts = list(map(known, words))
        missing = [k for k, p in enumerate(parts) if p is None]
        unknown, marked, marks = {}, {}, {b"": b""}
        for k in missing:
            w, again = words[k], often[k]
            stem = w.rstrip(self.marks)
            if len(stem) < len(w) and (stem.isalpha() or self._letters(stem)):
                marked[k] = stem, w[len(stem) :]
                marks[w[len(stem) :]] = b""
                again, w = again or stem in unknown, stem
            if w not in self.cache:
                unknown[w] = again or unknown.get(w, False)
        new = self._learn(unknown)
        marks.update(self._learn(m for m in marks if m))
        for k in missing:
            w, mark = marked.get(k) or (words[k], b"")
            parts[k] = (new[w] if w in new else known(w)) + marks[mark]
        room = self.cached - len(self.cache)  # a full cache stays as it is: frequent words come first
        if room > 0:
            self.cache.update((w, new[w]) for w in islice((w for w, again in unknown.items() if again), room))
        return parts

    @staticmethod
    def _letters(word: bytes) -> bool:
        if word.isascii():
            return word.isalpha()
        text = word.decode("utf-8", "surrogatepass")
        return text.isalpha() and text.lower().isalpha()

    def _learn(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of new words. ASCII ones go to the model piece by piece, others of letters through the tokenizer together."""
        new, mixed, stems = {}, [], []
        for w in words:
            if self.direct and w.isalpha() and w.islower():
                new[w] = self._piece(w.decode())
            elif self.direct and _PLAIN.fullmatch(w) and not any(s in w for s in self.special):
                mixed.append(w)
            elif self._letters(w):
                stems.append(w)
            else:
                new[w] = self._one(w.decode("utf-8", "surrogatepass"))
        pieces: dict[str, bytes] = {}
        for k in range(0, len(mixed), 200):
            new.update(self._mixed(mixed[k : k + 200], pieces))
        for k in range(0, len(stems), 1000):  # told apart by their last tokens
            some = stems[k : k + 1000]
            ids = np.array(self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                raw = ids.tobytes()
                new.update(zip(some, (raw[4 * i : 4 * j] for i, j in zip([0, *ends[:-1]], ends, strict=True)), strict=True))
            else:
                new.update((w, self._one(w.decode())) for w in some)
        return new

    def _mixed(self, words: list[bytes], pieces: dict[str, bytes]) -> dict[bytes, bytes]:
        """Ids of words that the normalizer leaves as they are, by the pre-tokenizer's ``pieces``; equal pieces are looked up once."""
        ends, own = np.cumsum([len(w) + 1 for w in words]), [[] for _ in words]
        found = self.split.pre_tokenize_str(b" ".join(words).decode())
        for k, (piece, _) in zip(np.searchsorted(ends, [at for _, (at, _) in found], "right").tolist(), found, strict=True):
            if piece not in pieces:
                ids = self.cache.get(piece.encode()) if piece.isalpha() else None
                pieces[piece] = self._piece(piece) if ids is None else ids
            own[k].append(pieces[piece])
        return {w: b"".join(x) for w, x in zip(words, own, strict=True)}


#: What may stand behind a letter and is apart from it, if the pre-tokenizer says so; else full stops and commas.
_MARKS = "!#$%&*,.:;?"
#: Visible ASCII without capital letters.
_PLAIN = re.compile(rb"[!-@\[-~]+")

_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, one a worker process, so that its cache serves later tasks too."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class SumOfSquares:
    """Open windows by fill level; a piece goes where the sum of squared counts of partly filled levels grows least.

    Windows hold ``(document, start, ids)`` pieces in order. The number of open windows is bounded by the
    levels times the counts the rule keeps level, not by the number of pieces seen.
    """

    def __init__(self, window: int = WINDOW, grain: int = GRAIN):
        self.window, self.grain, self.levels = window, grain, window // grain
        self.count = np.zeros(self.levels, np.int64)
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(self.levels)]

    def place(self, doc: tuple, start: int, ids: bytes) -> Iterator[list]:
        """Add a piece; yields the windows that this fills. ``ids`` holds four bytes for each token."""
        while ids:
            size = len(ids) // 4
            if size >= self.window:
                yield [(doc, start, ids[: 4 * self.window])]
                start, ids = start + self.window, ids[4 * self.window :]
                continue
            level = self._choose(size)
            fill, pieces = (0, []) if level is None else self.open[level].pop()
            if level is not None:
                self.count[level] -= 1
            take = min(size, self.window - fill)
            pieces.append((doc, start, ids[: 4 * take]))
            fill, start, ids = fill + take, start + take, ids[4 * take :]
            if fill == self.window:
                yield pieces
            else:
                self.count[fill // self.grain] += 1
                self.open[fill // self.grain].append((fill, pieces))

    def _choose(self, size: int) -> int | None:
        """Level of the open window to use, None for a new window."""
        step = size // self.grain
        here = np.flatnonzero(self.count)
        here = here[here + step <= self.levels]
        to = here + step
        arriving = np.where(to < self.levels, 2 * self.count[np.minimum(to, self.levels - 1)] + 1, 0)
        cost = np.where(step, 1 - 2 * self.count[here] + arriving, 0)
        if not len(here) or 2 * self.count[step] + 1 < cost.min():
            return None
        return int(here[cost.argmin()])

    def rest(self) -> Iterator[list]:
        """Close the windows still open: their pieces are cut to fill full windows, and the end is cut at powers of two."""
        left = [p for level in reversed(self.open) for _, pieces in level for p in pieces]
        total = sum(len(p[2]) // 4 for p in left)
        sizes = [self.window] * (total // self.window)
        sizes += [1 << k for k in reversed(range(self.window.bit_length())) if total % self.window >> k & 1]
        left.reverse()
        for size in sizes:
            full = []
            while size:
                doc, start, ids = left.pop()
                take = min(size, len(ids) // 4)
                full.append((doc, start, ids[: 4 * take]))
                size -= take
                if len(ids) > 4 * take:
                    left.append((doc, start + take, ids[4 * take :]))
            yield full
        self.__init__(self.window, self.grain)


def _together(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and end of runs of texts of TOGETHER bytes at most, or of one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(sizes, dtype=np.int64), 0
    while first < len(ends):
        last = int(np.searchsorted(ends, ends[first] - sizes[first] + TOGETHER, "right"))
        yield first, (last := max(first + 1, last))
        first = last


def pack(documents: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """Pieces of documents in windows, one row a piece.

    Each task tokenizes and packs the rows it reads, with its own level array: no shuffle, and memory for
    the open windows of one task. Sequences are numbered by task, so a lost task repeats the same rows.
    A null text counts as empty and gives the end id alone; null ids and repeated rows are documents of
    their own. Every sequence is full, but for at most twelve a task whose lengths are powers of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows = tokenizer(tokenizer_path), SumOfSquares(window)
        number = TaskContext.get().partitionId() << 40
        end = np.array([END_ID], "<u4").tobytes()
        out: dict[str, list] = defaultdict(list)

        def emit(pieces: list) -> None:
            nonlocal number
            at = 0
            for (doc_id, tokens), start, ids in pieces:
                size = len(ids) // 4
                row = (doc_id, start, size, zlib.crc32(ids), tokens, number, at)
                for name, value in zip(NAMES, row, strict=True):
                    out[name].append(value)
                at += size
            number += 1

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(out[n], pa.int64()) for n in NAMES], list(NAMES))
            out.clear()
            return b

        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            for first, last in _together(texts):
                coded = words.encode_column(texts.slice(first, last - first))
                for doc_id, tokens in zip(ids[first:last], coded, strict=True):
                    for full in windows.place((doc_id, len(tokens) // 4 + 1), 0, tokens + end):
                        emit(full)
                if len(out["doc_id"]) >= 5000:
                    yield flush()
        for full in windows.rest():
            emit(full)
        yield flush()
        pa.default_memory_pool().release_unused()  # the worker process goes on to other tasks

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


NAMES = tuple(x.split()[0] for x in SCHEMA.split(", "))
