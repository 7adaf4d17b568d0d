"""Line dedup: repeated runs of lines, and content-defined chunks of lines, wherever they stand in a document."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sensorframe.llm.textscan import Block, blocks, free_name, mix
from sensorframe.session import materialize

#: A chunk ends after a line if the hash of the last ROLL lines, modulo MEAN_LINES, is zero.
ROLL = 2
MEAN_LINES = 4

#: A repeated run of lines goes whole if it has more than so many words.
RUN_WORDS = 50

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _lines(b: Block) -> tuple[np.ndarray, ...]:
    """``(text, first byte, end, hash, words, closes a chunk)`` of every line of a block; ends leave out the line feed.

    The rolling hash sees only the lines of one text, so two texts that share ROLL - 1 lines before a
    passage and the passage itself cut it alike, wherever it stands.
    """
    feeds = np.flatnonzero(b.data == 10)
    starts = np.union1d(feeds + 1, b.bounds[:-1][np.diff(b.bounds) > 0])
    starts = starts[starts < len(b.data)]
    stops = np.append(starts[1:], len(b.data))
    if not len(starts):
        return (np.zeros(0, np.int64),) * 6
    ends = stops - (b.data[stops - 1] == 10)
    row = np.searchsorted(b.bounds, starts, "right") - 1
    lines = b.hashes(starts, ends)
    rolled = lines.copy()
    for k in range(1, ROLL):
        same = np.zeros(len(lines), bool)
        same[k:] = row[k:] == row[:-k]
        before = np.zeros(len(lines), np.uint64)
        before[k:] = lines[:-k]
        rolled = rolled * _STEP + np.where(same, before, np.uint64(0))
    last = np.append(row[1:] != row[:-1], True)
    words = np.searchsorted(b.starts, stops) - np.searchsorted(b.starts, starts)
    return row, starts, ends, lines, words, (mix(rolled) % np.uint64(MEAN_LINES) == 0) | last


def _spans(closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of every chunk."""
    close = np.flatnonzero(closes)
    return np.append(0, close[:-1] + 1)[: len(close)], close


def chunks(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, first byte, end, lines with a word)`` of every chunk of a block; ends leave out the last line feed."""
    row, starts, ends, _, words, closes = _lines(b)
    opened, close = _spans(closes)
    total = np.append(0, np.cumsum(words > 0))
    return row[opened], starts[opened], ends[close], total[close + 1] - total[opened]


def _number(row: np.ndarray) -> np.ndarray:
    """Position of each chunk in its text."""
    first = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
    at = np.arange(len(row))
    return at - np.maximum.accumulate(np.where(first, at, 0)) if len(row) else at


def chunk_rows(documents: DataFrame, with_text: bool) -> DataFrame:
    """``(doc_id, chunk, h)`` of every line, ``chunk`` being its number in the text.

    Further the bytes of the line, or else the hash of the text, which tells texts with one id apart, the words of the line and, where a
    chunk with two or more lines that hold a word opens, the number of the chunk's lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for b in blocks(batch.column("text")):
                row, start, end, h, words, closes = _lines(b)
                columns = [ids.take(pa.array(b.first + row)), pa.array(_number(row)), pa.array(h.view(np.int64))]
                if with_text:
                    at = np.column_stack([start, end]).ravel()
                    spans = pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), max(len(at) - 1, 0), [None, pa.py_buffer(np.append(at, 0)[: max(len(at), 1)].astype(np.int64)), pa.py_buffer(b.data)]
                    )
                    columns.append(spans.take(pa.array(np.arange(0, len(spans), 2))).cast(pa.binary()))
                else:
                    opened, close = _spans(closes)
                    total = np.append(0, np.cumsum(words > 0))
                    size = np.zeros(len(row), np.int64)
                    size[opened] = np.where(total[close + 1] - total[opened] >= 2, close + 1 - opened, 0)
                    columns += [batch.column("version").take(pa.array(b.first + row)), pa.array(words), pa.array(size)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "chunk", "h", *(["text"] if with_text else ["version", "words", "size"])])

    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version"))
    return rows.mapInArrow(run, "doc_id long, chunk long, h long, " + ("text binary" if with_text else "version long, words long, size long"))


def repeated(documents: DataFrame) -> DataFrame:
    """``(h, first)`` of every line that occurs more than once; ``first`` is the smallest (doc_id, chunk).

    Grouping on the hash and the bytes compares the bytes themselves. A hash that different bytes share
    is left out, so nothing is removed on the word of a hash. Equal lines are merged in each task before the shuffle.
    """
    texts = chunk_rows(documents, True).groupBy("h", "text").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "chunk")).alias("first")
    )
    return texts.groupBy("h").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.min("first").alias("first")).where(
        "texts = 1 and n > 1"
    ).select("h", "first")


def _windows(line: np.ndarray, words: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the runs to compare: the shortest of over RUN_WORDS words from each line and up to each line, and chunks.

    The lines of one document, in order, without those that occur only once. A longer run that occurs twice
    is covered by the shortest ones inside it, which occur twice as well; so these suffice.
    """
    n = len(line)
    breaks = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (line[1:] != line[:-1] + 1)))
    low = np.repeat(breaks, np.diff(np.append(breaks, n)))
    high = np.repeat(np.append(breaks[1:], n), np.diff(np.append(breaks, n)))
    total, at = np.append(0, np.cumsum(words)), np.arange(n)
    end = np.searchsorted(total, total[:-1] + RUN_WORDS, "right")
    begin = np.searchsorted(total, total[1:] - RUN_WORDS, "left") - 1
    ahead, back, whole = (words > 0) & (end <= high), (words > 0) & (begin >= low), (size > 0) & (at + size <= high)
    spans = np.concatenate([at[ahead] * (n + 1) + end[ahead], begin[back] * (n + 1) + at[back] + 1, at[whole] * (n + 1) + (at + size)[whole]])
    return np.divmod(np.unique(spans), n + 1)


def run_rows(lists: DataFrame) -> DataFrame:
    """``(doc_id, version, chunk, n, key)``: first line, lines and key of the runs to compare in ``(doc_id, version, lines)``.

    The key is the hashes of the lines, each of which stands for the same bytes everywhere, or of more than eight lines a
    264-bit hash of these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("lines")
            line, h, words, size = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("chunk", "h", "words", "size"))
            if not len(line):
                continue
            doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            start, end = _windows(line, words, size, doc)
            raw = np.ascontiguousarray(h).tobytes()
            keys = [raw[8 * i : 8 * j] if j - i <= 8 else blake2b(raw[8 * i : 8 * j], digest_size=33).digest() for i, j in zip(start.tolist(), end.tolist(), strict=True)]
            ids = [batch.column(c).take(pa.array(doc[start])) for c in ("doc_id", "version")]
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.array(line[start]), pa.array(end - start), pa.array(keys, pa.binary())], ["doc_id", "version", "chunk", "n", "key"]
            )

    return lists.mapInArrow(run, "doc_id long, version long, chunk long, n long, key binary")


def removals(documents: DataFrame) -> DataFrame:
    """``(doc_id, version, chunks)``: first line and number of lines of the runs of a text that occur before.

    Before is earlier in the text, or in a smaller id, or in a text of the same id with a smaller hash (``version``).
    """
    twice = materialize(repeated(documents), "lines").select("h")
    lists = chunk_rows(documents, False).join(twice, "h").groupBy("doc_id", "version").agg(
        F.sort_array(F.collect_set(F.struct("chunk", "h", "words", "size"))).alias("lines")
    )
    runs = materialize(run_rows(lists), "runs")
    first = runs.groupBy("key").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "version", "chunk")).alias("first")).where("times > 1").drop("times")
    again = runs.join(materialize(first, "first-runs"), "key").where("struct(doc_id, version, chunk) > first")
    return again.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(F.struct("chunk", "n"))).alias("chunks"))


def without(text: bytes, gone: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the lines of these runs, given as first line and number of lines, and how many chunks lose lines."""
    b = next(blocks(pa.array([text.decode()]), len(text) + 1))
    _, start, end, _, _, closes = _lines(b)
    cut = np.zeros(len(start) + 1, np.int64)
    for first, n in gone:
        cut[min(first, len(start))] += 1
        cut[min(first + n, len(start))] -= 1
    cut = np.cumsum(cut[:-1]) > 0
    opened, _ = _spans(closes)
    kept = np.flatnonzero(~cut)
    touched = int(np.logical_or.reduceat(cut, opened).sum()) if len(opened) else 0
    return b"\n".join(text[i:j] for i, j in zip(start[kept].tolist(), end[kept].tolist(), strict=True)), touched


def dedup(documents: DataFrame) -> DataFrame:
    """All documents, with the repeated lines cut out; ``n_removed`` counts the chunks that lose lines.

    Every run of lines with more than RUN_WORDS words that occurs before, in the same document or in a smaller id,
    goes whole. So does every repeated chunk of fewer words: a run of lines between content-defined boundaries, two or
    more of which hold a word. Of equal runs, the one with the smallest (doc_id, position) stays. A document may
    come out empty. ``text`` and ``n_chars`` change, if there is such a column; other columns are carried
    along, but for a column ``n_removed``, which is replaced. Null and empty texts and null ids stay as they are. Rows
    with the same id and text count as one document; texts that share an id are compared like those of two ids.
    """
    documents = documents.drop("n_removed")
    at = documents.columns.index("text")
    theirs = [free_name(documents, c) for c in ("id", "version", "gone")]
    joined = documents.join(
        removals(documents).toDF(*theirs), (F.col("doc_id").cast("long") == F.col(theirs[0])) & (F.xxhash64("text") == F.col(theirs[1])), "left"
    ).drop(*theirs[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column(batch.num_columns - 1)
            texts = batch.column(at)
            hit = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False) & texts.is_valid().to_numpy(zero_copy_only=False))
            n = np.zeros(batch.num_rows, np.int64)
            if len(hit):
                some = pa.array(hit)
                cut = [without(t.encode(), [(r["chunk"], r["n"]) for r in g]) for t, g in zip(texts.take(some).to_pylist(), gone.take(some).to_pylist(), strict=True)]
                mask = np.zeros(batch.num_rows, bool)
                mask[hit] = True
                n[hit] = [touched for _, touched in cut]
                texts = pa.compute.replace_with_mask(texts, pa.array(mask), pa.array([t.decode() for t, _ in cut], texts.type))
            removed = pa.array(n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], texts, *batch.columns[at + 1 : -1], removed], [*batch.schema.names[:-1], "n_removed"]
            )

    out = joined.mapInArrow(run, StructType([*documents.schema.fields, StructField("n_removed", LongType())]))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in documents.columns else out
