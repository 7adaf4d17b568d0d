"""Ranked lexical search: documents cut down to the items' words, equal bags of words scored once."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorframe.llm.textscan import blocks
from sensorframe.operators import top_rows_per_group
from sensorframe.session import materialize

TOP = 10

#: Items are looked up in passes. A pass ends once its items have so many terms, each counted once an item.
PASS_TERMS = 200_000

#: Classes are scored in pieces of at most so many (class, item) cells and of about as many postings.
CELLS = 1 << 20

#: Bytes that end a term: all of ASCII but digits and letters.
SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _lowered(column: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def term_rows(items: DataFrame) -> DataFrame:
    """Distinct ``(item_id, h)``: hashes of the terms of every item; rows with one id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(_lowered(batch.column("text")), spaces=SEPARATOR):
                ids = batch.column("item_id").take(pa.array(b.first + b.word_row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(b.word_hashes().view(np.int64))], ["item_id", "h"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, h long").distinct()


@dataclass
class Pass:
    """Some items: their ids, and for every term of theirs its hash and the items that have it."""

    ids: list
    terms: np.ndarray
    starts: np.ndarray
    owners: np.ndarray


def passes(items: DataFrame, most: int = PASS_TERMS) -> Iterator[Pass]:
    """The items in passes of about ``most`` terms, one pass in the driver at a time.

    Items are dealt to passes by running totals of their terms; a single item with more terms is a pass of its own.
    """
    terms = materialize(term_rows(items), "item-terms")
    sizes = materialize(terms.groupBy("item_id").agg(F.count("*").alias("size"), F.xxhash64("item_id").alias("o")), "item-sizes")
    # totals by hash range first, so that no window sees more than the items of one range
    ranges = sizes.groupBy(F.shiftright("o", 48).alias("r")).agg(F.sum("size").alias("all"))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("r", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("r").orderBy("o", "item_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("r", F.shiftright("o", 48)).withColumn("done", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, "r")
    dealt = materialize(placed.select(F.col("item_id").alias("of"), F.floor((F.col("start") + F.col("done")) / most).alias("pass")), "item-passes")
    numbers = dealt.groupBy("pass").count().orderBy("pass").select("pass").toLocalIterator()
    for number in [r["pass"] for r in numbers]:
        mine = dealt.where(F.col("pass") == number).select("of")
        got = terms.join(mine, F.col("item_id").eqNullSafe(F.col("of"))).select("item_id", "h").toArrow()
        ids = got.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        h, item = got.column("h").to_numpy(), ids.indices.to_numpy()
        order = np.lexsort((item, h))
        known, starts_at = np.unique(h[order], return_index=True)
        yield Pass(ids.dictionary.to_pylist(), known, np.append(starts_at, len(h)), item[order])


def bags(documents: DataFrame, terms: np.ndarray) -> DataFrame:
    """``(doc_id, n, bag)`` of every row: its terms with repeats, and the known ones as pairs of term number and count.

    ``terms`` are the sorted hashes of the known terms. The pairs are 32-bit numbers by ascending term; the bag is
    empty if no known term occurs. A term is known by its 64-bit hash.
    """
    shared = documents.sparkSession.sparkContext.broadcast(terms)  # at most PASS_TERMS and one item's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for b in blocks(_lowered(batch.column("text")), spaces=SEPARATOR):
                h = b.word_hashes().view(np.int64)
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                key, counts = np.unique(b.word_row[hit].astype(np.int64) << 32 | at[hit], return_counts=True)
                pairs = np.column_stack([key & 0xFFFFFFFF, counts]).astype("<u4")
                bounds = np.searchsorted(key >> 32, np.arange(b.n_rows + 1)).astype(np.int64) * 8
                bag = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.n_rows, [None, pa.py_buffer(bounds), pa.py_buffer(pairs)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(b.first, b.n_rows), pa.array(b.words_per_row()), bag.cast(pa.binary())], ["doc_id", "n", "bag"]
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, bag binary")


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of every pair in a column of bags."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], "<u4", (offsets[-1] - offsets[0]) // 4, offsets[0]).reshape(-1, 2)
    row = np.repeat(np.arange(len(column)), np.diff(offsets) // 8)
    return row, flat[:, 0].astype(np.int64), flat[:, 1].astype(np.int64)


def document_counts(classes: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term; every task sends its counts by term, never its classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            row, term, _ = _pairs(batch.column("bag"))
            np.add.at(total, term, batch.column("size").to_numpy()[row])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["term", "df"])

    sums = classes.select("bag", "size").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(n_terms, np.int64)
    df[sums.column("term").to_numpy()] = sums.column("df").to_numpy()
    return df


def _best(item: np.ndarray, score: np.ndarray, first: np.ndarray, cls: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    """The ``top`` best rows of every item, by descending score and ascending first document."""
    order = np.lexsort((first, -score, item))
    item = item[order]
    opens = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
    place = np.arange(len(item)) - np.repeat(opens, np.diff(np.append(opens, len(item))))
    kept = order[place < top]
    return item[place < top], score[kept], first[kept], cls[kept]


def _pieces(costs: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows whose costs add up to ``most``, or one row that costs more; at most ``rows`` at once."""
    done, low = np.append(0, np.cumsum(costs)), 0
    while low < len(costs):
        high = min(max(low + 1, int(np.searchsorted(done, done[low] + most, "right")) - 1), low + rows)
        yield low, high
        low = high


def scored(classes: DataFrame, found: Pass, weights: np.ndarray, top: int = TOP) -> DataFrame:
    """``(item, score, first, cls)``: every task's ``top`` best classes for every item, with a score above 0.

    ``classes`` are ``(cls, first, m, bag)``. The postings of the bags' terms give the score of a class for
    all items at once; a task keeps its best rows only, so it sends ``top`` rows an item at most.
    """
    shared = classes.sparkSession.sparkContext.broadcast((weights, found.starts, found.owners, len(found.ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, starts, owners, n_items = shared.value
        postings = np.diff(starts)
        best = tuple(np.zeros(0, np.int64) for _ in range(4))
        least = np.zeros(n_items, np.int64)
        for batch in batches:
            cls, first, m = (batch.column(c).to_numpy() for c in ("cls", "first", "m"))
            row, term, tf = _pairs(batch.column("bag"))
            gain = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
            for low, high in _pieces(np.bincount(row, postings[term], batch.num_rows), CELLS, max(1, CELLS // n_items)):
                a, z = np.searchsorted(row, (low, high))
                each = postings[term[a:z]]
                shift = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                cell = np.repeat((row[a:z] - low) * n_items, each) + owners[np.repeat(starts[term[a:z]], each) + shift]
                total = np.zeros((high - low) * n_items, np.int64)
                np.add.at(total, cell, np.repeat(gain[a:z], each))
                total = total.reshape(high - low, n_items)
                r, i = np.nonzero((total >= least) & (total > 0))
                new = i, total[r, i], first[low + r], cls[low + r]
                best = _best(*(np.concatenate(x) for x in zip(best, new, strict=True)), top)
                full = np.bincount(best[0], minlength=n_items) == top
                lowest = np.zeros(n_items, np.int64)
                lowest[best[0]] = best[1]  # an item's rows come by descending score, so its last one stays
                least = np.where(full, lowest, 0)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["item", "score", "first", "cls"])

    return classes.select("cls", "first", "m", "bag").mapInArrow(run, "item long, score long, first long, cls long")


def search_pass(documents: DataFrame, found: Pass, top: int = TOP) -> DataFrame:
    """``(item, rank, doc_id, score)`` of the items of one pass."""
    spark: SparkSession = documents.sparkSession
    rows = materialize(bags(documents, found.terms), "bags")
    n_docs, n_terms = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.lit(10) + F.expr(f"(90 * n * {n_docs}L) div {max(n_terms, 1)}L")
    held = rows.where(F.length("bag") > 0).withColumn("m", m).withColumn("h", F.xxhash64("m", "bag"))
    last = F.lit(2**63 - 1)  # a missing id comes after all others
    grouped = held.groupBy("h", "m", "bag").agg(F.count("*").alias("size"), F.min(F.coalesce("doc_id", last)).alias("first"))
    classes = materialize(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    df = document_counts(classes, len(found.terms))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    best = top_rows_per_group(scored(classes, found, weights, top), ["item"], "score", top, ["first", "cls"])
    winners = materialize(best, "winners")
    won = classes.join(winners.select("cls").distinct(), "cls").select("cls", "h", "m", "bag")
    members = top_rows_per_group(
        held.select("h", "m", "bag", "doc_id", F.lit(0).alias("same")).join(won, ["h", "m", "bag"]).select("cls", "doc_id", "same"),
        ["cls"], "same", top, [F.asc_nulls_last("doc_id")],
    )
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = winners.join(members, "cls").withColumn("rank", place).where(F.col("rank") <= top)
    return materialize(ranked.select("item", "rank", "doc_id", "score"), "ranked")


def search(documents: DataFrame, items: DataFrame, top: int = TOP, pass_terms: int = PASS_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents with the highest score above 0 for every item.

    Terms are runs of ASCII letters and digits and of other characters beyond ASCII, A-Z lower-cased. A document
    counts only with those of the items of a pass. Documents with equal counts of these and equal length norm ``m`` have equal scores
    for all items: they are one class, found by hash and by comparing the counts themselves, and scored once. The best ``top``
    classes by score and smallest id hold the best ``top`` documents, and of a class its ``top`` smallest ids suffice.

    Null and empty texts have no term: such a document counts nowhere, such an item has no row. Rows of documents that share
    an id are documents of their own, and a null id comes last among equal scores. Rows of items that share an id are one
    item; a null id is one item too. Empty tables give no row. Other columns are not looked at.
    """
    spark = documents.sparkSession
    kind = items.schema["item_id"].dataType
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    for found in passes(items, pass_terms):
        ids = spark.createDataFrame(list(enumerate(found.ids)), f"item long, item_id {kind.simpleString()}")
        out = out.union(search_pass(documents, found, top).join(ids, "item").select("item_id", "rank", "doc_id", "score"))
    return out
