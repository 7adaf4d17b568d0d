"""Near duplicates by similarity: SimHash fingerprints and MinHash bands find candidates, the exact Jaccard index of five-word shingles decides."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm import simhash
from sensorframe.llm.components import connected_components
from sensorframe.llm.textscan import blocks, mix, windows
from sensorframe.session import materialize

#: Words in a shingle, and the smallest similarity of a link.
SHINGLE = 5
SIMILAR = 0.8

#: A pair at 0.8 shares none of 20 bands of 5 minima with a chance of 0.0004.
BANDS, ROWS = 20, 5

#: All pairs of a bucket are compared up to this many members. In larger ones members are compared with two of them, and those that
#: are then not all linked are searched exactly by their rarest shingles.
ALL_PAIRS = 16

#: Shingles are counted in so many counters, 8 MB, to tell frequent ones.
COUNTERS = 1 << 20

_FACTORS = np.random.default_rng(5).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _lowered(column: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def signatures(documents: DataFrame) -> DataFrame:
    """``(doc_id, same, fp, bands)``: a 128-bit hash of the lower-cased words, the SimHash, and a key for every band, none if under five words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _lowered(batch.column("text"))
            words = [b" ".join(t.as_py().split()) for t in texts.cast(pa.large_binary())]
            same = [blake2b(w, digest_size=16).digest() for w in words]
            fps = np.array([simhash.fingerprint(w, shingle=SHINGLE) for w in words], np.uint64).view(np.int64)
            keys = [None] * len(texts)
            for b in blocks(texts):
                at, h = windows(b.word_hashes(), b.word_row, SHINGLE)
                if not len(at):
                    continue
                row = b.word_row[at]
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                bands = np.zeros((len(first), BANDS), np.uint64)
                for k in range(BANDS):
                    bands[:, k] = k + 1
                    for f in _FACTORS[k * ROWS : (k + 1) * ROWS]:
                        bands[:, k] = mix(bands[:, k] * _STEP + np.minimum.reduceat(h * f, first))
                for r, x in zip((b.first + row[first]).tolist(), bands.view(np.int64).tolist(), strict=True):
                    keys[r] = x
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(same, pa.binary()), pa.array(fps), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "same", "fp", "bands"],
            )

    return documents.mapInArrow(run, "doc_id long, same binary, fp long, bands array<long>")


def close(classes: DataFrame) -> DataFrame:
    """``(a, b)``, a below b, of ``(rep, fp)``: all whose fingerprints differ in at most two bits are in one component of these.

    Texts of one fingerprint are paired with the first of them, fingerprints by ``simhash.links``: rows for each member, never one
    for each pair.
    """
    firsts = materialize(classes.groupBy("fp").agg(F.min("rep").alias("rep")), "fingerprints")
    equal = classes.join(firsts.withColumnRenamed("rep", "a"), "fp").where("a < rep").select("a", F.col("rep").alias("b"))
    return equal.union(simhash.links(firsts).select(F.least("a", "b"), F.greatest("a", "b")))


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct ``(a, b)``, a below b, that share a bucket of ``(rep, bands)``, and ``(key, rep)`` of the crowded buckets.

    Of a crowded bucket the pairs are each member's with two hubs: two rows for each member, never one for each pair.
    """
    rows = classes.select("rep", F.explode("bands").alias("key"))
    order = F.struct(F.xxhash64("rep", "key").alias("o"), "rep")
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(order).alias("low"), F.max(order).alias("high")).where("n > 1")
    meeting = materialize(rows.join(materialize(shared, "buckets"), "key"), "meeting")
    few = meeting.where(F.col("n") <= ALL_PAIRS).select("key", "rep")
    pairs = few.withColumnRenamed("rep", "a").join(few.withColumnRenamed("rep", "b"), "key").where("a < b").select("a", "b")
    crowded = meeting.where(F.col("n") > ALL_PAIRS)
    stars = crowded.select("rep", F.explode(F.array("low.rep", "high.rep")).alias("hub")).where("rep <> hub")
    return pairs.union(stars.select(F.least("rep", "hub"), F.greatest("rep", "hub"))).distinct(), crowded.select("key", "rep")


def unsettled(crowded: DataFrame, known: DataFrame) -> DataFrame:
    """``(doc_id, c)`` of the members of crowded buckets that hold several components; ``known`` are ``(node, component)``."""
    placed = crowded.join(known, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
    return placed.join(mixed, "key").select(F.col("rep").alias("doc_id"), "c").distinct()


def counters(held: DataFrame) -> np.ndarray:
    """How many of the sets have a shingle of each counter; a task sends its counters, never its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            h = np.frombuffer(b"".join(batch.column("set").to_pylist()), np.uint64)
            total += np.bincount((h % np.uint64(COUNTERS)).view(np.int64), minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["at", "k"])

    sums = held.select("set").mapInArrow(run, "at long, k long").groupBy("at").agg(F.sum("k").alias("k")).toArrow()
    total = np.zeros(COUNTERS, np.int64)
    total[sums.column("at").to_numpy()] = sums.column("k").to_numpy()
    return total


def rare_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct ``(a, b)``, a below b, of members in different components; every similar pair of these is among them.

    All sets are ordered alike, shingles with low counters first. If two sets of m and n shingles are
    similar, they share ``4 / 9 * (m + n)`` or more. So their first common shingle stands so early in both that as many follow, in the
    first fifth of each and the first ninth of the smaller one, and meeting on shingles at such places loses no pair, whatever the
    order. Shingles of a template that many members share stand behind those that tell the members apart. Of the members that meet on a
    shingle, those outside the component most of them are in are paired with the others, so linked copies are not paired again.
    """
    held = materialize(members.join(sets, "doc_id").select("doc_id", "c", "set"), "unsettled-sets")
    frequent = members.sparkSession.sparkContext.broadcast(counters(held))  # COUNTERS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, s in enumerate(batch.column("set")):
                h = np.frombuffer(s.as_py(), np.uint64)
                early = h[np.lexsort((h, frequent.value[h % np.uint64(COUNTERS)]))][: len(h) // 5 + 1]
                again = pa.array(np.full(len(early), row))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(again), batch.column("c").take(again), pa.array(np.full(len(early), len(h))),
                     pa.array(early.view(np.int64)), pa.array(np.arange(len(early)))], ["doc_id", "c", "n", "h", "i"]
                )

    postings = materialize(held.mapInArrow(run, "doc_id long, c long, n long, h long, i long"), "postings")
    by_component = postings.groupBy("h", "c").agg(F.count("*").alias("k"), F.max(F.expr("9 * i <= n")).alias("early"))
    met = by_component.groupBy("h").agg(F.max_by("c", F.struct("k", "c")).alias("most"), F.count("*").alias("parts"), F.max("early").alias("early"))
    met = materialize(met.where("parts > 1 and early").select("h", "most"), "met")
    others = postings.join(met, "h").where("c <> most").select("h", *[F.col(x).alias(f"{x}_a") for x in ("doc_id", "c", "n", "i")])
    reach = "c <> c_a and 9 * (n - i) >= 4 * (n + n_a) and 9 * (n_a - i_a) >= 4 * (n + n_a)"
    return others.join(postings, "h").where(reach).select(F.least("doc_id", "doc_id_a").alias("a"), F.greatest("doc_id", "doc_id_a").alias("b")).distinct()


def shingles(documents: DataFrame) -> DataFrame:
    """``(doc_id, set)``: the sorted distinct shingle hashes of every document of five or more words, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, sets = batch.column("doc_id"), [], []
            for b in blocks(_lowered(batch.column("text"))):
                at, h = windows(b.word_hashes(), b.word_row, SHINGLE)
                bounds = np.searchsorted(b.word_row[at], np.arange(b.n_rows + 1))
                for r in np.flatnonzero(np.diff(bounds)):
                    rows.append(b.first + int(r))
                    sets.append(np.unique(h[bounds[r] : bounds[r + 1]]).tobytes())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(sets, pa.binary())], ["doc_id", "set"])

    return documents.mapInArrow(run, "doc_id long, set binary")


def similar(x: bytes, y: bytes) -> bool:
    """Whether two sets have at least SIMILAR of their union in common."""
    if min(len(x), len(y)) < SIMILAR * max(len(x), len(y)):
        return False
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILAR * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``(a, b)`` whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            use = pa.array([similar(i.as_py(), j.as_py()) for i, j in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(use), batch.column("b").filter(use)], ["a", "b"])

    x, y = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(documents: DataFrame) -> DataFrame:
    """Distinct ``(doc_id, component_id)`` of every id: documents of equal words or of similarity SIMILAR and more are linked.

    ``component_id`` is the smallest doc_id reachable. Candidates are texts with SimHash fingerprints at most two bits apart and, as most
    similar texts are further apart, those that share a MinHash band. Each node's one candidate is verified first; of the other candidates
    only those between different components are left to verify, so a large group of copies costs few sets. Members of crowded
    buckets that are in different components after that are searched by their rarest shingles.

    Null and empty texts have no words and are linked with each other; texts of fewer than five words are linked with equal ones only. Null ids
    are left out, an id with several texts links the components of all of them, repeated rows count once. An empty table
    gives no row. Other columns are not looked at.
    """
    documents = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(signatures(documents), "signatures")
    firsts = [F.first(c).alias(c) for c in ("fp", "bands")]
    classes = materialize(rows.groupBy("same").agg(F.min("doc_id").alias("rep"), *firsts), "classes")
    long = classes.where("bands is not null")
    found, crowded = candidates(long.select("rep", "bands"))
    pairs = materialize(close(long.select("rep", "fp")).union(found).distinct(), "candidates")
    crowded = materialize(crowded, "crowded")
    involved = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = materialize(shingles(documents.join(involved, "doc_id")), "sets")
    one = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    first = materialize(verified(one, sets), "links")
    joined = materialize(connected_components(first), "joined")
    ca, cb = joined.select(F.col("node").alias("a"), F.col("component").alias("ca")), joined.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    rest = pairs.join(ca, "a", "left").join(cb, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    near = materialize(first.union(verified(rest, sets)), "links")
    known = materialize(connected_components(near), "joined")
    third = materialize(verified(rare_pairs(materialize(unsettled(crowded, known), "unsettled"), sets), sets), "links")
    # one id with several texts is one document: its classes are linked through it
    own = rows.join(classes.select("same", "rep"), "same").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    # what is known already stands for its links
    settled = known.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    labels = connected_components(settled.union(third).union(own))
    return rows.select("doc_id").distinct().join(labels, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("component_id")
    )


def keep_first(documents: DataFrame) -> DataFrame:
    """The documents that are the smallest id of their component; rows with a null id stay, repeated rows of a kept id too."""
    extra = components(documents).where("doc_id <> component_id").select("doc_id")
    return documents.join(extra, "doc_id", "left_anti")
