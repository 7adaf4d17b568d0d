"""Near duplicates by SimHash: pigeonhole blocks find the fingerprints that may be close, bit flips link them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.components import connected_components
from sensorframe.session import materialize

#: Words in a shingle, hash seed, and the largest number of differing bits of a link.
SHINGLE = 3
SEED = 42
MAX_BITS = 2

#: The 64 bits are cut into four blocks. Two fingerprints that differ in at most two bits agree in two whole blocks.
BLOCK_BITS = 16
KEPT_BLOCKS = list(combinations(range(4), 2))


def fingerprint(text: bytes, piece: int = 1 << 16, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the lower-cased shingles of a UTF-8 text, repeats included; 0 without words."""
    joined = b" ".join(text.lower().split())  # both treat exactly A-Z and the bytes 9 to 13 and 32
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(joined))
    if len(starts) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), piece):
        spans = zip(starts[k : k + piece].tolist(), ends[k : k + piece].tolist(), strict=True)
        h = np.array([digest(joined[i:j], SEED) for i, j in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint of every whole text as a signed long; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            fps = np.array([fingerprint(t.as_py() or b"") for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _mask(blocks: tuple[int, ...]) -> int:
    bits = sum(((1 << BLOCK_BITS) - 1) << (BLOCK_BITS * k) for k in blocks)
    return bits - (1 << 64) if bits >> 63 else bits


def _flip(bit: int) -> int:
    return -(1 << 63) if bit == 63 else 1 << bit


def links(classes: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between the ``rep`` of different fingerprints, with the components of all close pairs.

    ``classes`` are ``(fp, rep)``, one row a fingerprint. Each fingerprint is put under a key for every
    choice of two blocks. Fingerprints alone under a key are dropped: they have no partner there. The others
    are put under themselves and each one-bit change outside the key's blocks; two of them meet under such a
    change exactly if they differ in at most two bits. All that meet are linked to the smallest of them, so
    a crowded block costs a row for each member and change, never one for each pair. The distance of
    every edge is verified at the end.
    """
    keyed = classes.select(
        "fp", "rep",
        F.explode(F.array(*[
            F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(_mask(c))).alias("part"))
            for k, c in enumerate(KEPT_BLOCKS)
        ])).alias("key"),
    ).select("fp", "rep", "key.choice", "key.part")
    shared = keyed.groupBy("choice", "part").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    meeting = keyed.join(shared, ["choice", "part"])
    changes = [
        F.when(F.col("choice") == k, F.array(F.col("fp"), *[
            F.col("fp").bitwiseXOR(F.lit(_flip(i))) for i in range(64) if i // BLOCK_BITS not in c
        ]))
        for k, c in enumerate(KEPT_BLOCKS)
    ]
    near = meeting.select("fp", "rep", F.explode(F.coalesce(*changes)).alias("centre")).distinct()
    stars = near.groupBy("centre").agg(F.min(F.struct("rep", "fp")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    return (
        near.join(stars, "centre").where("rep <> hub.rep")
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub.fp"))) <= MAX_BITS)
        .select(F.col("rep").alias("a"), F.col("hub.rep").alias("b"))
    )


def components(documents: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row.

    Documents with equal fingerprints, and with fingerprints at most two bits apart, are linked;
    ``component_id`` is the smallest doc_id reachable. Empty and null texts have fingerprint zero and are
    linked like any other. A row with a null id has its fingerprint, links nothing, and takes the component
    of its fingerprint (null if no row with an id has it). Repeated rows stay.
    """
    rows = materialize(fingerprints(documents), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    joined = connected_components(links(classes.where("rep is not null")))
    labels = classes.join(joined, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return rows.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(documents: DataFrame) -> DataFrame:
    """The documents that are the smallest id of their component; rows with a null id stay.

    Only ids travel to find them; the texts are shuffled once, in the join on the id. Repeated rows of a
    kept id stay together, as they are one document.
    """
    extra = components(documents).where("doc_id <> component_id").select("doc_id").distinct()
    return documents.join(extra, "doc_id", "left_anti")
