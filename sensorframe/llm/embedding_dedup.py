"""Near duplicates among vectors: a range join in every subspace finds candidates, the cosine itself decides."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sensorframe.llm.components import connected_components
from sensorframe.llm.textscan import mix
from sensorframe.session import materialize

#: The smallest cosine of a link.
SIMILAR = 0.93

#: Dimensions of a subspace, and how many of them the cells of its range join are cut in.
BLOCK = 8
GRID = 2

#: Vectors of a label that share a hash bucket, on average; two buckets of a cell are compared at a time.
BUCKET = 16384

#: Pairs whose distances are held at once.
CELLS = 1 << 20

#: What rounding may add to squared distances of unit vectors.
SLACK = 1e-9

#: Neighbour cells that a vector visits: of two neighbours, the one with the smaller number sends its vectors to the other.
_VISITS = [o for o in product((-1, 0, 1), repeat=GRID) if o > (0,) * GRID]

_KEY = ["label", "size", "block", *[f"c{g}" for g in range(GRID)], "i", "j"]


@lru_cache(16)
def rotation(size: int) -> np.ndarray:
    """A fixed random rotation, which spreads the distance of two vectors evenly over the subspaces."""
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def bounds(size: int) -> np.ndarray:
    """Where subspaces begin, and the end."""
    return np.append(np.arange(0, size, BLOCK), size)


def budgets(size: int, similar: float) -> np.ndarray:
    """Squared distance that a linked pair has at most in some subspace: each one's share of the whole by its dimensions."""
    return (2 - 2 * similar) * np.diff(bounds(size)) / size + SLACK


def _stack(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length and their vectors in double precision."""
    sizes = column.value_lengths().to_numpy()
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def dealt(classes: DataFrame, similar: float) -> DataFrame:
    """The rows of ``(cls, label, embedding, m, buckets)`` under the keys of all pairs of buckets they take part in.

    In each subspace the first GRID coordinates give a cell, twice the subspace's radius wide. A vector is at home in
    its cell and visits later neighbour cells that its radius reaches into, so any two vectors within the radius meet in a home cell
    of one of them. A home vector in bucket i stands on the left of pairs (i, j) and, for smaller buckets, on the right;
    a visitor in bucket j stands on the right of all (i, j).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, buckets = batch.column("cls").to_numpy(), batch.column("buckets").to_numpy()
            own = (mix(cls.view(np.uint64)) % buckets.view(np.uint64)).view(np.int64)
            for rows, vectors in _stack(batch.column("embedding")):
                size = vectors.shape[1]
                edges, turned = bounds(size), _unit(vectors) @ rotation(size)
                for block, radius in enumerate(np.sqrt(budgets(size, similar) + SLACK).tolist()):
                    x = turned[:, edges[block] : edges[block + 1]][:, :GRID]
                    x = np.pad(x, ((0, 0), (0, GRID - x.shape[1])))
                    home = np.floor(x / (2 * radius)).astype(np.int64)
                    up, down = x + radius >= (home + 1) * 2 * radius, x - radius <= home * 2 * radius
                    home_rows = [(at, home[at], left, right, np.full(len(at), side)) for at, left, right, side in _places(own[rows], buckets[rows])]
                    visits = []
                    for offset in _VISITS:
                        reach = np.ones(len(rows), bool)
                        for g, o in enumerate(offset):
                            reach &= up[:, g] if o > 0 else down[:, g] if o < 0 else True
                        at, left = _each(np.flatnonzero(reach), buckets[rows])
                        visits.append((at, home[at] + np.array(offset), left, own[rows[at]], np.full(len(at), 3)))
                    at, cell, left, right, side = (np.concatenate(v) for v in zip(*home_rows, *visits, strict=True))
                    picked = batch.select(["label", "cls", "m", "embedding"]).take(pa.array(rows[at]))
                    yield pa.RecordBatch.from_arrays(
                        [picked.column("label"), *(pa.array(np.full(len(at), v, np.int32)) for v in (size, block)),
                         *(pa.array(cell[:, g]) for g in range(GRID)), pa.array(left), pa.array(right), pa.array(side.astype(np.int8)),
                         *(picked.column(c) for c in ("cls", "m", "embedding"))],
                        [*_KEY, "side", "cls", "m", "embedding"],
                    )

    fields = classes.schema
    out = ", ".join(f"{c} long" for c in _KEY[3:])
    kind = StructType([
        fields["label"], *StructType.fromDDL(f"size int, block int, {out}, side byte").fields,
        StructField("cls", LongType()), StructField("m", LongType()), fields["embedding"],
    ])
    return classes.mapInArrow(run, kind)


def _each(at: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """These rows with every bucket of their label."""
    n = buckets[at]
    return np.repeat(at, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _places(own: np.ndarray, buckets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Rows, left and right bucket and side of vectors at home: 0 left with its own bucket on the right too, 1 left, 2 right."""
    at, other = _each(np.arange(len(own)), buckets)
    mine = own[at]
    for side, use, left, right in ((0, mine == other, mine, other), (1, mine != other, mine, other), (2, other < mine, other, mine)):
        yield at[use], left[use], right[use], side


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of rows with one key in sorted batches."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(c)[row].as_py() for c in _KEY)

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for c in _KEY:
            column = batch.column(c)
            change |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        starts = np.append(0, np.flatnonzero(change) + 1)
        for n, (low, high) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True)):
            if held and (n or key(held[-1], held[-1].num_rows - 1) != key(batch, 0)):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _links(group: pa.Table, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of linked pairs of a group that no earlier subspace brings together."""
    block, side = group.column("block")[0].as_py(), group.column("side").to_numpy()
    (_, vectors), = _stack(group.column("embedding").combine_chunks())
    unit = _unit(vectors)
    turned, edges, most = unit @ rotation(unit.shape[1]), bounds(unit.shape[1]), budgets(unit.shape[1], similar)
    part = np.ascontiguousarray(turned[:, edges[block] : edges[block + 1]])
    norms = np.einsum("ij,ij->i", part, part)
    left, right = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
    right = right[np.argsort(side[right] == 3, kind="stable")]  # those at home first
    found = []
    step = max(1, CELLS // max(1, len(right)))
    for k in range(0, len(left), step):
        a = left[k : k + step]
        near = norms[a, None] + norms[None, right] - 2 * (part[a] @ part[right].T) <= most[block] + SLACK
        # two of one bucket at home are one pair, met from both sides
        near &= (side[right] >= 2)[None, :] | (a[:, None] < right[None, :])
        i, j = np.nonzero(near)
        for s in range(0, len(i), 1 << 14):
            x, y = a[i[s : s + (1 << 14)]], right[j[s : s + (1 << 14)]]
            linked = np.einsum("ij,ij->i", unit[x], unit[y]) >= similar
            x, y = x[linked], y[linked]
            apart = np.add.reduceat((turned[x] - turned[y]) ** 2, edges[:-1], axis=1) <= most
            first = np.argmax(apart, axis=1) == block
            found.append((x[first], y[first]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _smallest(names: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each name the smallest one that the links between rows ``x`` and ``y`` lead to."""
    order = np.argsort(names)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    x, y, low = rank[x], rank[y], np.arange(len(names))
    while True:
        before = low.copy()
        least = np.minimum(low[x], low[y])
        for ends in (x, y, before[x], before[y]):
            np.minimum.at(low, ends, least)
        low = low[low]
        if (low == before).all():
            return names[order][low[rank]]


def links(classes: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``(cls, hub, n)`` of classes with links: vectors of other classes linked to it, and a class it leads to, per group.

    A pair with a cosine of ``similar`` or more is at a squared distance of ``2 - 2 * similar`` at most, so in one of the
    subspaces at its share at most: there the range join brings the two together. A pair is counted in the first such
    subspace only. ``n`` adds up over groups; ``hub`` keeps every group's linked vectors together without a row per link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            x, y = _links(group, similar)
            if not len(x):
                continue
            cls, m = group.column("cls").to_numpy(), group.column("m").to_numpy()
            n = np.zeros(len(cls), np.int64)
            np.add.at(n, x, m[y])
            np.add.at(n, y, m[x])
            hub, hit = _smallest(cls, x, y), np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(v[hit]) for v in (cls, hub, n)], ["cls", "hub", "n"])

    return dealt(classes, similar).repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(run, "cls long, hub long, n long")


def usable(embedding: str = "embedding") -> Column:
    """Whether a vector has a direction: not null or empty, all components finite, not all zero."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def components(vectors: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``(vec_id, label, embedding)``.

    Vectors with equal labels and a cosine of ``similar`` or more in double precision are linked. Equal vectors of a label are one class,
    compared once and counted by its ids. Null labels, and vectors that are null, empty, zero or hold a null or non-finite component,
    link with nothing, as do vectors of different lengths. Rows that repeat an id and its vector count as one; one id with different
    vectors is one node of the components, and its rows count their own links. A null id links with nothing, has no component
    and is kept. Other columns are not looked at.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", usable().alias("ok"))
    able = rows.where("ok and vec_id is not null and label is not null")
    copies = materialize(able.groupBy("label", "embedding", "vec_id").agg(F.count("*").alias("n")).drop("n"), "copies")
    grouped = copies.groupBy("label", "embedding").agg(F.count("*").alias("m"), F.min("vec_id").alias("rep"))
    classes = materialize(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    sizes = classes.groupBy("label").agg(F.ceil(F.count("*") / BUCKET).alias("buckets"))
    found = materialize(links(classes.join(sizes, "label"), similar), "links")
    names = classes.select(F.col("cls").alias("of"), "rep")
    near = found.where("cls <> hub").select("cls", "hub").distinct().join(names, F.col("cls") == F.col("of")).select(
        F.col("rep").alias("a"), "hub").join(names, F.col("hub") == F.col("of")).select("a", F.col("rep").alias("b"))
    several = copies.groupBy("vec_id").count().where("count > 1").select("vec_id")
    shared = copies.join(several, "vec_id").join(classes, ["label", "embedding"]).select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    joined = connected_components(near.union(shared))
    known = classes.join(found.groupBy("cls").agg(F.sum("n").alias("n")), "cls", "left").join(joined, F.col("rep") == F.col("node"), "left").select(
        "label", "embedding", F.lit(True).alias("ok"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("least")
    )
    answered = rows.join(known, ["label", "embedding", "ok"], "left").withColumn(
        "component_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("least", "vec_id"))
    )
    return answered.select(
        "vec_id", F.when(F.col("vec_id").isNull() | F.col("links").isNull(), 0).otherwise(F.col("links")).cast("long").alias("n_links"),
        "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
