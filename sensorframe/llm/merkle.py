"""Merkle manifest of a dataset: a hash tree per group, a tree over the groups, and a proof for every row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.session import materialize

FANOUT = 8

_SLOTS = [f"s{k}" for k in range(FANOUT)]


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other; null parts count as empty."""
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row's values: each is ``-`` if null, else the length of its text in UTF-8 bytes, ``:`` and its text."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*map(part, fields))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda h, step: digest(step["before"], h, step["after"]))


def proof(path: Column) -> Column:
    """One digest of all siblings on a path, from the leaf's upwards, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""))


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``p``, the position in the group from 0, and ``n``, the rows of the group; null groups are one group.

    Rows are dealt to ranges of ``(group, order)`` and the ranges are written, since drawing them again could draw
    them elsewhere. Positions are counted inside ranges and shifted by the sizes of earlier ones, so a group with most of
    the rows is many ranges. ``order`` must tell equal rows apart, or many of them would be one range.
    """
    drawn = materialize(rows.repartitionByRange(group, *order).withColumn("part", F.spark_partition_id()), "ranges")
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = drawn.groupBy(group, "part").agg(F.count("*").alias("size")).select(
        F.col(group).alias("of"), F.col("part").alias("at"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(whole).alias("n"),
    )
    inside = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order)) - 1
    return drawn.withColumn("p", inside).join(sizes, F.col(group).eqNullSafe(F.col("of")) & (F.col("part") == F.col("at"))).withColumn(
        "p", F.col("start") + F.col("p")
    ).drop("of", "at", "part", "start")


def parents(nodes: DataFrame) -> DataFrame:
    """``(g, p, n, s0, .., h)`` above ``(g, p, n, node)``: the runs of up to FANOUT children of a group that has several nodes.

    A parent's children are spread over the slot columns by conditional aggregates. Its digest is that of the slots
    one after the other; an empty slot adds nothing.
    """
    slot = F.col("p") % FANOUT
    spread = nodes.where("n > 1").groupBy("g", F.floor(F.col("p") / FANOUT).alias("up"), "n").agg(
        *[F.max(F.when(slot == k, F.col("node"))).alias(s) for k, s in enumerate(_SLOTS)]
    )
    return spread.select(
        "g", F.col("up").alias("p"), F.ceil(F.col("n") / FANOUT).alias("n"), *_SLOTS, digest(*[F.col(f"{s}.h") for s in _SLOTS]).alias("h")
    )


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The nodes and each level of parents above them, until every group has one node. A level has an eighth of the rows below."""
    out, left = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while left > 1:
        below = out[-1] if len(out) == 1 else out[-1].select("g", "p", "n", F.struct("h").alias("node"))
        out.append(materialize(parents(below), "level"))
        left = -(-left // FANOUT)
    return out


def roots(tree: list[DataFrame]) -> DataFrame:
    """``(g, h)``: the one node that remains of each group."""
    return reduce(DataFrame.union, [
        level.where("n = 1").select("g", F.col("h" if k else "node.h").alias("h")) for k, level in enumerate(tree)
    ])


def with_paths(tree: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``(node, above, path)`` of the lowest nodes; ``tops`` are ``(g, above, path)`` of the groups' roots.

    From the top down, each parent's path goes to its children. A child's step holds the digests of the slots
    before and after its own.
    """
    tops = tops.select(F.col("g").alias("top"), "above", "path")

    def ends(level: DataFrame, node: str) -> DataFrame:
        at = level.where("n = 1").join(tops, F.col("g").eqNullSafe(F.col("top")))
        return at.select("g", "p", F.expr(node).alias("node"), "above", "path")

    if len(tree) == 1:
        return ends(tree[0], "node").select("node", "above", "path")
    reached = None
    for k in range(len(tree) - 1, 0, -1):
        own = ends(tree[k], "struct(h)")
        reached = own if reached is None else reached.union(own)
        from_above = reached.select(F.col("g").alias("up_g"), F.col("p").alias("up_p"), "above", "path")
        slots = F.array(*[
            F.struct(
                (F.col("p") * FANOUT + i).alias("p"), F.col(s).alias("node"),
                F.struct(*[
                    F.concat_ws("", *[F.col(f"{o}.h") for o in others]).alias(name)
                    for name, others in (("before", _SLOTS[:i]), ("after", _SLOTS[i + 1 :]))
                ]).alias("step"),
            )
            for i, s in enumerate(_SLOTS)
        ])
        met = tree[k].join(from_above, F.col("g").eqNullSafe(F.col("up_g")) & (F.col("p") == F.col("up_p")))
        reached = met.select(
            "g", F.explode(F.filter(slots, lambda x: x["node"].isNotNull())).alias("kid"), "above", "path"
        ).select("g", "kid.p", "kid.node", "above", F.concat(F.array("kid.step"), "path").alias("path"))
    return reached.union(ends(tree[0], "node")).select("node", "above", "path")


def manifest(rows: DataFrame, key: str, group: str, fields: Sequence[str], carry: dict[str, Column] | None = None) -> DataFrame:
    """``(key, *carry, leaf, path, subroot, root)`` of every row.

    Leaves are digests of ``fields``. The leaves of a group, by ascending ``key``, are hashed in runs of FANOUT until one
    node is left, the group's subroot; the subroots, by ascending group, are hashed likewise to the root. ``path``
    has a step for each level from the leaf to the root: the digests of the run's other nodes ``before`` and ``after``.
    ``carry`` are further columns computed from a row that travel with it.

    Null keys and null groups come first; rows with one key are ordered by their leaves, and equal rows in any order, each
    being a leaf. Strings are ordered by their UTF-8 bytes. A lone row is its group's subroot, a lone group's
    subroot the root, with no step. An empty table gives no row. Other columns are not looked at.
    """
    carried = carry or {}
    leaves = materialize(rows.select(
        F.col(group).alias("g"), F.col(key).alias("key"), leaf([F.col(f) for f in fields]).alias("h"),
        F.struct(*[c.alias(name) for name, c in carried.items()] or [F.lit(None).cast("string").alias("none")]).alias("more"),
        F.xxhash64(F.monotonically_increasing_id()).alias("tie"),
    ), "leaves")
    own = numbered(leaves, "g", ["key", "h", "tie"]).select("g", "p", "n", F.struct("h", "key", "more").alias("node"))
    tree = levels(materialize(own, "nodes"))
    subroots = materialize(roots(tree), "subroots").select(F.lit(0).alias("all"), F.col("g").alias("key"), "h")
    over = numbered(subroots, "all", ["key"]).select(F.col("all").alias("g"), "p", "n", F.struct("h", "key").alias("node"))
    top_tree = levels(materialize(over, "nodes"))
    root = roots(top_tree).first()
    step = "array<struct<before: string, after: string>>"
    start = rows.sparkSession.range(1).select(
        F.lit(0).alias("g"), F.lit(None).cast("string").alias("above"), F.array().cast(step).alias("path")
    )
    tops = materialize(
        with_paths(top_tree, start).select(F.col("node.key").alias("g"), F.col("node.h").alias("above"), "path"), "tops"
    )
    return with_paths(tree, tops).select(
        F.col("node.key").alias(key), *[F.col("node.more")[name].alias(name) for name in carried], F.col("node.h").alias("leaf"),
        "path", F.col("above").alias("subroot"), F.lit(root["h"] if root else None).cast("string").alias("root"),
    )
