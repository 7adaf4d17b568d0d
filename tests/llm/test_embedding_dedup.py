"""Near duplicates among vectors: against all pairs, around the threshold, with crowded buckets, and edge rows."""

import math

import numpy as np
import pytest
from common import shipped  # noqa: F401
from compare import duck, duck_result, spark_result
from conftest import SF

from sensorframe.llm import embedding_dedup, queries


def table(spark, rows, kind="float"):
    extra = "cls long, size long, block int, m long, n string, rep long, ok string, links long, side int, component_id long, hub long"
    return spark.createDataFrame([(i, lab, v, *[1, 1, 1, 1, "n", 1, "o", 1, 1, 1, 1]) for i, lab, v in rows], f"vec_id long, label int, embedding array<{kind}>, {extra}")


def expected(rows, similar=0.93):
    """vec_id, n_links, component_id, kept of every row, by comparing all pairs of distinct vectors."""
    def usable(i, lab, v):
        return i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    nodes = sorted({(i, lab, tuple(v)) for i, lab, v in rows if usable(i, lab, v)})
    unit = [np.array(v, np.float64) / np.abs(v).max() for _, _, v in nodes]
    unit = [v / math.sqrt(float(v @ v)) for v in unit]
    count, least = dict.fromkeys(nodes, 0), {i: i for i, _, _ in nodes}
    pairs = []
    for x in range(len(nodes)):
        for y in range(x):
            a, b = nodes[x], nodes[y]
            if a[1] == b[1] and len(a[2]) == len(b[2]) and float(unit[x] @ unit[y]) >= similar:
                count[a] += 1
                count[b] += 1
                pairs.append((a[0], b[0]))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            changed |= low != least[a] or low != least[b]
            least[a] = least[b] = low
    out = []
    for i, lab, v in rows:
        ok = usable(i, lab, v)
        out.append((i, count[i, lab, tuple(v)] if ok else 0, least.get(i, i), i is None or least.get(i, i) == i))
    return sorted(out, key=repr)


def got(spark, rows, kind="float", **more):
    df = embedding_dedup.components(table(spark, rows, kind), **more)
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def f32(v):
    return [float(x) for x in np.asarray(v, np.float32)]


def at_cosine(rng, v, cosine):
    v = v / np.linalg.norm(v)
    w = rng.standard_normal(len(v))
    w -= (w @ v) * v
    return cosine * v + math.sqrt(1 - cosine * cosine) * w / np.linalg.norm(w)


def test_around_the_threshold_and_scales(spark, shipped):  # noqa: F811
    """Pairs just above and below, chains, other lengths of the same direction, and opposite vectors."""
    rng, rows = np.random.default_rng(3), []
    for k in range(60):
        base = rng.standard_normal(64)
        for cosine in (0.93 + 2e-5, 0.93 - 2e-5, 0.95, 0.5):
            rows.append((len(rows), k % 3, f32(at_cosine(rng, base, cosine) * rng.uniform(0.01, 50))))
        rows.append((len(rows), k % 3, f32(base)))
        step = base
        for _ in range(3):
            step = at_cosine(rng, step, 0.94)
            rows.append((len(rows), k % 3, f32(step)))
    rows.append((len(rows), 0, f32(-np.array(rows[0][2]))))
    assert got(spark, rows) == expected(rows)


@pytest.mark.parametrize("size", [1, 3, 8, 11, 30])
def test_any_length(spark, shipped, size):  # noqa: F811
    rng, rows = np.random.default_rng(size), []
    for k in range(25):
        base = rng.standard_normal(size)
        rows += [(5 * k, 1, f32(base)), (5 * k + 1, 1, f32(base + 0.2 * rng.standard_normal(size))), (5 * k + 2, 1, f32(base * 3))]
    assert got(spark, rows, "double") == expected(rows)


def test_crowded_buckets_count_every_link_once(spark, shipped, monkeypatch):  # noqa: F811
    """A third of all rows are near copies of one vector; with buckets of 16 they meet over many pairs of buckets."""
    monkeypatch.setattr(embedding_dedup, "BUCKET", 16)
    rng = np.random.default_rng(9)
    base = rng.standard_normal(64)
    rows = [(3 * i, 7, f32(base + 0.1 * rng.standard_normal(64))) for i in range(120)]
    rows += [(3 * i + 1, 7 + i % 2, f32(rng.standard_normal(64))) for i in range(240)]
    rows += [(2000 + i, 7, rows[5][2]) for i in range(40)]  # equal vectors are one class with 41 ids
    assert got(spark, rows) == expected(rows)


def test_awkward_rows(spark, shipped):  # noqa: F811
    v, w = f32(np.arange(1, 65)), f32(np.arange(64, 0, -1))
    rows = [
        (1, 1, v), (2, 1, v), (2, 1, v), (3, None, v), (4, None, v), (None, 1, v), (None, None, None), (5, 1, None), (6, 1, []), (7, 1, [0.0] * 64),
        (8, 1, [-0.0] * 64), (9, 1, [None, *v[1:]]), (10, 1, [float("nan"), *v[1:]]), (11, 1, [float("inf"), *v[1:]]), (12, 1, v[:32]), (13, 1, v[:32]),
        (14, 2, w), (15, 2, w), (15, 3, v), (16, 3, v), (17, 1, [1e30] * 64), (18, 1, [1e-30] * 64), (19, 1, f32(np.array(v) * 1e-36)),
    ]
    assert got(spark, rows) == expected(rows)


def test_empty_table_and_other_threshold(spark, shipped):  # noqa: F811
    assert got(spark, []) == []
    rng = np.random.default_rng(1)
    rows = [(i, 1, f32(rng.standard_normal(64) + (i % 2) * 2)) for i in range(60)]
    assert got(spark, rows, similar=0.7) == expected(rows, 0.7)


def test_budgets_cover_the_whole_distance():
    for size in (1, 7, 8, 9, 64, 100):
        assert embedding_dedup.budgets(size, 0.93).sum() >= 0.14
        q = embedding_dedup.rotation(size)
        assert np.allclose(q @ q.T, np.eye(size))


def test_given_vectors(spark):
    assert spark_result(queries.op12_embedding_dedup(spark, SF)) == duck_result(duck(SF), queries.ORACLES["op12_embedding_dedup"])
