import random
import re

import pytest
import xxhash
from common import AWKWARD, documents, rows, shipped  # noqa: F401
from conftest import SF

from sensorframe.llm import simhash
from sensorframe.llm.components import connected_components
from sensorframe.llm.queries import QUERIES


def reference(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(items, linked):
    """Smallest item reachable, by brute force."""
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in items}


def test_fingerprints_and_components_of_given_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op6_simhash"](spark, SF).collect()}
    fps = {i: int(r.fingerprint, 16) for i, r in got.items()}
    assert set(got) == set(texts)
    for i in sorted(texts)[:150]:
        assert fps[i] == reference(texts[i]) and len(got[i].fingerprint) == 16
    expected = groups(sorted(texts), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert {i: r.component_id for i, r in got.items()} == expected


def test_links_of_crowded_blocks_chains_and_sign_bits(spark, shipped):  # noqa: F811
    rng = random.Random(1)
    centre, fps = rng.getrandbits(64), set()
    for _ in range(150):  # many in one block
        fps.add(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    x = rng.getrandbits(64)
    for b in (0, 15, 16, 31, 32, 47, 48, 62, 63):  # a chain over all blocks
        fps.add(x := x ^ (1 << b) ^ (1 << (b + 5) % 64))
    fps |= {rng.getrandbits(64) for _ in range(200)} | {0, 1 << 63, 3 << 62, 7 << 61}
    ids = {i: f for i, f in enumerate(sorted(fps))}
    classes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in ids.items()], "fp long, rep long")
    edges = simhash.links(classes).collect()
    assert all((ids[e.a] ^ ids[e.b]).bit_count() <= 2 for e in edges)
    got = {r.node: r.component for r in connected_components(simhash.links(classes)).collect()}
    expected = groups(list(ids), lambda a, b: (ids[a] ^ ids[b]).bit_count() <= 2)
    assert {i: got.get(i, i) for i in ids} == expected


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(70)], [(0, i) for i in range(1, 60)] + [(90, 91), (91, 90), (90, 91)]])
def test_components_of_chains_and_stars(spark, edges):
    nodes = {x for e in edges for x in e if None not in e and e[0] != e[1]}
    linked = {tuple(sorted(e)) for e in edges if None not in e}
    got = rows(connected_components(spark.createDataFrame(edges, "a long, b long")))
    assert got == sorted(groups(sorted(nodes), lambda a, b: (a, b) in linked).items(), key=repr)


def test_awkward_rows(spark, shipped):  # noqa: F811
    got = simhash.components(documents(spark)).collect()
    assert len(got) == len(AWKWARD)
    by_id = {r.doc_id: (r.fingerprint, r.component_id) for r in got if r.doc_id is not None}
    assert by_id[1] == by_id[2] == by_id[3] == ("0" * 16, 1)
    assert by_id[4] == by_id[5] and by_id[4][1] == 4
    assert {r.component_id for r in got if r.doc_id is None} == {1, 4}
    kept = simhash.keep_first(documents(spark))
    assert kept.schema == documents(spark).schema
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 2 and 5 not in ids and 2 not in ids and ids.count(None) == 2


def test_empty_and_all_null(spark, shipped):  # noqa: F811
    assert simhash.components(documents(spark, [])).count() == 0
    got = simhash.components(documents(spark, [(None, None), (None, "a b c")])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, None)}


def test_long_text_is_hashed_in_pieces():
    text = " ".join(f"w{i % 977}" for i in range(5000))
    assert simhash.fingerprint(text.encode(), 100) == simhash.fingerprint(text.encode()) == reference(text)


def test_stars_take_no_step(spark, monkeypatch):
    from sensorframe.llm import components

    steps, star = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda edges: steps.append(1) or star(edges))
    found = connected_components(spark.createDataFrame([(1, 5), (6, 1), (2, 7), (7, 2), (3, 3), (None, 1)], "a long, b long"))
    assert rows(found) == [(1, 1), (2, 2), (5, 1), (6, 1), (7, 2)] and not steps
    assert rows(connected_components(spark.createDataFrame([(1, 5), (5, 6)], "a long, b long"))) == [(1, 1), (5, 1), (6, 1)] and steps == [1]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0 and steps == [1]
