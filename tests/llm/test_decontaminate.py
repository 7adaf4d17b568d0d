import gc
import random
import weakref

import numpy as np
import pyarrow as pa
import pytest
from common import WORDS, documents, prose, rows, shipped  # noqa: F401
from conftest import SF

from sensorframe.llm import decontaminate
from sensorframe.llm.queries import QUERIES


def distance(a, b):
    """Edit distance of ``a`` to the best run of ``b``, by the full table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def words(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()


def test_best_end_matches_the_full_table():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        b = [rng.randrange(5) for _ in range(rng.randrange(0, 20))]
        mask = {}
        for k, w in enumerate(a):
            mask[w] = mask.get(w, 0) | 1 << k
        assert decontaminate.best_end(mask, len(a), b)[0] == distance(a, b)


def test_edited_passages_are_found_and_prose_is_not():
    rng = random.Random(3)
    vocabulary = [f"{w}{i}" for w in WORDS for i in range(40)] + ["the", "of", "and"] * 100
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(12, 60))] for _ in range(60)]
    index = decontaminate.Index(list(range(60)), [" ".join(i) for i in items])
    texts, planted = [], []
    for k in range(300):
        item = k % 60
        w = list(items[item])
        for _ in range(rng.randint(0, decontaminate.edits(len(w)))):
            j = rng.randrange(len(w))
            w[j : j + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
        around = [rng.choice(vocabulary) for _ in range(200)]
        at = rng.randrange(201)
        texts.append(" ".join([*around[:at], *w, *around[at:]]))
        planted.append(item)
    found = {(b.first + row, item): d for b in decontaminate._blocks(pa.array(texts)) for row, item, d, *_ in index.search(b)}
    assert np.mean([(k, item) in found for k, item in enumerate(planted)]) > 0.97
    for (k, item), d in found.items():
        assert d == distance(items[item], words(texts[k])) or d <= decontaminate.edits(len(items[item]))
    assert {k: i for k, i in found if planted[k] != i} == {}


@pytest.mark.parametrize("n", [20, 50, 100, 200, 400, 800])
def test_recall_at_the_most_edits_does_not_fall_with_length(n):
    """A fifth of the words of every item is replaced, deleted or has a word put before it."""
    rng = random.Random(n)
    vocabulary = [f"{w}{i}" for w in WORDS for i in range(40)] + ["the", "of", "and"] * 100
    items = [[rng.choice(vocabulary) for _ in range(n)] for _ in range(100)]
    index = decontaminate.Index(list(range(100)), [" ".join(i) for i in items])
    texts = []
    for item in items:
        w = [[x] for x in item]
        for j in rng.sample(range(n), decontaminate.edits(n)):
            w[j] = rng.choice([[rng.choice(vocabulary)], [], [rng.choice(vocabulary), w[j][0]]])
        around = [rng.choice(vocabulary) for _ in range(100)]
        texts.append(" ".join([*around[:50], *(x for y in w for x in y), *around[50:]]))
    found = {(b.first + row, item): d for b in decontaminate._blocks(pa.array(texts)) for row, item, d, *_ in index.search(b)}
    assert np.mean([(k, k) in found for k in range(100)]) >= 0.95
    assert all(k == i and d <= decontaminate.edits(n) for (k, i), d in found.items())


def test_short_items_and_scripts_without_spaces():
    items = ["Otorhinolaryngology departments", "of the", "光合作用是植物利用光能合成有机物的过程", "x" * 30]
    index = decontaminate.Index([7, 8, 9, 10], items)
    texts = ["Two otorhinolaryngology -- departments of the", "otorhinolaryngology and departments", "我们知道光合作用是植物利用光能合成有機物的过程吗", "光合作用", "x" * 31, "a " + "X" * 30]
    found = [(b.first + row, int(index.item_ids[i]), d) for b in decontaminate._blocks(pa.array(texts)) for row, i, d, *_ in index.search(b)]
    assert found == [(0, 7, 0), (2, 9, 1), (5, 10, 0)]


def test_one_index_is_alive_at_a_time(spark, shipped, monkeypatch):  # noqa: F811
    alive, most, built = weakref.WeakSet(), [], decontaminate.Index.__init__

    def counted(self, *args):
        built(self, *args)
        gc.collect()
        alive.add(self)
        most.append(len(alive))

    monkeypatch.setattr(decontaminate.Index, "__init__", counted)
    items = spark.createDataFrame([(i, prose(20, 1000 * i)) for i in range(40)], "item_id long, text string")
    docs = documents(spark, [(i, prose(30, 500_000) + " " + prose(20, 1000 * i)) for i in range(0, 40, 4)])
    assert decontaminate.matches(docs, items, 4).count() == 10 and decontaminate.clean(docs, items, 4).count() == 0
    assert len(most) == 20 and max(most) == 1


def test_given_documents_against_brute_force(spark):
    """Every pair with a shared eight-word run is checked by the full table."""
    got = {(r.doc_id, r.item_id): r.edits for r in QUERIES["op2_decontaminate"](spark, SF).collect()}
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    texts = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    runs = {}
    for i, w in items.items():
        for k in range(len(w) - 4):
            runs.setdefault(tuple(w[k : k + 5]), set()).add(i)
    expected = {}
    for d, w in texts.items():
        for i in {i for k in range(len(w) - 4) for i in runs.get(tuple(w[k : k + 5]), ())}:
            e = distance(items[i], w)
            if e <= decontaminate.edits(len(items[i])):
                expected[d, i] = e
    assert len(expected) > 10 and got == expected


@pytest.fixture
def benchmark(spark):
    texts = [(1, prose(30, 500)), (2, "short one"), (3, None), (None, prose(40, 900)), (4, prose(7, 950)), (5, prose(30, 500))]
    return spark.createDataFrame(texts, "item_id long, text string")


def test_awkward_rows_and_passes(spark, shipped, benchmark):  # noqa: F811
    docs = [(1, prose(30, 500).upper().replace("\n", " -- ")), (2, None), (3, ""), (None, prose(30, 500)), (4, prose(300)), (4, prose(300)),
            (5, prose(100) + " " + prose(7, 950)), (6, prose(100) + " " + prose(6, 950)), (7, prose(120_000, 3) + " " + prose(30, 500))]
    expected = [(1, 1, 0), (1, 5, 0), (5, 4, 0), (7, 1, 0), (7, 5, 0)]
    for per_pass in (20_000, 2):
        got = decontaminate.matches(documents(spark, docs), benchmark, per_pass)
        assert sorted((r.doc_id, r.item_id, r.edits) for r in got.collect()) == expected
        kept = decontaminate.clean(documents(spark, docs), benchmark, per_pass)
        assert kept.schema == documents(spark, docs).schema
        assert [r[0] for r in rows(kept.select("doc_id"))] == [2, 3, 4, 4, 6]


def test_empty_tables(spark, shipped, benchmark):  # noqa: F811
    assert decontaminate.matches(documents(spark, []), benchmark).count() == 0
    assert decontaminate.matches(documents(spark), benchmark.limit(0)).count() == 0
    assert decontaminate.clean(documents(spark), benchmark.limit(0)).count() == documents(spark).count()
