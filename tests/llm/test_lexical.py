"""Ranked lexical search: against a plain scoring of all documents, over several passes, with hot classes."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from common import AWKWARD, documents, rows, shipped  # noqa: F401
from compare import duck, duck_result, spark_result
from conftest import SF

from sensorframe.llm import lexical, queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
WORDS = "be de la os ra mi qué 日本 x1 zz Ñu Alpha beta GAMMA delta".split()


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, top=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in wanted.items():
        scores = []
        for i, c in counts:
            m = 100 - 90 + (90 * c.total() * n_docs) // max(n_terms, 1)
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in words if c[t]
            )
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def items_of(spark, items):
    return spark.createDataFrame([(i, t, "x", 1, 1, "h") for i, t in items], "item_id long, text string, term string, score long, rank int, h string")


def some(n, seed, words=WORDS):
    r = random.Random(seed)
    return [" ".join(r.choice(words) for _ in range(r.randint(0, 12))) for _ in range(n)]


ITEMS = [*enumerate(some(12, 5)), (20, None), (21, ""), (22, "--- ..."), (23, "notfound"), (5, "beta"), (5, "beta"), (None, "beta zz"), (24, "ALPHA alpha")]


def test_against_plain_scoring(spark, shipped):
    docs = [*enumerate(some(150, 1)), *AWKWARD, (7, "beta beta"), (7, "beta beta"), (8, "beta beta"), (None, "beta beta")]
    assert rows(lexical.search(documents(spark, docs), items_of(spark, ITEMS))) == expected(docs, ITEMS)


@pytest.mark.parametrize("pass_terms", [1, 7])
def test_passes_do_not_change_results(spark, shipped, pass_terms):
    docs = list(enumerate(some(60, 2)))
    assert rows(lexical.search(documents(spark, docs), items_of(spark, ITEMS), pass_terms=pass_terms)) == expected(docs, ITEMS)


def test_copies_are_scored_once(spark, shipped):
    """A third of the rows is one text; its class is scored once and its ten smallest ids are returned."""
    docs = [(i, "Alpha beta 日本 other" if i % 3 == 0 else t) for i, t in enumerate(some(300, 3))]
    got = rows(lexical.search(documents(spark, docs), items_of(spark, [(1, "alpha 日本"), (2, "zz")])))
    assert got == expected(docs, [(1, "alpha 日本"), (2, "zz")])
    found = next(lexical.passes(items_of(spark, [(1, "alpha 日本"), (2, "zz")])))
    held = lexical.bags(documents(spark, docs), found.terms).where("length(bag) > 0")
    assert held.select("n", "bag").distinct().count() < held.count() / 2


def test_pieces_do_not_change_results(spark, shipped, monkeypatch):
    docs = list(enumerate(some(80, 4)))
    monkeypatch.setattr(lexical, "CELLS", 3)
    assert rows(lexical.search(documents(spark, docs), items_of(spark, ITEMS), top=3)) == expected(docs, ITEMS, 3)


def test_pieces_cover_all_rows():
    for costs, rows_at_once in ((np.array([5, 1, 10**9, 0, 0, 3]), 2), (np.zeros(7), 3), (np.zeros(0), 1)):
        cut = list(lexical._pieces(costs, 6, rows_at_once))
        assert [k for low, high in cut for k in range(low, high)] == list(range(len(costs)))


@pytest.mark.parametrize("docs, items", [([], ITEMS), ([(1, "beta")], []), ([(1, None), (2, "")], ITEMS), ([], [])])
def test_empty_tables(spark, shipped, docs, items):
    assert rows(lexical.search(documents(spark, docs), items_of(spark, items))) == expected(docs, items) == []


def test_given_documents(spark):
    assert spark_result(queries.op13_lexical(spark, SF)) == duck_result(duck(SF), queries.ORACLES["op13_lexical"])
