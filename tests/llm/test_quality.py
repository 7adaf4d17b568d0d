import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from common import AWKWARD, documents, prose, rows, shipped  # noqa: F401
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from sensorframe.llm import labelled, quality_rank, quality_rules
from sensorframe.llm.queries import QUERIES
from sensorframe.llm.textscan import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(map((text or "").count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def base(texts, size=1 << 20):
    out = []
    for b in blocks(pa.array(texts, pa.string()), size):
        c = quality_rules.base_counts(b)
        out += [(*map(int, v), bool(f)) for *v, f in zip(*c.values(), quality_rules.base_failed(c), strict=True)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é#|\n\t\x0b!", max_size=80)), max_size=8))
def test_base_counts_match_brute_force(texts):
    assert base(texts) == base(texts, 10) == [counted(t) for t in texts]


def test_base_counts_on_given_documents(spark):
    got = {r.doc_id: r for r in QUERIES["op5_quality_rules"](spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(texts)
    for d in texts:
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counted(d.text)
        assert not (r.base_failed and r.kept)


def test_rules_keep_good_rows_and_drop_bad_ones_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in QUERIES["op5_quality_rules"](spark, SF).collect() if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good = [r.kept for r in held if labels[r.doc_id] == 1 and not r.base_failed]
    bad = [r.kept for r in held if labels[r.doc_id] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_rank_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op1_quality_rank"](spark, SF).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(labels[r.doc_id], r.score, r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([y == p for y, _, p in held]) > 0.95
    assert np.mean([a > b for y, a, _ in held if y for z, b, _ in held if not z]) > 0.98


def test_pairs_recover_the_order():
    rng = np.random.default_rng(0)
    true = np.array([2.0, -1.0, 0.0])
    x, y = rng.normal(size=(2, 3000, 3))
    wins = rng.random(3000) < 1 / (1 + np.exp(-(x - y) @ true))
    w = quality_rank.fit_pairs(np.where(wins[:, None], x - y, y - x), ridge=1e-4)
    assert np.abs(w - true).max() < 0.25


def test_awkward_rows(spark, shipped):  # noqa: F811
    docs = documents(spark)
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, None), (None, 1), (6, 1), (8, 0)], "doc_id long, quality int")
    for model in (None, quality_rank.learn(docs, labels)):
        assert [r[0] for r in rows(quality_rank.score(docs, model))] == [r[0] for r in rows(docs.select("doc_id"))]
    for model in (None, quality_rules.learn(docs, labels)):
        got = quality_rules.judge(docs, model).collect()
        assert sorted((r.n_words for r in got)) == sorted(counted(t)[0] for _, t in AWKWARD)
        kept = quality_rules.keep(docs, model)
        assert kept.schema == docs.schema and kept.count() == sum(r.kept for r in got)


def test_empty_tables(spark, shipped):  # noqa: F811
    docs, labels = documents(spark, []), spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rank.learn(docs, labels) is None and quality_rules.learn(docs, labels) is None
    assert quality_rank.score(docs, None).count() == quality_rules.judge(docs, None).count() == quality_rules.keep(docs, None).count() == 0


def test_held_out_of_null(spark):
    df = spark.createDataFrame([(None,), (5,)], "doc_id long")
    assert [r[0] for r in df.select(labelled.held_out(df.doc_id)).collect()] == [True, zlib.crc32(b"5") % 5 == 0]


def test_long_text_counts_like_short_ones():
    assert base([prose(50_000)]) == [counted(prose(50_000))]


@pytest.mark.parametrize("text", ["", "x", "#### $$$$ " * 40])
def test_model_scores_any_text(text):
    model = quality_rules.RulesModel(np.zeros(1 << 16, np.float32), np.ones(1 << 16, np.float32), 0.1)
    b = next(blocks(pa.array([text])))
    assert 0 <= model.probability(b)[0] <= 1


def test_rules_fit_holds_no_copy_of_the_rows():
    rng, n = np.random.default_rng(3), 3000
    sparse = [(np.sort(rng.choice(2**17, n, replace=False)).astype(np.int32), rng.random(n, np.float32)) for _ in range(600)]
    y = np.arange(600) % 2
    tracemalloc.start()
    model = quality_rules.fit(sparse, y, {0: 5000, 1: 400}, steps=3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 600 * n * 8 + 8 * 2**20  # bytes of the rows, and a few arrays of a weight for each column
    assert model.word.shape == model.char.shape == (2**quality_rules.BITS,)
    weights = np.arange(2.0**17)
    assert np.allclose(quality_rules._sums(sparse, weights), [v @ weights[c] for c, v in sparse])
