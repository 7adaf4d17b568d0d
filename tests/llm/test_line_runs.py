"""Repeated runs of over 50 words go whole, whatever their number of lines; against brute force over all pairs of lines."""

import random

import pytest
from common import documents, shipped  # noqa: F401
from test_line_chunks import cut

from sensorframe.llm import line_chunks


def lines(rng, n, words):
    return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(words)) for _ in range(n)]


def brute(texts):
    """Lines in a maximal equal run of over 50 words with an earlier place, or in a repeated chunk of two lines with a word."""
    before, seen, out = [], set(), {}
    for i in sorted(texts):
        own = texts[i].split("\n")
        gone = set()
        for other in [*before, own]:
            length = [[0] * (len(other) + 1) for _ in range(len(own) + 1)]
            for a in range(len(own) - 1, -1, -1):
                for b in range(len(other) - 1, -1, -1):
                    if own[a] == other[b] and (other is not own or b < a):
                        length[a][b] = n = length[a + 1][b + 1] + 1
                        if sum(len(x.split()) for x in own[a : a + n]) > 50:
                            gone |= set(range(a, a + n))
        at = 0
        for chunk, worded in cut(texts[i]):
            n = chunk.count("\n") + 1
            if worded >= 2 and chunk in seen:
                gone |= set(range(at, at + n))
            if worded >= 2:
                seen.add(chunk)
            at += n
        before.append(own)
        out[i] = "\n".join(x for k, x in enumerate(own) if k not in gone)
    return out


@pytest.mark.parametrize("n", [1, 2, 4, 8])
def test_passages_go_whole(spark, shipped, n):  # noqa: F811
    rng = random.Random(n)
    passages = [lines(rng, n, 60 // n + 1) for _ in range(6)]
    texts = {}
    for k, p in enumerate(passages):
        texts[3 * k] = "\n".join([*lines(rng, 3, 9), *p, *lines(rng, 2, 9)])
        texts[3 * k + 1] = "\n".join([*lines(rng, 2, 9), *p, *lines(rng, 4, 9)])
        texts[3 * k + 2] = "\n".join(p)
    got = {r.doc_id: r.text for r in line_chunks.dedup(documents(spark, list(texts.items()))).collect()}
    assert got == brute(texts)
    for k, p in enumerate(passages):
        assert got[3 * k] == texts[3 * k] and got[3 * k + 2] == "" and not set(p) & set(got[3 * k + 1].split("\n"))
        assert len(got[3 * k + 1].split("\n")) == 6


def test_random_documents_of_few_lines(spark, shipped):  # noqa: F811
    rng = random.Random(0)
    pool = [x for w in (1, 7, 20, 49, 50, 51, 70) for x in lines(rng, 4, w)]
    texts = {}
    for i in range(120):
        start = rng.randrange(len(pool) - 5)
        texts[i] = "\n".join([*lines(rng, rng.randrange(3), 12), *pool[start : start + rng.randrange(1, 6)], *rng.choices(pool, k=rng.randrange(3)), *lines(rng, 1, 12)])
    got = {r.doc_id: r.text for r in line_chunks.dedup(documents(spark, list(texts.items()))).collect()}
    assert got == brute(texts)
