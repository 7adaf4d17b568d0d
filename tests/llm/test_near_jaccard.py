import random
import re

from common import AWKWARD, documents, shipped  # noqa: F401
from conftest import SF
from test_simhash import groups

import corpus_pipeline
from sensorframe.llm import near_jaccard, simhash
from sensorframe.llm.components import connected_components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def similar(x, y):
    return len(x & y) >= 0.8 * len(x | y)


def kept_by_brute_force(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    linked = {(a, b) for a in sets for b in sets if a < b and 0.8 * len(sets[a]) <= len(sets[b]) <= len(sets[a]) / 0.8 and similar(sets[a], sets[b])}
    return {i for i, c in groups(sorted(sets), lambda a, b: (a, b) in linked).items() if i == c}


def test_stage_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.schema == docs.schema
    assert {r.doc_id for r in got.collect()} == kept_by_brute_force(texts)


def test_edited_copies_chains_and_large_groups(spark, shipped):  # noqa: F811
    rng = random.Random(3)
    texts = {}
    for g, n in enumerate((2, 3, 5, 60)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for _ in range(n):
            own = list(base)
            for k in rng.sample(range(300), rng.randrange(1, 6)):
                own[k] = f"e{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(own)
    chain = [f"c{k}" for k in range(400)]
    for k in range(6):  # neighbours are similar, ends are not
        texts[len(texts)] = " ".join(chain[20 * k : 20 * k + 250])
    assert len(kept_by_brute_force(texts)) < 10
    got = {r.doc_id for r in near_jaccard.keep_first(documents(spark, list(texts.items()))).collect()}
    assert got == kept_by_brute_force(texts)


def test_close_fingerprints_are_in_one_component(spark):
    rng = random.Random(6)
    fps = [rng.getrandbits(64) for _ in range(12)]
    for _ in range(150):
        fps.append(rng.choice(fps) ^ (1 << rng.randrange(64)) ^ (rng.randrange(2) << rng.randrange(64)))
    fps += fps[::7]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    pairs = near_jaccard.close(spark.createDataFrame(list(enumerate(signed)), "rep long, fp long"))
    assert pairs.where("a >= b").count() == 0
    got = {r.node: r.component for r in connected_components(pairs).collect()}
    expected = groups(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert {i: got.get(i, i) for i in expected} == expected


def test_simhash_step_finds_near_copies_by_itself(spark, shipped, monkeypatch):  # noqa: F811
    """Without any band, texts with close fingerprints are candidates, and the exact index still decides."""
    long = [f"w{k}" for k in range(3000)]
    texts = {0: " ".join(long), 1: " ".join([*long, "end"]), 2: " ".join(["start", *long[1:]]), 3: "a b a b a b", 4: " ".join(["a b"] * 50), 5: "other words of a short text"}
    fps = {i: simhash.fingerprint(t.encode(), shingle=near_jaccard.SHINGLE) for i, t in texts.items()}
    assert all((fps[0] ^ fps[i]).bit_count() <= 2 for i in (1, 2)) and fps[3] != fps[5]
    none = lambda classes: (spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "key long, rep long"))
    monkeypatch.setattr(near_jaccard, "candidates", none)
    got = {r.doc_id: r.component_id for r in near_jaccard.components(documents(spark, list(texts.items()))).collect()}
    linked = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2 and similar(shingles(texts[a]), shingles(texts[b]))
    assert got == groups(sorted(texts), linked) and got[1] == got[2] == 0


def template_corpus(pairs, shared, own, apart, seed=0):
    """Texts on one template: ``shared`` words of all, ``own`` of each pair, ``apart`` of each text, in an order of blocks."""
    rng = random.Random(seed)
    template = [f"t{rng.randrange(10**9)}" for _ in range(shared)]
    texts = {}
    for p in range(pairs):
        mine = [f"p{p}x{k}" for k in range(own)]
        for side in range(2):
            texts[2 * p + side] = " ".join([*template, *mine, *[f"q{p}y{side}z{k}" for k in range(apart)]])
    return texts


def test_links_inside_a_template_are_not_lost(spark, shipped):  # noqa: F811
    """1,200 texts share most of their words; only the two of a pair reach 0.8, and all 600 pairs are linked."""
    texts = template_corpus(600, 265, 12, 23)
    sets = {i: shingles(t) for i, t in texts.items()}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.8 <= jaccard(0, 1) < 0.9 and 0.7 < jaccard(0, 2) < 0.8
    got = {r.doc_id: r.component_id for r in near_jaccard.components(documents(spark, list(texts.items()))).collect()}
    assert got == {i: i - i % 2 for i in texts}


def test_crowded_members_of_other_sizes_and_outsiders(spark, shipped):  # noqa: F811
    """Near copies of one text, and texts near some of these only, of up to 1.2 times their length."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(200)]
    texts = {}
    for i in range(90):
        own = list(base)
        start = rng.randrange(150)
        if i % 3:
            own[start : start + rng.randrange(1, 30)] = [f"n{i}k{k}" for k in range(rng.randrange(0, 60))]
        else:
            own[start : start + 12] = [f"m{i % 9}k{k}" for k in range(12)]
            own += [f"m{i % 9}e{k}" for k in range(rng.randrange(0, 16))]
        texts[i] = " ".join(own)
    expected = kept_by_brute_force(texts)
    assert 5 < len(expected) < 80
    got = {r.doc_id for r in near_jaccard.keep_first(documents(spark, list(texts.items()))).collect()}
    assert got == expected


def test_rare_pairs_hold_every_similar_pair(spark, shipped):  # noqa: F811
    rng = random.Random(4)
    sets = {i: sorted(rng.sample(range(40), rng.randrange(18, 33))) for i in range(150)}
    frame = spark.createDataFrame([(i, bytearray(b"".join(x.to_bytes(8, "little") for x in s))) for i, s in sets.items()], "doc_id long, set binary")
    members = spark.createDataFrame([(i, i - i % 3) for i in sets], "doc_id long, c long")
    got = {tuple(r) for r in near_jaccard.rare_pairs(members, frame).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and a // 3 != b // 3 and similar(set(sets[a]), set(sets[b]))}
    assert want and want <= got and all(a < b and a // 3 != b // 3 for a, b in got)


def test_awkward_rows(spark, shipped):  # noqa: F811
    docs = documents(spark)
    ids = [r.doc_id for r in near_jaccard.keep_first(docs).collect()]
    assert near_jaccard.keep_first(docs).schema == docs.schema
    texts = {i: t for i, t in AWKWARD if i is not None}
    assert set(ids) - {None} == kept_by_brute_force(texts) and ids.count(4) == 2 and ids.count(None) == 2
    assert near_jaccard.keep_first(documents(spark, [])).count() == 0
