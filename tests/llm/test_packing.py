import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from common import AWKWARD, documents, prose, shipped  # noqa: F401
from conftest import SF
from tokenizers import Tokenizer

from sensorframe.llm import packing
from sensorframe.llm.queries import QUERIES, TOKENIZER

ODD = ["a\x0bb\x0cc", "x\x1cy  <|endoftext|> z's İΣ ς", "é ́a don't  ΑΣ ΑΣΑ", "", "<|EndOfText|> <|endoftext|>a<|startoftext|>", "Å ﬁ ½ 一二 　日本",
       "İx, Ünï. . , ., ,, a.. ªº ǅ. ʰ K ſt. 's 're,", "THE the The. tHe,"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(TOKENIZER)


def ids(plain, text):
    return np.array([*plain.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")


def test_word_cache_gives_the_tokenizers_ids(plain):
    words = packing.WordTokenizer(TOKENIZER, cached=50)
    for _ in range(2):
        for text, got in zip(ODD, words.encode(ODD), strict=True):
            assert got == ids(plain, text)[:-1].tobytes()


def check(plain, texts, pieces):
    """Each id in one piece, sequences gapless, full or a power of two."""
    sequences, parts = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        parts[p.doc_id].append(p)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW and (at == packing.WINDOW or at & (at - 1) == 0)
    assert set(parts) == set(texts)
    for i, own in parts.items():
        expected, at = ids(plain, texts[i]), 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(expected)
            assert p.ids_crc32 == zlib.crc32(expected[at : at + p.length].tobytes())
            at += p.length
        assert at == len(expected)
    return sequences


def test_given_documents_round_trip(spark, plain):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sequences = check(plain, texts, QUERIES["op7_packing"](spark, SF).collect())
    assert sum(sum(n for _, n in s) == packing.WINDOW for s in sequences.values()) > 0.8 * len(sequences)


def test_awkward_rows(spark, shipped, plain):  # noqa: F811
    unique = {i: t for i, t in AWKWARD if i not in (None, 4)}
    pieces = packing.pack(documents(spark, list(unique.items())), TOKENIZER).collect()
    check(plain, unique, pieces)
    everything = packing.pack(documents(spark), TOKENIZER).collect()
    assert sum(p.length for p in everything) == sum(len(ids(plain, t)) for _, t in AWKWARD)
    assert sum(p.length for p in everything if p.doc_id is None) == len(ids(plain, prose(30))) + 1
    assert packing.pack(documents(spark, []), TOKENIZER).count() == 0


def test_sum_of_squares_choice():
    s = packing.SumOfSquares(window=100, grain=10)
    assert list(s.place("a", 0, bytes(4 * 60))) == [] and s.count[6] == 1
    assert list(s.place("b", 0, bytes(4 * 60))) == [] and s.count[6] == 2  # fits nowhere
    assert list(s.place("c", 0, bytes(4 * 20))) == [] and s.count[6] == s.count[8] == 1  # 4 to 2 squares; a new window would make 5
    full = list(s.place("d", 0, bytes(4 * 45)))  # completes the 60: what overruns by less than a grain is cut off
    assert [[(d, at, len(x) // 4) for d, at, x in w] for w in full] == [[("b", 0, 60), ("d", 0, 40)]] or [
        [(d, at, len(x) // 4) for d, at, x in w] for w in full] == [[("a", 0, 60), ("d", 0, 40)]]
    assert sum(len(p[2]) // 4 for w in s.rest() for p in w) == 85 and not s.count.any()


def test_open_windows_stay_few():
    s, rng, total = packing.SumOfSquares(), np.random.default_rng(1), 0
    for k in range(20_000):
        n = int(rng.lognormal(6, 1)) + 1
        total += n
        total -= sum(len(p[2]) // 4 for w in s.place(k, 0, bytes(4 * n)) for p in w)
    assert sum(map(len, s.open)) == s.count.sum() < 300
    rest = list(s.rest())
    assert sum(len(p[2]) // 4 for w in rest for p in w) == total
    assert sum(sum(len(p[2]) // 4 for p in w) < packing.WINDOW for w in rest) <= 12


def test_new_ascii_words_go_to_the_model(plain):
    """With nothing cached, the whole tokenizer isn't called for words that it needs no normalizer for."""
    words = packing.WordTokenizer(TOKENIZER, cached=0)
    texts = ["Zqxvorb zqxvorb, it's 12a.b@c-d%%% They'll,, x1.  qvorb.\n3.14 'S 're", "a", "", "zqxv..., ''s ''S ~{}"]
    expected = [ids(plain, t)[:-1].tobytes() for t in texts]
    words.tokenizer = None
    assert words.encode(texts) == expected and len(words.cache) == 1


def test_slices_of_a_column(plain):
    """Also beside null, spaced and non-ASCII texts, and with the names of special tokens in one of them."""
    texts = ["Ünï ê È,", None, "  lead  ", "éa È. 一二", *ODD, "x" * 50, "tail\t", ""]
    column, words = pa.array(texts), packing.WordTokenizer(TOKENIZER, cached=20)
    for first in range(len(texts)):
        got = words.encode_column(column.slice(first, 7))
        assert got == [ids(plain, t)[:-1].tobytes() for t in texts[first : first + 7]]


def test_runs_of_texts():
    big = "x" * (packing.TOGETHER // 2)
    for texts in ([], ["a", None, "b"], [big, big, "a", big + big + "c", None, big], [None, big * 3, "a"]):
        runs = list(packing._together(pa.array(texts, pa.string())))
        assert [k for first, last in runs for k in range(first, last)] == list(range(len(texts)))
        assert all(last - first == 1 or sum(len(t or "") for t in texts[first:last]) <= packing.TOGETHER for first, last in runs)


def test_words_met_once_are_not_kept(plain):
    """Nor more words than the cache may hold; letters are shared by what stands behind them."""
    rng = np.random.default_rng(3)
    once = ["".join(map(chr, rng.integers(97, 123, 9))) for _ in range(3000)]
    texts = [" ".join(once[:1500]) + " again é", "again  é!! Again?", " ".join(once[1500:]), "ab!!, ab*** ab İ# İ&&&x Σ$ it's!! ''!! <|endoftext|>!! a;:."]
    words, small = packing.WordTokenizer(TOKENIZER), packing.WordTokenizer(TOKENIZER, cached=3)
    for _ in range(2):
        expected = [ids(plain, t)[:-1].tobytes() for t in texts]
        assert words.encode(texts) == small.encode(texts) == expected
        assert {b"again", b"ab"} < set(words.cache) and len(words.cache) < 20 and len(small.cache) == 3


def test_memory_of_tokenizing():
    """A step's columns are gone when the next one's are made."""
    text = " ".join(f"w{k % 5000}" for k in range(200_000))
    column, words, pool = pa.array([text]), packing.WordTokenizer(TOKENIZER), pa.default_memory_pool()
    counted = pa.proxy_memory_pool(pool)
    pa.set_memory_pool(counted)
    try:
        words.encode_column(column)
    finally:
        pa.set_memory_pool(pool)
    assert 0 < counted.max_memory() < 7 * len(text)
