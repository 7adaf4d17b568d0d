from collections import defaultdict

import regex
from common import AWKWARD, documents, rows
from conftest import SF
from pyspark.sql import functions as F

from sensorframe.llm import pii_surrogates as pii
from sensorframe.llm.queries import QUERIES

FOUND = regex.compile(pii.PATTERN)


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


def test_given_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op4_pii_surrogates"](spark, SF).collect()}
    assert set(got) == set(texts)
    originals, new_of = set(), defaultdict(set)
    for i, text in texts.items():
        matches = [m[0] for m in FOUND.finditer(text)]
        assert got[i].n_replaced == len(matches)
        if not matches:
            assert got[i].text == text
            continue
        between, new = FOUND.split(text), got[i].text
        at, parts = 0, []
        for k, piece in enumerate(between):  # what stands between stays
            j = new.index(piece, at) if piece else (at if k < len(between) - 1 else len(new))
            parts.append(new[at:j])
            at = j + len(piece)
        originals.update(m.lower() for m in matches)
        for old, n in zip(matches, parts[1:], strict=True):
            assert regex.sub(r"\d", "0", regex.sub(r"\p{Ll}", "a", regex.sub(r"\p{Lu}", "A", n))).count("@") == old.count("@")
            assert FOUND.fullmatch(n), (old, n)
            new_of[old.lower()].add(n.lower())
    assert len(originals) > 40 and all(len(v) == 1 for v in new_of.values())
    surrogates = [next(iter(v)) for v in new_of.values()]
    assert len(set(surrogates)) == len(surrogates) and not set(surrogates) & originals


def replaced(spark, *texts):
    got = pii.pseudonymize(documents(spark, list(enumerate(texts))), "key").collect()
    return {r.doc_id: r for r in got}


def test_formats_and_coreference(spark):
    got = replaced(
        spark, "+1 (017) 555-7713 (017) 555-7713 017-555-7713", "Jo.Doe7@Mail.example.com jo.doe7@mail.EXAMPLE.com x@mail.example.com",
        "4111 1111 1111 1111 4111111111111111 9807915762804490", "10.1.2.3 192.168.1.1 8.8.8.8. v1.2.3 1.2.3.4.5 999.1.1.1",
        "Mrs. Anna Smith, Mr. Smith; Frau Müller-Lüdenscheidt; Госпожа Анна Иванова, Господин Иванова. DE89 3704 0044 0532 0130 00 123-45-6789",
    )
    a, b, c = regex.findall(r"\d{3}\)? ?-?\d{3}-\d{4}|(?<=\()\d{3}\) \d{3}-\d{4}", got[0].text)
    assert len({regex.sub(r"\D", "", x) for x in (a, b, c)}) == 1 and got[0].text.startswith("+1 (") and "555-7713" not in got[0].text
    first, second, third = got[1].text.split()
    assert first.lower() == second.lower() and first[0].isupper() and first != second and third.split("@")[1] == second.split("@")[1].lower()
    x, y = regex.search(r"(\d{4} \d{4} \d{4} \d{4}) (\d{16})", got[2].text).groups()
    assert x.replace(" ", "") == y != "4111111111111111" and luhn(y) and not luhn(got[2].text.split()[-1])
    assert regex.fullmatch(r"10\.\d+\.\d+\.\d+ 192\.168\.\d+\.\d+ \d+\.\d+\.\d+\.\d+\. v1\.2\.3 1\.2\.3\.4\.5 999\.1\.1\.1", got[3].text)
    assert got[3].n_replaced == 3 and "8.8.8.8" not in got[3].text
    names = regex.match(r"Mrs\. (\w+na) (\w+), Mr\. (\w+); Frau \w+; Госпожа (\p{IsCyrillic}+на) (\p{IsCyrillic}+), Господин (\p{IsCyrillic}+)\. DE\d\d( \d{4}){4} \d\d \d{3}-\d\d-\d{4}$", got[4].text)
    assert names and names[2] == names[3] and names[5] == names[6]


def test_crowded_formats_stay_distinct(spark):
    """All addresses of one letter: every first surrogate is an original, and the letters alone do not suffice."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    got = replaced(spark, " ".join(f"{x}@{d}.co" for d in "ab" for x in letters), "a@a.co and z@b.co", None)
    new = got[0].text.split()
    assert len(set(new)) == 52 and not set(new) & {f"{x}@{d}.co" for d in "ab" for x in letters}
    assert got[1].text == f"{new[0]} and {new[-1]}" and got[0].n_chars == len(got[0].text) and got[2].text is None


def test_a_full_private_range_is_permuted(spark):
    every = [f"192.168.{a}.{b}" for a in range(256) for b in range(256)]
    docs = documents(spark, [(k, " ".join(every[256 * k : 256 * k + 256])) for k in range(256)])
    got = {r.doc_id: r.text.split() for r in pii.pseudonymize(docs, "key").collect()}
    new = [x for k in range(256) for x in got[k]]
    assert sorted(new) == sorted(every) and all(a != b for a, b in zip(every, new, strict=True))
    far = replaced(spark, "10.1.2.3 127.0.0.1 172.16.0.9 172.31.255.255 172.32.0.1 192.168.01.1 192.168.1.1")[0].text.split()
    assert regex.fullmatch(r"10(\.\d+){3} 127(\.\d+){3} 172\.(1[6-9]|2\d|3[01])(\.\d+){2} 172\.(1[6-9]|2\d|3[01])(\.\d+){2} (\d+)(\.\d+){3} 192\.168(\.\d+){2} 192\.168(\.\d+){2}", " ".join(far))
    assert far[5] == far[6] and 11 <= int(far[4].split(".")[0]) <= 126


def mod97(number):
    s = number.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_account_numbers_keep_their_check_digits(spark):
    right = ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606"]
    wrong = ["DE88 3704 0044 0532 0130 00", "GB00 WEST 1234 5698 7654 32"]
    got = replaced(spark, "; ".join(right + wrong))[0].text.split("; ")
    assert [mod97(x) == 1 for x in got] == [True] * 3 + [False] * 2 and not set(got) & set(right + wrong)
    assert [regex.sub("[A-Z]", "A", regex.sub(r"\d", "0", x)) for x in got] == [regex.sub("[A-Z]", "A", regex.sub(r"\d", "0", x)) for x in right + wrong]


def test_a_title_without_gender_names_the_same_person(spark):
    got = replaced(spark, "Mrs. Anna Jones", "Dr. Anna Jones", "Mr. Kim Jones, Mrs. Kim Jones, Dr. Kim Jones", "Prof. Otto Weiss", "Dr. Anna Jones")
    name = {i: r.text.split(" ", 1)[1] for i, r in got.items()}
    assert name[0] == name[1] == name[4] != "Anna Jones" and got[1].text.startswith("Dr. ")
    kims = regex.findall(r"\. (\w+) (\w+)", got[2].text)
    assert len({k[0] for k in kims}) == 3 and {k[1] for k in kims} == {name[0].split()[1]} and name[3] != "Otto Weiss"


def test_columns_with_the_names_used_inside(spark):
    names = ["__found", "found", "draws", "of_text", "n_replaced", "kind", "canon", "attempt", "t"]
    docs = documents(spark, [(1, "Mrs. Anna Jones"), (2, "Dr. Anna Jones"), (3, None)]).withColumns({c: F.lit("mine") for c in names})
    got = pii.pseudonymize(docs, "key")
    assert got.columns == [*(c for c in docs.columns if c != "n_replaced"), "n_replaced"]
    assert sorted((r.doc_id, r.n_replaced, r.found, r.draws, r.t) for r in got.collect()) == [(1, 1, *["mine"] * 3), (2, 1, *["mine"] * 3), (3, 0, *["mine"] * 3)]


def test_another_key_gives_other_surrogates(spark):
    docs = documents(spark, [(1, "a.person@mail.example.com")])
    one, two = (pii.pseudonymize(docs, k).first().text for k in ("k1", "k2"))
    assert one != two and one == pii.pseudonymize(docs, "k1").first().text


def test_awkward_rows(spark):
    docs = documents(spark)
    got = pii.pseudonymize(docs, "key")
    assert got.columns == [*docs.columns, "n_replaced"]
    assert rows(got.select("doc_id", "text", "n_replaced")) == sorted(((i, t, 0) for i, t in AWKWARD), key=repr)
    again = pii.pseudonymize(documents(spark, [(None, "x@y.org"), (None, "x@y.org"), (1, "x@y.org " * 5000)]), "key").collect()
    assert len({r.text for r in again if r.doc_id is None}) == 1 and sum(r.n_replaced for r in again) == 5002
    assert pii.pseudonymize(documents(spark, []), "key").count() == 0
