"""Rows that every operator must bear, and small helpers."""

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed=0):
    """``n`` words without repeated five-word windows, a line feed after every eighth."""
    out = [f"{WORDS[(i * 7 + seed) % 20]}{i + seed}" for i in range(n)]
    return "\n".join(" ".join(out[i : i + 8]) for i in range(0, n, 8))


#: (doc_id, text) with null ids and texts, empty and blank texts, repeated rows, ties and a very long text.
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n \n"), (None, prose(30)), (None, None), (4, prose(30)), (4, prose(30)), (5, prose(30)), (6, prose(200_000, 3)),
    (7, "ÉÀ ﬁ İ ſ  　 日本"), (8, "x"), (9, "a\x00b \x0b\x0c c"),
]


def documents(spark, rows=None):
    """Documents with further columns whose names operators use themselves."""
    rows = AWKWARD if rows is None else rows
    extra = "lang string, source string, n_chars long, h long, chunk long, fp long, host string, key string, n long, m string, path string, y int, first int"
    return spark.createDataFrame(
        [(i, t, "en", "s", None if t is None else len(t), 1, 1, 1, "h", "k", 1, "m", "p", 1, 1) for i, t in rows],
        f"doc_id long, text string, {extra}",
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def shipped(spark):
    from sensorframe.session import ship_package

    return ship_package(spark)
