import pytest
from compare import duck, duck_result, spark_result
from conftest import SF

from sensorframe.llm import url_reputation
from sensorframe.llm.queries import ORACLES, QUERIES


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", 1, "y") for i, u in enumerate(urls)], "page_id long, url string, host string, n long, rule string")


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_matches_sql(spark, sf):
    assert spark_result(QUERIES["op3_url_reputation"](spark, sf)) == duck_result(duck(sf), ORACLES["op3_url_reputation"])


URLS = {
    "http://A.Example.COM/en/x?y#z": ("a.example.com", "/en/x", "example.com/en/"),
    "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"),
    "https://m.www.example.com/en/a": ("m.www.example.com", "/en/a", "www.example.com/en/"),
    "http://example.com": ("example.com", "", None),
    "http://example.com/EN/": ("example.com", "/EN/", "com/"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/"),
    "ftp://com/": ("com", "/", "com/"),
    "x://net/es/?q": ("net", "/es/", "net/es/"),
    "x://b.net/esx": ("b.net", "/esx", None),
    "x://b.net?/es/": ("b.net", "", None),
    "x://b.net#/es/": ("b.net", "", None),
    "a://b://c/d": ("b:", "//c/d", None),
    "no scheme": ("", "", None),
    "": ("", "", None),
    None: ("", "", None),
    "http://ÀÉ.ORG/ÀB": ("ÀÉ.org", "/ÀB", None),
    "http://u:p@h.com:80/": ("u:p@h.com:80", "/", None),
}


def test_hosts_paths_and_rules(spark):
    outcomes = spark.createDataFrame([(0, 1), (0, None), (None, 1), (3, 0), (3, 1), (77, 1)], "page_id long, bad int")
    got = {r.page_id: r for r in url_reputation.judge(pages(spark, [*URLS, *URLS]), outcomes).collect()}
    assert len(got) == 2 * len(URLS)
    for k, (host, path, rule) in enumerate([*URLS.values()] * 2):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict in ("allow", "block") and 0 <= got[k].bad_low <= got[k].bad_rate <= 1


def test_bad_hosts_are_blocked_and_unknown_hosts_take_their_domains_rate(spark):
    urls = ["http://bad.org/a"] * 200 + ["http://x.good.org/a"] * 200 + ["http://y.good.org/"] + ["http://new.bad.org/"] + ["http://once.org/"]
    outcomes = spark.createDataFrame([(i, int(i < 190)) for i in range(400)] + [(402, 1)], "page_id long, bad int")
    got = {r.host: r for r in url_reputation.judge(pages(spark, urls), outcomes).collect()}
    assert {h: r.verdict for h, r in got.items()}["bad.org"] == "block"
    assert got["x.good.org"].verdict == got["y.good.org"].verdict == "allow"
    assert got["new.bad.org"].bad_rate > 0.6 > 0.4 > got["y.good.org"].bad_rate
    assert got["once.org"].verdict == "allow"  # one bad page is no certainty
    assert got["bad.org"].bad_rate < 0.95 + 1e-6


def test_domains(spark):
    hosts = ["a.b.co.uk", "co.uk", "b.co.uk", "x.y.com", "com", "", "a.b.example.org:8080", "10.0.0.1", "x.com.br", "a..b"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    d = url_reputation.domain_of(df.host)
    got = {r[0]: (r[1], r[2]) for r in df.select("host", d, url_reputation.suffix_of(d)).collect()}
    assert got["a.b.co.uk"] == ("b.co.uk", "co.uk") and got["x.y.com"] == ("y.com", "com") and got["com"] == ("com", "com")
    assert got["a.b.example.org:8080"] == ("example.org", "org") and got[""] == ("", "") and got["x.com.br"] == ("x.com.br", "com.br")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, bad int")
    assert url_reputation.judge(pages(spark, URLS).limit(0), none).count() == 0
    got = url_reputation.judge(pages(spark, ["http://a.org/x"]), none).collect()
    assert [(r.verdict, r.bad_rate) for r in got] == [("allow", 0.5)]
