"""Url verdicts: explicit rules first, then the reputation of hosts by empirical Bayes."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.session import materialize

#: Verdict, host and path of the rules of the registered query.
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
#: Second-level labels that are suffixes under a country's domain, as in ``co.uk``.
SUFFIX_LABELS = ["ac", "co", "com", "edu", "gob", "gov", "net", "or", "org"]

#: A host is blocked if its rate of bad pages lies above MAX_BAD with about 95 % certainty (z = 1.645).
MAX_BAD = 0.5
Z = 1.645


def _after_scheme(url: str) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))


def host_of(url: str) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z in lower case; empty without ``://`` or for null."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: str) -> Column:
    """From the end of the host up to ``?``, ``#`` or end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """``(verdict, rule)`` of the longest rule that fits: on the host and its subdomains, where the path begins as the rule's."""
    fits = F.lit(None)
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        on_host = (host == rule_host) | host.endswith("." + rule_host)
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))
        fits = F.when(on_host & path.startswith(rule_path), found).otherwise(fits)
    return fits


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and the label before it. A bare suffix is its own domain."""
    labels = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")
    n = F.size(labels)
    long_suffix = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, -2).isin(SUFFIX_LABELS)
    take = F.when(long_suffix, 3).otherwise(2)
    return F.array_join(F.slice(labels, F.greatest(n - take + 1, F.lit(1)), take), ".")


def suffix_of(domain: Column) -> Column:
    """The domain without its first label; a domain of one label is its own suffix."""
    return F.regexp_replace(domain, r"^[^.]+\.", "")


def _shrunk(level: DataFrame) -> DataFrame:
    """The groups of a level get the ``rate`` and ``a, b`` of their beta posterior.

    ``up_a, up_b`` are the parent's posterior. A group's prior rate is the parent's without the group's own outcomes, so
    that none counts twice. The strength of the prior is fitted by moments over the groups of the level: how much their rates vary
    beyond what chance would make of equal rates. It is between 1 and 1,000 pages; a level without
    outcomes takes 1,000.
    """
    level = level.withColumn("prior", (F.col("up_a") - F.col("bad")) / (F.col("up_a") + F.col("up_b") - F.col("n")))
    p, n = F.col("prior"), F.col("n")
    # variance of (bad - n p) under a beta-binomial: n p (1 - p) (1 + (n - 1) rho), rho = 1 / (strength + 1)
    square, pages, pairs = level.agg(
        F.sum((F.col("bad") - n * p) ** 2 / (p * (1 - p))), F.sum("n"), F.sum((n * (n - 1)).cast("double"))
    ).first()
    rho = (square - pages) / pairs if pairs else 0.0
    strength = min(max(1 / max(rho, 1e-3) - 1, 1.0), 1000.0)
    a, b = F.col("bad") + strength * p, n - F.col("bad") + strength * (1 - p)
    return level.withColumns({"a": a, "b": b, "rate": a / (a + b)})


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``(host, n, bad, rate, low)`` of every host of ``pages``; ``outcomes`` are labelled pages ``(page_id, bad 0/1)``.

    Rates of bad pages are shrunk from the whole to the suffix, from there to the registered domain, and
    from there to the host, by beta-binomial priors whose strength is fitted at each level. ``low`` is the
    lower bound of the host's rate at z = 1.645 (normal bound of the beta posterior, not below 0). Hosts
    without outcomes have their domain's rate. Outcomes are counted per page row; those that are null are left out.
    """
    seen = outcomes.where("page_id is not null and bad in (0, 1)").groupBy("page_id").agg(F.max(F.col("bad").cast("long")).alias("bad"))
    hosts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of("url").alias("host")).join(
        seen, "page_id", "left"
    ).groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    hosts = materialize(hosts, "host-outcomes")
    bad, n = hosts.agg(F.sum("bad"), F.sum("n")).first()
    totals = [F.sum("bad").alias("bad"), F.sum("n").alias("n")]
    up = [F.col("a").alias("up_a"), F.col("b").alias("up_b")]
    whole = {"up_a": F.lit((bad or 0) + 1.0), "up_b": F.lit((n or 0) - (bad or 0) + 1.0)}
    suffixes = _shrunk(hosts.groupBy("suffix").agg(*totals).withColumns(whole))
    domains = _shrunk(hosts.groupBy("domain", "suffix").agg(*totals).join(suffixes.select("suffix", *up), "suffix"))
    shrunk = _shrunk(hosts.join(domains.select("domain", *up), "domain"))
    a, b = F.col("a"), F.col("b")
    spread = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return materialize(shrunk.select("host", "n", "bad", "rate", F.greatest(F.lit(0.0), F.col("rate") - Z * spread).alias("low")), "reputation")


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, bad_rate, bad_low)`` of every page.

    The longest fitting rule decides; without one, a host whose lower bound of the rate of bad pages is above
    MAX_BAD is blocked. A url that is null or has no scheme has an empty host and path, fits no rule and is
    judged by the reputation of the empty host. Repeated rows and null ids stay.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of("url").alias("host"), path_of("url").alias("path"))
    known = reputation(pages, outcomes).select("host", F.round("rate", 6).alias("bad_rate"), F.round("low", 6).alias("bad_low"))
    found = rows.withColumn("found", rule_of(rules, F.col("host"), F.col("path"))).join(known, "host", "left")
    method = F.when(F.col("bad_low") > MAX_BAD, "block").otherwise("allow")
    return found.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", method).alias("verdict"), "bad_rate", "bad_low"
    )
