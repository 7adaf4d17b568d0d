"""The queries of this subpackage over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.llm import (
    decontaminate, embedding_dedup, html_consensus, lexical, line_chunks, merkle, packing, pii_surrogates, quality_rank, quality_rules, secret_scan, simhash, url_reputation,
)
from sensorframe.session import ship_package

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rank.score(documents, quality_rank.learn(documents, labels))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the row with its id: bad if its quality is 0."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_reputation.judge(table(spark, sf_dir, "pages"), outcomes)


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is for the given tables only; a user passes a secret one."""
    return pii_surrogates.pseudonymize(table(spark, sf_dir, "documents"), "key of the given tables")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.judge(documents, quality_rules.learn(documents, labels))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.dedup(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op10_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_consensus.extract(table(spark, sf_dir, "pages"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees per lang; rows whose id's CRC-32 three divides are folded from a leaf with the text's A-Z lower-cased."""
    documents, fields = table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    seen = merkle.leaf([F.when(tampered, lowered).otherwise(F.col(f)) if f == "text" else F.col(f) for f in fields])
    rows = merkle.manifest(documents, "doc_id", "lang", fields, {"seen": seen})
    folded = merkle.fold(F.col("seen"), F.col("path"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.components(table(spark, sf_dir, "embeddings"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rank, op2_decontaminate, op3_url_reputation, op4_pii_surrogates, op5_quality_rules, op6_simhash, op7_packing,
    op8_line_chunks, op9_secret_scan, op10_html_consensus, op11_merkle, op12_embedding_dedup, op13_lexical,
)}


def _level(name: str, keys: str, groups: str) -> str:
    """SQL of one level of shrinkage: strength by moments, posterior and rate. ``groups`` have their parent's posterior."""
    return f"""
    {name}_in AS (SELECT *, (up_a - bad) / (up_a + up_b - n) AS prior FROM ({groups})),
    {name}_rho AS (
        SELECT CASE WHEN coalesce(sum(n * (n - 1)), 0) = 0 THEN 0
               ELSE (sum(power(bad - n * prior, 2) / (prior * (1 - prior))) - sum(n)) / sum(n * (n - 1)) END AS rho FROM {name}_in),
    {name}_s AS (SELECT least(greatest(1 / greatest(rho, 1e-3) - 1, 1), 1000) AS s FROM {name}_rho),
    {name} AS (SELECT {keys}, bad + s * prior AS a, n - bad + s * (1 - prior) AS b, (bad + s * prior) / (n + s) AS rate FROM {name}_in, {name}_s)"""


_RULES = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'"
    for v, h, p in sorted(url_reputation.RULES, key=lambda r: -len(r[1] + r[2]))
)
_SUFFIX_LABELS = ", ".join(f"'{x}'" for x in url_reputation.SUFFIX_LABELS)
_TOTALS = "sum(bad) AS bad, sum(n) AS n"

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

ORACLES: dict[str, str] = {
    # the tree of the subroots is one more tree, numbered -1; a leaf's way leads up its own tree, then up that one
    "op11_merkle": f"""
    WITH RECURSIVE crc AS (
        SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t
        FROM range(256) r(b)),
    tampered AS (
        SELECT rowid AS id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
            lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 3 = 0 AS hit
        FROM (SELECT row_number() OVER () AS rowid, doc_id FROM documents) d, crc),
    leaves AS (
        SELECT row_number() OVER () AS id, doc_id, lang, {_LEAF.format(text="text")} AS leaf,
            {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered
        FROM documents),
    placed AS (
        SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
            count(*) OVER (PARTITION BY lang) AS n FROM leaves),
    own AS (
        SELECT tree, 0 AS level, pos, n, leaf AS h FROM placed
        UNION ALL
        SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM own WHERE n > 1 GROUP BY tree, level, pos // 8, n),
    tops AS (
        SELECT -1 AS tree, 0 AS level, tree AS pos, count(*) OVER () AS n, h FROM own WHERE n = 1
        UNION ALL
        SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY tree, level, pos // 8, n),
    steps AS (
        SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
            coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
        FROM (SELECT * FROM own UNION ALL SELECT * FROM tops) a JOIN (SELECT * FROM own UNION ALL SELECT * FROM tops) b
            ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8
        WHERE a.n > 1 GROUP BY ALL),
    heights AS (SELECT tree, max(level) AS height FROM (SELECT * FROM own UNION ALL SELECT * FROM tops) GROUP BY tree),
    way AS (
        SELECT id, unnest(range(height + top)) AS step, pos, p.tree, height,
        FROM placed p JOIN heights USING (tree), (SELECT height AS top FROM heights WHERE tree = -1)),
    walked AS (
        SELECT w.id, w.step, before, after FROM way w JOIN steps s ON w.step < height AND s.tree = w.tree AND s.level = w.step
            AND s.pos = w.pos // power(8, w.step)::BIGINT
        UNION ALL
        SELECT w.id, w.step, before, after FROM way w JOIN steps s ON w.step >= height AND s.tree = -1 AND s.level = w.step - height
            AND s.pos = w.tree // power(8, w.step - height)::BIGINT),
    folding AS (
        SELECT id, 0 AS step, CASE WHEN hit THEN lowered ELSE leaf END AS h FROM placed JOIN tampered USING (id)
        UNION ALL
        SELECT f.id, f.step + 1, sha256(before || h || after) FROM folding f JOIN walked w ON f.id = w.id AND f.step = w.step),
    folded AS (SELECT id, max_by(h, step) AS folded_root FROM folding GROUP BY id),
    proofs AS (SELECT id, sha256(coalesce(string_agg(before || after, '' ORDER BY step), '')) AS proof_sha256 FROM placed LEFT JOIN walked USING (id) GROUP BY id)
    SELECT doc_id, leaf, o.h AS subroot, t.h AS root, proof_sha256, folded_root, folded_root = t.h AS verified
    FROM placed JOIN folded USING (id) JOIN proofs USING (id) JOIN own o ON o.tree = placed.tree AND o.n = 1 JOIN tops t ON t.n = 1""",
    "op3_url_reputation": f"""
    WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages),
    urls AS (
        SELECT page_id,
            coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
            coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path
        FROM rest),
    outcomes AS (SELECT doc_id AS page_id, max(1 - quality) AS bad FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY 1),
    counts AS (
        SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS l
        FROM urls LEFT JOIN outcomes USING (page_id) GROUP BY host),
    domains_of AS (
        SELECT host, n, bad, array_to_string(l[greatest(len(l) - CASE WHEN len(l) >= 3 AND length(l[-1]) = 2 AND l[-2] IN ({_SUFFIX_LABELS})
            THEN 2 ELSE 1 END, 1):], '.') AS domain FROM counts),
    hosts AS (SELECT *, regexp_replace(domain, '^[^.]+[.]', '') AS suffix FROM domains_of),
    {_level("suffixes", "suffix", f"SELECT suffix, {_TOTALS}, (SELECT sum(bad) + 1 FROM hosts) AS up_a, (SELECT sum(n) - sum(bad) + 1 FROM hosts) AS up_b FROM hosts GROUP BY 1")},
    {_level("domains", "domain", f"SELECT domain, sum(h.bad) AS bad, sum(h.n) AS n, any_value(a) AS up_a, any_value(b) AS up_b FROM hosts h JOIN suffixes USING (suffix) GROUP BY 1")},
    {_level("shrunk", "host", "SELECT host, bad, n, a AS up_a, b AS up_b FROM hosts JOIN domains USING (domain)")},
    judged AS (
        SELECT page_id, host, path, round(rate, 6) AS bad_rate,
            round(greatest(0, rate - {url_reputation.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))), 6) AS bad_low,
            CASE {_RULES} END AS found
        FROM urls JOIN shrunk USING (host))
    SELECT page_id, host, path, split_part(found, ' ', 2) AS rule,
        coalesce(split_part(found, ' ', 1), CASE WHEN bad_low > {url_reputation.MAX_BAD} THEN 'block' ELSE 'allow' END) AS verdict,
        bad_rate, bad_low
    FROM judged""",
    "op12_embedding_dedup": """
    WITH RECURSIVE able AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    linked AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
    reached AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reached r JOIN linked l ON r.b = l.a),
    least AS (SELECT a, min(b) AS b FROM reached GROUP BY a),
    counted AS (SELECT a, count(DISTINCT b) AS n FROM linked GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id, component_id = vec_id AS kept
    FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN counted ON vec_id = counted.a""",
    "op13_lexical": r"""
    WITH words AS (
        SELECT d.id, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT row_number() OVER () AS id, * FROM documents) d),
    wanted AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark),
    lengths AS (SELECT id, count(*) AS n FROM words GROUP BY id),
    totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
    counts AS (SELECT id, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY id, term),
    weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term),
    gains AS (
        SELECT id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS gain
        FROM counts JOIN lengths USING (id) JOIN weights USING (term), totals),
    scores AS (SELECT item_id, id, any_value(doc_id) AS doc_id, sum(gain)::BIGINT AS score FROM wanted JOIN gains USING (term) GROUP BY item_id, id),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scores WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
