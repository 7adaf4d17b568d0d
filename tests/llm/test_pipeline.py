from common import documents, shipped  # noqa: F401
from conftest import SF
from test_decontaminate import distance, words
from test_line_chunks import deduplicated
from test_near_jaccard import kept_by_brute_force
from test_packing import check
from tokenizers import Tokenizer

import corpus_pipeline
from sensorframe.llm import decontaminate
from sensorframe.llm.queries import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, tmp_path, shipped):  # noqa: F811
    docs, tables = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        tables.append(docs.collect())
        assert k == 4 or docs.columns == COLUMNS
    quality, lines, near, clean, pieces = tables
    # quality: rows as they were; what is dropped is labelled bad nearly always
    source = {r.doc_id: tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(source[r.doc_id] == tuple(r) for r in quality)
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    kept = {r.doc_id for r in quality}
    assert len(bad & kept) <= 0.1 * len(bad) and len(kept) > 0.8 * len(source)
    expected = deduplicated({r.doc_id: r.text for r in quality})
    assert {r.doc_id: r.text for r in lines} == {i: t for i, (t, _) in expected.items()} and all(r.n_chars == len(r.text) for r in lines)
    assert {r.doc_id for r in near} == kept_by_brute_force({r.doc_id: r.text for r in lines})
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    runs = {tuple(w[k : k + 5]): n for n, w in enumerate(items) for k in range(len(w) - 4)}
    held = set()
    for r in near:
        w = words(r.text)
        for n in {runs[t] for k in range(len(w) - 4) if (t := tuple(w[k : k + 5])) in runs}:
            if distance(items[n], w) <= decontaminate.edits(len(items[n])):
                held.add(r.doc_id)
    assert {r.doc_id for r in near} - {r.doc_id for r in clean} == held
    check(Tokenizer.from_file(TOKENIZER), {r.doc_id: r.text for r in clean}, pieces)


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_awkward_rows_pass_all_stages(spark, shipped):  # noqa: F811
    for docs in (documents(spark), documents(spark, [])):
        docs = docs.select(*COLUMNS)
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
