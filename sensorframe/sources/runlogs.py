"""Run logs: one JSON document per run, with an ingestion list and a query list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.schema import RUN_LOG


def _file_name(path: Column) -> Column:
    """File name without ``.json``."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.json)?$", 1)


def read_runlogs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``engine, run, ingestion, queries``, one row per document.

    The engine is the document's ``dbType``, or the file name where that is missing. The run is the document's
    ``run``, which ``write_runlogs`` stores, or else the whole path of the file: equal names in two folders
    are two runs.
    """
    raw = spark.read.schema(RUN_LOG).option("multiLine", True).option("mode", "FAILFAST").json(path)
    file = F.col("_metadata.file_path")
    return raw.select(
        F.coalesce("dbType", _file_name(file)).alias("engine"), F.coalesce("run", file).alias("run"), "ingestion", "queries")


def ingest_facts(docs: DataFrame) -> DataFrame:
    """``engine, run, chunk, duration_ms, n_records``: one row per loaded chunk, counter as logged."""
    return docs.select("engine", "run", F.posexplode("ingestion").alias("chunk", "i")).select(
        "engine", "run", "chunk", F.col("i.durationMs").alias("duration_ms"), F.col("i.nRecords").alias("n_records"))


def query_facts(docs: DataFrame) -> DataFrame:
    """``engine, run, query_id, duration_ms, description``: one row per query execution."""
    described = F.coalesce(F.col("q.description"), F.concat(F.lit("Query "), F.col("q.queryId").cast("string")))
    return docs.select("engine", "run", F.explode("queries").alias("q")).select(
        "engine", "run", F.col("q.queryId").alias("query_id"), F.col("q.durationMs").alias("duration_ms"),
        described.alias("description"))


def build_runlogs(ingest: DataFrame, queries: DataFrame) -> DataFrame:
    """Documents from the two fact tables. Both lists belong to one document of one run."""
    loaded = ingest.groupBy("engine", "run").agg(F.sort_array(F.collect_list(
        F.struct("chunk", F.col("duration_ms").alias("durationMs"), F.col("n_records").alias("nRecords")))).alias("i"))
    asked = queries.groupBy("engine", "run").agg(F.sort_array(F.collect_list(
        F.struct(F.col("query_id").alias("queryId"), F.col("duration_ms").alias("durationMs"), "description"))).alias("queries"))
    return loaded.join(asked, ["engine", "run"], "full").select(
        "engine", "run",
        F.transform("i", lambda x: x.dropFields("chunk")).alias("ingestion"),
        "queries",
    )


def write_runlogs(docs: DataFrame, path: str) -> None:
    """Write every document, with the name of its run, to a file of its own."""
    run = F.col("run").cast("string")
    log = F.concat(F.col("engine"), F.lit("_"), run)
    out = docs.select(F.col("engine").alias("dbType"), run.alias("run"), "ingestion", "queries", F.sha2(log, 256).alias("log"))
    out.write.partitionBy("log").json(path)
