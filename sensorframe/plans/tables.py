"""The engine's tables as derived from the given ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorframe.functions import SECOND_US, day_date, floor_to
from sensorframe.operators.timeslice import UNCUT_TS
from sensorframe.session import scratch_dir, stamp
from sensorframe.sources import build_runlogs, write_events, write_runlogs

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"

#: Rows of a chunk document of the staged readings; the last one may have fewer.
CHUNK_ROWS = 700


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def event_columns(e: DataFrame) -> DataFrame:
    """``events`` in the columns of the event table, and the instants before they are cut to seconds."""
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("simuser-"), F.col("user_id").cast("string")).alias("user_id"),
        floor_to("ts", SECOND_US).alias("ts"),
        (F.lit(-20.0) - F.col("value")).cast("float").alias("rssi"),
        F.concat(F.lit("AP-"), F.regexp_extract("props", "([0-9]+)", 1)).alias("ssid"),
        F.col("ts").alias(UNCUT_TS),
    )


def user_events(spark: SparkSession, sf_dir: str, uncut: bool = False) -> DataFrame:
    """The event table; ``uncut`` keeps the uncut instants, so that slices are pushed into the scan."""
    table = event_columns(events(spark, sf_dir))
    return table if uncut else table.drop(UNCUT_TS)


def ingest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load log: one chunk per engine, run and day, with the running counter a loader writes."""
    parts = events(spark, sf_dir).groupBy(
        F.col("event_type").alias("engine"), (F.col("event_id") % 5).alias("run"),
        (F.dayofmonth(day_date("ts")) - 1).alias("chunk"),
    ).agg(F.floor(F.sum("value")).alias("duration_ms"), F.count("*").alias("n"))
    return parts.selectExpr(
        "engine", "run", "chunk", "duration_ms",
        "sum(n) OVER (PARTITION BY engine, run ORDER BY chunk) AS n_records")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query log with one engine that always fails some queries, a 0 ms query and scattered failures."""
    e = events(spark, sf_dir).select(
        F.col("event_type").alias("engine"), (F.col("event_id") % 5).alias("run"),
        (1 + F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 20).alias("query_id"), "event_id", "value")
    duration = (
        F.when((F.col("engine") == "error") & (F.col("query_id") > 14), -1)
        .when((F.col("engine") == "view") & (F.col("query_id") == 3), 0)
        .when(F.col("event_id") % 17 == 0, -1)
        .otherwise(F.floor("value"))
    )
    return e.select("engine", "run", "query_id", duration.cast("bigint").alias("duration_ms"))


def run_log_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query log with one entry per run and query, as one document holds."""
    return run_log(spark, sf_dir).groupBy("engine", "run", "query_id").agg(
        F.max("duration_ms").alias("duration_ms")).withColumn(
        "description", F.concat(F.lit("Query "), F.col("query_id").cast("string")))


def chunked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with the chunk each row is staged in: ``CHUNK_ROWS`` consecutive rows in order of id.

    Rows are numbered inside ranges of the id, shifted by the rows of earlier ranges. The ranges are written
    first, because drawing them again could draw them elsewhere.
    """
    def write(path: str) -> None:
        user_events(spark, sf_dir).repartitionByRange("id").withColumn("range", F.spark_partition_id()).write.parquet(path)

    rows = spark.read.parquet(stage_once(spark, sf_dir, "by-id", write))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("id"))
    numbered = rows.withColumn("at", inside).join(F.broadcast(starts), "range")  # a row for each task of the scan
    return numbered.withColumn("chunk", F.floor((F.col("start") + F.col("at") - 1) / CHUNK_ROWS).cast("int")).drop("range", "at", "start")


_staged: dict[tuple, str] = {}


def once_key(spark: SparkSession, sf_dir: str, what: str) -> tuple:
    """What is derived from a session's input, until the input is rewritten."""
    return spark.sparkContext.applicationId, sf_dir, what, stamp(spark, f"{sf_dir}/events.parquet")


def stage_once(spark: SparkSession, sf_dir: str, what: str, write) -> str:
    key = once_key(spark, sf_dir, what)
    if key not in _staged:
        path = scratch_dir(spark, what)
        write(path)
        _staged[key] = path
    return _staged[key]


def write_chunk_files(chunks: DataFrame, path: str) -> None:
    """Add a document for each chunk of ``chunks`` to the folder ``path``.

    Even chunks are objects with a ``response`` list, odd ones bare arrays. Every reading is a line
    of its document, with the brackets and commas around it, so that a document is written row by
    row and never held in memory.
    """
    reading = F.to_json(F.struct(
        F.col("user_id").alias("userId"), F.unix_seconds("ts").alias("lastUpdatedTime"),
        F.struct("ssid", "rssi").alias("connection")))
    rows = chunks.select(
        F.concat(F.lit("readings_"), F.col("chunk").cast("string"), F.lit(".json")).alias("file"),
        "id", (F.col("chunk") % 2 == 0).alias("is_object"), reading.alias("reading"))
    in_file = Window.partitionBy("file").orderBy("id")
    is_first, is_last = F.lag("id").over(in_file).isNull(), F.lead("id").over(in_file).isNull()
    opening = F.when(is_first, F.when(F.col("is_object"), '{"response": [').otherwise("[")).otherwise("")
    closing = F.when(is_last, F.when(F.col("is_object"), "]}").otherwise("]")).otherwise(",")
    # the window leaves the rows ordered by file and id, and the writer keeps that order
    rows.select(F.concat(opening, "reading", closing).alias("value"), "file").write.mode("append").partitionBy("file").text(path)


def staged_readings(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the event table as chunk files, written once per session and state of the input."""
    def write(path: str) -> None:
        write_chunk_files(chunked_events(spark, sf_dir), path)
        # after the last chunk one without readings, and one with a reading that holds nothing
        chunked_events(spark, sf_dir).agg((F.coalesce(F.max("chunk"), F.lit(-1)) + 1).alias("n")).select(F.inline(F.array(*[
            F.struct(F.lit(text).alias("value"), F.concat(F.lit("readings_"), (F.col("n") + k).cast("string"), F.lit(".json")).alias("file"))
            for k, text in enumerate(['{"response": []}', "[{}]"])
        ]))).write.mode("append").partitionBy("file").text(path)

    return stage_once(spark, sf_dir, "readings", write)


def staged_runlogs(spark: SparkSession, sf_dir: str) -> str:
    """Folder with one run-log document per engine and run."""
    return stage_once(spark, sf_dir, "runlogs", lambda path: write_runlogs(
        build_runlogs(ingest_log(spark, sf_dir), run_log_per_query(spark, sf_dir)), path))


def staged_by_time(spark: SparkSession, sf_dir: str) -> str:
    """The event table in the ``time`` layout."""
    return stage_once(spark, sf_dir, "by-time", lambda path: write_events(user_events(spark, sf_dir), path, "time"))
