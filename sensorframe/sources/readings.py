"""Chunk files ``readings_{n}.json``: scan, order, validation and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorframe.functions import from_epoch_seconds, to_real
from sensorframe.schema import CHUNK_FILE

CHUNK_NAME = r"readings_(\d+)\.json"


def chunk_number(path: Column) -> Column:
    """``n`` of ``readings_{n}.json``, anywhere in the path; null for other files."""
    return F.regexp_extract(path, CHUNK_NAME, 1).try_cast("int")


def json_reader(reader):
    """Common options of the batch and the stream reader. A broken document fails the load."""
    return reader.schema(CHUNK_FILE).option("multiLine", True).option("mode", "FAILFAST")


def flatten_chunks(raw: DataFrame, with_pos: bool) -> DataFrame:
    """One row per reading of a chunk file, in table types, for both file shapes.

    ``pos`` orders the readings of a chunk: the row number of the scan (a bare array gives one row
    per reading) plus the index in the array (an object gives one row per file).
    """
    # a row without a response list is a reading of a bare array, also if it holds nothing: validation rejects it
    items = F.coalesce(F.col("response"), F.array(F.struct("userId", "lastUpdatedTime", "connection")))
    chunk = chunk_number(F.col("_metadata.file_path")).alias("chunk")
    if with_pos:
        rows = raw.select(chunk, F.monotonically_increasing_id().alias("_row"), F.posexplode(items).alias("_at", "r"))
        lead = [F.col("chunk"), (F.col("_row") + F.col("_at")).alias("pos")]
    else:
        rows = raw.select(chunk, F.explode(items).alias("r"))
        lead = [F.col("chunk")]
    return rows.filter("chunk IS NOT NULL").select(
        *lead,
        F.col("r.userId").alias("user_id"),
        from_epoch_seconds("r.lastUpdatedTime").alias("ts"),
        to_real("r.connection.rssi").alias("rssi"),
        F.col("r.connection.ssid").alias("ssid"),
    )


def scan_readings(spark: SparkSession, path: str) -> DataFrame:
    """All readings under ``path``: ``chunk, pos, user_id, ts, rssi, ssid``, not yet validated.

    A document cannot be split, so a chunk file is one task; write the result to an event table
    once and query that.
    """
    return flatten_chunks(json_reader(spark.read).json(path), with_pos=True)


def is_complete() -> Column:
    """The table's NOT NULL rule, as a predicate."""
    return F.expr("user_id IS NOT NULL AND ts IS NOT NULL AND rssi IS NOT NULL AND ssid IS NOT NULL")


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """The readings that satisfy the table's NOT NULL rule; ``chunk_progress`` counts the others."""
    return scan_readings(spark, path).filter(is_complete())


def chunk_files(spark: SparkSession, path: str, complete: bool = True) -> DataFrame:
    """``(chunk, ordinal, file_bytes)`` in load order, without reading the files.

    Chunks are loaded by number, so 10 comes after 9 and not after 1. A gap in the numbers 0, 1, 2, .. is an
    error, raised while the listing is read, unless ``complete`` is false.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = files.select(chunk_number(F.col("path")).alias("chunk"), F.col("length").alias("file_bytes"))
    ordinal = F.row_number().over(Window.orderBy("chunk")).cast("bigint")
    numbered = listed.filter("chunk IS NOT NULL").select("chunk", ordinal.alias("ordinal"), "file_bytes")
    if not complete:
        return numbered
    missing = F.concat(F.lit("missing chunk file: readings_"), (F.col("ordinal") - 1).cast("string"), F.lit(".json"))
    checked = F.when(F.col("chunk") == F.col("ordinal") - 1, F.col("chunk")).otherwise(F.raise_error(missing).cast("int"))
    return numbered.select(checked.alias("chunk"), "ordinal", "file_bytes")


#: Counts of loaded and rejected readings of a chunk.
CHUNK_COUNTS = "chunk INT, n BIGINT, rejected BIGINT"


def loaded_counts() -> list[Column]:
    return [F.count_if(is_complete()).alias("n"), F.count_if(~is_complete()).alias("rejected")]


def chunk_counts(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("chunk").agg(*loaded_counts())


def with_running_total(files: DataFrame, counts: DataFrame) -> DataFrame:
    """``(chunk, n, rejected, n_records)`` of every chunk file, counted or not; ``n_records`` is the running total of ``n``.

    Only the per-chunk counts pass through the ordered window.
    """
    running = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = files.select("chunk").join(counts, "chunk", "left").fillna(0, ["n", "rejected"])
    return rows.select("chunk", "n", "rejected", F.sum("n").over(running).alias("n_records"))


def chunk_progress(spark: SparkSession, path: str) -> DataFrame:
    """``(chunk, n, rejected, n_records)`` of every chunk file under ``path``, those without a reading included."""
    return with_running_total(chunk_files(spark, path), chunk_counts(scan_readings(spark, path)))
