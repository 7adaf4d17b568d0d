import datetime as dt

import pytest
from pyspark.sql import functions as F

from sensorframe.functions import n_rows
from sensorframe.operators import bucket_agg, gap_fill
from sensorframe.streaming import append_available, stream_gap_fill

KIND = "s string, k long, ts timestamp, bucket string, n string"
HOUR = 3600


def micros(seconds):
    return F.timestamp_micros(F.lit((1_704_067_200 + seconds) * 1_000_000))  # after 2024-01-01 UTC


def rows_at(spark, rows):
    """Rows ``(series, seconds)``; the table has other columns with the names of the result."""
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    return spark.createDataFrame([(s, 1, None if t is None else start + dt.timedelta(seconds=t), "x", "y") for s, t in rows], KIND).coalesce(1)


def steps(spark, tmp_path, batches, lo, hi):
    """Buckets ``(series, hour, minutes, n)`` of the table after each batch of rows."""
    source, seen = f"{tmp_path}/in", []
    for batch in batches:
        rows_at(spark, batch).write.mode("append").parquet(source)
        stream = spark.readStream.schema(KIND).parquet(source)
        filled = stream_gap_fill(stream, HOUR, micros(lo), None if hi is None else micros(hi), ["s", "k"], "30 minutes")
        got = append_available(filled, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        at = (F.unix_timestamp("bucket") - 1_704_067_200) / HOUR
        seen.append(sorted(tuple(r) for r in got.select(
            F.coalesce("s", F.lit("")), at.cast("int"), ((F.unix_timestamp("bucket_end") - F.unix_timestamp("bucket")) / 60).cast("int"), "n").collect()))
    return seen


def test_silent_series_give_out_empty_buckets(spark, tmp_path):
    """``a`` falls silent after its first hour, ``b`` starts late, the null series has a gap: what time has passed is complete after each step."""
    lo, hi = HOUR // 2, 5 * HOUR + HOUR // 2
    batches = [
        [("a", 2000), ("a", 2001), ("a", 100), ("a", 2000), (None, 3700), ("a", None)],
        [("b", 2 * HOUR + 5), (None, 3 * HOUR + 1800)],
        [("b", 5), ("other", 9 * HOUR)],  # five seconds after the start is late by now, nine hours are outside
    ]
    first, second, third = steps(spark, tmp_path, batches, lo, hi)
    assert first == []
    assert second == sorted([("a", 0, 60, 3), ("a", 1, 60, 0), ("a", 2, 60, 0), ("", 0, 60, 0), ("", 1, 60, 1), ("", 2, 60, 0), ("b", 0, 60, 0), ("b", 1, 60, 0), ("b", 2, 60, 1)])
    kept = rows_at(spark, [r for b in batches for r in b if r != ("b", 5)]).filter((F.col("ts") >= micros(lo)) & (F.col("ts") < micros(hi)))
    batch = gap_fill(bucket_agg(kept.drop("bucket", "n"), "1 hour", [n_rows()], ["s", "k"]), "1 hour", micros(lo), micros(hi), {"n": 0}, ["s", "k"])
    expected = batch.select(F.coalesce("s", F.lit("")), ((F.unix_timestamp("bucket") - 1_704_067_200) / HOUR).cast("int"),
                            ((F.unix_timestamp("bucket_end") - F.unix_timestamp("bucket")) / 60).cast("int"), "n").collect()
    assert third == sorted(map(tuple, expected)) and len(third) == 18 and ("a", 5, 30, 0) in third


@pytest.mark.parametrize("hi", [None, 3 * HOUR])
def test_a_step_without_new_rows_adds_nothing(spark, tmp_path, hi):
    one, two, three = steps(spark, tmp_path, [[("a", 10), ("b", 4 * HOUR)], [], [("b", 5 * HOUR)]], 0, hi)
    assert one == two
    assert [r for r in three if r[0] == "a"] == [("a", h, 60, int(h == 0)) for h in range(4 if hi is None else 3)]


def test_empty_range(spark, tmp_path):
    rows_at(spark, [("a", 10)]).write.parquet(f"{tmp_path}/in")
    filled = stream_gap_fill(spark.readStream.schema(KIND).parquet(f"{tmp_path}/in"), HOUR, F.lit(None).cast("timestamp"), micros(5), ["s"], "1 hour")
    assert append_available(filled, f"{tmp_path}/out", f"{tmp_path}/c").count() == 0
