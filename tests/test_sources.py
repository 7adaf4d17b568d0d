import json
import os
import pathlib

import pytest
from conftest import SF, at, scan_lines
from pyspark.sql import functions as F

from sensorframe import session
from sensorframe.functions import rfc3339
from sensorframe.operators import around_midpoint, bucket_agg, midpoint, row_count, time_bounds, time_slice, with_dense_id
from sensorframe.plans import QUERIES
from sensorframe.plans.loading import _streamed
from sensorframe.plans.tables import user_events
from sensorframe.session import scratch_dir, write_text
from sensorframe.sources import (
    as_variant, chunk_files, chunk_progress, read_events, read_readings, to_points, upsert_points, write_events,
)
from sensorframe.streaming import (
    latest_buckets, load_available, load_shares, load_with_progress, run_bucket_agg, scan_stream, stream_bucket_agg, stream_progress,
    stream_readings,
)

EPOCH = 1704067200  # 2024-01-01


def reading(user, sec, rssi=-60.5, ssid="AP-1"):
    return {"userId": user, "lastUpdatedTime": EPOCH + sec, "connection": {"ssid": ssid, "rssi": rssi}}


def write_chunks(folder, chunks):
    """Chunk files by number; even ones in the object shape, odd ones as bare arrays."""
    for n, rows in chunks.items():
        doc = {"response": rows} if n % 2 == 0 else rows
        (folder / f"readings_{n}.json").write_text(json.dumps(doc))
    return str(folder)


@pytest.fixture
def chunks(tmp_path):
    return write_chunks(tmp_path, {n: [reading(f"u{n}", 10 * n + i) for i in range(n % 3 + 1)] for n in range(12)})


def test_both_file_shapes_and_order_of_readings(spark, chunks):
    rows = read_readings(spark, chunks).orderBy("chunk", "pos").collect()
    expected = [(n, f"u{n}", at(10 * n + i)) for n in range(12) for i in range(n % 3 + 1)]
    assert [(r["chunk"], r["user_id"], r["ts"]) for r in rows] == expected
    assert [f.dataType.simpleString() for f in read_readings(spark, chunks).schema] == [
        "int", "bigint", "string", "timestamp", "float", "string"]


def test_ids_follow_the_load_order(spark, chunks):
    rows = with_dense_id(read_readings(spark, chunks)).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1, len(rows) + 1))
    assert [r["ts"] for r in rows] == [at(10 * n + i) for n in range(12) for i in range(n % 3 + 1)]


def test_chunks_are_ordered_by_number(spark, tmp_path):
    folder = write_chunks(tmp_path, {n: [reading("u", n)] for n in (1, 10, 2)})
    (tmp_path / "notes.json").write_text("{}")
    got = [(r["chunk"], r["ordinal"]) for r in chunk_files(spark, folder, complete=False).orderBy("ordinal").collect()]
    assert got == [(1, 1), (2, 2), (10, 3)]


@pytest.mark.parametrize("numbers", [(1, 2), (0, 2), (0, 1, 3, 4)])
def test_a_gap_in_the_chunks_is_an_error(spark, tmp_path, numbers):
    folder = write_chunks(tmp_path, {n: [reading("u", n)] for n in numbers})
    for listing in (chunk_files(spark, folder), chunk_progress(spark, folder)):
        with pytest.raises(Exception, match="missing chunk file"):
            listing.collect()


def test_listing_chunks_reads_no_content(spark, chunks):
    assert all("content" not in line for line in scan_lines(chunk_files(spark, chunks)))


def test_incomplete_readings_are_rejected_and_counted(spark, tmp_path):
    folder = write_chunks(tmp_path, {
        0: [reading("a", 1), reading(None, 2), reading("b", 3)],
        1: [reading("c", 4, rssi=None), reading("d", 5)],
        2: [],
        3: [],
        4: [{}, reading("e", 6)],
        5: [{}, reading("f", 7)],
    })
    assert read_readings(spark, folder).count() == 5
    expected = [(0, 2, 1, 2), (1, 1, 1, 3), (2, 0, 0, 3), (3, 0, 0, 3), (4, 1, 1, 4), (5, 1, 1, 5)]
    progress = chunk_progress(spark, folder).orderBy("chunk").collect()
    assert [tuple(r) for r in progress] == expected
    table, steps = scratch_dir(spark, "t"), scratch_dir(spark, "s")
    checkpoint = scratch_dir(spark, "c")
    for _ in range(2):  # the second load finds nothing new and repeats nothing
        load_with_progress(scan_stream(spark, folder, files_per_trigger=1), table, steps, checkpoint).awaitTermination()
        assert [tuple(r) for r in stream_progress(spark, folder, steps).orderBy("chunk").collect()] == expected
        assert spark.read.parquet(table).count() == 5
    assert len(os.listdir(steps)) == 6 + 1


def test_a_step_of_one_chunk_is_one_job(spark, chunks):
    table, steps, checkpoint = (scratch_dir(spark, x) for x in "tsc")
    load = load_with_progress(scan_stream(spark, chunks, files_per_trigger=1), table, steps, checkpoint)
    load.awaitTermination()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(load.runId))) == 12  # one for each file


def test_a_step_of_many_chunks_counts_each(spark, tmp_path):
    folder = write_chunks(tmp_path, {n: [reading("a", n), reading(None, n), reading("b", n)][: n % 4] for n in range(9)})
    table, steps, checkpoint = (scratch_dir(spark, x) for x in "tsc")
    load_with_progress(scan_stream(spark, folder), table, steps, checkpoint).awaitTermination()
    assert sorted(os.listdir(steps)) == ["step=-1", "step=0"]
    expected, got = chunk_progress(spark, folder), stream_progress(spark, folder, steps)
    assert [tuple(r) for r in got.orderBy("chunk").collect()] == [tuple(r) for r in expected.orderBy("chunk").collect()]


def test_a_repeated_step_replaces_its_rows_and_counts(spark, tmp_path):
    folder = write_chunks(tmp_path, {0: [reading("a", 1), reading(None, 2)], 1: [reading("b", 3)]})
    table, steps, checkpoint = (scratch_dir(spark, x) for x in "tsc")
    for _ in range(2):
        load_with_progress(scan_stream(spark, folder, files_per_trigger=1), table, steps, checkpoint).awaitTermination()
        assert [tuple(r) for r in stream_progress(spark, folder, steps).orderBy("chunk").collect()] == [(0, 1, 1, 1), (1, 1, 0, 2)]
        assert spark.read.parquet(table).count() == 2
        for name in ("1", ".1.crc"):  # as if the load had broken off at the end of its last step
            (pathlib.Path(checkpoint) / "commits" / name).unlink(missing_ok=True)


def test_many_steps_are_listed_in_few_tasks(spark, chunks):
    steps, context = scratch_dir(spark, "s"), spark.sparkContext
    for n in range(120):
        write_text(spark, f"{steps}/step={n}/counts.json", json.dumps({"chunk": n % 12, "n": 1, "rejected": 0}))
    context.setJobGroup("listing", "")
    try:
        progress = stream_progress(spark, chunks, steps)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 4 * context.defaultParallelism
    assert [tuple(r) for r in progress.orderBy("chunk").collect()] == [(n, 10, 0, 10 * (n + 1)) for n in range(12)]


def test_the_setting_for_log_entries_is_given_back(spark, chunks):
    name = "spark.sql.streaming.checkpointFileManagerClass"
    for own in (None, "org.apache.spark.sql.execution.streaming.checkpointing.FileContextBasedCheckpointFileManager"):
        if own:
            spark.conf.set(name, own)
        try:
            table, steps, checkpoint = (scratch_dir(spark, x) for x in "tsc")
            load_shares([scan_stream(spark, chunks, files_per_trigger=6)], table, steps, checkpoint)
            assert spark.conf.get(name, None) == own
            assert spark.read.parquet(table).count() == 24
        finally:
            spark.conf.unset(name)


def test_shares_are_loaded_at_a_time_one_file_a_step(spark, tmp_path):
    folder = write_chunks(tmp_path, {n: [reading("a", n), reading(None, n)][: n % 3] for n in range(13)})
    expected = [tuple(r) for r in chunk_progress(spark, folder).orderBy("chunk").collect()]
    table, steps, checkpoint = (scratch_dir(spark, x) for x in "tsc")

    def load():
        # the last share has no file
        load_shares([scan_stream(spark, f"{folder}/readings_*{d}.json", files_per_trigger=1) for d in "0123456789x"], table, steps, checkpoint)
        return [tuple(r) for r in stream_progress(spark, folder, steps).orderBy("chunk").collect()]

    for _ in range(2):  # the second load finds nothing new and repeats nothing
        assert load() == expected
        rows = spark.read.parquet(table).groupBy("share", "step").agg(F.collect_list("chunk").alias("chunks")).collect()
        assert sorted(r.chunks for r in rows) == [[n] for n in range(13) if n % 3]
        assert len({r.share for r in rows}) > 1
    assert [len(os.listdir(f"{steps}/share={d}")) for d in range(11)] == [3, 3, 3, 2, 2, 2, 2, 2, 2, 2, 1]


def test_a_share_that_fails_is_loaded_by_the_next_call(spark, tmp_path):
    folder = write_chunks(tmp_path, {n: [reading("a", n)] for n in range(6)})
    broken = tmp_path / "readings_3.json"
    whole = broken.read_text()
    broken.write_text(whole[:-9])
    table, steps, checkpoint = (scratch_dir(spark, x) for x in "tsc")
    shares = [scan_stream(spark, f"{folder}/readings_*{d}.json", files_per_trigger=1) for d in range(6)]
    with pytest.raises(Exception, match="(?i)malformed"):
        load_shares(shares, table, steps, checkpoint)
    assert not spark.streams.active
    broken.write_text(whole)
    load_shares(shares, table, steps, checkpoint)
    assert sorted(r.chunk for r in spark.read.parquet(table).collect()) == list(range(6))


def test_registered_stream_loads_one_file_a_step_in_shares(spark):
    rows = spark.read.parquet(f"{_streamed(spark, SF)}/rows").groupBy("share", "step").agg(F.count_distinct("chunk").alias("n")).collect()
    assert {r.n for r in rows} == {1} and len({r.share for r in rows}) == 10


def test_broken_document_fails_the_load(spark, tmp_path):
    (tmp_path / "readings_0.json").write_text('{"response": [{"userId": "a", ')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_readings(spark, str(tmp_path)).collect()


def test_stream_loads_every_file_once(spark, chunks, tmp_path):
    table, checkpoint = scratch_dir(spark, "t"), scratch_dir(spark, "c")

    def load():
        query = load_available(stream_readings(spark, chunks, files_per_trigger=1), table, checkpoint)
        query.awaitTermination()
        return spark.read.parquet(table).count()

    batch = read_readings(spark, chunks).drop("pos")
    assert load() == batch.count() == 24
    streamed = spark.read.parquet(table)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    assert load() == 24, "nothing new, nothing loaded"
    with open(os.path.join(chunks, "readings_12.json"), "w") as f:
        json.dump({"response": [reading("new", 500)]}, f)
    assert load() == 24 + 1


def test_stream_counts_equal_batch_counts_for_files_in_any_order(spark, tmp_path):
    source = scratch_dir(spark, "shuffled")
    rows = spark.range(5000).select(F.timestamp_seconds(F.lit(EPOCH) + F.col("id") * 61).alias("ts"))
    rows.orderBy(F.hash("ts")).repartition(6).write.parquet(source)
    stream = spark.readStream.schema("ts TIMESTAMP").option("maxFilesPerTrigger", 1).parquet(source)
    updates = scratch_dir(spark, "u")
    run_bucket_agg(stream_bucket_agg(stream, "1 hour"), updates, scratch_dir(spark, "c"))
    got = {r["bucket"]: r["n"] for r in latest_buckets(spark, updates).collect()}
    want = {r[0]: r[1] for r in rows.groupBy(F.date_trunc("hour", "ts")).count().collect()}
    assert got == want


def test_stream_without_files(spark, tmp_path):
    stream = spark.readStream.schema("ts TIMESTAMP").parquet(str(tmp_path))
    updates = scratch_dir(spark, "u")
    run_bucket_agg(stream_bucket_agg(stream, "1 hour"), updates, scratch_dir(spark, "c"))
    assert latest_buckets(spark, updates).count() == 0


def test_watermark_releases_old_buckets(spark):
    source = scratch_dir(spark, "late")
    for seconds in (0, 10 * 3600, 10 * 3600 + 1, 60):  # the last file is ten hours late
        spark.createDataFrame([(at(seconds),)], "ts timestamp").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("ts TIMESTAMP").option("maxFilesPerTrigger", 1).parquet(source)
    updates = scratch_dir(spark, "u")
    run_bucket_agg(stream_bucket_agg(stream, "1 hour", watermark="1 hour"), updates, scratch_dir(spark, "c"))
    got = {r["bucket"]: r["n"] for r in latest_buckets(spark, updates).collect()}
    assert got == {at(0): 1, at(10 * 3600): 2}


@pytest.mark.parametrize("layout", ["plain", "time", "shards", "sorted"])
def test_layouts_keep_every_row(spark, layout):
    ue = user_events(spark, SF)
    table = scratch_dir(spark, layout)
    for half in (0, 1):
        write_events(ue.filter(F.col("id") % 2 == half), table, layout)
    stored = read_events(spark, table, layout).select(ue.columns)
    assert stored.exceptAll(ue).count() == 0 and ue.exceptAll(stored).count() == 0


def test_time_layout_prunes_partitions(spark):
    ue = user_events(spark, SF)
    table = scratch_dir(spark, "time")
    write_events(ue, table, "time")
    stored = read_events(spark, table, "time")
    assert tuple(time_bounds(stored).first()) == tuple(time_bounds(ue).first())
    cut = row_count(time_slice(stored, midpoint(stored, plus_hours=-1), midpoint(stored, plus_hours=1)))
    assert cut.first()["n"] == row_count(time_slice(ue, midpoint(ue, plus_hours=-1), midpoint(ue, plus_hours=1))).first()["n"]
    literal = time_slice(stored, F.lit(at(86400)), F.lit(at(2 * 86400)), "left")
    assert literal.count() == time_slice(ue, F.lit(at(86400)), F.lit(at(2 * 86400)), "left").count()
    scans = scan_lines(literal)
    assert all("event_date#" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)
    assert any("GreaterThanOrEqual(ts,2024-01-02" in line for line in scans)
    counting = scan_lines(row_count(literal))
    assert {line.split("ReadSchema: ")[1] for line in counting} == {"struct<>", "struct<ts:timestamp>"}


@pytest.mark.parametrize("closed", ["both", "left", "none"])
def test_slices_of_the_time_layout_equal_slices_of_the_table(spark, closed):
    ue = user_events(spark, SF)
    table = scratch_dir(spark, "time")
    write_events(ue, table, "time")
    stored = read_events(spark, table, "time")
    exact = ue.orderBy("ts").limit(3000).agg(F.max("ts")).first()[0]  # a bound that rows lie on
    hour = 3600
    for lo, hi in [(None, exact), (exact, None), (None, None), (at(5 * hour), exact), (exact, exact),
                   (at(4 * hour), at(8 * hour)), (at(5 * hour), at(6 * hour)), (at(9 * hour), at(hour))]:
        bounds = [None if b is None else F.lit(b) for b in (lo, hi)]
        got, want = (time_slice(t, *bounds, closed).agg(F.count("*"), F.sum("id")).first() for t in (stored, ue))
        assert tuple(got) == tuple(want), (lo, hi)


def test_midpoint_reaches_the_partition_filters(spark):
    table = scratch_dir(spark, "time")
    write_events(user_events(spark, SF), table, "time")
    stored = read_events(spark, table, "time")
    scans = scan_lines(row_count(time_slice(stored, lo=midpoint(stored), closed="none")))
    assert any("ubquery" in line.split("PartitionFilters: [")[1].split("PushedFilters")[0] for line in scans)


def test_one_bound_is_pushed_into_the_scan_of_a_sorted_table(spark):
    table = scratch_dir(spark, "sorted")
    write_events(user_events(spark, SF), table, "sorted", partitions=6)
    stored = read_events(spark, table)
    cut = row_count(time_slice(stored, hi=midpoint(stored), closed="none"))
    assert any("LessThan(ts,ScalarSubquery" in line for line in scan_lines(cut))


def test_both_bounds_are_pushed_into_the_scan(spark):
    table = scratch_dir(spark, "sorted")
    write_events(user_events(spark, SF), table, "sorted", partitions=6)
    for source, column in ((read_events(spark, table), "ts"), (user_events(spark, SF, uncut=True), "ts")):
        cut = row_count(time_slice(source, *around_midpoint(source, -1, 1)))
        pushed = [line.split("PushedFilters: [")[1] for line in scan_lines(cut)]
        assert any(f"GreaterThanOrEqual({column},2024" in p and f"({column},2024" in p.split("LessThan")[1] for p in pushed), pushed


def test_slices_over_another_column_and_in_another_zone(spark):
    rows = user_events(spark, SF).withColumn("seen", F.expr("ts + make_interval(0, 0, 0, id % 5, (id * 7) % 24)"))
    table = scratch_dir(spark, "time")
    write_events(rows, table, "time")
    stored = spark.read.parquet(table)
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            for ts in ("ts", "seen"):
                assert tuple(time_bounds(stored, ts).first()) == tuple(time_bounds(rows, ts).first())
                lo, hi = around_midpoint(rows, -5, 30, ts=ts)
                got, want = (time_slice(t, lo, hi, "left", ts).agg(F.count("*"), F.sum("id")).first() for t in (stored, rows))
                assert tuple(got) == tuple(want) and got[0] > 0
            days = bucket_agg(stored, "1 day", [F.count("*").alias("n")], name="day", as_date=True)
            starts = bucket_agg(stored, "1 day", [F.count("*").alias("n")], name="day")
            assert {(r.day.isoformat(), r.n) for r in days.collect()} == {
                (text, n) for text, n in starts.select(F.substring(rfc3339("day"), 1, 10), "n").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_sparse_ids_and_rewritten_input_are_staged(spark, tmp_path):
    def stage(ids):
        rows = spark.createDataFrame([(i, at(k), k % 3, "view", 1.5, '{"k": 1}') for k, i in enumerate(ids)],
                                     "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
        rows.write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        return QUERIES["ingest_progress"](spark, str(tmp_path)).orderBy("chunk").collect()

    assert [r.n for r in stage([k * 10**15 for k in range(1500)])] == [700, 700, 100, 0, 0]
    assert [tuple(r) for r in stage([0, 10**18, 2 * 10**18, 3 * 10**18])] == [(0, 4, 0, 4), (1, 0, 0, 4), (2, 0, 1, 4)]


def test_scratch_folders(spark, tmp_path, monkeypatch):
    class Cluster:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077", "applicationId": "x"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(Cluster, "x")
    monkeypatch.setattr(session, "_scratch", {})
    mine, other = scratch_dir(spark, "mine"), tmp_path / "other"
    other.mkdir()
    spark.range(3).write.parquet(mine)
    assert session.clear_scratch(spark) == 1 and not os.path.exists(mine) and other.exists()
    assert session.clear_scratch(spark) == 0


def test_sorted_files_cover_disjoint_times(spark):
    table = scratch_dir(spark, "sorted")
    write_events(user_events(spark, SF), table, "sorted", partitions=6)
    spans = sorted(tuple(r) for r in read_events(spark, table).groupBy(F.col("_metadata.file_path")).agg(
        F.min("ts"), F.max("ts")).select(F.col("min(ts)"), F.col("max(ts)")).collect())
    assert len(spans) == 6
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_crowded_instant_is_spread_over_files(spark, make_events):
    ue = spark.range(20000).selectExpr(
        "id", "'u' AS user_id", "timestamp'2024-01-01' AS ts", "CAST(-60 AS FLOAT) AS rssi", "'x' AS ssid")
    table = scratch_dir(spark, "crowded")
    write_events(ue, table, "sorted", partitions=4)
    sizes = [r["count"] for r in read_events(spark, table).groupBy("_metadata.file_path").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 10000


def test_unknown_layout_and_variant(spark, make_events):
    with pytest.raises(ValueError):
        write_events(make_events([]), scratch_dir(spark, "x"), "heap")
    with pytest.raises(ValueError):
        as_variant(make_events([]), "narrow")


def test_points(make_events):
    ue = make_events([("a", 0, -60.5, "x")])
    assert tuple(to_points(ue).first()) == ("user_events", "a", "x", "rssi", -60.5, at(0))


def test_upsert_keeps_the_later_point(make_events):
    ue = make_events([("a", 0, -60.0, "x"), ("a", 0, -50.0, "x"), ("a", 0, -70.0, "y")])
    got = sorted((r["ssid"], r["rssi"], r["id"]) for r in upsert_points(ue).collect())
    assert got == [("x", -50.0, 1), ("y", -70.0, 2)]


def test_upsert_with_null_versions_and_ties(spark):
    rows = [(None, "a", "x", 1.0), (None, "a", "x", 1.0), (None, "b", "x", 5.0), (3, "b", "x", None), (7, "c", "x", 1.0), (7, "c", "y", 2.0)]
    df = spark.createDataFrame(rows, "id long, user_id string, ssid string, rssi float")
    for parts in (1, 4):
        got = {r.user_id: tuple(r) for r in upsert_points(df.repartition(parts), ["user_id"]).collect()}
        assert got["a"] == (None, "a", "x", 1.0) and got["b"] == (3, "b", "x", None)
        assert got["c"] in rows[4:]  # a whole row, not a mixture
