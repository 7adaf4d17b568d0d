"""Equivalent SQL of the registered queries, for an independent engine (DuckDB) on the same tables."""

EVENT_TABLE = """user_events AS (
  SELECT event_id AS id, concat('simuser-', CAST(user_id AS VARCHAR)) AS user_id,
         date_trunc('second', ts) AS ts, CAST(-20.0 - value AS FLOAT) AS rssi,
         concat('AP-', regexp_extract(props, '([0-9]+)', 1)) AS ssid
  FROM events)"""

BOUNDS = """b AS (
  SELECT min(ts) AS lo, max(ts) AS hi, min(ts) + (max(ts) - min(ts)) / 2 AS mid FROM user_events)"""

# chunks of 700 rows in order of id, whatever the ids are
CHUNKS = """chunked AS (
  SELECT *, CAST((row_number() OVER (ORDER BY id) - 1) // 700 AS INTEGER) AS chunk FROM user_events),
  staged AS (SELECT chunk, count(*) AS n, 0 AS rejected FROM chunked GROUP BY 1
    UNION ALL SELECT max(chunk) + 1, 0, 0 FROM chunked  -- staged without readings
    UNION ALL SELECT max(chunk) + 2, 0, 1 FROM chunked)"""

INGEST_LOG = """ingest_log AS (
  SELECT engine, run, chunk, duration_ms,
         CAST(sum(n) OVER (PARTITION BY engine, run ORDER BY chunk) AS BIGINT) AS n_records
  FROM (SELECT event_type AS engine, event_id % 5 AS run, CAST(extract(day FROM ts) - 1 AS INTEGER) AS chunk,
               CAST(floor(sum(value)) AS BIGINT) AS duration_ms, count(*) AS n
        FROM events GROUP BY 1, 2, 3) t)"""

RUN_LOG = """run_log AS (
  SELECT engine, run, query_id,
         CASE WHEN engine = 'error' AND query_id > 14 THEN -1
              WHEN engine = 'view' AND query_id = 3 THEN 0
              WHEN event_id % 17 = 0 THEN -1
              ELSE CAST(floor(value) AS BIGINT) END AS duration_ms
  FROM (SELECT event_type AS engine, event_id % 5 AS run,
               1 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 20 AS query_id, event_id, value
        FROM events) t)"""

DELTAS = """deltas AS (
  SELECT engine, run, chunk, duration_ms,
         n_records - coalesce(lag(n_records) OVER (PARTITION BY engine, run ORDER BY chunk), 0) AS delta
  FROM ingest_log)"""

STATS = """stats AS (
  SELECT engine, med_duration, med_delta, coalesce(med_rate, 0) AS med_rate, total_records, total_duration, runs
  FROM (SELECT engine, median(greatest(0, duration_ms)) AS med_duration, median(greatest(0, delta)) AS med_delta,
               median(CASE WHEN duration_ms > 0 THEN greatest(0, delta * 1000.0::DOUBLE / duration_ms) END) AS med_rate
        FROM deltas GROUP BY engine) m
  JOIN (SELECT engine, avg(n) AS total_records, avg(d) AS total_duration, count(*) AS runs
        FROM (SELECT engine, run, arg_max(n_records, chunk) AS n, sum(duration_ms) AS d
              FROM ingest_log GROUP BY engine, run) p GROUP BY engine) t USING (engine))"""

MEANS = """means AS (
  SELECT engine, query_id, coalesce(avg(CASE WHEN duration_ms >= 0 THEN duration_ms END), -1) AS avg_ms
  FROM run_log GROUP BY engine, query_id)"""

BASE = """base AS (
  SELECT engine FROM (
    SELECT s.engine, row_number() OVER (ORDER BY coalesce(c.n, 0) DESC, s.med_duration DESC, s.engine) AS r
    FROM stats s LEFT JOIN (SELECT engine, count(*) AS n FROM means WHERE avg_ms >= 0 GROUP BY engine) c USING (engine)) x
  WHERE r = 1)"""

SPEEDUPS = """speedups AS (
  SELECT m.engine, m.query_id,
         CASE WHEN m.avg_ms > 0 THEN r.avg_ms / m.avg_ms ELSE r.avg_ms / 0.1::DOUBLE END AS speedup
  FROM means m JOIN means r ON r.query_id = m.query_id AND r.engine = (SELECT engine FROM base)
  WHERE m.engine <> (SELECT engine FROM base) AND r.avg_ms > 0 AND m.avg_ms >= 0)"""

INGEST_SPEEDUPS = """ingest_speedups AS (
  SELECT s.engine,
         CASE WHEN s.engine = b.engine THEN 1 WHEN s.med_duration > 0 THEN b.med_duration / s.med_duration
              ELSE b.med_duration / 0.1::DOUBLE END AS duration_speedup,
         CASE WHEN s.engine = b.engine THEN 1 WHEN b.med_rate > 0 THEN s.med_rate / b.med_rate ELSE 0 END AS rate_improvement
  FROM stats s CROSS JOIN (SELECT * FROM stats WHERE engine = (SELECT engine FROM base)) b
  WHERE s.engine = b.engine OR b.med_duration > 0)"""

SUMMARY = """summary AS (
  SELECT g.engine, median(coalesce(p.speedup, 0)) AS median, coalesce(min(p.speedup), 0) AS min,
         coalesce(max(p.speedup), 0) AS max, count(p.speedup) AS n
  FROM (SELECT s.engine, q.query_id FROM stats s CROSS JOIN (SELECT DISTINCT query_id FROM means) q
        WHERE s.engine <> (SELECT engine FROM base)) g
  LEFT JOIN speedups p USING (engine, query_id) GROUP BY g.engine
  UNION ALL
  SELECT b.engine, 1, 1, 1, (SELECT count(*) FROM means m WHERE m.engine = b.engine AND m.avg_ms >= 0) FROM base b)"""

LOG_PARTS = [INGEST_LOG, DELTAS, STATS, RUN_LOG, MEANS, BASE]


def _with(parts, body):
    """``body`` after the named parts; a body that starts with a comma names more of them."""
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def _ue(body):
    return _with([EVENT_TABLE], body)


def _mid(body):
    return _with([EVENT_TABLE, BOUNDS], body)


def _daily(expr, name, day="CAST(ts AS DATE)"):
    return _ue(f"SELECT {day} AS day, round({expr}, 6) AS {name} FROM user_events GROUP BY 1 ORDER BY 1 LIMIT 30")


_HOURLY_24H = "FROM user_events, b WHERE ts BETWEEN mid AND mid + INTERVAL 24 HOUR GROUP BY 1 ORDER BY 1"
#: The engines of the given logs. A statement with an open list of columns cannot be stored as a view.
ENGINES = ("click", "error", "purchase", "signup", "view")


def _pivoted(value: str, source: str, missing: str = "NULL") -> str:
    columns = ", ".join(f"coalesce(max(CASE WHEN engine = '{e}' THEN round({value}, 6) END), {missing}) AS {e}" for e in ENGINES)
    return f"SELECT query_id, concat('Query ', query_id) AS description, {columns} FROM {source} GROUP BY query_id"


# bins of 1/40000 of the 64th root; all signal values are negative
_ROOT = "sqrt(sqrt(sqrt(sqrt(sqrt(sqrt(-CAST(rssi AS DOUBLE)))))))"
_BINNED = f""", v AS (SELECT CAST(floor(-{_ROOT} * 40000) AS BIGINT) AS bin, row_number() OVER (ORDER BY rssi) - 1 AS r,
         count(*) OVER () AS n FROM user_events)
  SELECT """ + ", ".join(
    f"round(max(CASE WHEN r = CAST(floor({p}::DOUBLE * (n - 1)) AS BIGINT) THEN -pow(-(bin + 0.5::DOUBLE) / 40000, 64) END), 6) AS {c}"
    for c, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))) + " FROM v"

ORACLES = {
    "q01_time_bounds": _ue("SELECT min(ts) AS min_ts, max(ts) AS max_ts FROM user_events"),
    "q02_count_all": _ue("SELECT count(*) AS n FROM user_events"),
    "q03_distinct_users": _ue("SELECT count(DISTINCT user_id) AS n FROM user_events"),
    "q04_avg_rssi": _ue("SELECT round(avg(rssi), 6) AS avg_rssi FROM user_events"),
    "q05_before_mid": _mid("SELECT count(*) AS n FROM user_events, b WHERE ts < mid"),
    "q06_after_mid": _mid("SELECT count(*) AS n FROM user_events, b WHERE ts > mid"),
    "q07_around_mid": _mid(
        "SELECT count(*) AS n FROM user_events, b WHERE ts BETWEEN mid - INTERVAL 1 HOUR AND mid + INTERVAL 1 HOUR"),
    "q08_hourly_24h": _mid(f"SELECT date_trunc('hour', ts) AS hour, count(*) AS n {_HOURLY_24H}"),
    "q09_top_users": _ue("SELECT user_id, count(*) AS n FROM user_events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10"),
    "q10_strong_signal": _ue("SELECT count(*) AS n FROM user_events WHERE rssi > -50"),
    "q11_weak_signal": _ue("SELECT count(*) AS n FROM user_events WHERE rssi < -80"),
    "q12_top_ssids": _ue("SELECT ssid, count(*) AS n FROM user_events GROUP BY 1 ORDER BY n DESC, ssid LIMIT 10"),
    "q13_user_rssi_stats": _ue(
        "SELECT user_id, round(avg(rssi), 6) AS avg_rssi, min(rssi) AS min_rssi, max(rssi) AS max_rssi "
        "FROM user_events GROUP BY 1 ORDER BY avg(rssi) DESC, user_id LIMIT 100"),
    "q14_rssi_percentiles": _ue("SELECT " + ", ".join(
        f"round(percentile_cont({p}) WITHIN GROUP (ORDER BY CAST(rssi AS DOUBLE)), 6) AS {c}"
        for c, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))) + " FROM user_events"),
    "q15_first_half": _mid("SELECT count(*) AS n FROM user_events, b WHERE ts BETWEEN lo AND mid"),
    "q16_second_half": _mid("SELECT count(*) AS n FROM user_events, b WHERE ts BETWEEN mid AND hi"),
    "q17_hour_of_day": _ue(
        "SELECT CAST(extract(hour FROM ts) AS BIGINT) AS hour, count(*) AS n FROM user_events GROUP BY 1 ORDER BY 1"),
    "q18_daily_variance": _daily("var_samp(rssi)", "rssi_variance"),
    "q19_peak_hours": _ue(
        "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM user_events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5"),
    "q20_activity_span": _ue(
        "SELECT user_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us FROM user_events "
        "GROUP BY 1 ORDER BY span_us DESC, user_id LIMIT 10"),

    "v_sample_by": _mid(f"SELECT date_trunc('hour', ts) AS ts, count(*) AS n {_HOURLY_24H} LIMIT 24"),
    "v_implicit_group": _ue("SELECT user_id, count(*) AS n FROM user_events GROUP BY ALL ORDER BY n DESC, user_id LIMIT 10"),
    "v_subquery_topk": _ue(
        "SELECT ts, n FROM (SELECT date_trunc('hour', ts) AS ts, count(*) AS n FROM user_events GROUP BY 1) s "
        "ORDER BY n DESC, ts LIMIT 5"),
    "v_range_half_open": _mid("SELECT count(*) AS n FROM user_events, b WHERE ts >= mid AND ts < hi"),
    "v_range_relative": _mid("SELECT count(*) AS n FROM user_events, b WHERE ts >= hi - INTERVAL 10 DAY AND ts < hi"),
    "v_series_count": _ue(
        "SELECT user_id, ssid, count(*) AS n, round(avg(rssi), 6) AS avg_rssi FROM user_events GROUP BY 1, 2"),
    "v_window_gapfill": _mid("""
      , s AS (SELECT user_id, ssid, date_trunc('hour', ts) AS hour FROM user_events, b
              WHERE ts >= mid AND ts < mid + INTERVAL 24 HOUR),
      h AS (SELECT unnest(generate_series(date_trunc('hour', mid),
              date_trunc('hour', mid + INTERVAL 24 HOUR - INTERVAL 1 MICROSECOND), INTERVAL 1 HOUR)) AS hour,
              mid + INTERVAL 24 HOUR AS stop FROM b)
      SELECT k.user_id, k.ssid, h.hour, least(h.hour + INTERVAL 1 HOUR, h.stop) AS bucket_end, coalesce(c.n, 0) AS n
      FROM (SELECT DISTINCT user_id, ssid FROM s) k CROSS JOIN h
      LEFT JOIN (SELECT user_id, ssid, hour, count(*) AS n FROM s GROUP BY 1, 2, 3) c USING (user_id, ssid, hour)"""),
    "v_window_inf": _ue("SELECT user_id, round(avg(rssi), 6) AS avg_rssi FROM user_events GROUP BY 1"),
    "v_spread": _ue("SELECT user_id, max(rssi) - min(rssi) AS spread FROM user_events GROUP BY 1"),
    "v_topn_per_group": _ue("""
      SELECT user_id, ssid, n FROM (
        SELECT user_id, ssid, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, ssid) AS r
        FROM user_events GROUP BY 1, 2) t WHERE r <= 3"""),
    "v_series_peak_hours": _ue("""
      SELECT user_id, ssid, hour, n FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, ssid ORDER BY n DESC, hour) AS r FROM (
          SELECT user_id, ssid, date_trunc('hour', ts) AS hour, count(*) AS n FROM user_events GROUP BY 1, 2, 3) c) t
      WHERE r <= 5"""),
    "v_distinct_values": _ue("SELECT count(*) AS n FROM (SELECT DISTINCT user_id FROM user_events) d"),
    "v_daily_stddev": _daily("stddev_samp(rssi)", "rssi_stddev"),
    "v_var_pop": _daily("var_pop(rssi)", "rssi_var_pop"),
    "v_pctl_approx": _with([EVENT_TABLE], _BINNED),
    "v_pctl_sketch": "SELECT * FROM (VALUES ('q1', true), ('median', true), ('q3', true)) t(quartile, rank_ok)",
    **{f"v_pctl_{how}": "SELECT * FROM (VALUES ('q1', true), ('median', true), ('q3', true)) t(quartile, rank_ok)"
       for how in ("digest", "sample")},
    "v_two_stage_sum": _ue("""
      SELECT CAST(extract(hour FROM h) AS BIGINT) AS hour, CAST(sum(n) AS BIGINT) AS n
      FROM (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM user_events GROUP BY 1) t GROUP BY 1 ORDER BY 1"""),
    "v_bucket_day_ts": _daily("var_samp(rssi)", "rssi_variance", "date_trunc('day', ts)"),
    "variant_no_zone": _ue("SELECT user_id, ts, rssi, ssid FROM user_events"),
    "variant_whole_seconds": """
      SELECT event_id AS id, concat('simuser-', CAST(user_id AS VARCHAR)) AS user_id, date_trunc('second', ts) AS ts,
             CAST(-20.0 - value AS FLOAT) AS rssi, concat('AP-', regexp_extract(props, '([0-9]+)', 1)) AS ssid FROM events""",
    "variant_wide_signal": _ue("SELECT user_id, ts, CAST(rssi AS DOUBLE) AS rssi, ssid FROM user_events"),
    "scalar_functions": """
      SELECT event_id AS id, ts + (ts + INTERVAL 1 SECOND - ts) / 2 AS mid_ts, ts - INTERVAL 1 HOUR AS hour_before,
             ts + INTERVAL 24 HOUR AS day_after, date_trunc('hour', ts) AS hour_ts,
             CAST(date_trunc('day', ts) AS TIMESTAMP) AS day_ts, CAST(ts AS DATE) AS day,
             CAST(extract(hour FROM ts) AS BIGINT) AS hour_no,
             epoch_us(ts + INTERVAL 1 HOUR) - epoch_us(ts) AS span_us,
             ts AS from_epoch, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS text, CAST(-value AS FLOAT) AS negated,
             CASE WHEN value * 10 >= 1000 THEN printf('%.1fs', value * 10 / 1000) ELSE printf('%.1fms', value * 10) END AS took
      FROM (SELECT event_id, date_trunc('second', ts) AS ts, value FROM events) t""",

    "ingest_readings": _ue("SELECT user_id, ts, rssi, ssid FROM user_events"),
    "ingest_chunk_order": _with([EVENT_TABLE, CHUNKS],
        "SELECT chunk, CAST(chunk + 1 AS BIGINT) AS ordinal FROM staged"),
    "ingest_stream": _with([EVENT_TABLE, CHUNKS], "SELECT chunk, user_id, ts, rssi, ssid FROM chunked"),
    "ingest_stream_progress": _with([EVENT_TABLE, CHUNKS], """
      SELECT chunk, n, CAST(rejected AS BIGINT) AS rejected, CAST(sum(n) OVER (ORDER BY chunk) AS BIGINT) AS n_records
      FROM staged"""),
    "ingest_append": _ue("SELECT id, user_id, ts, rssi, ssid FROM user_events"),
    "ingest_progress": _with([EVENT_TABLE, CHUNKS], """
      SELECT chunk, n, CAST(rejected AS BIGINT) AS rejected, CAST(sum(n) OVER (ORDER BY chunk) AS BIGINT) AS n_records
      FROM staged"""),
    "surrogate_id": _ue("""
      SELECT chunk, pos, user_id, ts, row_number() OVER (ORDER BY chunk, pos) AS id
      FROM (SELECT CAST(extract(day FROM ts) AS INTEGER) % 12 AS chunk, id AS pos, user_id, ts FROM user_events) t"""),
    "ingest_resumed_ids": _with([EVENT_TABLE, CHUNKS],
        "SELECT row_number() OVER (ORDER BY id) AS id, chunk, user_id, ts, rssi, ssid FROM chunked"),
    "layout_time_partition": _ue("""
      SELECT CAST(ts AS DATE) AS event_date, CAST(extract(hour FROM ts) AS INTEGER) // 4 * 4 AS part_hour, count(*) AS n
      FROM user_events GROUP BY 1, 2"""),
    "layout_pruned_slice": _mid(f"SELECT date_trunc('hour', ts) AS hour, count(*) AS n {_HOURLY_24H}"),
    "layout_shards": _ue("SELECT ts, count(*) AS n, CAST(1 AS BIGINT) AS n_shards FROM user_events GROUP BY 1"),
    "layout_bucketed": _ue("""
      SELECT user_id, n, n_ssids FROM (SELECT user_id, count(*) AS n FROM user_events GROUP BY 1) a
      JOIN (SELECT user_id, count(DISTINCT ssid) AS n_ssids FROM user_events GROUP BY 1) b USING (user_id)"""),
    "layout_sorted": _ue("SELECT id, user_id, ts, rssi, ssid FROM user_events"),
    "points_long": _ue("""
      SELECT 'user_events' AS measurement, user_id, ssid, 'rssi' AS field, CAST(rssi AS DOUBLE) AS value, ts AS time
      FROM user_events"""),
    "points_upsert": _ue("""
      SELECT id, user_id, ssid, day, rssi FROM (
        SELECT id, user_id, ssid, CAST(ts AS DATE) AS day, rssi,
               row_number() OVER (PARTITION BY user_id, ssid, CAST(ts AS DATE) ORDER BY id DESC) AS r
        FROM user_events) t WHERE r = 1"""),
    "points_upsert_stored": _ue("""
      SELECT id, user_id, ssid, day, rssi FROM (
        SELECT id, user_id, ssid, CAST(ts AS DATE) AS day, rssi,
               row_number() OVER (PARTITION BY user_id, ssid, CAST(ts AS DATE) ORDER BY id DESC) AS r
        FROM user_events) t WHERE r = 1"""),
    "points_upsert_stream": _ue("""
      SELECT id, user_id, ssid, day, rssi FROM (
        SELECT id, user_id, ssid, CAST(ts AS DATE) AS day, rssi,
               row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY id DESC) AS r
        FROM user_events) t WHERE r = 1"""),
    "rollup_daily_variance": _ue("""
      SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(rssi), 6) AS avg_rssi, round(var_samp(rssi), 6) AS rssi_variance,
             round(var_pop(rssi), 6) AS rssi_var_pop FROM user_events GROUP BY 1"""),
    "rollup_hour_of_day": _ue(
        "SELECT CAST(extract(hour FROM ts) AS BIGINT) AS hour, count(*) AS n FROM user_events GROUP BY 1 ORDER BY 1"),
    "rollup_peak_hours": _ue(
        "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM user_events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5"),
    "distinct_over_appends": _ue("""
      SELECT day, count(DISTINCT user_id) AS n_users FROM (SELECT CAST(ts AS DATE) AS day, user_id FROM user_events) t
      GROUP BY GROUPING SETS ((day), ())"""),
    "stream_hourly": "SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1",

    "runlog_scan": _with([INGEST_LOG, RUN_LOG], """
      SELECT engine, CAST(run AS VARCHAR) AS run, 'ingest' AS kind,
             CAST(row_number() OVER (PARTITION BY engine, run ORDER BY chunk) - 1 AS INTEGER) AS item, duration_ms, n_records
      FROM ingest_log
      UNION ALL
      SELECT engine, CAST(run AS VARCHAR), 'query', query_id, max(duration_ms), NULL
      FROM run_log GROUP BY engine, run, query_id"""),
    "runlog_write": _with([INGEST_LOG, RUN_LOG], """
      SELECT engine, CAST(run AS VARCHAR) AS run, n_chunks, n_queries, n_records
      FROM (SELECT engine, run, CAST(count(*) AS INTEGER) AS n_chunks, max(n_records) AS n_records
            FROM ingest_log GROUP BY 1, 2) i
      JOIN (SELECT engine, run, CAST(count(DISTINCT query_id) AS INTEGER) AS n_queries FROM run_log GROUP BY 1, 2) q
      USING (engine, run)"""),
    "r_counter_diff": _with([INGEST_LOG, DELTAS], "SELECT engine, run, chunk, delta FROM deltas"),
    "r_ingest_rate": _with([INGEST_LOG, DELTAS],
        "SELECT engine, run, chunk, round(delta * 1000.0::DOUBLE / duration_ms, 6) AS rate FROM deltas WHERE duration_ms > 0"),
    "r_ingest_stats": _with([INGEST_LOG, DELTAS, STATS], """
      SELECT engine, med_duration, med_delta, round(med_rate, 6) AS med_rate, round(total_records, 6) AS total_records,
             round(total_duration, 6) AS total_duration, runs FROM stats"""),
    "r_query_means": _with([RUN_LOG, MEANS], "SELECT engine, query_id, round(avg_ms, 6) AS avg_ms FROM means"),
    "r_baseline": _with(LOG_PARTS, "SELECT engine FROM base"),
    "r_speedups": _with([*LOG_PARTS, SPEEDUPS], "SELECT engine, query_id, round(speedup, 6) AS speedup FROM speedups"),
    "r_ingest_speedups": _with([*LOG_PARTS, INGEST_SPEEDUPS], """
      SELECT engine, round(duration_speedup, 6) AS duration_speedup, round(rate_improvement, 6) AS rate_improvement
      FROM ingest_speedups"""),
    "r_speedup_summary": _with([*LOG_PARTS, SPEEDUPS, SUMMARY],
        "SELECT engine, round(median, 6) AS median, round(min, 6) AS min, round(max, 6) AS max, n FROM summary"),
    "r_pivot_times": _with([RUN_LOG, MEANS], _pivoted("avg_ms", "means", "-1")),
    "r_pivot_speedups": _with([*LOG_PARTS, SPEEDUPS, """ratios AS (
        SELECT engine, query_id, speedup FROM speedups
        UNION ALL SELECT engine, query_id, CASE WHEN engine = (SELECT engine FROM base) THEN 1.0::DOUBLE END FROM means
          WHERE engine = (SELECT engine FROM base) OR (engine, query_id) NOT IN (SELECT engine, query_id FROM speedups))"""],
        _pivoted("speedup", "ratios")),
    "r_best": _with([*LOG_PARTS, SPEEDUPS, INGEST_SPEEDUPS, SUMMARY], """
      SELECT 'ingest' AS metric, engine, round(duration_speedup, 6) AS speedup FROM (
        SELECT *, row_number() OVER (ORDER BY duration_speedup DESC, engine) AS r FROM ingest_speedups
        WHERE engine <> (SELECT engine FROM base)) i WHERE r = 1
      UNION ALL
      SELECT 'query', engine, round(median, 6) FROM (
        SELECT *, row_number() OVER (ORDER BY median DESC, engine) AS r FROM summary
        WHERE engine <> (SELECT engine FROM base)) q WHERE r = 1"""),
    "r_file_counts": _with([INGEST_LOG], "SELECT engine, count(DISTINCT run) AS runs FROM ingest_log GROUP BY 1"),
}

#: A stream fills gaps like a batch does, once time has passed the range.
ORACLES["stream_gapfill"] = ORACLES["v_window_gapfill"]
