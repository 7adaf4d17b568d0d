"""Forms of the questions whose meaning differs from the plain one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.functions import (
    SECOND_US, day_date, day_start, floor_to, from_epoch_seconds, hour_of, hour_start, humanize_ms, micros_between, midpoint_of, n_rows,
    rfc3339, shift, to_real,
)
from sensorframe.operators import (
    around_midpoint, bucket_agg, digest_percentiles, distinct_values, gap_fill, hour_of_day_from_buckets, implicit_group, instants,
    percentiles, relative_slice, row_count, sampled_percentiles, series_agg, spread, time_slice, top_k_per_group, top_rows, top_rows_per_group,
)
from sensorframe.operators.timeslice import UNCUT_TS
from sensorframe.plans.core import QUARTILES
from sensorframe.plans.tables import event_columns, events, user_events
from sensorframe.sources import as_variant

SERIES = ["user_id", "ssid"]


def v_sample_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly samples after the midpoint, cut off after 24 of them."""
    ue = user_events(spark, sf_dir, uncut=True)
    day = time_slice(ue, *around_midpoint(ue, 0, 24))
    return bucket_agg(day, "1 hour", [n_rows()], name="ts").orderBy("ts").limit(24)


def v_implicit_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most active users, with the grouping left to the engine."""
    return top_rows(implicit_group(user_events(spark, sf_dir), "user_id", "count(*) AS n"), "n", 10, ["user_id"])


def v_subquery_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak hours: buckets in an inner query, order and limit outside."""
    hourly = bucket_agg(user_events(spark, sf_dir), "1 hour", [n_rows()], name="ts")
    return top_rows(hourly.select("ts", "n"), "n", 5, ["ts"])


def v_range_half_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second half of the range with an exclusive end, so without the last instant."""
    ue = user_events(spark, sf_dir, uncut=True)
    lo, hi = instants(ue, midpoint_of("min_ts", "max_ts"), F.col("max_ts"))
    return row_count(time_slice(ue, lo, hi, "left"))


def v_range_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 10 days of the table; "now" is its latest instant."""
    ue = user_events(spark, sf_dir, uncut=True)
    return row_count(relative_slice(ue, "10 days"))


def v_series_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_agg(user_events(spark, sf_dir), [n_rows(), F.round(F.avg("rssi"), 6).alias("avg_rssi")])


def v_window_gapfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts per series for 24 hours from the midpoint, hours without rows included."""
    ue = user_events(spark, sf_dir, uncut=True)
    lo, hi = around_midpoint(ue, 0, 24)
    hourly = bucket_agg(time_slice(ue, lo, hi, "left"), "1 hour", [n_rows()], SERIES, name="hour")
    return gap_fill(hourly, "1 hour", lo, hi, {"n": 0}, SERIES, name="hour")


def v_window_inf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One window over the whole range: mean per user."""
    return bucket_agg(user_events(spark, sf_dir), "inf", [F.round(F.avg("rssi"), 6).alias("avg_rssi")], ["user_id"])


def v_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(user_events(spark, sf_dir), "user_id", "rssi")


def v_topn_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_per_group(user_events(spark, sf_dir), "user_id", "ssid", 3)


def v_series_peak_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five busiest hours of every series."""
    hourly = bucket_agg(user_events(spark, sf_dir), "1 hour", [n_rows()], SERIES, name="hour")
    return top_rows_per_group(hourly, SERIES, "n", 5, ["hour"])


def v_distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_count(distinct_values(user_events(spark, sf_dir), "user_id"))


def v_daily_stddev(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = F.round(F.stddev_samp("rssi"), 6).alias("rssi_stddev")
    return bucket_agg(user_events(spark, sf_dir), "1 day", [agg], name="day", as_date=True).orderBy("day").limit(30)


def v_var_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = F.round(F.var_pop("rssi"), 6).alias("rssi_var_pop")
    return bucket_agg(user_events(spark, sf_dir), "1 day", [agg], name="day", as_date=True).orderBy("day").limit(30)


def v_pctl_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles with a bounded relative error."""
    found = percentiles(user_events(spark, sf_dir), "rssi", QUARTILES, "binned")
    return found.select(*[F.round(c, 6).alias(c) for c in QUARTILES])


def _rank_ok(ue: DataFrame, found: DataFrame, off: float = 0.005) -> DataFrame:
    """``(quartile, rank_ok)``: whether each approximate quartile has a rank at most a share of ``off`` from its own."""
    values = found.first()
    shares = ue.agg(*[(F.count_if(F.col("rssi") <= values[q]) / F.count("rssi")).alias(q) for q in QUARTILES])
    return shares.select(F.inline(F.array(*[
        F.struct(F.lit(q).alias("quartile"), (F.abs(F.col(q) - p) <= off).alias("rank_ok")) for q, p in QUARTILES.items()
    ])))


def v_pctl_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of sketched quartiles: the values differ from run to run."""
    ue = user_events(spark, sf_dir)
    return _rank_ok(ue, percentiles(ue, "rssi", QUARTILES, "sketch"))


def v_pctl_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of quartiles from a t-digest."""
    ue = user_events(spark, sf_dir)
    return _rank_ok(ue, digest_percentiles(ue, "rssi", QUARTILES))


def v_pctl_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of quartiles from the 10,000 rows whose ids have the smallest hashes, within 2 percent."""
    ue = user_events(spark, sf_dir)
    return _rank_ok(ue, sampled_percentiles(ue, "rssi", QUARTILES, ["id"]), 0.02)


def v_two_stage_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = bucket_agg(user_events(spark, sf_dir), "1 hour", [n_rows()])
    return hour_of_day_from_buckets(hourly).orderBy("hour")


def v_bucket_day_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily variance labelled with midnight timestamps instead of dates."""
    agg = F.round(F.var_samp("rssi"), 6).alias("rssi_variance")
    return bucket_agg(user_events(spark, sf_dir), "1 day", [agg], name="day").orderBy("day").limit(30)


def variant_no_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_variant(user_events(spark, sf_dir), "no_zone")


def variant_whole_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From instants with fractions of a second, as given."""
    given = event_columns(events(spark, sf_dir)).withColumn("ts", F.col(UNCUT_TS))
    return as_variant(given, "whole_seconds")


def variant_wide_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_variant(user_events(spark, sf_dir), "wide_signal")


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar helpers, applied to every event."""
    e = events(spark, sf_dir).select("event_id", floor_to("ts", SECOND_US).alias("ts"), "value")
    return e.select(
        F.col("event_id").alias("id"),
        midpoint_of("ts", shift("ts", 1, "SECOND")).alias("mid_ts"),
        shift("ts", -1).alias("hour_before"),
        shift("ts", 24).alias("day_after"),
        hour_start("ts").alias("hour_ts"),
        day_start("ts").alias("day_ts"),
        day_date("ts").alias("day"),
        hour_of("ts").alias("hour_no"),
        micros_between("ts", shift("ts", 1)).alias("span_us"),
        from_epoch_seconds(F.unix_seconds("ts")).alias("from_epoch"),
        rfc3339("ts").alias("text"),
        to_real(-F.col("value")).alias("negated"),
        humanize_ms(F.col("value") * 10).alias("took"),
    )


QUERIES = {q.__name__: q for q in (
    v_sample_by, v_implicit_group, v_subquery_topk, v_range_half_open, v_range_relative, v_series_count,
    v_window_gapfill, v_window_inf, v_spread, v_topn_per_group, v_series_peak_hours, v_distinct_values,
    v_daily_stddev, v_var_pop, v_pctl_approx, v_pctl_sketch, v_pctl_digest, v_pctl_sample, v_two_stage_sum, v_bucket_day_ts,
    variant_no_zone, variant_whole_seconds, variant_wide_signal, scalar_functions,
)}
