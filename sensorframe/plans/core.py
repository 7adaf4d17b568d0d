"""The 20 time-series and relational questions, over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.functions import n_rows
from sensorframe.operators import (
    activity_span, around_midpoint, bucket_agg, distinct_count, hour_of_day, mean,
    percentiles, row_count, time_bounds, time_slice, top_k, top_rows,
)
from sensorframe.plans.tables import user_events

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def q01_time_bounds(ue: DataFrame) -> DataFrame:
    return time_bounds(ue)


def q02_count_all(ue: DataFrame) -> DataFrame:
    return row_count(ue)


def q03_distinct_users(ue: DataFrame) -> DataFrame:
    return distinct_count(ue, "user_id")


def q04_avg_rssi(ue: DataFrame) -> DataFrame:
    return mean(ue, "rssi", "avg_rssi").select(F.round("avg_rssi", 6).alias("avg_rssi"))


def q05_before_mid(ue: DataFrame) -> DataFrame:
    (mid,) = around_midpoint(ue, 0)
    return row_count(time_slice(ue, hi=mid, closed="none"))


def q06_after_mid(ue: DataFrame) -> DataFrame:
    (mid,) = around_midpoint(ue, 0)
    return row_count(time_slice(ue, lo=mid, closed="none"))


def q07_around_mid(ue: DataFrame) -> DataFrame:
    return row_count(time_slice(ue, *around_midpoint(ue, -1, 1)))


def q08_hourly_24h(ue: DataFrame) -> DataFrame:
    day = time_slice(ue, *around_midpoint(ue, 0, 24))
    return bucket_agg(day, "1 hour", [n_rows()], name="hour").orderBy("hour")


def q09_top_users(ue: DataFrame) -> DataFrame:
    return top_k(ue, ["user_id"], [n_rows()], "n", 10)


def q10_strong_signal(ue: DataFrame) -> DataFrame:
    return row_count(ue.filter(F.col("rssi") > -50))


def q11_weak_signal(ue: DataFrame) -> DataFrame:
    return row_count(ue.filter(F.col("rssi") < -80))


def q12_top_ssids(ue: DataFrame) -> DataFrame:
    return top_k(ue, ["ssid"], [n_rows()], "n", 10)


def q13_user_rssi_stats(ue: DataFrame) -> DataFrame:
    stats = [F.avg("rssi").alias("avg_rssi"), F.min("rssi").alias("min_rssi"), F.max("rssi").alias("max_rssi")]
    return top_k(ue, ["user_id"], stats, "avg_rssi", 100).withColumn("avg_rssi", F.round("avg_rssi", 6))


def q14_rssi_percentiles(ue: DataFrame) -> DataFrame:
    found = percentiles(ue, "rssi", QUARTILES)
    return found.select(*[F.round(c, 6).alias(c) for c in QUARTILES])


def q15_first_half(ue: DataFrame) -> DataFrame:
    """From the earliest row, which no row precedes, to the midpoint."""
    (mid,) = around_midpoint(ue, 0)
    return row_count(time_slice(ue, hi=mid))


def q16_second_half(ue: DataFrame) -> DataFrame:
    (mid,) = around_midpoint(ue, 0)
    return row_count(time_slice(ue, lo=mid))


def q17_hour_of_day(ue: DataFrame) -> DataFrame:
    return hour_of_day(ue).orderBy("hour")


def q18_daily_variance(ue: DataFrame) -> DataFrame:
    variance = F.round(F.var_samp("rssi"), 6).alias("rssi_variance")
    return bucket_agg(ue, "1 day", [variance], name="day", as_date=True).orderBy("day").limit(30)


def q19_peak_hours(ue: DataFrame) -> DataFrame:
    return top_rows(bucket_agg(ue, "1 hour", [n_rows()], name="hour"), "n", 5, ["hour"])


def q20_activity_span(ue: DataFrame) -> DataFrame:
    return top_rows(activity_span(ue), "span_us", 10, ["user_id"])


QUESTIONS = (
    q01_time_bounds, q02_count_all, q03_distinct_users, q04_avg_rssi, q05_before_mid, q06_after_mid,
    q07_around_mid, q08_hourly_24h, q09_top_users, q10_strong_signal, q11_weak_signal, q12_top_ssids,
    q13_user_rssi_stats, q14_rssi_percentiles, q15_first_half, q16_second_half, q17_hour_of_day,
    q18_daily_variance, q19_peak_hours, q20_activity_span,
)


def _on_events(question):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return question(user_events(spark, sf_dir, uncut=True))
    return run


QUERIES = {question.__name__: _on_events(question) for question in QUESTIONS}
