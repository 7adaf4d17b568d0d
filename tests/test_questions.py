"""Invariants between questions, and hand-made edge rows."""

import pytest
from conftest import SF, at

from sensorframe.plans import core as c
from sensorframe.plans.tables import user_events


def value(df):
    return df.first()[0]


def test_halves_add_up(spark):
    ue = user_events(spark, SF).cache()
    total = value(c.q02_count_all(ue))
    at_mid = total - value(c.q05_before_mid(ue)) - value(c.q06_after_mid(ue))
    assert at_mid >= 0
    assert value(c.q15_first_half(ue)) + value(c.q16_second_half(ue)) == total + at_mid
    assert sum(r["n"] for r in c.q17_hour_of_day(ue).collect()) == total


def test_row_at_midpoint(make_events):
    ue = make_events([("a", 0, -60.0, "x"), ("a", 10, -60.0, "x"), ("a", 20, -60.0, "x")])
    assert value(c.q05_before_mid(ue)) == 1
    assert value(c.q06_after_mid(ue)) == 1
    assert value(c.q15_first_half(ue)) == 2
    assert value(c.q16_second_half(ue)) == 2


def test_midpoint_keeps_half_seconds(make_events):
    from sensorframe.operators import midpoint
    ue = make_events([("a", 0, -60.0, "x"), ("a", 3, -60.0, "x")])
    assert ue.select(midpoint(ue).alias("m")).first()["m"] == at(1.5)


def test_empty_table(make_events):
    ue = make_events([])
    assert tuple(c.q01_time_bounds(ue).first()) == (None, None)
    for question in (c.q02_count_all, c.q03_distinct_users, c.q05_before_mid, c.q06_after_mid, c.q07_around_mid,
                     c.q10_strong_signal, c.q11_weak_signal, c.q15_first_half, c.q16_second_half):
        assert value(question(ue)) == 0, question.__name__
    assert value(c.q04_avg_rssi(ue)) is None
    assert [tuple(r) for r in c.q14_rssi_percentiles(ue).collect()] == [(None, None, None)]
    for question in (c.q08_hourly_24h, c.q09_top_users, c.q13_user_rssi_stats, c.q17_hour_of_day, c.q18_daily_variance,
                     c.q19_peak_hours, c.q20_activity_span):
        assert question(ue).collect() == [], question.__name__


def test_single_row(make_events):
    ue = make_events([("a", 5, -60.5, "x")])
    assert tuple(c.q01_time_bounds(ue).first()) == (at(5), at(5))
    assert value(c.q05_before_mid(ue)) == value(c.q06_after_mid(ue)) == 0
    assert value(c.q15_first_half(ue)) == value(c.q16_second_half(ue)) == value(c.q07_around_mid(ue)) == 1
    assert tuple(c.q14_rssi_percentiles(ue).first()) == (-60.5, -60.5, -60.5)
    assert c.q18_daily_variance(ue).first()["rssi_variance"] is None
    assert c.q20_activity_span(ue).first()["span_us"] == 0


def test_signal_limits_are_strict(make_events):
    ue = make_events([("a", 0, -50.0, "x"), ("a", 1, -80.0, "x")])
    assert value(c.q10_strong_signal(ue)) == 0
    assert value(c.q11_weak_signal(ue)) == 0


def test_ties_follow_the_key(make_events):
    ue = make_events([(f"u{i:02d}", i, -60.0, f"s{i:02d}") for i in reversed(range(12))])
    assert [r["user_id"] for r in c.q09_top_users(ue).collect()] == [f"u{i:02d}" for i in range(10)]
    assert [r["ssid"] for r in c.q12_top_ssids(ue).collect()] == [f"s{i:02d}" for i in range(10)]


def test_window_around_midpoint_is_inclusive(make_events):
    ue = make_events([("a", s, -60.0, "x") for s in (0, 3600, 7200, 10800, 14400)])
    assert value(c.q07_around_mid(ue)) == 3


@pytest.mark.parametrize("hours, buckets", [(24, 25), (23, 24)])
def test_a_day_from_mid_hour_spans_25_hours(make_events, hours, buckets):
    # midpoint at 30:30, rows every half hour
    ue = make_events([("a", s, -60.0, "x") for s in range(0, 61 * 3600 + 1, 1800)])
    from sensorframe.functions import n_rows
    from sensorframe.operators import bucket_agg, midpoint, time_slice
    day = time_slice(ue, midpoint(ue), midpoint(ue, plus_hours=hours))
    rows = bucket_agg(day, "1 hour", [n_rows()]).collect()
    assert len(rows) == buckets
    assert sum(r["n"] for r in rows) == 2 * hours + 1
