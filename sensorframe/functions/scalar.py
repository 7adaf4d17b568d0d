"""Column helpers. All are built-in expressions, so they stay inside generated code; times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def midpoint_of(lo: Column | str, hi: Column | str) -> Column:
    """Instant half way between two timestamps; half seconds are kept."""
    return col(lo) + (col(hi) - col(lo)) / 2


def shift(ts: Column | str, n: int, unit: str = "HOUR") -> Column:
    """``ts`` moved by ``n`` units, backwards when negative."""
    return F.timestamp_add(unit, F.lit(n), col(ts))


# Buckets are cut by arithmetic on the epoch: in UTC that equals date_trunc and hour, which go through
# the time zone rules for every row and take two to three times as long.

SECOND_US = 1_000_000
HOUR_US = 3600 * SECOND_US
DAY_US = 24 * HOUR_US


def floor_to(ts: Column | str, width_us: int) -> Column:
    """Start of the bucket of ``width_us`` microseconds, counted from the epoch, that ``ts`` falls in."""
    us = F.unix_micros(col(ts))
    return F.timestamp_micros(us - F.pmod(us, F.lit(width_us)))


def hour_start(ts: Column | str) -> Column:
    return floor_to(ts, HOUR_US)


def day_start(ts: Column | str) -> Column:
    return floor_to(ts, DAY_US)


def day_date(ts: Column | str) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_micros(col(ts)) / F.lit(DAY_US)).cast("int"))


def no_zone(ts: Column | str) -> Column:
    """The UTC wall clock, as a timestamp without time zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), col(ts).cast("timestamp_ntz"))


def hour_of(ts: Column | str) -> Column:
    """Hour of the day, 0-23."""
    us = F.unix_micros(col(ts))
    return F.floor(F.pmod(us, F.lit(DAY_US)) / HOUR_US)


def micros_between(lo: Column | str, hi: Column | str) -> Column:
    """``hi - lo`` in microseconds."""
    return F.unix_micros(col(hi)) - F.unix_micros(col(lo))


def from_epoch_seconds(sec: Column | str) -> Column:
    return F.timestamp_seconds(col(sec))


def rfc3339(ts: Column | str) -> Column:
    """RFC 3339 text at whole seconds, e.g. ``2024-01-15T23:58:39Z``."""
    return F.date_format(no_zone(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def to_real(x: Column | str) -> Column:
    """Narrow float64 to the table's REAL."""
    return col(x).cast("float")


def _one_decimal(x: Column) -> Column:
    """Non-negative ``x`` as text with one decimal, correctly rounded from the stored binary value.

    Java's formatter rounds the shortest decimal form instead, which turns 1.45 (stored as
    1.4499999...) into 1.5. ``20 * frac`` is compared with the odd integer at the rounding
    boundary as ``(16f - q) + 4f``; both steps are exact in binary floating point.
    """
    whole = F.floor(x)
    frac = x - whole
    tenth = F.floor(frac * 10)
    side = (frac * 16 - (tenth * 2 + 1)) + frac * 4
    # no CASE: generated code shares common parts only where nothing is conditional
    up = (side > 0).cast("int") + ((side == 0) & (tenth % 2 == 1)).cast("int")
    tenths = whole * 10 + tenth + up
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def humanize_ms(ms: Column | str, missing: str = "N/A") -> Column:
    """``12.5ms`` below one second, ``1.4s`` from there on; negative durations mean failed."""
    ms = col(ms).cast("double")
    shown = F.when(ms >= 1000, ms / 1000).when(ms >= 0, ms)
    unit = F.when(ms >= 1000, F.lit("s")).otherwise(F.lit("ms"))
    return F.coalesce(F.concat(_one_decimal(shown), unit), F.lit(missing))


def n_rows(name: str = "n") -> Column:
    """Aggregate: number of rows."""
    return F.count("*").alias(name)


def spread_of(x: Column | str) -> Column:
    """Aggregate: largest minus smallest value."""
    return F.max(col(x)) - F.min(col(x))
