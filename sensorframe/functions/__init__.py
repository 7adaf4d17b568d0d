from sensorframe.functions.scalar import (
    DAY_US, HOUR_US, SECOND_US,
    day_date, day_start, floor_to, from_epoch_seconds, hour_of, hour_start, humanize_ms,
    micros_between, midpoint_of, n_rows, no_zone, rfc3339, shift, spread_of, to_real,
)

__all__ = [
    "DAY_US", "HOUR_US", "SECOND_US",
    "day_date", "day_start", "floor_to", "from_epoch_seconds", "hour_of", "hour_start", "humanize_ms",
    "micros_between", "midpoint_of", "n_rows", "no_zone", "rfc3339", "shift", "spread_of", "to_real",
]
