from sensorframe.streaming.buckets import latest_buckets, run_bucket_agg, stream_bucket_agg
from sensorframe.streaming.gaps import append_available, stream_gap_fill
from sensorframe.streaming.ingest import (
    load_available, load_numbered, load_shares, load_with_progress, scan_stream, stream_progress, stream_readings,
)
from sensorframe.streaming.upserts import newest_points, upsert_available

__all__ = [
    "append_available", "latest_buckets", "load_available", "load_numbered", "load_with_progress", "newest_points", "run_bucket_agg", "scan_stream",
    "stream_bucket_agg", "stream_gap_fill", "stream_progress", "stream_readings", "upsert_available",
]
