from sensorframe.sources.distinct import add_distinct, distinct_counts
from sensorframe.sources.events import as_variant, read_events, write_bucketed, write_events
from sensorframe.sources.points import to_points, upsert_points, upsert_stored
from sensorframe.sources.readings import (
    chunk_files, chunk_progress, read_readings, scan_readings,
)
from sensorframe.sources.rollups import (
    hourly_counts, merge_moments, moments, read_rollup, refresh_rollup, variance,
)
from sensorframe.sources.runlogs import (
    build_runlogs, ingest_facts, query_facts, read_runlogs, write_runlogs,
)
from sensorframe.sources.steps import append_step, high_water, read_steps, write_step

__all__ = [
    "add_distinct", "append_step", "as_variant", "build_runlogs", "chunk_files", "chunk_progress", "distinct_counts",
    "high_water", "hourly_counts", "ingest_facts", "merge_moments", "moments", "query_facts", "read_events", "read_readings",
    "read_rollup", "read_runlogs", "read_steps", "refresh_rollup", "scan_readings", "to_points", "upsert_points",
    "upsert_stored", "variance", "write_bucketed", "write_events", "write_runlogs", "write_step",
]
