from sensorframe.operators.buckets import (
    bucket_agg, bucket_of, gap_fill, hour_of_day, hour_of_day_from_buckets,
)
from sensorframe.operators.digest import digest, digest_percentiles, merge_digests, sample, sampled_percentiles
from sensorframe.operators.ids import with_dense_id
from sensorframe.operators.rank import top_k, top_k_per_group, top_rows, top_rows_per_group
from sensorframe.operators.stats import (
    activity_span, binned_percentiles, distinct_count, distinct_values, exact_percentiles,
    implicit_group, mean, percentiles, row_count, series_agg, sketch_percentiles, spread,
)
from sensorframe.operators.timeslice import (
    around_midpoint, bound, earliest, instants, latest, midpoint, relative_slice, time_bounds, time_slice,
)

__all__ = [
    "activity_span", "around_midpoint", "binned_percentiles", "bound", "bucket_agg", "bucket_of", "digest",
    "digest_percentiles", "distinct_count", "distinct_values", "earliest", "exact_percentiles", "gap_fill", "hour_of_day",
    "hour_of_day_from_buckets", "implicit_group", "instants", "latest", "mean", "merge_digests", "midpoint", "percentiles",
    "relative_slice", "row_count", "sample", "sampled_percentiles", "series_agg", "sketch_percentiles", "spread",
    "time_bounds", "time_slice", "top_k", "top_k_per_group", "top_rows", "top_rows_per_group", "with_dense_id",
]
