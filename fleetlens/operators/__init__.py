"""Generic DataFrame operators (G01-G24 of the blueprint)."""

from .topn import top_n
from .scope import capture_at, captures_at, database_scope, latest_capture, multi_filter, sample_keys
from .joins import blocking_pairs, resolve_handle, resolve_plan, resolve_text, shuffled, unused_keys, with_index_names
from .shares import conditional_split, pareto_cutoff, share_of_total
from .deltas import capture_range_delta, consecutive_delta, snapshot_delta
from .history import counter_gains, gained_between, segmented_delta, with_segments
from .dedup import distinct_pairs, latest_per_key
from .strings import ordered_string_agg, distinct_string_agg
from .overlap import prefix_overlap
from .ledger import ledger_of_intervals, upsert_intervals, upsert_ledger

__all__ = [
    "resolve_plan", "resolve_text", "top_n", "capture_at", "captures_at", "database_scope", "latest_capture",
    "multi_filter", "sample_keys", "blocking_pairs", "resolve_handle",
    "unused_keys", "with_index_names", "conditional_split", "pareto_cutoff",
    "share_of_total", "capture_range_delta", "consecutive_delta", "snapshot_delta", "distinct_pairs",
    "latest_per_key", "ordered_string_agg", "distinct_string_agg", "prefix_overlap",
    "upsert_ledger", "counter_gains", "gained_between", "segmented_delta", "with_segments",
    "upsert_intervals", "ledger_of_intervals",
]
