"""Structured Streaming forms of the counter sampler (ST1) and the usage
ledger (ST2)."""

from .counters import compact_counter_windows, counter_windows, read_counter_windows, start_counter_stream
from .ledger import read_ledger, start_ledger_stream

__all__ = ["compact_counter_windows", "counter_windows", "read_counter_windows", "start_counter_stream", "read_ledger",
           "start_ledger_stream"]
