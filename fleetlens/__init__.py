"""fleetlens: fleet telemetry analytics for database servers, on Spark.

Captured monitoring views (query statistics, waits, counters, index usage,
locks, sessions, space, XML event documents) of many servers go in as
DataFrames keyed by ``instance_id`` / ``captured_at``; ranked, compared and
explained reports come out.  Everything is a lazy DataFrame plan built from
built-in Spark SQL functions.
"""

__version__ = "0.1.0"
