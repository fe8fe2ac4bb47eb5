"""Wait reports: top waits (R49), Pareto of waits (R50), wait delta."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact_ratio
from ..operators import pareto_cutoff, sample_keys, segmented_delta, share_of_total, snapshot_delta, top_n
from .constants import (PARETO_WAITS_BENIGN, TOP_WAITS_BENIGN, WAIT_HELP_URL, WAIT_SLEEP_PATTERN,
                        WAITFOR_WAIT)



def top_waits(waits: DataFrame, n: int = 20, benign=TOP_WAITS_BENIGN, per=None) -> DataFrame:
    """Wait, signal and real wait, and their % of the instance's total
    after leaving out benign types.

    The benign list is an ``IN`` set (pushed into the scan, no join); the
    total is a per-instance aggregate joined back (G08), not an empty
    ``OVER ()`` window."""
    keys = sample_keys(waits)
    w = waits.filter(~F.col("wait_type").isin(list(benign)))
    w = share_of_total(w, "wait_time_ms", keys, "_total")
    w = top_n(w, [F.col("wait_time_ms").desc(), *[F.col(k) for k in keys], F.col("wait_type")], n, per)
    return w.select(
        *keys, "wait_type", "wait_time_ms", "signal_wait_time_ms",
        (F.col("wait_time_ms") - F.col("signal_wait_time_ms")).alias("real_wait"),
        exact_ratio("wait_time_ms", "_total", factor=100, precision=12).alias("pct_waiting"),
        exact_ratio(F.col("wait_time_ms") - F.col("signal_wait_time_ms"), "_total", factor=100,
                    precision=12).alias("pct_real_time"))


def wait_pareto(waits: DataFrame, pct: int = 95, benign=PARETO_WAITS_BENIGN) -> DataFrame:
    """Waits, largest first, until the share before the row reaches
    ``pct`` % of the instance's total, with averages and a help link."""
    keys = sample_keys(waits)
    w = waits.filter(~F.col("wait_type").isin(list(benign)) & (F.col("waiting_tasks_count") > 0))
    w = pareto_cutoff(w, "wait_time_ms", [F.col("wait_time_ms").desc(), F.col("wait_type")], pct, keys)
    res = F.col("wait_time_ms") - F.col("signal_wait_time_ms")
    cnt = F.col("waiting_tasks_count")
    return w.select(
        *keys, "wait_type",
        exact_ratio("wait_time_ms", F.lit(1000), precision=16).alias("wait_s"),
        exact_ratio(res, F.lit(1000), precision=16).alias("resource_s"),
        exact_ratio("signal_wait_time_ms", F.lit(1000), precision=16).alias("signal_s"),
        cnt.alias("wait_count"),
        exact_ratio("wait_time_ms", "_total", factor=100, precision=5).alias("percentage"),
        exact_ratio("wait_time_ms", cnt * 1000, scale=4, precision=16).alias("avg_wait_s"),
        exact_ratio(res, cnt * 1000, scale=4, precision=16).alias("avg_res_s"),
        exact_ratio("signal_wait_time_ms", cnt * 1000, scale=4, precision=16).alias("avg_sig_s"),
        F.concat(F.lit(WAIT_HELP_URL), F.col("wait_type")).alias("help_url"))


def wait_delta(pre: DataFrame, post: DataFrame, sleep_pattern: str = WAIT_SLEEP_PATTERN) -> DataFrame:
    """Wait, signal and real-wait deltas between two captures; waits that
    grew, without sleeps (``NOT LIKE sleep_pattern``) and WAITFOR."""
    d = snapshot_delta(pre, post, ["instance_id", "wait_type"], ["wait_time_ms", "signal_wait_time_ms"],
                       keep=None, on_reset="raw")
    return _grown_waits(d, sleep_pattern)


def wait_delta_between(captures: DataFrame, start, end, restarts: DataFrame, sleep_pattern: str = WAIT_SLEEP_PATTERN) -> DataFrame:
    """R78 over a table of captures, cut at the servers' starts (R64): waits after a restart count from zero, whatever
    their values, and captures in between keep what was counted before it."""
    d = segmented_delta(captures, ["instance_id", "wait_type"], ["wait_time_ms", "signal_wait_time_ms"], start, end, restarts, keep=None)
    return _grown_waits(d, sleep_pattern)


def _grown_waits(d: DataFrame, sleep_pattern: str) -> DataFrame:
    d = d.filter((F.col("delta_wait_time_ms") > 0) & ~F.col("wait_type").like(sleep_pattern)
                 & (F.col("wait_type") != WAITFOR_WAIT))
    return d.select("instance_id", "wait_type",
                    F.col("delta_wait_time_ms").alias("wait_time_ms"),
                    F.col("delta_signal_wait_time_ms").alias("signal_wait_time_ms"),
                    (F.col("delta_wait_time_ms") - F.col("delta_signal_wait_time_ms")).alias("real_wait"))
