"""Metrics of fetches by event time: numbers, time and latency buckets of each window, host and status.

The same columns serve tables and streams; on a stream, late rows go by its watermark,
and on_time applies that rule to a table of fetches that tells when each arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import running

#: Upper bounds of the latency buckets, in milliseconds; each holds the buckets below it.
BUCKETS = (100, 500, 1000, 5000, 10_000, 30_000)


def fetch_metrics(fetches: DataFrame, every_seconds: int = 3600, late_seconds: int | None = None, buckets: tuple[int, ...] = BUCKETS) -> DataFrame:
    """One row per window of every_seconds, host and status of fetches (host, status, ts, duration_ms): window_start, host, status, fetches, total_ms and le_<bound> for each bucket.

    late_seconds: on a stream, how late rows may be: a window is told once, when the
    watermark has passed its end. Null hosts and statuses are groups of their own;
    rows without ts are in no window; a null duration counts as a fetch in no bucket.
    """
    if late_seconds is not None:
        fetches = fetches.withWatermark("ts", f"{late_seconds} seconds")
    bounds = [F.count_if(F.col("duration_ms") <= b).alias(f"le_{b}") for b in buckets]
    out = fetches.groupBy(F.window("ts", f"{every_seconds} seconds"), "host", "status").agg(F.count("*").alias("fetches"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_ms"), *bounds)
    return out.select(F.col("window.start").alias("window_start"), "host", "status", "fetches", "total_ms", *[f"le_{b}" for b in buckets])


def on_time(fetches: DataFrame, every_seconds: int, late_seconds: int) -> DataFrame:
    """The rows of fetches (ts, arrival, ...) that a stream's windows would count, arrival being the micro-batch that they came in.

    The watermark of a micro-batch is the latest ts of those before it, in whole
    milliseconds, less late_seconds; a row whose window has ended by then is late.
    Rows without ts or arrival are left out.
    """
    us, span = F.unix_micros("ts"), every_seconds * 1_000_000
    rows = fetches.where("ts is not null and arrival is not null")
    marks = running(rows.groupBy("arrival").agg(F.max(us).alias("__us")), "__latest", F.col("__us"), ("arrival",), (), "max", own=False).select("arrival", (F.expr("__latest div 1000") * 1000 - late_seconds * 1_000_000).alias("__mark"))
    met = rows.join(marks, "arrival")
    end = (F.floor(us / span).cast("long") + 1) * span
    return met.where(F.col("__mark").isNull() | (end > F.col("__mark"))).select(*fetches.columns)


def metric_totals(metrics: DataFrame) -> DataFrame:
    """Metrics summed over windows and hosts: one row a status, in the form in which they are scraped (cumulative buckets, sum and count)."""
    sums = [c for c in metrics.columns if c in ("fetches", "total_ms") or c.startswith("le_")]
    return metrics.groupBy("status").agg(*[F.sum(c).alias(c) for c in sums])
