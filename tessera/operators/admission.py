"""Admission control: which requests a service with a limited number of permits turns away.

A request is admitted if fewer than `limit` admitted ones are running when it comes;
one that is turned away holds no permit. Starts and ends are swept as events, whose
running count is carried over ranges of time. Requests that would be admitted even if
no other had been turned away are certain; only the others depend on each other, and
only while their times overlap. So these alone are replayed, each stretch of
overlapping ones on its own, against the permits that certain requests leave free.
Of long stretches one piece of time is replayed after the other, and only the ends of
what still runs are carried on, so that no task holds a whole stretch.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from .order import ranges, running

#: Requests of a stretch, roughly, that a task replays at a time.
REPLAYED = 1_000_000

# fixed values: what a request that is turned away is told
SATURATED, SATURATED_STATUS = "crawler is saturated, retry later", 429


def _load(requests: DataFrame, name: str, by: tuple[str, ...], counts, order: tuple[str, ...]) -> DataFrame:
    """requests with the number of those for which `counts` holds that run when each begins; an end comes before a start of the same time."""
    lasting = F.when(counts & (F.col("end_us") > F.col("start_us")), 1).otherwise(0)
    start = requests.select("*", F.col("start_us").alias("__us"), F.lit(1).alias("__side"), lasting.cast("long").alias("__step"))
    end = requests.where("end_us > start_us").select("*", F.col("end_us").alias("__us"), F.lit(0).alias("__side"), (-lasting).cast("long").alias("__step"))
    swept = running(start.unionByName(end), name, F.col("__step"), ("__us", "__side", *order), by, own=False)
    return swept.where("__side = 1").drop("__us", "__side", "__step")


def _replayed(held: dict):
    """Of rows sorted by stretch and start, which are admitted; held: the ends of what runs of a stretch before them."""

    def run(batches):
        key, running_ends = None, []
        for b in batches:
            out = np.zeros(b.num_rows, bool)
            for i, (scope, stretch, start, end, room) in enumerate(zip(*(b.column(c).to_pylist() for c in ("__scope", "__stretch", "start_us", "end_us", "__room")), strict=True)):
                if (scope, stretch) != key:
                    key = (scope, stretch)
                    running_ends = sorted(held.get(key, ()))
                while running_ends and running_ends[0] <= start:
                    heapq.heappop(running_ends)
                if len(running_ends) < room:
                    out[i] = True
                    if end > start:
                        heapq.heappush(running_ends, end)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("__row", "__scope", "__stretch", "end_us")), pa.array(out)], names=["__row", "__scope", "__stretch", "end_us", "admitted"])

    return run


def _replay(rows: DataFrame, order: tuple[str, ...], held: dict) -> DataFrame:
    kind = rows.schema["__row"].dataType.simpleString()
    key = ("__scope", "__stretch")
    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(_replayed(held), f"__row {kind}, __scope string, __stretch string, end_us long, admitted boolean")


def _replay_all(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Which rows are admitted: short stretches side by side, long ones piece by piece in the order of time."""
    key = ["__scope", "__stretch"]
    long = cut(rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > REPLAYED).select(*key, "n"))
    most = long.agg(F.max("n"), F.sum("n")).first()
    if most[0] is None:
        return _replay(rows, order, {}).select("__row", "admitted")
    out = _replay(rows.join(long, key, "left_anti"), order, {}).select("__row", "admitted")
    those = rows.join(long.select(*key), key, "left_semi")
    parted = cut(those.withColumn("__piece", ranges(those, "start_us", -(-most[1] // REPLAYED))), "__piece")
    ends = sorted(parted.groupBy("__piece").agg(F.max("start_us").alias("last")).collect(), key=lambda r: r["__piece"])
    held: dict = {}
    for r in ends:
        told = cut(_replay(parted.where(F.col("__piece") == r["__piece"]), order, held))
        held = {k: left for k, v in held.items() if (left := [e for e in v if e > r["last"]])}
        for x in told.where(F.col("admitted") & (F.col("end_us") > r["last"])).select(*key, "end_us").collect():
            held.setdefault((x[0], x[1]), []).append(x[2])
        out = out.unionByName(told.select("__row", "admitted"))
    return out


def admit(requests: DataFrame, limit: int, by: tuple[str, ...] = ()) -> DataFrame:
    """requests (request_id, start_us, end_us, ...) with admitted, status (429 or null) and error.

    start_us, end_us: when a request comes and when it would end, in microseconds.
    Requests come in the order of (start_us, request_id, end_us); one that ends when
    another comes has given its permit back. by: columns whose values have `limit`
    permits each, nulls being a value; else there are `limit` in all. A request that
    ends at its start, before it or at no known time takes no permit from others; one
    without a start is turned away. Repeated rows are requests of their own.
    """
    tie = ("request_id", "end_us")
    named = requests.select(F.struct(*requests.columns).alias("__row"), *by, "request_id", "start_us", F.coalesce("end_us", "start_us").alias("end_us"))
    every = cut(_load(named.where("start_us is not null"), "__all", by, F.lit(True), tie).withColumn("__sure", F.col("__all") < limit))
    judged = cut(_load(every, "__certain", by, F.col("__sure"), (*tie, "__all")))
    # stretches of overlapping requests that aren't certain, named by their first
    order, first = ("start_us", *tie, "__all"), F.struct("start_us", "request_id")
    left = running(judged.where("not __sure"), "__until", F.greatest("start_us", "end_us"), order, by, "max", own=False)
    left = running(cut(left), "__stretch", F.when(F.col("__until").isNull() | (F.col("start_us") >= F.col("__until")), first), order, by, "last")
    scope = F.to_json(F.struct(*by)) if by else F.lit("")
    rows = left.select("__row", scope.alias("__scope"), F.to_json("__stretch").alias("__stretch"), *order, (limit - F.col("__certain")).alias("__room"))
    told = _replay_all(cut(rows), order)
    out = judged.where("__sure").select("__row", F.lit(True).alias("admitted")).unionByName(told).unionByName(named.where("start_us is null").select("__row", F.lit(False).alias("admitted")))
    refused = ~F.col("admitted")
    return out.select("__row.*", "admitted", F.when(refused, F.lit(SATURATED_STATUS)).alias("status"), F.when(refused, F.lit(SATURATED)).alias("error"))
