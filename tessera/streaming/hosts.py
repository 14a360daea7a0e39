"""Host failures in Structured Streaming: the fold of operators.hosts as keyed state that expires."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.hosts import FORCE_BROWSER, fold

SCHEMA = "host string, event_id long, ts timestamp, failed boolean, score_before int, score int, force_browser boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    """Keeps the state of streams that start from now on in RocksDB, off the heap, as keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class HostMemory(StatefulProcessor):
    """A host's score and when it was last fetched; nothing is kept of a host at 0.

    clock "event": idle time is that of the fetches, and a timer deletes the state
    once the watermark has passed it. "processing": the state has a time to live, by
    the clock of the machine.
    """

    def __init__(self, idle_seconds: float | None, clock: str):
        self.idle, self.clock = None if idle_seconds is None else round(idle_seconds * 1_000_000), clock

    def init(self, handle) -> None:
        ttl = -(-self.idle // 1000) if self.idle is not None and self.clock == "processing" else None
        self.handle = handle
        self.memory = handle.getValueState("memory", "score int, last long", ttl)

    def _deadline(self, last: int) -> int:
        """The first millisecond by which a fetch would be later than idle."""
        return (last + self.idle) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")
        score, last = self.memory.get() if self.memory.exists() else (0, None)
        timed = self.idle if self.clock == "event" else None
        if timed is not None and last is not None:
            self.handle.deleteTimer(self._deadline(last))
        failed, us = pdf["failed"].tolist(), pdf["us"].tolist()
        after = fold(failed, score, us, timed, last)
        gaps = [u - t if t is not None else 0 for t, u in zip([last, *us], us, strict=False)]
        before = [0 if timed is not None and g > timed else b for b, g in zip([score, *after], gaps, strict=False)]
        if after[-1]:
            self.memory.update((after[-1], us[-1]))
            if timed is not None:
                self.handle.registerTimer(self._deadline(us[-1]))
        else:
            self.memory.clear()
        yield pdf[["host", "event_id", "ts", "failed"]].assign(score_before=before, score=after, force_browser=[b >= FORCE_BROWSER for b in before])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.memory.clear()
        yield from ()

    def close(self) -> None:
        pass


def host_history_stream(fetches: DataFrame, idle_seconds: float | None = None, clock: str = "event", late: str = "1 hour") -> DataFrame:
    """As host_history, for a stream: a micro-batch's rows of a host are taken in the order of (ts, event_id), micro-batches as they come.

    Hosts are state in RocksDB (see with_rocksdb), which a restart from the checkpoint
    goes on with. idle_seconds: how long a host without fetches is remembered, by
    event time with rows up to `late` late, or by the clock of the machine. A null
    failed is a success; rows without a host are left out.
    """
    rows = fetches.where("host is not null and host <> ''").select("host", "event_id", "ts", F.coalesce("failed", F.lit(False)).alias("failed"), F.unix_micros("ts").alias("us"))
    if idle_seconds is None:
        mode = "None"
    elif clock == "event":
        rows, mode = rows.withWatermark("ts", late), "EventTime"
    else:
        mode = "ProcessingTime"
    return rows.groupBy("host").transformWithStateInPandas(HostMemory(idle_seconds, clock), SCHEMA, "Append", mode)
