"""Failures of hosts over time: a score that each failure raises and each success lowers, kept within 0 and 8.

A fetch is the map x -> min(hi, max(lo, x + c)); where a host was idle for longer
than is asked for, it begins anew, which is a map with lo = hi. Such maps compose to
maps of the same form. So a host's fetches are folded as a tree: runs of up to RUN
fetches become one map each, runs of these one again, and on the way down each run
learns the score that it begins with. All is native, and a host of very many fetches
is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from .asof import as_of
from .order import running

# fixed values
MOST, FORCE_BROWSER = 8, 3
#: Fetches, or maps, that are folded at once.
RUN = 256


def fold(failed: list[bool], score: int = 0, times: list | None = None, idle=None, last=None) -> list[int]:
    """The score after each fetch of one host, from a score and the time of the fetch before on; longer than idle without one, and it is 0 again."""
    out = []
    for i, f in enumerate(failed):
        if idle is not None and last is not None and times[i] - last > idle:
            score = 0
        last = times[i] if times is not None else None
        score = min(score + 1, MOST) if f else max(score - 1, 0)
        out.append(score)
    return out


def _through(score: Column, m: Column) -> Column:
    return F.least(m["hi"], F.greatest(m["lo"], score + m["c"]))


def _fresh(last: Column, first: Column, idle: int | None) -> Column:
    """Whether a host that was last fetched then begins anew."""
    return F.coalesce(first - last > idle, F.lit(False)) if idle is not None else F.lit(False)


def _fetch_map(x: Column) -> Column:
    failed = x["failed"]
    return F.struct(F.when(failed, 1).otherwise(0).alias("lo"), F.when(failed, MOST).otherwise(MOST - 1).alias("hi"), F.when(failed, 1).otherwise(-1).cast("long").alias("c"), x["us"].alias("first"), x["us"].alias("last"))


def _composed(idle: int | None):
    def then(a: Column, b: Column) -> Column:
        fresh, anew = _fresh(a["last"], b["first"], idle), _through(F.lit(0), b)
        ends = [F.when(fresh, anew).otherwise(_through(a[c], b)).cast("int").alias(c) for c in ("lo", "hi")]
        return F.struct(*ends, F.when(fresh, F.lit(0)).otherwise(a["c"] + b["c"]).cast("long").alias("c"), a["first"].alias("first"), b["last"].alias("last"))

    return then


def _runs(df: DataFrame, *items: str) -> DataFrame:
    """Rows (host, at, items...) in runs: host, at and the sorted items of each."""
    return df.groupBy("host", F.expr(f"at div {RUN}").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", *items))).alias("items"))


def _maps(runs: DataFrame, idle: int | None, leaf: bool) -> DataFrame:
    maps = F.transform("items", _fetch_map) if leaf else F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in ("lo", "hi", "c", "first", "last")]))
    whole = F.aggregate(F.slice(maps, 2, RUN), maps[0], _composed(idle))
    return runs.select("host", "at", whole.alias("m")).select("host", "at", "m.*")


def _tree(fetches: DataFrame, idle: int | None) -> tuple[list[DataFrame], DataFrame]:
    """The levels of runs, from the fetches up, and each host's map."""
    rows = fetches.where("host is not null and host <> ''").select("host", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce("failed", F.lit(False)).alias("failed"))
    placed = running(rows, "at", F.lit(1).cast("long"), ("ts", "event_id"), ("host",), own=False).withColumn("us", F.unix_micros("ts"))
    levels = [cut(_runs(placed, "event_id", "ts", "us", "failed"))]
    maps, n = _maps(levels[0], idle, True), levels[0].groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while n > 1:  # runs of the largest host
        levels.append(_runs(maps, "lo", "hi", "c", "first", "last"))
        maps, n = _maps(levels[-1], idle, False), -(-n // RUN)
    return levels, maps


def _micros(idle_seconds: float | None) -> int | None:
    return None if idle_seconds is None else round(idle_seconds * 1_000_000)


def host_history(fetches: DataFrame, idle_seconds: float | None = None) -> DataFrame:
    """Of fetches (host, event_id, ts, failed) the host's score before and after each, and whether it asks for a browser.

    In the order of (ts, event_id), which must tell a host's fetches apart; rows
    without a host are left out, and a null `failed` is a success. idle_seconds: the
    time without a fetch beyond which a host's failures are forgotten.
    """
    idle = _micros(idle_seconds)
    levels, maps = _tree(fetches, idle)
    begin = maps.select("host", "at", F.lit(0).alias("start"), F.lit(None).cast("long").alias("since"))
    for runs in reversed(levels[1:]):
        zero = F.struct(F.col("start").alias("score"), F.col("since").alias("last"), F.array().cast("array<struct<at: long, start: int, since: long>>").alias("out"))

        def step(a, x):
            score = F.when(_fresh(a["last"], x["first"], idle), F.lit(0)).otherwise(a["score"])
            return F.struct(_through(score, x).cast("int").alias("score"), x["last"].alias("last"), F.array_append(a["out"], F.struct(x["at"].alias("at"), a["score"].alias("start"), a["last"].alias("since"))).alias("out"))

        begin = runs.join(begin, ["host", "at"]).select("host", F.explode(F.aggregate("items", zero, step)["out"]).alias("s")).select("host", "s.*")
    kind = "array<struct<event_id: long, ts: timestamp, failed: boolean, score_before: int, score: int>>"
    zero = F.struct(F.col("start").alias("score"), F.col("since").alias("last"), F.array().cast(kind).alias("out"))

    def fetch(a, x):
        before = F.when(_fresh(a["last"], x["us"], idle), F.lit(0)).otherwise(a["score"])
        after = F.when(x["failed"], F.least(before + 1, F.lit(MOST))).otherwise(F.greatest(before - 1, F.lit(0)))
        row = F.struct(x["event_id"].cast("long").alias("event_id"), x["ts"].alias("ts"), x["failed"].alias("failed"), before.alias("score_before"), after.alias("score"))
        return F.struct(after.alias("score"), x["us"].alias("last"), F.array_append(a["out"], row).alias("out"))

    told = levels[0].join(begin, ["host", "at"]).select("host", F.explode(F.aggregate("items", zero, fetch)["out"]).alias("r")).select("host", "r.*")
    return told.withColumn("force_browser", F.col("score_before") >= FORCE_BROWSER)


def host_scores(fetches: DataFrame, idle_seconds: float | None = None, at: Column | None = None) -> DataFrame:
    """Each host's score at the end, or at a time, by when a host may have been idle; hosts at 0 are forgotten."""
    idle = _micros(idle_seconds)
    maps = _tree(fetches, idle)[1]
    score = _through(F.lit(0), F.struct("lo", "hi", "c")).cast("int")
    if at is not None and idle is not None:
        score = F.when(_fresh(F.col("last"), F.unix_micros(at), idle), F.lit(0)).otherwise(score)
    return maps.select("host", score.alias("score")).where("score > 0")


def scores_at(requests: DataFrame, fetches: DataFrame, idle_seconds: float | None = None) -> DataFrame:
    """requests (request_id, host, ts, ...) with host_score, the score that the host's fetches up to ts left, and whether it asks for a browser.

    An as-of lookup: of the fetches at or before ts, those at ts included, the last
    one counts. A host without any, a null host or a null ts have the score 0, as a
    host idle for longer than idle_seconds at ts. Repeated requests are answered row
    by row.
    """
    history = cut(host_history(fetches, idle_seconds).select("host", "ts", "event_id", F.struct("score", "ts").alias("__known")))
    out = as_of(requests.withColumn("ts", F.col("ts").cast("timestamp")), history, ("host",), "ts", "event_id", "__known")
    score = F.col("__known.score")
    if idle_seconds is not None:
        score = F.when(_fresh(F.unix_micros("__known.ts"), F.unix_micros("ts"), _micros(idle_seconds)), F.lit(0)).otherwise(score)
    out = out.withColumn("host_score", F.coalesce(score, F.lit(0))).drop("__known")
    return out.withColumn("force_browser", F.col("host_score") >= FORCE_BROWSER)
