"""State with expiry, as-of lookups, windows with late data and admission, against plain Python."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import admission, asof, hosts, metrics, order
from tessera.streaming import hosts as stream

FETCHES = "host string, event_id long, ts timestamp, failed boolean"
DAY = dt.datetime(2024, 1, 1)
IDLE = 6 * 3600


def replay(rows, idle=None):
    """(event_id, score_before, score) of fetches, one by one."""
    known, out = {}, []
    for host, i, ts, failed in sorted(rows, key=lambda r: (r[2], r[1])):
        score, last = known.get(host, (0, None))
        if idle is not None and last is not None and (ts - last).total_seconds() > idle:
            score = 0
        after = min(8, score + 1) if failed else max(0, score - 1)
        out.append((i, score, after))
        known[host] = (after, ts)
    return sorted(out), known


def some_fetches(rng, n, every=dt.timedelta(minutes=40)):
    at, rows = DAY, []
    for i in range(n):
        at += rng.choice([dt.timedelta(0), every, every, 12 * every])
        rows.append((rng.choice(["hot", "hot", "hot", "a", "b", "c"]), i, at, rng.random() < 0.6))
    return rows


@pytest.mark.parametrize("run", [256, 3])
@pytest.mark.parametrize("idle", [None, IDLE])
def test_host_memory_of_runs_of_any_size(spark, monkeypatch, run, idle):
    monkeypatch.setattr(hosts, "RUN", run)
    rows = some_fetches(random.Random(run), 400)
    want, known = replay(rows, idle)
    df = spark.createDataFrame([*rows, (None, 999, DAY, True), ("", 998, DAY, True)], FETCHES)
    got = hosts.host_history(df, idle).collect()
    assert sorted((r["event_id"], r["score_before"], r["score"]) for r in got) == want
    assert all(r["force_browser"] == (r["score_before"] >= 3) for r in got)
    assert {r["host"]: r["score"] for r in hosts.host_scores(df, idle).collect()} == {h: s for h, (s, _) in known.items() if s}


def test_scores_at_a_time(spark):
    late = DAY + dt.timedelta(days=900)
    df = spark.createDataFrame([("a", 1, DAY, True), ("b", 2, DAY, True), ("b", 3, late, True)], FETCHES)
    assert {r["host"]: r["score"] for r in hosts.host_scores(df, IDLE, F.lit(late)).collect()} == {"b": 1}
    assert hosts.host_history(df.where("false")).count() == 0 and hosts.host_scores(df.where("false")).count() == 0
    null = spark.createDataFrame([("a", 1, DAY, None), ("a", 2, DAY, True)], FETCHES)
    assert sorted(r["score"] for r in hosts.host_history(null).collect()) == [0, 1]


@pytest.mark.parametrize("idle", [None, IDLE])
def test_a_request_finds_the_score_of_its_time(spark, idle):
    rng = random.Random(9)
    rows = some_fetches(rng, 200)
    asked = [(i, rng.choice(["hot", "a", "none", None]), DAY + dt.timedelta(minutes=rng.randrange(-100, 30_000))) for i in range(150)]
    asked += [(900, "hot", rows[5][2]), (901, "hot", None), (902, "a", None), (3, *asked[3][1:])]
    history = replay(rows, idle)[0]
    after = {i: s for i, _, s in history}

    def score(host, ts):
        own = [(t, i) for h, i, t, _ in rows if h == host and ts is not None and t <= ts]
        if not own or (idle is not None and (ts - max(own)[0]).total_seconds() > idle):
            return 0
        return after[max(own)[1]]

    df = spark.createDataFrame([(i, h, t, "kept") for i, h, t in asked], "request_id long, host string, ts timestamp, more string")
    got = hosts.scores_at(df, spark.createDataFrame(rows, FETCHES), idle).collect()
    assert sorted((r["request_id"], r["host_score"], r["force_browser"]) for r in got) == sorted((i, score(h, t), score(h, t) >= 3) for i, h, t in asked)
    assert {r["more"] for r in got} == {"kept"}
    assert {r["host_score"] for r in hosts.scores_at(df, spark.createDataFrame([], FETCHES)).collect()} == {0}


def test_as_of_takes_the_last_value_and_skips_nulls(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 9), (3, "k", 0), (4, None, 9), (5, "other", 9), (5, "other", 9)], "id long, k string, t long")
    right = spark.createDataFrame([("k", 1, 1, "a"), ("k", 5, 1, "b"), ("k", 5, 2, "c"), ("k", 8, 1, None), (None, 1, 1, "no"), ("other", 10, 1, "late")], "k string, t long, tie long, v string")
    got = sorted((r["id"], r["v"]) for r in asof.as_of(left, right, ("k",), "t", "tie", "v").collect())
    assert got == [(1, "c"), (2, "c"), (3, None), (4, None), (5, None), (5, None)]


def test_running_values_over_ranges(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", "x", None]), rng.choice([None, rng.randrange(100)])) for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "i long, g string, v long")
    for how, own in (("sum", True), ("sum", False), ("max", True), ("max", False), ("last", True), ("last", False)):
        got = {r["i"]: r["out"] for r in order.running(df, "out", F.col("v"), ("i",), ("g",), how, own).collect()}
        assert len(got) == 300
        for i, g, _ in rows:
            seen = [v for j, h, v in sorted(rows, key=lambda r: r[0]) if h == g and (j <= i if own else j < i) and v is not None]
            assert got[i] == {"sum": sum(seen), "max": max(seen, default=None), "last": seen[-1] if seen else None}[how]


def arrivals(spark, folder, rows, schema):
    """One file for each micro-batch, written when asked for."""
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        yield


@pytest.mark.parametrize("restart", [False, True])
def test_stream_with_expiry_equals_batch(spark, tmp_path, restart):
    stream.with_rocksdb(spark)
    rows = some_fetches(random.Random(8), 240)
    parts = [rows[60 * k : 60 * k + 60] for k in range(4)]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    fed = arrivals(spark, folder, parts, FETCHES)
    next(fed)

    def start():
        src = spark.readStream.schema(FETCHES).parquet(folder)
        return stream.host_history_stream(src, IDLE, late="1 hour").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", out).start()

    q = start()
    q.processAllAvailable()
    for _ in fed:
        if restart:
            q.stop()
            q = start()
        q.processAllAvailable()
    q.stop()
    got = sorted((r["event_id"], r["score_before"], r["score"]) for r in spark.read.parquet(out).collect())
    assert got == replay(rows, IDLE)[0]
    assert any(b == 0 and a == 1 for _, b, a in got)


def test_state_of_an_idle_host_is_deleted_by_its_timer(spark, tmp_path):
    stream.with_rocksdb(spark)
    rows = [[("a", 1, DAY, True), ("b", 2, DAY, True)], [("b", 3, DAY + dt.timedelta(days=2), True)], [("b", 4, DAY + dt.timedelta(days=2, hours=1), True)]]
    fed = arrivals(spark, str(tmp_path / "in"), rows, FETCHES)
    next(fed)
    q = stream.host_history_stream(spark.readStream.schema(FETCHES).parquet(str(tmp_path / "in")), IDLE).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    for _ in fed:
        q.processAllAvailable()
    q.stop()
    kept = spark.read.format("statestore").option("stateVarName", "memory").load(str(tmp_path / "c")).selectExpr("key.host", "value.score").collect()
    assert [tuple(r) for r in kept] == [("b", 2)]


def test_state_by_the_machines_clock(spark, tmp_path):
    stream.with_rocksdb(spark)
    rows = some_fetches(random.Random(3), 60)
    for _ in arrivals(spark, str(tmp_path / "in"), [rows], FETCHES):
        pass
    q = stream.host_history_stream(spark.readStream.schema(FETCHES).parquet(str(tmp_path / "in")), 3600, "processing").writeStream.format("memory").queryName("clock").option("checkpointLocation", str(tmp_path / "c")).start()
    until = time.time() + 60
    while spark.table("clock").count() < len(rows) and time.time() < until:  # by this clock there is always another micro-batch
        time.sleep(1)
    q.stop()
    assert sorted((r["event_id"], r["score_before"], r["score"]) for r in spark.table("clock").collect()) == replay(rows)[0]


METRIC = "host string, status string, ts timestamp, duration_ms long, arrival long"


def test_late_rows_are_dropped_by_stream_and_batch_alike(spark, tmp_path):
    rng = random.Random(4)
    parts = []
    for k in range(6):
        at = DAY + dt.timedelta(hours=4 * k)
        parts.append([(rng.choice(["hot", "hot", "a", None]), rng.choice(["ok", "error", None]), at + dt.timedelta(minutes=rng.randrange(240)) - (dt.timedelta(hours=rng.choice([1, 3, 9])) if rng.random() < 0.3 else dt.timedelta(0)), rng.choice([None, 5, 100, 101, 20_000, 99_999]), k) for _ in range(60)])
    rows = [r for p in parts for r in p]
    df = spark.createDataFrame([*rows, ("a", "ok", None, 1, 0)], METRIC)
    kept = metrics.on_time(df, 3600, 7200)
    assert 0 < kept.count() < len(rows)
    fed = arrivals(spark, str(tmp_path / "in"), parts, METRIC)
    next(fed)
    src = spark.readStream.schema(METRIC).parquet(str(tmp_path / "in"))
    q = metrics.fetch_metrics(src, 3600, 7200).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    for _ in fed:
        q.processAllAvailable()
    q.stop()
    told = {tuple(r) for r in spark.table("windows").collect()}
    want = {tuple(r) for r in metrics.fetch_metrics(kept, 3600).collect()}
    mark = max(r[2] for r in rows) - dt.timedelta(hours=2)
    assert told == {r for r in want if r[0] + dt.timedelta(hours=1) <= mark} and len(told) > 20
    some = next(r for r in want if r[3] > 1)
    own = [r[3] for r in kept.collect() if r[0] == some[1] and r[1] == some[2] and r[2].replace(minute=0) == some[0]]
    assert some[3] == len(own) and some[4] == sum(x or 0 for x in own) and some[5:] == tuple(sum(x is not None and x <= b for x in own) for b in metrics.BUCKETS)
    totals = metrics.metric_totals(metrics.fetch_metrics(kept, 3600)).collect()
    assert sum(r["fetches"] for r in totals) == kept.count()
    assert metrics.fetch_metrics(metrics.on_time(df.where("false"), 3600, 60)).count() == 0


def one_by_one(rows, limit, by_host):
    """Which requests (id, host, start, end) are admitted."""
    out, running = [], {}
    for i, host, s, e in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0], r[3] if r[3] is not None else r[2])):
        e = s if e is None else e
        key = host if by_host else 0
        running[key] = [x for x in running.get(key, []) if x > s]
        ok = len(running[key]) < limit
        if ok and e > s:
            running[key].append(e)
        out.append((i, host, ok))
    return sorted(out + [(r[0], r[1], False) for r in rows if r[2] is None], key=str)


@pytest.mark.parametrize("by", [(), ("host",)])
@pytest.mark.parametrize(("limit", "long"), [(1, 40), (3, 60), (2, 2000)])
def test_admission(spark, by, limit, long):
    rng = random.Random(limit * long)
    rows = []
    for i in range(300):
        s = rng.randrange(3000)
        rows.append((i, rng.choice(["hot", "hot", "a", "b", None]), s, s + rng.randrange(long)))
    rows += [(400, "a", 10, 10), (401, "a", 10, 5), (402, "hot", 20, None), (403, "hot", None, 30), (404, None, None, None), (7, *rows[7][1:]), (7, *rows[7][1:3], rows[7][3] + 5)]
    df = spark.createDataFrame(rows, "request_id long, host string, start_us long, end_us long")
    got = admission.admit(df, limit, by).collect()
    assert sorted(((r["request_id"], r["host"], r["admitted"]) for r in got), key=str) == one_by_one(rows, limit, bool(by))
    assert all((r["status"], r["error"]) == ((None, None) if r["admitted"] else (429, "crawler is saturated, retry later")) for r in got)


@pytest.mark.parametrize("by", [(), ("host",)])
def test_long_stretches_are_replayed_piece_by_piece(spark, monkeypatch, by):
    """A service that is saturated throughout: no task replays more than a piece, and what runs is carried on."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot", "hot", "a"]), s := rng.randrange(3000), s + rng.choice([5, 90, 1500])) for i in range(600)]
    held, whole = [], admission._replayed
    monkeypatch.setattr(admission, "REPLAYED", 100)
    monkeypatch.setattr(admission, "_replayed", lambda before: held.append(before) or whole(before))
    df = spark.createDataFrame(rows, "request_id long, host string, start_us long, end_us long").repartition(3)
    got = admission.admit(df, 2, by).collect()
    assert sorted(((r["request_id"], r["host"], r["admitted"]) for r in got), key=str) == one_by_one(rows, 2, bool(by))
    assert len(held) >= 5 and any(held) and all(len(ends) <= 2 for x in held for ends in x.values())


def test_admission_of_nothing(spark):
    df = spark.createDataFrame([], "request_id long, host string, start_us long, end_us long")
    assert admission.admit(df, 3).count() == 0 and admission.admit(df, 0, ("host",)).count() == 0
    assert [r["admitted"] for r in admission.admit(spark.createDataFrame([(1, "a", 0, 9)], df.schema), 0).collect()] == [False]
