"""Hosts in batch and stream, crawls, benchmark summaries, and every registered query against DuckDB."""

import datetime as dt
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import extract
from tessera.operators import batch, benchmark, crawl, hosts, order, scrape
from tessera.plans import requests as plans
from tessera.sources import tables
from tessera.streaming import hosts as stream
from tessera.streaming import pages as page_stream

EVENTS = "host string, event_id long, ts timestamp, failed boolean"
DAY = dt.datetime(2024, 1, 1)


def test_a_host_is_capped_at_eight_and_forced_from_three(spark):
    rows = [("h", i, DAY + dt.timedelta(hours=5 * i), i < 10) for i in range(13)]
    got = [tuple(r) for r in hosts.host_history(spark.createDataFrame(rows, EVENTS)).orderBy("event_id").select("score_before", "score", "force_browser").collect()]
    assert [g[1] for g in got] == [1, 2, 3, 4, 5, 6, 7, 8, 8, 8, 7, 6, 5]
    assert [g[2] for g in got] == [False] * 3 + [True] * 10


def test_scores_by_composed_days_equal_the_fold(spark):
    rng = random.Random(5)
    rows = [(f"h{rng.randrange(5)}", i, DAY + dt.timedelta(hours=i * 3), rng.random() < 0.55) for i in range(300)] + [(None, 999, DAY, True), ("", 998, DAY, True)]
    want = {}
    for h in {r[0] for r in rows if r[0]}:
        s = hosts.fold([r[3] for r in rows if r[0] == h])[-1]
        if s:
            want[h] = s
    assert {r["host"]: r["score"] for r in hosts.host_scores(spark.createDataFrame(rows, EVENTS)).collect()} == want


def test_rows_are_numbered_in_ranges(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10**6), 400)
    rows = [(i, "hot" if i % 3 else f"h{i % 7}") for i in ids]
    df = spark.createDataFrame(rows, "index long, host string")
    got = {r["index"]: (r["a"], r["b"]) for r in order.numbered(order.numbered(df, "a", "index"), "b", "index", ("host",)).collect()}
    for i, h in rows:
        assert got[i] == (sorted(ids).index(i) + 1, sorted(x for x, y in rows if y == h).index(i) + 1)
    assert order.numbered(df.where("false"), "a", "index").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    stream.with_rocksdb(spark)
    rng = random.Random(7)
    rows = [(f"h{rng.randrange(4)}", i, DAY + dt.timedelta(minutes=i), rng.random() < 0.6) for i in range(120)]
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    q = stream.host_history_stream(src).writeStream.format("memory").queryName("hosts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    cols = ["host", "event_id", "score_before", "score", "force_browser"]
    want = {tuple(r) for r in hosts.host_history(spark.createDataFrame(rows, EVENTS)).select(cols).collect()}
    assert {tuple(r) for r in spark.table("hosts").select(cols).collect()} == want


def test_pages_are_scored_as_they_come(spark, tmp_path, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    pages.write.parquet(str(tmp_path / "p"))
    q = page_stream.signals_stream(page_stream.read_pages(spark, str(tmp_path / "p"))).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    want = {r["page_id"]: r["word_count"] for r in catalog.QUERIES["visible_word_count"](spark, small).collect()}
    assert {r["page_id"]: r["n"] for r in spark.table("scored").select("page_id", F.col("signals.word_count").alias("n")).collect()} == want


WORDS = " ".join(f"word{i}" for i in range(200))
GOOD = f"<html><body><article><p>{WORDS}</p></article></body></html>"
FETCH = {"url": "http://a.org/x", "final_url": "http://a.org/y", "status_code": 200, "headers": {"content-type": "text/html"}, "html": GOOD, "error_status": None, "page_links": None, "waf_check": False, "content_truncated": False, "duration_ms": 5, "ts": None}


def answers(spark, fetches, requests, scores=None):
    rows = spark.createDataFrame([{**FETCH, **f} for f in fetches], tables.FETCHES)
    plan = plans.scrape_plan(spark.createDataFrame([{"url": "http://a.org/x", "crawl_mode": "http", "response_format": "text", "include_content": True, "required_text": None, "wait_for_selector": None, **r} for r in requests], "index long, url string, crawl_mode string, response_format string, include_content boolean, required_text string, wait_for_selector string"))
    got = scrape.scrape(rows, plan, scores=None if scores is None else spark.createDataFrame(scores, "host string, score int"))
    return {r["request_id"]: r for r in got.collect()}


def tried(request, *attempts):
    return [{"request_id": request, "attempt": k, "mode": mode, **more} for k, (mode, more) in enumerate(attempts)]


def test_one_answer_per_request_whatever_its_attempts(spark):
    thin, gone = {"html": "<p>few words</p>"}, {"html": None, "status_code": None}
    fetches = [
        *tried(1, ("http", {"status_code": 503}), ("http", {})),
        *tried(2, ("http", thin), ("http", thin), ("http", thin), ("browser", {"duration_ms": 100})),
        *tried(3, ("http", thin), ("http", gone), ("http", gone)),
        *tried(4, ("http", {"html": f"<b>verify you are a human</b>{GOOD}"}), ("http", gone), ("http", {}), ("http", {"status_code": 404})),
        *tried(5, ("browser", {}), ("browser", {"html": GOOD.replace("word0 ", "last ")})),
        *tried(6, ("http", {"headers": {"content-type": "application/pdf"}})),
        *tried(8, ("http", {})),
    ]
    got = answers(spark, fetches, [{"index": i, "crawl_mode": "browser" if i == 5 else "http", "url": "no url" if i == 8 else "http://a.org/x"} for i in range(1, 9)])
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7]
    told = lambda i: (got[i]["status_code"], got[i]["mode_used"], got[i]["signals"]["fallback_reason"], got[i]["error"] and got[i]["error"]["code"], got[i]["failed"], got[i]["duration_ms"])
    assert told(1) == (200, "http", "none", None, False, 10)
    assert told(2) == (200, "http", "http_low_words", None, False, 115)
    assert told(3) == (None, "http", "http_empty", "empty_content", True, 15)
    assert told(4) == (200, "http", "none", None, False, 20)
    assert told(5) == (200, "browser", "none", None, False, 10) and got[5]["content"].startswith("last")
    assert told(6) == (200, "http", "http_unsupported_content_type", "unsupported_content_type", False, 5) and got[6]["page"] is None
    assert told(7) == (None, "http", "http_empty", "empty_content", True, 0) and got[7]["signals"]["word_count"] == 0


def test_auto_answers_take_a_browser_where_text_or_selector_or_host_ask_for_it(spark):
    fetches = [f for i in (1, 2, 3, 4) for f in tried(i, ("http", {}), ("browser", {"final_url": "http://a.org/b"}))]
    fetches += tried(5, ("browser", {"final_url": "http://a.org/warm"}), ("http", {"final_url": "http://a.org/plain"}))
    auto = {"crawl_mode": "auto"}
    got = answers(spark, fetches, [{"index": 1, **auto}, {"index": 2, "required_text": "missing", **auto}, {"index": 3, "wait_for_selector": "#none", **auto}, {"index": 4, "required_text": "WORD7 ", "wait_for_selector": "article", **auto}, {"index": 5, "url": "http://bad.org", **auto}], [("bad.org", 3)])
    told = {i: (r["final_url"][13:], r["mode_used"], r["signals"]["fallback_reason"]) for i, r in got.items()}
    assert told == {1: ("y", "auto", "none"), 2: ("b", "browser", "required_text_missing"), 3: ("b", "browser", "wait_for_selector_missing"), 4: ("y", "auto", "none"), 5: ("warm", "browser", "http_blocked")}


def test_items_of_batches(spark):
    plan = plans.crawl_plan(spark.createDataFrame([(2, "http://a"), (0, "bad"), (1, "http://b")], "index long, url string"))
    got = batch.crawl_items(spark.createDataFrame([(2, 3, 7)], "seed long, pages_fetched long, unique_links_seen long"), plan).collect()
    assert [tuple(r) for r in got] == [(0, False, None, None, None, "url must be a valid absolute URL"), (1, True, "http://b", 0, 0, None), (2, True, "http://a", 3, 7, None)]


def test_crawls_with_limits_of_their_own(spark):
    edges = spark.createDataFrame([(0, k) for k in range(1, 40)] + [(k, 100 + k) for k in range(1, 40)], "src long, dst long")
    seeds = spark.createDataFrame([(0, 0, 1, 100), (1, 0, 6, 5), (2, 0, 6, 50), (3, 0, 0, 9)], "seed long, page long, max_depth int, max_pages int")
    got = crawl.crawl(seeds, edges, 6, 60).groupBy("seed").agg(F.count("*").alias("n"), F.max("depth").alias("d"), F.max("place").alias("p")).collect()
    assert {r["seed"]: (r["n"], r["d"], r["p"]) for r in got} == {0: (40, 1, 40), 1: (5, 1, 5), 2: (50, 2, 50), 3: (1, 0, 1)}


def test_no_folder_of_one_machine_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_folder(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://x/y/"}
    assert tables.shared_folder(Session()) == "hdfs://x/y"


def test_crawl_of_a_cycle_ends(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 3)], "src long, dst long")
    seeds = spark.createDataFrame([(0, 0)], "seed long, page long")
    got = {r["page"]: (r["depth"], r["place"]) for r in crawl.crawl(seeds, edges, 6, 3).collect()}
    assert got == {0: (0, 1), 1: (1, 2), 3: (1, 3)}
    assert crawl.crawl(seeds.where("false"), edges, 2, 5).count() == 0




@pytest.mark.parametrize(("values", "p95"), [([], None), ([2.0], 2.0), ([1.0, 2.0], 2.85), ([float(i) for i in range(1, 20)], 19.0)])
def test_exclusive_percentile(spark, values, p95):
    import statistics

    got = spark.createDataFrame([(values,)], "v array<double>").select(benchmark.exclusive_p95(F.col("v"))).first()[0]
    assert got == pytest.approx(p95) if p95 is not None else got is None
    if len(values) > 1:
        assert got == pytest.approx(statistics.quantiles(values, n=20)[-1])


def test_summary_of_runs(spark):
    rows = [(1, "b", "u", True, 1.0, 10, 0, "T", None), (2, "b", "u", True, 2.0, 5, 3, " t ", None), (3, "b", "u", False, 9.0, 0, 0, None, "late"), (4, "a", "v", False, 1.0, 0, 0, None, "no")]
    runs = spark.createDataFrame(rows, "run_id long, tool string, url string, ok boolean, duration_s double, bytes_extracted long, link_count long, title string, error string")
    b, a = benchmark.summarize(runs, spark.createDataFrame([("u", "t")], "url string, title string")).collect()
    assert (b.tool, b.runs, b.successes, b.avg_latency, b.p95_latency, b.avg_bytes, b.avg_links, b.title_match_rate, b.content_rate, b.links_rate, b.n_errors) == ("b", 3, 2, 1.5, 2.85, 7, 1.5, 1.0, 1.0, 0.5, 1)
    assert (a.avg_latency, a.p95_latency, a.avg_bytes, a.avg_links, a.title_match_rate, a.n_errors) == (None, None, 0, 0.0, None, 1)
    assert sorted(map(tuple, benchmark.run_errors(runs).collect())) == [("a", 4, "no"), ("b", 3, "late")]


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


#: Queries that SQL can't express; each has a test below.
CHECKED_BY_HAND = ("fit_markdown", "main_text", "scrape_pages")


def test_texts_and_markdown_are_those_of_each_page_alone(spark, small):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = catalog.QUERIES["main_text"](spark, small).collect()
    assert len(got) == len(html)
    for r in got:
        root = extract.parse(html[r["page_id"]])
        assert (r["main_text"], r["full_text"]) == (extract.main_text(root), extract.to_text(root)) and r["full_text"]
    got = catalog.QUERIES["fit_markdown"](spark, small).collect()
    assert len(got) == len(html) * len(extract.PROFILES)
    for r in got:
        assert (r["raw_markdown"], r["fit_markdown"], r["fit_html"]) == extract.fit_markdown(html[r["page_id"]], *extract.PROFILES[r["profile"]])


def test_answers_of_all_formats(spark, small):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = {r["request_id"]: r for r in catalog.QUERIES["scrape_pages"](spark, small).collect()}
    assert set(got) == set(html)
    for i, r in got.items():
        h = html[i]
        if r["page"] is None:
            assert r["content"] is None and r["signals"]["fallback_reason"] == "http_unsupported_content_type"
            continue
        root = extract.parse(h)
        main, full = extract.main_text(root), extract.to_text(root)
        md = extract.fit_markdown(h, *extract.PROFILES["docs"])
        want = (h, full if len(main.split()) < 40 else main, md[1][:4000])[i % 3]
        assert r["content"] == want == r["page"]["content"] and r["page"]["bytes"] == len(h.encode())
        assert (r["markdown"] is not None) == (i % 3 == 2) and (r["markdown"] is None or r["markdown"]["raw_markdown"] == md[0][:4000])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    if name not in catalog.ORACLE_SQL:
        assert name in CHECKED_BY_HAND
        return
    rel = duck.sql(catalog.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    want = sorted(repr([plain(dict(zip(rel.columns, r, strict=True))[c]) for c in cols]) for r in rel.fetchall())
    assert got == want


def test_answers_tell_of_whole_pages(spark, tmp_path):
    """Words, links, score and marks of a challenge count wherever they are in a page of some 700 kB."""
    early, late = "<meta>" * 117_000, "<p>Some words and <a href='/x'>a link</a> here.</p>" * 200
    body = f"<body><article>{late}{{0}}</article></body>"
    pages = [early + body.format(""), early + body.format("Access Denied"), body.format("<br>" * 175_000 + late), body.format("")]
    spark.createDataFrame([(i, f"http://h{i % 3}.org/{i}", f"<html>{pages[i % 4]}</html>") for i in range(12)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    df = catalog.QUERIES["scrape_metadata"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    rel = con.sql(catalog.ORACLE_SQL["scrape_metadata"])
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    assert got == sorted(repr([plain(dict(zip(rel.columns, r, strict=True))[c]) for c in cols]) for r in rel.fetchall())


@pytest.mark.parametrize("parsed", [False, True])
def test_signals_are_those_of_whole_pages(spark, parsed):
    html = "<html><head>" + "<meta>" * 200_000 + "<title>Late</title></head><body><article><h1>One</h1><pre>two</pre>" + "word " * 50 + "</article><p>captcha</p></body></html>"
    df = tables.fetches_from_pages(spark.createDataFrame([(1, "http://a.b/c", html)], "page_id long, url string, html string"))
    r = scrape.with_signals(df.withColumn("wait_for_selector", F.lit("article h1")), parsed=parsed, selector=F.col("wait_for_selector")).withColumn("has", scrape.X.contains_text("html", F.lit("ONE</h1>"))).first()
    x = r["signals"]
    assert (r["dom"]["title"], r["dom"]["has_selector"], r["has"], x["word_count"], x["heading_count"], x["code_block_count"], x["blocked_likelihood"]) == ("Late", True, True, 54, 1, 1, 0.85)
    assert x["char_count"] == len("LateOnetwo" + "word " * 50 + "captcha") and x["main_content_score"] > 0.12


def test_signals_reach_the_scan_pruned(spark, small):
    plan = catalog.QUERIES["host_extract"](spark, small)._jdf.queryExecution().toString()
    assert "html" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_pages_go_to_python_in_small_batches(spark):
    from pyspark.sql import functions as F

    from tessera.operators import scrape

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    pages = spark.sql("SELECT '<p>a b</p>' AS html, true AS supported, true AS include_content, true AS want_markdown, 9L AS max_content_chars, named_struct('pruning_threshold', 0.5D, 'pruning_type', 'fixed', 'min_word_threshold', 0L) AS fit")
    assert scrape.rendered(pages, F.col("fit"), F.lit("html")).count() == 1
    assert int(spark.conf.get(key)) <= 4 << 20
