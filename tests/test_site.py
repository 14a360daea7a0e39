"""URLs and links, crawls over links, request options, site rules, reports and the SQL surface."""

from urllib.parse import urldefrag, urljoin

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import extract, sql, urls
from tessera.operators import benchmark, crawl, links, rules, scrape
from tessera.plans import requests as plans
from tessera.sources import buckets, tables

BASE = "http://a.org/b/c/d;p?q"
REFERENCES = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g?y/./x", "g#s/../x", "https://x.net/a/../b", "a:b/c", "/a//b"]


def test_references_are_resolved(spark):
    got = spark.createDataFrame([(r,) for r in REFERENCES], "r string").select("r", urls.resolved(F.lit(BASE), "r").alias("u")).collect()
    for r, u in got:
        want = urldefrag(urljoin(BASE, r))[0].replace("/a/../b", "/b")
        if not r.startswith("a:"):
            want += "" if want.count("/") > 2 else "/"
        assert u == (None if r.startswith("a:") else want), r


@pytest.mark.parametrize(
    ("base", "ref", "want"),
    [
        ("HTTP://U:p@EXAMPLE.com:80/x", "", "http://example.com/x"), ("https://e.com:443", "", "https://e.com/"), ("https://e.com:8443/a?b=1", "#f", "https://e.com:8443/a?b=1"), ("http://e.com/a", " \n/b\tc ", "http://e.com/bc"),
        ("http://e.com/a", "mailto:x@y", None), ("http://e.com/a", "javascript:void(0)", None), ("no url", "x", None), (None, "x", None), ("http://e.com", None, None), ("http://e.com/a", "http://", None), ("http://e.com", "x", "http://e.com/x"), ("http://e.com/ä/b", "../ö", "http://e.com/ö"),
    ],
)
def test_hosts_ports_and_what_is_no_page(spark, base, ref, want):
    assert spark.createDataFrame([(base, ref)], "b string, r string").select(urls.resolved("b", "r")).first()[0] == want


def test_tracking_goes_and_keys_are_equal(spark):
    df = spark.createDataFrame([("http://e.com/a?utm_source=x&b=1&gclid=2&UTM_x=3&c#f",), ("http://e.com/a?fbclid=1",), ("http://e.com/a?refer=1&ref",), ("http://e.com/a",), (None,)], "u string")
    assert [r[0] for r in df.select(urls.without_tracking("u")).collect()] == ["http://e.com/a?b=1&c#f", "http://e.com/a", "http://e.com/a?refer=1", "http://e.com/a", None]
    same = ["http://E.com/a/?utm_x=1#f", "https://e.com:443/a", "http://e.com/./a//"]
    assert {r[0] for r in spark.createDataFrame([(u,) for u in same], "u string").select(urls.page_key("u")).collect()} == {"e.com/a"}


PAGE = """<html><head><base href='/docs/'></head><body><!-- <a href="/no">x</a> --><script>'<a href="/no2">'</script>
<a href="one">1</a><A CLASS="b" HREF = 'two?a=1&amp;b=2#f'>2</A><a data-href="/no3" href=/three>3</a><a name="x">-</a><a href="one">again</a><a href="tel:1">t</a><a href="">self</a></body></html>"""


def test_links_of_pages(spark):
    rows = [(1, "http://h.org/x/y", PAGE), (2, "http://h.org/docs/one?utm_source=a", "<a href='//h.org/docs/two?a=1&b=2'>"), (3, "https://h.org/docs/two?a=1&b=2", None), (4, "http://h.org/docs/one/", "<p>none"), (5, None, PAGE), (6, "no url", "<a href='x'>"), (1, "http://h.org/x/y", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["link"]) for r in links.page_links(df).collect())
    assert got == [(1, "http://h.org/docs/"), (1, "http://h.org/docs/one"), (1, "http://h.org/docs/two?a=1&b=2"), (1, "http://h.org/three"), (2, "http://h.org/docs/two?a=1&b=2")]
    assert sorted(tuple(r) for r in links.page_edges(df).collect()) == [(1, 2), (1, 3), (2, 3)]
    assert links.page_edges(df.where("false")).count() == 0
    walked = crawl.crawl(spark.createDataFrame([(1, 1)], "seed long, page long"), tables.cut(links.page_edges(df)), 3, 9).collect()
    assert sorted((r["page"], r["depth"]) for r in walked) == [(1, 0), (2, 1), (3, 1)]


REQUEST = "index long, url string, response_format string, include_content boolean, include_markdown boolean, extraction_profile string, fit_markdown struct<pruning_threshold: double, pruning_type: string, min_word_threshold: long>"
ASKED = [
    (0, "http://a.org", "markdown", True, True, "docs", None), (1, "http://a.org", "markdown", True, True, "docs", (0.48, "fixed", 5)), (2, "http://a.org", "markdown", True, True, "docs", (0.9, None, 300)),
    (3, "http://a.org", "markdown", True, True, "docs", (None, "Dynamic", 0)), (4, "http://a.org", "markdown", True, True, None, (None, None, None)),
]
OPTIONS = {0: (0.32, "dynamic", 3), 1: (0.32, "dynamic", 3), 2: (0.9, "fixed", 300), 3: (0.48, "dynamic", 0), 4: (0.48, "fixed", 5)}


def test_a_request_has_its_own_options(spark):
    page = {"url": "http://a.org", "html": f"<html><body><article><h1>Two words</h1><p>{'long text of words ' * 40}</p><p>tiny one</p><div><span>{'more text of words ' * 30}</span></div></article></body></html>"}
    asked = spark.createDataFrame(ASKED, REQUEST)
    fetch = spark.createDataFrame([(i, page["url"], page["html"]) for i in OPTIONS], "page_id long, url string, html string")
    got = {r["request_id"]: r["markdown"] for r in scrape.scrape(tables.fetches_from_pages(fetch), plans.scrape_plan(asked)).collect()}
    for i, (t, kind, words) in OPTIONS.items():
        raw, fit, html = extract.fit_markdown(page["html"], t, kind, words)
        assert (got[i]["raw_markdown"], got[i]["fit_markdown"], got[i]["fit_html"]) == (raw[:4000], fit[:4000], html[:4000])
    assert len({r["fit_html"] for r in got.values()}) > 1
    crawled = spark.createDataFrame([(i, 0, 1) for i in OPTIONS] + [(2, 0, 2)], "seed long, page long, place long")
    one = spark.createDataFrame([(0, page["url"], page["html"])], "page_id long, url string, html string")
    told = {(r["seed"], r["place"]): r["page"] for r in crawl.crawl_pages(crawled, tables.fetches_from_pages(one), plans.crawl_plan(asked)).collect()}
    assert len(told) == 6
    for (i, _), p in told.items():  # a profile counts for nothing here
        t, kind, words = (0.48, "fixed", 5) if i < 2 else OPTIONS[i]
        assert p["markdown"]["fit_markdown"] == extract.fit_markdown(page["html"], t, kind, words)[1][:4000] and p["content"] == page["html"]


def test_whole_answers_of_crawls(spark):
    plan = plans.crawl_plan(spark.createDataFrame([(1, "http://b"), (0, "bad"), (2, "http://c")], "index long, url string"))
    shown = spark.createDataFrame([(1, 2, ("u2",)), (1, 1, ("u1",))], "seed long, place long, page struct<url: string>")
    counts = spark.createDataFrame([(1, 2, 7), (2, 0, 0)], "seed long, pages_fetched long, unique_links_seen long")
    got = crawl.crawl_answers(plan, shown, counts, spark.createDataFrame([(1, 55)], "seed long, ms long")).collect()
    assert [(r["index"], r["root_url"], r["crawl_duration_ms"], r["pages_fetched"], r["unique_links_seen"], r["pages"] and [p["url"] for p in r["pages"]]) for r in got] == [(0, None, None, None, None, None), (1, "http://b", 55, 2, 7, ["u1", "u2"]), (2, "http://c", 0, 0, 0, [])]


def test_the_most_particular_rule_holds(spark):
    made = [("a", "Example.com", None, 1), ("b", "docs.example.com", "/api", 2), ("c", "docs.example.com", "/api/v1/", 3), ("d", None, "/api", 4), ("e2", "x.org", "", 5), ("e1", "x.org", "/", 6), ("f", "ample.com", "", 7)]
    df = spark.createDataFrame(made, "rule_id string, domain string, path_prefix string, n int")
    want = {"http://docs.example.com/api/v1/x": "c", "http://docs.example.com/api/v1": "c", "http://docs.example.com/api/v10": "b", "http://docs.example.com/apis": "a", "http://www.DOCS.example.com:81/api?x": "b", "http://example.com": "a", "http://other.net/api/x": "d", "http://other.net/x": None, "http://x.org/api": "e1", "no url": None, "http://notexample.com/": None}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*want, None])], "page_id long, url string")
    got = {r["url"]: r["rule_id"] for r in rules.match_rules(pages.unionByName(pages), df).collect()}
    assert got == want | {None: None}
    assert rules.match_rules(pages, df).count() == len(want) + 1 and rules.match_rules(pages, df.where("false")).where("n is null").count() == len(want) + 1
    assert rules.match_rules(pages.where("false"), df).count() == 0


RUNS = "run_id long, ts timestamp, tool string, url string, iteration long, ok boolean, duration_s double, used_browser boolean, content_hash string"


def test_reports_of_several_levels_and_sketches(spark):
    rows = [(i, None if i == 7 else f"2024-01-0{1 + i % 5} 00:00:00", "t" if i % 2 else None, f"u{i % 3}", i % 2, i % 4 != 0, float(i), i % 3 == 0, f"h{i % 3}" if i != 9 else "other") for i in range(1, 60)]
    df = spark.createDataFrame([(r[0], None, *r[2:]) for r in rows], RUNS).withColumn("ts", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(run_id % 5 as int))"))
    total = benchmark.rolled_up(df).where("level = 7").collect()
    assert [(r["runs"], r["successes"]) for r in total] == [(59, sum(r[5] for r in rows))]
    assert {(r["tool"], r["runs"]) for r in benchmark.rolled_up(df).where("level = 3").collect()} == {("t", 30), (None, 29)}
    days = tables.cut(benchmark.daily_sketches(df))
    got = {r["tool"]: r for r in benchmark.sketched_summary(days).collect()}
    ok = sorted(r[6] for r in rows if r[2] == "t" and r[5])
    assert got["t"]["runs"] == 30 and got["t"]["urls"] == 3 and got["t"]["median_latency"] in ok[len(ok) // 2 - 1 : len(ok) // 2 + 1] and got["t"]["fallback_rate"] == pytest.approx(sum(r[7] for r in rows if r[2] == "t") / 30)
    import datetime as dt

    some = {r["tool"]: r["runs"] for r in benchmark.sketched_summary(days, dt.date(2024, 1, 2), dt.date(2024, 1, 3)).collect()}
    assert sum(some.values()) == sum(r[0] % 5 in (1, 2) for r in rows)
    assert {r["tool"]: (r["urls"], r["stable_urls"]) for r in benchmark.stability(df).collect()}["t"] == (3, 2)
    none = df.where("not ok")
    assert all(r["median_latency"] is None for r in benchmark.sketched_summary(benchmark.daily_sketches(none)).collect())
    assert benchmark.rolled_up(df.where("false")).count() == 0 and benchmark.stability(df.where("false")).count() == 0


def test_percentile_beyond_the_rows_that_are_ranked(spark, monkeypatch):
    import statistics

    monkeypatch.setattr(benchmark, "RANKED", 50)
    values = {"a": [float(i * 7919 % 5003) for i in range(3000)], "b": [1.0] * 400 + [9.0] * 3, "c": [5.0], None: [float(i) for i in range(60)], "d": [3.0, 1.0]}
    df = spark.createDataFrame([(t, v, True) for t, own in values.items() for v in own] + [("a", None, True), ("z", 1.0, False)], "tool string, duration_s double, ok boolean")
    got = {r["tool"]: r["p95_latency"] for r in benchmark.p95_latency(df).collect()}
    assert got == {t: pytest.approx(statistics.quantiles(v, n=20)[-1] if len(v) > 1 else v[0]) for t, v in values.items()}


def test_functions_in_sql(spark):
    names = sql.register(spark, "p_")
    assert "p_host_key" in names and "p_climb_ladder" in names
    row = spark.sql("SELECT p_host_key('HTTP://U@Ex.org:1/x'), p_retry_status(429), p_retry_status(200), p_urls_match('a/', 'a'), p_url_error('ftp://x'), p_content_type('Text/HTML; x'), p_visible_word_count('<p>two words</p>'), p_weak_fetch(true, 200, 'x', 1L, false, true)").first()
    assert tuple(row) == ("ex.org", True, False, True, "url must use http or https", "text/html", 2, True)
    plan = spark.sql("SELECT p_host_key(url) AS h FROM VALUES ('http://a.b/') AS t(url)")._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan


def test_the_ladder_without_attempts_that_gave_anything(spark):
    sql.register(spark, "p_")
    spark.createDataFrame([(1, "http", 0, 1, None, None, None, None), (2, "auto", 5, 0, 20, False, None, None), (3, "browser", 0, 4, 34, None, None, None)], "request_id long, mode string, host_score int, rung int, page_id long, weak boolean, auto_reason string, http_reason string").createOrReplaceTempView("attempts")
    got = [tuple(r) for r in spark.sql("SELECT t.* FROM p_climb_ladder(TABLE(attempts) PARTITION BY request_id ORDER BY rung) t ORDER BY 1").collect()]
    assert got == [(1, None, False, "none", "http", True), (2, 20, True, "http_blocked", "browser", False), (3, 34, True, "none", "browser", True)]


def test_buckets_need_no_exchange(spark, small):
    fetches = tables.fetches_from_pages(spark.read.parquet(f"{small}/pages.parquet"))
    buckets.write_by_host(fetches, "fetches_by_host", 4)
    got = buckets.read_by_host(spark, "fetches_by_host")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sums = got.groupBy("host").agg(F.count("*").alias("n"))
        assert "Exchange" not in sums._jdf.queryExecution().executedPlan().toString()
        scores = spark.createDataFrame([("none", 3)], "host string, score int")
        joined = got.join(scores.repartition(4, "host"), "host", "left")._jdf.queryExecution().executedPlan().toString()
        assert joined.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in joined
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = {r["host"]: r["count"] for r in fetches.groupBy(urls.host_key("url").alias("host")).count().collect()}
    assert {r["host"]: r["n"] for r in sums.collect()} == want
    spark.sql("DROP TABLE fetches_by_host")


def test_scratch_tables_can_be_deleted(spark):
    df = tables.cut(spark.range(5))
    assert df.count() == 5 and df._tessera_path in tables.scratch
    tables.delete_scratch(df._tessera_path)
    assert df._tessera_path not in tables.scratch
    with pytest.raises(Exception, match="(?i)not.*exist|FILE_NOT_EXIST|not found"):
        spark.read.parquet(df._tessera_path).count()


def test_every_query_has_sql_or_a_test_by_hand():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"fit_markdown", "main_text", "scrape_pages"} and duckdb.sql("SELECT 1 AS x").fetchall() == [(1,)]


def test_links_are_made_once_a_page(spark):
    """A page's markup is made in one place of the plan: neither again for each of its links nor for filters."""
    df = spark.createDataFrame([(1, "http://a.b/x", '<base href="/q/"><a href="y">1</a><a href="mailto:x@y.z">2</a><a href="y">3</a>'), (2, "http://a.b/q/y", "none"), (3, "http://a.b/z", None), (1, "http://a.b/x", '<a href="/q/y">1</a>')], "page_id long, url string, html string")
    for made, want in ((links.page_links(df), [(1, "http://a.b/q/y")]), (links.page_edges(df), [(1, 2)])):
        assert sorted(tuple(r) for r in made.collect()) == want
        assert made._jdf.queryExecution().optimizedPlan().toString().count("<!--") == 1


def test_equal_pages_of_a_request_are_told_once(spark):
    """What attempts are told by is that of their own html, though equal ones of a request are read once; signals that nobody reads aren't computed."""
    html = ["<body><article>" + "word " * 60 + "<a href='x'>y</a></article></body>", "  <p>Access Denied</p> ", "<p>a b c</p>", None]
    rows = [(r, k, html[h]) for r, hs in ((1, (0, 0, 1, 0, 3)), (2, (1, 1, 2)), (3, (3, 3)), (4, (2, 0, 2, 1))) for k, h in enumerate(hs)]
    df = tables.fetches_from_pages(spark.createDataFrame(rows, "page_id long, attempt int, html string").withColumn("url", F.lit("http://a.b/c"))).drop("attempt", "html")
    own = spark.createDataFrame(rows, "request_id long, attempt int, html string")
    df = own.join(df.dropDuplicates(["request_id"]), "request_id").withColumn("wait_for_selector", F.when(F.col("request_id") == 1, "article a"))
    told = scrape.told_pages(df)
    got = {(r["request_id"], r["attempt"]): r for r in told.collect()}
    want = scrape.with_signals(df, selector=F.col("wait_for_selector")).withColumn("words", scrape.X.visible_word_count(scrape.C.trim_space(F.col("html")))).collect()
    assert len(got) == len(want) == len(rows)
    for r in want:
        g = got[r["request_id"], r["attempt"]]
        assert g["html"] == r["html"] and g["supported"] == r["supported"]
        if r["html"] is not None:
            assert (g["word_count"], g["challenge"], g["main_score"], g["counted_links"], g["has_selector"], g["words"]) == (r["word_count"], r["challenge"], r["dom"]["main_score"], r["dom"]["link_count"], r["dom"]["has_selector"], r["words"])
    plan = scrape.with_signals(df).select("signals.link_count")._jdf.queryExecution().optimizedPlan().toString()
    assert "captcha" not in plan and "<body" not in plan
