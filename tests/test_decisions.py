"""URLs, proxies, types, errors and the fetch ladder at their boundaries."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import contract as C
from tessera.functions import proxies as P
from tessera.functions import urls as U
from tessera.operators import batch, ladder
from tessera.plans import requests as R
from tessera.sources import tables as T


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_hosts(spark):
    urls = ["http://User:p@Ex.COM:80/a", "https://a.b/c?d#e", "nothing", "ftp://x", "http:///y"]
    assert one(spark, *[U.host_key(F.lit(u)) for u in urls]) == ["ex.com", "a.b", "", "x", ""]


def test_target_urls(spark):
    got = one(spark, *[U.url_error(F.lit(u)) for u in ("http://a", "HTTPS://a", "ftp://a", "a/b", "http://")])
    assert got == [None, None, "url must use http or https", "url must be a valid absolute URL", "url must be a valid absolute URL"]


def test_urls_match_but_for_slashes(spark):
    assert one(spark, U.urls_match(F.lit("a//"), F.lit("a")), U.urls_match(F.lit("a/b"), F.lit("a"))) == [True, False]


@pytest.mark.parametrize(
    ("line", "proxy", "error"),
    [
        ("", None, None), ("  # c", None, None), ("1.2.3.4:80", "http://1.2.3.4:80", None), ("h:1:u:p", "http://u:p@h:1", None), ("h::u:p", None, "proxy entries must include host and port"),
        ("host", None, "proxy entries must include host:port"), ("socks5h://h:1", "socks5h://h:1", None), ("ftp://h:1", None, P.BAD_SCHEME), ("u:p@h:1", "http://u:p@h:1", None),
    ],
)
def test_proxy_lines(spark, line, proxy, error):
    assert tuple(spark.range(1).select(P.normalize_proxy(F.lit(line)).alias("p")).first()["p"]) == (proxy, error)


def test_default_scheme_of_proxies(spark):
    assert one(spark, P.normalize_proxy(F.lit("h:1"), "socks5")["proxy"], P.normalize_proxy(F.lit("h:1"), "gopher")["proxy"]) == ["socks5://h:1", "http://h:1"]


def test_bench_proxies(spark):
    lines = ["h:1", "h:1:u:p", "u:p@h:1", "u:p@h", "h", "a:b:c", "http://x", "#"]
    assert one(spark, *[P.bench_proxy(F.lit(x)) for x in lines]) == ["http://h:1", "http://u:p@h:1", "http://u:p@h:1", None, None, None, "http://x", None]


def test_rotation_goes_round(spark):
    pool = F.array(*map(F.lit, "abc"))
    assert one(spark, P.rotated(pool, F.lit(2), 2), P.rotated(pool, F.lit(4), 9), P.rotated(F.array().cast("array<string>"), F.lit(0), 3)) == [["c", "a"], ["b", "c", "a"], None]


def test_proxy_files(spark, tmp_path):
    p = tmp_path / "p.txt"
    p.write_text("# x\nh1:1\nbad\n\nh2:2\r\nh3:3\n")
    assert [r["proxy"] for r in T.proxy_file(spark, str(p), 2).collect()] == ["http://h1:1", "http://h2:2"]
    assert T.proxy_file(spark, str(tmp_path / "none"), 2).count() == 0
    both = T.bench_proxy_list([T.numbered_lines(spark, str(p)), T.numbered_lines(spark, str(p))], 10)
    assert [r["proxy"] for r in both.collect()] == ["http://h1:1", "http://h2:2", "http://h3:3"]


def test_clamp_lets_the_maximum_win(spark):
    assert one(spark, R.clamp(F.lit(5), 9, 3), R.clamp(F.lit(-1), 0, 6), R.clamp(F.lit(7), 0, 6)) == [3, 0, 6]


def test_plans_take_defaults_for_missing_columns(spark):
    df = spark.createDataFrame([(0, "http://a"), (1, "x")], "index long, url string")
    a, b = R.scrape_plan(df, ["p1", "p2"]).orderBy("index").collect()
    assert (a.request_timeout_secs, a.crawl_timeout_secs, a.max_content_chars, a.crawl_mode, a.response_format, a.want_markdown, a.require_substantive) == (10, 30, 4000, "http", "text", False, True)
    assert a.headers.referer == "https://www.google.com/" and a.proxies == ["p1", "p2"] and a.error is None and b.error is not None
    c = R.single_page(R.crawl_plan(df)).orderBy("index").first()
    assert (c.max_depth, c.max_pages, c.crawl_concurrency, c.subdomains, c.return_page_links) == (0, 1, 1, False, True)


def test_profiles_count_only_with_default_options(spark):
    o = lambda t, w, p: R.fit_options(F.lit(t), F.lit("fixed"), F.lit(w), F.lit(p))
    got = [tuple(x) for x in one(spark, o(0.48, 5, "docs"), o(0.5, 5, "docs"), o(0.48, 5, "balanced"), o(0.48, 5, None), o(0.48, None, "docs"))]
    assert got == [(0.32, "dynamic", 3), (0.5, "fixed", 5), (0.48, "fixed", 5), (0.48, "fixed", 5), (0.48, "fixed", None)]


@pytest.mark.parametrize(
    ("header", "kind", "ok"),
    [
        (None, "", True), ("Text/HTML; x=1", "text/html", True), ("application/pdf", "application/pdf", False), ("image/svg+xml", "image/svg+xml", False), ("application/json", "application/json", True), ("application/rss+xml", "application/rss+xml", True),
        ("font/woff", "font/woff", False), ("application/octet-stream ", "application/octet-stream", False), ("video/mp4", "video/mp4", False), ("weird", "weird", True),
    ],
)
def test_content_types(spark, header, kind, ok):
    c = C.content_type(F.lit(header).cast("string"))
    assert one(spark, c, C.type_supported(c)) == [kind, ok]


def test_retry_statuses(spark):
    s = [200, 404, 403, 410, 429, 451, 499, 500, 503, 599]
    assert one(spark, *[C.retry_status(F.lit(x)) for x in s]) == [False, False, True, True, True, True, False, True, True, True]


@pytest.mark.parametrize(("size", "words", "weak"), [(511, 40, True), (512, 40, False), (512, 39, True)])
def test_weak_fetches(spark, size, words, weak):
    t = F.lit(True)
    assert one(spark, C.weak_fetch(t, F.lit(200), F.lit("x" * size), F.lit(words), F.lit(False), t)) == [weak]
    assert one(spark, C.weak_fetch(t, F.lit(200), F.lit("x" * size), F.lit(words), F.lit(False), F.lit(False))) == [False]


@pytest.mark.parametrize(
    ("status", "words", "score", "links", "reason"),
    [(200, 149, 0.9, 0, "http_low_words"), (200, 150, 0.449, 0, "http_low_main_score"), (200, 150, 0.45, 900, None), (200, 150, 0.45, 901, "http_low_density"), (404, 0, 0.0, 0, None), (403, 0, 0.0, 0, "http_bad_status"), (500, 0, 0.0, 0, "http_bad_status")],
)
def test_auto_fallback(spark, status, words, score, links, reason):
    f, t = F.lit(False), F.lit(True)
    assert one(spark, C.auto_fallback(t, F.lit(status), C.blocked_statuses(None), F.lit("x"), F.lit(words), f, t, f, f, F.lit(score), F.lit(links))) == [reason]


def test_batches(spark):
    assert one(spark, batch.batch_error(0), batch.batch_error(64), batch.batch_error(65)) == ["requests must contain at least one item", None, "batch size exceeds configured maximum: 64"]
    df = spark.createDataFrame([(i, "http://a/" if i % 2 else "bad") for i in range(10)], "index long, url string")
    got = {r["index"]: (r["host"], r["wave"]) for r in batch.waves(df).collect()}
    assert got[9] == ("a", 2) and got[8] == ("", 2) and got[0] == ("", 1)


RUNG = "struct<page_id: long, weak: boolean, auto_reason: string, http_reason: string>"


def climb(spark, mode, score, *rungs):
    rows = [(mode, score, *[(None if r is None else (k, r == "weak", "http_low_words" if r != "strong" else None, "http_low_words")) for k, r in enumerate(rungs)])]
    r = ladder.climb(spark.createDataFrame(rows, "mode string, host_score int, " + ", ".join(f"r{k}: {RUNG}" for k in range(5)))).first()
    return (None if r.chosen is None else r.chosen.page_id, r.used_browser, r.reason, r.mode_used, r.failed)


def test_ladder_facts(spark):
    w, s = "weak", "strong"
    # a weaker later rung replaces; the forced browser stays told of
    assert climb(spark, "auto", 3, w, s, None, None, None) == (1, True, "http_blocked", "browser", False)
    # a page that is strong on its rung but thin for auto asks for a browser again
    assert climb(spark, "auto", 3, "thin", None, None, None, s) == (4, True, "http_low_words", "browser", False)
    # no browser answer keeps the page and tells no reason
    assert climb(spark, "http", 0, None, w, w, w, None) == (3, False, "none", "http", True)
    assert climb(spark, "http", 0, None, w, w, w, s) == (4, True, "http_low_words", "http", False)
    # a missing later page leaves nothing
    assert climb(spark, "http", 0, None, w, None, None, None) == (None, False, "none", "http", True)
    # browser mode uses no memory, and is told even without a page
    assert climb(spark, "browser", 8, s, s, s, s, None) == (None, True, "none", "browser", True)
    assert climb(spark, "auto", 2, s, w, s, None, s) == (2, False, "none", "auto", False)


def test_json_sink_keeps_asked_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert T.as_json(df).first()[0] == '{"a":1}' and T.as_json(df, ("b",)).first()[0] == '{"a":1,"b":null}'


def test_batch_bodies_are_decoded(spark):
    df = spark.createDataFrame([('{"requests":[{"url":"http://a","extra":1},{"url":"b","max_content_chars":5}]}',)], "body string")
    got = T.decode_requests(df).select("index", "url", "max_content_chars").collect()
    assert [tuple(r) for r in got] == [(0, "http://a", None), (1, "b", 5)]


def test_settings_that_cant_be_read_are_the_default(spark):
    spark.conf.set("tessera.n", "x")
    spark.conf.set("tessera.m", "7")
    assert [T.conf(spark, "n", 4, "long"), T.conf(spark, "m", 4, "long"), T.conf(spark, "none", 4, "long")] == [4, 7, 4]
