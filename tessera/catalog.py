"""The registered queries of the page engine and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import contract as C
from .functions import proxies as P
from .functions import text as X
from .functions import urls as U
from .operators import admission, batch, benchmark, crawl, dom, hosts, ladder, links, metrics
from .operators import scrape as S
from .operators.order import numbered
from .plans import requests as R
from .sources.tables import bench_proxy_list, decode_requests, fetches_from_pages, read_table, spread, target_list

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


STATUSES = (200, 200, 200, 301, 404, 403, 410, 429, 500, 503)
TYPES = ("text/html; charset=utf-8", "TEXT/PLAIN", "application/pdf", "image/svg+xml", "application/json", "", "application/rss+xml", "text/markdown ;x=1", "video/mp4", "application/octet-stream")
ERRORS = ("dns error: no record", "TLS handshake failed", "operation timed out", "connection reset", "failed to lookup address", "bad certificate", "Timeout while reading", "Name or service not known")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages")


def pick(values, key: str = "page_id", step: int = 1):
    """One of a few values, by key."""
    a = F.array(*map(F.lit, values))
    return F.element_at(a, (F.floor(F.col(key) / step) % len(values) + 1).cast("int"))


def sql_pick(values, key: str = "page_id", step: int = 1) -> str:
    inner = ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{inner}][CAST({key} // {step} AS BIGINT) % {len(values)} + 1]"


STATUS_SQL = sql_pick(STATUSES)
WS = r"[\s\x0B\x{85}\p{Z}]"
LOWER_SQL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = r"CAST(len(regexp_extract_all(regexp_replace(html, '(?is)<[ \t\n\f\r]*script.*?</script>|<[ \t\n\f\r]*style.*?</style>|<[^>]*(?:>|\z)', ' ', 'g'), '[^ \t\n\f\r]+')) AS BIGINT)"
PLAIN_SQL = rf"regexp_replace(regexp_replace(html, '(?s)<[^>]*(?:>|\z)', '', 'g'), '{WS}+', ' ', 'g')"
CHALLENGE_SQL = "regexp_matches(html, '(?i)" + "|".join(m.replace("!", "[!]") for m in X.CHALLENGE_MARKERS) + "')"
UNESCAPE_SQL = "replace(replace(replace(replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', chr(160)), '&amp;', '&')"
TEXT_SQL = UNESCAPE_SQL.format(r"array_to_string(list_filter(string_split_regex(regexp_extract(html, '(?is)<body[^>]*>(.*)\z', 1), '<[^>]*>'), lambda x: x <> ''), ' ')")
SCORE_SQL = rf"""least(1.0, greatest(0.0, 0.75 * least(1.0, strlen(body_text) / greatest(strlen(html), 1)::DOUBLE)
    + 0.2 * least(greatest(len(regexp_extract_all(body_text, '[^\s\x0B\x{{85}}\p{{Z}}]+')), 1), 800) / 800.0
    + CASE WHEN regexp_matches(html, '(?i)<(article|main)[^a-z]') THEN 0.12 ELSE 0.0 END))"""
LINKS_SQL = r"CAST(len(regexp_extract_all(html, '(?i)<a\b[^>]*\shref\s*=')) AS BIGINT)"
HOST_SQL = LOWER_SQL.format(r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)")


def _fetches(spark, sf_dir) -> DataFrame:
    """Pages as fetches whose status and type follow from their number, so that all rules are met."""
    return fetches_from_pages(spread(pages(spark, sf_dir)), pick(STATUSES), pick(TYPES, step=10))


@query(f"""
WITH a AS (SELECT page_id, html, {PLAIN_SQL} AS plain, {WORDS_SQL} AS word_count FROM pages),
b AS (SELECT *, list_filter(string_split({LOWER_SQL.format("plain")}, ' '), lambda x: x <> '') AS w,
  strlen(html) - strlen(replace(html, '<', '')) AS tags, left(plain, 4000) AS sample FROM a)
SELECT page_id, word_count, CAST(length(plain) AS BIGINT) AS char_count,
  round(CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_distinct(w)) / len(w)::DOUBLE END, 6) AS unique_word_ratio,
  round(least(1.0, 0.7 * least(1.0, tags / greatest(strlen(html), 1)::DOUBLE) + CASE WHEN word_count < 80 THEN 0.35 ELSE 0.0 END), 6) AS boilerplate_ratio,
  round(least(1.0, strlen(plain) / greatest(strlen(html), 1)::DOUBLE), 6) AS content_density,
  CASE WHEN length(sample) = 0 THEN NULL WHEN 4 * length(regexp_replace(sample, '[A-Za-z0-9{WS[1:-1]}]', '', 'g')) > length(sample) THEN 'und' ELSE 'en' END AS language
FROM b""")
def page_signals(spark, sf_dir):
    """Words, characters, ratios, density and language of every page, all native."""
    d = S.native_signals(spread(pages(spark, sf_dir)))
    return d.select("page_id", "word_count", "char_count", *[F.round(c, 6).alias(c) for c in ("unique_word_ratio", "boilerplate_ratio", "content_density")], "language")


@query(f"SELECT page_id, {WORDS_SQL} AS word_count FROM pages")
def visible_word_count(spark, sf_dir):
    return spread(pages(spark, sf_dir)).select("page_id", X.visible_word_count("html").alias("word_count"))


@query(f"SELECT page_id, CAST(length({PLAIN_SQL}) AS BIGINT) AS char_count, md5({PLAIN_SQL}) AS plain_md5 FROM pages")
def plain_text_stats(spark, sf_dir):
    return spread(pages(spark, sf_dir)).select("page_id", F.length(X.plain_text("html")).cast("long").alias("char_count"), F.md5(X.plain_text("html").cast("binary")).alias("plain_md5"))


@query(f"""WITH f AS (SELECT page_id, page_id % 7 = 0 AS waf, {STATUS_SQL} AS status, {CHALLENGE_SQL.replace("html", "html || CASE WHEN page_id % 11 = 0 THEN ' Verify You Are A Human' ELSE '' END")} AS challenge FROM pages)
SELECT page_id, challenge, CASE WHEN waf OR challenge THEN 0.85 WHEN status IN (403, 429, 503, 407, 408, 409, 425, 451) THEN 0.75 WHEN status >= 500 THEN 0.55 ELSE 0.0 END::DOUBLE AS blocked_likelihood FROM f""")
def challenge_flags(spark, sf_dir):
    d = spread(pages(spark, sf_dir)).select("page_id", (F.col("page_id") % 7 == 0).alias("waf"), pick(STATUSES).alias("status"), X.challenge_hit(F.concat("html", F.when(F.col("page_id") % 11 == 0, " Verify You Are A Human").otherwise(""))).alias("challenge"))
    return d.select("page_id", "challenge", X.blocked_likelihood("status", "waf", "challenge").alias("blocked_likelihood"))


@query(f"SELECT page_id, contains({LOWER_SQL.format('html')}, 'the and') AS has_text, contains({LOWER_SQL.format('html')}, '<article') AS has_article FROM pages")
def required_text_filter(spark, sf_dir):
    d = spread(pages(spark, sf_dir))
    return d.select("page_id", X.contains_text("html", F.lit("The AND")).alias("has_text"), X.contains_text("html", F.lit("<ARTICLE")).alias("has_article"))


@query(f"SELECT page_id, {HOST_SQL} AS host FROM pages")
def host_extract(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.host_key("url").alias("host"))


BAD_URL = ("{url}", "ftp://x.org/a", "no url", "HTTP://User:pw@Example.COM:80/a?b#c", "http:///nohost", "mailto:a@b.c")
BAD_URL_SQL = "replace(" + sql_pick(BAD_URL) + ", '{url}', url)"


@query(f"""WITH u AS (SELECT page_id, {BAD_URL_SQL} AS url FROM pages),
s AS (SELECT *, {LOWER_SQL.format("regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)")} AS scheme FROM u)
SELECT page_id, url AS target, CASE WHEN scheme = '' THEN 'url must be a valid absolute URL' WHEN scheme NOT IN ('http', 'https') THEN 'url must use http or https'
 WHEN {HOST_SQL} = '' THEN 'url must be a valid absolute URL' END AS error FROM s""")
def url_validate(spark, sf_dir):
    d = pages(spark, sf_dir).select("page_id", F.replace(pick(BAD_URL), F.lit("{url}"), F.col("url")).alias("target"))
    return d.withColumn("error", U.url_error("target"))


@query("""SELECT page_id, rtrim(url || repeat('/', CAST(page_id % 3 AS INT)), '/') = rtrim(url, '/') AS same, rtrim(url || 'x', '/') = rtrim(url, '/') AS other FROM pages""")
def url_match(spark, sf_dir):
    longer = F.concat("url", F.expr("repeat('/', cast(page_id % 3 as int))"))
    return pages(spark, sf_dir).select("page_id", U.urls_match(longer, "url").alias("same"), U.urls_match(F.concat("url", F.lit("x")), "url").alias("other"))


PROXY_LINES = ("10.0.0.{n}:8080", " 10.0.0.{n}:8080:user:pw ", "socks5://h{n}:1", "# comment", "", "ftp://h{n}:2", "justhost{n}", "u:p@h{n}:90", "h{n}::u:p", "https://h{n}")
PROXY_SQL = "replace(" + sql_pick(PROXY_LINES, "s_suppkey") + ", '{n}', CAST(s_suppkey AS VARCHAR))"


def _proxy_lines(spark, sf_dir):
    return read_table(spark, sf_dir, "supplier").select("s_suppkey", F.replace(pick(PROXY_LINES, "s_suppkey"), F.lit("{n}"), F.col("s_suppkey").cast("string")).alias("line"))


PROXY_CASE = """WITH l AS (SELECT s_suppkey, trim({line}) AS v FROM supplier),
p AS (SELECT *, string_split(v, ':') AS p, regexp_matches(v, '^(http|https|socks5|socks5h)://') AS known FROM l),
q AS (SELECT *, v = '' OR v LIKE '#%' AS skip, len(p) = 4 AND NOT contains(v, '@') AS four FROM p),
r AS (SELECT *, four AND (trim(p[1]) = '' OR trim(p[2]) = '' OR trim(p[3]) = '' OR trim(p[4]) = '') AS blank FROM q),
o AS (SELECT s_suppkey, CASE WHEN skip THEN NULL WHEN known THEN v WHEN contains(v, '://') OR blank THEN NULL
 WHEN four THEN 'http://' || p[3] || ':' || p[4] || '@' || p[1] || ':' || p[2] WHEN contains(v, ':') THEN 'http://' || v END AS proxy,
 CASE WHEN skip OR known THEN NULL WHEN contains(v, '://') THEN 'proxy entries must use http://, https://, socks5://, or socks5h://'
 WHEN blank THEN 'proxy entries must include host and port' WHEN NOT contains(v, ':') THEN 'proxy entries must include host:port' END AS error FROM r)
""".replace("{line}", PROXY_SQL)


@query(PROXY_CASE + "SELECT s_suppkey, proxy, error FROM o")
def proxy_normalize(spark, sf_dir):
    return _proxy_lines(spark, sf_dir).withColumn("p", P.normalize_proxy("line")).select("s_suppkey", "p.proxy", "p.error")


@query(PROXY_CASE + "SELECT s_suppkey AS line_no, proxy FROM o WHERE proxy IS NOT NULL ORDER BY s_suppkey LIMIT 20")
def proxy_file_scan(spark, sf_dir):
    """The first twenty acceptable lines: a limit of the feature."""
    return P.accepted(_proxy_lines(spark, sf_dir).withColumnRenamed("s_suppkey", "line_no"), 20)


@query("""WITH r AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS cursor FROM pages), c AS (SELECT ['p0', 'p1', 'p2', 'p3', 'p4'] AS pool)
SELECT page_id, [pool[CAST((cursor + i) % 5 AS INT) + 1] FOR i IN [0, 1, 2]] AS proxies FROM r, c""")
def proxy_rotation(spark, sf_dir):
    pool = F.array(*[F.lit(f"p{i}") for i in range(5)])
    return numbered(pages(spark, sf_dir).select("page_id"), "place", "page_id").select("page_id", P.rotated(pool, F.col("place") - 1, 3).alias("proxies"))


@query("""WITH a AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN [' http://a:1 ', ''] WHEN 2 THEN ['http://a:1', 'a:2'] ELSE ['http://a:1', 'http://b:1', 'socks5://c:1'] END AS l FROM pages),
b AS (SELECT page_id, list_filter(list_transform(l, lambda x: trim(x)), lambda x: x <> '') AS own FROM a),
c AS (SELECT page_id, own, CASE WHEN len(list_filter(own, lambda x: NOT regexp_matches(x, '^(http|https|socks5|socks5h)://'))) > 0 THEN 'proxy entries must use http://, https://, socks5://, or socks5h://' WHEN len(own) > 2 THEN 'proxy list exceeds configured maximum: 2' END AS error FROM b)
SELECT page_id, CASE WHEN error IS NULL AND len(own) > 0 THEN own END AS proxies, error FROM c""")
def proxy_request_list(spark, sf_dir):
    k = F.col("page_id") % 4
    arr = lambda *x: F.array(*map(F.lit, x))
    own = F.when(k == 1, arr(" http://a:1 ", "")).when(k == 2, arr("http://a:1", "a:2")).when(k == 3, arr("http://a:1", "http://b:1", "socks5://c:1"))
    return pages(spark, sf_dir).select("page_id", P.request_proxies(own, 2).alias("p")).select("page_id", "p.proxies", "p.error")


def _requests(spark, sf_dir):
    """Requests whose options follow from the page's number."""
    i = F.col("page_id")
    return pages(spark, sf_dir).select(
        i.alias("index"), "url", F.when(i % 3 != 0, i * 7 % 90).alias("request_timeout_secs"), F.when(i % 4 != 0, i * 13 % 400).alias("crawl_timeout_secs"), F.when(i % 5 != 0, i * 997 % 150_000).alias("max_content_chars"),
        pick(("http", "auto", "browser"), "page_id").alias("crawl_mode"), pick(("html", "text", "markdown"), "page_id", 3).alias("response_format"), F.when(i % 2 == 0, i % 4 == 0).alias("include_content"), F.when(i % 6 == 0, True).alias("include_markdown"),
        pick(("off", "basic", "camoufox_like"), "page_id", 2).alias("anti_bot_profile"), F.lit("agent").alias("user_agent"), pick(("balanced", "docs", "article", "repo", "minimal"), "page_id").alias("extraction_profile"),
        F.when(i % 4 == 1, 0.5).otherwise(0.48).alias("pruning_threshold"),
    )


FORMAT_SQL = sql_pick(("html", "text", "markdown"), "page_id", 3)


@query(f"""SELECT page_id AS index, least(greatest(coalesce(CASE WHEN page_id % 3 <> 0 THEN page_id * 7 % 90 END, 10), 1), 60) AS request_timeout_secs,
 least(greatest(coalesce(CASE WHEN page_id % 4 <> 0 THEN page_id * 13 % 400 END, 30), 1), 300) AS crawl_timeout_secs,
 least(greatest(coalesce(CASE WHEN page_id % 5 <> 0 THEN page_id * 997 % 150000 END, 4000), 1), 100000) AS max_content_chars,
 {sql_pick(("http", "auto", "browser"))} AS crawl_mode, page_id % 6 = 0 OR {FORMAT_SQL} = 'markdown' AS want_markdown,
 coalesce(CASE WHEN page_id % 2 = 0 THEN page_id % 4 = 0 END, true) OR page_id % 6 = 0 OR {FORMAT_SQL} = 'markdown' AS require_substantive,
 {sql_pick(("off", "basic", "camoufox_like"), "page_id", 2)} <> 'off' AS modify_headers,
 CASE WHEN {sql_pick(("off", "basic", "camoufox_like"), "page_id", 2)} = 'camoufox_like' THEN '{R.CAMOUFOX_USER_AGENT}' ELSE 'agent' END AS user_agent FROM pages""")
def request_plan(spark, sf_dir):
    p = R.scrape_plan(_requests(spark, sf_dir))
    return p.select("index", "request_timeout_secs", "crawl_timeout_secs", "max_content_chars", "crawl_mode", "want_markdown", "require_substantive", "headers.modify_headers", "headers.user_agent")


@query("""SELECT page_id AS index, least(greatest(page_id % 11 - 2, 0), 6) AS max_depth, least(greatest(page_id * 101 % 9000, 1), 5000) AS max_pages, least(greatest(page_id * 17 % 400, 1), 256) AS crawl_concurrency,
 CAST(10 AS BIGINT) AS request_timeout_secs, CAST(30 AS BIGINT) AS crawl_timeout_secs, CAST(4000 AS BIGINT) AS max_content_chars, false AS include_content, CAST(20 AS BIGINT) AS min_links FROM pages""")
def crawl_request_plan(spark, sf_dir):
    i = F.col("page_id")
    r = pages(spark, sf_dir).select(i.alias("index"), "url", (i % 11 - 2).alias("max_depth"), (i * 101 % 9000).alias("max_pages"), (i * 17 % 400).alias("crawl_concurrency"))
    return R.crawl_plan(r).select("index", "max_depth", "max_pages", "crawl_concurrency", "request_timeout_secs", "crawl_timeout_secs", "max_content_chars", "include_content", "min_links")


@query(f"""WITH r AS (SELECT page_id, {sql_pick(("balanced", "docs", "article", "repo", "minimal"))} AS profile, CASE WHEN page_id % 4 = 1 THEN 0.5 ELSE 0.48 END AS t FROM pages),
d AS (SELECT *, t = 0.48 AND profile <> 'balanced' AS preset FROM r)
SELECT page_id AS index, (CASE WHEN preset THEN CASE profile WHEN 'docs' THEN 0.32 WHEN 'article' THEN 0.38 WHEN 'repo' THEN 0.36 ELSE 0.58 END ELSE t END)::DOUBLE AS pruning_threshold,
 CASE WHEN preset AND profile IN ('docs', 'article') THEN 'dynamic' ELSE 'fixed' END AS pruning_type,
 CAST(CASE WHEN preset THEN CASE profile WHEN 'docs' THEN 3 WHEN 'article' THEN 4 WHEN 'repo' THEN 3 ELSE 10 END ELSE 5 END AS BIGINT) AS min_word_threshold FROM d""")
def fit_option_plan(spark, sf_dir):
    o = R.fit_options(F.col("pruning_threshold"), F.lit("fixed"), F.lit(5), F.col("extraction_profile"))
    return _requests(spark, sf_dir).select("index", o.alias("o")).select("index", "o.*")


@query("""WITH r AS (SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN page_id % 50 - 5 END AS pt, page_id % 60 AS rt, page_id % 90 AS ct, CASE WHEN page_id % 4 = 1 THEN '#main' WHEN page_id % 4 = 2 THEN '' END AS sel, CASE WHEN page_id % 5 > 0 THEN page_id % 5 - 1 END AS st FROM pages)
SELECT page_id, CASE WHEN pt IS NULL THEN rt ELSE least(greatest(pt, 1), greatest(rt, 1)) END AS request_secs, CASE WHEN pt IS NULL THEN ct ELSE least(greatest(pt, 1), greatest(ct, 1)) END AS crawl_secs,
 CASE WHEN sel <> '' THEN greatest(coalesce(st, 30), 1) END AS selector_secs, CASE WHEN page_id % 7 = 3 THEN greatest(ct, 5) END AS idle_secs, CASE WHEN page_id % 7 = 4 THEN greatest(rt, 3) END AS almost_idle_secs,
 CASE WHEN page_id % 3 > 0 THEN page_id % 2 = 0 END AS block_javascript FROM r""")
def browser_plan(spark, sf_dir):
    i = F.col("page_id")
    d = pages(spark, sf_dir).select("page_id", F.when(i % 3 != 0, i % 50 - 5).alias("pt"), (i % 60).alias("rt"), (i % 90).alias("ct"), F.when(i % 4 == 1, "#main").when(i % 4 == 2, "").alias("sel"), F.when(i % 5 > 0, i % 5 - 1).alias("st"))
    rt, ct = R.browser_timeouts(F.col("rt"), F.col("ct"), F.col("pt"))
    null = F.lit(None)
    w = R.browser_waits(F.col("sel"), F.col("st"), null.cast("long"), F.when(i % 7 == 3, "NetworkIdle").when(i % 7 == 4, "load"), F.col("rt"), F.col("ct"), null.cast("int"), null.cast("int"), null.cast("boolean"))
    b = R.browser_intercept(pick(("http", "auto", "browser")), null.cast("boolean"), null.cast("boolean"), i % 2 == 1)
    return d.select("page_id", rt.alias("request_secs"), ct.alias("crawl_secs"), w.alias("w"), b.alias("b")).select("page_id", "request_secs", "crawl_secs", "w.selector_secs", "w.idle_secs", "w.almost_idle_secs", "b.block_javascript")


TYPE_SQL = "lower(trim(split_part(" + sql_pick(TYPES, "page_id", 10) + ", ';', 1)))"
SUPPORTED_SQL = "(content_type IN ('', 'text/html', 'application/xhtml+xml', 'text/plain', 'text/markdown', 'text/x-markdown') OR (contains(content_type, 'xml') AND (starts_with(content_type, 'text/') OR starts_with(content_type, 'application/'))) OR NOT (content_type IN ('application/pdf', 'application/octet-stream') OR regexp_matches(content_type, '^(image|video|audio|font)/')))"


@query(f"WITH t AS (SELECT page_id, {TYPE_SQL} AS content_type FROM pages) SELECT page_id, content_type, {SUPPORTED_SQL} AS supported FROM t")
def content_type_classify(spark, sf_dir):
    d = pages(spark, sf_dir).select("page_id", C.content_type(pick(TYPES, step=10)).alias("content_type"))
    return d.withColumn("supported", C.type_supported("content_type"))


NET_SQL = "CASE WHEN regexp_matches({0}, '(?i)dns|failed to lookup|not known') THEN 'dns_error' WHEN regexp_matches({0}, '(?i)tls|certificate') THEN 'tls_error' WHEN regexp_matches({0}, '(?i)timed out|timeout') THEN 'timeout' ELSE 'http_error' END"


@query(f"WITH m AS (SELECT event_id, {sql_pick(ERRORS, 'event_id')} AS m FROM events) SELECT event_id, {NET_SQL.format('m')} AS code, m AS message, {NET_SQL.format('m')} IN ('timeout', 'http_error') AS retryable FROM m")
def network_error(spark, sf_dir):
    d = read_table(spark, sf_dir, "events").select("event_id", pick(ERRORS, "event_id").alias("m"))
    return d.select("event_id", C.network_error("m").alias("e")).select("event_id", "e.*")


@query(f"""WITH f AS (SELECT page_id, {TYPE_SQL} AS content_type, {STATUS_SQL} AS st, html, CASE WHEN page_id % 17 = 4 THEN 'operation timed out' END AS es, page_id % 9 = 2 AS want, page_id % 2 = 0 AS blank FROM pages),
e AS (SELECT *, {SUPPORTED_SQL} AS supported FROM f)
SELECT page_id, CASE WHEN NOT supported THEN 'unsupported_content_type' WHEN es IS NOT NULL THEN 'timeout' WHEN st NOT BETWEEN 200 AND 299 THEN 'http_error' WHEN trim(html) = '' THEN 'empty_content' WHEN want AND blank THEN 'empty_content' END AS code,
 CASE WHEN NOT supported THEN 'content-type ' || content_type || ' is not supported for extraction' WHEN es IS NOT NULL THEN es WHEN st NOT BETWEEN 200 AND 299 THEN 'upstream HTTP ' || st WHEN trim(html) = '' THEN 'empty document body' WHEN want AND blank THEN 'markdown extraction produced no usable text' END AS message,
 CASE WHEN NOT supported THEN false WHEN es IS NOT NULL THEN true WHEN st NOT BETWEEN 200 AND 299 THEN st >= 500 OR st = 429 WHEN trim(html) = '' THEN true WHEN want AND blank THEN false END AS retryable FROM e""")
def scrape_error(spark, sf_dir):
    i = F.col("page_id")
    d = pages(spark, sf_dir).select("page_id", C.content_type(pick(TYPES, step=10)).alias("content_type"), pick(STATUSES).alias("st"), "html", F.when(i % 17 == 4, "operation timed out").alias("es"))
    e = C.scrape_error(F.lit(True), C.type_supported("content_type"), F.col("content_type"), F.col("st"), F.col("es"), F.col("html"), i % 9 == 2, i % 2 == 0)
    return d.select("page_id", e.alias("e")).select("page_id", "e.code", "e.message", "e.retryable")


def _judged(spark, sf_dir) -> DataFrame:
    """Fetches with what the decisions look at. Short, empty and challenge pages, which the tables don't hold, are in the tests."""
    d = spread(pages(spark, sf_dir)).select("page_id", pick(STATUSES, "page_id", 6).alias("status"), C.trim_space(F.col("html")).alias("html"))
    return d.select("page_id", "status", "html", X.visible_word_count("html").alias("words"), X.challenge_hit("html").alias("challenge"), X.pattern_main_score("html").alias("score"), X.pattern_link_count("html").alias("links"))


JUDGED_SQL = f"""WITH c AS (SELECT page_id, {sql_pick(STATUSES, "page_id", 6)} AS status, regexp_replace(html, '^{WS}+|{WS}+$', '', 'g') AS html FROM pages),
t AS (SELECT *, {TEXT_SQL} AS body_text FROM c),
j AS (SELECT page_id, status, html, {WORDS_SQL} AS words, {CHALLENGE_SQL} AS challenge, {SCORE_SQL} AS score, {LINKS_SQL} AS links FROM t)
"""
RETRY_SQL = "(status IN (403, 407, 408, 409, 410, 425, 429, 451) OR status >= 500)"


@query(JUDGED_SQL + f"SELECT page_id, {RETRY_SQL} AS retry_status, {RETRY_SQL} OR html = '' OR challenge OR strlen(html) < 512 OR words < 40 AS weak, {RETRY_SQL} OR challenge AS weak_anyway FROM j")
def retry_flags(spark, sf_dir):
    d = _judged(spark, sf_dir)
    weak = lambda need: C.weak_fetch(F.lit(True), F.col("status"), F.col("html"), F.col("words"), F.col("challenge"), F.lit(need))
    return d.select("page_id", C.retry_status("status").alias("retry_status"), weak(True).alias("weak"), weak(False).alias("weak_anyway"))


AUTO_SQL = """CASE WHEN status NOT BETWEEN 200 AND 299 THEN CASE WHEN status >= 500 OR status IN (403, 407, 408, 409, 410, 425, 429, 451, 503, 404) THEN 'http_bad_status' END
 WHEN html = '' THEN 'http_empty' WHEN challenge THEN 'http_challenge' WHEN NOT contains(lower(html), 'e') THEN 'required_text_missing' WHEN words < 150 THEN 'http_low_words' WHEN score < 0.45 THEN 'http_low_main_score' WHEN links / words > 6.0 THEN 'http_low_density' END"""


@query(JUDGED_SQL + f"SELECT page_id, {AUTO_SQL} AS reason, {RETRY_SQL} OR html = '' OR challenge OR strlen(html) < 512 OR words < 40 AS weak FROM j")
def fallback_reason_auto(spark, sf_dir):
    d = _judged(spark, sf_dir)
    blocked = C.blocked_statuses(F.array(F.lit(404)))
    reason = C.auto_fallback(F.lit(True), F.col("status"), blocked, F.col("html"), F.col("words"), F.col("challenge"), F.lit(True), ~X.contains_text("html", F.lit("E")), F.lit(False), F.col("score"), F.col("links"))
    return d.select("page_id", reason.alias("reason"), C.weak_fetch(F.lit(True), F.col("status"), F.col("html"), F.col("words"), F.col("challenge"), F.lit(True)).alias("weak"))


@query(JUDGED_SQL + f"""SELECT page_id, CASE WHEN {sql_pick(("http", "auto", "browser"))} = 'auto' AND page_id % 2 = 0 THEN 'browser' ELSE {sql_pick(("http", "auto", "browser"))} END AS mode_used,
 CASE WHEN page_id % 2 = 0 THEN CASE WHEN challenge THEN 'http_challenge' WHEN status NOT BETWEEN 200 AND 299 THEN 'http_bad_status' ELSE 'http_low_words' END ELSE 'none' END AS reason FROM j""")
def mode_used(spark, sf_dir):
    d, used = _judged(spark, sf_dir), F.col("page_id") % 2 == 0
    return d.select("page_id", C.mode_used(pick(("http", "auto", "browser")), used).alias("mode_used"), C.reported_reason(C.final_http_reason(F.col("status"), F.col("challenge")), used).alias("reason"))


@query("SELECT page_id, list_sort(list_distinct([403, 407, 408, 409, 410, 425, 429, 451, 503] || [404, 403 + CAST(page_id % 5 AS INT)])) AS statuses FROM pages")
def blocked_status_union(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", C.blocked_statuses(F.array(F.lit(404), (F.col("page_id") % 5 + 403).cast("int"))).alias("statuses"))


def _rungs(spark, sf_dir) -> DataFrame:
    """Every page as a request, with rungs that are missing, weak or strong by its number."""
    i = F.col("page_id")

    def rung(k: int, gap: int):
        state = F.floor(i / (2**k)) % 3  # 0: nothing came, 1: weak, 2: strong
        weak = state == 1
        return F.when(state != 0, F.struct((i * 10 + k).alias("page_id"), weak.alias("weak"), F.when(weak | (i % gap == 0), "http_low_words").alias("auto_reason"), F.when(i % 2 == 0, "http_challenge").otherwise("http_low_words").alias("http_reason")))

    return pages(spark, sf_dir).select("page_id", pick(("http", "auto", "browser"), "page_id").alias("mode"), (i % 5).alias("host_score"), *[rung(k, k + 3).alias(f"r{k}") for k in range(5)])


def _ladder_sql() -> str:
    def rung(k, gap):
        state = f"CAST(page_id // {2**k} AS BIGINT) % 3"
        return f"""CASE WHEN {state} <> 0 THEN page_id * 10 + {k} END AS p{k}, {state} = 1 AS w{k}, CASE WHEN {state} = 1 OR page_id % {gap} = 0 THEN 'http_low_words' END AS a{k}"""

    return f"""WITH r AS (SELECT page_id, {sql_pick(("http", "auto", "browser"))} AS mode, page_id % 5 AS s, CASE WHEN page_id % 2 = 0 THEN 'http_challenge' ELSE 'http_low_words' END AS hr, {", ".join(rung(k, k + 3) for k in range(5))} FROM pages),
c0 AS (SELECT *, CASE WHEN mode <> 'browser' AND s >= 3 AND p0 IS NOT NULL THEN 0 ELSE -1 END AS k0 FROM r),
c1 AS (SELECT *, CASE WHEN k0 = -1 OR w0 THEN CASE WHEN p1 IS NULL THEN -1 ELSE 1 END ELSE 0 END AS k1 FROM c0),
c2 AS (SELECT *, CASE WHEN k1 = -1 OR [w0, w1][k1 + 1] THEN CASE WHEN p2 IS NULL THEN -1 ELSE 2 END ELSE k1 END AS k2 FROM c1),
c3 AS (SELECT *, CASE WHEN k2 = -1 OR [w0, w1, w2][k2 + 1] THEN CASE WHEN p3 IS NULL THEN -1 ELSE 3 END ELSE k2 END AS k3 FROM c2),
d AS (SELECT *, CASE WHEN mode = 'auto' THEN CASE WHEN k3 = -1 THEN 'http_empty' ELSE [a0, a1, a2, a3][k3 + 1] END WHEN mode = 'http' THEN CASE WHEN k3 = -1 THEN 'http_low_words' WHEN [w0, w1, w2, w3][k3 + 1] THEN hr END END AS asked FROM c3),
e AS (SELECT *, CASE WHEN mode = 'browser' OR (asked IS NOT NULL AND p4 IS NOT NULL) THEN 4 ELSE k3 END AS k, mode = 'browser' OR (asked IS NOT NULL AND p4 IS NOT NULL) OR k0 = 0 AS used FROM d)
SELECT page_id, CASE WHEN k >= 0 THEN [p0, p1, p2, p3, p4][k + 1] END AS chosen, used AS used_browser,
 CASE WHEN used AND mode <> 'browser' THEN coalesce(asked, CASE WHEN s >= 3 THEN 'http_blocked' END, 'none') ELSE 'none' END AS reason,
 CASE WHEN mode = 'browser' OR (mode = 'auto' AND used) THEN 'browser' ELSE mode END AS mode_used,
 k < 0 OR [p0, p1, p2, p3, p4][k + 1] IS NULL OR [w0, w1, w2, w3, w4][k + 1] AS failed FROM e"""


@query(_ladder_sql())
def fetch_ladder(spark, sf_dir):
    d = ladder.climb(_rungs(spark, sf_dir))
    return d.select("page_id", F.col("chosen.page_id").alias("chosen"), "used_browser", "reason", "mode_used", "failed")


@query("""WITH c AS (SELECT page_id AS request_id, k AS position, k = 0 AS direct, CASE WHEN k = 2 AND page_id % 3 = 0 THEN url || '/' ELSE url || '/' || k || 'x' END AS url, url AS target, CASE WHEN k = 0 AND page_id % 2 = 0 THEN 404 ELSE 200 END AS status FROM pages, (SELECT unnest([0, 1, 2, 3]) AS k)),
r AS (SELECT *, CASE WHEN direct AND status = 200 THEN 0 WHEN NOT direct AND rtrim(url, '/') = rtrim(target, '/') THEN 1 WHEN NOT direct THEN 2 ELSE 3 END AS rank FROM c)
SELECT request_id, arg_min(position, rank * 10 + position) AS position FROM r GROUP BY request_id""")
def page_recovery(spark, sf_dir):
    i = F.col("page_id")
    c = pages(spark, sf_dir).withColumn("position", F.explode(F.array(*map(F.lit, range(4)))))
    k = F.col("position")
    c = c.select(i.alias("request_id"), k.alias("position"), (k == 0).alias("direct"), F.when((k == 2) & (i % 3 == 0), F.concat("url", F.lit("/"))).otherwise(F.concat("url", F.lit("/"), k.cast("string"), F.lit("x"))).alias("url"), F.col("url").alias("target"), F.when((k == 0) & (i % 2 == 0), 404).otherwise(200).alias("status_code"), F.lit("x").alias("html"))
    return ladder.recovered_page(c.withColumn("final_url", F.col("url"))).select("request_id", "position")


@query(r"""SELECT page_id, nullif(trim(regexp_replace(""" + UNESCAPE_SQL.format(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + rf""", '{WS}+', ' ', 'g')), '') AS title FROM pages""")
def title_extract(spark, sf_dir):
    return spread(pages(spark, sf_dir)).select("page_id", X.pattern_title(X.markup("html")).alias("title"))


@query(r"SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<h[1-6][\s/>]')) AS BIGINT) AS heading_count, CAST(len(regexp_extract_all(html, '(?i)<(?:pre|code)[\s/>]')) AS BIGINT) AS code_block_count FROM pages")
def heading_code_counts(spark, sf_dir):
    d = spread(pages(spark, sf_dir)).select("page_id", X.markup("html").alias("html"))
    return d.select("page_id", X.pattern_heading_count("html").alias("heading_count"), X.pattern_code_count("html").alias("code_block_count"))


@query(f"SELECT page_id, {LINKS_SQL} + 2 AS link_count, {LINKS_SQL} AS filled_link_count FROM pages")
def link_counts(spark, sf_dir):
    """Links of every page, to which two are added whose target is blank: the benchmark doesn't count these."""
    d = spread(pages(spark, sf_dir)).select("page_id", F.concat("html", F.lit('<a href=" ">x</a><a href="">y</a>')).alias("html"))
    d = d.withColumn("html", X.markup("html"))
    return d.select("page_id", X.pattern_link_count("html").alias("link_count"), X.pattern_filled_link_count("html").alias("filled_link_count"))


@query(f"WITH t AS (SELECT page_id, html, {TEXT_SQL} AS body_text FROM pages) SELECT page_id, round({SCORE_SQL}, 6) AS main_content_score FROM t")
def main_content_score(spark, sf_dir):
    return spread(pages(spark, sf_dir)).select("page_id", F.round(X.pattern_main_score("html"), 6).alias("main_content_score"))


@query(r"""SELECT page_id, regexp_matches(html, '(?i)<article[\s>]') AS has_article, regexp_matches(html, '(?i)<div class="?ad"?>') AS has_ad FROM pages""")
def selector_match(spark, sf_dir):
    d = spread(pages(spark, sf_dir))
    d = d.select("page_id", X.markup("html").alias("html"))
    return d.select("page_id", X.pattern_selector("html", "article").alias("has_article"), X.pattern_selector("html", "div.ad").alias("has_ad"))


MD_PARTS = ("a\n\n\n\nb", "x ![i](data:image/png;base64,AAAA) y", "![k](http://h/i.png)", "\n\n lead", "![open](data:image/gif;x", "tail \n\n\n\n\n")


@query(f"""WITH m AS (SELECT page_id, {sql_pick(MD_PARTS).replace(chr(10), "' || chr(10) || '")} || ' | ' || {sql_pick(MD_PARTS, "page_id", 6).replace(chr(10), "' || chr(10) || '")} AS md FROM pages)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(md, '!\\[[^\\[\\]]*\\]\\(data:image[^)]*(?:\\)|\\z)', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{WS}+|{WS}+$', '', 'g') AS markdown FROM m""")
def markdown_normalize(spark, sf_dir):
    d = pages(spark, sf_dir).select("page_id", F.concat(pick(MD_PARTS), F.lit(" | "), pick(MD_PARTS, step=6)).alias("md"))
    return d.select("page_id", X.normalize_markdown("md").alias("markdown"))


@query()
def fit_markdown(spark, sf_dir):
    """Markdown of every page under every profile."""
    from .functions.extract import PROFILES

    d = spread(pages(spark, sf_dir)).crossJoin(F.broadcast(spark.createDataFrame([(k, *v) for k, v in PROFILES.items()], "profile string, t double, kind string, words int")))
    return d.select("page_id", "profile", dom.fit_markdown("html", F.col("t"), F.col("kind"), F.col("words")).alias("m")).select("page_id", "profile", "m.*")


@query()
def main_text(spark, sf_dir):
    return spread(pages(spark, sf_dir)).select("page_id", dom.main_text("html").alias("main_text"), dom.page_text("html").alias("full_text"))


@query(r"""WITH a AS (SELECT page_id, """ + UNESCAPE_SQL.format(r"array_to_string(list_filter(string_split_regex(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '<[^>]*>'), lambda x: x <> ''), ' ')") + rf""" AS t FROM pages), n AS (SELECT page_id, CAST(len(regexp_extract_all(t, '[^{WS[1:-1]}]+')) AS BIGINT) AS n FROM a)
SELECT page_id, CASE WHEN n >= 40 THEN 'article' END AS tag, CASE WHEN n >= 40 THEN n END AS words FROM n""")
def semantic_block(spark, sf_dir):
    return spread(pages(spark, sf_dir)).select("page_id", X.pattern_main_block(X.markup("html"), X.MAIN_BLOCKS).alias("b")).select("page_id", "b.tag", "b.words")


@query(r"""WITH l AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS site, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*\shref\s*=\s*"([^"]*)"', 1)) AS href FROM pages)
SELECT DISTINCT page_id, site || href AS link FROM l WHERE starts_with(href, '/')""")
def page_link_list(spark, sf_dir):
    d = spread(pages(spark, sf_dir)).select("page_id", "url", F.explode(F.array_distinct(links.references("html"))).alias("ref"))
    return d.select("page_id", U.resolved("url", "ref").alias("link")).where("link is not null").distinct()


@query()
def scrape_pages(spark, sf_dir):
    """The whole answer to a request for every page."""
    req = pages(spark, sf_dir).select(F.col("page_id").alias("index"), "url", pick(("html", "text", "markdown")).alias("response_format"), F.lit("docs").alias("extraction_profile"))
    return S.scrape(_fetches(spark, sf_dir), R.scrape_plan(req))


def _attempts(spark, sf_dir) -> DataFrame:
    """Five attempts at every page, whose outcomes follow from its number: a browser's, three plain ones, a browser's again. Where nothing came, html is null."""
    i, k = F.col("page_id"), F.col("k")
    d = spread(pages(spark, sf_dir)).select("*", F.explode(F.array(*map(F.lit, range(5)))).alias("k"))
    came = F.when(k == 0, i % 4 != 1).when(k == 4, i % 5 != 0).otherwise(F.floor(i / F.expr("shiftleft(1, k)")) % 3 != 0)
    a = F.array(*map(F.lit, STATUSES))
    status = F.element_at(a, (F.floor(i / (k + 1)) % len(STATUSES) + 1).cast("int"))
    return d.select(
        i.alias("request_id"), k.alias("attempt"), F.when(k.isin(0, 4), "browser").otherwise("http").alias("mode"), "url", F.col("url").alias("final_url"), F.when(came, status).cast("int").alias("status_code"), F.create_map(F.lit("content-type"), pick(TYPES, step=10)).alias("headers"), F.when(came, F.col("html")).alias("html"),
        F.lit(None).cast("string").alias("error_status"), F.lit(None).cast("array<string>").alias("page_links"), F.lit(False).alias("waf_check"), F.lit(False).alias("content_truncated"), (i % 50 + k).cast("long").alias("duration_ms"), F.lit(None).cast("timestamp").alias("ts"),
    )


def _host_scores(spark, sf_dir) -> DataFrame:
    return pages(spark, sf_dir).select(U.host_key("url").alias("host")).distinct().withColumn("score", F.length("host") % 5)


def _asked(spark, sf_dir) -> DataFrame:
    """A plan of a request for every page: all modes and formats, with and without content."""
    i = F.col("page_id")
    r = pages(spark, sf_dir).select(i.alias("index"), "url", pick(("http", "auto", "browser")).alias("crawl_mode"), pick(("html", "text", "markdown"), step=3).alias("response_format"), (i % 4 != 2).alias("include_content"), F.lit("docs").alias("extraction_profile"))
    return R.scrape_plan(r)


def _answer_sql() -> str:
    came = ["page_id % 4 <> 1", *[f"CAST(page_id // {2**k} AS BIGINT) % 3 <> 0" for k in (1, 2, 3)], "page_id % 5 <> 0"]
    status = [sql_pick(STATUSES, step=k + 1) for k in range(5)]
    retry = "({0} IN (403, 407, 408, 409, 410, 425, 429, 451) OR {0} >= 500)"
    weak = [f"{retry.format(f's{k}')} OR challenge OR (need AND (n < 512 OR words < 40))" for k in range(5)]
    auto = [f"""CASE WHEN s{k} NOT BETWEEN 200 AND 299 THEN CASE WHEN {retry.format(f's{k}')} THEN 'http_bad_status' END WHEN challenge THEN 'http_challenge'
 WHEN need AND words < 150 THEN 'http_low_words' WHEN need AND score < 0.45 THEN 'http_low_main_score' WHEN need AND links / words > 6.0 THEN 'http_low_density' END""" for k in range(5)]
    http = [f"CASE WHEN challenge THEN 'http_challenge' WHEN s{k} NOT BETWEEN 200 AND 299 THEN 'http_bad_status' ELSE 'http_low_words' END" for k in range(5)]
    pick_k = lambda x, k: f"[{', '.join(f'{x}{j}' for j in range(5))}][{k} + 1]"
    step = lambda k: f"""CASE WHEN k{k - 1} = -1 OR {pick_k("w", f"k{k - 1}")} THEN CASE WHEN p{k} THEN {k} ELSE -1 END ELSE k{k - 1} END AS k{k}"""
    return f"""WITH t AS (SELECT *, {HOST_SQL} AS host, {TYPE_SQL} AS kind, {TEXT_SQL} AS body_text FROM pages),
b AS (SELECT page_id, html, kind, {sql_pick(("http", "auto", "browser"))} AS mode, {FORMAT_SQL} AS fmt, page_id % 4 <> 2 AS include, length(host) % 5 AS hs, {WORDS_SQL} AS words, {CHALLENGE_SQL} AS challenge, {SCORE_SQL} AS score, {LINKS_SQL} AS links, strlen(html) AS n,
 {", ".join(f"{c} AS p{k}" for k, c in enumerate(came))}, {", ".join(f"{s} AS s{k}" for k, s in enumerate(status))} FROM t),
j AS (SELECT *, include OR fmt = 'markdown' AS need FROM b),
r AS (SELECT *, {", ".join(f"{w} AS w{k}, {a} AS a{k}, {h} AS h{k}" for k, (w, a, h) in enumerate(zip(weak, auto, http, strict=True)))}, CASE WHEN mode <> 'browser' AND hs >= 3 AND p0 THEN 0 ELSE -1 END AS k0 FROM j),
c1 AS (SELECT *, {step(1)} FROM r), c2 AS (SELECT *, {step(2)} FROM c1), c3 AS (SELECT *, {step(3)} FROM c2),
d AS (SELECT *, CASE WHEN mode = 'auto' THEN CASE WHEN k3 = -1 THEN 'http_empty' ELSE {pick_k("a", "k3")} END WHEN mode = 'http' THEN CASE WHEN k3 = -1 THEN 'http_low_words' WHEN {pick_k("w", "k3")} THEN {pick_k("h", "k3")} END END AS asked FROM c3),
e AS (SELECT *, CASE WHEN mode = 'browser' THEN CASE WHEN p4 THEN 4 WHEN p0 THEN 0 ELSE -1 END WHEN asked IS NOT NULL AND p4 THEN 4 ELSE k3 END AS k, mode = 'browser' OR (asked IS NOT NULL AND p4) OR k0 = 0 AS used FROM d),
f AS (SELECT *, k >= 0 AS has, {pick_k("s", "k")} AS status_code, CASE WHEN k >= 0 THEN kind ELSE '' END AS content_type, CASE WHEN used AND mode <> 'browser' THEN coalesce(asked, CASE WHEN hs >= 3 THEN 'http_blocked' END, 'none') ELSE 'none' END AS reason FROM e),
g AS (SELECT *, {SUPPORTED_SQL} AS supported FROM f)
"""


@query(_answer_sql() + """SELECT page_id AS request_id, CASE WHEN has THEN status_code END AS status_code, content_type, 5 * (page_id % 50) + 10 AS duration_ms, CASE WHEN mode = 'browser' OR (mode = 'auto' AND used) THEN 'browser' ELSE mode END AS mode_used,
 CASE WHEN NOT supported THEN 'http_unsupported_content_type' WHEN NOT has THEN 'http_empty' ELSE reason END AS reason, NOT has OR """ + "[w0, w1, w2, w3, w4][k + 1]" + """ AS failed,
 CASE WHEN NOT supported THEN 'unsupported_content_type' WHEN NOT has THEN 'empty_content' WHEN status_code NOT BETWEEN 200 AND 299 THEN 'http_error' END AS error,
 CASE WHEN has AND supported THEN words ELSE 0 END AS word_count, CASE WHEN has AND supported THEN links ELSE 0 END AS link_count, round(CASE WHEN has AND supported THEN score ELSE 0.0 END, 6) AS main_content_score, round(CASE WHEN has AND supported AND words > 0 THEN least(1.0, links / words / 20.0) ELSE 0.0 END, 6) AS link_density,
 CASE WHEN has AND supported THEN CAST(n AS BIGINT) END AS page_bytes, CASE WHEN has AND supported THEN links END AS links_extracted, CASE WHEN has AND supported AND include AND fmt = 'html' THEN md5(html) END AS html_md5,
 has AND supported AND include AS has_content, has AND supported AND fmt = 'markdown' AS has_markdown FROM g""")
def scrape_metadata(spark, sf_dir):
    """All of an answer but its texts, for requests of five attempts each."""
    d = S.scrape(_attempts(spark, sf_dir), _asked(spark, sf_dir), scores=_host_scores(spark, sf_dir))
    fmt = pick(("html", "text", "markdown"), "request_id", 3)
    return d.select("request_id", "status_code", "content_type", "duration_ms", "mode_used", F.col("signals.fallback_reason").alias("reason"), "failed", F.col("error.code").alias("error"), "signals.word_count", "signals.link_count", F.round("signals.main_content_score", 6).alias("main_content_score"), F.round("signals.link_density", 6).alias("link_density"), F.col("page.bytes").alias("page_bytes"), "page.links_extracted", F.when(fmt == "html", F.md5(F.col("content").cast("binary"))).alias("html_md5"), F.col("content").isNotNull().alias("has_content"), F.col("markdown").isNotNull().alias("has_markdown"))


@query(_answer_sql() + f"""SELECT page_id AS index, page_id % 9 <> 4 AS ok, CASE WHEN page_id % 9 = 4 THEN 0 ELSE 5 * (page_id % 50) + 10 END AS duration_ms, CASE WHEN page_id % 9 <> 4 AND has THEN status_code END AS status_code, CASE WHEN page_id % 9 = 4 THEN 'url must use http or https' END AS error FROM g""")
def batch_answers(spark, sf_dir):
    """The items of a batch; a ninth of the requests has no target that can be fetched."""
    plan = _asked(spark, sf_dir)
    bad = F.col("index") % 9 == 4
    plan = plan.withColumn("url", F.when(bad, F.concat(F.lit("ftp://"), F.col("url"))).otherwise(F.col("url"))).withColumn("error", F.coalesce("error", U.url_error("url")))
    answers = S.scrape(_attempts(spark, sf_dir), plan, scores=_host_scores(spark, sf_dir))
    items = batch.batch_items(answers, plan, ["status_code", "mode_used"])
    return items.select("index", "ok", "duration_ms", F.col("response.status_code").alias("status_code"), "error")


@query("""SELECT page_id AS request_id, max(k) FILTER (page_id % (k + 2) <> 0) AS seq FROM pages, (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS k) GROUP BY page_id HAVING max(k) FILTER (page_id % (k + 2) <> 0) IS NOT NULL""")
def browser_last_page(spark, sf_dir):
    """The last of up to eight pages that a browser told."""
    told = pages(spark, sf_dir).select(F.col("page_id").alias("request_id"), F.explode(F.array(*map(F.lit, range(8)))).alias("seq"), "url").where("request_id % (seq + 2) <> 0")
    return ladder.last_page(told).select("request_id", "seq")


@query(f"""WITH p AS (SELECT page_id, {sql_pick(("http", "auto", "browser"))} AS mode, {STATUS_SQL} AS status, page_id % 4 <> 0 AS has_http, page_id % 5 <> 0 AS has_browser, page_id % 2 = 0 AS need, html FROM pages),
w AS (SELECT *, NOT has_http OR status NOT BETWEEN 200 AND 299 OR (need AND trim(html) = '') AS weak FROM p)
SELECT page_id, weak, CASE WHEN mode = 'browser' THEN CASE WHEN has_browser THEN 'browser' END WHEN mode = 'auto' AND weak THEN CASE WHEN has_browser THEN 'browser' WHEN has_http THEN 'http' END WHEN has_http THEN 'http' END AS page FROM w""")
def page_by_mode(spark, sf_dir):
    """Which page a single fetch ends with under each mode."""
    i = F.col("page_id")
    d = pages(spark, sf_dir).select("page_id", F.when(i % 4 != 0, F.struct(F.lit("http").alias("by"), pick(STATUSES).alias("status_code"), "html")).alias("http"), F.when(i % 5 != 0, F.struct(F.lit("browser").alias("by"), F.lit(200).alias("status_code"), "html")).alias("browser"))
    need, http = i % 2 == 0, F.col("http")
    return d.select("page_id", C.page_needs_browser(http.isNotNull(), http["status_code"], http["html"], need).alias("weak"), ladder.page_by_mode(pick(("http", "auto", "browser")), http, F.col("browser"), need)["by"].alias("page"))


@query("SELECT page_id AS index, CAST(0 AS BIGINT) AS max_depth, CAST(1 AS BIGINT) AS max_pages, CAST(1 AS BIGINT) AS crawl_concurrency, false AS subdomains, true AS return_page_links FROM pages")
def single_page_plan(spark, sf_dir):
    i = F.col("page_id")
    p = R.single_page(R.crawl_plan(pages(spark, sf_dir).select(i.alias("index"), "url", (i % 7).alias("max_depth"), F.lit(True).alias("subdomains"))))
    return p.select("index", "max_depth", "max_pages", "crawl_concurrency", "subdomains", "return_page_links")


POLICIES = ("loose", "strict", "none", "", "LOOSE")


@query(f"""WITH p AS (SELECT page_id, url, nullif({sql_pick(POLICIES)}, '') AS p FROM pages)
SELECT page_id AS index, CASE WHEN p <> 'LOOSE' THEN p END AS redirect_policy, CASE WHEN p = 'LOOSE' THEN 'redirect_policy must be one of loose, strict, none' END AS error FROM p""")
def redirect_plan(spark, sf_dir):
    p = R.scrape_plan(pages(spark, sf_dir).select(F.col("page_id").alias("index"), "url", F.nullif(pick(POLICIES), F.lit("")).alias("redirect_policy")))
    return p.select("index", "redirect_policy", "error")


@query("""SELECT page_id AS batch, CAST(i AS BIGINT) AS index, url || i AS url, CASE WHEN i = 1 THEN page_id % 1000 END AS max_content_chars, CASE WHEN i = 2 THEN true END AS include_markdown FROM pages, (SELECT unnest([0, 1, 2]) AS i)""")
def request_decode(spark, sf_dir):
    """Batch bodies of three requests each, as JSON, one row per request."""
    body = F.concat(F.lit('{"requests":[{"url":"'), "url", F.lit('0","unknown":{"a":1}},{"url":"'), "url", F.lit('1","max_content_chars":'), (F.col("page_id") % 1000).cast("string"), F.lit('},{"url":"'), "url", F.lit('2","include_markdown":true}]}'))
    d = decode_requests(pages(spark, sf_dir).select("page_id", body.alias("body")), keep=("page_id",))
    return d.select(F.col("page_id").alias("batch"), "index", "url", "max_content_chars", "include_markdown")


TARGETS = ("  http://t{n}.org/a ", "", "   ", "http://t{n}.org/b")


@query(f"SELECT s_suppkey AS line_no, trim(replace({sql_pick(TARGETS, 's_suppkey')}, '{{n}}', CAST(s_suppkey AS VARCHAR))) AS url FROM supplier WHERE trim({sql_pick(TARGETS, 's_suppkey')}) <> ''")
def target_lines(spark, sf_dir):
    lines = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("line_no"), F.replace(pick(TARGETS, "s_suppkey"), F.lit("{n}"), F.col("s_suppkey").cast("string")).alias("line"))
    return target_list(lines)


BENCH_PROXIES = ("10.0.0.{n}:80", " h{n}:1:user:pw ", "socks5://h{n}:1", "# comment", "", "u:p@h{n}:90", "u@h{n}", "h{n}", "a:b:c", "10.0.0.1:80")


@query(f"""WITH l AS (SELECT s_suppkey AS line_no, trim(replace({sql_pick(BENCH_PROXIES, "s_suppkey")}, '{{n}}', CAST(s_suppkey AS VARCHAR))) AS v FROM supplier),
p AS (SELECT *, string_split(v, ':') AS p FROM l),
o AS (SELECT line_no, CASE WHEN v = '' OR v LIKE '#%' THEN NULL WHEN contains(v, '://') THEN v WHEN contains(v, '@') THEN CASE WHEN contains(string_split(v, '@')[-1], ':') THEN 'http://' || v END WHEN len(p) = 2 THEN 'http://' || v WHEN len(p) = 4 THEN 'http://' || p[3] || ':' || p[4] || '@' || p[1] || ':' || p[2] END AS proxy FROM p)
SELECT min(line_no) AS line_no, proxy FROM o WHERE proxy IS NOT NULL GROUP BY proxy ORDER BY line_no LIMIT 50""")
def bench_proxies(spark, sf_dir):
    """The first fifty different proxies of a benchmark's list: a limit of the feature."""
    lines = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("line_no"), F.replace(pick(BENCH_PROXIES, "s_suppkey"), F.lit("{n}"), F.col("s_suppkey").cast("string")).alias("line"))
    return bench_proxy_list([lines], 50)


TITLES = ("  A  b ", "a\tb", "   ", "Plain")


@query(f"""WITH t AS (SELECT event_id, {sql_pick(TITLES, "event_id").replace(chr(9), "' || chr(9) || '")} AS t FROM events) SELECT event_id, nullif(trim(regexp_replace(t, '[ \t]+', ' ', 'g')), '') AS title FROM t""")
def normalized_titles(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", benchmark.normalized_title(pick(TITLES, "event_id")).alias("title"))


@query(f"""WITH b AS (SELECT page_id AS index, {HOST_SQL} AS host FROM pages), w AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY index) AS p FROM b)
SELECT index, host, CAST((p + 3) // 4 AS BIGINT) AS wave FROM w""")
def scrape_batch(spark, sf_dir):
    return batch.waves(pages(spark, sf_dir).select(F.col("page_id").alias("index"), "url")).select("index", "host", "wave")


@query("SELECT n, CASE WHEN n = 0 THEN 'requests must contain at least one item' WHEN n > 64 THEN 'batch size exceeds configured maximum: 64' END AS error FROM (SELECT DISTINCT CAST(page_id % 70 AS INT) AS n FROM pages)")
def batch_limit(spark, sf_dir):
    return pages(spark, sf_dir).select((F.col("page_id") % 70).cast("int").alias("n")).distinct().withColumn("error", batch.batch_error(F.col("n")))


def _edges(spark, sf_dir) -> DataFrame:
    p = pages(spark, sf_dir).select("page_id")
    n = p.agg((F.max("page_id") + 1).alias("n"))
    return p.crossJoin(F.broadcast(n)).select(F.col("page_id").alias("src"), F.explode(F.array((F.col("page_id") * 7 + 3) % F.col("n"), (F.col("page_id") * 5 + 1) % F.col("n"))).alias("dst"))


CRAWL_SQL = """WITH RECURSIVE n AS (SELECT max(page_id) + 1 AS n FROM pages), edges AS (SELECT page_id AS src, unnest([(page_id * 7 + 3) % n, (page_id * 5 + 1) % n]) AS dst FROM pages, n),
walk(seed, page, depth) AS (SELECT page_id, page_id, 0 FROM pages UNION SELECT w.seed, e.dst, w.depth + 1 FROM walk w JOIN edges e ON w.page = e.src WHERE w.depth < 3),
firsts AS (SELECT seed, page, min(depth) AS depth FROM walk GROUP BY seed, page),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, page) AS place FROM firsts),
crawled AS (SELECT * FROM ranked WHERE place <= 10)
"""


def _crawl(spark, sf_dir):
    seeds = pages(spark, sf_dir).select(F.col("page_id").alias("seed"), F.col("page_id").alias("page"))
    return crawl.crawl(seeds, _edges(spark, sf_dir), 3, 10)


@query(CRAWL_SQL + "SELECT seed, page, depth, place FROM crawled")
def crawl_bfs(spark, sf_dir):
    return _crawl(spark, sf_dir)


@query(CRAWL_SQL + """, s AS (SELECT c.seed, count(DISTINCT e.dst) AS unique_links_seen FROM crawled c LEFT JOIN edges e ON c.page = e.src GROUP BY c.seed),
p AS (SELECT seed, count(*) AS pages_fetched, max(depth) AS max_depth FROM crawled GROUP BY seed)
SELECT seed, pages_fetched, max_depth, unique_links_seen, pages_fetched < 5 OR unique_links_seen < 18 AS needs_browser FROM p JOIN s USING (seed)""")
def crawl_fallback(spark, sf_dir):
    return crawl.crawl_summary(_crawl(spark, sf_dir), _edges(spark, sf_dir), 5, 18)


SCOPE_SQL = f"""WITH RECURSIVE n AS (SELECT max(page_id) + 1 AS n FROM pages), h AS (SELECT page_id, {HOST_SQL} AS host FROM pages), raw AS (SELECT page_id AS src, unnest([(page_id * 7 + 3) % n, (page_id * 5 + 1) % n]) AS dst FROM pages, n),
"""


@query(SCOPE_SQL.replace("RECURSIVE ", "") + r"""s AS (SELECT page_id, host, regexp_extract(host, '([^.]+\.)?[^.]+$') AS site FROM h)
SELECT DISTINCT src, dst, a.host = b.host AS same_host FROM raw JOIN s a ON a.page_id = src JOIN s b ON b.page_id = dst WHERE a.site = b.site""")
def crawl_scope(spark, sf_dir):
    """Links within a site, and whether they stay on their host."""
    hosts_of = pages(spark, sf_dir).select(F.col("page_id").alias("page"), U.host_key("url").alias("host"))
    edges = _edges(spark, sf_dir).distinct()
    wide, own = crawl.in_scope(edges, hosts_of, True), crawl.in_scope(edges, hosts_of).withColumn("same", F.lit(True))
    return wide.join(own, ["src", "dst"], "left").select("src", "dst", F.coalesce("same", F.lit(False)).alias("same_host"))


def _crawls_sql() -> str:
    return f"""WITH RECURSIVE n AS (SELECT max(page_id) + 1 AS n FROM pages), both_edges AS (SELECT page_id AS src, unnest([(page_id * 7 + 3) % n, (page_id * 5 + 1) % n]) AS dst, unnest([0, 1]) AS which FROM pages, n),
e AS (SELECT src, dst, b FROM both_edges, (SELECT unnest([false, true]) AS b) WHERE b OR (which = 0 AND src % 2 = 0)),
seeds AS (SELECT page_id, {sql_pick(("http", "auto", "browser"))} AS mode FROM pages),
walk(seed, page, depth, b) AS (SELECT page_id, page_id, 0, b FROM seeds, (SELECT unnest([false, true]) AS b) UNION SELECT w.seed, e.dst, w.depth + 1, w.b FROM walk w JOIN e ON w.page = e.src AND w.b = e.b WHERE w.depth < 2),
firsts AS (SELECT seed, page, b, min(depth) AS depth FROM walk GROUP BY seed, page, b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seed, b ORDER BY depth, page) AS place FROM firsts),
crawled AS (SELECT * FROM ranked WHERE place <= 5),
told AS (SELECT c.seed, c.b, count(DISTINCT c.page) AS pages_fetched, count(DISTINCT e.dst) AS unique_links_seen FROM crawled c LEFT JOIN e ON c.page = e.src AND c.b = e.b GROUP BY c.seed, c.b),
mode AS (SELECT page_id AS seed, mode = 'browser' OR (mode = 'auto' AND (pages_fetched < 2 OR unique_links_seen < 2)) AS used FROM seeds JOIN told ON seed = page_id AND NOT b)
"""


@query(_crawls_sql() + "SELECT c.seed, page, depth, place, used AS used_browser FROM crawled c JOIN mode m ON c.seed = m.seed AND c.b = m.used")
def crawl_modes(spark, sf_dir):
    """Crawls by mode: a plain fetch sees one link of every other page, a browser sees all."""
    return _crawls(spark, sf_dir)[0]


def _crawls(spark, sf_dir):
    every = _edges(spark, sf_dir)
    n = pages(spark, sf_dir).agg((F.max("page_id") + 1).alias("n"))
    plain = pages(spark, sf_dir).crossJoin(F.broadcast(n)).where("page_id % 2 = 0").select(F.col("page_id").alias("src"), ((F.col("page_id") * 7 + 3) % F.col("n")).alias("dst"))
    seeds = pages(spark, sf_dir).select(F.col("page_id").alias("seed"), F.col("page_id").alias("page"), pick(("http", "auto", "browser")).alias("mode"))
    return crawl.crawl_by_mode(seeds, plain, every, 2, 5, 2, 2), plain, every


@query(_crawls_sql() + """SELECT page_id AS index, page_id % 9 <> 4 AS ok, CASE WHEN page_id % 9 <> 4 THEN url END AS root_url, CASE WHEN page_id % 9 <> 4 THEN pages_fetched END AS pages_fetched, CASE WHEN page_id % 9 <> 4 THEN unique_links_seen END AS unique_links_seen, CASE WHEN page_id % 9 = 4 THEN 'url must use http or https' END AS error
 FROM pages JOIN mode m ON m.seed = page_id JOIN told t ON t.seed = page_id AND t.b = m.used""")
def crawl_batch(spark, sf_dir):
    """The items of a batch of crawls; a ninth of the requests has no target that can be crawled."""
    crawled, plain, every = _crawls(spark, sf_dir)
    links = plain.withColumn("used_browser", F.lit(False)).unionByName(every.withColumn("used_browser", F.lit(True)))
    i = F.col("page_id")
    plan = R.crawl_plan(pages(spark, sf_dir).select(i.alias("index"), F.when(i % 9 == 4, F.concat(F.lit("ftp://"), F.col("url"))).otherwise(F.col("url")).alias("url")))
    return batch.crawl_items(crawl.crawl_counts(crawled, links), plan)


@query(CRAWL_SQL + f"""SELECT seed, place, p.url AS url, CAST(strlen(html) AS BIGINT) AS bytes, {LINKS_SQL} AS links_extracted, CASE WHEN seed % 2 = 0 THEN md5(html) END AS content_md5, seed % 3 = 0 AS has_markdown FROM crawled c JOIN pages p ON p.page_id = c.page""")
def crawl_answers(spark, sf_dir):
    """The pages of every crawl's answer."""
    i = F.col("page_id")
    plan = R.crawl_plan(pages(spark, sf_dir).select(i.alias("index"), "url", (i % 2 == 0).alias("include_content"), (i % 3 == 0).alias("include_markdown")))
    d = crawl.crawl_pages(_crawl(spark, sf_dir), fetches_from_pages(pages(spark, sf_dir)), plan)
    return d.select("seed", "place", "page.url", "page.bytes", "page.links_extracted", F.md5(F.col("page.content").cast("binary")).alias("content_md5"), F.col("page.markdown").isNotNull().alias("has_markdown"))


@query("SELECT page_id AS seed, CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN 1 ELSE page_id % 3 END AS pages_fetched, CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN greatest(page_id % 4, 1) ELSE page_id % 4 END AS unique_links_seen, CASE WHEN page_id % 6 = 0 THEN page_id END AS recovered FROM pages")
def crawl_recovery(spark, sf_dir):
    p = pages(spark, sf_dir)
    i = F.col("page_id")
    done = p.select(i.alias("seed"), (i % 3).alias("pages_fetched"), (i % 4).alias("unique_links_seen"))
    alone = p.select(i.alias("seed"), F.when(i % 2 == 0, i).alias("page")).where("page is not null")  # a fetch that failed has no page
    return crawl.with_recovery(done, alone, 0, 1)


def _host_events(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("host"), "event_id", "ts", (F.col("event_type") == "error").alias("failed"))


@query("""SELECT CAST(user_id AS VARCHAR) AS host, event_id, event_type = 'error' AS failed,
 CASE WHEN len(h) = 1 THEN greatest(0, least(8, h[1])) ELSE list_reduce(list_prepend(0, h), lambda a, x: greatest(0, least(8, a + x))) END AS score,
 CASE WHEN len(h) = 1 THEN false ELSE list_reduce(list_prepend(0, h[:-2]), lambda a, x: greatest(0, least(8, a + x))) >= 3 END AS force_browser
FROM (SELECT *, list(CASE WHEN event_type = 'error' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS h FROM events)""")
def host_failure_memory(spark, sf_dir):
    return hosts.host_history(_host_events(spark, sf_dir)).select("host", "event_id", "failed", "score", "force_browser")


@query("""SELECT host, score FROM (SELECT CAST(user_id AS VARCHAR) AS host, list_reduce(list_prepend(0, list(CASE WHEN event_type = 'error' THEN 1 ELSE -1 END ORDER BY ts, event_id)), lambda a, x: greatest(0, least(8, a + x))) AS score FROM events GROUP BY user_id) WHERE score > 0""")
def host_final_scores(spark, sf_dir):
    return hosts.host_scores(_host_events(spark, sf_dir))


def _events(spark, sf_dir):
    """Events whose ts is a moment, not a wall clock's time."""
    return read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


IDLE = 5 * 86400


def _forgetful_sql(idle: int) -> str:
    """Each event's score before and after it, where a host idle for longer than `idle` seconds begins anew: k numbers such beginnings."""
    return f"""WITH e AS (SELECT *, event_type = 'error' AS failed, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > {idle}000000 AS fresh FROM events),
s AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e),
h AS (SELECT *, list_prepend(0, list(CASE WHEN failed THEN 1 ELSE -1 END) OVER (PARTITION BY user_id, k ORDER BY ts, event_id)) AS h FROM s),
scored AS (SELECT user_id, event_id, ts, failed, CASE WHEN len(h) = 2 THEN 0 ELSE list_reduce(h[:-2], lambda a, x: greatest(0, least(8, a + x))) END AS score_before, list_reduce(h, lambda a, x: greatest(0, least(8, a + x))) AS score FROM h)
"""


@query(_forgetful_sql(IDLE) + "SELECT CAST(user_id AS VARCHAR) AS host, event_id, score_before, score, score_before >= 3 AS force_browser FROM scored")
def host_memory_expiry(spark, sf_dir):
    """Failure memory of hosts that forgets a host after five days without a fetch."""
    return hosts.host_history(_host_events(spark, sf_dir), IDLE).select("host", "event_id", "score_before", "score", "force_browser")


@query(_forgetful_sql(IDLE) + f"""SELECT r.event_id AS request_id, CAST(r.user_id AS VARCHAR) AS host, CASE WHEN s.score IS NULL OR epoch_us(r.at) - epoch_us(s.ts) > {IDLE}000000 THEN 0 ELSE s.score END AS host_score,
 coalesce(s.score, 0) >= 3 AND epoch_us(r.at) - epoch_us(s.ts) <= {IDLE}000000 AS force_browser
FROM (SELECT event_id, user_id, ts + INTERVAL 7 HOUR AS at FROM events WHERE event_type <> 'error') r ASOF LEFT JOIN (SELECT user_id, max_by(ts, event_id) AS ts, max_by(score, event_id) AS score, ts AS t FROM scored GROUP BY user_id, ts) s ON r.user_id = s.user_id AND r.at >= s.t""")
def host_score_lookup(spark, sf_dir):
    """The score of a request's host at the request's time, seven hours after an event that wasn't an error."""
    r = _events(spark, sf_dir).where("event_type <> 'error'").select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("host"), (F.col("ts") + F.expr("INTERVAL 7 HOURS")).alias("ts"))
    return hosts.scores_at(r, _host_events(spark, sf_dir), IDLE).select("request_id", "host", "host_score", "force_browser")


def _arrivals(spark, sf_dir):
    """Events as fetches of twenty hosts that arrive by half days, every 37th three half days late."""
    e, i = _events(spark, sf_dir), F.col("event_id")
    arrival = F.floor(F.unix_seconds("ts") / 43200) + F.when(i % 37 == 0, 3).otherwise(0)
    return e.select(F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string")).alias("host"), F.col("event_type").alias("status"), "ts", F.round(F.col("value") * 100).cast("long").alias("duration_ms"), arrival.cast("long").alias("arrival"))


ARRIVALS_SQL = """WITH f AS (SELECT 'h' || (user_id % 20) AS host, event_type AS status, ts, CAST(round(value * 100) AS BIGINT) AS duration_ms, epoch_us(ts) // 1000000 // 43200 + CASE WHEN event_id % 37 = 0 THEN 3 ELSE 0 END AS arrival FROM events),
m AS (SELECT arrival, max(max(epoch_us(ts))) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 * 1000 - 21600000000 AS mark FROM f GROUP BY arrival),
kept AS (SELECT f.*, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM f JOIN m USING (arrival) WHERE mark IS NULL OR epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) + 3600000000 > mark)
"""
SUMS_SQL = "CAST(count(*) AS BIGINT) AS fetches, CAST(sum(duration_ms) AS BIGINT) AS total_ms, " + ", ".join(f"count(*) FILTER (duration_ms <= {b}) AS le_{b}" for b in metrics.BUCKETS)


@query(ARRIVALS_SQL + f"SELECT strftime(window_start, '%Y-%m-%d %H:%M') AS window_start, host, status, {SUMS_SQL} FROM kept GROUP BY ALL")
def window_metrics(spark, sf_dir):
    """Hourly metrics of hosts and statuses, without the rows that come more than six hours late."""
    d = metrics.fetch_metrics(metrics.on_time(_arrivals(spark, sf_dir), 3600, 21600), 3600)
    return d.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query(ARRIVALS_SQL + f"SELECT status, {SUMS_SQL} FROM kept GROUP BY status")
def status_metrics(spark, sf_dir):
    """The same metrics summed up for each status."""
    return metrics.metric_totals(metrics.fetch_metrics(metrics.on_time(_arrivals(spark, sf_dir), 3600, 21600), 3600))


def _timed_requests(spark, sf_dir):
    """Events as requests that take six seconds for each hundredth of their value; a seventh of them is of one host."""
    e, i, us = _events(spark, sf_dir), F.col("event_id"), F.unix_micros("ts")
    return e.select(i.alias("request_id"), F.when(i % 7 == 0, "hot").otherwise(F.concat(F.lit("h"), (F.col("user_id") % 40).cast("string"))).alias("host"), us.alias("start_us"), (us + F.round(F.col("value") * 100).cast("long") * 6_000_000).alias("end_us"))


def _admission_sql(limit: int, by: str) -> str:
    """Request after request, with the ends of those that run."""
    return f"""WITH RECURSIVE r AS (SELECT event_id AS request_id, CASE WHEN event_id % 7 = 0 THEN 'hot' ELSE 'h' || (user_id % 40) END AS host, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 6000000 AS e FROM events),
q AS (SELECT *, {by} AS scope, row_number() OVER (PARTITION BY {by} ORDER BY s, request_id) AS k FROM r),
go(scope, k, request_id, host, ends, admitted) AS (SELECT scope, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', CAST([] AS BIGINT[]), true FROM q GROUP BY scope UNION ALL
 SELECT q.scope, q.k, q.request_id, q.host, CASE WHEN len(list_filter(go.ends, lambda x: x > q.s)) < {limit} THEN list_append(list_filter(go.ends, lambda x: x > q.s), q.e) ELSE list_filter(go.ends, lambda x: x > q.s) END, len(list_filter(go.ends, lambda x: x > q.s)) < {limit}
 FROM go JOIN q ON q.scope = go.scope AND q.k = go.k + 1)
SELECT request_id, host, admitted, CASE WHEN NOT admitted THEN 429 END AS status, CASE WHEN NOT admitted THEN 'crawler is saturated, retry later' END AS error FROM go WHERE k > 0"""


@query(_admission_sql(24, "0"))
def admission_global(spark, sf_dir):
    """Requests that a service of 24 permits admits or turns away."""
    return admission.admit(_timed_requests(spark, sf_dir), 24).select("request_id", "host", "admitted", "status", "error")


@query(_admission_sql(2, "host"))
def admission_by_host(spark, sf_dir):
    """Requests that hosts of two permits each admit or turn away."""
    return admission.admit(_timed_requests(spark, sf_dir), 2, ("host",)).select("request_id", "host", "admitted", "status", "error")


def _runs(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(i.alias("run_id"), F.col("event_type").alias("tool"), F.concat(F.lit("u"), (i % 50).cast("string")).alias("url"), (i % 7 != 0).alias("ok"), F.round("value", 3).alias("duration_s"), (i * 37 % 5000 - 100).alias("bytes_extracted"), (i % 9).alias("link_count"), F.concat(F.lit(" Title "), (i % 60).cast("string")).alias("title"), F.when(i % 700 == 0, "timeout").otherwise("http").alias("error"))


RUNS_SQL = """WITH runs AS (SELECT event_id AS run_id, event_type AS tool, 'u' || (event_id % 50) AS url, event_id % 7 <> 0 AS ok, round(value, 3) AS duration_s, event_id * 37 % 5000 - 100 AS bytes_extracted, event_id % 9 AS link_count, ' Title ' || (event_id % 60) AS title, CASE WHEN event_id % 700 = 0 THEN 'timeout' ELSE 'http' END AS error FROM events),
canonical AS (SELECT 'u' || i AS url, 'TITLE ' || i AS canonical_title FROM range(40) t(i))
"""


@query(RUNS_SQL + """SELECT tool, count(*) AS runs, count(*) FILTER (ok) AS successes, round(avg(duration_s) FILTER (ok), 4) AS avg_latency, CAST(trunc(avg(bytes_extracted) FILTER (ok)) AS BIGINT) AS avg_bytes, round(avg(link_count) FILTER (ok), 2) AS avg_links,
 count(*) FILTER (NOT ok) AS n_errors FROM runs GROUP BY tool""")
def bench_summary(spark, sf_dir):
    d = benchmark.summarize(_runs(spark, sf_dir))
    return d.select("tool", "runs", "successes", "avg_latency", "avg_bytes", "avg_links", "n_errors")


@query(RUNS_SQL + "SELECT tool, run_id, error FROM runs WHERE NOT ok")
def bench_errors(spark, sf_dir):
    """The error of every run that failed."""
    return benchmark.run_errors(_runs(spark, sf_dir))


@query(RUNS_SQL + """, v AS (SELECT tool, list(duration_s ORDER BY duration_s) AS v FROM runs WHERE ok GROUP BY tool), n AS (SELECT *, len(v) AS n FROM v), j AS (SELECT *, least(greatest(19 * (n + 1) // 20, 1), n - 1) AS j FROM n)
SELECT tool, round(CASE WHEN n = 1 THEN v[1] ELSE (v[j] * (20 - (19 * (n + 1) - 20 * j)) + v[j + 1] * (19 * (n + 1) - 20 * j)) / 20 END, 4) AS p95_latency FROM j""")
def bench_p95(spark, sf_dir):
    return benchmark.p95_latency(_runs(spark, sf_dir)).select("tool", F.round("p95_latency", 4).alias("p95_latency"))


@query(RUNS_SQL + """SELECT tool, round(avg(CASE WHEN lower(trim(title)) = lower(trim(canonical_title)) THEN 1 WHEN canonical_title IS NULL THEN NULL ELSE 0 END) FILTER (ok), 4) AS title_match_rate, round(avg(CAST(bytes_extracted > 0 AS INT)) FILTER (ok), 4) AS content_rate, round(avg(CAST(link_count > 0 AS INT)) FILTER (ok), 4) AS links_rate FROM runs LEFT JOIN canonical USING (url) GROUP BY tool""")
def bench_quality(spark, sf_dir):
    canonical = spark.range(40).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.concat(F.lit("TITLE "), F.col("id").cast("string")).alias("title"))
    return benchmark.summarize(_runs(spark, sf_dir), canonical).select("tool", "title_match_rate", "content_rate", "links_rate")


@query(f"WITH f AS (SELECT {STATUS_SQL} AS status_code, strlen(html) AS n FROM pages) SELECT 'http' AS mode, status_code, count(*) AS fetches, CAST(sum(n) AS BIGINT) AS bytes FROM f GROUP BY status_code")
def mode_status_metrics(spark, sf_dir):
    return _fetches(spark, sf_dir).groupBy("mode", "status_code").agg(F.count("*").alias("fetches"), F.sum(F.octet_length("html")).cast("long").alias("bytes"))


from . import catalog_requests, catalog_site  # noqa: E402, F401  they register their queries
