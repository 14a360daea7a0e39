"""Queries over links between pages, site rules, reports of several levels, sketches and the SQL surface."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import HOST_SQL, LINKS_SQL, _events, _ladder_sql, pages, query
from .functions import sql as surface
from .functions import urls as U
from .operators import benchmark, crawl, links, rules
from .operators.order import running
from .plans import requests as R
from .sources.tables import cut, fetches_from_pages, spread


@query(r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a href="(/[^"]*)"', 1)) AS href FROM pages)
SELECT DISTINCT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || href AS link FROM l""")
def resolved_links(spark, sf_dir):
    """Every page's links as absolute URLs."""
    return links.page_links(spread(pages(spark, sf_dir)))


def _linked(spark, sf_dir) -> DataFrame:
    """Pages that link, in all manners of writing, to the page before them on their host and to one of another host."""
    i = F.col("page_id")
    d = spread(pages(spark, sf_dir)).withColumn("host", U.host_key("url"))
    n = d.agg((F.max("page_id") + 1).alias("n"))
    d = running(d, "near", F.col("url"), ("page_id",), ("host",), "last", own=False).crossJoin(F.broadcast(n)).withColumn("to", (i * 7 + 3) % F.col("n"))
    d = d.join(pages(spark, sf_dir).select(F.col("page_id").alias("to"), F.col("url").alias("far")), "to", "left")

    def written(url, form):
        plain = F.regexp_replace(url, "#.*", "")
        scheme, host, rest = (F.regexp_extract(plain, "^([a-z]+)://([^/]+)(.*)", k) for k in (1, 2, 3))
        port = F.when(scheme == "http", ":80").otherwise(":443")
        more = F.concat(plain, F.when(F.instr(plain, "?") > 0, "&amp;").otherwise("?"), F.lit("utm_medium=a&GCLID=7"))
        return F.when(form == 0, F.concat(plain, F.lit("#part"))).when(form == 1, more).when(form == 2, F.concat(F.upper(scheme), F.lit("://u:p@"), F.upper(host), port, rest)).when(form == 3, F.concat(F.lit("/x/.././."), rest)).otherwise(F.concat(F.lit(" ../../../"), F.ltrim(rest, F.lit("/")), F.lit(" ")))

    def anchor(url, quote):
        return F.coalesce(F.concat(F.lit("<A class=x HREF = "), quote, url, quote, F.lit(">more</A>")), F.lit(""))

    quote = F.when(i % 2 == 0, '"').otherwise("'")
    hidden = F.lit("<!-- <a href='/hidden'>x</a> --><a name=x>y</a><a href='mailto:a@b.c'>z</a><script>'<a href=\"/s\">'</script>")
    return d.select("page_id", "url", F.concat("html", anchor(written(F.col("near"), i % 5), quote), hidden, anchor(written(F.col("far"), i % 3), quote)).alias("html"))


#: Pages by key, and the links between them as they were put in.
EDGES_SQL = rf"""n AS (SELECT max(page_id) + 1 AS n FROM pages),
k AS (SELECT page_id, url, {HOST_SQL} AS host, {HOST_SQL} || rtrim(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/') || CASE WHEN contains(url, 'page=2') THEN '?page=2' ELSE '' END AS key FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY key) AS first FROM k),
edges AS (SELECT src, f.first AS dst FROM (SELECT page_id AS src, lag(page_id) OVER (PARTITION BY host ORDER BY page_id) AS dst FROM k UNION ALL SELECT page_id, (page_id * 7 + 3) % n FROM pages, n) e JOIN f ON f.page_id = e.dst GROUP BY ALL)"""


@query(f"WITH {EDGES_SQL} SELECT src, dst FROM edges")
def page_edges(spark, sf_dir):
    """The links of pages that lead to pages."""
    return links.page_edges(_linked(spark, sf_dir))


@query(f"""WITH RECURSIVE {EDGES_SQL},
walk(seed, page, depth) AS (SELECT page_id, page_id, 0 FROM pages UNION SELECT w.seed, e.dst, w.depth + 1 FROM walk w JOIN edges e ON w.page = e.src WHERE w.depth < 3),
ranked AS (SELECT seed, page, depth, row_number() OVER (PARTITION BY seed ORDER BY depth, page) AS place FROM (SELECT seed, page, min(depth) AS depth FROM walk GROUP BY seed, page))
SELECT seed, page, depth, place FROM ranked WHERE place <= 6""")
def page_crawl(spark, sf_dir):
    """Crawls of six pages over the links that pages have."""
    seeds = pages(spark, sf_dir).select(F.col("page_id").alias("seed"), F.col("page_id").alias("page"))
    return crawl.crawl(seeds, cut(links.page_edges(_linked(spark, sf_dir))), 3, 6)


def _crawl_requests(spark, sf_dir) -> DataFrame:
    """A crawl request for every page, with options of its own; a ninth has no target, a third asks for one page alone."""
    i = F.col("page_id")
    fit = F.when(i % 4 == 0, F.struct(F.lit(0.9).alias("pruning_threshold"), F.lit(None).cast("string").alias("pruning_type"), F.lit(0).cast("long").alias("min_word_threshold")))
    alone = i % 3 == 0
    return pages(spark, sf_dir).select(i.alias("index"), F.when(i % 9 == 4, F.concat(F.lit("ftp://"), F.col("url"))).otherwise(F.col("url")).alias("url"), F.when(alone, 0).otherwise(2).alias("max_depth"), F.when(alone, 1).otherwise(5).alias("max_pages"), (i % 2 == 0).alias("include_content"), (i % 5 == 0).alias("include_markdown"), fit.alias("fit_markdown"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, came AS (SELECT page_id FROM pages WHERE page_id % 5 <> 2), e AS (SELECT src, dst FROM edges SEMI JOIN came ON src = page_id WHERE dst % 5 <> 2),
walk(seed, page, depth) AS (SELECT page_id, page_id, 0 FROM came UNION SELECT w.seed, e.dst, w.depth + 1 FROM walk w JOIN e ON w.page = e.src WHERE w.depth < 2 AND w.seed % 3 <> 0),
ranked AS (SELECT seed, page, row_number() OVER (PARTITION BY seed ORDER BY depth, page) AS place FROM (SELECT seed, page, min(depth) AS depth FROM walk GROUP BY seed, page)),
crawled AS (SELECT * FROM ranked WHERE place <= 5),
c AS (SELECT seed, count(DISTINCT page) AS fetched, count(DISTINCT e.dst) AS seen FROM crawled LEFT JOIN edges e ON e.src = page GROUP BY seed),
p AS (SELECT page_id AS index, page_id % 9 <> 4 AS ok, url, coalesce(fetched, 0) AS fetched, coalesce(seen, 0) AS seen, fetched IS NULL AND page_id % 3 = 0 AND page_id % 2 = 0 AS alone FROM pages LEFT JOIN c ON seed = page_id),
all_pages AS (SELECT seed, place, page FROM crawled UNION ALL SELECT index, 1, index FROM p WHERE alone),
urls AS (SELECT seed, string_agg(q.url || ' ' || strlen(html) || CASE WHEN seed % 2 = 0 THEN ' html' ELSE '' END || CASE WHEN seed % 5 = 0 THEN ' markdown' ELSE '' END, ', ' ORDER BY place) AS told FROM all_pages JOIN pages q ON q.page_id = page GROUP BY seed)
SELECT index, CASE WHEN ok THEN url END AS root_url, CASE WHEN ok THEN CASE WHEN alone THEN 1 ELSE fetched END END AS pages_fetched, CASE WHEN ok THEN CASE WHEN alone THEN greatest(seen, 1) ELSE seen END END AS unique_links_seen,
 CASE WHEN ok THEN coalesce(told, '') END AS told, CASE WHEN NOT ok THEN 'url must use http or https' END AS error FROM p LEFT JOIN urls ON seed = index""")
def crawl_responses(spark, sf_dir):
    """The whole answer to a crawl request for every page: a fifth of the pages can't be crawled, and where one such is all that is asked for, half of them come when fetched alone."""
    asked = R.crawl_plan(_crawl_requests(spark, sf_dir))
    edges, page = cut(links.page_edges(_linked(spark, sf_dir))), pages(spark, sf_dir)
    seeds = asked.select(F.col("index").alias("seed"), F.col("index").alias("page"), "max_depth", "max_pages").where("page % 5 <> 2")
    crawled = crawl.crawl(seeds, edges.where("src % 5 <> 2 and dst % 5 <> 2"), 2, 5)
    counts = crawl.links_seen(crawled, edges).join(crawled.groupBy("seed").agg(F.count("*").alias("pages_fetched")), "seed")
    every = asked.select(F.col("index").alias("seed"), "max_depth", "max_pages").join(counts, "seed", "left").fillna(0, ["pages_fetched", "unique_links_seen"])
    single = page.where("page_id % 2 = 0").select(F.col("page_id").alias("seed"), F.col("page_id").alias("page"))
    whole = crawl.with_recovery(every, single, F.col("max_depth"), F.col("max_pages"))
    recovered = whole.where("recovered is not null").select("seed", F.col("recovered").alias("page"), F.lit(1).cast("long").alias("place"))
    told = crawl.crawl_pages(crawled.select("seed", "page", "place").unionByName(recovered), fetches_from_pages(page), asked)
    out = crawl.crawl_answers(asked, told, whole)
    line = F.transform("pages", lambda p: F.concat(p["url"], F.lit(" "), p["bytes"].cast("string"), F.when(p["content"].isNotNull(), " html").otherwise(""), F.when(p["markdown"].isNotNull(), " markdown").otherwise("")))
    return out.select("index", "root_url", "pages_fetched", "unique_links_seen", F.array_join(line, ", ").alias("told"), "error")


RULES_SQL = f"""h AS (SELECT DISTINCT {HOST_SQL} AS host FROM pages),
rules AS (SELECT DISTINCT regexp_extract(host, '[^.]+\\.[^.]+$') AS domain, '' AS prefix, 'site' AS profile FROM h
 UNION ALL SELECT host, '/en', 'docs' FROM h WHERE length(host) % 2 = 0 UNION ALL SELECT host, '/fr/', 'article' FROM h WHERE length(host) % 3 = 0
 UNION ALL SELECT DISTINCT regexp_extract(host, '[^.]+\\.[^.]+\\.[^.]+$'), '/en', 'repo' FROM h UNION ALL SELECT '', '/de/6', 'minimal' UNION ALL SELECT '', '/de', 'balanced')"""


def _rules(spark, sf_dir) -> DataFrame:
    """Rules for hosts, their domains and paths."""
    h = pages(spark, sf_dir).select(U.host_key("url").alias("host")).distinct()
    put = lambda df, domain, prefix, profile: df.select(domain.alias("domain"), F.lit(prefix).alias("path_prefix"), F.lit(profile).alias("profile")).distinct()
    last = lambda n: F.regexp_extract("host", r"[^.]+" + r"\.[^.]+" * (n - 1) + "$", 0)
    one, every = spark.range(1), F.lit(None).cast("string")
    out = put(h, last(2), "", "site")
    for part in (put(h.where("length(host) % 2 = 0"), F.col("host"), "/en", "docs"), put(h.where("length(host) % 3 = 0"), F.upper("host"), "/fr/", "article"), put(h, last(3), "/en", "repo"), put(one, every, "/de/6", "minimal"), put(one, F.lit(""), "/de", "balanced")):
        out = out.unionByName(part)
    return out.withColumn("rule_id", F.concat_ws("|", "profile", F.lower(F.coalesce("domain", F.lit("")))))


@query(f"""WITH {RULES_SQL}, p AS (SELECT page_id, {HOST_SQL} AS host, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages),
m AS (SELECT page_id, profile || '|' || domain AS rule_id, profile, row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC, length(rtrim(prefix, '/')) DESC, profile || '|' || domain) AS k
 FROM p LEFT JOIN rules ON (domain = '' OR host = domain OR ends_with(host, '.' || domain)) AND (prefix = '' OR path = rtrim(prefix, '/') OR starts_with(path, rtrim(prefix, '/') || '/')))
SELECT page_id, rule_id, profile FROM m WHERE k = 1""")
def site_rules(spark, sf_dir):
    """The rule that holds for every page."""
    return rules.match_rules(pages(spark, sf_dir).select("page_id", "url"), _rules(spark, sf_dir)).select("page_id", "rule_id", "profile")


def _reported(spark, sf_dir) -> DataFrame:
    """Events as benchmark runs: three iterations of fifty URLs, one of which is null."""
    i = F.col("event_id")
    return _events(spark, sf_dir).select(i.alias("run_id"), "ts", F.col("event_type").alias("tool"), F.when(i % 50 != 49, F.concat(F.lit("u"), (i % 50).cast("string"))).alias("url"), (F.floor(i / 50) % 3).cast("long").alias("iteration"), (i % 7 != 0).alias("ok"), F.round("value", 3).alias("duration_s"), (i % 5 == 0).alias("used_browser"), F.concat(F.lit("h"), (i % 50).cast("string"), F.when(i % 331 == 0, "x").otherwise("")).alias("content_hash"))


REPORTED_SQL = """WITH r AS (SELECT event_type AS tool, CASE WHEN event_id % 50 <> 49 THEN 'u' || (event_id % 50) END AS url, event_id // 50 % 3 AS iteration, event_id % 7 <> 0 AS ok, round(value, 3) AS duration_s, event_id % 5 = 0 AS used_browser, ts, 'h' || (event_id % 50) || CASE WHEN event_id % 331 = 0 THEN 'x' ELSE '' END AS content_hash FROM events)
"""


@query(REPORTED_SQL + """SELECT CAST(grouping(tool, url, iteration) AS BIGINT) AS level, tool, url, iteration, count(*) AS runs, count(*) FILTER (ok) AS successes, CAST(sum(CAST(round(duration_s * 1000) AS BIGINT)) FILTER (ok) AS BIGINT) AS total_ms
FROM r GROUP BY GROUPING SETS ((tool, url, iteration), (tool, url), (tool, iteration), (tool), ())""")
def runs_rollup(spark, sf_dir):
    """Benchmark runs by tool, URL and iteration, with all totals."""
    return benchmark.rolled_up(_reported(spark, sf_dir)).drop("avg_latency")


@query(REPORTED_SQL + "SELECT tool, count(*) AS runs, round(avg(CAST(used_browser AS INT)), 4) AS fallback_rate, true AS median_within, true AS p95_within, true AS urls_within FROM r GROUP BY tool")
def sketched_report(spark, sf_dir):
    """Latency quantiles and numbers of URLs of each tool from its days' sketches, held against their exact ranks and numbers."""
    runs = _reported(spark, sf_dir)
    told = benchmark.sketched_summary(benchmark.daily_sketches(runs)).withColumnRenamed("urls", "about")
    exact = runs.join(told.select("tool", "median_latency", "p95_latency"), "tool").groupBy("tool").agg(
        F.count_if(F.expr("ok and duration_s is not null")).alias("n"), F.count_distinct("url").alias("urls"),
        *[F.count_if(F.expr(f"ok and duration_s {sign} {q}_latency")).alias(f"{q}_{name}") for q in ("median", "p95") for sign, name in (("<", "below"), ("<=", "upto"))],
    )
    within = [((F.col(f"{q}_below") <= (at + benchmark.RANK_ERROR) * F.col("n")) & (F.col(f"{q}_upto") >= (at - benchmark.RANK_ERROR) * F.col("n"))).alias(f"{q}_within") for q, at in (("median", 0.5), ("p95", 0.95))]
    near = (F.abs(F.col("about") - F.col("urls")) <= benchmark.DISTINCT_ERROR * F.col("urls")).alias("urls_within")
    return told.join(exact, "tool").select("tool", "runs", F.round("fallback_rate", 4).alias("fallback_rate"), *within, near)


@query(REPORTED_SQL + """, u AS (SELECT tool, url, count(DISTINCT content_hash) AS hashes FROM r WHERE ok AND url IS NOT NULL GROUP BY tool, url HAVING count(*) > 1)
SELECT tool, count(*) AS urls, count(*) FILTER (hashes = 1) AS stable_urls, round(count(*) FILTER (hashes = 1) / count(*), 4) AS stability FROM u GROUP BY tool""")
def content_stability(spark, sf_dir):
    """How many pages gave the same content in all their runs."""
    return benchmark.stability(_reported(spark, sf_dir).where("url is not null"))


LADDER = """
SELECT t.* FROM page_climb_ladder(TABLE(
  SELECT page_id AS request_id, element_at(array('http', 'auto', 'browser'), CAST(page_id % 3 + 1 AS INT)) AS mode, CAST(page_id % 5 AS INT) AS host_score, rung,
    CASE WHEN state <> 0 THEN page_id * 10 + rung END AS page_id, state = 1 AS weak, CASE WHEN state = 1 OR page_id % (rung + 3) = 0 THEN 'http_low_words' END AS auto_reason, CASE WHEN page_id % 2 = 0 THEN 'http_challenge' ELSE 'http_low_words' END AS http_reason
  FROM (SELECT page_id, rung, CAST(floor(page_id / shiftleft(1, rung)) AS BIGINT) % 3 AS state FROM {pages} LATERAL VIEW explode(array(0, 1, 2, 3, 4)) r AS rung)
) PARTITION BY request_id ORDER BY rung) AS t"""


@query(f"SELECT page_id AS request_id, chosen, used_browser, reason, mode_used, failed FROM ({_ladder_sql()})")
def ladder_in_sql(spark, sf_dir):
    """The fetch ladder's answers by Spark SQL alone, with the attempts' table function."""
    surface.register(spark)
    return spark.sql(LADDER, pages=pages(spark, sf_dir))


@query(f"SELECT {HOST_SQL} AS host, count(*) AS pages, CAST(sum({LINKS_SQL}) AS BIGINT) AS links, count(*) FILTER (page_id % 10 IN (4, 6, 7, 8, 9)) AS retried FROM pages GROUP BY ALL")
def hosts_in_sql(spark, sf_dir):
    """Pages, links and statuses to try again of every host, by Spark SQL with the engine's functions."""
    surface.register(spark)
    return spark.sql("""SELECT page_host_key(url) AS host, count(*) AS pages, CAST(sum(regexp_count(html, '(?i)<a\\\\b[^>]*\\\\shref\\\\s*=')) AS BIGINT) AS links,
      count_if(page_retry_status(element_at(array(200, 200, 200, 301, 403, 404, 410, 429, 500, 503), CAST(page_id % 10 + 1 AS INT)))) AS retried FROM {pages} GROUP BY 1""", pages=pages(spark, sf_dir))
