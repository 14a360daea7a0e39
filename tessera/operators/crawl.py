"""Bounded crawls over a table of links, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contract as C
from ..sources.tables import cut


def in_scope(edges: DataFrame, hosts: DataFrame, subdomains: bool = False) -> DataFrame:
    """The links that stay on their page's host or, with subdomains, on hosts of the same two last labels. hosts: (page, host).

    As a crawl starts on its own host and never leaves it, links can be told once,
    for all crawls.
    """
    site = (lambda c: F.regexp_extract(c, r"([^.]+\.)?[^.]+\z", 0)) if subdomains else (lambda c: c)
    own = hosts.select("page", site(F.col("host")).alias("site"))
    out = edges.join(own.select(F.col("page").alias("src"), F.col("site").alias("__from")), "src").join(own.select(F.col("page").alias("dst"), F.col("site").alias("__to")), "dst")
    return out.where("__from = __to").select("src", "dst")


def crawl(seeds: DataFrame, edges: DataFrame, max_depth: int = 2, max_pages: int = 100) -> DataFrame:
    """Pages of each crawl: seed, page, depth and place.

    seeds: (seed, page), with limits of their own in max_depth and max_pages where
    these columns are there, the arguments then being the most; edges: (src, dst), a
    table, as every level reads it (cut what is costly to make).
    Breadth first to max_depth, at most max_pages of each seed in the order of
    (depth, page). Every level is one join with the links and one anti-join with
    what has been seen; a crawl that has its pages goes no further, so that no level
    holds more than max_pages pages of a seed.
    """
    limit = lambda name, most: F.least(F.col(name), F.lit(most)).cast("long") if name in seeds.columns else F.lit(most).cast("long")
    keep = ["seed", "page", "depth", "place"]

    def placed(df, depth):
        rank = F.row_number().over(Window.partitionBy("seed").orderBy("page"))
        df = df.withColumn("rank", rank).where(F.col("rank") <= max_pages).withColumn("place", F.col("n") + F.col("rank")).where("place <= most")
        return df.select("seed", "page", F.lit(depth).alias("depth"), "place", "deep", "most", F.max("place").over(Window.partitionBy("seed")).alias("n"))

    first = seeds.select("seed", "page", limit("max_depth", max_depth).alias("deep"), limit("max_pages", max_pages).alias("most"), F.lit(0).cast("long").alias("n")).distinct()
    frontier = placed(first, 0)
    seen = frontier.select(*keep)
    for level in range(1, max_depth + 1):
        going = frontier.where((F.col("n") < F.col("most")) & (F.col("deep") >= level))
        step = going.join(edges, going["page"] == edges["src"]).select("seed", F.col("dst").alias("page"), "deep", "most", "n").distinct()
        frontier = cut(placed(step.join(seen.select("seed", "page"), ["seed", "page"], "left_anti"), level))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select(*keep))
    return seen.withColumn("place", F.col("place").cast("long"))


def crawl_by_mode(seeds: DataFrame, http_edges: DataFrame, browser_edges: DataFrame, max_depth: int = 2, max_pages: int = 100, min_pages: int = 1, min_links: int = 20) -> DataFrame:
    """Pages of each crawl under its mode: seed, page, depth, place, used_browser.

    seeds: (seed, page, mode). http and auto follow the links of plain fetches,
    browser those that a browser sees; an auto crawl of few pages or links is run
    again by a browser, whose pages replace it.
    """
    plain = crawl(seeds.where("mode <> 'browser'"), http_edges, max_depth, max_pages)
    weak = crawl_summary(plain, http_edges, min_pages, min_links).where("needs_browser").select("seed")
    again = seeds.where("mode = 'auto'").join(weak, "seed", "left_semi")
    seen = crawl(seeds.where("mode = 'browser'").unionByName(again), browser_edges, max_depth, max_pages)
    return plain.join(again, "seed", "left_anti").withColumn("used_browser", F.lit(False)).unionByName(seen.withColumn("used_browser", F.lit(True)))


def crawl_pages(crawled: DataFrame, fetches: DataFrame, plan: DataFrame) -> DataFrame:
    """The pages of each crawl's answer: seed, place and page.

    crawled: (seed, page, place); fetches: one per page (request_id = page); plan:
    of crawl_plan, index = seed. Content is html, Markdown that of the request's own
    options (fit), without a profile. A page is parsed once for each way in which
    crawls ask for it, however many have it.
    """
    from .scrape import mapped_page, rendered, with_signals

    way = ["include_content", "want_markdown", "max_content_chars", "fit"]
    asked = plan.where("error is null").select(F.col("index").alias("seed"), "include_content", F.col("include_markdown").alias("want_markdown"), "max_content_chars", "fit")
    rows = crawled.select("seed", "place", F.col("page").alias("request_id")).join(asked, "seed")
    once = rows.select("request_id", *way).distinct()
    signals = F.struct(F.col("signals.link_count").alias("link_count"))  # the others aren't told, so that they aren't computed
    got = with_signals(fetches).select("request_id", "url", "final_url", "status_code", "html", "error_status", signals.alias("signals"), F.lit(True).alias("supported"))
    shown = rendered(once.join(got, "request_id"), F.col("fit"), F.lit("html")).select("request_id", *way, mapped_page().alias("page"))
    return rows.join(shown, ["request_id", *way]).select("seed", "place", "page")


def crawl_answers(plan: DataFrame, pages: DataFrame, counts: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """The whole answer to each request of plan (of crawl_plan), in the order of index: index, root_url, crawl_duration_ms, pages_fetched, unique_links_seen, pages, error.

    pages: (seed, place, page); counts: (seed, pages_fetched, unique_links_seen), as
    they are after recovery; durations: (seed, ms). An answer holds at most max_pages
    pages, which is what bounds its row. A request with an error has nothing else; one
    that fetched nothing has no pages and is no error.
    """
    own = pages.groupBy("seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "page"))), lambda x: x["page"]).alias("pages"))
    told = counts.select(F.col("seed").alias("index"), "pages_fetched", "unique_links_seen").join(own.withColumnRenamed("seed", "index"), "index", "left")
    out = plan.select("index", F.col("url").alias("root_url"), "error").join(told, "index", "left")
    if durations is None:
        out = out.withColumn("ms", F.lit(0).cast("long"))
    else:
        out = out.join(durations.select(F.col("seed").alias("index"), "ms"), "index", "left")
    ok = F.col("error").isNull()
    numbers = {"ms": "crawl_duration_ms", "pages_fetched": "pages_fetched", "unique_links_seen": "unique_links_seen"}
    return out.select("index", F.when(ok, F.col("root_url")).alias("root_url"), *[F.when(ok, F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(n) for c, n in numbers.items()], F.when(ok, F.coalesce("pages", F.array().cast(own.schema["pages"].dataType))).alias("pages"), "error").orderBy("index")


def links_seen(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct links of each crawl's pages: seed, unique_links_seen."""
    return pages.join(edges, pages["page"] == edges["src"], "left").groupBy("seed").agg(F.count_distinct("dst").alias("unique_links_seen"))


def crawl_summary(pages: DataFrame, edges: DataFrame, min_pages: int = 1, min_links: int = 20) -> DataFrame:
    """Each crawl's pages, links and whether a browser would run it again."""
    n = pages.groupBy("seed").agg(F.count("*").alias("pages_fetched"), F.max("depth").alias("max_depth"))
    out = n.join(links_seen(pages, edges), "seed")
    return out.withColumn("needs_browser", C.crawl_needs_browser(F.col("pages_fetched"), F.col("unique_links_seen"), min_pages, min_links))


def crawl_counts(crawled: DataFrame, links: DataFrame) -> DataFrame:
    """(seed, pages_fetched, unique_links_seen) of crawls (seed, page, used_browser) over the links (src, dst, used_browser) that each way of fetching sees."""
    j = crawled.join(links, (crawled["page"] == links["src"]) & (crawled["used_browser"] == links["used_browser"]), "left")
    n = crawled.groupBy("seed").agg(F.count("*").alias("pages_fetched"))
    return n.join(j.groupBy("seed").agg(F.count_distinct("dst").alias("unique_links_seen")), "seed")


def with_recovery(crawled: DataFrame, single: DataFrame, depth: int | Column, pages: int | Column) -> DataFrame:
    """Crawls of one page without depth that fetched nothing take the page fetched alone.

    crawled: (seed, pages_fetched, unique_links_seen, ...); single: (seed, page);
    depth, pages: what was asked for, of all crawls or as columns of crawled.
    """
    depth, pages = (c if isinstance(c, Column) else F.lit(c) for c in (depth, pages))
    rows = crawled.withColumn("__alone", (depth == 0) & (pages == 1) & (F.col("pages_fetched") == 0))
    j = rows.join(single.select("seed", F.col("page").alias("alone")), "seed", "left")
    took = F.col("__alone") & F.col("alone").isNotNull()
    return j.select("seed", F.when(took, 1).otherwise(F.col("pages_fetched")).cast("long").alias("pages_fetched"), F.when(took, F.greatest("unique_links_seen", F.lit(1))).otherwise(F.col("unique_links_seen")).cast("long").alias("unique_links_seen"), F.when(took, F.col("alone")).cast("long").alias("recovered"))
