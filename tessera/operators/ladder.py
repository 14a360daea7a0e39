"""The fetch ladder: which of a request's attempts is its page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contract as C

# fixed value: failures of a host from which a browser comes first
FORCE_BROWSER = 3


def recovered_page(candidates: DataFrame) -> DataFrame:
    """Of each request's candidates (request_id, position, url, final_url, target, direct, status_code, html): the direct fetch if it is good, else the first whose url fits the target, else the first of the crawl, else the direct one."""
    from ..functions.urls import urls_match

    good = F.col("direct") & F.col("status_code").between(200, 299) & (C.trim_space(F.coalesce("html", F.lit(""))) != "")
    fits = ~F.col("direct") & (urls_match("url", "target") | urls_match("final_url", "target"))
    rank = F.when(good, 0).when(fits, 1).when(~F.col("direct"), 2).otherwise(3)
    cols = [c for c in candidates.columns if c != "request_id"]
    return candidates.groupBy("request_id").agg(F.min_by(F.struct(*cols), F.struct(rank, F.col("position"))).alias("p")).select("request_id", "p.*")


def last_page(pages: DataFrame) -> DataFrame:
    """The last page (by seq) that a browser told for each request."""
    cols = [c for c in pages.columns if c != "request_id"]
    return pages.groupBy("request_id").agg(F.max_by(F.struct(*cols), F.col("seq")).alias("p")).select("request_id", "p.*")


def page_by_mode(mode: Column, http: Column, browser: Column, need: Column) -> Column:
    """The single page of a mode: auto takes the browser's where the http page is missing, not 2xx or, if content is needed, empty."""
    weak = C.page_needs_browser(http.isNotNull(), http["status_code"], http["html"], need)
    return F.when(mode == "browser", browser).when((mode == "auto") & weak, F.coalesce(browser, http)).otherwise(http)


def rungs(fetches: DataFrame) -> DataFrame:
    """fetches (request_id, attempt, mode, crawl_mode, ...) with the rung, 0 to 4, that each attempt is, null for those beyond.

    A browser before the first http attempt is rung 0, the first three http attempts
    are 1 to 3, a browser after them is 4; where a browser is all that is asked for,
    its pages are 4.
    """
    own = Window.partitionBy("request_id")
    http = F.col("mode") != "browser"
    so_far = F.count_if(http).over(own.orderBy("attempt", "mode", "final_url").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rung = F.when(http, F.when(so_far <= 3, so_far)).when((F.col("crawl_mode") != "browser") & (so_far == 0) & (F.count_if(http).over(own) > 0), 0).otherwise(4)
    return fetches.withColumn("rung", F.when(F.col("attempt").isNotNull(), rung).cast("int"))


def climb(requests: DataFrame) -> DataFrame:
    """The ladder as columns.

    requests: mode, host_score, need, reason_of (see below) and rungs r0..r4, each a
    struct(page_id, has_page, weak, auto_reason, http_reason) or null where that
    attempt gave nothing. r0: browser for a host that fails; r1, r2, r3: http;
    r4: browser. In browser mode r4 is the page.

    Adds chosen (the rung's struct), used_browser, reason, mode_used and failed.
    """
    auto_like = F.col("mode") != "browser"
    weak = lambda c: c.isNull() | F.coalesce(c["weak"], F.lit(True))
    forced = auto_like & (F.col("host_score") >= FORCE_BROWSER)
    df = requests.withColumn("cur0", F.when(forced, F.col("r0")))
    df = df.withColumn("used0", forced & F.col("cur0").isNotNull())
    df = df.withColumn("cur1", F.when(weak(F.col("cur0")), F.col("r1")).otherwise(F.col("cur0")))
    df = df.withColumn("cur2", F.when(weak(F.col("cur1")), F.col("r2")).otherwise(F.col("cur1")))
    df = df.withColumn("cur3", F.when(weak(F.col("cur2")), F.col("r3")).otherwise(F.col("cur2")))
    missing = F.col("cur3").isNull()
    auto = F.when(missing, "http_empty").otherwise(F.col("cur3")["auto_reason"])
    http = F.when(weak(F.col("cur3")), F.when(missing, "http_low_words").otherwise(F.col("cur3")["http_reason"]))
    wanted = F.when(F.col("mode") == "auto", auto).otherwise(http)
    df = df.withColumn("asked", F.when(auto_like, wanted))
    took = F.col("asked").isNotNull() & F.col("r4").isNotNull()
    chosen = F.when(~auto_like, F.col("r4")).when(took, F.col("r4")).otherwise(F.col("cur3"))
    used = F.when(~auto_like, F.lit(True)).otherwise(took | F.col("used0"))
    reason = F.coalesce(F.col("asked"), F.when(forced, F.lit("http_blocked")))
    df = df.withColumns({"chosen": chosen, "used_browser": used, "reason": C.reported_reason(F.when(auto_like, reason), used), "mode_used": F.when(~auto_like, F.lit("browser")).otherwise(C.mode_used(F.col("mode"), used))})
    return df.withColumn("failed", weak(F.col("chosen"))).drop("cur0", "used0", "cur1", "cur2", "cur3", "asked")
