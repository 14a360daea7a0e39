"""Request plans: defaults, limits and what a fetch would be told, as native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import PROFILES
from ..functions.proxies import rotated
from ..functions.urls import url_error

# fixed values: name -> (default, least, most); sizes of batches; proxies of a list
LIMITS = {
    "max_depth": (2, 0, 6),
    "max_pages": (100, 1, 5000),
    "crawl_concurrency": (16, 1, 256),
    "request_timeout_secs": (10, 1, 60),
    "crawl_timeout_secs": (30, 1, 300),
    "max_content_chars": (4000, 1, 100_000),
}
BATCH = {"default": 4, "most": 64, "global_concurrency": 16, "per_host_concurrency": 4}
MOST_PROXIES = 128
# fixed values: how redirects are followed
REDIRECTS = ("loose", "strict", "none")
# fixed values: headers of the camoufox_like profile
CAMOUFOX_USER_AGENT = "Mozilla/5.0 (X11; Linux x86_64; rv:128.0) Gecko/20100101 Firefox/128.0"
CAMOUFOX_REFERER = "https://www.google.com/"


def clamp(value: Column, least: Column | int, most: Column | int) -> Column:
    """Raised to least, then lowered to most, which wins where the two cross."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(F.greatest(value, lit(least)), lit(most))


def limited(name: str, limits: dict | None = None) -> Column:
    default, least, most = (limits or LIMITS)[name]
    return clamp(F.coalesce(F.col(name), F.lit(default)).cast("long"), least, most)


def field(df: DataFrame, name: str, kind: str, default=None) -> Column:
    c = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
    return c if default is None else F.coalesce(c, F.lit(default).cast(kind))


def fit_options(threshold: Column, kind: Column, min_words: Column, profile: Column) -> Column:
    """struct(pruning_threshold, pruning_type, min_word_threshold): a profile counts only where the options are the defaults."""
    d_threshold, d_kind, d_words = PROFILES["balanced"]
    default = threshold.eqNullSafe(F.lit(d_threshold)) & kind.eqNullSafe(F.lit(d_kind)) & min_words.eqNullSafe(F.lit(d_words))
    out = F.struct(threshold.alias("pruning_threshold"), kind.alias("pruning_type"), min_words.cast("long").alias("min_word_threshold"))
    for name, (t, k, w) in PROFILES.items():
        if name != "balanced":
            preset = F.struct(F.lit(t).alias("pruning_threshold"), F.lit(k).alias("pruning_type"), F.lit(w).cast("long").alias("min_word_threshold"))
            out = F.when(default & profile.eqNullSafe(F.lit(name)), preset).otherwise(out)
    return out


def asked_fit(requests: DataFrame) -> Column:
    """A request's own struct fit_markdown; what it doesn't tell is the default. A null min_word_threshold is the default too, 0 asks for none."""
    threshold, kind, words = PROFILES["balanced"]
    own = field(requests, "fit_markdown", "struct<pruning_threshold: double, pruning_type: string, min_word_threshold: long>")
    return F.struct(F.coalesce(own["pruning_threshold"], F.lit(threshold)).alias("pruning_threshold"), F.coalesce(F.lower(own["pruning_type"]), F.lit(kind)).alias("pruning_type"), F.coalesce(own["min_word_threshold"], F.lit(words)).cast("long").alias("min_word_threshold"))


def browser_timeouts(request: Column, crawl: Column, page_timeout: Column) -> tuple[Column, Column]:
    """Both timeouts, lowered to the page's own where one is given."""
    lower = lambda t: F.when(page_timeout.isNull(), t).otherwise(clamp(page_timeout, 1, F.greatest(t, F.lit(1))))
    return lower(request), lower(crawl)


def browser_waits(selector: Column, selector_timeout: Column, wait_ms: Column, wait_for: Column, request: Column, crawl: Column, width: Column, height: Column, screenshot: Column) -> Column:
    load = F.lower(wait_for)
    return F.struct(
        F.when(selector.isNotNull() & (selector != ""), F.greatest(F.coalesce(selector_timeout, F.lit(30)), F.lit(1))).alias("selector_secs"),
        F.when(wait_ms > 0, wait_ms).alias("delay_ms"),
        F.when(load == "networkidle", F.greatest(crawl, F.lit(5))).alias("idle_secs"),
        F.when(load == "load", F.greatest(request, F.lit(3))).alias("almost_idle_secs"),
        (width.isNotNull() & height.isNotNull()).alias("viewport"),
        F.coalesce(screenshot, F.lit(False)).alias("screenshot"),
    )


def browser_intercept(mode: Column, intercept: Column, block_javascript: Column, javascript_enabled: Column) -> Column:
    """What a browser is told to block, null in http mode."""
    js = F.when(javascript_enabled.isNotNull(), ~javascript_enabled).otherwise(F.coalesce(block_javascript, F.lit(False)))
    return F.when(mode.isin("browser", "auto"), F.struct(F.coalesce(intercept, F.lit(True)).alias("enabled"), js.alias("block_javascript")))


def header_profile(profile: Column, user_agent: Column, referer: Column) -> Column:
    """struct(modify_headers, user_agent, referer); camoufox_like overrides what the caller gave."""
    strong = profile == "camoufox_like"
    return F.struct(
        (profile != "off").alias("modify_headers"),
        F.when(strong, CAMOUFOX_USER_AGENT).otherwise(user_agent).alias("user_agent"),
        F.when(strong, CAMOUFOX_REFERER).otherwise(referer).alias("referer"),
    )


def redirect_policy(value: Column) -> tuple[Column, Column]:
    """The policy that a request names (null: the fetcher's own) and why it can't be followed, or null."""
    known = value.isin(*REDIRECTS)
    return F.when(known, value), F.when(value.isNotNull() & ~known, f"redirect_policy must be one of {', '.join(REDIRECTS)}")


def scrape_plan(requests: DataFrame, pool: list[str] | None = None, most_proxies: int = MOST_PROXIES) -> DataFrame:
    """requests with defaults and limits; missing columns count as null. A row whose url is no target has an error."""
    df, f = requests, lambda n, k, d=None: field(requests, n, k, d)
    full = df.select(*[c for c in df.columns if c in ("index", "url")], *[f(n, "long").alias(n) for n in ("request_timeout_secs", "crawl_timeout_secs", "max_content_chars")], f("crawl_mode", "string", "http").alias("crawl_mode"), f("response_format", "string", "text").alias("response_format"), f("include_content", "boolean", True).alias("include_content"), f("include_markdown", "boolean", False).alias("include_markdown"), f("respect_robots_txt", "boolean", True).alias("respect_robots_txt"), f("redirect_limit", "long", 10).alias("redirect_limit"), f("anti_bot_profile", "string", "camoufox_like").alias("anti_bot_profile"), f("user_agent", "string").alias("user_agent"), f("referer", "string").alias("referer"), f("redirect_policy", "string").alias("redirect_policy"), f("extraction_profile", "string").alias("extraction_profile"), f("required_text", "string").alias("required_text"), f("wait_for_selector", "string").alias("wait_for_selector"), f("auto_browser_min_words", "long", 150).alias("min_words"), f("auto_browser_min_main_content_score", "double", 0.45).alias("min_score"), f("auto_browser_blocked_statuses", "array<int>").alias("blocked_statuses"), f("proxies", "array<string>").alias("proxies"), f("cursor", "long", 0).alias("cursor"), asked_fit(df).alias("fit"))
    want = F.col("include_markdown") | (F.col("response_format") == "markdown")
    policy, bad_policy = redirect_policy(F.col("redirect_policy"))
    out = full.select(
        *[c for c in ("index", "url") if c in full.columns],
        F.coalesce(url_error("url"), bad_policy).alias("error"),
        *[limited(n).alias(n) for n in ("request_timeout_secs", "crawl_timeout_secs", "max_content_chars")],
        "crawl_mode", "response_format", "include_content", "respect_robots_txt", "redirect_limit", policy.alias("redirect_policy"), "extraction_profile", "required_text", "wait_for_selector", "min_words", "min_score", "blocked_statuses",
        want.alias("want_markdown"),
        fit_options(F.col("fit.pruning_threshold"), F.col("fit.pruning_type"), F.col("fit.min_word_threshold"), F.col("extraction_profile")).alias("fit"),
        (F.col("include_content") | want).alias("require_substantive"),
        header_profile(F.col("anti_bot_profile"), F.col("user_agent"), F.col("referer")).alias("headers"),
        (F.when(F.col("proxies").isNotNull(), F.col("proxies")).otherwise(rotated(F.array(*map(F.lit, pool)), F.col("cursor"), most_proxies)) if pool else F.col("proxies")).alias("proxies"),
    )
    return out


def crawl_plan(requests: DataFrame) -> DataFrame:
    f = lambda n, k, d=None: field(requests, n, k, d)
    full = requests.select(*[c for c in requests.columns if c in ("index", "url")], *[f(n, "long").alias(n) for n in LIMITS], f("include_content", "boolean", False).alias("include_content"), f("include_markdown", "boolean", False).alias("include_markdown"), f("respect_robots_txt", "boolean", True).alias("respect_robots_txt"), f("subdomains", "boolean", False).alias("subdomains"), f("redirect_limit", "long", 10).alias("redirect_limit"), f("redirect_policy", "string").alias("redirect_policy"), f("crawl_mode", "string", "http").alias("crawl_mode"), f("auto_browser_min_pages", "long", 1).alias("min_pages"), f("auto_browser_min_links", "long", 20).alias("min_links"), f("anti_bot_profile", "string", "basic").alias("anti_bot_profile"), asked_fit(requests).alias("fit"))
    policy, bad_policy = redirect_policy(F.col("redirect_policy"))
    return full.select(*[c for c in full.columns if c not in (*LIMITS, "redirect_policy")], policy.alias("redirect_policy"), F.coalesce(url_error("url"), bad_policy).alias("error"), *[limited(n).alias(n) for n in LIMITS])


def single_page(plan: DataFrame) -> DataFrame:
    """The crawl by which one page is fetched: no depth, one page, one at a time, links told."""
    return plan.withColumns({"max_depth": F.lit(0).cast("long"), "max_pages": F.lit(1).cast("long"), "crawl_concurrency": F.lit(1).cast("long"), "subdomains": F.lit(False), "return_page_links": F.lit(True)})
