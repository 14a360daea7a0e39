"""Fetches to scored and extracted pages.

A request's attempts are judged one by one, put on the rungs of the ladder, and the
page that it ends with is rendered. The attempts meet once, in a shuffle by request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contract as C
from ..functions import text as X
from . import dom, ladder

SIGNALS = ("word_count", "char_count", "unique_word_ratio", "boilerplate_ratio", "link_density", "heading_count", "code_block_count", "link_count", "content_density", "main_content_score", "blocked_likelihood", "fallback_reason", "truncated", "language")


#: Bytes of a batch of pages that goes to a Python worker, which holds it several times over, as pages, texts and Markdown.
BATCH_BYTES = 4 << 20


def native_signals(fetches: DataFrame, known: bool = False) -> DataFrame:
    """fetches with all signals that need no tree: plain, word_count, char_count, ratios, densities, challenge and language; known: word_count and challenge are there."""
    told = {"plain": X.plain_text("html")} | ({} if known else {"word_count": X.visible_word_count("html"), "challenge": X.challenge_hit("html")})
    return (
        fetches.withColumns(told)
        .withColumns({"char_count": F.length("plain").cast("long"), "unique_word_ratio": X.unique_word_ratio("plain"), "boilerplate_ratio": X.boilerplate_ratio("html", "word_count"), "content_density": X.content_density("html", "plain"), "language": X.language_hint("plain")})
    )


def zero_signals(reason: str) -> Column:
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    values = dict.fromkeys(SIGNALS, none) | dict.fromkeys(("word_count", "char_count", "heading_count", "code_block_count", "link_count"), zero) | {"fallback_reason": F.lit(reason), "truncated": F.lit(False), "language": F.lit(None).cast("string")}
    return F.struct(*[values[n].alias(n) for n in SIGNALS])


def _either(signals: list[Column], unsupported: Column, empty: Column) -> Column:
    """The struct of signals or zeros, chosen field by field, so that a field that nobody reads isn't computed."""
    fields = zip(SIGNALS, signals, strict=True)
    bad, none = zero_signals("http_unsupported_content_type"), zero_signals("http_empty")
    return F.struct(*[F.when(unsupported, bad[n]).when(empty, none[n]).otherwise(c).alias(n) for n, c in fields])


def link_count(links: Column, counted: Column) -> Column:
    """The links that the fetch told, or else those counted in its html."""
    return F.coalesce(F.size(links).cast("long"), counted)


#: What tells how good a fetch is, as columns of their own.
TOLD = ("word_count", "challenge", "main_score", "counted_links")


def with_signals(fetches: DataFrame, reason: Column | None = None, parsed: bool = False, selector: Column | None = None, known: bool = False) -> DataFrame:
    """fetches with content_type, supported and the struct `signals`, all of native columns.

    parsed: title and counts from the parsed page instead of patterns; selector: what
    dom.has_selector tells of, for which the pages that are asked for one are parsed;
    known: content_type, supported and the columns TOLD are there and aren't computed again.
    """
    df = native_signals(fetches, known)
    if not known:
        df = df.withColumn("content_type", C.content_type(F.col("headers")["content-type"]))
        df = df.withColumn("supported", C.type_supported("content_type"))
    if parsed:
        df = df.withColumn("dom", dom.dom_features("html", selector))
    else:
        has = F.lit(False)
        if selector is not None:
            has = F.coalesce(dom.dom_features(F.when(selector != "", F.col("html")), selector)["has_selector"], F.lit(False))
        # each part of a page that several columns read is a column of its own
        df = df.withColumns({"__markup": X.markup("html"), "__text": X.body_text("html")})
        score, found = (F.col("main_score"), F.col("counted_links")) if known else (X.main_score("html", "__text"), X.pattern_link_count("__markup"))
        counts = {"title": X.pattern_title("__markup"), "heading_count": X.pattern_heading_count("__markup"), "code_block_count": X.pattern_code_count("__markup"), "link_count": found, "main_score": score, "has_selector": has}
        df = df.withColumn("dom", F.struct(*[c.alias(n) for n, c in counts.items()])).drop("__markup", "__text")
    links = link_count(F.col("page_links"), F.col("dom.link_count"))
    told = reason if reason is not None else F.lit("none")
    plain = {n: F.col(n) for n in ("word_count", "char_count", "unique_word_ratio", "boilerplate_ratio", "content_density", "language")}
    parts = {n: F.col(f"dom.{c}") for n, c in (("heading_count", "heading_count"), ("code_block_count", "code_block_count"), ("main_content_score", "main_score"))}
    rest = {"link_density": X.link_density(links, "word_count"), "link_count": links, "blocked_likelihood": X.blocked_likelihood("status_code", "waf_check", "challenge"), "fallback_reason": told, "truncated": F.col("content_truncated")}
    values = plain | parts | rest
    return df.withColumn("signals", _either([values[n] for n in SIGNALS], ~F.col("supported"), F.col("html").isNull()))


def content(html: Column, fmt: Column, include: Column, main: Column, full: Column, fit: Column) -> Column:
    """What is shown of a page: all html, its main text (or all text if that has fewer than 40 words) or its Markdown (or text)."""
    n = F.size(F.filter(F.split(main, rf"{X.SPACE}+"), lambda x: x != ""))
    return F.when(include, F.when(fmt == "html", html).when(fmt == "text", F.when(n < 40, full).otherwise(main)).when(fmt == "markdown", F.coalesce(fit, full)))


def told_pages(fetches: DataFrame) -> DataFrame:
    """fetches and the columns of their request with TOLD, has_selector, words and challenged (of the trimmed html), content_type and supported.

    Attempts of a request that brought the same html, as most that are made again do,
    are told by the first of them, so that it is read once.
    """
    same = Window.partitionBy("request_id", "html").orderBy("attempt", "mode", "final_url")
    df = fetches.withColumns({"__html": F.col("html"), "__nth": F.row_number().over(same)})
    df = with_signals(df.withColumn("html", F.when(F.col("__nth") == 1, F.col("html"))), selector=F.col("wait_for_selector"))
    df = df.withColumn("body", C.trim_space(F.col("html")))
    whole = F.col("body") == F.col("html")
    told = {"word_count": F.col("word_count"), "challenge": F.col("challenge"), "main_score": F.col("dom.main_score"), "counted_links": F.col("dom.link_count"), "has_selector": F.col("dom.has_selector")}
    told |= {"words": F.when(whole, F.col("word_count")).otherwise(X.visible_word_count("body")), "challenged": F.when(whole, F.col("challenge")).otherwise(X.challenge_hit("body"))}
    df = df.select(*[c for c in fetches.columns if c != "html"], "content_type", "supported", "__html", *[c.alias(f"__{n}") for n, c in told.items()])
    same = Window.partitionBy("request_id", "__html").orderBy("attempt", "mode", "final_url")
    return df.withColumns({n: F.first(f"__{n}").over(same) for n in told}).withColumnRenamed("__html", "html").drop(*[f"__{n}" for n in told])


def judged(fetches: DataFrame) -> DataFrame:
    """told_pages with what the ladder asks: weak, auto_reason and http_reason."""
    df = fetches.withColumn("body", C.trim_space(F.col("html")))
    need = F.col("require_substantive")
    words, challenge, has = F.col("words"), F.col("challenged"), F.col("html").isNotNull()
    links = F.when(~F.col("supported") | ~has, F.lit(0).cast("long")).otherwise(link_count(F.col("page_links"), F.col("counted_links")))
    text_missing = F.coalesce((F.col("required_text") != "") & ~X.contains_text("html", F.col("required_text")), F.lit(False))
    selector_missing = F.coalesce((F.col("wait_for_selector") != "") & ~F.col("has_selector"), F.lit(False))
    auto = C.auto_fallback(has, F.col("status_code"), C.blocked_statuses(F.col("blocked_statuses")), F.col("body"), words, challenge, need, text_missing, selector_missing, F.col("main_score"), links, F.col("min_words"), F.col("min_score"))
    return df.withColumns({"weak": C.weak_fetch(has, F.col("status_code"), F.col("body"), words, challenge, need), "auto_reason": auto, "http_reason": C.final_http_reason(F.col("status_code"), challenge)}).drop("body", "words", "challenged", "has_selector")


#: Columns of a request that its answer needs, and of a fetch that its page needs.
ASKED = ("request_id", "root_url", "request_error", "crawl_mode", "response_format", "include_content", "want_markdown", "require_substantive", "max_content_chars", "extraction_profile", "fit", "required_text", "wait_for_selector", "min_words", "min_score", "blocked_statuses")
FETCHED = ("attempt", "url", "final_url", "status_code", "html", "error_status", "page_links", "waf_check", "content_truncated", "content_type", "supported", *TOLD, "weak", "auto_reason", "http_reason")


def chosen_pages(fetches: DataFrame, plan: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """One row per request of plan that has no error of its own: its columns, those of the page that the ladder chose (null where nothing came), mode_used, reason, failed and the attempts' time.

    scores: (host, score), the failures of hosts; what isn't there is 0. A fetch
    without html is an attempt that gave nothing; where an attempt isn't in the
    table, it wasn't made and what was there before stays. Only what the ladder asks
    is told of each attempt; signals and title are those of the chosen page.
    """
    from ..functions.urls import host_key

    names = {"url": "root_url", "index": "request_id", "error": "request_error"}
    asked = plan.withColumnsRenamed(names).select(*ASKED).where("request_error is null")
    if scores is not None:
        asked = asked.withColumn("host", host_key("root_url")).join(scores, "host", "left").drop("host")
    else:
        asked = asked.withColumn("score", F.lit(None).cast("int"))
    told = asked.withColumn("host_score", F.coalesce("score", F.lit(0))).drop("score")
    rows = told.join(fetches, "request_id", "left")
    rows = ladder.rungs(judged(told_pages(rows)).select(*told.columns, *FETCHED, "mode", "duration_ms"))
    page = F.struct(*FETCHED)
    own = [c for c in told.columns if c != "request_id"]
    came = [(F.col("rung") == k) & F.col("html").isNotNull() for k in range(5)]
    best = [F.max_by(F.when(c, page), F.when(c, F.col("attempt"))).alias(f"r{k}") for k, c in enumerate(came)]
    met = rows.groupBy("request_id").agg(*[F.first(c).alias(c) for c in own], F.sum("duration_ms").alias("duration_ms"), *best, *[F.bool_or(F.col("rung") == k).alias(f"made{k}") for k in (1, 2, 3)])
    for k in (1, 2, 3):
        before = F.when(F.col("host_score") >= ladder.FORCE_BROWSER, F.col("r0")) if k == 1 else F.col(f"r{k - 1}")
        met = met.withColumn(f"r{k}", F.when(F.col(f"made{k}"), F.col(f"r{k}")).otherwise(before)).drop(f"made{k}")
    out = ladder.climb(met.withColumn("mode", F.col("crawl_mode"))).drop("mode", *[f"r{k}" for k in range(5)])
    out = out.select(*[c for c in out.columns if c != "chosen"], "chosen.*")
    out = out.withColumns({"supported": F.coalesce("supported", F.lit(True)), "content_type": F.coalesce("content_type", F.lit(""))})
    drop = ("plain", "char_count", "unique_word_ratio", "boilerplate_ratio", "content_density", "language", "dom", "page_links", "waf_check", "content_truncated", *TOLD)
    return with_signals(out, F.col("reason"), known=True).withColumn("title", F.col("dom.title")).drop(*drop)


def rendered(pages: DataFrame, opts: Column, fmt: Column) -> DataFrame:
    """pages (html, supported, include_content, want_markdown, max_content_chars) with content and markdown, both null where not asked for or not supported; each page is parsed once for them.

    opts: struct(pruning_threshold, pruning_type, min_word_threshold).
    """
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    html = F.when(F.col("supported"), F.col("html"))
    asks_text = F.col("include_content") & (fmt == "text")
    asks_full = F.col("include_content") & ((fmt == "text") | ((fmt == "markdown") & ~F.col("want_markdown")))
    got = dom.page_content(html, F.col("want_markdown"), asks_text, asks_full, opts["pruning_threshold"], opts["pruning_type"], opts["min_word_threshold"])
    df = pages.withColumn("__got", got)
    n = F.col("max_content_chars").cast("int")
    cut = F.when(F.col("__got.raw_markdown").isNotNull(), F.struct(*[F.left(F.col(f"__got.{c}"), n).alias(c) for c in dom.MARKDOWN.names]))
    df = df.withColumn("markdown", F.when(F.col("want_markdown") & F.col("supported"), cut))
    shown = content(F.col("html"), fmt, F.col("include_content"), F.col("__got.main_text"), F.col("__got.full_text"), F.col("markdown.fit_markdown"))
    return df.withColumn("content", F.when(F.col("supported"), shown)).drop("__got")


def mapped_page() -> Column:
    """The page of an answer; its bytes are those of its body, 0 without one."""
    return F.struct("url", "final_url", "status_code", F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("bytes"), F.col("signals.link_count").alias("links_extracted"), F.col("error_status").alias("error"), "content", "markdown")


def scrape(fetches: DataFrame, plan: DataFrame, options: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """The answer to each request: the page that its fetches (attempts) end with, under plan (of scrape_plan, index = request_id).

    One row per request that has no error of its own. Markdown is pruned by the
    plan's options (fit). options: (request_id, options) instead of these; scores: (host, score), see chosen_pages. What isn't asked for isn't
    computed: Markdown only where it is wanted, text only for its format. `failed`
    is what a host's memory learns.
    """
    f = chosen_pages(fetches, plan, scores)
    opts = F.col("fit")
    if options is not None:
        f = f.join(options, "request_id", "left")
        opts = F.col("options")
    has = F.col("html").isNotNull()
    f = rendered(f, opts, F.col("response_format"))
    blank = (C.trim_space(F.coalesce(F.col("markdown.raw_markdown"), F.lit(""))) == "") & (C.trim_space(F.coalesce(F.col("markdown.fit_markdown"), F.lit(""))) == "")
    error = C.scrape_error(has, F.col("supported"), F.col("content_type"), F.col("status_code"), F.col("error_status"), F.col("html"), F.col("want_markdown"), blank)
    duration = F.coalesce("duration_ms", F.lit(0)).alias("duration_ms")
    return f.select("request_id", "root_url", "final_url", "status_code", "content_type", duration, "mode_used", "content", "markdown", "title", error.alias("error"), "signals", F.when(F.col("supported") & has, mapped_page()).alias("page"), "failed")
