"""Queries over what requests ask for: options, conditions, settings and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import CHALLENGE_SQL, LINKS_SQL, LOWER_SQL, SCORE_SQL, TEXT_SQL, WORDS_SQL, pages, pick, query, sql_pick
from .functions import text as X
from .operators import scrape as S
from .plans import requests as R
from .sources.tables import fetches_from_pages, read_table, setting, spread

VALUES = ("{n}", "{n}x", "", " {n}", "-{n}", "{n}.5", "true", "99999999999999999999", "FALSE", "1e3")
VALUES_SQL = f"replace({sql_pick(VALUES, 's_suppkey')}, '{{n}}', CAST(s_suppkey AS VARCHAR))"


@query(f"""WITH v AS (SELECT s_suppkey, {VALUES_SQL} AS v FROM supplier)
SELECT s_suppkey, CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN coalesce(try_cast(v AS BIGINT), 7) ELSE 7 END AS whole, CASE WHEN regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(v AS DOUBLE) ELSE 0.5 END AS number,
 CASE v WHEN 'true' THEN true WHEN 'false' THEN false ELSE true END AS flag FROM v""")
def settings_defaults(spark, sf_dir):
    """Settings as they are read: what can't be read is the default."""
    d = read_table(spark, sf_dir, "supplier").select("s_suppkey", F.replace(pick(VALUES, "s_suppkey"), F.lit("{n}"), F.col("s_suppkey").cast("string")).alias("v"))
    return d.select("s_suppkey", setting(F.col("v"), "long", 7).alias("whole"), setting(F.col("v"), "double", 0.5).alias("number"), setting(F.col("v"), "boolean", True).alias("flag"))


@query("SELECT doc_id, md5(left(text, CAST(doc_id * 37 % 3000 AS INTEGER))) AS cut_md5, CAST(length(left(text, CAST(doc_id * 37 % 3000 AS INTEGER))) AS BIGINT) AS n_chars FROM documents")
def text_truncation(spark, sf_dir):
    """Texts cut to a limit of characters, as Markdown is."""
    cut = X.truncate("text", (F.col("doc_id") * 37 % 3000).cast("int"))
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.md5(cut.cast("binary")).alias("cut_md5"), F.length(cut).cast("long").alias("n_chars"))


@query(f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN page_id % 7 ELSE {LINKS_SQL} END AS link_count, round(CASE WHEN {WORDS_SQL} = 0 THEN 0.0 ELSE least(1.0, CASE WHEN page_id % 3 = 0 THEN page_id % 7 ELSE {LINKS_SQL} END / {WORDS_SQL} / 20.0) END, 6) AS link_density FROM pages""")
def told_links(spark, sf_dir):
    """Links that the fetch told count instead of those in the html."""
    i = F.col("request_id")
    f = fetches_from_pages(spread(pages(spark, sf_dir))).withColumn("page_links", F.when(i % 3 == 0, F.transform(F.slice(F.sequence(F.lit(0), F.lit(7)), F.lit(1), (i % 7).cast("int")), lambda k: F.concat(F.col("url"), k.cast("string")))))
    return S.with_signals(f).select(i.alias("page_id"), "signals.link_count", F.round("signals.link_density", 6).alias("link_density"))


ASKS = {"required_text": ("ARTICLE", "no such words", None, None), "wait_for_selector": ("article h1", "main", None)}


@query(f"""WITH t AS (SELECT *, {TEXT_SQL} AS body_text FROM pages),
j AS (SELECT page_id, html, {WORDS_SQL} AS words, {CHALLENGE_SQL} AS challenge, {SCORE_SQL} AS score, {LINKS_SQL} AS links, CASE WHEN page_id % 5 = 0 THEN 100000 ELSE 150 END AS min_words, CASE WHEN page_id % 5 = 1 THEN 0.99 ELSE 0.45 END AS min_score FROM t),
r AS (SELECT page_id, CASE WHEN challenge THEN 'http_challenge' WHEN page_id % 4 = 1 OR (page_id % 4 = 0 AND NOT contains({LOWER_SQL.format("html")}, 'article')) THEN 'required_text_missing' WHEN page_id % 3 = 1 THEN 'wait_for_selector_missing'
 WHEN words < min_words THEN 'http_low_words' WHEN score < min_score THEN 'http_low_main_score' WHEN links / words > 6.0 THEN 'http_low_density' END AS reason FROM j)
SELECT page_id AS request_id, coalesce(reason, 'none') AS reason, CASE WHEN reason IS NULL THEN 'auto' ELSE 'browser' END AS mode_used, reason IS NOT NULL AS from_browser FROM r""")
def scrape_conditions(spark, sf_dir):
    """Answers of auto mode to requests with texts, selectors and thresholds of their own; a browser is tried after a plain fetch."""
    i, p = F.col("page_id"), spread(pages(spark, sf_dir))
    asked = p.select(i.alias("index"), "url", F.lit("auto").alias("crawl_mode"), F.lit("html").alias("response_format"), *[F.when(i % len(v) == 0, v[0]).when(i % len(v) == 1, v[1]).alias(n) for n, v in ASKS.items()], F.when(i % 5 == 0, 100_000).alias("auto_browser_min_words"), F.when(i % 5 == 1, 0.99).alias("auto_browser_min_main_content_score"))
    plain = fetches_from_pages(p)
    seen = plain.withColumns({"attempt": F.lit(1), "mode": F.lit("browser"), "final_url": F.concat("final_url", F.lit("#seen"))})
    d = S.scrape(plain.unionByName(seen), R.scrape_plan(asked))
    return d.select("request_id", F.col("signals.fallback_reason").alias("reason"), "mode_used", F.col("final_url").endswith("#seen").alias("from_browser"))


@query(f"""WITH r AS (SELECT page_id, page_id % 4 <> 3 AS told, CASE WHEN page_id % 4 = 0 THEN 0.6 END AS t, CASE WHEN page_id % 4 = 1 THEN 'dynamic' END AS k, CASE WHEN page_id % 4 = 2 AND page_id % 8 = 2 THEN page_id % 9 END AS w, {sql_pick(("balanced", "docs", "article", "repo", "minimal"))} AS profile FROM pages),
f AS (SELECT page_id, profile, coalesce(CASE WHEN told THEN t END, 0.48) AS t, coalesce(CASE WHEN told THEN k END, 'fixed') AS k, coalesce(CASE WHEN told THEN w END, 5) AS w FROM r),
d AS (SELECT *, t = 0.48 AND k = 'fixed' AND w = 5 AND profile <> 'balanced' AS preset FROM f)
SELECT page_id AS index, CAST(CASE WHEN preset THEN CASE profile WHEN 'docs' THEN 0.32 WHEN 'article' THEN 0.38 WHEN 'repo' THEN 0.36 ELSE 0.58 END ELSE t END AS DOUBLE) AS threshold, CASE WHEN preset AND profile IN ('docs', 'article') THEN 'dynamic' WHEN preset THEN 'fixed' ELSE k END AS kind,
 CAST(CASE WHEN preset THEN CASE profile WHEN 'docs' THEN 3 WHEN 'article' THEN 4 WHEN 'repo' THEN 3 ELSE 10 END ELSE w END AS BIGINT) AS words, CAST(t AS DOUBLE) AS crawl_threshold, k AS crawl_kind, CAST(w AS BIGINT) AS crawl_words FROM d""")
def own_fit_options(spark, sf_dir):
    """The Markdown options of requests that tell some of them: for a scrape, where a profile counts for those that tell none, and for a crawl."""
    i = F.col("page_id")
    fit = F.when(i % 4 != 3, F.struct(F.when(i % 4 == 0, 0.6).alias("pruning_threshold"), F.when(i % 4 == 1, "DYNAMIC").alias("pruning_type"), F.when(i % 8 == 2, i % 9).alias("min_word_threshold")))
    asked = pages(spark, sf_dir).select(i.alias("index"), "url", fit.alias("fit_markdown"), pick(("balanced", "docs", "article", "repo", "minimal")).alias("extraction_profile"))
    names = (("pruning_threshold", "threshold"), ("pruning_type", "kind"), ("min_word_threshold", "words"))
    own = R.scrape_plan(asked).select("index", *[F.col(f"fit.{c}").alias(n) for c, n in names])
    return own.join(R.crawl_plan(asked).select("index", *[F.col(f"fit.{c}").alias(f"crawl_{n}") for c, n in names]), "index")


@query(f"""WITH r AS (SELECT page_id, CASE WHEN page_id % 6 < 3 THEN page_id % 300 END AS wait, page_id % 4 < 2 AS wide, page_id % 4 IN (0, 2) AS high, CASE WHEN page_id % 5 > 2 THEN page_id % 5 = 3 END AS shot, CASE WHEN page_id % 4 = 3 THEN false END AS intercept, CASE WHEN page_id % 3 = 2 THEN page_id % 2 = 0 END AS js, page_id % 7 = 0 AS block, {sql_pick(("http", "auto", "browser"), "page_id", 2)} AS mode FROM pages)
SELECT page_id, CASE WHEN wait > 0 THEN wait END AS delay_ms, wide AND high AS viewport, coalesce(shot, false) AS screenshot, CASE WHEN mode <> 'http' THEN coalesce(intercept, true) END AS enabled, CASE WHEN mode <> 'http' THEN CASE WHEN js IS NOT NULL THEN NOT js ELSE block END END AS block_javascript,
 CASE WHEN {sql_pick(("off", "basic", "camoufox_like"), "page_id", 2)} = 'camoufox_like' THEN '{R.CAMOUFOX_REFERER}' ELSE 'http://from/' || page_id END AS referer FROM r""")
def browser_options(spark, sf_dir):
    """What browsers are told of delays, windows, pictures and scripts, and the referer."""
    i, no = F.col("page_id"), F.lit(None)
    size = lambda c: F.when(c, F.lit(800))
    w = R.browser_waits(no.cast("string"), no.cast("long"), F.when(i % 6 < 3, i % 300), no.cast("string"), F.lit(1), F.lit(1), size(i % 4 < 2), size((i % 4).isin(0, 2)), F.when(i % 5 > 2, i % 5 == 3))
    b = R.browser_intercept(pick(("http", "auto", "browser"), step=2), F.when(i % 4 == 3, False), i % 7 == 0, F.when(i % 3 == 2, i % 2 == 0))
    h = R.header_profile(pick(("off", "basic", "camoufox_like"), step=2), F.lit("agent"), F.concat(F.lit("http://from/"), i.cast("string")))
    return pages(spark, sf_dir).select("page_id", w.alias("w"), b.alias("b"), h.alias("h")).select("page_id", "w.delay_ms", "w.viewport", "w.screenshot", "b.enabled", "b.block_javascript", "h.referer")
