"""Links of pages to pages: found by patterns, resolved, and joined to the pages that they mean. All native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import markup
from ..functions.urls import let, named, page_key, resolved, without_tracking

VALUE = r"""("[^"<>]*"|'[^'<>]*'|[^\s"'<>][^\s<>]*)"""


def _unquoted(value: Column) -> Column:
    return F.replace(F.regexp_replace(value, "^[\"']|[\"']\\z", ""), F.lit("&amp;"), F.lit("&"))


def _references(shown: Column) -> Column:
    found = F.regexp_extract_all(shown, F.lit(rf"(?is)<a\s(?:[^<>]*?\s)?href\s*=\s*{VALUE}"), F.lit(1))
    return F.transform(found, _unquoted)


def references(html: Column | str) -> Column:
    """The targets of a page's links as they are written, in their order; those in comments, scripts and styles don't count."""
    return _references(markup(html))


def _base(shown: Column, url: Column) -> Column:
    own = _unquoted(F.regexp_extract(shown, rf"(?is)<base\s(?:[^<>]*?\s)?href\s*=\s*{VALUE}", 1))
    return F.coalesce(resolved(url, F.nullif(own, F.lit(""))), url)


def base_url(html: Column | str, url: Column | str) -> Column:
    """The URL that a page's references start from: that of its base element, if there is one that is good, or its own."""
    return _base(markup(html), F.col(url) if isinstance(url, str) else url)


def _found(pages: DataFrame) -> DataFrame:
    """(page_id, link) of all links of pages, each once a row of pages.

    A page's markup and base are made once, not once a link, and its links before
    they become rows. Rows come from the outer explode and nulls go after it: a
    filter before it would make all of it twice.
    """
    shown = pages.select("page_id", "url", markup("html").alias("__shown"))
    told = named({"base": _base(F.col("__shown"), F.col("url")), "refs": F.array_distinct(_references(F.col("__shown")))})
    links = let(told, lambda x: F.array_distinct(F.transform(x["refs"], lambda ref: without_tracking(resolved(x["base"], ref)))))
    return shown.select("page_id", F.explode_outer(links).alias("link")).where("link is not null")


def page_links(pages: DataFrame) -> DataFrame:
    """Of pages (page_id, url, html) each different link once: page_id, link, an absolute URL without fragment and tracking.

    A link to no http or https URL is left out, as are pages without html or url.
    """
    return _found(pages).distinct()


def page_edges(pages: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """The links of pages that lead to one of the targets (page_id, url; the pages themselves by default): (src, dst), each once.

    A link leads to the page whose URL has its key (see page_key); of several pages of
    one key, to that of the smallest page_id. Links are told apart before the join, and
    a target has one row, so that a page to which very many link is split by Spark's
    skew join and makes no pairs.
    """
    own = (pages if targets is None else targets).select(page_key("url").alias("key"), F.col("page_id").alias("dst")).where("key is not null").groupBy("key").agg(F.min("dst").alias("dst"))
    keyed = _found(pages).select(F.col("page_id").alias("src"), page_key("link").alias("key")).distinct()
    return keyed.join(own, "key").select("src", "dst").distinct()
