"""Content types, errors and decisions of a fetch, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, ascii_lower, col

# fixed values: statuses that make a fetch worth repeating
RETRY_STATUSES = (403, 407, 408, 409, 410, 425, 429, 451)


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def content_type(header: Column | str) -> Column:
    """The type before any parameter, in lower case; empty without a header."""
    return F.coalesce(ascii_lower(trim_space(F.split_part(col(header), F.lit(";"), F.lit(1)))), F.lit(""))


def type_supported(kind: Column | str) -> Column:
    """Whether content of this type is extracted; what isn't known is."""
    k = col(kind)
    text = k.isin("", "text/html", "application/xhtml+xml", "text/plain", "text/markdown", "text/x-markdown")
    xml = k.contains("xml") & (k.startswith("text/") | k.startswith("application/"))
    media = k.startswith("image/") | k.startswith("video/") | k.startswith("audio/") | k.startswith("font/")
    return F.when(text | xml, True).when(k.isin("application/pdf", "application/octet-stream") | media, False).otherwise(True)


def error_struct(code: str, message: Column | str, retryable: Column | bool) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"), (F.lit(retryable) if isinstance(retryable, bool) else retryable).alias("retryable"))


def network_error(message: Column | str) -> Column:
    m = ascii_lower(message)

    def has(*xs):
        out = F.lit(False)
        for x in xs:
            out = out | m.contains(x)
        return out

    return (
        F.when(has("dns", "failed to lookup", "not known"), error_struct("dns_error", col(message), False))
        .when(has("tls", "certificate"), error_struct("tls_error", col(message), False))
        .when(has("timed out", "timeout"), error_struct("timeout", col(message), True))
        .otherwise(error_struct("http_error", col(message), True))
    )


def is_success(status: Column) -> Column:
    return status.between(200, 299)


def scrape_error(has_page: Column, supported: Column, kind: Column, status: Column, error_status: Column, html: Column, want_markdown: Column, markdown_blank: Column) -> Column:
    """The error of a scrape, first that holds, or null."""
    return (
        F.when(~supported, error_struct("unsupported_content_type", F.concat(F.lit("content-type "), kind, F.lit(" is not supported for extraction")), False))
        .when(~has_page, error_struct("empty_content", "no page could be fetched", True))
        .when(error_status.isNotNull(), network_error(error_status))
        .when(~is_success(status), error_struct("http_error", F.concat(F.lit("upstream HTTP "), status.cast("string")), (status >= 500) | (status == 429)))
        .when(trim_space(html) == "", error_struct("empty_content", "empty document body", True))
        .when(want_markdown & markdown_blank, error_struct("empty_content", "markdown extraction produced no usable text", False))
    )


def retry_status(status: Column | str) -> Column:
    s = col(status)
    return s.isin(*RETRY_STATUSES) | (s >= 500)


def blocked_statuses(extra: Column | None) -> Column:
    own = F.array(*[F.lit(s) for s in (*RETRY_STATUSES, 503)])
    return F.array_sort(F.array_distinct(own if extra is None else F.concat(own, F.coalesce(extra.cast("array<int>"), F.array().cast("array<int>")))))


def weak_fetch(has_page: Column, status: Column, trimmed_html: Column, words: Column, challenge: Column, need: Column) -> Column:
    """Whether a fetch is to be repeated; words and challenge are those of the trimmed html."""
    return (
        ~has_page
        | F.coalesce(retry_status(status), F.lit(False))
        | F.coalesce(need & (trimmed_html == ""), F.lit(False))
        | F.coalesce(challenge, F.lit(False))
        | F.coalesce(need & ((F.octet_length(trimmed_html) < 512) | (words < 40)), F.lit(False))
    )


def auto_fallback(has_page: Column, status: Column, blocked: Column, trimmed_html: Column, words: Column, challenge: Column, need: Column, text_missing: Column, selector_missing: Column, score: Column, links: Column, min_words: Column | int = 150, min_score: Column | float = 0.45) -> Column:
    """Why a browser is asked for in auto mode, or null."""
    min_words = F.lit(min_words) if isinstance(min_words, int) else min_words
    min_score = F.lit(min_score) if isinstance(min_score, float) else min_score
    dense = F.when(words > 0, links / words).otherwise(F.lit(float("inf"))) > 6.0
    bad = (status >= 500) | F.array_contains(blocked, status)
    return (
        F.when(~has_page, "http_empty")
        .when(~is_success(status), F.when(bad, "http_bad_status"))
        .when(need & (trimmed_html == ""), "http_empty")
        .when(challenge, "http_challenge")
        .when(text_missing, "required_text_missing")
        .when(selector_missing, "wait_for_selector_missing")
        .when(need & (words < min_words), "http_low_words")
        .when(need & (score < min_score), "http_low_main_score")
        .when(need & dense, "http_low_density")
    )


def final_http_reason(status: Column, challenge: Column) -> Column:
    return F.when(challenge, "http_challenge").when(~is_success(status), "http_bad_status").otherwise("http_low_words")


def crawl_needs_browser(pages: Column, links: Column, min_pages: Column | int = 1, min_links: Column | int = 20) -> Column:
    return (pages < min_pages) | (links < min_links)


def page_needs_browser(has_page: Column, status: Column, html: Column, need: Column) -> Column:
    return ~has_page | F.coalesce(~is_success(status), F.lit(False)) | F.coalesce(need & (trim_space(html) == ""), F.lit(False))


def mode_used(requested: Column, used_browser: Column) -> Column:
    """The mode that is told; auto without a browser stays auto, and http stays http."""
    return F.when((requested == "auto") & used_browser, "browser").otherwise(requested)


def reported_reason(reason: Column, used_browser: Column) -> Column:
    return F.when(used_browser, F.coalesce(reason, F.lit("none"))).otherwise("none")
