"""One vectorised function that parses each page once and gives all that needs a tree."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import extract as X
from ..functions.dom import parse
from ..functions.text import col

MARKDOWN = T.StructType([T.StructField(n, T.StringType()) for n in ("raw_markdown", "fit_markdown", "fit_html")])
FEATURES = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("heading_count", T.LongType()),
        T.StructField("code_block_count", T.LongType()),
        T.StructField("link_count", T.LongType()),
        T.StructField("main_score", T.DoubleType()),
        T.StructField("has_selector", T.BooleanType()),
    ]
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _features(html: str | None, selector: str | None) -> tuple:
    if html is None:
        return None, None, None, None, None, None
    root = parse(html)
    names = [e.name for e in root.walk()]
    sel = X.selector(selector) if selector is not None else None
    return (
        X.title_of(root),
        sum(n in HEADINGS for n in names),
        sum(n in ("pre", "code") for n in names),
        sum(e.name == "a" and "href" in e.attrs for e in root.walk()),
        X.main_score(root, X.octets(html)),
        False if sel is None else any(sel.matches(e) for e in root.walk()),
    )


@F.pandas_udf(FEATURES)
def _features_udf(html: pd.Series, selector: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_features(h, s) for h, s in zip(html, selector, strict=True)], columns=FEATURES.names)


def dom_features(html: Column | str, selector: Column | None = None) -> Column:
    """Title, counts, main-content score and whether a selector matches, from one parse."""
    return _features_udf(col(html), selector if selector is not None else F.lit(None).cast("string"))


@F.pandas_udf(MARKDOWN)
def _markdown_udf(html: pd.Series, threshold: pd.Series, kind: pd.Series, min_words: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None) if h is None else X.fit_markdown(h, t, k, None if pd.isna(m) else int(m)) for h, t, k, m in zip(html, threshold, kind, min_words, strict=True)]
    return pd.DataFrame(rows, columns=MARKDOWN.names)


def fit_markdown(html: Column | str, threshold: Column, kind: Column, min_words: Column) -> Column:
    """struct(raw_markdown, fit_markdown, fit_html) under pruning options."""
    return _markdown_udf(col(html), threshold.cast("double"), kind, min_words.cast("double"))


CONTENT = T.StructType([*MARKDOWN.fields, T.StructField("main_text", T.StringType()), T.StructField("full_text", T.StringType())])


@F.pandas_udf(CONTENT)
def _content_udf(html: pd.Series, marked: pd.Series, main: pd.Series, full: pd.Series, threshold: pd.Series, kind: pd.Series, min_words: pd.Series) -> pd.DataFrame:
    rows = []
    for h, md, m, f, t, k, w in zip(html, marked, main, full, threshold, kind, min_words, strict=True):
        row = [None] * 5
        if h is not None and (m or f):
            root = parse(h)
            row[3] = X.main_text(root) if m else None
            row[4] = X.to_text(root) if f else None
        if h is not None and md:
            row[:3] = X.fit_markdown(h, t, k, None if pd.isna(w) else int(w))
        rows.append(row)
    return pd.DataFrame(rows, columns=CONTENT.names)


def page_content(html: Column, marked: Column, main: Column, full: Column, threshold: Column, kind: Column, min_words: Column) -> Column:
    """struct(raw_markdown, fit_markdown, fit_html, main_text, full_text): the Markdown where marked, and the texts where asked for; all else is null."""
    return _content_udf(html, *[F.coalesce(c, F.lit(False)) for c in (marked, main, full)], threshold.cast("double"), kind, min_words.cast("double"))


@F.pandas_udf(T.StringType())
def _main_text_udf(html: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else X.main_text(parse(h)) for h in html], dtype=object)


@F.pandas_udf(T.StringType())
def _text_udf(html: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else X.to_text(parse(h)) for h in html], dtype=object)


def main_text(html: Column | str) -> Column:
    return _main_text_udf(col(html))


def page_text(html: Column | str) -> Column:
    return _text_udf(col(html))


BLOCK = T.StructType([T.StructField("tag", T.StringType()), T.StructField("words", T.LongType()), T.StructField("html", T.StringType())])


@F.pandas_udf(BLOCK)
def _block_udf(html: pd.Series) -> pd.DataFrame:
    rows = []
    for h in html:
        e = X.main_block(parse(h)) if h is not None else None
        rows.append((None, None, None) if e is None else (e.name, X.words_in(e), X.outer_html(e)))
    return pd.DataFrame(rows, columns=BLOCK.names)


def main_block(html: Column | str) -> Column:
    """struct(tag, words, html) of the main block, null fields without one."""
    return _block_udf(col(html))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _links_udf(html: pd.Series, base: pd.Series) -> pd.Series:
    from urllib.parse import urldefrag, urljoin

    out = []
    for h, b in zip(html, base, strict=True):
        found: dict[str, None] = {}
        for e in parse(h or "").walk():
            href = e.attrs.get("href", "").strip() if e.name == "a" else ""
            if href:
                try:
                    found.setdefault(urldefrag(urljoin(b or "", href))[0])
                except ValueError:
                    continue
        out.append([x for x in found if x.startswith(("http://", "https://"))])
    return pd.Series(out)


def page_links(html: Column | str, base: Column | str) -> Column:
    """Absolute http links of a page, each once, without fragments."""
    return _links_udf(col(html), col(base))


@F.pandas_udf(T.LongType())
def _filled_links_udf(html: pd.Series) -> pd.Series:
    return pd.Series([sum(e.name == "a" and bool(e.attrs.get("href", "").strip()) for e in parse(h or "").walk()) for h in html])


def filled_link_count(html: Column | str) -> Column:
    """Links whose target isn't blank, as the benchmark counts them."""
    return _filled_links_udf(col(html))


