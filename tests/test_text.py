"""Native signals against plain readings of their rules."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import extract as E
from tessera.functions import text as X

HTML = ["", " ", "a<b>c", "<script>x y</script>z", "<scripty>q</scripty> r", "< script>no</script>yes", "<script>open", "<!-- a > b --> y", "x <b", "é è <p>ü</p>", "<style>p{}</style>one two", "a\u00a0b c", "<p>One</p>\v<p>Two</p>", "1 < 2 and 3 > 2"]


def word_count(html):
    t = re.sub(r"(?is)<[ \t\n\f\r]*script.*?</script>|<[ \t\n\f\r]*style.*?</style>|<[^>]*(?:>|\Z)", " ", html)
    return len(re.findall(r"[^ \t\n\f\r]+", t))


def plain(html):
    return re.sub(r"[\s\x85]+", " ", re.sub(r"(?s)<[^>]*(?:>|\Z)", "", html))


def values(spark, data, *cols):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, html string")
    return [tuple(r) for r in df.select("i", *cols).orderBy("i").drop("i").collect()]


def test_words_and_plain_text(spark):
    got = values(spark, HTML, X.visible_word_count("html"), X.plain_text("html"))
    assert got == [(word_count(h), plain(h)) for h in HTML]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="<>/ scriptyle\n\tab!-", max_size=60), min_size=60, max_size=60))
def test_words_and_plain_text_of_odd_html(spark, data):
    got = values(spark, data, X.visible_word_count("html"), X.plain_text("html"))
    assert got == [(word_count(h), plain(h)) for h in data]


def test_every_challenge_marker(spark):
    data = [f"<p>x {m.upper()} y</p>" for m in X.CHALLENGE_MARKERS] + ["<p>cloud flare</p>", "capt cha"]
    assert [r[0] for r in values(spark, data, X.challenge_hit("html"))] == [True] * 11 + [False, False]


def test_language_hint(spark):
    data = ["", " ", "plain words", "日本語", "abc é", "abcd!", "ab!!"]
    assert [r[0] for r in values(spark, data, X.language_hint("html"))] == [None, "en", "en", "und", "en", "en", "und"]


def test_unique_words_are_compared_by_ascii_case(spark):
    data = ["a A b", "", "É é", "x x x"]
    got = [r[0] for r in values(spark, data, X.unique_word_ratio("html"))]
    assert got == pytest.approx([2 / 3, 0.0, 1.0, 1 / 3])


@pytest.mark.parametrize(("words", "extra"), [(79, 0.35), (80, 0.0)])
def test_boilerplate_of_short_pages(spark, words, extra):
    r = spark.range(1).select(X.boilerplate_ratio(F.lit("<a>"), F.lit(words))).first()[0]
    assert r == pytest.approx(min(1, 0.7 / 3 + extra))


def test_byte_limits_dont_split_characters(spark):
    r = spark.range(1).select(X.head_bytes(F.lit("aéb"), 2), X.head_bytes(F.lit("aéb"), 3), X.head_bytes(F.lit("aéb"), 9)).first()
    assert list(r) == ["a", "aé", "aéb"]
    assert [E.head("aéb" * 3, 2), E.head("aéb", 12)] == ["a", "aéb"]


def test_likelihood_of_a_block(spark):
    rows = [(403, False, False, 0.75), (410, False, False, 0.0), (500, False, False, 0.55), (503, False, False, 0.75), (200, True, False, 0.85), (200, False, True, 0.85), (404, False, False, 0.0)]
    df = spark.createDataFrame(rows, "s int, w boolean, c boolean, want double")
    assert df.where(X.blocked_likelihood("s", "w", "c") != F.col("want")).count() == 0


def test_link_density(spark):
    r = spark.range(1).select(X.link_density(F.lit(5), F.lit(0)), X.link_density(F.lit(10), F.lit(5)), X.link_density(F.lit(1000), F.lit(2))).first()
    assert list(r) == [1.0, 0.1, 1.0]


MARKDOWN = ["a ![x](data:image/png;base64,A) b", "![a ![b](data:image/png;base64,..) c", "](data:image/x) kept", "![open](data:image/gif;x", "![k](http://h/i.png)", "a\n\n\n\nb", "a\n\nb\n", "\n\n\n"]


def test_markdown_clean_up_is_the_same_in_both_forms(spark):
    got = [r[0] for r in values(spark, MARKDOWN, X.normalize_markdown("html"))]
    assert got == [E.normalize_markdown(m) for m in MARKDOWN]
    assert got[0] == "a  b" and got[2] == "](data:image/x) kept" and got[3] == "" and got[5] == "a\n\nb"


def test_text_is_contained_whatever_its_case(spark):
    r = spark.range(1).select(X.contains_text(F.lit("<P>Hello É"), F.lit("p>hEL")), X.contains_text(F.lit("x"), F.lit("")), X.contains_text(F.lit("É"), F.lit("é"))).first()
    assert list(r) == [True, True, False]


HTML = """<!-- <h1>no</h1><a href=x> --><script>'<h2><a href="s">'</script><style>h3 {}</style><title> A &amp; b </title>
<article id=one class="Main ad"><h1 class=t>x</h1><pre><code>c</code></pre><a href="">e</a><a href=' '>b</a><a HREF=full>f</a><a name=n>n</a></article><div data-content="1" class='x ad y'>z</div><uploads class="ads">"""


def test_patterns_of_markup(spark):
    d = spark.createDataFrame([(HTML,), (None,), ("",)], "html string").select(X.markup("html").alias("html"))
    got = [tuple(r) for r in d.select(X.pattern_title("html"), X.pattern_heading_count("html"), X.pattern_code_count("html"), X.pattern_link_count("html"), X.pattern_filled_link_count("html")).collect()]
    assert got == [("A & b", 1, 2, 3, 1), (None,) * 5, (None, 0, 0, 0, 0)]


SELECTORS = ["article", "article.ad", "article.Main.ad", "#one", "div.ad", "div.x.y", ".y", "[data-content]", "div[data-content=1]", "*", "[class*=a]", "article[id*=n]"]
NO_SELECTORS = ["main", "div.Main", "uploads.ad", "#two", "article.a", "div#one", "div[data-content=2]", "[data-contents]", "pre.c", "h2"]


def test_selectors_of_one_element(spark):
    d = spark.createDataFrame([(HTML,)], "html string").select(X.markup("html").alias("html"))
    assert list(d.select(*[X.pattern_selector("html", s).alias(s) for s in SELECTORS + NO_SELECTORS]).first()) == [True] * len(SELECTORS) + [False] * len(NO_SELECTORS)
    for s in ("a b", "a > b", "a, b", "", "a:hover"):
        with pytest.raises(ValueError, match="selector"):
            X.opening(s)


def test_main_block_by_pattern(spark):
    w = lambda n: "<b>w</b> " * n
    rows = [f"<article>{w(39)}</article>", f"<article>{w(40)}</article>", f"<div id='mycontent'>{w(60)}</div><main>{w(50)}</main>", f"<main>{w(50)}</main><article>{w(50)}</article>", f"<p role='main'>{w(45)}&amp;</p>", "", None]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, html string").select("i", X.pattern_main_block("html", X.MAIN_BLOCKS).alias("b")).orderBy("i")
    assert [tuple(r) for r in d.select("b.tag", "b.words").collect()] == [(None, None), ("article", 40), ("div", 60), ("article", 50), ("p", 46), (None, None), (None, None)]


@pytest.mark.parametrize("piece", ["<a ", "<a href='", "<a href", "<div class=x", "<!--", "<script", "<title", "<body <", "</a", "<article>"])
def test_long_pages_of_unclosed_tags(spark, piece):
    from tessera.operators import links

    d = spark.range(1).select(F.repeat(F.lit(piece), 200_000).alias("html")).withColumn("shown", X.markup("html"))
    got = d.select(X.pattern_title("shown"), X.pattern_heading_count("shown"), X.pattern_link_count("shown"), X.pattern_filled_link_count("shown"), X.pattern_main_score("html"), X.pattern_selector("shown", "div.x"), F.size(links.references("html"))).first()
    assert got[0] is None and got[1] == 0


@pytest.mark.parametrize(("piece", "words"), [("<script>x</script> y ", 200_000), ("</script><script> y ", 1), ("<style> y ", 200_000), ("<title>", 0), ("<", 0), ("<a x ", 0)])
def test_long_pages_of_unclosed_blocks(spark, piece, words):
    """No signal reads to the end of a page for each tag or block that isn't closed."""
    d = spark.range(1).select(F.concat(F.lit("<body>"), F.repeat(F.lit(piece), 200_000)).alias("html"))
    got = d.select(X.visible_word_count("html"), X.pattern_title("html"), X.pattern_main_score("html")).first()
    assert got[0] == words and got[1] is None


PIECES = ["<script>", "<SCRIPT x>", "</script>", "</Script>", "<style>", "</style>", "< style", "<scriptstyle", "<script", "/script>", "<", ">", " ", "a", "é b", "<b>", "</b>", "<body>", "x > y"]


@pytest.mark.parametrize("least", [0, X.LONG_BYTES])
def test_words_and_texts_of_blocks_in_any_order(spark, monkeypatch, least):
    monkeypatch.setattr(X, "LONG_BYTES", least)
    rng = random.Random(3)
    data = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(20))) for _ in range(3000)]
    body = lambda h: (re.search(r"(?is)<body[^<>]*>(.*)", h) or [0, ""])[1]
    got = values(spark, data, X.visible_word_count("html"), X.body_text("html"))
    assert got == [(word_count(h), " ".join(x for x in re.split("<[^>]*>", body(h)) if x)) for h in data]
