"""The page tree, pruning and rendering on hand-made pages."""

import math

import pytest

from tessera.functions import extract as E
from tessera.functions.dom import Selector, inner_html, outer_html, parse

WORDS = " ".join(f"word{i}" for i in range(50))


def names(html):
    return [e.name for e in parse(html).walk()]


def test_implied_ends_and_bodies():
    assert outer_html(parse("<p>a<p>b")) == "<html><body><p>a</p><p>b</p></body></html>"
    assert outer_html(parse("<ul><li>a<li>b</ul>")) == "<html><body><ul><li>a</li><li>b</li></ul></body></html>"
    assert outer_html(parse("<title>t</title><p>x<br>y")) == "<html><head><title>t</title></head><body><p>x<br>y</p></body></html>"


def test_open_formatting_is_taken_up_again():
    assert outer_html(parse("<p><b>x<br><p>y")) == "<html><body><p><b>x<br></b></p><p><b>y</b></p></body></html>"


def test_raw_text_and_escapes():
    assert inner_html(parse("<p>1 &lt; 2 &amp; 3</p>", fragment=True)) == "<p>1 &lt; 2 &amp; 3</p>"
    assert "p" not in names('<script>"</p><p>"</script>')


def test_title():
    assert E.title_of(parse("<title> A &amp; B\n c</title>")) == "A & B c"
    assert E.title_of(parse("<svg><title>s</title></svg><title>t</title>")) == "s"
    assert E.title_of(parse("<title> </title>")) is None and E.title_of(parse("<p>x")) is None


def test_selectors():
    root = parse('<div id="c-x" class="a b"><p class="b"><span data-k="v w">x</span></p></div>')
    hits = {"div > p": 1, "div span": 1, ".b": 2, "#c-x": 1, "[data-k~=w]": 1, "[class*=a]": 1, "div > span": 0, "p, span": 2, "*": 5, "[id^=c]": 1, "[id$=x]": 1}
    assert {s: len(Selector(s).select(root)) for s in hits} == hits
    assert E.selector("div >") is None and E.selector("a::x") is None


@pytest.mark.parametrize("gone", ["<nav>x</nav>", "<footer>x</footer>", "<header>x</header>", "<aside>x</aside>", "<form>x</form>", "<iframe>x</iframe>", '<div role="navigation">x</div>', '<div data-ad="1">x</div>', '<div class="uploads">x</div>', '<div class="thread-1 head-ad-x">x</div>', '<div id="head-1">x</div>'])
def test_hostile_elements_go(gone):
    left = outer_html(E.without(parse(f"<p>k</p>{gone}"), E.HOSTILE))
    assert left == "<html><body><p>k</p></body></html>"


def test_class_ad_stays():
    assert "x" in outer_html(E.without(parse('<div class="ad">x</div>'), E.HOSTILE))


@pytest.mark.parametrize(("n", "found"), [(39, False), (40, True)])
def test_main_block_needs_forty_words(n, found):
    root = parse(f"<article>{' '.join(['w'] * n)}</article>")
    assert (E.main_block(root) is not None) is found


def test_first_main_block_wins_ties():
    root = parse(f"<div id='content1'>{WORDS}</div><article id='x'>{WORDS}</article><article id='y'>{WORDS}</article>")
    assert E.main_block(root).attrs["id"] == "x"


def test_score_of_a_void_element_and_of_a_paragraph():
    p = E.Pruner(0.48, "fixed", None)
    root = parse("<p>one two<br></p>", fragment=True)
    p.measure(root)
    br = next(e for e in root.walk() if e.name == "br")
    assert p.score(br) == pytest.approx(0.70)
    assert not p.removed(br)
    para = next(e for e in root.walk() if e.name == "p")
    assert p.of[id(para)] == (2, 7, 11, 0)
    assert p.score(para) == pytest.approx(0.4 * 7 / 11 + 0.2 + 0.2 + 0.1 * math.log(8))


def test_measures_equal_a_direct_reading():
    root = parse(f"<div>a<a href='x'>link one</a><p>b <b>c</b> d</p><a>two</a>{WORDS}</div>", fragment=True)
    p = E.Pruner(0.48, "fixed", 5)
    p.measure(root)
    for e in root.walk():
        text = " ".join(e.texts())
        links = sum(E.octets(" ".join(k.texts())) for k in e.kids if not isinstance(k, str) and k.name == "a")
        assert p.of[id(e)] == (len(text.split()), E.octets(text), E.octets(inner_html(e)), links)


def test_short_elements_go_by_default_and_stay_without_a_threshold():
    html = f"<article><h1>Two words</h1><p>{WORDS}</p></article>"
    assert "Two words" not in E.fit_markdown(html, 0.48, "fixed", 5)[1]
    assert E.fit_markdown(html, 0.48, "fixed", None)[1].startswith("# Two words")


def test_a_page_of_short_blocks_is_kept_as_it_is():
    raw, fit, html = E.fit_markdown("<body><p>one two</p><p>three four</p></body>", 0.48, "fixed", 5)
    assert html == "<body><p>one two</p><p>three four</p></body>" and fit == "one two\n\nthree four"


def test_dynamic_thresholds():
    p = E.Pruner(1.0, "dynamic", None)
    root = parse("<p><a>only a link here</a></p>", fragment=True)
    p.measure(root)
    para = next(e for e in root.walk() if e.name == "p")
    assert p.limit(para) == pytest.approx(1.0 * 0.8 * 0.9 * 1.2)


def test_markdown_forms():
    md = E.to_markdown(parse("<h2>T</h2><p>a <b>b</b> <i>c</i> <code>d</code> <a href='u'>e</a></p><ul><li>x<li>y</ul><ol><li>p<li>q</ol><pre><code>k\n l</code></pre><blockquote>z</blockquote><table><tr><th>h<th>i<tr><td>1<td>2</table>"))
    assert md == "## T\n\na **b** *c* `d` [e](u)\n\n- x\n- y\n\n1. p\n2. q\n\n```\nk\n l\n```\n\n> z\n\n| h | i |\n| --- | --- |\n| 1 | 2 |"


def test_main_text_needs_its_share():
    long = " ".join(["w"] * 130)
    assert E.main_text(parse(f"<article>{long}</article><p>rest</p>")) == long
    assert "rest" in E.main_text(parse(f"<article>{' '.join(['w'] * 119)}</article><p>rest</p>"))
    assert "rest" in E.main_text(parse(f"<article>{long}</article><p>{' '.join(['rest'] * 400)}</p>"))
