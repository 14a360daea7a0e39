"""Extraction of main content from a parsed page: pruning, Markdown and text."""

from __future__ import annotations

import math
import re
from functools import lru_cache

from .dom import RAW, VOID, Element, Selector, escape, escape_attr, outer_html, parse
from .text import MAIN_BLOCKS

# fixed values: weight of each tag in an element's score, 0.5 for others
TAG_WEIGHT = {"div": 0.5, "p": 1.0, "article": 1.5, "section": 1.0, "span": 0.3, "li": 0.5, "ul": 0.5, "ol": 0.5, "h1": 1.2, "h2": 1.1, "h3": 1.0, "h4": 0.9, "h5": 0.8, "h6": 0.7}
# fixed values: importance of each tag for the dynamic threshold, 0.5 for others
TAG_IMPORTANCE = {"article": 1.5, "main": 1.4, "section": 1.3, "p": 1.2, "h1": 1.4, "h2": 1.3, "h3": 1.2, "div": 0.7, "span": 0.6}
# fixed values: weights of text share, few links, tag, class (which counts nothing) and length
WEIGHTS = (0.4, 0.2, 0.2, 0.1, 0.1)
# fixed values: what is dropped before extraction
HOSTILE = Selector("script, style, link[rel=stylesheet], nav, footer, header, aside, form, iframe, noscript, [role=navigation], [role=contentinfo], [data-ad], [class*=ad-], [id*=ad-], [class*=ads]")
# fixed values: where main content is looked for, in this order
MAIN = [Selector(s) for s in MAIN_BLOCKS]
# fixed values: elements of main content that raise a page's score
MAIN_BONUS = Selector("main, article, [role=main]")

PROFILES = {
    "balanced": (0.48, "fixed", 5),
    "docs": (0.32, "dynamic", 3),
    "article": (0.38, "dynamic", 4),
    "repo": (0.36, "fixed", 3),
    "minimal": (0.58, "fixed", 10),
}


def octets(s: str) -> int:
    return len(s.encode("utf-8", "surrogatepass"))


def head(s: str, n: int) -> str:
    """The first n bytes, without the character that the cut splits."""
    return s if len(s) * 4 <= n else s.encode("utf-8", "surrogatepass")[:n].decode("utf-8", "ignore")


def without(root: Element, selector: Selector) -> Element:
    """root with what the selector matches taken out."""
    gone = {id(e) for e in root.walk() if selector.matches(e)}
    if gone:
        for e in root.walk():
            e.kids = [k for k in e.kids if isinstance(k, str) or id(k) not in gone]
    return root


def words_in(e: Element) -> int:
    return len(" ".join(e.texts()).split())


def main_block(root: Element) -> Element | None:
    """The block with most words, at least 40; the first among equals, by selector and then by place."""
    best, most = None, 39
    for selector in MAIN:
        for e in selector.select(root):
            n = words_in(e)
            if n > most:
                best, most = e, n
    return best


class Pruner:
    """Scores every element once, from the leaves up, and serialises what stays."""

    def __init__(self, threshold: float, kind: str, min_words: int | None):
        self.threshold, self.dynamic, self.min_words = threshold, kind == "dynamic", min_words

    def measure(self, root: Element) -> None:
        """For each element: words, bytes of text (its text nodes joined by blanks), bytes of inner html, bytes of text of links that are its children."""
        self.of: dict[int, tuple[int, int, int, int]] = {}
        order = list(root.walk())
        tag = {}
        for e in order:
            attrs = sum(len(k) + 4 + octets(escape_attr(v)) for k, v in e.attrs.items())
            tag[id(e)] = len(e.name) + 2 + attrs + (0 if e.name in VOID else len(e.name) + 3)
        nodes: dict[int, int] = {}
        joined: dict[int, str] = {}
        for e in reversed(order):
            size = inner = count = links = 0
            for k in e.kids:
                if isinstance(k, str):
                    size, count = size + octets(k), count + 1
                    inner += octets(k) if e.name in RAW else octets(escape(k))
                else:
                    w, s, h, _ = self.of[id(k)]
                    n = nodes[id(k)]
                    size, count = size + s - max(0, n - 1), count + n
                    inner += h + tag[id(k)]
                    if k.name == "a":
                        links += s
            nodes[id(e)] = count
            text = " ".join(k if isinstance(k, str) else joined.pop(id(k)) for k in e.kids if isinstance(k, str) or nodes[id(k)])
            joined[id(e)] = text
            self.of[id(e)] = (len(text.split()), size + max(0, count - 1), inner, links)

    def score(self, e: Element) -> float:
        words, text, inner, links = self.of[id(e)]
        if self.min_words is not None and words < self.min_words:
            return -1.0
        t, h = max(text, 1), max(inner, 1)
        a, b, c, d, f = WEIGHTS
        s = a * (t / h) + b * (1 - min(links / t, 1.0)) + c * TAG_WEIGHT.get(e.name, 0.5) + d * 0.0 + f * math.log(text + 1)
        return s / (a + b + c + d + f)

    def limit(self, e: Element) -> float:
        t = self.threshold
        if self.dynamic:
            _, text, inner, links = self.of[id(e)]
            tl, hl = max(text, 1), max(inner, 1)
            if TAG_IMPORTANCE.get(e.name, 0.5) > 1.0:
                t *= 0.8
            if tl / hl > 0.4:
                t *= 0.9
            if links / tl > 0.6:
                t *= 1.2
        return t

    def removed(self, e: Element) -> bool:
        s = self.score(e)
        return s < 0 or s < self.limit(e)

    def serialise(self, e: Element) -> str:
        out: list[str] = []
        stack: list = [e]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                out.append(x[0])
            elif isinstance(x, str):
                out.append(x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
            elif not self.removed(x):
                keep = {"a": ("href",), "img": ("src", "alt")}.get(x.name, ())
                attrs = "".join(f' {k}="{x.attrs[k].replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k in keep if k in x.attrs)
                out.append(f"<{x.name}{attrs}>")
                if x.name not in VOID:
                    stack.append((f"</{x.name}>",))
                    stack.extend(reversed(x.kids))
        return "".join(out)


def squeeze(s: str) -> str:
    return re.sub(r"\s+", " ", s)


class _Markdown:
    """Our own Markdown: ATX headings, dashes for list items, fenced code, inline links and images, quotes, pipes for tables."""

    SKIP = frozenset(("script", "style", "svg", "noscript", "head"))

    def block(self, e: Element, depth: int = 0) -> str:
        parts: list[str] = []
        line: list[str] = []

        def flush():
            text = squeeze("".join(line)).strip()
            line.clear()
            if text:
                parts.append(text)

        for k in e.kids:
            if isinstance(k, str):
                line.append(k)
            elif k.name in self.SKIP:
                continue
            elif k.name == "br":
                flush()
            elif k.name in BLOCK_TAGS:
                flush()
                text = self.element(k, depth)
                if text:
                    parts.append(text)
            else:
                line.append(self.inline(k))
        flush()
        return "\n\n".join(parts)

    def element(self, e: Element, depth: int) -> str:
        n = e.name
        if n in ("h1", "h2", "h3", "h4", "h5", "h6"):
            text = squeeze("".join(self.inline(k) for k in e.kids)).strip()
            return f"{'#' * int(n[1])} {text}" if text else ""
        if n == "pre":
            code = "".join(e.texts()).strip("\n")
            return f"```\n{code}\n```" if code.strip() else ""
        if n == "hr":
            return "---"
        if n == "blockquote":
            inner = self.block(e, depth)
            return "\n".join(f"> {x}".rstrip() for x in inner.split("\n")) if inner else ""
        if n in ("ul", "ol"):
            out, i = [], 1
            for k in e.kids:
                if isinstance(k, Element) and k.name not in self.SKIP:
                    inner = self.block(k, depth + 1)
                    if inner:
                        mark = f"{i}. " if n == "ol" else "- "
                        i += 1
                        out.append(mark + inner.replace("\n\n", "\n").replace("\n", "\n" + " " * len(mark)))
            return "\n".join(out)
        if n == "table":
            rows = [[squeeze("".join(self.inline(c) for c in r.kids)).strip().replace("|", "\\|") for r in row.kids if isinstance(r, Element) and r.name in ("td", "th") for c in [r]] for row in e.walk() if row.name == "tr"]
            rows = [r for r in rows if r]
            if not rows:
                return ""
            wide = max(map(len, rows))
            lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
            return "\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]])
        return self.block(e, depth)

    def inline(self, e) -> str:
        if isinstance(e, str):
            return e
        n = e.name
        if n in self.SKIP:
            return ""
        if n == "br":
            return "\n"
        if n == "img":
            return f"![{e.attrs.get('alt', '')}]({e.attrs.get('src', '')})" if e.attrs.get("src") else ""
        if n in BLOCK_TAGS:
            return f" {self.block(e)} "
        inner = "".join(self.inline(k) for k in e.kids)
        core = inner.strip()
        if not core:
            return inner
        lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
        if n == "a":
            href = e.attrs.get("href")
            return f"{lead}[{core}]({href}){tail}" if href else inner
        if n in ("b", "strong"):
            return f"{lead}**{core}**{tail}"
        if n in ("i", "em"):
            return f"{lead}*{core}*{tail}"
        if n in ("code", "kbd", "samp"):
            return f"{lead}`{core}`{tail}"
        return inner


BLOCK_TAGS = frozenset("html body address article aside blockquote dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())


def to_markdown(root: Element) -> str:
    return normalize_markdown(_Markdown().block(root))


DATA_IMAGE = re.compile(r"!\[(?:(?!!\[)[\s\S])*?\]\(data:image[^)]*(?:\)|\Z)")


def normalize_markdown(s: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", DATA_IMAGE.sub("", s)).strip()


def to_text(root: Element) -> str:
    """The text of a page, a line per block; images, scripts and styles give none."""
    out: list[str] = []
    line: list[str] = []

    def flush():
        text = squeeze("".join(line)).strip()
        line.clear()
        if text:
            out.append(text)

    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.name in _Markdown.SKIP:
            continue
        else:
            if x.name in BLOCK_TAGS or x.name == "br":
                flush()
                stack.append(None)
            stack.extend(reversed(x.kids))
    flush()
    return "\n".join(out)


def main_text(root: Element) -> str:
    """The main block's text if it has 120 words and two fifths of the page's, else the page's."""
    full = to_text(root)
    block = main_block(root)
    focused = to_text(block) if block is not None else full
    n, m = len(focused.split()), len(full.split())
    return focused if n >= 120 and (m == 0 or n * 10 >= m * 4) else full


@lru_cache(maxsize=4)
def prepared(html: str) -> tuple[str, str, Element, dict]:
    """(raw_markdown, target, its tree, measures): what all pruning options of a page share."""
    root = without(parse(html), HOSTILE)
    raw = to_markdown(root)
    block = main_block(root)
    body = next((e for e in root.walk() if e.name == "body"), root)
    target = outer_html(block if block is not None else body)
    fragment = parse(target, fragment=True)
    p = Pruner(0.0, "fixed", None)
    p.measure(fragment)
    return raw, target, fragment, p.of


def fit_markdown(html: str, threshold: float, kind: str, min_words: int | None) -> tuple[str, str, str]:
    """(raw_markdown, fit_markdown, fit_html): all that isn't hostile, and what of its main block or body survives pruning."""
    raw, target, fragment, measures = prepared(html)
    p = Pruner(threshold, kind, min_words)
    p.of = measures
    fit = p.serialise(fragment)
    if len(fit.split()) < 10:
        fit = target
    return raw, to_markdown(parse(fit, fragment=True)), fit


@lru_cache(maxsize=256)
def selector(text: str) -> Selector | None:
    try:
        return Selector(text)
    except ValueError:
        return None


def title_of(root: Element) -> str | None:
    e = next((x for x in root.walk() if x.name == "title"), None)
    return (squeeze("".join(e.texts())).strip() or None) if e is not None else None


def main_score(root: Element, sample_bytes: int) -> float:
    body = next((e for e in root.walk() if e.name == "body"), root)
    text = " ".join(body.texts())
    words = max(len(text.split()), 1)
    density = min(1.0, octets(text) / max(sample_bytes, 1))
    bonus = 0.12 if any(MAIN_BONUS.matches(e) for e in root.walk()) else 0.0
    return min(1.0, max(0.0, 0.75 * density + 0.2 * min(words, 800) / 800 + bonus))
