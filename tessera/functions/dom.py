"""A small HTML tree: building, text, selectors and serialising.

Built on the standard library's tokenizer, with implied ends of paragraphs, list
items, options and table parts, void elements, raw text, implied html, head and
body, and reopening of formatting elements that were left open.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEAD = frozenset("base link meta title style script noscript".split())
#: Elements that end an open paragraph.
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: What a start tag closes if it is open, up to the element in the second set.
CLOSES = {
    "li": (("li",), ("ul", "ol")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
}


class Element:
    __slots__ = ("name", "attrs", "kids", "up")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, up: Element | None = None):
        self.name, self.attrs, self.kids, self.up = name, attrs or {}, [], up

    def walk(self):
        """This element and all below it, in document order."""
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(k for k in reversed(e.kids) if isinstance(k, Element))

    def texts(self) -> list[str]:
        """The text nodes below, in order."""
        out, stack = [], [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                out.append(e)
            else:
                stack.extend(reversed(e.kids))
        return out


class _Builder(HTMLParser):
    def __init__(self, fragment: bool):
        super().__init__(convert_charrefs=True)
        self.root = Element("html")
        self.body = self.root if fragment else None
        self.fragment = fragment
        self.at = self.root
        self.open_formats: list[tuple[str, dict]] = []

    def _in_body(self):
        if self.body is None:
            self.body = Element("body", {}, self.root)
            self.root.kids.append(self.body)
            self.at = self.body

    def _open(self, names, stop=()):
        e = self.at
        while e is not None and e.name not in stop:
            if e.name in names:
                return e
            e = e.up
        return None

    def _reopen(self):
        have = set()
        e = self.at
        while e is not None:
            have.add(e.name)
            e = e.up
        for name, attrs in self.open_formats:
            if name not in have:
                self._add(name, dict(attrs))

    def _add(self, name, attrs):
        e = Element(name, attrs, self.at)
        self.at.kids.append(e)
        if name not in VOID:
            self.at = e

    def handle_starttag(self, tag, attrs):
        attrs = {k: v if v is not None else "" for k, v in reversed(attrs)}
        attrs = dict(reversed(attrs.items()))
        if tag == "html":
            for k, v in attrs.items():
                self.root.attrs.setdefault(k, v)
            return
        if not self.fragment:
            if tag == "head":
                if self.body is None and self.at is self.root:
                    self._add("head", attrs)
                return
            if tag == "body":
                if self.body is None:
                    self.body = Element("body", attrs, self.root)
                    self.root.kids.append(self.body)
                    self.at = self.body
                return
            if self.body is None:
                if tag in HEAD:
                    if self.at is self.root:
                        self._add("head", {})
                    self._add(tag, attrs)
                    return
                self._in_body()
        if tag in BLOCKS:
            p = self._open(("p",), ("button", "table"))
            if p is not None:
                self.at = p.up
        if tag in CLOSES:
            names, stop = CLOSES[tag]
            while (e := self._open(names, stop)) is not None:
                self.at = e.up
        if tag not in BLOCKS and tag not in RAW:
            self._reopen()
        if tag == "a" and (e := self._open(("a",))) is not None:
            self.handle_endtag("a")
        self._add(tag, attrs)
        if tag in FORMATTING:
            self.open_formats.append((tag, attrs))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in VOID or tag in ("html", "body"):
            return
        if tag == "head":
            if self.body is None:
                self.at = self.root
            return
        if tag in FORMATTING:
            for i in range(len(self.open_formats) - 1, -1, -1):
                if self.open_formats[i][0] == tag:
                    del self.open_formats[i]
                    break
        e = self._open((tag,))
        if e is None or e is self.root or e is self.body:
            return
        self.at = e.up

    def handle_data(self, data):
        if not data:
            return
        if self.body is None and not self.fragment:
            inside = self.at is not self.root and self.at.name != "head"
            if not inside:
                if not data.strip():
                    return
                self._in_body()
        if self.at.name not in RAW and self.at.name not in ("title", "textarea") and data.strip():
            self._reopen()
        kids = self.at.kids
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


def parse(html: str, fragment: bool = False) -> Element:
    """The html element of a document, or one that holds a fragment's nodes."""
    b = _Builder(fragment)
    b.feed(html)
    b.close()
    if not fragment:
        b._in_body()
    return b.root


def escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attr(s: str) -> str:
    return s.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace('"', "&quot;")


def start_tag(e: Element) -> str:
    return f"<{e.name}" + "".join(f' {k}="{escape_attr(v)}"' for k, v in e.attrs.items()) + ">"


def outer_html(e: Element) -> str:
    out: list[str] = []
    stack: list = [e]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, str):
            out.append(escape(x))
        else:
            out.append(start_tag(x))
            if x.name in VOID:
                continue
            stack.append((f"</{x.name}>",))
            if x.name in RAW:
                out.extend(k for k in x.kids if isinstance(k, str))
            else:
                stack.extend(reversed(x.kids))
    return "".join(out)


def inner_html(e: Element) -> str:
    return "".join(escape(k) if isinstance(k, str) and e.name not in RAW else k if isinstance(k, str) else outer_html(k) for k in e.kids)


_SIMPLE = re.compile(r"(?P<tag>[A-Za-z][\w-]*|\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<q>[^\"]*)\"|'(?P<s>[^']*)'|(?P<w>[\w-]+))\s*)?\]")


class Selector:
    """A subset of CSS: lists, descendants and children of tag, #id, .class and [attr], =, ~=, |=, ^=, $=, *=. ValueError for others."""

    def __init__(self, text: str):
        self.choices = []
        for part in text.split(","):
            tokens = re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", part.strip())
            if not tokens:
                raise ValueError(text)
            steps, child = [], False
            for t in tokens:
                if t == ">":
                    if not steps or child:
                        raise ValueError(text)
                    child = True
                else:
                    steps.append((child, self._simple(t)))
                    child = False
            if child:
                raise ValueError(text)
            self.choices.append(steps)

    @staticmethod
    def _simple(t: str):
        tests, at = [], 0
        while at < len(t):
            m = _SIMPLE.match(t, at)
            if not m or (m["tag"] and at):
                raise ValueError(t)
            at = m.end()
            value = next((m[k] for k in "qsw" if m[k] is not None), None)
            tests.append((m["tag"], m["id"], m["cls"], m["attr"], m["op"], value))
        return tests

    @staticmethod
    def _fits(e: Element, tests) -> bool:
        for tag, id_, cls, attr, op, value in tests:
            if tag:
                if tag != "*" and tag.lower() != e.name:
                    return False
            elif id_:
                if e.attrs.get("id") != id_:
                    return False
            elif cls:
                if cls not in e.attrs.get("class", "").split():
                    return False
            else:
                have = e.attrs.get(attr.lower())
                if have is None:
                    return False
                if op is None:
                    continue
                ok = {
                    "=": have == value,
                    "~=": value in have.split(),
                    "|=": have == value or have.startswith(f"{value}-"),
                    "^=": bool(value) and have.startswith(value),
                    "$=": bool(value) and have.endswith(value),
                    "*=": bool(value) and value in have,
                }[op]
                if not ok:
                    return False
        return True

    def matches(self, e: Element) -> bool:
        return any(self._chain(e, steps, len(steps) - 1) for steps in self.choices)

    def _chain(self, e, steps, i) -> bool:
        child, tests = steps[i]
        if not self._fits(e, tests):
            return False
        if i == 0:
            return True
        up = e.up
        if child:
            return up is not None and self._chain(up, steps, i - 1)
        while up is not None:
            if self._chain(up, steps, i - 1):
                return True
            up = up.up
        return False

    def select(self, root: Element) -> list[Element]:
        return [e for e in root.walk() if self.matches(e)]
