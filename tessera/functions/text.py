"""Page signals as native columns: words, plain text, densities, language, markdown clean-up.

Signals are those of the whole page, however long. Bytes are those of UTF-8.
Lower-casing is that of A-Z only.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: marks of challenge pages
CHALLENGE_MARKERS = (
    "cloudflare",
    "captcha",
    "access denied",
    "verify you are a human",
    "attention required",
    "datadome",
    "akamai",
    "bot detection",
    "security check",
    "please enable javascript and cookies",
    "oops!! something went wrong",
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of html from which on its open blocks are looked for first, which changes no result.
LONG_BYTES = 1 << 16
#: Script and style blocks, then any tag up to the first ">".
TAGS = r"(?is)<[ \t\n\f\r]*script.*?</script>|<[ \t\n\f\r]*style.*?</style>|<[^>]*(?:>|\z)"
ANY_TAG = r"(?s)<[^>]*(?:>|\z)"
SPACE = r"\p{IsWhite_Space}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    return F.translate(col(c), UPPER, LOWER)


def head_bytes(c: Column | str, n: int) -> Column:
    """The first n bytes, without the character that the cut splits."""
    c = col(c)
    cut = F.make_valid_utf8(F.substring(c.cast("binary"), 1, n).cast("string"))
    return F.when(F.octet_length(c) <= n, c).otherwise(F.regexp_replace(cut, "�+$", ""))


def once(c: Column, f) -> Column:
    """f of a value that it reads several times and that is computed once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def without_open_blocks(html: Column | str, name: str) -> Column:
    """html whose openings of a block (script or style) that no end follows have "<_" for a name: they are tags as any, and TAGS needn't read to the end of the page for each of them. The last end gets a "<_" before it, which is inside of the block or the tag."""
    return F.regexp_replace(col(html), rf"(?is)(\A.*)(</{name}>)|(<[ \t\n\f\r]*){name}", "$1$3<_$2")


def visible_word_count(html: Column | str) -> Column:
    """Words outside of tags, scripts and styles, entities as they are."""
    html = col(html)
    page = F.when(F.octet_length(html) > LONG_BYTES, without_open_blocks(without_open_blocks(html, "script"), "style")).otherwise(html)
    text = F.regexp_replace(page, TAGS, " ")
    return F.regexp_count(text, F.lit(r"[^ \t\n\f\r]+")).cast("long")


def plain_text(html: Column | str) -> Column:
    """The html without its tags, each run of white space one blank; scripts and styles stay."""
    return F.regexp_replace(F.regexp_replace(col(html), ANY_TAG, ""), f"{SPACE}+", " ")


def challenge_hit(html: Column | str) -> Column:
    return col(html).rlike("(?i)" + "|".join(m.replace("!", "[!]") for m in CHALLENGE_MARKERS))


def words(plain: Column | str) -> Column:
    return F.filter(F.split(ascii_lower(plain), " "), lambda x: x != "")


def unique_word_ratio(plain: Column | str) -> Column:
    w = words(plain)
    return F.when(F.size(w) == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(w)) / F.size(w))


def boilerplate_ratio(html: Column | str, word_count: Column | str) -> Column:
    html = col(html)
    tags = (F.length(html) - F.length(F.replace(html, F.lit("<"), F.lit("")))) / F.greatest(F.octet_length(html), F.lit(1))
    return F.least(F.lit(1.0), 0.7 * F.least(F.lit(1.0), tags) + F.when(col(word_count) < 80, 0.35).otherwise(0.0))


def contains_text(html: Column | str, needle: Column | str) -> Column:
    """Whether html holds the needle, A-Z and a-z alike; an empty needle is everywhere."""
    needle = col(needle)
    return (needle == "") | F.contains(ascii_lower(html), ascii_lower(needle))


def content_density(html: Column | str, plain: Column | str) -> Column:
    return F.least(F.lit(1.0), F.octet_length(col(plain)) / F.greatest(F.octet_length(col(html)), F.lit(1)))


def link_density(links: Column | str, word_count: Column | str) -> Column:
    n = col(word_count)
    return F.when(n > 0, F.least(col(links) / n, F.lit(20.0)) / 20.0).otherwise(F.lit(1.0))


def blocked_likelihood(status: Column | str, waf: Column | str, challenge: Column | str) -> Column:
    status = col(status)
    # fixed values: statuses that tell of a block
    return F.when(col(waf) | col(challenge), 0.85).when(status.isin(403, 429, 503, 407, 408, 409, 425, 451), 0.75).when(status >= 500, 0.55).otherwise(0.0)


def language_hint(plain: Column | str) -> Column:
    """und if more than a quarter of the first 4000 characters are neither ASCII letters or digits nor white space, else en; null without text."""
    sample = F.left(col(plain), F.lit(4000))
    odd = F.length(F.regexp_replace(sample, f"[A-Za-z0-9{SPACE}]", ""))
    return F.when(F.length(sample) == 0, F.lit(None).cast("string")).when(4 * odd > F.length(sample), "und").otherwise("en")


def strip_data_images(markdown: Column | str) -> Column:
    """Without images whose source is a data URI; one that isn't closed goes to the end."""
    return F.regexp_replace(col(markdown), r"!\[(?:(?!!\[)[\s\S])*?\]\(data:image[^)]*(?:\)|\z)", "")


def collapse_blank_lines(markdown: Column | str) -> Column:
    """At most one blank line in a row, none at the ends."""
    return F.regexp_replace(F.regexp_replace(col(markdown), "\n{3,}", "\n\n"), rf"\A{SPACE}+|{SPACE}+\z", "")


def normalize_markdown(markdown: Column | str) -> Column:
    return collapse_blank_lines(strip_data_images(markdown))


def truncate(c: Column | str, n: Column | int) -> Column:
    """The first n characters."""
    return F.left(col(c), n if isinstance(n, Column) else F.lit(n))


# Forms that read html by pattern; equal to the parsed page where it is well formed. A tag ends at the next < or >, so
# that a page of unclosed tags, however long, is read in one go.


#: What a page holds but doesn't show: comments, scripts and styles.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"


def markup(html: Column | str) -> Column:
    """A page without comments, scripts and styles, whose text is no markup; the forms below are to be asked of it."""
    return F.regexp_replace(col(html), HIDDEN, "")


def pattern_link_count(html: Column | str) -> Column:
    return F.regexp_count(col(html), F.lit(r"(?i)<a\b[^<>]*\shref\s*=")).cast("long")


def pattern_filled_link_count(html: Column | str) -> Column:
    """Links whose target isn't blank, as the benchmark counts them."""
    return F.regexp_count(col(html), F.lit(r"""(?i)<a\b[^<>]*\shref\s*=\s*(?:"\s*[^"\s]|'\s*[^'\s]|[^"'\s>])""")).cast("long")


_SIMPLE = r"([a-zA-Z][a-zA-Z0-9-]*|\*)?((?:[.#][\w-]+|\[[\w-]+(?:[*]?=[\w-]+)?\])*)"


def opening(selector: str) -> str:
    """The pattern of the opening tags that a selector of one element matches: a tag, classes, ids and [attribute], [attribute=word], [attribute*=part], in any number."""
    m = re.fullmatch(_SIMPLE, selector.strip())
    if not m or not selector.strip():
        raise ValueError(f"not a selector of one element: {selector}")
    wanted = ""
    for sign, name in re.findall(r"([.#])([\w-]+)", re.sub(r"\[.*?\]", "", m[2])):
        value = re.escape(name)
        inside = (lambda q, v=value: rf"(?:[^{q}]*\s)?{v}(?:\s[^{q}]*)?") if sign == "." else (lambda q, v=value: v)
        wanted += _attribute("class" if sign == "." else "id", inside, value)
    for name, part, value in re.findall(r"\[([\w-]+)(?:([*]?)=([\w-]+))?\]", m[2]):
        v = re.escape(value)
        wanted += _attribute(name, (lambda q, v=v, part=part: rf"[^{q}]*{v}[^{q}]*" if part else v), rf"[^\s>\"']*{v}[^\s>\"']*" if part else v) if value else rf"(?=[^<>]*\s{re.escape(name)}[\s=/>])"
    tag = "[a-zA-Z][a-zA-Z0-9-]*" if m[1] in (None, "*") else re.escape(m[1])
    return rf"(?is)<({tag})(?=[\s/>]){wanted}[^<>]*>"


def _attribute(name: str, inside, bare: str) -> str:
    return rf"""(?=[^<>]*\s{re.escape(name)}\s*=\s*(?:"{inside('"')}"|'{inside("'")}'|{bare}(?=[\s/>])))"""


def pattern_selector(html: Column | str, selector: str) -> Column:
    """Whether a page has an element that a selector of one element matches; see opening."""
    return col(html).rlike(opening(selector))


# fixed values: selectors of main content
MAIN_BLOCKS = ("article", "main", "[role=main]", "section[id*=content]", "div[id*=content]", "section[class*=content]", "div[class*=content]", "section[class*=article]", "div[class*=article]")


def pattern_main_block(html: Column | str, selectors: tuple[str, ...], least: int = 40) -> Column:
    """struct(tag, words) of the block of most words, at least `least`, among the elements that the selectors match; of equal ones that of the first selector, then the first. Null fields without one. An element ends at the first end of its tag."""
    def words(block: Column) -> Column:
        return F.regexp_count(unescape(F.regexp_replace(block, ANY_TAG, " ")), F.lit(rf"[^{SPACE}]+")).cast("long")

    def blocks(k: int, selector: str) -> Column:
        whole = rf"{opening(selector)}(.*?)</\1\s*>"
        tags, bodies = (F.regexp_extract_all(col(html), F.lit(whole), F.lit(g)) for g in (1, 2))
        return F.zip_with(F.transform(tags, lambda t, i: F.named_struct(F.lit("selector"), F.lit(-k), F.lit("place"), -i, F.lit("tag"), ascii_lower(t))), bodies, lambda at, body: F.named_struct(F.lit("words"), words(body), F.lit("selector"), at["selector"], F.lit("place"), at["place"], F.lit("tag"), at["tag"]))

    found = [blocks(k, selector) for k, selector in enumerate(selectors)]
    best = F.array_max(F.filter(F.concat(*found), lambda x: x["words"] >= least))
    return F.get(F.transform(F.array(best), lambda b: F.named_struct(F.lit("tag"), b["tag"], F.lit("words"), b["words"])), F.lit(0))


def pattern_heading_count(html: Column | str) -> Column:
    return F.regexp_count(col(html), F.lit(r"(?i)<h[1-6](?=[\s/>])")).cast("long")


def pattern_code_count(html: Column | str) -> Column:
    return F.regexp_count(col(html), F.lit(r"(?i)<(?:pre|code)(?=[\s/>])")).cast("long")


# fixed values: entities that pages of plain prose use; "&amp;" comes last
ENTITIES = (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(c: Column | str) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, col(c))


def pattern_title(html: Column | str) -> Column:
    t = F.regexp_extract(col(html), r"(?is)\A(?>.*?<title[^<>]*>)(.*?)</title>", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(unescape(t), f"{SPACE}+", " "), "^ | $", ""), F.lit(""))


def body_text(html: Column | str) -> Column:
    """The text of a page's body, a blank between its pieces. A tag that isn't closed is text; none is looked for after the last ">"."""
    body = F.regexp_extract(col(html), r"(?is)<body[^<>]*>(.*)\z", 1)

    def pieces(b: Column) -> Column:
        rest = F.substring_index(b, ">", -1)
        head = F.split(F.left(b, F.length(b) - F.length(rest)), "<[^>]*>")
        return once(head, lambda p: F.concat(F.slice(p, F.lit(1), F.size(p) - 1), F.array(F.concat(F.element_at(p, -1), rest))))

    return unescape(F.array_join(F.filter(once(body, pieces), lambda x: x != ""), " "))


def main_score(html: Column | str, text: Column | str) -> Column:
    """Share of text, length of text and a main element, weighed to 0..1, of a page and its body_text."""
    html, text = col(html), col(text)
    n = F.greatest(F.regexp_count(text, F.lit(rf"[^{SPACE}]+")), F.lit(1))
    density = F.least(F.lit(1.0), F.octet_length(text) / F.greatest(F.octet_length(html), F.lit(1)))
    bonus = F.when(html.rlike("(?i)<(article|main)[^a-z]"), 0.12).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.75 * density + 0.2 * F.least(n, F.lit(800)) / 800 + bonus))


def pattern_main_score(html: Column | str) -> Column:
    return once(body_text(html), lambda text: main_score(html, text))
