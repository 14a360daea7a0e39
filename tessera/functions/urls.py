"""URLs: validation, host and comparison, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, col

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_key(url: Column | str) -> Column:
    """The host in lower case, without port and user; empty if there is none."""
    return ascii_lower(F.regexp_extract(col(url), HOST, 1))


def url_error(url: Column | str) -> Column:
    """Why the URL can't be a target, or null."""
    url = col(url)
    scheme = ascii_lower(F.regexp_extract(url, SCHEME, 1))
    return (
        F.when(url.isNull() | (scheme == ""), "url must be a valid absolute URL")
        .when(~scheme.isin("http", "https"), "url must use http or https")
        .when(F.regexp_extract(url, HOST, 1) == "", "url must be a valid absolute URL")
    )


def urls_match(a: Column | str, b: Column | str) -> Column:
    """Equal but for slashes at the end."""
    return F.rtrim(col(a), F.lit("/")) == F.rtrim(col(b), F.lit("/"))


#: Parameters that tell where a reader came from, not what the page is.
TRACKING = r"utm_[^=]*|gclid|fbclid|msclkid|mc_cid|mc_eid|igshid|ref"
_SCHEME = r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?"


def _split(url: Column) -> dict[str, Column]:
    """Scheme, authority (with its slashes), path and query (with its mark) of a URL or reference; empty where they are missing."""
    return {
        "scheme": ascii_lower(F.regexp_extract(url, SCHEME, 1)),
        "authority": F.regexp_extract(url, rf"^{_SCHEME}(//[^/?#]*)", 1),
        "path": F.regexp_extract(url, rf"^{_SCHEME}(?://[^/?#]*)?([^?#]*)", 1),
        "query": F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1),
    }


def _authority(authority: Column, scheme: Column) -> Column:
    """Host in lower case and port, without user and the scheme's own port."""
    host = ascii_lower(F.regexp_replace(authority, r"^//(?:.*@)?", ""))
    return F.regexp_replace(F.when(scheme == "http", F.regexp_replace(host, r":80\z", "")).otherwise(F.regexp_replace(host, r":443\z", "")), r":\z", "")


def let(value: Column, use) -> Column:
    """use(value), the value being computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _dots(segments: Column) -> Column:
    none = F.array().cast("array<string>")
    kept = F.aggregate(F.slice(segments, 2, F.greatest(F.size(segments), F.lit(1))), none, lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)))
    end = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise("")
    return F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/"), end), r"^//\z", "/")


def without_dots(path: Column) -> Column:
    """An absolute path without . and .. segments; .. at the root stays there."""
    return let(F.split(path, "/"), _dots)


def _joined(x: Column) -> Column:
    b, r = x["b"], x["r"]
    own, placed = r["scheme"] != "", r["authority"] != ""
    scheme = F.when(own, r["scheme"]).otherwise(b["scheme"])
    authority = F.when(placed, r["authority"]).when(own, F.lit("")).otherwise(b["authority"])
    folder = F.regexp_replace(b["path"], r"[^/]*\z", "")
    path = F.when(placed | own, r["path"]).when(r["path"] == "", b["path"]).when(r["path"].startswith("/"), r["path"]).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), r["path"]))
    query = F.when(~placed & ~own & (r["path"] == "") & (r["query"] == ""), b["query"]).otherwise(r["query"])
    return named({"scheme": scheme, "authority": authority, "path": F.regexp_replace(path, "^(?!/)", "/"), "query": query})


def _written(x: Column) -> Column:
    whole = F.concat(x["scheme"], F.lit("://"), x["host"], without_dots(x["path"]), x["query"])
    return F.when(x["scheme"].isin("http", "https") & (x["host"] != ""), whole)


def named(values: dict[str, Column]) -> Column:
    return F.named_struct(*[c for n, v in values.items() for c in (F.lit(n), v)])


def _parts(url: Column) -> Column:
    return named(_split(url))


def resolved(base: Column | str, reference: Column | str) -> Column:
    """The absolute http or https URL that a reference on a page means, without fragment and user; null for other schemes and where there is no host.

    Blanks around it and line ends within are dropped. A null base or reference is null.
    """
    clean = F.regexp_replace(col(reference), r"[\t\r\n\x0c]|^[\t\r\n\x0c ]+|[\t\r\n\x0c ]+\z", "")
    both = let(named({"b": col(base), "r": clean}), lambda x: F.when(x["b"].isNotNull() & x["r"].isNotNull(), named({"b": _parts(x["b"]), "r": _parts(x["r"])})))
    met = let(let(both, _joined), lambda x: named({"scheme": x["scheme"], "host": _authority(x["authority"], x["scheme"]), "path": x["path"], "query": x["query"]}))
    return let(met, _written)


def without_tracking(url: Column | str, names: str = TRACKING) -> Column:
    """A URL without the parameters whose names match; the others keep their order, and a query that is left empty goes."""

    def cut(u):
        kept = F.array_join(F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: (x != "") & ~x.rlike(rf"^(?i)(?:{names})(?:=|\z)")), "&")
        return F.concat(F.regexp_extract(u, r"^[^?#]*", 0), F.regexp_replace(kept, "^(?=.)", "?"), F.regexp_extract(u, r"(#.*)?\z", 1))

    return let(col(url), cut)


def page_key(url: Column | str) -> Column:
    """What URLs of one page have in common: host, path without a slash at its end, and query without tracking; http and https are one."""
    plain = without_tracking(resolved(url, F.lit("")))
    return F.regexp_replace(F.regexp_replace(plain, r"^https?://", ""), r"/+(?=\?|\z)", "")
