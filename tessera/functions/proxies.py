"""Proxy addresses: normalising, request lists and rotation, as native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, col

# fixed values: schemes of proxies
SCHEMES = ("http", "https", "socks5", "socks5h")
BAD_SCHEME = "proxy entries must use http://, https://, socks5://, or socks5h://"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def has_scheme(v: Column) -> Column:
    out = F.lit(False)
    for s in SCHEMES:
        out = out | v.startswith(f"{s}://")
    return out


def normalize_proxy(value: Column | str, scheme: Column | str = "http") -> Column:
    """struct(proxy, error); both null for a blank or a comment.

    host:port:user:password becomes scheme://user:password@host:port; an unknown
    default scheme is http.
    """
    v = trimmed(col(value))
    scheme = F.lit(scheme) if isinstance(scheme, str) else scheme
    scheme = F.when(scheme.isin(*SCHEMES), scheme).otherwise("http")
    p = F.split(v, ":")
    four = ~v.contains("@") & (F.size(p) == 4)
    blank = F.exists(p, lambda x: trimmed(x) == "")
    skip = v.isNull() | (v == "") | v.startswith("#")
    proxy = (
        F.when(skip, None)
        .when(has_scheme(v), v)
        .when(v.contains("://"), None)
        .when(four & blank, None)
        .when(four, F.concat(scheme, F.lit("://"), F.get(p, F.lit(2)), F.lit(":"), F.get(p, F.lit(3)), F.lit("@"), F.get(p, F.lit(0)), F.lit(":"), F.get(p, F.lit(1))))
        .when(v.contains(":"), F.concat(scheme, F.lit("://"), v))
    )
    error = (
        F.when(skip | has_scheme(v), None)
        .when(v.contains("://"), BAD_SCHEME)
        .when(four & blank, "proxy entries must include host and port")
        .when(~v.contains(":"), "proxy entries must include host:port")
    )
    return F.struct(proxy.cast("string").alias("proxy"), error.cast("string").alias("error"))


def request_proxies(list_: Column | str, most: Column | int) -> Column:
    """struct(proxies, error) of a request's own list: null stays null, blanks go, one bad scheme or too many spoil the request."""
    own = F.filter(F.transform(col(list_), trimmed), lambda x: x != "")
    most = most if isinstance(most, Column) else F.lit(most)
    error = F.when(F.exists(own, lambda x: ~has_scheme(x)), BAD_SCHEME).when(F.size(own) > most, F.concat(F.lit("proxy list exceeds configured maximum: "), most.cast("string")))
    return F.struct(F.when(error.isNull() & (F.size(own) > 0), own).alias("proxies"), error.alias("error"))


def rotated(pool: Column, cursor: Column, most: Column | int) -> Column:
    """min(most, n) entries of the pool in a circle from cursor mod n on; null for an empty pool."""
    n = F.size(pool)
    most = most if isinstance(most, Column) else F.lit(most)
    return F.when(n > 0, F.slice(F.concat(pool, pool), F.pmod(cursor, n).cast("int") + 1, F.least(most, n).cast("int")))


def bench_proxy(value: Column | str) -> Column:
    """The proxy of a benchmark list, or null: two or four parts, or a user before a host with a port."""
    v = trimmed(col(value))
    p = F.split(v, ":")
    return (
        F.when(v.isNull() | (v == "") | v.startswith("#"), None)
        .when(v.contains("://"), v)
        .when(v.contains("@"), F.when(F.substring_index(v, "@", -1).contains(":"), F.concat(F.lit("http://"), v)))
        .when(F.size(p) == 2, F.concat(F.lit("http://"), v))
        .when(F.size(p) == 4, F.concat(F.lit("http://"), F.get(p, F.lit(2)), F.lit(":"), F.get(p, F.lit(3)), F.lit("@"), F.get(p, F.lit(0)), F.lit(":"), F.get(p, F.lit(1))))
    )


def accepted(lines: DataFrame, most: int, scheme: str = "http", first_only: bool = False, form=None) -> DataFrame:
    """Rows (line_no, proxy) of lines (line_no, line): bad ones go, at most `most` stay, in order; first_only: repeated ones once."""
    got = lines.select("line_no", (normalize_proxy("line", scheme)["proxy"] if form is None else form("line")).alias("proxy")).where("proxy is not null")
    if first_only:
        got = got.groupBy("proxy").agg(F.min("line_no").alias("line_no"))
    # a top-k by line, so that no window over all lines is needed
    return got.select("line_no", "proxy").orderBy("line_no").limit(most)
