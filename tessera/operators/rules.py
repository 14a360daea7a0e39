"""Site rules: settings for hosts and paths, of which the most particular one holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host_key, resolved


def host_suffixes(host: Column) -> Column:
    """A host and all that it belongs to: itself, its domains label by label, and '' for every host."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    own = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(host == "", F.array(F.lit(""))).otherwise(F.array_append(own, F.lit("")))


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (page_id, url, ...) with the columns of the rule that holds for each, null where none does.

    rules: (rule_id, domain, path_prefix, settings...). A rule is for its domain and
    all hosts below it, an empty or null domain for all hosts, and for paths that are
    its prefix or lie below it, an empty or null prefix for all. The longest domain
    counts, then the longest prefix, then the smallest rule_id. A host is taken apart
    into its suffixes, so that rules are found by equality; what belongs to one page
    is told apart where the page is, and only the winner's id moves. URLs without a
    host match no rule but those for all hosts.
    """
    own = [c for c in rules.columns if c not in ("domain", "path_prefix")]
    low = rules.select(F.struct(*own).alias("__rule"), F.lower(F.coalesce("domain", F.lit(""))).alias("__domain"), F.regexp_replace(F.coalesce("path_prefix", F.lit("")), r"/+\z", "").alias("__prefix"))
    path = F.regexp_extract(resolved("url", F.lit("")), r"^https?://[^/?]*(/[^?]*)", 1)
    asked = pages.select("page_id", "url").distinct().select("page_id", "url", F.coalesce(path, F.lit("")).alias("__path"), F.explode(host_suffixes(F.coalesce(host_key("url"), F.lit("")))).alias("__domain"))
    at, prefix = F.col("__path"), F.col("__prefix")
    met = asked.join(low, "__domain").where((prefix == "") | (at == prefix) | at.startswith(F.concat(prefix, F.lit("/"))))
    best = met.groupBy(F.col("page_id").alias("__page"), F.col("url").alias("__url")).agg(F.min_by("__rule", F.struct(-F.length("__domain"), -F.length("__prefix"), F.col("__rule.rule_id"))).alias("__rule"))
    out = pages.join(best, F.col("page_id").eqNullSafe(F.col("__page")) & F.col("url").eqNullSafe(F.col("__url")), "left")
    return out.select(*[f"`{c}`" for c in pages.columns], *[F.col(f"__rule.{c}").alias(c) for c in own])
