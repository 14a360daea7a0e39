"""Batches of requests: limits, order and per-host waves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host_key
from ..plans.requests import BATCH
from .order import numbered


# fixed values: why a batch is turned away
EMPTY_BATCH = "requests must contain at least one item"
LARGE_BATCH = "batch size exceeds configured maximum: {most}"


def batch_error(n: Column | int, most: int = BATCH["most"], default: int = BATCH["default"]) -> Column:
    """Why a batch of n requests is turned away, or null; the limit is the larger of both, the message tells of most."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(n == 0, EMPTY_BATCH).when(n > max(most, default), LARGE_BATCH.format(most=most))


def waves(requests: DataFrame, per_host: int = BATCH["per_host_concurrency"]) -> DataFrame:
    """requests with host and wave, so that no wave has more than per_host requests of a host; a URL without host is of host ''."""
    placed = numbered(requests.withColumn("host", host_key("url")), "place", "index", ("host",))
    return placed.withColumn("wave", F.ceil(F.col("place") / max(per_host, 1)).cast("long")).drop("place")


def batch_items(answers: DataFrame, plan: DataFrame, response: list[str]) -> DataFrame:
    """One row per request, in the order of index: ok, duration_ms, response, or the error that turned it away. A request that fails spoils no other."""
    got = answers.select(F.col("request_id").alias("index"), "duration_ms", F.struct(*response).alias("response"))
    out = plan.select("index", F.col("error").alias("request_error")).join(got, "index", "left")
    return out.select("index", F.col("request_error").isNull().alias("ok"), F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"), F.when(F.col("request_error").isNull(), F.col("response")).alias("response"), F.col("request_error").alias("error")).orderBy("index")


def crawl_items(summaries: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per crawl request (plan of crawl_plan), in the order of index: ok, root_url, pages_fetched, unique_links_seen, or the error that turned it away.

    summaries: (seed, pages_fetched, unique_links_seen), seed = index; a crawl
    that fetched nothing is not an error.
    """
    out = plan.select("index", F.col("url").alias("root_url"), "error").join(summaries.withColumnRenamed("seed", "index"), "index", "left")
    ok = F.col("error").isNull()
    told = [F.when(ok, F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c) for c in ("pages_fetched", "unique_links_seen")]
    return out.select("index", ok.alias("ok"), F.when(ok, F.col("root_url")).alias("root_url"), *told, "error").orderBy("index")
