"""Summaries of benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE


def normalized_title(title: Column | str) -> Column:
    t = F.col(title) if isinstance(title, str) else title
    return F.nullif(F.regexp_replace(F.regexp_replace(t, f"{SPACE}+", " "), "^ | $", ""), F.lit(""))


def exclusive_p95(values: Column) -> Column:
    """The 95th percentile of a sorted array by the exclusive method, which goes beyond the largest of few values; the value itself for one, null for none."""
    n = F.size(values)
    m = n + 1
    j = F.least(F.greatest(F.floor(19 * m / 20), F.lit(1)), n - 1).cast("int")
    d = 19 * m - 20 * j
    many = (F.get(values, j - 1) * (20 - d) + F.get(values, j) * d) / 20
    return F.when(n == 0, F.lit(None).cast("double")).when(n == 1, F.get(values, F.lit(0))).otherwise(many)


#: Runs of a tool up to which all are ranked; beyond, those between two quantiles of a sketch, whose rank is within 1 / ACCURACY of the true one.
RANKED, ACCURACY = 4000, 10_000


def p95_latency(runs: DataFrame) -> DataFrame:
    """(tool, p95_latency) of the runs that are ok and have a duration.

    A sketch tells two durations that the percentile lies between, rows are counted
    below them, and only the different durations between them are ranked, by their
    numbers of runs; so that no tool's runs meet in a task. Exact whatever the sketch.
    """
    d = runs.where("ok and duration_s is not null").select("tool", "duration_s")
    marks = F.percentile_approx("duration_s", [0.0, 0.9495, 0.9515, 1.0], ACCURACY)
    told = d.groupBy("tool").agg(F.count("*").alias("n"), marks.alias("m"))
    few = F.col("n") < RANKED
    told = told.select("tool", "n", F.least(F.greatest(F.floor(19 * (F.col("n") + 1) / 20), F.lit(1)), F.col("n") - 1).alias("j"), F.when(few, F.col("m")[0]).otherwise(F.col("m")[1]).alias("low"), F.when(few, F.col("m")[3]).otherwise(F.col("m")[2]).alias("high"))
    met = d.join(told.withColumnRenamed("tool", "__tool"), F.col("tool").eqNullSafe(F.col("__tool"))).where("duration_s <= high")
    by = met.groupBy("tool", F.when(F.col("duration_s") >= F.col("low"), F.col("duration_s")).alias("v")).agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("j").alias("j"))
    upto = F.sum("c").over(Window.partitionBy("tool").orderBy(F.col("v").asc_nulls_first()))
    near = by.withColumn("upto", upto).where("v is not null and upto >= j and upto - c < j + 1")
    two = near.groupBy("tool").agg(F.first("n").alias("n"), F.first("j").alias("j"), F.min_by("v", "upto").alias("a"), F.min_by("v", F.when(F.col("upto") >= F.col("j") + 1, F.col("upto"))).alias("b"))
    t = 19 * (F.col("n") + 1) - 20 * F.col("j")
    return two.select("tool", F.when(F.col("n") == 1, F.coalesce("b", "a")).otherwise((F.col("a") * (20 - t) + F.col("b") * t) / 20).alias("p95_latency"))


def run_errors(runs: DataFrame) -> DataFrame:
    """The errors of the runs that failed: tool, run_id, error; a failed run without an error tells null."""
    return runs.where("not ok").select("tool", "run_id", "error")


def title_matches(title: Column, canonical: Column) -> Column:
    """Whether both titles, where both are there, are equal but for case and blanks at the ends."""
    return F.when(title.isNotNull() & canonical.isNotNull(), (F.lower(F.trim(title)) == F.lower(F.trim(canonical))).cast("int"))


def summarize(runs: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """One row per tool of runs (run_id, tool, url, ok, duration_s, bytes_extracted, link_count, title, error).

    canonical: (url, title), one row per target, so it is broadcast by size. n_errors
    counts the failed runs, whose errors run_errors tells.
    """
    if canonical is not None:
        runs = runs.join(canonical.withColumnRenamed("title", "canonical_title"), "url", "left")
    else:
        runs = runs.withColumn("canonical_title", F.lit(None).cast("string"))
    p95 = p95_latency(runs)
    ok = F.col("ok")
    when_ok = lambda c: F.when(ok, c)
    out = runs.groupBy("tool").agg(
        F.count("*").alias("runs"),
        F.count_if(ok).alias("successes"),
        F.round(F.avg(when_ok(F.col("duration_s"))), 4).alias("avg_latency"),
        F.coalesce(F.avg(when_ok(F.col("bytes_extracted"))).cast("long"), F.lit(0)).alias("avg_bytes"),
        F.coalesce(F.round(F.avg(when_ok(F.col("link_count"))), 2), F.lit(0.0)).alias("avg_links"),
        F.round(F.avg(when_ok(title_matches(F.col("title"), F.col("canonical_title")))), 4).alias("title_match_rate"),
        F.round(F.avg(when_ok((F.col("bytes_extracted") > 0).cast("int"))), 4).alias("content_rate"),
        F.round(F.avg(when_ok((F.col("link_count") > 0).cast("int"))), 4).alias("links_rate"),
        F.count_if(~ok).alias("n_errors"),
        F.min("run_id").alias("first_run"),
    )
    out = out.join(p95, out["tool"].eqNullSafe(p95["tool"]), "left").drop(p95["tool"]).withColumn("p95_latency", F.round("p95_latency", 4))
    return out.orderBy("first_run").select("tool", "runs", "successes", "avg_latency", "p95_latency", "avg_bytes", "avg_links", "title_match_rate", "content_rate", "links_rate", "n_errors")


#: The levels of a rolled-up report, by the keys that each has.
LEVELS = (("tool", "url", "iteration"), ("tool", "url"), ("tool", "iteration"), ("tool",), ())


def rolled_up(runs: DataFrame) -> DataFrame:
    """Runs, successes and mean latency of every level of LEVELS at once: level, tool, url, iteration, runs, successes, total_ms (of the ok runs) and avg_latency.

    level is the grouping id: its bits tell which of tool, url and iteration a row sums
    over, so that a total is told from a key that is null. Rows are expanded to the
    levels and pre-aggregated before their one shuffle. An empty table gives no rows,
    no total either.
    """
    keys, latency = ("tool", "url", "iteration"), F.avg(F.when(F.col("ok"), F.col("duration_s")))
    out = runs.groupingSets([[F.col(c) for c in level] for level in LEVELS], *map(F.col, keys))
    return out.agg(F.grouping_id().alias("level"), F.count("*").alias("runs"), F.count_if("ok").alias("successes"), F.sum(F.when(F.col("ok"), F.round(F.col("duration_s") * 1000).cast("long"))).alias("total_ms"), F.round(latency, 4).alias("avg_latency")).select("level", *keys, "runs", "successes", "total_ms", "avg_latency")


#: Size parameters of the sketches: a quantile's rank is within RANK_ERROR of the true one, a number of different values within DISTINCT_ERROR of it, both with 99 % certainty.
KLL_K, HLL_LG = 400, 12
RANK_ERROR, DISTINCT_ERROR = 0.01, 0.05


def daily_sketches(runs: DataFrame) -> DataFrame:
    """Of runs (ts, tool, url, ok, duration_s, used_browser) one row per day and tool, which add up: day, tool, runs, fallbacks, latency (a KLL sketch of the durations of ok runs) and urls (an HLL sketch).

    Null durations and urls are in no sketch; rows without ts are of the day null.
    """
    ok = F.when(F.col("ok"), F.col("duration_s"))
    return runs.groupBy(F.to_date("ts").alias("day"), "tool").agg(F.count("*").alias("runs"), F.count_if("used_browser").alias("fallbacks"), F.kll_sketch_agg_double(ok, KLL_K).alias("latency"), F.hll_sketch_agg("url", HLL_LG).alias("urls"))


def sketched_summary(days: DataFrame, first=None, last=None) -> DataFrame:
    """Of daily sketches those of first to last (dates; all by default), merged by tool: tool, runs, fallback_rate, median_latency, p95_latency, urls. No run is read again."""
    if first is not None:
        days = days.where(F.col("day") >= F.lit(first))
    if last is not None:
        days = days.where(F.col("day") <= F.lit(last))
    all_days = days.groupBy("tool").agg(F.sum("runs").alias("runs"), F.sum("fallbacks").alias("fallbacks"), F.kll_merge_agg_double("latency").alias("latency"), F.hll_union_agg("urls").alias("urls"))
    any_run = F.kll_sketch_get_n_double("latency") > 0
    at = [F.when(any_run, F.kll_sketch_get_quantile_double("latency", F.lit(q))).alias(f"{n}_latency") for n, q in (("median", 0.5), ("p95", 0.95))]
    return all_days.select("tool", "runs", (F.col("fallbacks") / F.col("runs")).alias("fallback_rate"), *at, F.hll_sketch_estimate("urls").alias("urls"))


def stability(runs: DataFrame) -> DataFrame:
    """How alike repeated runs of a page are: tool, urls, stable_urls (all ok runs gave one content_hash) and stability, of pages with more than one ok run."""
    by = runs.where("ok and content_hash is not null").groupBy("tool", "url").agg(F.count("*").alias("n"), F.min("content_hash").alias("low"), F.max("content_hash").alias("high")).where("n > 1")
    out = by.groupBy("tool").agg(F.count("*").alias("urls"), F.count_if(F.col("low") == F.col("high")).alias("stable_urls"))
    return out.withColumn("stability", F.round(F.col("stable_urls") / F.col("urls"), 4))


def run_grid(tools: DataFrame, targets: DataFrame, iterations: int) -> DataFrame:
    """Every tool on every target, iteration by iteration; both tables are lists of a command line."""
    return tools.crossJoin(targets).withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
