"""Sources and sinks: pages, fetches, requests, proxy lists, targets and JSON."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.proxies import accepted, bench_proxy

FETCHES = "request_id long, attempt int, mode string, url string, final_url string, status_code int, headers map<string,string>, html string, error_status string, page_links array<string>, waf_check boolean, content_truncated boolean, duration_ms long, ts timestamp"
REQUESTS = (
    "index long, url string, request_timeout_secs long, crawl_timeout_secs long, respect_robots_txt boolean, include_content boolean, max_content_chars long, proxies array<string>, anti_bot_profile string, user_agent string, referer string, redirect_policy string, redirect_limit long, crawl_mode string, "
    "browser struct<chrome_connection_url: string, chrome_intercept: boolean, block_visuals: boolean, block_stylesheets: boolean, block_javascript: boolean, block_analytics: boolean, page_timeout_secs: long, wait_for_load: string, wait_ms_after_load: long, wait_for_selector_timeout_secs: long, javascript_enabled: boolean, viewport_width: int, viewport_height: int, screenshot: boolean>, "
    "response_format string, include_markdown boolean, fit_markdown struct<pruning_threshold: double, pruning_type: string, min_word_threshold: long>, extraction_profile string, auto_browser_min_words long, auto_browser_min_main_content_score double, auto_browser_blocked_statuses array<int>, required_text string, wait_for_selector string"
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a temporary one where none is set and all is on this machine."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        top = sc.getCheckpointDir()
    return top.rstrip("/")


#: Scratch tables that are there: path to the JVM that made it, in the order in which they were made.
scratch: dict[str, object] = {}


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Ends the lineage: writes df as a table in the shared folder, in folders by some columns, and reads it again. The table goes with delete_scratch, or at the end of the program."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
    scratch[path] = spark._jvm
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def delete_scratch(path: str) -> None:
    """Deletes a scratch table, or whatever is at its path."""
    jvm = scratch.pop(path)
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


@atexit.register
def _delete_all() -> None:
    for path in list(scratch):
        with contextlib.suppress(Exception):  # the JVM may have ended before
            delete_scratch(path)


#: Partitions of a table that is dealt out at most: a larger one has work enough for many cores, and its shuffle would cost more than it gains.
SPREAD_MOST = 256


def spread(df: DataFrame) -> DataFrame:
    """Deals out a table of fewer partitions than half the cores, as files of one row group give them; a larger one stays as it is."""
    cores, n = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores) if n < min(cores // 2, SPREAD_MOST) else df


def fetches_from_pages(pages: DataFrame, status: Column | None = None, content_type: Column | None = None) -> DataFrame:
    """pages (page_id, url, html) as fetches, with defaults for all that pages don't tell."""
    kind = content_type if content_type is not None else F.lit("text/html; charset=utf-8")
    return pages.select(
        F.col("page_id").alias("request_id"),
        F.lit(0).alias("attempt"),
        F.lit("http").alias("mode"),
        "url",
        F.col("url").alias("final_url"),
        (status if status is not None else F.lit(200)).cast("int").alias("status_code"),
        F.create_map(F.lit("content-type"), kind).alias("headers"),
        "html",
        F.lit(None).cast("string").alias("error_status"),
        F.lit(None).cast("array<string>").alias("page_links"),
        F.lit(False).alias("waf_check"),
        F.lit(False).alias("content_truncated"),
        F.lit(0).cast("long").alias("duration_ms"),
        F.lit(None).cast("timestamp").alias("ts"),
    )


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests from JSON lines; unknown fields are ignored."""
    return spark.read.schema(REQUESTS).json(path)


def decode_requests(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """A batch body {"requests": [...]} as one row per request, with its index and the columns in keep."""
    kind = T._parse_datatype_string(REQUESTS)
    items = T.StructType([T.StructField("requests", T.ArrayType(T.StructType([f for f in kind.fields if f.name != "index"])))])
    return df.select(*keep, F.posexplode(F.from_json(body, items)["requests"]).alias("index", "r")).select(*keep, F.col("index").cast("long").alias("index"), "r.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a text file, read as one value so that lines keep their order; null for a missing file."""
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as e:  # a list that isn't there is empty
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "line_no long, line string")
    return text.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).select(F.col("line_no").cast("long").alias("line_no"), "line")


def proxy_file(spark: SparkSession, path: str, most: int, scheme: str = "http") -> DataFrame:
    """The first `most` acceptable proxies of a file."""
    return accepted(numbered_lines(spark, path), most, scheme)


def bench_proxy_list(lists: list[DataFrame], most: int) -> DataFrame:
    """Proxies of several lists (line_no, line), one after the other, each once, at most `most`."""
    out = None
    for i, df in enumerate(lists):
        part = df.select((F.col("line_no") + (i << 40)).alias("line_no"), "line")
        out = part if out is None else out.unionByName(part)
    return accepted(out, most, first_only=True, form=bench_proxy)


def target_list(lines: DataFrame) -> DataFrame:
    """Targets of a benchmark: stripped lines that aren't blank."""
    return lines.select("line_no", F.trim("line").alias("url")).where("url <> ''")


#: How a setting of each kind is written; anything else is the default.
SETTING = {"long": r"^[+-]?[0-9]+\z", "double": r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\z", "boolean": r"^(true|false)\z"}


def setting(value: Column, kind: str, default) -> Column:
    """A setting's text as a value of its kind (string, long, double, boolean), or the default where it is null or can't be read as such."""
    if kind == "string":
        return F.coalesce(value, F.lit(default))
    return F.coalesce(F.when(value.rlike(SETTING[kind]), value.try_cast(kind)), F.lit(default).cast(kind))


def conf(spark: SparkSession, key: str, default, kind: str = "string"):
    """A setting of the session under tessera., or the default where it is unset or can't be read as such."""
    return spark.range(1).select(setting(F.lit(spark.conf.get(f"tessera.{key}", None)).cast("string"), kind, default)).first()[0]


def as_json(df: DataFrame, keep_nulls: tuple[str, ...] = ()) -> DataFrame:
    """One JSON text per row (json). Null fields are left out, but for those in keep_nulls."""
    dropped = F.to_json(F.struct(*df.columns))
    if not keep_nulls:
        return df.select(dropped.alias("json"))
    out = dropped
    for name in keep_nulls:
        out = F.when(F.col(name).isNull(), F.concat(F.regexp_replace(out, r"\}\z", ""), F.when(F.length(out) > 2, ",").otherwise(""), F.lit(f'"{name}":null}}'))).otherwise(out)
    return df.select(out.alias("json"))


def health(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT 'ok' AS status")


def error_body(message: Column | str) -> Column:
    return F.to_json(F.struct((F.col(message) if isinstance(message, str) else message).alias("error")))


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)
