"""Fetches as a bucketed table, so that what is asked of them by host needs no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.urls import host_key


def write_by_host(fetches: DataFrame, table: str, buckets: int = 64, mode: str = "overwrite") -> None:
    """Writes fetches (url, ts, ...) as the table `table`, in buckets of their host, each sorted by host and ts, with statistics.

    The column host is put in, or replaced. Joins and groups by host over the table
    take its buckets as they are, if the other side has as many or is broadcast; sums
    over a host's rows are so without a shuffle. Buckets of a host that holds very many
    rows are large: where order matters less than balance, ask by (host, range), as the
    operators do. Null urls are of the host null; an empty table has no files.
    """
    rows = fetches.withColumn("host", host_key("url"))
    # one task writes a bucket, not every task a part of each
    rows.repartition(buckets, "host").write.mode(mode).bucketBy(buckets, "host").sortBy("host", "ts").saveAsTable(table)
    spark = fetches.sparkSession
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR COLUMNS host, ts")


def read_by_host(spark: SparkSession, table: str) -> DataFrame:
    """The table, its buckets known to the optimizer."""
    return spark.table(table)
