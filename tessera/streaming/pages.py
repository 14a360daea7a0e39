"""Scoring pages as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.scrape import with_signals
from ..sources.tables import fetches_from_pages


def read_pages(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def signals_stream(pages: DataFrame) -> DataFrame:
    """page_id, url and signals of each page; map-only, so it has no state and needs no watermark."""
    return with_signals(fetches_from_pages(pages)).selectExpr("request_id as page_id", "url", "signals")
