"""As-of joins: of the rows up to a time, the last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import running


def as_of(left: DataFrame, right: DataFrame, by: tuple[str, ...], on: str, tie: str, value: str) -> DataFrame:
    """left with `value` of the last row of right that has its values of `by` and is at or before it in `on`; null where there is none.

    Of rows of right at one time, the one of the largest `tie` counts. Both tables are
    dealt to ranges of the time as one, where each row of left takes the last value
    before it; a range without one takes that of the ranges before. So a key that has
    very many rows on either side is many tasks, and no pair of rows but the one asked
    for is made. Rows with a null in `by` or `on` find nothing; a null value counts as
    none; repeated rows of left are kept.
    """
    own = [c for c in left.columns if c != value]
    mine = left.select(F.struct(*own).alias("__row"), *by, F.col(on).alias("__on"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__tie"), F.lit(None).cast(right.schema[value].dataType).alias("__known"), F.monotonically_increasing_id().alias("__id"))
    theirs = right.select(F.lit(None).cast(mine.schema["__row"].dataType).alias("__row"), *by, F.col(on).alias("__on"), F.lit(0).alias("__side"), F.col(tie).cast("long").alias("__tie"), F.col(value).alias("__known"), F.lit(None).cast("long").alias("__id"))
    told = " and ".join(f"`{c}` is not null" for c in (*by, "__on"))
    both = running(mine.unionByName(theirs.where(told)), "__found", F.col("__known"), ("__on", "__side", "__tie", "__id"), by, "last")
    found = F.when(F.expr(told), F.col("__found"))
    return both.where("__side = 1").select("__row.*", found.alias(value))
