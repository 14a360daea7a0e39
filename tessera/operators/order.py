"""Order-dependent work without a single sorted partition: ranges of the order, and what comes before each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranges(df: DataFrame, order: str, n: int | None = None) -> Column:
    """The number of a row's range of the order, non-decreasing in it; the n ranges (as many as a shuffle has partitions by default) hold about equal shares of the rows.

    The cuts are one constant array, searched in as many steps as its size has bits.
    The order is a number or a time; nulls are in the first range.
    """
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(order).cast("double")
    cuts = sorted(set(df.select(key.alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    if not cuts:
        return F.lit(0)
    bits = len(cuts).bit_length()
    padded = F.split(F.lit(",".join(map(repr, cuts + [float("inf")] * ((1 << bits) - 1 - len(cuts))))), ",").cast("array<double>")
    found = F.aggregate(F.array(*[F.lit(1 << b) for b in reversed(range(bits))]), F.lit(0), lambda at, step: F.when(F.get(padded, at + step - 1) < key, at + step).otherwise(at))
    return F.when(key.isNull(), 0).otherwise(found)


def running(df: DataFrame, name: str, value: Column, order: tuple[str, ...], by: tuple[str, ...] = (), how: str = "sum", own: bool = True) -> DataFrame:
    """df with the sum, max or last non-null of value over the rows up to its own in the order, within equal values of `by`.

    own=False: up to the row before. The order must tell rows apart; ranges are told
    by its first column. Only one row of each range is carried to those after it, so
    that neither all rows nor those of one value meet in a task. Nulls count for
    nothing; before the first value the result is null, of a sum 0.
    """
    key, at = [*by, "__range"], F.struct(*order)
    d = df.withColumns({"__range": ranges(df, order[0]), "__value": value}).repartition(*key)  # one exchange for both
    whole = {"sum": F.sum("__value"), "max": F.max("__value"), "last": F.max_by("__value", F.when(F.col("__value").isNotNull(), at))}[how]
    over = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    earlier = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # rows: ranges
    totals = d.groupBy(*key).agg(whole.alias("__total"))
    totals = totals.withColumn("__before", over("__total").over(earlier.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))).drop("__total")
    inner = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    here = d.withColumn("__here", over("__value").over(inner))
    met = here.join(totals.withColumnsRenamed({c: f"__{c}" for c in key}), F.expr(" and ".join(f"`{c}` <=> `__{c}`" for c in key))) if by else here.join(totals, key)
    both = {"sum": F.coalesce("__before", F.lit(0)) + F.coalesce("__here", F.lit(0)), "max": F.greatest("__before", "__here"), "last": F.coalesce("__here", "__before")}[how]
    return met.withColumn(name, both).select(*df.columns, name)


def numbered(df: DataFrame, name: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with a row's place (from 1) in the order, within equal values of `by`; see running."""
    return running(df, name, F.lit(1).cast("long"), (order,), by)
