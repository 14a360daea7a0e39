"""Vectors of whole numbers and their exact inner products, in blocks (operators 12 and 13)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, settle, spread

#: Components of the queries that are compared with all rows in one pass.
CELLS = 1 << 18
#: Queries of a pass at most.
MOST_QUERIES = 2048
#: Sums below this are exact in doubles.
EXACT = 1 << 52
#: The largest score: distances of two scores still fit 64 bits.
SCORE_MAX = (1 << 61) - 1


def quantised(vectors: DataFrame, scale: int, label: str | None = None) -> DataFrame:
    """(vec_id, v[, label]) of the vectors that take part, settled: each component x is floor(scale * x), x as double.

    Null vectors, those with null or non-finite components, rows without a vec_id
    and, where a label is asked for, without one take no part. Numbers beyond 64
    bits become the largest of 64 bits.
    """
    importable(vectors.sparkSession)
    cols = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *([F.col(label).cast("long").alias("label")] if label else [])]
    rows = vectors.select(*cols).where("vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf'))")
    if label:
        rows = rows.where("label is not null")
    v = F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale)))).cast("array<long>")
    return settle(spread(rows).select("vec_id", v.alias("v"), *(["label"] if label else [])))


def largest(rows: DataFrame) -> int:
    """The largest component of any vector, without its sign."""
    top = rows.select(F.greatest(F.abs(F.array_max("v").cast("decimal(38,0)")), F.abs(F.array_min("v").cast("decimal(38,0)"))).alias("m")).agg(F.max("m")).first()[0]
    return int(top or 0)


def query_batches(rows: DataFrame, every: int, label: bool = False) -> list[pa.Table]:
    """The rows whose vec_id `every` divides, each different one once, in batches of bounded size for one pass each.

    Generated batch by batch, so that the driver holds one.
    """
    asked = rows.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).select("vec_id", "v", *(["label"] if label else []))
    asked = settle(asked.distinct())
    n, cells = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("v") + 1), F.lit(0))).first()
    parts = max(-(-cells // CELLS), -(-n // MOST_QUERIES))
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)) == part) if parts > 1 else asked
        got = own.toArrow().sort_by([("vec_id", "ascending")])
        if got.num_rows:
            yield got


def by_length(table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The vectors of a batch or table by their length: row numbers, and one row of int64 each."""
    column = table["v"] if isinstance(table, pa.Table) else table.column(table.schema.get_field_index("v"))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.asarray(column.offsets).astype(np.int64)
    flat, size, out = np.asarray(column.values), np.diff(at), {}
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        out[dim] = (rows, flat[(at[rows][:, None] + np.arange(dim))].astype(np.int64).reshape(len(rows), dim))
    return out


def products(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b as int64; bound: the largest component of b.

    By doubles where no sum can leave them, by whole numbers of any size else; sums
    beyond 61 bits become the largest of 61 bits.
    """
    dim = a.shape[1]
    if dim * bound * max(int(a.max(initial=0)), -int(a.min(initial=0))) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    s = a.astype(object) @ b.astype(object).T if dim else np.zeros((len(a), len(b)), object)
    return np.clip(s, -SCORE_MAX, SCORE_MAX).astype(np.int64)
