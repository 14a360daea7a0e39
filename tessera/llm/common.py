"""What the corpus operators share: reading, scratch tables, words, components."""

from __future__ import annotations

import ctypes
import os
import re
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder, spread

#: A word: a run of bytes that are neither a blank nor one of \t \n \v \f \r.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A-Z to a-z, all else unchanged.
LOWER = {c: c + 32 for c in range(65, 91)}
MULT = np.uint64(0x9E3779B97F4A7C15)
#: Rows that are broadcast at most; beyond, tables are joined by shuffling.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that goes to a Python worker; Spark's default of 64 MB is held several times over by JVM and worker.
BATCH_BYTES = 4 << 20


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the library from where the driver has it, and keeps their batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


#: Paths of the settled tables that are there, in the order in which they were made.
_made: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that all executors share."""
    return f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it again."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    _made.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made.remove(path)


def discard(df: DataFrame) -> None:
    """Deletes a settled table that no later plan reads."""
    path = getattr(df, "_tessera_path", None)
    if path in _made:
        _delete(df.sparkSession, path)


def settled_alone(df: DataFrame, make) -> DataFrame:
    """make(df), settled; all tables that were settled on the way, and df if it is such a table, are deleted."""
    before = len(_made)
    out = settle(make(df))
    for path in [p for p in _made[before:] if p != out._tessera_path]:
        _delete(out.sparkSession, path)
    discard(df)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def trim() -> None:
    """Gives freed memory back to the system, which the allocator else keeps for the life of the worker."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def pieces(batches, rows: int = 2000, most: int = 1 << 20, column: str = "text"):
    """Cuts record batches into slices of few rows and, single long rows apart, few bytes."""
    for b in batches:
        if not b.num_rows:
            continue
        at = b.schema.get_field_index(column)
        col = b.column(at)
        size = np.zeros(b.num_rows, np.int64)
        size[:] = np.asarray(pc.fill_null(pc.binary_length(col), 0))
        begin, held = 0, 0
        for i, n in enumerate(size.tolist()):
            if i > begin and (held + n > most or i - begin >= rows):
                yield b.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield b.slice(begin)
    trim()


def spans_union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that the half-open spans cover; touching spans join."""
    if not len(starts):
        return starts, ends
    o = np.argsort(starts, kind="stable")
    s, e = starts[o], np.maximum.accumulate(ends[o])
    new = np.r_[True, s[1:] > e[:-1]]
    return s[new], e[np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]]


class Forest:
    """Union-find over hashable keys; the smallest key of a set is its root."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True

    def links(self) -> list[tuple]:
        return [(x, self.find(x)) for x in self.up if self.find(x) != x]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the links (u, v): one row (id, component) per linked id, component being the smallest id reachable.

    Alternates large-star and small-star steps, each a grouped minimum that is
    combined before its shuffle and joined back on the same key, until the set
    of links is a set of stars. Links never leave the executors; every round is
    written to the shared folder and the one before it deleted.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now, before = settle(pairs), None

    def digest(df):
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    mark = digest(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        nxt = settle(small.where("u <> v").distinct())
        was, mark = mark, digest(nxt)
        if before is not None:
            discard(before)
        before, now = now, nxt
        if mark == was:
            break
    if before is not None:
        discard(before)
    stars = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
