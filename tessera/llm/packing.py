"""Best-fit packing of token sequences (operator 5): hierarchical residual packing.

Every partition tokenizes its documents and packs its own pieces best-fit
decreasing. Bins that are nearly full are final. The others become items of the
next round, in which the underfull bins of several partitions are packed
together, and so on up a tree, until one group is left. Only (bin, fill) pairs
move. Where so many bins stay underfull that one task can't hold them, the last
round packs the number of bins of each fill instead: bins of one fill are alike, so
best fit gives as many sequences, and each bin finds its place by its rank.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import importable, pieces, settle, spread
from .tokens import default_path, encoder

#: Free tokens at which a bin counts as full.
SLACK = 4
#: Partitions or groups that one merge takes.
FAN_IN = 16
#: Underfull bins that one task merges; more are merged by their counts.
GROUP_MOST = 1_000_000


def best_fit(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and offset of each item, and the bins' fills.

    Ties go to the earlier item and to the bin that reached its room last. An
    item of at most room tokens always fits a new bin.
    """
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    free: list[list[int]] = [[] for _ in range(room + 1)]
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        m = mask >> n
        if m:
            r = (m & -m).bit_length() - 1 + n
            b = free[r].pop()
            if not free[r]:
                mask &= ~(1 << r)
        else:
            r, b = room, len(fills)
            fills.append(0)
        bin_of[i], offset[i] = b, fills[b]
        fills[b] += n
        if r - n > 0:
            free[r - n].append(b)
            mask |= 1 << (r - n)
    return bin_of, offset, np.array(fills, np.int64)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, bin_offset long, bin_fill long, part long"


def _pack_partition(path: str, room: int, end_id: int):
    def run(batches):
        enc, part = encoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        doc, piece, start, length, crc = [], [], [], [], []
        for b in pieces(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for d, text in zip(ids, texts, strict=True):
                raw = enc.encode(text or "") + end
                n, view, s = len(raw) // 4, memoryview(raw), 0
                k = 0
                while s < n:
                    m = (n - 1) % room + 1 if k == 0 else room
                    doc.append(d), piece.append(k), start.append(s), length.append(m)
                    crc.append(zlib.crc32(view[4 * s : 4 * (s + m)]))
                    s, k = s + m, k + 1
        sizes = np.array(length, np.int64)
        bin_of, offset, fills = best_fit(sizes, room)
        if len(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(bin_of + (part << 36)), pa.array(offset), pa.array(fills[bin_of]), pa.array(np.full(len(sizes), part))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "bin_offset", "bin_fill", "part"],
            )

    return run


def _merge(room: int):
    def run(key, items):
        items = items.sort_values("item", kind="stable")
        bin_of, offset, fills = best_fit(items["fill"].to_numpy(np.int64), room)
        first = np.full(len(fills), -1, np.int64)
        ids = items["item"].to_numpy(np.int64)
        first[bin_of[::-1]] = ids[::-1]  # a merged bin is named after the first of its items
        return items[["item", "grp"]].assign(to=first[bin_of], base=offset, to_fill=fills[bin_of])

    return run


def best_fit_counts(counts: dict[int, int], room: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of so many items of each size: slots (size, first rank, number, first bin, offset).

    The item of a size whose rank is the first rank + i goes to the first bin + i.
    Bins that hold the same sizes are one class and filled together, so that the
    work depends on the number of sizes alone.
    """
    free: list[list[tuple[int, list]]] = [[] for _ in range(room + 1)]  # by free room: bins of a class, its items (size, rank of the first bin's, offset)
    mask = 1 << room
    done: list[tuple[int, list]] = []

    def put(r, m, items):
        nonlocal mask
        if m and r:
            free[r].append((m, items))
            mask |= 1 << r
        elif m:
            done.append((m, items))

    for n in sorted((n for n, c in counts.items() if c), reverse=True):
        left, rank = counts[n], 0
        while left:
            up = mask >> n
            r = (up & -up).bit_length() - 1 + n
            m, items = free[r].pop() if free[r] else (left, [])  # new bins are as many as there can be
            new = r == room and not items
            if not free[r] and r < room:
                mask &= ~(1 << r)
            q = min(r // n, left)  # items that each bin takes
            k = min(m, left // q)
            own = [*items, *((n, rank + j * k, room - r + j * n) for j in range(q))]
            put(r - q * n, k, own)
            if not new:
                put(r, m - k, [(size, first + k, off) for size, first, off in items])
            left, rank = left - q * k, rank + q * k
    out, number = [], 0
    for m, items in [*done, *(c for x in free for c in x)]:
        out.extend((size, first, m, number, off) for size, first, off in items)
        number += m
    return out


def _by_slots(shared):
    """Bins (item, fill, rank) to the bins of the last round, numbered downwards from -1."""

    def run(batches):
        slots = shared.value
        key = slots[:, 0] << 44 | slots[:, 1]
        for b in batches:
            fill, rank = b.column("fill").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(key, fill << 44 | rank, "right") - 1
            to = -1 - (slots[at, 3] + rank - slots[at, 1])
            yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(to), pa.array(slots[at, 4])], names=["item", "to", "base"])

    return run


def _merge_all(items: DataFrame, room: int) -> DataFrame:
    """One round over all items (item, fill, grp), whatever their number: item, to, base."""
    by = items.groupBy("grp", "fill").agg(F.count("*").alias("n"))
    # rows: groups times fills; a fill's ranks go on from group to group
    first = by.withColumn("first", F.sum("n").over(Window.partitionBy("fill").orderBy("grp")) - F.col("n")).drop("n")
    counts = {r["fill"]: r["n"] for r in by.groupBy("fill").agg(F.sum("n").alias("n")).collect()}  # at most room fills
    slots = np.array(sorted(best_fit_counts(counts, room)), np.int64).reshape(-1, 5)
    shared = items.sparkSession.sparkContext.broadcast(slots)
    within = items.withColumn("inner", F.row_number().over(Window.partitionBy("grp", "fill").orderBy("item")) - 1)
    ranked = within.join(first, ["grp", "fill"]).select("item", "fill", (F.col("first") + F.col("inner")).cast("long").alias("rank"))
    return ranked.mapInArrow(_by_slots(shared), "item long, to long, base long")


def pack(docs: DataFrame, tokenizer_path: str | None = None, room: int = 2048, end_id: int = 0, fan_in: int = FAN_IN) -> DataFrame:
    """Packs docs (doc_id, text) into sequences of at most room tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. A document is its ids and then end_id; a null or empty text is that
    one id. Only a document of more than room tokens is cut, its first piece
    taking the remainder; a text of any length is encoded whole. Repeated rows and
    repeated or null doc_ids are packed row by row. An empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    importable(spark)
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    placed = settle(docs.mapInArrow(_pack_partition(tokenizer_path or default_path(), room, end_id), PIECES))
    items = placed.where(F.col("bin_fill") < room - SLACK).groupBy(F.col("bin").alias("item")).agg(F.max("bin_fill").alias("fill"), F.max("part").alias("grp"))
    spread_over, held = placed.agg(F.max("part"), F.count_distinct(F.when(F.col("bin_fill") < room - SLACK, F.col("bin")))).first()
    groups, where = (spread_over or 0) + 1, None
    while groups > 1:
        by_counts = (held or 0) * min(fan_in, groups) / groups > GROUP_MOST
        if by_counts:
            merged = settle(_merge_all(items, room))
        else:
            groups = -(-groups // fan_in)
            merged = settle(items.withColumn("grp", F.floor(F.col("grp") / fan_in).cast("long")).groupBy("grp").applyInPandas(_merge(room), "item long, grp long, to long, base long, to_fill long"))
        step = merged.select("item", "to", "base")
        if where is None:
            where = step.select(F.col("item").alias("bin"), "to", "base")
        else:
            old = where.withColumnRenamed("to", "item").withColumnRenamed("base", "below")
            where = old.join(step, "item", "left").select("bin", F.coalesce("to", "item").alias("to"), (F.coalesce("base", F.lit(0)) + F.col("below")).alias("base"))
        if by_counts:
            break
        items = merged.where(F.col("to_fill") < room - SLACK).groupBy(F.col("to").alias("item")).agg(F.max("to_fill").alias("fill"), F.max("grp").alias("grp"))
        held = items.count() if groups > 1 else 0
    if where is None:
        out = placed.withColumns({"to": F.col("bin"), "base": F.lit(0).cast("long")})
    else:
        out = placed.join(where, "bin", "left").withColumns({"to": F.coalesce("to", "bin"), "base": F.coalesce("base", F.lit(0)).cast("long")})
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("to").alias("sequence_id"), (F.col("base") + F.col("bin_offset")).alias("offset"))
