"""Exact top-k inner products by a bit-sliced index (operator 13).

A block of rows keeps, of each attribute, the leading bits as bitmaps with a bit a
row, and the vectors themselves. A query's weights become few signed digits; its
score for all rows of a block at once is the sum of slices, shifted by their digit's
place, added by carry-save adders over whole bitmaps. Rows are then selected from
the most significant slice of the sum downward. What slices and digits leave out is
bounded for each query and block, so that the rows that may be among the best are
told for certain; these alone are resolved by their exact scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, trim
from .integers import by_length, largest, products, quantised, query_batches

#: Rows of a block.
BLOCK = 16_384
#: Leading bits of an attribute that are sliced, and of a query's weights.
BITS, WEIGHT_BITS = 7, 6

INDEX = "dim int, shift int, vec_id array<long>, low array<long>, high array<long>, slices binary, item int, v binary"
FOUND = "q int, vec_id long, score long"


def signed_digits(c: int) -> list[tuple[int, bool]]:
    """The places of the non-zero digits of c in its sparsest signed form, and whether each is negative."""
    out, place, sign = [], 0, c < 0
    c = abs(c)
    while c:
        if c & 1:
            minus = c & 3 == 3
            out.append((place, minus != sign))
            c += 1 if minus else -1
        c >>= 1
        place += 1
    return out


def slices_of(v: np.ndarray, bits: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """shift, the least and largest value of each attribute, and its slices (attributes, bits, words) of rows v; bit 0 first."""
    low, high = v.min(axis=0), v.max(axis=0)
    shift = max(0, max((int(h) - int(l) for l, h in zip(low, high, strict=True)), default=0).bit_length() - bits)
    # differences as unsigned numbers: two values can be further apart than int64 holds
    u = (v.T.astype(np.uint64) - low.astype(np.uint64)[:, None]) >> np.uint64(shift)
    words = -(-len(v) // 64)
    out = np.zeros((v.shape[1], bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((u >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return shift, low, high, out.view(np.uint64)


def _index(bits: int, block: int):
    def made(ids, v):
        shift, low, high, slices = slices_of(v, bits)
        item = next(n for n in (2, 4, 8) if n == 8 or not len(low) or max(int(high.max()), -int(low.min())) < 1 << (8 * n - 1))
        cols = [pa.array([v.shape[1]], pa.int32()), pa.array([shift], pa.int32()), *[pa.array([x], pa.list_(pa.int64())) for x in (ids, low, high)], pa.array([slices.tobytes()], pa.binary()), pa.array([item], pa.int32()), pa.array([v.astype(f"<i{item}").tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in INDEX.split(", ")])

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            ids = np.asarray(b.column(b.schema.get_field_index("vec_id")))
            for dim, (rows, v) in by_length(b).items():
                a, w = held.pop(dim, (ids[:0], v[:0]))
                a, w = np.r_[a, ids[rows]], np.concatenate([w, v])
                while len(a) >= block:
                    yield made(a[:block], w[:block])
                    a, w = a[block:], w[block:]
                if len(a):
                    held[dim] = (a, w)
        for dim in list(held):
            yield made(*held.pop(dim))
        trim()

    return run


def bit_sliced_index(rows: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """The index of rows (vec_id, v), settled: one row per block of vectors of one length."""
    return settle(rows.select("vec_id", "v").mapInArrow(_index(bits, block), INDEX))


def added(columns: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """The slices of a sum: columns holds the bitmaps to be added at each place."""
    out, place = [], 0
    columns = {k: list(x) for k, x in columns.items()}
    while columns:
        todo = columns.pop(place, [])
        carried = columns.setdefault(place + 1, []) if len(todo) > 1 else []
        while len(todo) > 2:
            a, b, c = todo.pop(), todo.pop(), todo.pop()
            half, carry = a ^ b, a & b
            carry |= half & c
            half ^= c
            carried.append(carry)
            todo.append(half)
        if len(todo) == 2:
            a, b = todo
            carried.append(a & b)
            todo = [a ^ b]
        out.append(todo[0] if todo else np.zeros(words, np.uint64))
        place += 1
    return out


def kth_value(slices: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th largest sum among the rows of a bitmap, told from the most significant slice downward; 0 where there are fewer."""
    above, equal, value = 0, rows, 0
    for s in reversed(slices):
        both = equal & s
        n = int(np.bitwise_count(both).sum())
        if above + n >= k:
            equal, value = both, 2 * value + 1
        else:
            above, equal, value = above + n, equal & ~s, 2 * value
    return value


def at_least(slices: list[np.ndarray], rows: np.ndarray, least: int) -> np.ndarray:
    """The rows of a bitmap whose sum is at least a number, told from the most significant slice downward."""
    if least <= 0:
        return rows
    if least >> len(slices):
        return np.zeros_like(rows)
    above, equal = np.zeros_like(rows), rows
    for b in range(len(slices) - 1, -1, -1):
        s = slices[b]
        if least >> b & 1:
            equal = equal & s
        else:
            above |= equal & s
            equal = equal & ~s
    return above | equal


class Query:
    """A query's weights as signed digits, and what they leave out."""

    def __init__(self, w: np.ndarray, weight_bits: int):
        w = [int(x) for x in w]
        self.drop = max(0, max((abs(x) for x in w), default=0).bit_length() - weight_bits)
        half = 1 << self.drop >> 1
        self.c = [(x + half) >> self.drop for x in w]
        self.rest = [x - (c << self.drop) for x, c in zip(w, self.c, strict=True)]
        self.digits = [signed_digits(c) for c in self.c]
        self.plus, self.minus = sum(c for c in self.c if c > 0), sum(c for c in self.c if c < 0)
        self.negative = sum(1 << p for d in self.digits for p, m in d if m)

    def bounds(self, low: list[int], high: list[int], shift: int, bits: int) -> tuple[int, int, int, int]:
        """scale, base, least, most: a row's score is base + scale * its sum, and from least to most."""
        unit = (1 << bits) - 1
        base = sum(c * l for c, l in zip(self.c, low, strict=True)) - (unit << shift) * self.negative
        ends = [(e * l, e * h) for e, l, h in zip(self.rest, low, high, strict=True)]
        gap = (1 << shift) - 1
        least = sum(map(min, ends)) + ((gap * self.minus) << self.drop)
        most = sum(map(max, ends)) + ((gap * self.plus) << self.drop)
        return 1 << (shift + self.drop), base << self.drop, least, most


class Block:
    """A block of the index in a worker."""

    def __init__(self, dim, shift, ids, low, high, slices, item, v):
        self.ids = np.asarray(ids, np.int64)
        n = len(self.ids)
        self.words = -(-n // 64)
        self.shift, self.low, self.high = shift, [int(x) for x in low], [int(x) for x in high]
        s = np.frombuffer(slices, np.uint64)
        self.bits = len(s) // (dim * self.words) if dim else 0
        self.slices = s.reshape(dim, self.bits, self.words)
        self.v = np.frombuffer(v, f"<i{item}").reshape(n, dim)
        every = np.zeros(self.words * 64, np.uint8)
        every[:n] = 1
        self.every = np.packbits(every, bitorder="little").view(np.uint64)
        self.turned = None

    def sums(self, q: Query) -> list[np.ndarray]:
        if self.turned is None:
            self.turned = ~self.slices
        columns: dict[int, list] = {}
        for i, digits in enumerate(q.digits):
            for place, minus in digits:
                own = (self.turned if minus else self.slices)[i]
                for b in range(self.bits):
                    columns.setdefault(place + b, []).append(own[b])
        return added(columns, self.words)

    def best(self, q: Query, w: np.ndarray, own: int, k: int, floor: int | None, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the rows that may be among the k best, of which the k-th has `floor` so far."""
        rows = self.every.copy()
        for i in np.flatnonzero(self.ids == own).tolist():
            rows[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        slices = self.sums(q)
        scale, base, least, most = q.bounds(self.low, self.high, self.shift, self.bits)
        # k rows score kth * scale + base + least or more; a row that can't reach that isn't among the best
        reach = -((most - least) // scale) + kth_value(slices, rows, k)
        if floor is not None:
            reach = max(reach, -((base + most - floor) // scale))
        picked = np.flatnonzero(np.unpackbits(at_least(slices, rows, reach).view(np.uint8), bitorder="little"))
        return self.ids[picked], products(w[None, :], self.v[picked].astype(np.int64), bound)[0]


def first(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of the highest scores, of equal ones those of the smallest ids."""
    o = np.lexsort((ids, -scores))[:k]
    return ids[o], scores[o]


def _search(shared, k: int, bound: int, weight_bits: int):
    def run(batches):
        own, queries = shared.value
        best: dict[int, tuple] = {}
        weighed: dict[int, Query] = {}
        for b in batches:
            for row in b.to_pylist():
                if row["dim"] not in queries:
                    continue
                block = Block(*(row[x.split()[0]] for x in INDEX.split(", ")))
                for i, w in zip(*queries[row["dim"]], strict=True):
                    i = int(i)
                    if i not in weighed:
                        weighed[i] = Query(w, weight_bits)
                    ids, scores = best.get(i, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    more = block.best(weighed[i], w, int(own[i]), k, int(scores[-1]) if len(scores) >= k else None, bound)
                    best[i] = first(np.r_[ids, more[0]], np.r_[scores, more[1]], k)
        for i, (ids, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i, np.int32)), pa.array(ids), pa.array(scores)], names=["q", "vec_id", "score"])
        trim()

    return run


def top_products(vectors: DataFrame, k: int = 10, scale: int = 1024, every: int = 100, bits: int = BITS, weight_bits: int = WEIGHT_BITS, block: int = BLOCK) -> DataFrame:
    """Of each vector whose vec_id `every` divides the k other rows of the highest inner product: query_id, rank, vec_id, score.

    Components are floor(scale * x). Ties go to the smaller vec_id; where fewer rows
    are there, all are told. Null vectors, those with null or non-finite components
    and rows without a vec_id take no part; vectors meet those of their own length.
    Rows of the query's vec_id are its own and no candidates; other repeated rows
    each are candidates, and a query that is there twice with one vector is one
    query. Components beyond 64 bits become the
    largest of 64 bits, scores beyond 61 bits the largest of 61 bits. An
    empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, scale)
    bound, out = largest(rows), None
    index = bit_sliced_index(rows, bits, block)
    for asked in query_batches(rows, every):
        ids = asked["vec_id"].to_numpy()
        shared = spark.sparkContext.broadcast((ids, by_length(asked)))
        found = index.mapInArrow(_search(shared, k, bound, weight_bits), FOUND)
        names = spark.createDataFrame(pa.table({"q": pa.array(range(len(ids)), pa.int32()), "query_id": pa.array(ids, pa.int64())}))
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))
        best = found.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "q").select("query_id", "rank", "vec_id", "score")
        out = best if out is None else out.unionByName(best)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
