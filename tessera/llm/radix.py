"""Hard negatives by distributed radix selection (operator 12).

A window is an anchor with a range of scores and a set of rows that count: those of
its label or those of another one. Its first k rows are found without sorting: every
task counts the scores of its rows in a histogram a window, by the leading digit of
their distance from the window's upper end; the counts are added up, which tells the
bucket that holds the k-th row; that bucket alone is counted by the next digit, and
so on to the last. Then only rows up to the k-th score are gathered, of rows at the
k-th score no more a task than are wanted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import trim
from .integers import SCORE_MAX, by_length, largest, products, quantised, query_batches

#: Bits of a digit.
DIGIT = 8
#: Scores that a worker holds at once.
SCORES = 1 << 20

COUNTS = "w int, digit int, n long"
FOUND = "w int, vec_id long, score long"


class Anchors:
    """A batch of anchors in a worker: ids, labels and vectors by length."""

    def __init__(self, table: pa.Table, bound: int):
        self.ids, self.labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
        self.by_length, self.bound = by_length(table), bound

    def most(self) -> np.ndarray:
        """What no score of each anchor exceeds."""
        out = np.zeros(len(self.ids), object)
        for rows, v in self.by_length.values():
            out[rows] = np.abs(v.astype(object)).sum(axis=1) * self.bound if v.shape[1] else 0
        return np.minimum(out, SCORE_MAX).astype(np.int64)

    def scored(self, batch):
        """Of a batch's rows, in slices: the anchors' numbers, their scores with the rows, which rows are of another vec_id, which of the anchor's label, and the rows' ids."""
        ids, labels = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("vec_id", "label"))
        for dim, (rows, v) in by_length(batch).items():
            if dim not in self.by_length:
                continue
            mine, a = self.by_length[dim]
            step = max(1, SCORES // len(mine))
            for i in range(0, len(rows), step):
                at = rows[i : i + step]
                scores = products(a, v[i : i + step], self.bound)
                yield mine, scores, self.ids[mine][:, None] != ids[at][None, :], self.labels[mine][:, None] == labels[at][None, :], ids[at]


class Windows:
    """Windows (anchor, high, width), all of rows of the anchor's label or all of other rows, and how far their selection has come.

    prefix: the digits of the k-th row's distance from high that are known, those
    above `shift`; left: how many rows of that bucket are wanted; whole: whether all
    rows of the window are.
    """

    def __init__(self, anchor, high, width, same: bool, k: int):
        self.anchor, self.high, self.width = (np.asarray(x, np.int64) for x in (anchor, high, width))
        self.same, n = same, len(self.anchor)
        self.prefix, self.left, self.whole = np.zeros(n, np.int64), np.full(n, k, np.int64), np.zeros(n, bool)
        self.shift = -(-int(self.width.max(initial=0)).bit_length() // DIGIT) * DIGIT

    def places(self, n_anchors: int):
        """The windows in rounds of at most one an anchor: for each anchor its window or -1."""
        order = np.argsort(self.anchor, kind="stable")
        first = np.searchsorted(self.anchor[order], self.anchor[order])
        turn = np.arange(len(order)) - first
        for t in range(int(turn.max(initial=-1)) + 1):
            out = np.full(n_anchors, -1, np.int64)
            own = order[turn == t]
            out[self.anchor[own]] = own
            yield out

    def met(self, anchors: Anchors, batch):
        """Windows, distances from their upper ends, and ids, of the rows of a batch that are in a window."""
        rounds = list(self.places(len(anchors.ids)))
        for mine, scores, other, alike, ids in anchors.scored(batch):
            counts = other & (alike if self.same else ~alike)
            for place in rounds:
                w = place[mine]
                key = self.high[w][:, None] - scores
                a, r = np.nonzero(counts & (w >= 0)[:, None] & (key >= 0) & (key <= self.width[w][:, None]))
                if len(a):
                    yield w[a], key[a, r], ids[r]


def _count(shared):
    def run(batches):
        anchors, windows = shared.value
        counts = np.zeros(len(windows.anchor) << DIGIT, np.int64)
        for b in batches:
            for w, key, _ in windows.met(anchors, b):
                known = (key >> (windows.shift + DIGIT)) == windows.prefix[w]
                counts += np.bincount((w[known] << DIGIT) + (key[known] >> windows.shift & ((1 << DIGIT) - 1)), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array((at >> DIGIT).astype(np.int32)), pa.array((at & ((1 << DIGIT) - 1)).astype(np.int32)), pa.array(counts[at])], names=["w", "digit", "n"])
        trim()

    return run


def _gather(shared):
    def run(batches):
        anchors, windows = shared.value
        found = []

        def kept():
            """Of the rows so far, those before the k-th score and of those at it the smallest ids that are wanted."""
            w, key, ids = (np.concatenate(x) for x in zip(*found, strict=True))
            tied = (key == windows.prefix[w]) & ~windows.whole[w]
            o = np.lexsort((ids, w, tied))
            w, key, ids, tied = w[o], key[o], ids[o], tied[o]
            new = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (tied[1:] != tied[:-1])])
            place = np.arange(len(w)) - np.repeat(new, np.diff(np.r_[new, len(w)]))
            keep = ~tied | (place < windows.left[w])
            found[:] = [(w[keep], key[keep], ids[keep])]

        for b in batches:
            for w, key, ids in windows.met(anchors, b):
                keep = windows.whole[w] | (key <= windows.prefix[w])
                found.append((w[keep], key[keep], ids[keep]))
            if len(found) > 64:
                kept()
        if found:
            kept()
            w, key, ids = found[0]
            yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(ids), pa.array(windows.high[w] - key)], names=["w", "vec_id", "score"])
        trim()

    return run


def by_window(spark: SparkSession, **values: np.ndarray) -> DataFrame:
    """What is told of each of a batch's windows, as a small table with its number w."""
    n = len(next(iter(values.values())))
    return spark.createDataFrame(pa.table({"w": pa.array(range(n), pa.int32())} | {k: pa.array(v, pa.int64()) for k, v in values.items()}))


def select(rows: DataFrame, anchors: Anchors, windows: Windows, k: int) -> DataFrame:
    """The first k rows (all, if fewer) of each window by score, then vec_id: w, vec_id, score, rank. Windows are a batch's, so that what the driver holds of them is bounded."""
    spark, sc = rows.sparkSession, rows.sparkSession.sparkContext
    while windows.shift:
        windows.shift -= DIGIT
        got = rows.mapInArrow(_count(sc.broadcast((anchors, windows))), COUNTS).groupBy("w", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("w").orderBy("digit"))
        # the bucket of the k-th row; a window of fewer rows has none
        hit = got.withColumn("upto", upto).join(F.broadcast(by_window(spark, wanted=windows.left)), "w").where("upto >= wanted and upto - n < wanted").selectExpr("w", "digit", "upto - n as before").toArrow()
        w, digit, before = (hit[c].to_numpy() for c in ("w", "digit", "before"))
        none = np.ones(len(windows.anchor), bool)
        none[w] = False
        windows.whole |= none
        windows.prefix <<= DIGIT
        windows.prefix[w] += digit
        windows.left[w] -= before
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.col("score").desc(), "vec_id"))
    found = rows.mapInArrow(_gather(sc.broadcast((anchors, windows))), FOUND)
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, label: str = "label", k: int = 5, positives: int = 5, low: int = 80, scale: int = 256, every: int = 100) -> DataFrame:
    """Hard negatives of the anchors, the vectors whose vec_id `every` divides: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are floor(scale * x), scores inner products; higher ones come first,
    of equal ones that of the smaller vec_id. An anchor's positives are its first
    `positives` other rows of its label; for each, the first k rows of another label
    whose score is `low` to 100 per cent of the positive's. Where fewer are there,
    all are told: of a negative positive_score none. Rows without label, vec_id or
    vector, or with null or non-finite components, take no part; vectors meet those
    of their own length. Rows of the anchor's vec_id are its own and no positives;
    other repeated rows count one by one, and an anchor that is there twice with
    one vector and label is one anchor. An empty table gives no rows; other columns
    are ignored.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, scale, label)
    bound, out = largest(rows), None
    for table in query_batches(rows, every, label=True):
        anchors = Anchors(table, bound)
        most, n = anchors.most(), np.arange(len(anchors.ids))
        mates = select(rows, anchors, Windows(n, most, 2 * most, True, positives), positives).select("w", "vec_id", "score").toArrow().sort_by([("w", "ascending"), ("score", "descending"), ("vec_id", "ascending")])
        owner, score = mates["w"].to_numpy(), mates["score"].to_numpy()
        least = [-(-low * int(s) // 100) for s in score]  # the smallest whole number that is not below
        good = np.array([i for i, s in enumerate(score) if least[i] <= s], np.int64)
        if not len(good):
            continue
        high = score[good]
        found = select(rows, anchors, Windows(owner[good], high, high - np.array([least[i] for i in good], np.int64), False, k), k)
        told = by_window(spark, anchor_id=anchors.ids[owner[good]], positive_id=mates["vec_id"].to_numpy()[good], positive_score=high)
        part = found.join(F.broadcast(told), "w").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], RESULT)
