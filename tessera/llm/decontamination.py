"""Benchmark decontamination (operator 1): latent semantic retrieval.

Texts are lower-cased and read as words of letters. Only words of the benchmark
have columns; their weights come from document frequencies over all documents. A
randomised singular value decomposition of the TF-IDF passages of all documents
and of the items is computed on the executors in one pass; only matrices of
columns by rank reach the driver. Then every document is
cut to overlapping passages, which are projected and compared by cosine with all
items and, where an item is longer than a passage, with its own passages of that
length; for candidates the longest common subsequence with the item's words, and
with its answer (the last sentence), decides, so that paraphrases with words put
in, left out or replaced are found.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, pieces, spread
from .words import Words

#: Words of half a passage; passages overlap by one half.
HALF = 32
#: Words from one passage of a long item to the next, so that one of them is at most half of it off a document's.
STEP = 16
RANK = 96
EXTRA = 16
#: Columns at most: words of the benchmark beyond share them by hash.
MOST_COLUMNS = 1 << 17
#: Items and passages of items, roughly, that are compared in one pass over the documents.
MOST_ITEMS = 20_000
#: Bytes of text whose passages the decomposition holds at a time.
RANGE_BYTES = 1 << 19
#: Cosines that are computed at a time.
CELLS = 4 << 20
COSINE = 0.55
#: Shares of an item's words in common order that make a leak, alone and with the answer.
ALONE, WITH_ANSWER, ANSWER = 0.7, 0.5, 0.8
#: Fewer words than this must all be there.
SHORT = 8

SENTENCE = re.compile(r"[.!?\n]+")


def low(column):
    return F.lower(F.col(column).cast("string"))


def words_of(texts: list[str]) -> list[np.ndarray]:
    w = Words(pa.array(texts, pa.large_string()), letters=True)
    return [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


def lcs(place: dict[int, int], n: int, other: list[int]) -> int:
    """Length of the longest common subsequence; place: for each word of the first the bits of its places."""
    v = full = (1 << n) - 1
    for x in other:
        m = place.get(x)
        if m:
            u = v & m
            v = (v + u) | (v - u)
    return n - bin(v & full).count("1")


def places(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(words):
        out[x] = out.get(x, 0) | (1 << i)
    return out


def cuts(n: int) -> list[tuple[int, int]]:
    """An item of n words as a whole and, if it is longer than a passage, its overlapping passages, the last one up to its end."""
    size = 2 * HALF
    return [(0, n), *((a, a + size) for a in [*range(0, n - size, STEP), n - size] if n > size)]


class Items:
    """The benchmark's items and its columns."""

    def __init__(self, ids: list[int], texts: list[str]):
        lowered = [(t or "").lower() for t in texts]
        seqs = words_of(lowered)
        answers = words_of([next((s for s in reversed(SENTENCE.split(t)) if re.search(r"[^\W\d_]", s)), "") for t in lowered])
        keep = [i for i, s in enumerate(seqs) if len(s)]
        self.ids = [ids[i] for i in keep]
        self.seqs = [seqs[i].tolist() for i in keep]
        self.answers = [answers[i].tolist() for i in keep]
        self.places = [places(s) for s in self.seqs]
        self.counts = [list(Counter(s).items()) for s in self.seqs]
        self.answer_places = [places(s) for s in self.answers]
        #: Item, first word and end of all that is looked for: each item, and the passages of a long one.
        self.cuts = [(i, a, e) for i, s in enumerate(self.seqs) for a, e in cuts(len(s))]
        self.vocab = np.unique(np.concatenate([np.array(s, np.uint64) for s in self.seqs])) if self.seqs else np.zeros(0, np.uint64)
        self.columns = min(len(self.vocab), MOST_COLUMNS)
        bits = 20
        self.flag = np.zeros(1 << bits, bool)
        self.shift = np.uint64(64 - bits)
        self.flag[(self.vocab >> self.shift).astype(np.int64)] = True

    def column(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of words that have a column, and their columns."""
        at = np.flatnonzero(self.flag[(h >> self.shift).astype(np.int64)])
        col = np.searchsorted(self.vocab, h[at])
        ok = self.vocab[np.minimum(col, len(self.vocab) - 1)] == h[at]
        at, col = at[ok], col[ok]
        return at, col % self.columns


def _frequencies(shared):
    def run(batches):
        items = shared.value
        total, n = np.zeros(items.columns, np.int64), 0
        for b in pieces(batches, most=1 << 20):
            w = Words(b.column("low"), letters=True)
            at, col = items.column(w.hash)
            seen = np.unique(w.doc[at].astype(np.int64) * items.columns + col)
            total += np.bincount(seen % items.columns, minlength=items.columns)
            n += b.num_rows
        if n:
            # in slices, so that adding up is spread as well
            for k, part in enumerate(np.array_split(np.r_[total, n], 8)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["k", "part"])

    return run


def _sums(dtype):
    """Adds up packed arrays by k, from rows sorted by it."""

    def run(batches):
        now, total = None, None
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(part, dtype)
                if k != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "part"])
                    now, total = k, np.zeros(len(x), dtype)
                total = total + x
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "part"])

    return run


def added(df: DataFrame, dtype) -> np.ndarray | None:
    """The sum over all rows (k, part) of arrays of a fixed size, in the order of k."""
    got = df.repartition("k").sortWithinPartitions("k").mapInArrow(_sums(dtype), "k int, part binary").collect()
    return np.concatenate([np.frombuffer(r["part"], dtype) for r in sorted(got, key=lambda r: r["k"])]) if got else None


#: Rows that are added up one after the other; more are added up in parts.
RUN = 32


def summed(table: np.ndarray, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of table[rows] over groups of one row or more that follow each other: the k-th rows of all groups at once."""
    if int(size.max()) > RUN:
        parts = -(-size // RUN)
        cut = np.full(int(parts.sum()), RUN)
        cut[np.cumsum(parts) - 1] = size - (parts - 1) * RUN
        part = summed(table, rows, cut)
        return summed(part, np.arange(len(part)), parts)
    o = np.argsort(-size, kind="stable")
    begin, left = (np.cumsum(size) - size)[o], -size[o]
    sums = table.take(rows[begin], axis=0)
    for k in range(1, -int(left[0])):
        m = np.searchsorted(left, -k)  # the groups of more than k rows come first
        sums[:m] += table.take(rows[begin[:m] + k], axis=0)
    out = np.empty_like(sums)
    out[o] = sums
    return out


def begins(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal keys begin, and how many there are."""
    begin = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return begin, np.diff(np.r_[begin, len(sorted_keys)])


def blocks(w: Words, at: np.ndarray, col: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the rows of table over the half passages, for the places of words and their columns; each half's document and first word."""
    size = np.diff(w.first)
    halves = -(-size // HALF)
    first_half = np.r_[0, np.cumsum(halves)]
    half = first_half[w.doc[at]] + (at - w.first[w.doc[at]]) // HALF
    out = np.zeros((int(first_half[-1]), table.shape[1]), np.float32)
    if len(at):
        begin, n = begins(half)
        out[half[begin]] = summed(table, col, n)
    doc = np.repeat(np.arange(len(size)), halves)
    start = (np.arange(len(doc)) - first_half[doc]) * HALF
    return out, doc, start


def _range(shared, idf, omega):
    """Sums over passages of A' (A X), in slices; A's rows are the TF-IDF passages, scaled to length 1."""

    def run(batches):
        items, weights = shared.value, idf.value
        x = (omega.value * weights[:, None]).astype(np.float32)
        total = np.zeros(x.shape)
        some = False
        for b in pieces(batches, most=RANGE_BYTES, column="low"):
            w = Words(b.column("low"), letters=True)
            at, col = items.column(w.hash)
            if not len(at):
                continue
            some = True
            # each document's halves, and one without words after them
            first_half = np.r_[0, np.cumsum(1 - (-np.diff(w.first) // HALF))]
            half = first_half[w.doc[at]] + (at - w.first[w.doc[at]]) // HALF
            # a word belongs to the passage that begins with its half, and to the one before in its document
            before = half > first_half[w.doc[at]]
            key, n = np.unique(np.r_[half, half[before] - 1] * items.columns + np.r_[col, col[before]], return_counts=True)
            norm2 = np.bincount(key // items.columns, np.square(n * weights[key % items.columns]), int(first_half[-1]))
            y = np.zeros((len(norm2) + 2, x.shape[1]), np.float32)
            begin, n = begins(half)
            y[half[begin] + 1] = summed(x, col, n)
            passage = y[:-1] + y[1:]
            passage[1:] *= np.where(norm2 > 0, 1 / np.maximum(norm2, 1e-24), 0).astype(np.float32)[:, None]
            passage[0] = 0
            z = passage[1:] + passage[:-1]  # a half's words are in two passages
            o = np.argsort(col, kind="stable")
            first, n = begins(col[o])
            total[col[o[first]]] += summed(z, half[o], n)
        if some:
            total *= weights[:, None]
            for k, part in enumerate(np.array_split(total, 8)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["k", "part"])

    return run


class ItemRows:
    """The items' TF-IDF rows, of length 1, as (row, column, value) sorted by row: products with a matrix without a dense table of items by columns."""

    def __init__(self, items: Items, idf: np.ndarray):
        found = [np.unique(items.column(np.array(s, np.uint64))[1], return_counts=True) for s in items.seqs]
        size = np.array([len(c) for c, _ in found], np.int64)
        self.columns, self.first = items.columns, np.r_[0, np.cumsum(size)]
        self.col = np.concatenate([c for c, _ in found])
        v = np.concatenate([n for _, n in found]) * idf[self.col]
        row = np.repeat(np.arange(len(size)), size)
        self.value = v / np.maximum(np.sqrt(np.bincount(row, v * v, len(size))), 1e-12)[row]

    def times(self, x: np.ndarray, rows: int = 1000) -> np.ndarray:
        """B x, some items at a time."""
        out = np.zeros((len(self.first) - 1, x.shape[1]))
        for i in range(0, len(out), rows):
            cut = self.first[i : i + rows + 1]
            part = x[self.col[cut[0] : cut[-1]]] * self.value[cut[0] : cut[-1], None]
            out[i : i + rows] = np.add.reduceat(part, cut[:-1] - cut[0], axis=0)
        return out

    def back(self, y: np.ndarray, rows: int = 1000) -> np.ndarray:
        """B' y, some items at a time."""
        out = np.zeros((self.columns, y.shape[1]))
        for i in range(0, len(y), rows):
            cut = self.first[i : i + rows + 1]
            row = np.repeat(np.arange(i, i + len(cut) - 1), np.diff(cut))
            np.add.at(out, self.col[cut[0] : cut[-1]], y[row] * self.value[cut[0] : cut[-1], None])
        return out


def _item_vectors(items: Items, idf: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The projections, of length 1, of all that is looked for."""
    out, now = np.zeros((len(items.cuts), v.shape[1])), None
    for row, (i, a, e) in zip(out, items.cuts, strict=True):
        if i != now:
            _, col = items.column(np.array(items.seqs[i], np.uint64))
            now, sums = i, np.vstack([np.zeros(v.shape[1]), np.cumsum(v[col] * idf[col, None], axis=0)])
        row[:] = sums[e] - sums[a]
    return (out / np.maximum(np.sqrt((out * out).sum(1)), 1e-12)[:, None]).astype(np.float32)


def decompose(rows: DataFrame, items: Items, idf: np.ndarray, rank: int = RANK, seed: int = 17) -> np.ndarray:
    """Right singular vectors (columns by rank) of the passages of all rows and the items, in one pass: of C = A'A, C W for a random W tells its range, and W'C W the turn within it (Nystroem).

    An item counts as much as a passage; so that the rank holds what tells items
    apart, the items' rows come in with the weight of the average column.
    """
    sc = rows.sparkSession.sparkContext
    rank = min(rank, items.columns)
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((items.columns, min(items.columns, rank + EXTRA))))[0].astype(np.float32)
    got = added(rows.mapInArrow(_range(sc.broadcast(items), sc.broadcast(idf), sc.broadcast(w)), "k int, part binary"), float)
    b = ItemRows(items, idf)
    z = b.back(b.times(w))
    if got is not None:
        y = got.reshape(items.columns, -1)
        z = y + max(1.0, np.linalg.norm(y) / max(np.linalg.norm(z), 1e-12)) * z
    core = w.T @ z
    value, turn = np.linalg.eigh((core + core.T) / 2)
    good = value > 1e-6 * value[-1]
    root = z @ (turn[:, good] / np.sqrt(value[good]))  # C is about root root'
    value, turn = np.linalg.eigh(root.T @ root)
    good = np.flatnonzero(value > 1e-9 * value[-1])[::-1][:rank]
    return (root @ (turn[:, good] / np.sqrt(value[good]))).astype(np.float32)


class ItemWords:
    """The items' different words by their columns, and which items can have enough of them in a stretch of text."""

    def __init__(self, items: Items):
        found = [np.unique(items.column(np.array(s, np.uint64))[1], return_counts=True) for s in items.seqs]
        self.of_cut = np.array([i for i, _, _ in items.cuts], np.int64)
        self.n = np.array([len(s) for s in items.seqs], np.int64)
        self.size = np.array([len(c) for c, _ in found], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.col, self.count = (np.concatenate([f[k] for f in found]) for k in (0, 1))

    def enough(self, w: Words, at: np.ndarray, col: np.ndarray, doc: np.ndarray, start: np.ndarray, span: int, item: np.ndarray, rows: int = 4096) -> np.ndarray:
        """The hits (document, first word, item) whose stretch has WITH_ANSWER of the item's words, in any order; items of more than a passage, whose stretches are joined, are all kept.

        at, col: the places of words that have columns, and their columns.
        """
        n, all_words = self.n[item], len(w.hash)
        a, size = w.first[doc], w.first[doc + 1] - w.first[doc]
        low, high = a + np.maximum(0, start - n), a + np.minimum(size, start + span + n)
        there = np.sort(col * all_words + at)
        there = np.r_[there, np.iinfo(np.int64).max]
        keep = n > 2 * HALF
        ask = np.flatnonzero(~keep)
        for hit in np.array_split(ask, -(-len(ask) // rows)) if len(ask) else []:
            k = self.size[item[hit]]
            of = np.repeat(np.arange(len(hit)), k)
            word = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k) + self.first[item[hit]][of]
            key = self.col[word] * all_words
            inside = there[np.searchsorted(there, key + low[hit][of])] < key + high[hit][of]
            keep[hit] = np.bincount(of[inside], self.count[word[inside]], len(hit)) >= WITH_ANSWER * n[hit]
        return np.flatnonzero(keep)


def _search(model, item_vectors, cosine):
    def run(batches):
        items, idf, v = model.value
        table, iv, words = v * idf.astype(np.float32)[:, None], item_vectors.value, ItemWords(items)
        for b in pieces(batches, most=1 << 19):
            w = Words(b.column("low"), letters=True)
            if not len(w.hash):
                continue
            at_word, col = items.column(w.hash)
            half, doc, start = blocks(w, at_word, col, table)
            both = half.copy()
            joined, alone = doc[1:] == doc[:-1], np.flatnonzero(np.r_[doc[1:] != doc[:-1], True])
            both[:-1][joined] += half[1:][joined]
            found: dict[tuple[int, int], list] = {}
            norms = [np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9) for x in (both, half)]
            width = max(1, CELLS // len(half))
            for at in range(0, len(iv), width):
                # the halves alone as well: a short item fills one half only
                raw = half @ iv[at : at + width].T
                pair = np.empty_like(raw)
                np.add(raw[:-1], raw[1:], out=pair[:-1])
                pair[alone] = raw[alone]
                for norm, c, span in ((norms[0], pair, 2 * HALF), (norms[1], raw, HALF)):
                    p, i = np.divmod(np.flatnonzero(c >= ((cosine - 1e-4) * norm)[:, None].astype(np.float32)), c.shape[1])
                    c = c[p, i] / norm[p]
                    some = np.flatnonzero(c >= cosine)
                    p, i, c = p[some], words.of_cut[i[some] + at], c[some]
                    some = words.enough(w, at_word, col, doc[p], start[p], span, i)
                    for d, k, v_, s in zip(doc[p[some]].tolist(), i[some].tolist(), c[some].tolist(), start[p[some]].tolist(), strict=True):
                        found.setdefault((d, k), []).append((v_, s, span))
            rows = []
            ids = b.column("doc_id").to_pylist()
            for (d, k), hits in sorted(found.items()):
                a0, n = int(w.first[d]), len(items.seqs[k])
                size = int(w.first[d + 1]) - a0
                best = (-1.0, 0.0, 0.0, 0)
                done: set = set()
                for c, s, a, e in _stretches(hits, n, size):
                    if (a, e) in done:
                        continue
                    done.add((a, e))
                    text = w.hash[a0 + a : a0 + e].tolist()
                    # a common subsequence has at most the words that both have
                    there = set(text)
                    if sum(m for x, m in items.counts[k] if x in there) < WITH_ANSWER * n:
                        continue
                    share, answer = _share(items, k, text)
                    best = max(best, (share, answer, c, s))
                share, answer, c, s = best
                if share >= (1.0 if n < SHORT else ALONE) or (n >= SHORT and share >= WITH_ANSWER and answer >= ANSWER):
                    rows.append((ids[d], items.ids[k], c, share, answer, s))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3]), pa.array(cols[4]), pa.array(cols[5], pa.int64())], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "word"])

    return run


def _stretches(hits: list[tuple], n: int, size: int) -> list[tuple]:
    """Where to compare an item of n words with a text of some size: around each hit (cosine, first word, words); those of an item longer than a passage overlap and are joined, with the best hit's cosine and place."""
    out = [(c, s, max(0, s - n), min(size, s + span + n)) for c, s, span in hits]
    if n <= 2 * HALF:
        return out
    joined: list[tuple] = []
    for c, s, a, e in sorted(out, key=lambda x: x[2:]):
        if joined and a <= joined[-1][3]:
            last = joined[-1]
            joined[-1] = (*max(last[:2], (c, s)), last[2], max(last[3], e))
        else:
            joined.append((c, s, a, e))
    return joined


def _share(items: Items, k: int, text: list[int]) -> tuple[float, float]:
    """The largest share of the item's words, and of its answer's, in common order with a stretch of the text not longer than a paraphrase: one and a half times the item."""
    n = len(items.seqs[k])
    most = n + max(4, n // 2)
    best = (0.0, 0.0)
    for a in range(0, max(1, len(text) - most + 1), max(1, n // 4)):
        part = text[a : a + most]
        share = lcs(items.places[k], n, part) / n
        if share > best[0]:
            m = len(items.answers[k])
            best = (share, lcs(items.answer_places[k], m, part) / m if m else 0.0)
    tail = text[-most:]
    share = lcs(items.places[k], n, tail) / n
    if share > best[0]:
        m = len(items.answers[k])
        best = (share, lcs(items.answer_places[k], m, tail) / m if m else 0.0)
    return best


RESULT = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, word long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Documents that hold a benchmark item, one row per pair: doc_id, item_id, cosine, lcs_share, answer_share, word (where the passage begins).

    A pair is a leak if ALONE of the item's words stand in the passage in their
    order, or WITH_ANSWER of them and ANSWER of its last sentence's; an item of
    fewer than SHORT words must be there as a whole. Of stretches that hold equally
    much of an item the one of the higher cosine, then the later one, is told. Texts
    and items of any length are read whole, an item of more than a passage by its
    passages. Null and empty texts and items match nothing; repeated rows give
    repeated pairs; empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    importable(spark)
    sc = spark.sparkContext
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), low("text").alias("low")))
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null")
    passages = F.when(F.length("text") > 12 * HALF, F.floor(F.length("text") / (6 * STEP))).otherwise(0)
    n_items, out = asked.agg(F.coalesce(F.sum(1 + passages), F.lit(0))).first()[0], None
    parts = max(1, -(-n_items // MOST_ITEMS))
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id", "text").collect() if parts > 1 else asked.orderBy("item_id", "text").collect()
        items = Items([r["item_id"] for r in own], [r["text"] for r in own])
        if not items.columns:
            continue
        shared = sc.broadcast(items)
        counts = added(rows.mapInArrow(_frequencies(shared), "k int, part binary"), np.int64)
        n = int(counts[-1]) if counts is not None else 0
        idf = np.log((n + 1) / ((counts[:-1] if n else np.zeros(items.columns)) + 1)) + 0.1
        v = decompose(rows, items, idf)
        iv = _item_vectors(items, idf, v)
        found = rows.mapInArrow(_search(sc.broadcast((items, idf, v)), sc.broadcast(iv), cosine), RESULT)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], RESULT)
