"""Quality classifier (operator 9): supervised subword embeddings.

Every word and every character n-gram of a word is hashed to a row of a table
of vectors. A document is the average of the rows of all its words; a softmax
over that average gives the score. Table and softmax are learned together by
stochastic gradient descent in numpy. As softmax and average are linear, the
learned table is folded to one number per row for scoring.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, importable, mixed, pieces, spread
from .learning import fold, labelled_sample
from .words import Words

BITS = 17
BUCKETS = 1 << BITS
DIM = 12
SIZES = (2, 3, 4)
#: Labelled documents that training uses at most.
MOST_LABELLED = 5000
#: The row of "this word equals the one before".
AGAIN = xxhash.xxh32_intdigest(b"again") % BUCKETS


class _Text:
    """The characters of a batch's words with one blank before, between and after them, document after document."""

    def __init__(self, column):
        w = self.words = Words(column)
        # characters before each byte
        at = np.r_[0, np.cumsum((w.body & 0xC0) != 0x80)]
        begin = at[w.begin]
        size = at[w.end] - begin
        docs = len(w.first) - 1
        # each document begins with a blank and each word ends with one
        lead = w.doc + 1
        self.end = np.cumsum(size + 1) - 1 + lead
        self.begin = self.end - size
        total = int((size + 1).sum()) + docs
        out = np.full(total, 32, np.uint32)
        if len(size):
            code = np.frombuffer(w.body.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
            inner = np.arange(int(size.sum())) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
            out[inner + np.repeat(self.begin, size)] = code[inner + np.repeat(begin, size)]
        self.text = out
        words = np.bincount(w.doc, size + 1, docs).astype(np.int64) if docs else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(docs), words + 1)


def rows_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all documents of a batch and whose each is: for every word that of the word and those of its character n-grams, its ends marked by blanks, and one for a word that is the same as the one before."""
    t = _Text(column)
    w, b = t.words, t.text.astype(np.uint64)
    shift = np.uint64(64 - BITS)
    rows, docs = [(w.hash * MULT >> shift).astype(np.int32)], [w.doc]
    again = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1]))
    rows.append(np.full(len(again), AGAIN, np.int32)), docs.append(w.doc[again])
    blank = np.r_[0, np.cumsum(t.text == 32)]
    n_chars = len(b)
    key = b
    for n in range(2, max(SIZES) + 1):
        if n_chars < n:
            break
        key = key[: n_chars - n + 1] * MULT + b[n - 1 :]
        if n not in SIZES:
            continue
        at = np.arange(n_chars - n + 1)
        # blanks only at the ends, and no two ends of different documents
        ok = (blank[at + n - 1] == blank[at + 1]) & (t.doc[at] == t.doc[at + n - 1])
        if n == 2:
            ok &= (t.text[at] != 32) | (t.text[at + 1] != 32)
        at = at[ok]
        rows.append((mixed(key[at] + (np.uint64(n) << np.uint64(56))) >> shift).astype(np.int32)), docs.append(t.doc[at])
    return np.concatenate(rows), np.concatenate(docs)


def _bags(batches):
    """(label, rows, weights) of each document; rows are distinct and weights sum to 1."""
    for b in pieces(batches, most=1 << 19):
        rows, docs = rows_of(b.column("text"))
        key, n = np.unique(docs.astype(np.int64) * BUCKETS + rows, return_counts=True)
        at = np.searchsorted(key, np.arange(b.num_rows + 1) * BUCKETS)
        ids = [(key[x:y] % BUCKETS).astype(np.int32) for x, y in zip(at[:-1], at[1:], strict=True)]
        share = [(n[x:y] / max(1, n[x:y].sum())).astype(np.float32) for x, y in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(ids, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], names=["doc_id", "label", "rows", "weights"])


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 0.6, seed: int = 7) -> tuple[np.ndarray, float]:
    """Learns table and softmax; returns the log-odds of label 1 per row, and the bias."""
    rng = np.random.default_rng(seed)
    e = ((rng.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
    w, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, at = epochs * max(1, len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            y, rows, weights = bags[i]
            lr = np.float32(rate * (1 - at / steps))
            at += 1
            v = e[rows]
            x = weights @ v
            z = w @ x + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            g = p @ w
            w -= lr * np.outer(p, x)
            bias -= lr * np.float32(0.1) * p
            if len(rows):
                # each row's step is that of its share, scaled up so that rare rows move too
                e[rows] = v - lr * np.outer(np.minimum(weights * 50, 1), g)
    return (e @ (w[1] - w[0])).astype(np.float64), float(bias[1] - bias[0])


def _score(model):
    def run(batches):
        odds, bias, a, c = model.value
        for b in pieces(batches, most=1 << 19):
            rows, docs = rows_of(b.column("text"))
            n = np.bincount(docs, minlength=b.num_rows)
            z = bias + np.bincount(docs, odds[rows], b.num_rows) / np.maximum(n, 1)
            p = 1 / (1 + np.exp(-np.clip(a * z + c, -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def _kept(model, cut):
    """The rows, with all their columns, whose text scores at least cut."""

    def run(batches):
        odds, bias, a, c = model.value
        for b in pieces(batches, most=1 << 19):
            rows, docs = rows_of(b.column("text"))
            n = np.bincount(docs, minlength=b.num_rows)
            z = bias + np.bincount(docs, odds[rows], b.num_rows) / np.maximum(n, 1)
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(a * z + c, -40, 40))) >= cut))

    return run


def calibrate(z: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Platt scaling by Newton steps with a little ridge; (1, 0) where a class is missing."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    m, s = z.mean(), z.std() + 1e-9
    x = np.c_[(z - m) / s, np.ones(len(z))]
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    b = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t) + 1e-3 * b)
        b -= np.clip(step, -2, 2)
    return b[0] / s, b[1] - b[0] * m / s


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held: int = 2, most: int = MOST_LABELLED):
    """The model (log-odds per row, bias, slope, shift), from at most `most` labelled documents outside the held-out fold."""
    chosen = F.broadcast(labelled_sample(labels, label, modulus, held, most))
    bags = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    got = bags.select("doc_id", "label", "text").mapInArrow(_bags, "doc_id long, label int, rows array<int>, weights array<float>").toArrow().sort_by("doc_id")
    data = list(zip(got["label"].to_pylist(), _lists(got["rows"]), _lists(got["weights"]), strict=True))
    # a fifth is left out for calibration
    odds, bias = fit([d for i, d in enumerate(data) if i % 5])
    rest = [d for i, d in enumerate(data) if not i % 5]
    a, c = calibrate(np.array([bias + w @ odds[r] for _, r, w in rest]), np.array([y for y, _, _ in rest])) if rest else (1.0, 0.0)
    return odds, bias, a if a > 0 else 1.0, c if a > 0 else 0.0


def _lists(column) -> list[np.ndarray]:
    """The lists of a column as views of it."""
    out = []
    for chunk in column.chunks:
        at, flat = np.asarray(chunk.offsets), chunk.values.to_numpy(zero_copy_only=False)
        out.extend(flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True))
    return out


def classify(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held: int = 2, cut: float = 0.7, most: int = MOST_LABELLED) -> DataFrame:
    """Scores every whole text: doc_id, held_out, score (higher: label 1 likelier), predicted.

    Null and empty texts get the score of no evidence; repeated rows are scored
    row by row, a row without a doc_id like any other; equal texts have equal
    scores; a text of any length is read whole. Without labelled rows every score is
    the same. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    importable(spark)
    model = spark.sparkContext.broadcast(train(train_docs, labels, label, modulus, held, most))
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold(modulus) == held).alias("held_out")))
    scored = rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held: int = 2, cut: float = 0.7, most: int = MOST_LABELLED) -> DataFrame:
    """docs without the rows that the classifier rejects, with all columns as they are, whatever their names.

    Null and empty texts are judged by the score of no evidence; each row is judged
    on its own, so equal ones stay or go together; an empty table stays empty.
    """
    importable(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, modulus, held, most))
    return spread(docs).mapInArrow(_kept(model, cut), docs.schema)
