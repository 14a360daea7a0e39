"""Toxicity (operator 2): weak supervision.

Terms (words and word beginnings) that tell toxic labelled documents from others
are mined from a bounded sample and dealt to lexicon voters by how well they tell;
pattern voters look at case, punctuation and address. All documents outside the held-out fold vote.
A generative model takes from the voters' moments over all of them each voter's
accuracy (by triplets of voters) and the correlations beyond what the accuracies
explain; a vote's evidence, the log-ratio of its probabilities, is divided by one plus
its voter's correlations, so that voters that repeat each other don't count for more.
The posteriors are the labels from which a linear classifier over term counts is trained.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, pieces, spread
from .learning import fold, labelled_sample
from .quality import calibrate

LETTERS = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that count as terms.
HEADS = (3, 4, 5, 6)
MOST_LABELLED = 6000
#: Terms of the lexicons, those of the best odds: 16 in the first of nine, twice as many up to each other one.
MOST_TERMS = 4096
LEXICONS = 9
#: Documents whose posterior labels train the classifier at most.
MOST_TRAINED = 12_000
KEEP = 500_000
#: A voter that finds nothing says "not toxic" in long documents only.
SURE_WORDS = 20
#: The first lexicon has so many terms, and each other as many as all before it.
FIRST = 16
#: Words of a document for each of which a lexicon must find one term.
SPARSE = 500

#: English words of abuse; a voter beside the mined ones.
ABUSE = frozenset("idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown dumb imbecile vermin filth hate kill".split())
ADDRESS = re.compile(r"(?i)\b(?:you|your|they)\W+(?:are\W+)?(?:\w+\W+){0,2}?(?:idiots?|morons?|stupid|losers?|scum|trash|pathetic|worthless|disgusting|clowns?)\b")
SHOUT = re.compile(r"\b[A-Z]{3,}!+")
STARRED = re.compile(r"\b[A-Za-z][*#@$%]{2,}[A-Za-z]*\b")
PATTERNS = (ADDRESS, SHOUT, STARRED)


def terms_of(word: str) -> set[str]:
    """The term of a lower-case word, and those of its beginnings, which end in a star."""
    return {word} | {word[:n] + "*" for n in HEADS if len(word) >= n}


def _terms(batches):
    for b in pieces(batches):
        out = []
        for t in b.column("text").to_pylist():
            words = set(LETTERS.findall((t or "").lower()))
            out.append(sorted(set().union(*map(terms_of, words))) if words else [])
        yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(out, pa.list_(pa.string()))], names=["label", "terms"])


def mine(docs: DataFrame, labels: DataFrame, modulus: int, held: int, most: int) -> tuple[list[str], float]:
    """Terms in order of their odds, and the share of toxic documents.

    Counted on the executors over the sample of labelled documents; a term needs
    five toxic documents and odds of eight to one.
    """
    chosen = labelled_sample(labels, "toxic", modulus, held, most)
    n = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return [], 0.5
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(_terms, "label int, terms array<string>")
    c = got.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("t"), F.count("*").alias("n"))
    odds = (F.col("t") + 0.1) / n1 / ((F.col("n") - F.col("t") + 0.5) / n0)
    rows = c.where(F.col("t") >= min(5, n1)).select("term", "t", odds.alias("odds")).where("odds >= 8").orderBy(F.desc("odds"), "term").limit(MOST_TERMS).collect()
    return [r["term"] for r in rows], n1 / (n0 + n1)


class Lexicon:
    """Which terms a word has; a worker keeps what it has looked up."""

    def __init__(self, terms: list[str]):
        self.at = {t: i for i, t in enumerate(terms)}
        self.known: dict[str, tuple] = {}

    def hits(self, words: list[str]) -> Counter:
        known, found = self.known, Counter()
        for w, n in Counter(words).items():
            h = known.get(w)
            if h is None:
                if len(known) > KEEP:
                    known.clear()
                h = known[w] = tuple(sorted(self.at[t] for t in terms_of(w) if t in self.at))
            for i in h:
                found[i] += n
        return found


_lexicons: dict = {}


def _lexicon(terms: list[str]) -> Lexicon:
    key = hash(tuple(terms))
    if key not in _lexicons:
        _lexicons.clear()
        _lexicons[key] = Lexicon(terms)
    return _lexicons[key]


def lexicon_of(rank: int) -> int:
    """The voter of the term at a place in the order of odds."""
    return min(LEXICONS - 1, max(0, (rank // FIRST).bit_length()))


def votes(text: str, words: list[str], hits: Counter) -> np.ndarray:
    """One vote per voter: 1 toxic, -1 not, 0 none. A lexicon without finds says -1 if the text is long enough to have some."""
    none = -1.0 if len(words) >= SURE_WORDS else 0.0
    out = np.full(LEXICONS + 1 + len(PATTERNS), none)
    found = [0] * LEXICONS
    for i, n in hits.items():
        found[lexicon_of(i)] += n
    for k, n in enumerate(found):
        if n and n * SPARSE >= len(words):
            out[k] = 1.0
    if not ABUSE.isdisjoint(words):
        out[LEXICONS] = 1.0
    for k, p in enumerate(PATTERNS):
        out[LEXICONS + 1 + k] = 1.0 if p.search(text) else 0.0
    return out


def _vote(model):
    def run(batches):
        terms = model.value
        lex = _lexicon(terms)
        m = LEXICONS + 1 + len(PATTERNS)
        total, sums, prods, n = np.zeros(m), np.zeros(m), np.zeros((m, m)), 0
        for b in pieces(batches):
            rows = []
            for t in b.column("text").to_pylist():
                words = LETTERS.findall((t or "").lower())
                h = lex.hits(words)
                rows.append(votes(t or "", words, h))
            v = np.array(rows)
            n, total, sums, prods = n + len(v), total + (v != 0).sum(0), sums + v.sum(0), prods + v.T @ v
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([np.r_[total, sums, prods.ravel()].tolist()], pa.list_(pa.float64()))], names=["n", "moments"])

    return run


def label_model(n: int, moments: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Accuracies and residual correlations of the voters from their moments.

    With Y in {-1, 1} of mean 2*prior-1, votes that are independent given Y have
    Cov(i, j) = Cov(i, Y) Cov(j, Y) / Var(Y); the median over triplets gives
    each |Cov(i, Y)|. What of Cov(i, j) is beyond that product is the voters'
    own correlation.
    """
    m = LEXICONS + 1 + len(PATTERNS)
    mean = moments[m : 2 * m] / n
    cov = moments[2 * m :].reshape(m, m) / n - np.outer(mean, mean)
    var_y = 1 - (2 * prior - 1) ** 2
    a = np.zeros(m)
    for i in range(m):
        got = [abs(cov[i, j] * cov[i, k] / cov[j, k]) for j, k in itertools.combinations([x for x in range(m) if x != i], 2) if abs(cov[j, k]) > 1e-6 and cov[i, j] > 0 and cov[i, k] > 0]
        a[i] = math.sqrt(np.median(got) * var_y) if got else 0.0
    a = np.minimum(a, np.sqrt(np.maximum(np.diag(cov), 0) * var_y) * 0.999)
    return a, cov - np.outer(a, a) / var_y


def posteriors(v: np.ndarray, mean: np.ndarray, accuracy: np.ndarray, residual: np.ndarray, prior: float) -> np.ndarray:
    """The probability of label 1 given each row's votes.

    E[v | Y] follows from the voter's mean and its covariance with Y; a voter's
    evidence is the log-ratio of its vote's probabilities (an abstention has none)
    and is divided by one plus its correlation with the other voters.
    """
    y = 2 * prior - 1
    slope = accuracy / max(1 - y * y, 1e-9)
    up = np.clip((1 + mean + slope * (1 - y)) / 2, 1e-4, 1 - 1e-4)  # P(vote 1 | toxic)
    down = np.clip((1 + mean - slope * (1 + y)) / 2, 1e-4, 1 - 1e-4)
    scale = np.sqrt(np.maximum(np.diag(residual) + accuracy**2 / max(1 - y * y, 1e-9), 1e-9))
    corr = np.abs(residual / np.outer(scale, scale))
    np.fill_diagonal(corr, 0)
    share = 1 / (1 + np.minimum(corr, 1).sum(1))
    z = math.log(prior / (1 - prior)) + ((v > 0) * np.log(up / down) * share + (v < 0) * np.log((1 - up) / (1 - down)) * share).sum(1)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _train_rows(model):
    """Votes and term counts of the documents that train the classifier."""

    def run(batches):
        terms = model.value
        lex = _lexicon(terms)
        for b in pieces(batches):
            v, idx, cnt, words_n = [], [], [], []
            for t in b.column("text").to_pylist():
                words = LETTERS.findall((t or "").lower())
                h = lex.hits(words)
                v.append(votes(t or "", words, h).tolist())
                idx.append(sorted(h)), cnt.append([h[i] for i in sorted(h)]), words_n.append(len(words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(v, pa.list_(pa.float64())), pa.array(idx, pa.list_(pa.int32())), pa.array(cnt, pa.list_(pa.int32())), pa.array(words_n, pa.int32())], names=["doc_id", "label", "votes", "rows", "counts", "n"])

    return run


def weight_of(count: float, words: int) -> float:
    """A term's weight in a document: the log of its count per hundred words, plus 1."""
    return math.log1p(100 * count / max(words, 1))


def vector(cnt: list[int], words: int) -> np.ndarray:
    return np.array([weight_of(c, words) for c in cnt])


def fit_linear(rows: list[tuple[list[int], np.ndarray]], target: np.ndarray, n_terms: int, epochs: int = 8, rate: float = 0.3, ridge: float = 1e-5, seed: int = 11) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by stochastic gradient descent."""
    rng, w, b = np.random.default_rng(seed), np.zeros(n_terms), 0.0
    for epoch in range(epochs):
        lr = rate / (1 + epoch)
        for i in rng.permutation(len(rows)):
            idx, x = rows[i]
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[idx] @ x) + b))))
            g = p - target[i]
            if len(idx):
                w[idx] -= lr * (g * x + ridge * w[idx])
            b -= lr * 0.2 * g
    return w, b


def _score(model):
    def run(batches):
        terms, w, bias, a, c = model.value
        lex = _lexicon(terms)
        for b in pieces(batches):
            z = []
            for t in b.column("text").to_pylist():
                words = LETTERS.findall((t or "").lower())
                z.append(bias + sum(w[i] * weight_of(n, len(words)) for i, n in lex.hits(words).items()))
            p = 1 / (1 + np.exp(-np.clip(a * np.array(z) + c, -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, most: int = MOST_LABELLED) -> dict:
    """The label model over all documents outside the held-out fold and the classifier trained on its posteriors."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms, prior = mine(rows, labels, modulus, held, most)
    plain = {"terms": [], "weights": np.zeros(1), "bias": math.log(prior / (1 - prior)), "slope": 1.0, "shift": 0.0, "accuracy": np.zeros(0), "correlation": np.zeros((0, 0))}
    if not terms:
        return plain
    shared = sc.broadcast(terms)
    mine_rows = rows.where(fold(modulus) != held)
    got = mine_rows.mapInArrow(_vote(shared), "n long, moments array<double>")
    m = LEXICONS + 1 + len(PATTERNS)
    sums = got.select("n", F.posexplode("moments").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("k").collect()
    if not sums:
        return plain
    n, moments = sums[0]["n"], np.array([r["x"] for r in sums])
    accuracy, residual = label_model(n, moments, prior)
    # the classifier's documents: labelled ones for balance, and as many others
    chosen = labelled_sample(labels, "toxic", modulus, held, most)
    both = mine_rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    share = min(1.0, max(0, MOST_TRAINED - most) / max(1, n))
    others = mine_rows.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))).select("doc_id", F.lit(-1).alias("label"), "text")
    data = both.unionByName(others).mapInArrow(_train_rows(shared), "doc_id long, label int, votes array<double>, rows array<int>, counts array<int>, n int").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")]).to_pydict()
    v, y = np.array(data["votes"]).reshape(-1, m), np.array(data["label"])
    mean = moments[m : 2 * m] / n
    posterior = posteriors(v, mean, accuracy, residual, prior)
    x = [(np.array(i, np.int64), vector(c, n)) for i, c, n in zip(data["rows"], data["counts"], data["n"], strict=True)]
    w, b = fit_linear(x, posterior, len(terms))
    z = np.array([b + (w[i] @ xx if len(i) else 0.0) for i, xx in x])
    known = y >= 0
    slope, shift = calibrate(z[known], y[known]) if known.any() else (1.0, 0.0)
    if slope <= 0:
        slope, shift = 1.0, 0.0
    return {"terms": terms, "weights": w, "bias": b, "slope": slope, "shift": shift, "accuracy": accuracy, "correlation": residual}


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, cut: float = 0.5) -> DataFrame:
    """Scores every whole text: doc_id, held_out, score (higher: label 1 likelier), predicted.

    Null and empty texts have no terms and get the score of the bias; repeated
    rows are scored row by row, a row without a doc_id like any other; equal texts
    have equal scores; a text of any length is read whole. Without labels of both
    kinds every score is the prior. An empty table gives no rows; other columns are
    ignored.
    """
    spark = docs.sparkSession
    importable(spark)
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    model = train(docs, labels, modulus, held)
    shared = spark.sparkContext.broadcast(tuple(model[k] for k in ("terms", "weights", "bias", "slope", "shift")))
    scored = docs.withColumn("held_out", fold(modulus) == held).mapInArrow(_score(shared), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
