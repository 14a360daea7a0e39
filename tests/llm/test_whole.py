"""Texts of several megabytes through every operator, invariants of whole results by SQL, and the classifier's fit by plain loops."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from tessera.llm import automata, decontamination, edits, jaccard, langid, merkle, packing, quality, suffixes, toxicity
from tessera.llm.common import table
from tessera.llm.tokens import default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
MEGABYTES = 5


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(17)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 10))) for _ in range(20_000)]
    out, size = [], 0
    while size < MEGABYTES << 20:
        w = rng.choice(vocab)
        out.append(w)
        size += len(w) + 1
    return " ".join(out)


@pytest.fixture(scope="module")
def long_docs(spark, long_text):
    rows = [(1, long_text, "en", "s", None), (2, long_text, "en", "s", None), (3, "a short text of few words", "en", "s", None), (4, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(2).cache()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_long_texts_are_cut_whole(long_docs, long_text):
    n, words = len(long_text.encode()), len(long_text.split())
    got = by_id(suffixes.remove_repeats(long_docs))
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) for i in (1, 2, 4)] == [(n, n, 1), (n, n, 1), (0, 0, 0)] and got[3]["n_removed"] == 0
    got = by_id(automata.remove_phrases(long_docs))
    assert [(got[i]["n_words"], got[i]["n_removed"]) for i in (1, 2, 3, 4)] == [(words, 0), (words, words), (6, 0), (0, 0)]
    assert got[1]["kept_sha256"] == hashlib.sha256(long_text.encode()).hexdigest()


def test_long_texts_are_compared_whole(long_docs, long_text):
    w = long_text.split()
    got = by_id(jaccard.jaccard_components(long_docs))
    assert [(got[i]["component_id"]) for i in (1, 2, 3, 4)] == [1, 1, 3, 4] and got[1]["n_shingles"] == got[2]["n_shingles"] == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})


def test_long_texts_are_counted_and_packed_whole(long_docs, long_text):
    counts = by_id(edits.count_edited(edits.some_edits(long_docs), default_path()))
    pieces = packing.pack(long_docs, default_path()).collect()
    for i in (1, 2, 3, 4):
        assert sum(p["length"] for p in pieces if p["doc_id"] == i) == counts[i]["n_tokens"] + 1
    assert counts[1]["n_tokens"] > 1_000_000 and counts[1]["n_chars_encoded_again"] < 20_000
    leaf = by_id(merkle.verified_documents(long_docs))
    assert leaf[1]["leaf"] == hashlib.sha256(f"1:11:s2:en-{len(long_text)}:{long_text}".encode()).hexdigest()


def test_long_texts_are_scored_and_searched_whole(spark, long_docs, long_text):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 5)], "doc_id long, quality int, toxic int")
    for df in (quality.classify(long_docs, long_docs, labels), toxicity.score_toxicity(long_docs, labels), langid.identify(long_docs)):
        got = by_id(df)
        assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got.values()) and got[1]["score"] == pytest.approx(got[2]["score"])
    w = long_text.split()
    items = spark.createDataFrame([(7, " ".join(w[400_000:400_030]))], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(long_docs, items).collect()) == [(1, 7), (2, 7)]


def test_packing_holds_by_sql(spark, small):
    """No gap, no overlap, no sequence over 2048, each document's ids once and in order; the tokens are those that are counted."""
    docs = table(spark, small, "documents")
    pieces = packing.pack(docs).toArrow()  # noqa: F841  read by name
    counts = edits.count_edited(edits.some_edits(docs)).select("doc_id", "n_tokens").toArrow()  # noqa: F841
    con = duckdb.connect()
    con.register("pieces", pieces)
    con.register("counts", counts)
    bad = con.execute("""SELECT count(*) AS n FROM (SELECT "offset", length, lag("offset" + length, 1, 0) OVER (PARTITION BY sequence_id ORDER BY "offset") AS free FROM pieces) WHERE "offset" <> free OR "offset" + length > 2048""").fetchall()
    cut = con.execute("""SELECT count(*) AS n FROM (SELECT *, lag(start + length, 1, 0) OVER own AS before, row_number() OVER own - 1 AS k FROM pieces WINDOW own AS (PARTITION BY doc_id ORDER BY piece)) WHERE start <> before OR piece <> k OR (piece > 0 AND length <> 2048)""").fetchall()
    total = con.execute("SELECT count(*) AS n, sum(CAST(n <> n_tokens + 1 AS INT)) AS bad FROM (SELECT doc_id, sum(length) AS n FROM pieces GROUP BY doc_id) JOIN counts USING (doc_id)").fetchall()
    least = con.execute("SELECT count(DISTINCT sequence_id) AS n, ceil(sum(length) / 2048) AS least FROM pieces").fetchall()
    assert bad == [(0,)] and cut == [(0,)] and total == [(docs.count(), 0)] and least[0][0] <= least[0][1] + 2


def test_quality_is_fitted_by_gradient_descent(monkeypatch):
    """The table and softmax after each document's step, by loops over numbers."""
    monkeypatch.setattr(quality, "BUCKETS", 12)
    monkeypatch.setattr(quality, "DIM", 3)
    rng = np.random.default_rng(1)
    bags = []
    for i in range(15):
        rows = np.sort(rng.choice(12, rng.integers(0, 6), replace=False)).astype(np.int32)
        share = rng.random(len(rows)).astype(np.float32)
        bags.append((i % 2, rows, share / max(share.sum(), 1e-9)))
    odds, bias = quality.fit(bags, epochs=3, rate=0.5, seed=4)
    rng = np.random.default_rng(4)
    table_ = [[float(x) for x in r] for r in (rng.random((12, 3)) - 0.5) / 3]
    w, b, at, steps = [[0.0] * 3, [0.0] * 3], [0.0, 0.0], 0, 3 * len(bags)
    for _ in range(3):
        for i in rng.permutation(len(bags)).tolist():
            y, rows, share = bags[i]
            lr = 0.5 * (1 - at / steps)
            at += 1
            x = [sum(float(s) * table_[r][d] for r, s in zip(rows, share, strict=True)) for d in range(3)]
            z = [sum(w[c][d] * x[d] for d in range(3)) + b[c] for c in range(2)]
            e = [math.exp(v - max(z)) for v in z]
            miss = [e[c] / sum(e) - (c == y) for c in range(2)]
            pull = [sum(miss[c] * w[c][d] for c in range(2)) for d in range(3)]
            for c in range(2):
                for d in range(3):
                    w[c][d] -= lr * miss[c] * x[d]
                b[c] -= 0.1 * lr * miss[c]
            for r, s in zip(rows, share, strict=True):
                for d in range(3):
                    table_[r][d] -= lr * min(50 * float(s), 1) * pull[d]
    want = [sum(row[d] * (w[1][d] - w[0][d]) for d in range(3)) for row in table_]
    assert odds == pytest.approx(want, abs=1e-4) and bias == pytest.approx(b[1] - b[0], abs=1e-4) and np.abs(odds).max() > 1e-3
