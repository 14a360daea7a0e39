"""The Jaccard join, vector near-duplicates and components against brute force."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import common, jaccard, vectors


def closure(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(common.LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_jaccard(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = closure(ids, links)
    return sorted((i, len(sets[i]), comp[i]) for i in ids)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_jaccard(docs, corpus):
    assert rows_of(jaccard.jaccard_components(docs)) == brute_jaccard(corpus)


def chain(rng, n):
    """Texts that are similar to their neighbours only, and decoys."""
    w = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        out.append((i, " ".join(w)))
        w[rng.randrange(60)] = f"n{i}"
    return out


@pytest.mark.parametrize("block", [1, 700, 4000])
def test_blocks_that_are_too_large_for_a_task(spark, block):
    rows = chain(random.Random(2), 60) + [(1000 + i, " ".join(f"q{i}x{k}" for k in range(30))) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard.jaccard_components(df, block_bytes=block)) == brute_jaccard(rows)


def test_jaccard_of_clashing_columns_repeated_rows_and_nothing(spark, clashing, corpus, empty_docs):
    want = brute_jaccard(corpus)
    assert rows_of(jaccard.jaccard_components(clashing)) == want
    assert jaccard.jaccard_components(empty_docs).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y"), (3, None)], "doc_id long, text string")
    assert rows_of(jaccard.jaccard_components(twice)) == [(1, 2, 1), (1, 2, 1), (2, 1, 2), (3, 0, 3)]


def test_threshold_is_met_exactly(spark):
    # 8 of 10 shingles: 4 words more at the end give 8 / 10; 5 give 8 / 11
    w = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join(w)), (2, " ".join([*w, "a", "b"])), (3, " ".join(["z", *w, "c", "d"]))]
    assert rows_of(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_jaccard(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), max_size=12), max_size=14))
def test_prefix_tree(sets):
    ids = list(range(len(sets)))
    got = jaccard.link_sets(ids, [np.array(sorted(s), np.uint64) for s in sets])
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {i: got.find(i) for i in ids} == closure(ids, links)


def test_short_texts_are_one_shingle():
    a, b, c, d = jaccard.shingle_sets(pa.array(["one two", "ONE  two", None, "a b c d e a b c d e"]))
    assert len(a) == 1 and (a == b).all() and len(c) == 0 and len(d) == 5


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    ids = sorted({x for e in links if e[0] != e[1] for x in e})
    got = dict(rows_of(common.components(spark.createDataFrame(links, "u long, v long"))))
    assert got == closure(ids, [e for e in links if e[0] != e[1]])
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_vectors(rows, dim, cosine=0.95):
    ok = {}
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / np.abs(v).max()
            ok[i] = x / np.linalg.norm(x)
    ids = sorted(ok)
    links = [(a, b) for a in ids for b in ids if a < b and ok[a] @ ok[b] >= cosine]
    comp = closure(sorted({i for i, _ in rows}), links)
    n = {i: 0 for i in comp}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return sorted((i, n[i], comp[i], comp[i] == i) for i in comp)


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(6)
    rows = [[float(x) for x in rng.standard_normal(16)] for _ in range(150)]
    rows += [[x + 0.1 * float(rng.standard_normal()) for x in rows[i % 9]] for i in range(60)]
    rows += [rows[0]] * 20 + [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0] * 3, [1e-300] * 16, [1e300] * 16, [-1e300] * 16]
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [4096, 16])
def test_vectors(spark, vector_rows, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    df = spark.createDataFrame(vector_rows, "vec_id long, embedding array<double>")
    want = brute_vectors(vector_rows, 16)
    assert rows_of(vectors.near_vectors(df, reach=math.inf)) == want
    found, links = ({r[0]: r[1] for r in rows} for rows in (rows_of(vectors.near_vectors(df)), want))
    assert sum(found.values()) >= 0.95 * sum(links.values()) and all(found[i] <= links[i] for i in links)


@pytest.mark.parametrize("cells", [vectors.SAMPLE_CELLS, 1])
def test_vectors_of_all_lengths_copies_and_repeated_ids(spark, cells, monkeypatch):
    """Lengths 1 to 5 and 16, many copies, equal rows of one id; two different rows of an id are vectors of their own."""
    monkeypatch.setattr(vectors, "SAMPLE_CELLS", cells)
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base = [[float(x) for x in rng.standard_normal(d)] for d in (1, 2, 3, 3, 4, 5, 16, 16, 16)]
    rows = [base[int(rng.integers(len(base)))] for _ in range(150)] + [[x + 0.05 * float(rng.standard_normal()) for x in base[int(rng.integers(len(base)))]] for _ in range(60)]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = {}
    for dim in {len(v) for _, v in rows}:
        want |= {r[0]: r for r in brute_vectors([r for r in rows if len(r[1]) == dim], dim)}
    assert rows_of(vectors.near_vectors(df, reach=math.inf)) == sorted(want.values())
    again = [(7, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [0.0, 1.0]), (3, [1.0, 0.0]), (9, [0.0, 1.0]), (9, [1.0, 1.0]), (11, [2.0, 2.1])]
    got = rows_of(vectors.near_vectors(spark.createDataFrame(again, "vec_id long, embedding array<double>"), reach=math.inf))
    assert got == [(3, 2, 3, True), (7, 3, 3, False), (9, 2, 3, False), (11, 1, 3, False)]


def test_vectors_of_nothing_and_of_clashing_columns(spark):
    e = "vec_id long, embedding array<float>, label int, list int, vec string, n long, u long"
    assert vectors.near_vectors(spark.createDataFrame([], e)).count() == 0
    assert rows_of(vectors.near_vectors(spark.createDataFrame([(1, None, 0, 0, "", 0, 0), (2, [0.0, 0.0], 0, 0, "", 0, 0)], e))) == [(1, 0, 1, True), (2, 0, 2, True)]
    two = spark.createDataFrame([(5, [1.0, 0.0], 1, 1, "x", 1, 1), (3, [2.0, 0.1], 1, 1, "x", 1, 1), (3, [2.0, 0.1], 1, 1, "x", 1, 1)], e)
    assert rows_of(vectors.near_vectors(two)) == [(3, 2, 3, True), (5, 2, 3, False)]


@pytest.mark.parametrize("second", [1, 7])
def test_index_recall_is_complete(second):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 32))
    x[1500:] = x[:1500] + 0.15 * rng.standard_normal((1500, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = vectors.Index(x[:500], 40, second)
    radius = np.sqrt(2 - 2 * 0.95)
    near, d = index.nearest(x)
    probe = np.zeros((len(x), index.lists), bool)
    probe[index.probes(near, d, x, radius)] = True
    code, err = index.encode(x, near)
    i, j = np.nonzero(x @ x.T >= 0.95)
    assert probe[i, near[j]].all()
    for a in range(0, 200):
        for b in j[i == a]:
            t = index.tables(x[a : a + 1], index.centroid(near[b]))
            low = np.sqrt(sum(tt[0, code[b, k]] for k, tt in enumerate(t))) - err[b]
            assert low <= np.linalg.norm(x[a] - x[b]) + 1e-9


def test_links_count_for_both_sides(spark):
    """Pairs of vectors with an uneven spectrum that link with nothing else; some are probed from one side only."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1500, 64)) * np.arange(1, 65) ** -0.7
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal(x.shape)
    y -= (y * x).sum(1)[:, None] * x
    y = 0.955 * x + np.sqrt(1 - 0.955**2) * y / np.linalg.norm(y, axis=1)[:, None]
    z = np.vstack([x, y])
    near = (z @ z.T >= 0.95).sum(1) == 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "vec_id long, embedding array<double>").repartition(3)
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(df, reach=1.0).collect()}
    own = [i for i in range(len(x)) if near[i] and near[i + len(x)]]
    assert len(own) > 500 and all(got[i] == got[i + len(x)] for i in own) and sum(got[i] for i in own) > 0.5 * len(own)
