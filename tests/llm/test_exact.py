"""Manifest, hard negatives and top products against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bitslices, integers, merkle, radix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "vec_id long, embedding array<double>, label int, v array<int>, w int, q int, n long, rank int, score double, dim int, digit string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(leaves):
    """The levels of a tree."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha("".join(x[i : i + 3])) for i in range(0, len(x), 3)])
    return levels


def path_of(levels, i):
    for x in levels[:-1]:
        a = i // 3 * 3
        yield "".join(x[a:i]), "".join(x[i + 1 : a + 3])
        i //= 3


def expected(rows):
    """Of rows (doc_id, text, lang, source, n_chars) the rows of verified_documents."""
    made = [(r[3], r[0], leaf_of((r[0], r[3], r[2], r[4], r[1])), r) for r in rows]
    made.sort(key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1] is not None, x[1] or 0, x[2]))
    sources = list(dict.fromkeys(x[0] for x in made))
    trees = {s: tree_of([x[2] for x in made if x[0] == s]) for s in sources}
    top = tree_of([trees[s][-1][0] for s in sources])
    place, out = dict.fromkeys(sources, 0), []
    for s, i, leaf, r in made:
        path = [*path_of(trees[s], place[s]), *path_of(top, sources.index(s))]
        place[s] += 1
        node = leaf
        if i is not None and r[1] is not None and zlib.crc32(str(i).encode()) % 2 == 0:
            node = leaf_of((i, s, r[2], r[4], r[1].replace("\n", "")))
        for a, b in path:
            node = sha(a + node + b)
        out.append((i, leaf, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def documents(rng, n):
    """Sources of very different sizes and without a name, repeated rows and ids, nulls in all columns."""
    rows = [(i, f"text {i}\nline" if i % 3 else f"no feed {i} é", "en" if i % 4 else None, rng.choice(["hot"] * 5 + ["a", "b", "é", None]), i % 50 if i % 5 else None) for i in range(n)]
    rows += [rows[3], rows[3], rows[5], (7, "other", None, "hot", None), (None, "x\ny", "en", "hot", 1), (None, None, None, None, None), (None, None, None, None, None), (n + 1, None, "en", "b", 0), (n + 2, "", "en", "b", 0), (n + 3, "\n" * 9, "en", "alone", 0), (n + 4, "word\n" * 300_000, "en", "hot", 0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [0, 300])
def test_manifest(spark, n):
    rows = documents(random.Random(n), n) if n else []
    got = [tuple(r) for r in merkle.verified_documents(spark.createDataFrame(rows, DOCS).repartition(5)).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)
    if n:
        assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 4, 9])
def test_manifest_of_one_source(spark, n):
    rows = [(i, f"a\n{i}", "en", "s", i) for i in range(n)]
    got = [tuple(r) for r in merkle.verified_documents(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got) == sorted(expected(rows))


def test_manifest_of_clashing_columns(spark, clashing, corpus):
    kept = clashing.withColumns({c: clashing["k"] for c in ("tree", "at", "run", "row", "nodes", "part", "digest", "leaf", "root", "__order")})
    rows = [(i, t, "en", "s", 1) for i, t in corpus]
    assert sorted(map(tuple, merkle.verified_documents(kept).collect())) == sorted(expected(rows))


def test_nodes_are_stored_by_level(spark):
    rows = [(i, "t", "en", "abc"[i % 3], 1) for i in range(30)]
    m = merkle.manifest(spark.createDataFrame(rows, DOCS), merkle.DOCUMENT, "source", "doc_id")
    assert m.heights == (3, 1)
    levels = [merkle._level(spark, m.trees, k, m.row).collect() for k in range(4)]
    assert [sum(len(r["nodes"]) for r in x) for x in levels] == [30, 12, 6, 3]
    assert all(len({x["at"] // 3 for x in r["nodes"]}) == 1 and r["run"] == r["nodes"][0]["at"] // 3 for x in levels for r in x)
    assert merkle.root_of(m).first()["root"] == expected(rows)[0][3]


# vectors


def whole(v, scale):
    return [math.floor(scale * float(x)) for x in v]


def fit(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def vectors(rng, n, dim=16, copies=60):
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(dim)], rng.choice([0, 1, 1, 1, 2])) for i in range(n)]
    rows += [(n + i, rows[0][1], i % 3) for i in range(copies)]  # one common vector
    rows += [(100, rows[100][1], rows[100][2])] if n > 100 else []  # a repeated query
    rows += [rows[5], (None, rows[1][1], 1), (n + 1000, None, 1), (n + 1001, [float("nan")] * dim, 1), (n + 1002, [None] * dim, 0), (n + 1003, [math.inf] * dim, 0), (n + 1004, [0.0] * dim, None), (n + 1005, [0.0] * dim, 1), (n + 1006, [1.0] * 3, 1), (n + 1100 - n % 100, [0.5] * 3, 0), (n + 1200 - n % 100, [], 0), (n + 1201, [], 1)]
    rng.shuffle(rows)
    return rows


def brute_top(rows, k=10, scale=1024):
    rows = [(i, whole(v, scale)) for i, v, _ in rows if i is not None and fit(v)]
    out = []
    for q in {(i, tuple(v)) for i, v in rows if i % 100 == 0}:
        near = sorted((-dot(q[1], v), i) for i, v in rows if i != q[0] and len(v) == len(q[1]))[:k]
        out += [(q[0], r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("block", "bits", "weight_bits"), [(16_384, 7, 6), (100, 3, 2), (64, 20, 20)])
def test_top_products(spark, block, bits, weight_bits):
    rows = vectors(random.Random(4), 520)
    got = bitslices.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3), block=block, bits=bits, weight_bits=weight_bits)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)


def test_top_products_in_passes_and_of_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(integers, "MOST_QUERIES", 2)
    rows = vectors(random.Random(5), 450, 5)
    clash = spark.createDataFrame([(i, v, c, [1], 1, 1, 1, 1, 0.5, 3, "d") for i, v, c in rows], CLASHING)
    assert sorted(map(tuple, bitslices.top_products(clash, 3).collect())) == brute_top(rows, 3)
    assert sorted(map(tuple, radix.hard_negatives(clash).collect())) == brute_negatives(rows)


def test_vectors_of_nothing(spark):
    for rows in ([], [(0, None, 1)], [(0, [1.0], 1)], [(1, [1.0], 1), (2, [1.0], 2)]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        assert bitslices.top_products(df).collect() == [] and radix.hard_negatives(df).collect() == []


def test_huge_components(spark):
    rows = [(0, [1e12, -3.0]), (1, [1e12, 2.0]), (2, [-1e12, 2.0]), (3, [5e11, 1.0]), (4, [1e300, 0.0])]
    got = [tuple(r) for r in bitslices.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert [r[2] for r in sorted(got)] == [1, 3, 4, 2] and max(r[3] for r in got) == integers.SCORE_MAX


def brute_negatives(rows, k=5, positives=5, scale=256):
    rows = [(i, whole(v, scale), c) for i, v, c in rows if i is not None and c is not None and fit(v)]
    out = []
    for a in {(i, tuple(v), c) for i, v, c in rows if i % 100 == 0}:
        near = sorted((-dot(a[1], v), i, c) for i, v, c in rows if i != a[0] and len(v) == len(a[1]))
        for s, p, _ in [x for x in near if x[2] == a[2]][:positives]:
            hard = [(i, -t) for t, i, c in near if c != a[2] and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a[0], p, r + 1, i, -s, t) for r, (i, t) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize(("digit", "scores"), [(8, 1 << 20), (3, 500)])
def test_hard_negatives(spark, monkeypatch, digit, scores):
    monkeypatch.setattr(radix, "DIGIT", digit)
    monkeypatch.setattr(radix, "SCORES", scores)
    rows = vectors(random.Random(6), 620, 8, 200)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    want = brute_negatives(rows)
    assert len(want) > 60 and sorted(map(tuple, radix.hard_negatives(df).collect())) == want


def test_windows_of_few_rows_and_of_ties(spark):
    rows = [(0, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (8, [0.9, 0.0], 2), *[(i, [0.95, 0.0], 2) for i in range(60, 20, -1)], (5, [2.0, 0.0], 2), (200, [-1.0, 0.0], 1)]
    got = sorted(map(tuple, radix.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()))
    assert got == brute_negatives(rows) and [r[3] for r in got if r[:2] == (0, 7)] == [21, 22, 23, 24, 25]


@settings(max_examples=100, deadline=None)
@given(st.integers(-5000, 5000))
def test_signed_digits(c):
    d = bitslices.signed_digits(c)
    assert sum(-(1 << p) if m else 1 << p for p, m in d) == c
    assert all(b - a > 1 for (a, _), (b, _) in zip(d, d[1:], strict=False))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=200), st.integers(1, 12), st.integers(-5, 1100), st.integers(1, 7))
def test_sums_are_selected_from_the_top_slice_down(values, k, least, bits):
    """Rows of one attribute, added to itself twice and once more shifted: 4 times the value."""
    v = np.array(values)[:, None]
    shift, low, high, slices = bitslices.slices_of(v, bits)
    own = slices[0]
    columns = {}
    for place in (0, 0, 1):
        for b in range(bits):
            columns.setdefault(place + b, []).append(own[b])
    total = bitslices.added(columns, slices.shape[2])
    want = 4 * ((v[:, 0] - v.min()) >> shift)
    bit = lambda x: np.unpackbits(x.view(np.uint8), bitorder="little")[: len(v)]
    assert (sum(bit(s).astype(int) << i for i, s in enumerate(total)) == want).all() and int(low[0]) == v.min() and int(high[0]) == v.max()
    rows = np.zeros(slices.shape[2] * 64, np.uint8)
    rows[: len(v)] = 1
    rows = np.packbits(rows, bitorder="little").view(np.uint64)
    assert bitslices.kth_value(total, rows, k) == (sorted(want)[-k] if k <= len(want) else 0)
    assert (bit(bitslices.at_least(total, rows, least)) == (want >= least)).all()


def test_scores_are_within_their_bounds():
    rng = np.random.default_rng(3)
    v = rng.integers(-600, 700, (300, 12))
    for bits, weight_bits in ((7, 6), (2, 2), (12, 12)):
        batch = next(iter(bitslices._index(bits, 10**6)([pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(v.tolist(), pa.list_(pa.int64()))], names=["vec_id", "v"])])))
        block = bitslices.Block(*batch.to_pylist()[0].values())
        for w in rng.integers(-500, 500, (5, 12)):
            q = bitslices.Query(w, weight_bits)
            scale, base, least, most = q.bounds(block.low, block.high, block.shift, bits)
            a = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:300].astype(int) << i for i, s in enumerate(block.sums(q)))
            rest = v @ w - base - scale * a
            assert least <= rest.min() and rest.max() <= most
