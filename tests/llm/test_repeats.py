"""Suffix-array and phrase deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import anchors, automata, suffixes


def brute_bytes(rows, n):
    return sorted(brute_rows(rows, n))


def brute_rows(rows, n):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + n] for _, b in texts for k in range(len(b) - n + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, n):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in sorted(texts, key=lambda x: x[0]):
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("n", [400, 60])
def test_bytes(docs, corpus, n):
    assert rows_of(suffixes.remove_repeats(docs, n)) == brute_bytes(corpus, n)


@pytest.mark.parametrize(("n", "m"), [(400, 200), (90, 60), (300, 299)])
def test_two_lengths_at_once(docs, corpus, n, m, monkeypatch):
    want = [(*x, y[2]) for x, y in zip(brute_bytes(corpus, n), brute_bytes(corpus, m), strict=True)]
    assert rows_of(suffixes.remove_repeats(docs, n, m)) == want
    monkeypatch.setattr(anchors, "CROWD", 3)
    assert rows_of(suffixes.remove_repeats(docs, n, m)) == want


@pytest.mark.parametrize("seed", range(4))
def test_two_lengths_of_texts_in_many_pieces(spark, seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 60))) for _ in range(25)]
    rows = [(i if i % 7 else None, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for n, m in ((50, 20), (41, 7)):
        want = Counter((i, *x[1:], y[2]) for (i, _), x, y in zip(rows, brute_rows(rows, n), brute_rows(rows, m), strict=True))
        assert Counter(map(tuple, suffixes.remove_repeats(df, n, m).collect())) == want


@pytest.mark.parametrize("n", [13, 5])
def test_phrases(docs, corpus, n):
    assert rows_of(automata.remove_phrases(docs, n)) == brute_words(corpus, n)


def test_small_chunks_give_the_same(docs, corpus, monkeypatch):
    monkeypatch.setattr(anchors, "CHUNK", 1)
    monkeypatch.setattr(anchors, "HELD", 1)
    assert rows_of(suffixes.remove_repeats(docs)) == brute_bytes(corpus, 400)


def test_equal_rows_are_copies(spark, docs, corpus):
    twice = docs.union(docs)
    assert rows_of(suffixes.remove_repeats(twice)) == brute_bytes(corpus + corpus, 400)
    assert rows_of(automata.remove_phrases(twice)) == brute_words(corpus + corpus, 13)


def test_clashing_columns(clashing, corpus):
    assert rows_of(suffixes.remove_repeats(clashing)) == brute_bytes(corpus, 400)
    assert rows_of(automata.remove_phrases(clashing)) == brute_words(corpus, 13)
    kept = suffixes.without_repeats(clashing)
    assert kept.columns == clashing.columns
    want = {r[0]: r[1] - r[2] for r in brute_bytes(corpus, 400)}
    null = {i for i, t in corpus if t is None}
    for r in kept.collect():
        assert (r["text"] is None) == (r["doc_id"] in null)
        assert len((r["text"] or "").encode()) <= want[r["doc_id"]]
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["spans"] == "x"


def test_empty_tables(empty_docs):
    assert suffixes.remove_repeats(empty_docs).count() == 0
    assert automata.remove_phrases(empty_docs).count() == 0
    assert suffixes.without_repeats(empty_docs).count() == 0


def brute_groups(texts, n):
    """Maximal repeats by growing every repeated string until it can't grow."""
    out = set()
    places: dict = {}
    for i, t in enumerate(texts):
        for a in range(len(t)):
            for m in range(n, len(t) - a + 1):
                places.setdefault(t[a : a + m], []).append((i, a))
    for s, p in places.items():
        if len(p) < 2:
            continue
        left = {texts[i][a - 1] if a else (i, "start") for i, a in p}
        right = {texts[i][a + len(s)] if a + len(s) < len(texts[i]) else (i, a, "end") for i, a in p}
        if len(left) > 1 and len(right) > 1:
            out.add((len(s), tuple(sorted(p))))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_interval_tree_gives_all_maximal_repeats(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(1, 5))]
    texts += [texts[0], b"", b"aaaaaaa"]
    n = rng.choice([2, 3, 5, 9])
    got = {(m, tuple(p)) for m, p in suffixes.maximal_repeats(texts, n)}
    assert got == brute_groups(texts, n)


def test_interval_tree_of_nothing():
    assert suffixes.maximal_repeats([], 4) == [] and suffixes.maximal_repeats([b"", b"abc"], 4) == []


def test_groups_hold_all_occurrences_of_long_strings():
    rng = random.Random(3)
    long = bytes(rng.choice(b"abcd") for _ in range(900))
    texts = [b"1" + long + b"x", b"2" + long + b"y", b"3" + long[:600] + b"z"]
    got = suffixes.maximal_repeats(texts, 400)
    assert got == [(900, [(0, 1), (1, 1)]), (600, [(0, 1), (1, 1), (2, 1)])]


def test_crowded_anchors_and_many_places(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(anchors, "CROWD", 3)
    assert rows_of(suffixes.remove_repeats(docs)) == brute_bytes(corpus, 400)
    assert rows_of(automata.remove_phrases(docs)) == brute_words(corpus, 13)
    rng = random.Random(1)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(200))
    rows = [(i, base if i % 3 else base + f" end{i} of it") for i in range(60, 0, -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for crowd in (10**6, 3):
        monkeypatch.setattr(anchors, "CROWD", crowd)
        assert rows_of(suffixes.remove_repeats(df)) == brute_bytes(rows, 400)
        assert rows_of(automata.remove_phrases(df)) == brute_words(rows, 13)
