"""Packing and edit-aware counts against the tokenizer itself."""

import array
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import edits, packing, tokens

PATH = tokens.default_path()


@pytest.fixture(scope="module")
def enc():
    return tokens.Encoder(PATH)


def truth(enc, text):
    return enc.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 'sltrevd1²½\n\t\x1c\x85\xa0.-_é日ɐ́<|>")), max_size=40))
def test_cached_ids_are_the_tokenizers(text):
    e = tokens.encoder(PATH)
    assert e.encode(text) == array.array("I", truth(e, text)).tobytes() and e.count(text) == len(truth(e, text))


SPECIAL = st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "<", "|", ">", " ", "  ", "\n", "a", "word", "é", "д", "<|endoftext|", "1", "'s"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(SPECIAL)
def test_added_tokens_have_their_ids(text):
    e = tokens.encoder(PATH)
    assert "".join(e.split(text)) == text and e.encode(text) == array.array("I", truth(e, text)).tobytes()


def test_an_added_token_at_starts_ends_and_in_words(enc):
    for text in ("x <|endoftext|> y", "<|endoftext|>", "<|endoftext|><|endoftext|>", "ab<|endoftext|>cd", " <|endoftext|>", "a \n<|endoftext|>\n b"):
        assert 50256 in truth(enc, text) and enc.encode(text) == array.array("I", truth(enc, text)).tobytes()
    assert 50256 not in truth(enc, "<|endoftext |>")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(SPECIAL, st.sampled_from(["", "and more words " * 9])), max_size=8), st.lists(st.tuples(st.integers(0, 600), st.integers(0, 30), SPECIAL), max_size=8))
def test_edits_make_and_break_added_tokens(parts, changes):
    e, text = tokens.encoder(PATH), "".join(a + b for a, b in parts)
    t = edits.Tree(text, e)
    for at, cut, new in changes:
        t.edit(at, cut, new)
        text = apply(text, [(at, cut, new)])
        assert t.text() == text and t.count == len(truth(e, text))


def test_packing_and_counts_of_added_tokens(spark, enc):
    rows = [(i, t) for i, t in enumerate(["x <|endoftext|> y", "<|endoftext|>" * 3000, "plain", None, "a<|endoftext|>"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_packing(packing.pack(df, PATH).collect(), rows, enc, 2048)
    got = {r["doc_id"]: r["n_tokens"] for r in edits.count_edited(edits.some_edits(df), PATH).collect()}
    assert got == {i: len(truth(enc, t)) for i, t in rows}


def test_cache_starts_anew(enc, monkeypatch):
    monkeypatch.setattr(tokens, "KEEP", 3)
    assert enc.encode("one two three four five six") == array.array("I", truth(enc, "one two three four five six")).tobytes()


def check_packing(rows, corpus, enc, room):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_doc) == sorted(i for i, _ in corpus)
    for i, t in corpus:
        ids = [*truth(enc, t), 0]
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        at = 0
        for k, p in enumerate(pieces):
            part = np.array(ids[at : at + p["length"]], "<u4").tobytes()
            assert (p["piece"], p["start"], p["ids_crc32"]) == (k, at, zlib.crc32(part)) and p["length"] > 0
            if k:
                assert p["length"] == room
            at += p["length"]
        assert at == len(ids)
        if len(ids) <= room:
            assert len(pieces) == 1
    for group in by_seq.values():
        at = 0
        for r in sorted(group, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= room
    return len(by_seq)


@pytest.mark.parametrize("room", [2048, 64])
def test_packing(docs, corpus, enc, room):
    rows = packing.pack(docs, PATH, room).collect()
    n = check_packing(rows, corpus, enc, room)
    total = sum(r["length"] for r in rows)
    assert n <= -(-total // room) * 1.15 + 2


def test_packing_over_many_partitions_and_rounds(docs, corpus, enc):
    rows = packing.pack(docs.repartition(20), PATH, 256, fan_in=3).collect()
    n = check_packing(rows, corpus, enc, 256)
    alone = packing.pack(docs.coalesce(1), PATH, 256).collect()
    assert n <= len({r["sequence_id"] for r in alone}) + 6


def test_bins_that_no_task_can_hold_are_merged_all_the_same(docs, corpus, enc, monkeypatch):
    n = check_packing(packing.pack(docs.repartition(7), PATH, 256).collect(), corpus, enc, 256)
    monkeypatch.setattr(packing, "GROUP_MOST", 0)
    assert abs(check_packing(packing.pack(docs.repartition(7), PATH, 256).collect(), corpus, enc, 256) - n) <= 1
    monkeypatch.setattr(packing, "GROUP_MOST", 20)
    assert abs(check_packing(packing.pack(docs.repartition(9), PATH, 256, fan_in=2).collect(), corpus, enc, 256) - n) <= 2


@given(st.lists(st.integers(1, 50), max_size=120))
@settings(max_examples=200, deadline=None)
def test_best_fit_of_counts_is_that_of_items(sizes):
    counts = {n: sizes.count(n) for n in set(sizes)}
    bins, ranks = {}, {n: [] for n in counts}
    for size, first, m, number, off in packing.best_fit_counts(counts, 50):
        ranks[size].extend(range(first, first + m))
        for i in range(m):
            bins.setdefault(number + i, []).append((off, size))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for own in bins.values():
        at = 0
        for off, size in sorted(own):
            assert off == at
            at += size
        assert at <= 50
    fills = packing.best_fit(np.array(sizes, np.int64), 50)[2]
    assert sorted(sum(s for _, s in own) for own in bins.values()) == sorted(fills.tolist())


def test_packing_of_clashing_columns_and_nothing(clashing, corpus, enc, empty_docs):
    check_packing(packing.pack(clashing, PATH).collect(), corpus, enc, 2048)
    assert packing.pack(empty_docs, PATH).count() == 0


@given(st.lists(st.integers(1, 50), max_size=80))
@settings(max_examples=60, deadline=None)
def test_best_fit_fills_bins(sizes):
    s = np.array(sizes, np.int64)
    b, o, f = packing.best_fit(s, 50)
    for k in range(len(f)):
        own = sorted(zip(o[b == k], s[b == k], strict=True))
        at = 0
        for x, n in own:
            assert x == at
            at += n
        assert at == f[k] <= 50
    assert sum(f <= 25) <= 1  # two half-empty bins would have been one


def apply(text, changes):
    for at, cut, new in changes:
        at = min(at, len(text))
        text = text[:at] + new + text[at + cut :]
    return text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 's1\n.-é")), max_size=400), st.lists(st.tuples(st.integers(0, 420), st.integers(0, 30), st.text(alphabet=st.sampled_from(list("ab \n'1é½")), max_size=40)), max_size=6))
def test_edited_counts(text, changes):
    e = tokens.encoder(PATH)
    t = edits.Tree(text, e)
    assert t.count == len(truth(e, text))
    for at, cut, new in changes:
        t.edit(at, cut, new)
    want = apply(text, changes)
    assert t.text() == want and t.count == len(truth(e, want)) and t.length == len(want)


def test_edits_encode_little_again(enc):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(20_000))
    t = edits.Tree(text, enc)
    t.edit(70_000, 3, "xyz")
    assert t.encoded < 2000 and t.count == len(truth(enc, t.text()))


SIGNS = list("ab 's1\n.-é") + list("\u201c\u2019\u2014дЖλ日本語テअनしい한글ا\u0301²½\x1c\x85\xa0\u2028\U0001f600\U00020000")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(SIGNS), max_size=600), st.lists(st.tuples(st.integers(0, 620), st.integers(0, 40), st.text(alphabet=st.sampled_from(SIGNS), max_size=40)), max_size=6))
def test_edited_counts_of_all_scripts(text, changes):
    e = tokens.encoder(PATH)
    t = edits.Tree(text, e)
    for at, cut, new in changes:
        t.edit(at, cut, new)
    want = apply(text, changes)
    assert t.text() == want and t.count == len(truth(e, want)) and t.length == len(want)


@pytest.mark.parametrize("sign", ["\u2019", "\u2014", "д", "日本"])
def test_a_sign_of_another_script_leaves_the_segments(enc, sign):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(500))
    text = text[:900] + sign + text[900:]
    t = edits.Tree(text, enc)
    t.edit(1800, 3, "xyz" + sign)
    assert len(t.parts) > 10 and t.encoded < 0.15 * len(text) + 300 and t.count == len(truth(enc, t.text()))


def test_counts_of_a_table(docs, corpus, enc, clashing, empty_docs):
    got = {r["doc_id"]: r for r in edits.count_edited(edits.some_edits(docs), PATH).collect()}
    for i, t in corpus:
        t = t or ""
        n, tag = len(t), i % 997
        want = apply(t, [(n // 3, 6, f" edit{tag}"), (2 * n // 3, 0, f" One more line, number {tag}.\n"), (n // 4, 10, "")])
        assert (got[i]["n_tokens"], got[i]["n_tokens_edited"], got[i]["n_chars_edited"]) == (len(truth(enc, t)), len(truth(enc, want)), len(want))
    plain = clashing.withColumn("edits", F.lit(None).cast(edits.EDITS))
    assert all(r["n_tokens"] == r["n_tokens_edited"] == got[r["doc_id"]]["n_tokens"] for r in edits.count_edited(plain, PATH).collect())
    assert edits.count_edited(edits.some_edits(empty_docs), PATH).count() == 0
