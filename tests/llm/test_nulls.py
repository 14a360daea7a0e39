"""Rows without an id, and tables where all is null."""

import pytest

from tessera.llm import automata, decontamination, edits, jaccard, langid, packing, quality, suffixes, toxicity, vectors
from tessera.llm.tokens import default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(120))
ROWS = [(1, LONG, "en", None, None), (None, LONG, None, None, None), (None, "a b c d e f", None, None, None), (2, None, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")


def by_size(df, size, *cols):
    return sorted((r[size], *(r[c] for c in cols)) for r in df.collect())


def test_rows_without_an_id_have_bytes_but_are_no_documents(rows):
    n = len(LONG.encode())
    assert by_size(suffixes.remove_repeats(rows), "n_bytes", "n_removed") == [(0, 0), (0, 0), (11, 0), (n, n), (n, n)]
    assert by_size(automata.remove_phrases(rows), "n_words", "n_removed") == [(0, 0), (0, 0), (6, 0), (120, 0), (120, 0)]
    assert suffixes.without_repeats(rows).count() == 5


def test_rows_without_an_id_link_with_nothing(rows, spark):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(rows).collect()}
    assert got == {(1, 116, 1), (None, 116, None), (None, 2, None), (2, 0, 2), (None, 0, None)}
    v = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.01])], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in vectors.near_vectors(v).collect()} == {(None, 0, None, True), (3, 1, 3, True), (4, 1, 3, False)}


def test_all_rows_are_packed_counted_and_scored(rows, labels, spark):
    assert packing.pack(rows).count() == 5 and edits.count_edited(edits.some_edits(rows), default_path()).count() == 5
    for df in (quality.classify(rows, rows, labels), toxicity.score_toxicity(rows, labels), langid.identify(rows)):
        got = df.collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    items = spark.createDataFrame([(7, LONG), (None, LONG)], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in decontamination.find_leaks(rows, items).collect()) == [(0, 7), (1, 7)]


def test_toxic_labels_of_held_out_rows_only(spark):
    import zlib

    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, "some idiot text", "en", None, None) for i in held], SCHEMA)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    assert len({r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}) == 1
