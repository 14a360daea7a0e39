import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use for their own.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, rid long, spans string, label int, score double, h long, component string, low string, held_out string, k int, bin long"


def words(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text): prose, exact and near copies, shared passages, repeats within a text, odd white space, null, empty and short texts."""
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    rows, passage = [], words(rng, 70, vocab)
    base = [words(rng, rng.randrange(5, 400), vocab) for _ in range(60)]
    texts = list(base)
    texts += base[:6] + [base[0]] * 4
    for i in range(12):  # near copies
        w = base[10 + i % 4].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [f"{words(rng, 40, vocab)} {passage} {words(rng, 30, vocab)}" for _ in range(7)]
    line = words(rng, 12, vocab)
    texts += ["\n".join([line] * 80), "ab" * 700, "x" * 900, words(rng, 9000, vocab)]
    texts += [None, "", "  \t\n", "one", "one", "One two", "one two three four", "a b c d e", "A b c d e", "é à ü ß " * 200, "日本語 テキスト " * 150, base[3].replace(" ", "\t", 5), base[4].upper()]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in corpus], DOCS).repartition(5)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "s", 1, 1, "x", 0, 0.5, 2, "c", "l", "h", 3, 4) for i, t in corpus], CLASH)
