"""Edit-aware token counts (operator 10): segment trees over pre-tokens.

A document is a row of segments of consecutive pre-tokens, the leaves of a binary
tree whose nodes hold the characters and tokens below them. An edit goes down by
characters to the segments it touches; these, with the segment before and as much
after as it takes until a pre-token boundary of old and new text meet, are encoded
again, and the sums above them updated. All other segments keep their counts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, pieces, spread
from .tokens import default_path, encoder

#: Pre-tokens of a segment.
SEGMENT = 32


class Tree:
    """Token counts of one document under edits."""

    def __init__(self, text: str, enc):
        self.enc, self.encoded = enc, 0
        self._load(text)

    def _load(self, text: str) -> None:
        words = self.enc.split(text)
        segments = [words[a : a + SEGMENT] for a in range(0, len(words), SEGMENT)]
        self.parts = ["".join(x) for x in segments]
        self._build([self._tokens(x) for x in segments])

    def _tokens(self, words: list[str]) -> int:
        return sum(map(len, map(self.enc.pieces.__getitem__, words))) // 4

    def _build(self, counts: list[int]) -> None:
        n = max(1, len(self.parts))
        self.size = 1 << (n - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (p, c) in enumerate(zip(self.parts, counts, strict=True)):
            self.chars[self.size + i], self.tokens[self.size + i] = len(p), c
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.parts)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The segment that holds character `at`, and how far into it; the last one for the end."""
        i = 1
        if at >= self.chars[1]:
            last = max(0, len(self.parts) - 1)
            return last, len(self.parts[last]) if self.parts else 0
        while i < self.size:
            i *= 2
            if at >= self.chars[i]:
                at -= self.chars[i]
                i += 1
        return i - self.size, at

    def _set(self, leaf: int, part: str, count: int) -> None:
        self.parts[leaf] = part
        i = self.size + leaf
        dc, dt = len(part) - self.chars[i], count - self.tokens[i]
        while i:
            self.chars[i] += dc
            self.tokens[i] += dt
            i //= 2

    def edit(self, at: int, cut: int, new: str) -> None:
        """Replaces `cut` characters from `at` on by new."""
        at = max(0, min(at, self.length))
        cut = max(0, min(cut, self.length - at))
        if not self.parts:
            self.encoded += len(new)
            self._load(new)
            return
        first, inner = self._leaf(at)
        b, _ = self._leaf(at + cut)
        a = first
        # what is before a segment with a character that isn't blank is split as it was, if no added token can reach it
        head = inner
        while a > 0 and (a == first or not self.parts[a].strip() or head < self.enc.reach):
            a -= 1
            head += len(self.parts[a])
        while True:
            old, rest, c = "".join(self.parts[a : b + 1]), "", b + 1
            while c < len(self.parts) and (not rest.strip() or len(rest) < self.enc.reach):
                rest += self.parts[c]
                c += 1
            text = old[:head] + new + old[head + cut :]
            words = self.enc.split(text + rest)
            end = k = 0
            while end < len(text):
                end += len(words[k])
                k += 1
            if end == len(text):  # from here on all is split as it was
                break
            b += 1
        self.encoded += len(text)
        # the words go back to the same segments
        share = max(1, -(-k // (b - a + 1)))
        for j in range(a, b + 1):
            seg = words[(j - a) * share : min(k, (j - a + 1) * share)]
            self._set(j, "".join(seg), self._tokens(seg))


def _counts(path: str):
    def run(batches):
        enc = encoder(path)
        for b in pieces(batches):
            before, after, done, chars = [], [], [], []
            for text, edits in zip(b.column("text").to_pylist(), b.column("edits").to_pylist(), strict=True):
                t = Tree(text or "", enc)
                before.append(t.count)
                for e in edits or []:
                    t.edit(e["at"], e["cut"], e["new"] or "")
                after.append(t.count), done.append(t.encoded), chars.append(t.length)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(before, pa.int64()), pa.array(after, pa.int64()), pa.array(chars, pa.int64()), pa.array(done, pa.int64())], names=["doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_encoded_again"])

    return run


EDITS = "array<struct<at: long, cut: long, new: string>>"


def count_edited(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Token counts before and after edits of docs (doc_id, text, edits).

    edits: an array of (at, cut, new), applied in order: from character `at` on,
    `cut` characters are replaced by `new`; places beyond the end are the end.
    Null texts are empty, null edits none; repeated rows are counted row by row. A
    text of any script and length has segments; only those that an edit touches, with
    boundary context, are encoded again (n_chars_encoded_again). An empty table gives
    no rows; other columns are ignored.
    """
    importable(docs.sparkSession)
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("edits").cast(EDITS).alias("edits")))
    return rows.mapInArrow(_counts(tokenizer_path or default_path()), "doc_id long, n_tokens long, n_tokens_edited long, n_chars_edited long, n_chars_encoded_again long")


def some_edits(docs: DataFrame) -> DataFrame:
    """docs with three edits each that follow from doc_id and length: a word replaced near a third, a sentence put in at two thirds, ten characters cut at the end of the first quarter.

    A null or empty text is edited at its start; without a doc_id the new words are
    null, so that these two edits put nothing in. Columns keep their names, but that
    one called edits is replaced.
    """
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")

    def edit(at, cut, new):
        return F.struct(at.cast("long").alias("at"), F.lit(cut).cast("long").alias("cut"), new.alias("new"))

    tag = F.pmod(F.col("doc_id").cast("long"), F.lit(997)).cast("string")
    return docs.withColumn("edits", F.array(edit(F.floor(n / 3), 6, F.concat(F.lit(" edit"), tag)), edit(F.floor(2 * n / 3), 0, F.concat(F.lit(" One more line, number "), tag, F.lit(".\n"))), edit(F.floor(n / 4), 10, F.lit(""))))
