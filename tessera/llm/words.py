"""Hashes of words and word sequences of a whole batch of texts, without a loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import MULT, mixed

#: A multiplier's inverse modulo 2**64.
BACK = np.uint64(pow(int(MULT), -1, 1 << 64))

#: Powers that a worker keeps; those for a longer text are made for it alone.
MOST_POWERS = 5 << 19

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT**i and MULT**-i for i below n."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = (n | 0xFFFF) + 1
    made = []
    for base in (MULT, BACK):
        out = np.full(size, base, np.uint64)
        out[0] = 1
        made.append(np.cumprod(out, dtype=np.uint64, out=out))
    if size <= MOST_POWERS:
        _powers[:] = made
    return made[0], made[1]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each begins (with the end); null is empty."""
    if column.null_count:
        column = column.fill_null("")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(at):
        at = np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a batch: begin and end in bytes, document and 64-bit hash of each."""

    def __init__(self, column: pa.Array, lower: bool = False, letters: bool = False):
        """lower: A-Z to a-z. letters: words are runs of ASCII letters and bytes beyond ASCII instead."""
        body, at = raw(column)
        if lower:
            body = body + (np.uint8(32) * ((body >= 65) & (body <= 90))).astype(np.uint8)
        self.body, self.at = body, at
        n = len(body)
        if letters:
            low = body | np.uint8(32)
            blank = ~(((low >= 97) & (low <= 122)) | (body >= 128))
        else:
            blank = (body == 32) | ((body >= 9) & (body <= 13))
        word = np.zeros(n + 2, np.int8)
        word[1:-1] = ~blank
        step = np.diff(word)
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        # a word doesn't reach over a document's end
        inner = at[1:-1]
        cut = inner[(inner > 0) & (inner < n)]
        cut = np.unique(cut[word[cut] * word[cut + 1] == 1]) if len(cut) else cut
        if len(cut):
            begin, end = np.sort(np.r_[begin, cut]), np.sort(np.r_[end, cut])
        self.begin, self.end = begin, end
        self.doc = np.searchsorted(at, begin, "right") - 1
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        self.hash = mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
        count = np.bincount(self.doc, minlength=len(at) - 1)
        self.first = np.r_[0, np.cumsum(count)].astype(np.int64)  # of each document, the place of its first word

    def runs(self, n: int) -> np.ndarray:
        """The hash of the n words from each word on; those that reach over a document's end are meaningless."""
        out = np.zeros(len(self.hash), np.uint64)
        for k in range(min(n, len(out))):
            out[: len(out) - k] = out[: len(out) - k] * MULT + self.hash[k:]
        return mixed(out)

    def left(self) -> np.ndarray:
        """How many words of its document are there from each word on."""
        return self.first[self.doc + 1] - np.arange(len(self.doc))


def window_low(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive keys, for every place where as many are left."""
    out, have = keys, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
