"""Substring deduplication (operator 4): repeated-phrase automata.

Windows of 13 words that recur in another document are confirmed in the groups of
their anchors (see anchors). Each chunk of groups is a shard: its recurring
passages, runs of such windows that first start in the same document, are compiled
into an Aho-Corasick automaton over word numbers, through which all contexts of
the shard are streamed to locate every occurrence of every passage.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .anchors import anchor_runs, covered, keyed, spans_of
from .common import mixed, pieces
from .words import Words, powers, window_low

WINDOW = 13
GRAM = 4


class _View:
    """Words of a batch and its text with one blank after each word."""

    def __init__(self, column):
        w = self.words = Words(column)
        self.first = w.first[:-1]
        size = w.end - w.begin
        self.end = np.cumsum(size + 1) - 1
        self.begin = self.end - size
        out = np.full(int(self.end[-1]) + 1 if len(size) else 0, 32, np.uint8)
        if len(size):
            out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = w.body[np.arange(int(size.sum())) + np.repeat(w.begin - np.r_[0, np.cumsum(size)[:-1]], size)]
        self.text = out


class Phrases:
    """Windows of `window` words, anchored by grams of words."""

    at_once = False

    def __init__(self, window: int = WINDOW, gram: int | None = None):
        self.window, self.gram = window, gram or min(GRAM, window)

    def view(self, column):
        return _View(column)

    def runs(self, view):
        w, g = view.words, self.gram
        keys = w.runs(g)
        size = np.diff(w.first)
        doc, first, length, h = anchor_runs(keys, self.window - g + 1, view.first, np.maximum(0, size - self.window + 1), window_low)
        up, down = powers(len(w.hash) + 1)
        sums = np.zeros(len(w.hash) + 1, np.uint64)
        np.cumsum(w.hash * up[: len(w.hash)], out=sums[1:])
        return doc, first, length, h, mixed((sums[first + length - 1 + self.window] - sums[first]) * down[first])

    def cut(self, view, doc, lo, n, last):
        """The text of the windows lo to lo + n - 1; what follows up to window `last` isn't asked for."""
        a = view.first[doc] + lo
        return view.text[view.begin[a] : view.end[a + n - 2 + self.window]].tobytes()

    def single(self, view, doc, lo, n, last):
        """Each of the windows, in the group of its hash."""
        for x in range(lo, lo + n):
            body = self.cut(view, doc, x, 1, last)
            yield xxhash.xxh64_intdigest(body, seed=1) - (1 << 63), 1, x, body

    def solve(self, groups):
        """For each context the spans of words that a passage covers, with the first document that has the passage."""
        none = (np.zeros(0, np.int64),) * 3
        out = [none] * sum(map(len, groups))
        which, k = [], 0
        for g in groups:
            which.extend(k + i for i, c in enumerate(g) if len(g) > 1 or len(c.places) > 1)
            k += len(g)
        every = [c for g in groups for c in g]
        ctx = [every[i] for i in which]
        if not ctx:
            return out
        w = Words(pa.array([c.body for c in ctx], pa.large_binary()))
        first = w.first
        # windows: of each context those that its run has
        count = np.array([c.n for c in ctx], np.int64)
        of = np.repeat(np.arange(len(ctx)), count)
        inner = np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
        low = np.array([c.places[:, 1].min() for c in ctx])
        high = np.array([c.places[:, 1].max() for c in ctx])
        key = w.runs(self.window)[first[of] + inner]
        o = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.r_[True, key[o][1:] != key[o][:-1]])
        length = np.diff(np.r_[at, len(o)])
        earliest, latest = np.minimum.reduceat(low[of][o], at), np.maximum.reduceat(high[of][o], at)
        when, recurs = np.empty(len(o), np.int64), np.empty(len(o), bool)
        when[o], recurs[o] = np.repeat(earliest, length), np.repeat(earliest < latest, length)
        # passages: runs of recurring windows of a context with one earliest document
        new = np.r_[True, (of[1:] != of[:-1]) | (when[1:] != when[:-1]) | (recurs[1:] != recurs[:-1])]
        a = np.flatnonzero(new)
        b = np.r_[a[1:], len(of)]
        a, b = a[recurs[a]], b[recurs[a]]
        if not len(a):
            return out
        # words as numbers
        ids = np.unique(w.hash, return_inverse=True)[1].tolist()
        begin = (first[of[a]] + inner[a]).tolist()
        passages: dict[tuple, int] = {}
        for s, n, d in zip(begin, (b - a - 1 + self.window).tolist(), when[a].tolist(), strict=True):
            p = tuple(ids[s : s + n])
            if passages.get(p, d) >= d:
                passages[p] = d
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for p, d in passages.items():
            machine.add_word(p, (len(p), d))
        machine.make_automaton()
        # a context without a recurring window holds no passage
        hits: list[tuple[int, int, int]] = []
        some = np.unique(of[a])
        for i in some.tolist():
            x = int(first[i])
            hits.extend((d, x + end - n + 1, x + end + 1) for end, (n, d) in machine.iter(tuple(ids[x : int(first[i + 1])])))
        since = np.full(len(w.hash), np.iinfo(np.int64).max, np.int64)
        hits.sort(reverse=True)  # the earliest document comes last and stays
        for d, x, y in hits:
            since[x:y] = d
        # stretches of words with one first document
        never = np.iinfo(np.int64).max
        owner = np.repeat(np.arange(len(ctx)), np.diff(first))
        edge = np.flatnonzero(np.r_[True, (since[1:] != since[:-1]) | (owner[1:] != owner[:-1])])
        stop = np.r_[edge[1:], len(since)]
        on = since[edge] < never
        edge, stop = edge[on], stop[on]
        cut = np.searchsorted(owner[edge], np.arange(len(ctx) + 1))
        base = first[owner[edge]]
        for i in some.tolist():
            x, y = cut[i], cut[i + 1]
            out[which[i]] = (edge[x:y] - base[x:y], stop[x:y] - base[x:y], since[edge[x:y]])
        return out


def _finish(batches):
    for b in pieces(batches):
        view = _View(b.column("text"))
        size = np.diff(view.words.first)
        removed, sha = [], []
        for i, (a, z) in enumerate(spans_of(b.column("spans"))):
            base, n = int(view.words.first[i]), int(size[i])
            keep_a, keep_z = np.r_[0, z], np.r_[a, n]
            parts = [view.text[view.begin[base + p] : view.end[base + q - 1]].tobytes() for p, q in zip(keep_a.tolist(), keep_z.tolist(), strict=True) if q > p]
            removed.append(int((z - a).sum()))
            sha.append(hashlib.sha256(b" ".join(parts)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_phrases(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """What is left of each document: doc_id, n_words, n_removed, kept_sha256.

    Each word covered by a window of `window` words that also starts in a document
    with a smaller doc_id is removed. Null and empty texts have no words. Rows
    with one doc_id count as one document, so none is earlier than another; a row
    without one is neither earlier nor later than any and keeps all its words. A
    text of any length is read whole. An empty table gives no rows; other columns
    are ignored.
    """
    return covered(keyed(docs), Phrases(window), by_doc=True).select("doc_id", "text", "spans").mapInArrow(_finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
