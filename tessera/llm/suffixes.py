"""Suffix-array deduplication (operator 3): maximal repeats from a common-prefix interval tree.

An enhanced suffix array (order and common-prefix lengths) is scanned with a
stack. Every interval of suffixes whose common prefix has at least min_len bytes
and whose left neighbours differ is a maximal repeat group; its occurrences are all
suffixes of the interval, not only adjacent ones. On the cluster the texts are the
contexts of one anchor chunk (see anchors), whose windows are min_len bytes long.
Covered bytes can be told for several lengths at once: windows have the least, a
context reaches as far as the greatest, and each maximal repeat counts for all
lengths up to its own. The spans of length number k are shifted by k * LEVEL.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .anchors import DIGEST, anchor_runs, covered, keyed, spans_of
from .common import mixed, pieces, spans_union
from .words import powers, raw, window_low

MIN_LEN = 400
#: Bytes of a repeated passage of some 40 words or more, which op3 tells as well and the pipeline cuts.
PASSAGE = 200
#: By how much the spans of each further length are shifted.
LEVEL = 1 << 40
#: Since before all documents.
ALWAYS = np.iinfo(np.int64).min
GRAM = 32


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in a row; where each begins, and its size."""
    size = np.array([len(t) for t in texts], np.int64)
    return (np.concatenate(texts) if texts else np.zeros(0, np.uint8)), np.r_[0, np.cumsum(size)[:-1]].astype(np.int64) if len(texts) else size, size


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int = 64) -> np.ndarray:
    """How many bytes from a and from b on are equal, pair by pair, up to most."""
    got, todo, n = np.zeros(len(a), np.int64), np.flatnonzero(most > 0), len(text)
    while len(todo):
        for part in np.array_split(todo, -(-len(todo) // 20_000)):
            at = got[part][:, None] + np.arange(step)
            off = (text[np.minimum(a[part][:, None] + at, n - 1)] != text[np.minimum(b[part][:, None] + at, n - 1)]) | (at >= most[part][:, None])
            got[part] += np.where(off.any(1), off.argmax(1), step)
        todo = todo[(got[todo] % step == 0) & (got[todo] < most[todo])]
        # a pair that differs right at a step's end stays once more and gains nothing
        if len(todo):
            at = got[todo]
            todo = todo[text[np.minimum(a[todo] + at, n - 1)] == text[np.minimum(b[todo] + at, n - 1)]]
    return np.minimum(got, most)


def window_classes(text: np.ndarray, starts: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of starts in an order that puts equal strings of min_len bytes together, and where each such class begins (with the end). Strings are told by a 64-bit hash; what is made of a class compares its bytes."""
    up, down = powers(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=sums[1:])
    key = (sums[starts + min_len] - sums[starts]) * down[starts]
    o = np.argsort(key, kind="stable")
    return o, np.flatnonzero(np.r_[True, key[o][1:] != key[o][:-1], True]) if len(o) else np.zeros(1, np.int64)


def suffix_array(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes [start, end) by their bytes, and the common-prefix length of each with the one before (0 for the first)."""
    body = [text[x:y].tobytes() for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
    o = np.array(sorted(range(len(body)), key=body.__getitem__), np.int64)
    s, e = starts[o], ends[o]
    return o, np.r_[0, common_prefix(text, s[1:], s[:-1], np.minimum(e[1:] - s[1:], e[:-1] - s[:-1]))]


def interval_tree(lcp: np.ndarray, left: np.ndarray, min_len: int) -> list[tuple[int, int, int]]:
    """Left-diverse intervals (length, first, last) of the suffix array, found by a scan with a stack.

    left: a code of what precedes each suffix in suffix-array order; a negative
    one differs from all others. An interval is diverse when two of its suffixes
    are preceded by different codes.
    """
    out = []
    # [length, first, code below or -2 if diverse]
    stack: list[list[int]] = []

    def merged(x: int, y: int) -> int:
        return x if x == y and x >= 0 else -2

    n = len(lcp)
    for i in range(n + 1):
        now = int(lcp[i]) if i < n else 0
        begin, code = i - 1, int(left[i - 1]) if i else -2
        while stack and stack[-1][0] > now:
            length, first, below = stack.pop()
            below = merged(below, code)
            if below == -2 and length >= min_len:
                out.append((length, first, i - 1))
            begin, code = first, below
        if now >= min_len:
            if stack and stack[-1][0] == now:
                stack[-1][2] = merged(stack[-1][2], code)
            else:
                stack.append([now, begin, code])
    return out


def repeat_groups(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, left: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeat groups among the given suffixes, one after the other: each one's length and number of occurrences, and all occurrences as places in starts.

    left: for each start a code of what precedes it (negative: like nothing else).
    Classes of suffixes equal in min_len bytes that are all preceded by one code
    hold no maximal repeat and are left out; the others are sorted and scanned. A
    class of two is an interval of its own.
    """
    o, cut = window_classes(text, starts, min_len)
    size = np.diff(cut)
    low, high = (np.minimum.reduceat(left[o], cut[:-1]), np.maximum.reduceat(left[o], cut[:-1])) if len(o) else (size, size)
    good = (size > 1) & ((low != high) | (low < 0))
    two = cut[:-1][good & (size == 2)]
    a, b = o[two], o[two + 1]
    n = common_prefix(text, starts[a], starts[b], np.minimum(ends[a] - starts[a], ends[b] - starts[b]))
    on = n >= min_len
    lengths, counts, places = [n[on]], [np.full(int(on.sum()), 2)], [np.c_[a[on], b[on]].ravel()]
    for k in np.flatnonzero(good & (size > 2)).tolist():
        own = o[cut[k] : cut[k + 1]]
        order, lcp = suffix_array(text, starts[own], ends[own])
        own = own[order]
        for m, i, j in interval_tree(lcp, left[own], min_len):
            lengths.append(np.array([m])), counts.append(np.array([j - i + 1])), places.append(own[i : j + 1])
    return np.concatenate(lengths), np.concatenate(counts), np.concatenate(places)


def maximal_repeats(texts: list[bytes], min_len: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """All maximal repeats of at least min_len bytes in a few texts: (length, occurrences (text, place)), longest first."""
    body, begin, size = joined([np.frombuffer(t, np.uint8) for t in texts])
    of = np.repeat(np.arange(len(size)), np.maximum(0, size - min_len + 1))
    if not len(of):
        return []
    starts = np.concatenate([np.arange(b, b + n - min_len + 1) for b, n in zip(begin, size, strict=True) if n >= min_len])
    left = np.where(starts == begin[of], -1 - of, body[np.maximum(starts - 1, 0)].astype(np.int64))
    lengths, counts, places = repeat_groups(body, starts, begin[of] + size[of], left, min_len)
    groups = np.split(places, np.cumsum(counts)[:-1])
    return sorted(((int(n), sorted((int(of[p]), int(starts[p] - begin[of[p]])) for p in own)) for n, own in zip(lengths, groups, strict=True)), key=lambda x: (-x[0], x[1]))


class _View:
    def __init__(self, column):
        self.body, self.at = raw(column)
        self.first = self.at[:-1]


class Bytes:
    """Windows of min_len bytes, anchored by grams; strings of the greater lengths in `also` are told too."""

    at_once = True

    def __init__(self, min_len: int = MIN_LEN, gram: int | None = None, also: tuple[int, ...] = ()):
        self.min_len, self.lengths = min_len, (min_len, *also)
        self.gram = gram or min(GRAM, max(1, min_len // 2))

    def whole(self, n, body):
        """The spans of a context that is there twice."""
        if n <= DIGEST:
            k = DIGEST - n
            return [(k * LEVEL, k * LEVEL + self.lengths[k])]
        return [(k * LEVEL, k * LEVEL + len(body)) for k, m in enumerate(self.lengths) if m <= len(body)]

    def view(self, column):
        return _View(column)

    def runs(self, view):
        n, g = len(view.body), self.gram
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((view.body.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        keys = mixed((sums[g:] - sums[:-g]) * down[: max(0, n + 1 - g)]) if n >= g else np.zeros(0, np.uint64)
        size = np.diff(view.at)
        doc, first, length, h = anchor_runs(keys, self.min_len - g + 1, view.first, np.maximum(0, size - self.min_len + 1), window_low)
        return doc, first, length, h, mixed((sums[first + length - 1 + self.min_len] - sums[first]) * down[first])

    def cut(self, view, doc, lo, n, last):
        """The bytes of the windows lo to lo + n - 1, and of the longest strings that start with them as far as the windows up to `last` reach."""
        a = view.at[doc] + lo
        return view.body[a : a + min(n - 1 + max(self.lengths), last - lo + self.min_len)].tobytes()

    def single(self, view, doc, lo, n, last):
        """A digest of each string that starts with one of the windows, in the group of its own hash: 16 bytes instead of the string."""
        text = view.body[view.at[doc] + lo : view.at[doc] + last + self.min_len].tobytes()
        for k, m in enumerate(self.lengths):
            for x in range(min(n, len(text) - m + 1)):
                body = xxhash.xxh3_128_digest(text[x : x + m], seed=k)
                yield int.from_bytes(body[:8], "little", signed=True), DIGEST - k, lo + x, body

    def solve(self, groups):
        """For each context the spans that repeats cover. A context that is there twice is a repeat as a whole; where an anchor has several contexts, a suffix array of them all finds what they share."""
        ctx = [c for g in groups for c in g]
        found = [(i, *span) for i, c in enumerate(ctx) if len(c.places) > 1 for span in self.whole(c.n, c.body)]
        several, k = [], 0
        for g in groups:
            own = [k + i for i, c in enumerate(g) if c.n > 0]
            if len(own) > 1:
                several.extend(own)
            k += len(g)
        which, s, e = np.array(found, np.int64).reshape(-1, 3).T
        if several:
            body, begin, size = joined([np.frombuffer(ctx[i].body, np.uint8) for i in several])
            count = np.array([ctx[i].n for i in several], np.int64)
            of = np.repeat(np.arange(len(several)), count)
            inner = np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
            starts = begin[of] + inner
            left = np.where(inner == 0, -1 - of, body[np.maximum(starts - 1, 0)].astype(np.int64))
            n, counts, places = repeat_groups(body, starts, begin[of] + size[of], left, self.min_len)
            n = np.repeat(n, counts)
            for k, m in enumerate(self.lengths):
                p, own = places[n >= m], n[n >= m]
                which, s, e = np.r_[which, np.array(several)[of[p]]], np.r_[s, k * LEVEL + inner[p]], np.r_[e, k * LEVEL + inner[p] + own]
        none = (np.zeros(0, np.int64),) * 3
        out = [none] * len(ctx)
        # one union of all: contexts lie apart by more than all levels
        apart = LEVEL * (len(self.lengths) + 1)
        a, b = spans_union(which * apart + s, which * apart + e)
        which = a // apart
        at = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(a) else np.zeros(0, np.int64)
        for x, y in zip(at.tolist(), [*at[1:].tolist(), len(a)], strict=False):
            i = int(which[x])
            out[i] = (a[x:y] - i * apart, b[x:y] - i * apart, np.full(y - x, ALWAYS))
        return out


def cut_spans(column: pa.Array, spans: pa.Array, levels: int = 1):
    """Of each row the bytes, and for each length its maximal removed runs as (starts, ends)."""
    body, at = raw(column)
    for i, (s, e) in enumerate(spans_of(spans)):
        cut = np.searchsorted(s, LEVEL * np.arange(levels + 1))
        yield body[at[i] : at[i + 1]], [(s[x:y] - k * LEVEL, e[x:y] - k * LEVEL) for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True))]


def _finish(levels: int):
    """What is left without the runs of the last length, and the bytes that those of the first cover."""

    def run(batches):
        for b in pieces(batches):
            rows = []
            for body, found in cut_spans(b.column("text"), b.column("spans"), levels):
                (s, e), h, last = found[-1], hashlib.sha256(), 0
                for x, y in zip(s.tolist(), e.tolist(), strict=True):
                    h.update(body[last:x])
                    last = y
                h.update(body[last:])
                rows.append((len(body), int((e - s).sum()), len(s), h.hexdigest(), int((found[0][1] - found[0][0]).sum())))
            n, removed, k, sha, passage = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(k, pa.int64()), pa.array(sha, pa.string()), pa.array(passage, pa.int64())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage"])

    return run


def _keep(spared: str | None):
    """The row and the text that is left, all of it where `spared` holds; characters that a cut splits go."""

    def run(batches):
        for b in pieces(batches):
            out = []
            whole = np.asarray(b.column("text").is_null())
            keep = np.asarray(b.column("rest").field(spared).fill_null(False)) if spared else np.zeros(len(whole), bool)
            for i, (body, [(s, e)]) in enumerate(cut_spans(b.column("text"), b.column("spans"))):
                parts, last = [], 0
                if not keep[i]:
                    for x, y in zip(s.tolist(), e.tolist(), strict=True):
                        parts.append(body[last:x].tobytes())
                        last = y
                parts.append(body[last:].tobytes())
                out.append(None if whole[i] else "".join(p.decode("utf-8", "ignore") for p in parts))
            yield pa.RecordBatch.from_arrays([b.column("rest"), pa.array(out, pa.string())], names=["rest", "kept"])

    return run


def repeated_spans(docs: DataFrame, min_len: int = MIN_LEN, also: tuple[int, ...] = ()) -> DataFrame:
    """docs (rid, doc_id, text) with the spans of bytes that repeats of min_len bytes or more cover, and those of each greater length in `also`, shifted by LEVEL each."""
    return covered(docs, Bytes(min_len, also=also), by_doc=False)


def remove_repeats(docs: DataFrame, min_len: int = MIN_LEN, passage: int | None = None) -> DataFrame:
    """What is left of each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte covered by a min_len-byte string that also starts anywhere else,
    in the same document too, is removed. With `passage`, a length of less than
    min_len, a column n_passage counts the bytes that repeats of that length cover.
    Null and empty texts have no bytes; a text of any length is read whole, in one
    task. Rows that are equal in doc_id and text are copies of each other and lose
    all that is long enough; a row without a doc_id is judged like any other. An
    empty table gives no rows; other columns are ignored.
    """
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage long"
    if passage and passage >= min_len:
        raise ValueError("passage must be less than min_len")
    least, also = (passage, (min_len,)) if passage else (min_len, ())
    out = repeated_spans(keyed(docs), least, also).select("doc_id", "text", "spans").mapInArrow(_finish(1 + len(also)), columns)
    return out if passage else out.drop("n_passage")


def without_repeats(docs: DataFrame, min_len: int = MIN_LEN, spared: str | None = None) -> DataFrame:
    """docs with all columns, their texts without what remove_repeats removes and n_chars, if there, counted anew.

    Characters that a cut goes through are left out; a text that is all repeats
    becomes empty; a null text stays null; a row without a doc_id is judged like
    any other. Equal rows all lose what they share. spared: a boolean column whose
    rows keep their texts, though what they hold still counts for the others.
    """
    rows = keyed(docs, rest=True)
    found = repeated_spans(rows, min_len).select("doc_id", "rest", "text", "spans")
    kept = found.mapInArrow(_keep(spared), StructType([rows.schema["rest"], StructField("kept", StringType())]))
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    new = {"text": F.col("kept").cast(kinds["text"]), "n_chars": F.length("kept").cast(kinds.get("n_chars", "long"))}
    return kept.select(*[new[c].alias(c) if c in new else F.col("rest").getField(c).alias(c) for c in docs.columns])
