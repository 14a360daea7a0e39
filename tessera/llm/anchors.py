"""Finding all places where a fixed-length window of text recurs, without moving the text that doesn't.

Every window has an anchor: the smallest hash among the short grams in it, the
leftmost if several are equal. Equal windows have equal anchors at equal places, so
windows can only be equal inside the group of one anchor hash. A run of
consecutive windows with one anchor is a row (hash, row key, first window, number).
Hashes that occur once are dropped. For the others, the stretch of text that the
run's windows cover (a context) goes to the anchor's group; equal contexts of one
task go there once, and of many places only a few come with them: the others
stream by when the group is solved. Where strings longer than a window are asked
for too, a context goes on behind its last window as far as shared windows do.
Anchors with very many contexts are cut to single windows, whose groups are those
of equal windows (kind.single). Groups are solved in chunks, and the covered spans
go back to their documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, importable, mixed, pieces, settle, spans_union, spread

#: Bits of a packed key that tell the place in the batch.
PLACE = 32
LOW = np.uint64((1 << PLACE) - 1)
#: Bytes of contexts that are solved together.
CHUNK = 1 << 20
#: Different contexts from which on an anchor is crowded (counted by their marks).
CROWD = 4000
#: Places that go along with a context.
INLINE = 4
#: Instead of a number of windows: spans that need no solving.
TOLD = -1
#: Instead of a number of windows, less the level: a single string, given by its digest.
DIGEST = -2
#: Bytes of contexts in which a task looks for equal ones.
HELD = 16 << 20


def anchor_runs(keys: np.ndarray, width: int, doc_first: np.ndarray, doc_windows: np.ndarray, low) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: document, first window (place in the batch), number, anchor's hash.

    keys: a hash for each gram of the batch; doc_first: place of each document's
    first gram; doc_windows: its number of windows; low: the sliding minimum.
    """
    n = len(keys)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, np.zeros(0, np.uint64)
    packed = (keys & ~LOW) | np.arange(n, dtype=np.uint64)
    at = (low(packed, width) & LOW).astype(np.int64)
    docs = np.flatnonzero(doc_windows > 0)
    count = doc_windows[docs]
    total = int(count.sum())
    if not total:
        return none, none, none, np.zeros(0, np.uint64)
    begin = np.r_[0, np.cumsum(count)[:-1]]
    window = np.arange(total) - np.repeat(begin - doc_first[docs], count)
    a = at[window]
    new = np.r_[True, a[1:] != a[:-1]]
    new[begin] = True
    first = np.flatnonzero(new)
    length = np.diff(np.r_[first, total])
    doc = docs[np.searchsorted(begin, first, "right") - 1]
    return doc, window[first], length, keys[a[first]]


#: Kinds of rows: a run; one whose hash is known to recur; a hash that is known to.
PLAIN, KNOWN, SIGN = 0, 1, 2


def _find(kind, by_doc: bool):
    """Runs (k, h, rid, doc_id, lo, n, mark, state); mark: two bytes of the hash of a run's context. A hash that recurs in the batch already goes to its group (k) as one sign; its runs are dealt at random."""

    def run(batches):
        for b in pieces(batches, rows=3000, most=1 << 20):
            view = kind.view(b.column("text"))
            doc, first, length, h, mark = kind.runs(view)
            if not len(h):
                continue
            h = h.astype(np.int64)
            rid, ids = b.column("rid").to_numpy()[doc], b.column("doc_id").to_numpy()[doc]
            lo = first - view.first[doc]
            o = np.argsort(h, kind="stable")
            at = np.flatnonzero(np.r_[True, h[o][1:] != h[o][:-1]])
            n = np.diff(np.r_[at, len(o)])
            twice = (np.minimum.reduceat(ids[o], at) != np.maximum.reduceat(ids[o], at)) if by_doc else n > 1
            state = np.empty(len(h), np.int8)
            state[o] = np.repeat(np.where(twice, KNOWN, PLAIN), n)
            k = np.where(state == KNOWN, mixed(rid.view(np.uint64) + lo.astype(np.uint64)).view(np.int64), h)
            sign = o[at[twice]]
            own = np.r_[np.arange(len(h)), sign]
            kinds = np.r_[state, np.full(len(sign), SIGN, np.int8)]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[k, h[sign]]), pa.array(h[own]), pa.array(rid[own]), pa.array(ids[own]), pa.array(lo[own].astype(np.int32)), pa.array(length[own].astype(np.int32)), pa.array((mark[own] >> np.uint64(48)).astype(np.uint16).view(np.int16)), pa.array(kinds)], names=["k", "h", "rid", "doc_id", "lo", "n", "mark", "state"])

    return run


FOUND = "k long, h long, rid long, doc_id long, lo int, n int, mark short, state byte"


SHARED = ["h", "rid", "doc_id", "lo", "n", "mark"]


def _shared(by_doc: bool):
    """Keeps the runs, which come sorted by k, of hashes that occur twice (by_doc: in two documents)."""

    def run(batches):
        held, last, good_before = None, None, False
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            k, d, state = t["k"].to_numpy(), t["doc_id"].to_numpy(), t["state"].to_numpy()
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            length = np.diff(np.r_[first, len(k)])
            good = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)) if by_doc else length > 1
            good |= np.maximum.reduceat(state, first) > PLAIN
            if good_before and k[0] == last:
                good[0] = True
            keep = np.repeat(good, length) & (state != SIGN)
            end = first[-1]
            last, good_before = k[end], bool(good[-1])
            # the last hash may go on in the next batch
            held = None if good_before else t.slice(end).to_batches()[0]
            yield from t.filter(pa.array(keep)).select(SHARED).to_batches()

    return run


def _stretches(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each run of a document, sorted by its first window: the last window of the shared windows that follow one another from it on."""
    last = lo + n - 1
    ends = np.flatnonzero(np.r_[lo[1:] != last[:-1] + 1, True])
    return last[ends][np.searchsorted(ends, np.arange(len(lo)))]


def _contexts(kind):
    """Of each document (rid, key, text, runs) the contexts of its shared runs, equal ones of a task once.

    A context comes with up to INLINE places, those of its first and last document
    among them. The others follow it in its group as rows of places alone or, where
    a second place is all that counts (kind.at_once), are told at once, one row a
    document. Runs of crowded anchors are cut to single windows, each the group of
    its own hash.
    """

    def flush(found):
        rows, own = [], {}
        for (h, n, body), places in found.items():
            places.sort(key=lambda p: p[1])
            mark, rest = xxhash.xxh64_digest(body, seed=max(n, 0)), []
            if len(places) > INLINE:
                rest, places = places[INLINE - 1 : -1], [*places[: INLINE - 1], places[-1]]
            rows.append((h, False, n, body, np.array(places, np.int64).tobytes()))
            if kind.at_once:  # what is there twice is covered, wherever else it is
                whole = kind.whole(n, body)
                for rid, doc_id, lo in rest:
                    own.setdefault((rid, doc_id), []).extend((lo + s, lo + e) for s, e in whole)
            else:
                for a in range(0, len(rest), 4096):
                    rows.append((h, True, n, mark, np.array(rest[a : a + 4096], np.int64).tobytes()))
        for key, spans in own.items():
            s, e = spans_union(*np.array(spans, np.int64).T)
            rows.append((key[0], True, TOLD, np.c_[s, e].tobytes(), np.array(key, np.int64).tobytes()))
        for a in range(0, len(rows), 4000):
            h, alone, n, body, places = zip(*rows[a : a + 4000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(alone, pa.bool_()), pa.array(n, pa.int32()), pa.array(body, pa.binary()), pa.array(places, pa.binary())], names=["h", "alone", "n", "context", "places"])

    def run(batches):
        found: dict[tuple, list] = {}
        size = 0
        for b in pieces(batches, rows=1000, most=2 << 20):
            view = kind.view(b.column("text"))
            rid, ids = b.column("rid").to_pylist(), b.column("key").to_pylist()
            runs = b.column("runs")
            at = np.asarray(runs.offsets).astype(np.int64)
            flat = runs.values
            fields = [flat.field(k).to_numpy(zero_copy_only=False) for k in ("h", "lo", "n", "crowded")]
            for i in range(b.num_rows):
                own = [f[at[i] : at[i + 1]] for f in fields]
                o = np.unique(own[1], return_index=True)[1]  # rows that are equal have each run twice
                h, lo, n, many = (f[o] for f in own)
                for h, lo, n, many, last in zip(h.tolist(), lo.tolist(), n.tolist(), many.tolist(), _stretches(lo, n).tolist(), strict=True):
                    cuts = kind.single(view, i, lo, n, last) if many else [(h, n, lo, kind.cut(view, i, lo, n, last))]
                    for h, n, x, body in cuts:
                        key = (h, n, body)
                        have = found.get(key)
                        if have is None:
                            have = found[key] = []
                            size += len(body) + 300
                        have.append((rid[i], ids[i], x))
                        size += 150
                        if size > HELD:
                            yield from flush(found)
                            found, size = {}, 0
        yield from flush(found)

    return run


class Context:
    """A distinct context: its number of windows, its bytes, and places as rows (rid, doc_id, first window), its first and last document's among them."""

    __slots__ = ("n", "body", "parts")

    def __init__(self, n, body):
        self.n, self.body, self.parts = n, body, []

    @property
    def places(self):
        if len(self.parts) != 1:
            self.parts = [b"".join(self.parts)]
        return np.frombuffer(self.parts[0], np.int64).reshape(-1, 3)


def spans_at(places: np.ndarray, own: np.ndarray, solution: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (place, s, e) of places, each of the context own: those of its solution (s, e, since) with since before the place's document."""
    size = np.array([len(x[0]) for x in solution], np.int64)
    first = np.r_[0, np.cumsum(size)]
    s, e, since = (np.concatenate([x[k] for x in solution]) if len(solution) else np.zeros(0, np.int64) for k in range(3))
    n = size[own]
    place = np.repeat(np.arange(len(places)), n)
    at = first[own][place] + np.arange(len(place)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
    on = since[at] < places[place, 1]
    place, at = place[on], at[on]
    return place, places[place, 2] + s[at], places[place, 2] + e[at]


def _solve(kind):
    """Solves chunks of whole groups. A group's contexts come before its other places, which are told as they stream by."""

    def told(places, own, solution):
        place, s, e = spans_at(places, own, solution)
        rid, ids = places[place, 0], places[place, 1]
        o = np.lexsort((s, ids, rid))
        rid, ids, pairs = rid[o], ids[o], np.c_[s[o], e[o]]
        at = np.flatnonzero(np.r_[True, (rid[1:] != rid[:-1]) | (ids[1:] != ids[:-1])]) if len(rid) else np.zeros(0, np.int64)
        if len(at):
            yield packed(rid[at], ids[at], [x.tobytes() for x in np.split(pairs, at[1:])])

    def packed(rid, ids, spans):
        return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(ids, pa.int64()), pa.array(spans, pa.binary())], names=["rid", "doc_id", "spans"])

    def flush(groups):
        ctx = [c for g in groups for c in g]
        solution = kind.solve(groups)
        places = [c.places for c in ctx]
        own = np.repeat(np.arange(len(ctx)), [len(p) for p in places])
        if len(own):
            yield from told(np.concatenate(places), own, solution)
        return solution

    def run(batches):
        now, group, groups, size = None, {}, [], 0
        marks, solution = None, None  # of a group whose other places stream by

        def ended():
            """The groups that are complete, with the current one."""
            nonlocal group, groups, size
            out = [*groups, list(group.values())] if group else groups
            group, groups, size = {}, [], 0
            return out

        for b in batches:
            passing = []
            for h, alone, n, body, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if n == TOLD:
                    passing.append((*np.frombuffer(places, np.int64).tolist(), body))
                    continue
                if h != now:
                    marks = solution = None
                    if group:
                        groups.append(list(group.values()))
                        group = {}
                    if size > CHUNK:
                        yield from flush(ended())
                    now = h
                if not alone:
                    c = group.get((n, body))
                    if c is None:
                        c = group[n, body] = Context(n, body)
                        size += len(body)
                    c.parts.append(places)
                    size += len(places)
                    continue
                if solution is None:
                    last = list(group.values())
                    marks = {(c.n, xxhash.xxh64_digest(c.body, seed=c.n)): i for i, c in enumerate(last)}
                    done = yield from flush(ended())
                    solution = done[len(done) - len(last) :]
                p = np.frombuffer(places, np.int64).reshape(-1, 3)
                yield from told(p, np.full(len(p), marks[n, body]), solution)
            if passing:
                yield packed(*zip(*passing, strict=True))
        rest = ended()
        if rest:
            yield from flush(rest)

    return run


def spans_of(column: pa.Array):
    """Of each row the union of its packed spans, as (starts, ends)."""
    offsets, there = np.asarray(column.offsets).astype(np.int64), np.asarray(column.is_valid())
    parts = column.values
    for i in range(len(column)):
        blobs = [parts[k].as_py() for k in range(offsets[i], offsets[i + 1])] if there[i] else []
        pairs = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2)
        yield spans_union(pairs[:, 0], pairs[:, 1])


def keyed(docs: DataFrame, rest: bool = False) -> DataFrame:
    """(rid, doc_id, text) and, if asked for, the whole row as a struct `rest`; rid, a hash, and doc_id together are equal only for rows of equal doc_id and text."""
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    d = spread(docs.select(*own, *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")] if rest else [])))
    return d.select(F.xxhash64("doc_id", "text").alias("rid"), *d.columns)


def _flagged(shared: DataFrame) -> DataFrame:
    """Runs with `crowded`: whether their anchor has some CROWD contexts or more.

    The number of different marks is estimated from the least one of each of eight
    classes, so that one aggregation, combined before its shuffle, tells.
    """
    mark = F.col("mark").cast("int").bitwiseAND(0xFFFF)
    least = [F.coalesce(F.min(F.when(mark.bitwiseAND(7) == j, F.shiftright(mark, 3))), F.lit(8192)) for j in range(8)]
    rows = shared.groupBy("h").agg(F.count("*").alias("n"), sum(least[1:], least[0]).alias("least"))
    # of m random marks below 8192 the least is 8192 / (m + 1) on average
    hot = settle(rows.where((F.col("n") > CROWD) & (F.col("least") <= 8 * 8192 / (CROWD / 8 + 1))).select("h", F.lit(True).alias("crowded")))
    n = hot.count()
    if not n:
        return shared.withColumn("crowded", F.lit(False))
    return shared.join(F.broadcast(hot) if n <= BROADCAST_ROWS else hot, "h", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))


def covered(docs: DataFrame, kind, by_doc: bool) -> DataFrame:
    """docs (of keyed) with spans: arrays of pairs (s, e) in the kind's units, packed, null where nothing recurs.

    by_doc: only what recurs in another document counts; rows without a doc_id are
    in no document then, so that they lose nothing and take nothing.
    """
    importable(docs.sparkSession)
    known = docs.where("text is not null and doc_id is not null" if by_doc else "text is not null").select("rid", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text")
    found = known.mapInArrow(_find(kind, by_doc), FOUND)
    shared = settle(found.repartition("k").sortWithinPartitions("k").mapInArrow(_shared(by_doc), "h long, rid long, doc_id long, lo int, n int, mark short"))
    runs = _flagged(shared).groupBy("rid", "doc_id").agg(F.collect_list(F.struct("h", "lo", "n", "crowded")).alias("runs"))
    whose = docs.withColumn("key", F.coalesce("doc_id", F.lit(0)))
    runs = runs.withColumnRenamed("doc_id", "key")
    # both joins read all columns of docs, so that one exchange of the texts serves both
    contexts = whose.join(runs.hint("shuffle_hash"), ["rid", "key"]).mapInArrow(_contexts(kind), "h long, alone boolean, n int, context binary, places binary")
    spans = contexts.repartition("h").sortWithinPartitions("h", "alone").mapInArrow(_solve(kind), "rid long, doc_id long, spans binary")
    spans = spans.groupBy("rid", F.col("doc_id").alias("key")).agg(F.collect_list("spans").alias("spans"))
    return whose.join(spans.hint("shuffle_hash"), ["rid", "key"], "left").select(*docs.columns, "spans")
