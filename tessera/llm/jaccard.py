"""N-gram Jaccard join (operator 7): documents whose word shingles overlap by 0.8 or more, exactly.

1. Sharing. A document that is 0.8-similar to another shares at least 0.8 of its
   shingles. Shingle hashes are dealt by value to buckets, in one row of packed
   arrays per batch and bucket; each bucket finds the shingles of two or more
   batches and sends back one count per document. Most documents end here. Equal
   sets of a batch, and a shingle that sets of one batch share, go on once. Copies
   in several batches pass this filter; from here on, equal sets, told by their
   digests, count once, whatever their number.
2. Blocks. For the rest the same exchange gives every shingle's frequency. Sets
   are ordered from rare to frequent; two similar sets share a shingle among the
   first |x| - ceil(0.8 |x|) + 1. Every task sends on one set per such shingle and
   the links to it of its other sets, so no shingle's group is ever large. The
   connected components of these links are blocks: no similar pair lies across.
3. Prefix trees. In each block, sets are put into a trie in the global order,
   one after the other. A set first walks the trie: documents below a node share
   the overlap counted down to it; a subtree is left where sizes or the lengths
   still to come can't reach the bound, or where all is linked with the set already.
   A block that is too large for a task is dealt to parts; see _large.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Forest, components, discard, importable, pieces, settle, spread
from .words import Words

N = 5
#: Bytes of text that one block may have in one task.
BLOCK_BYTES = 48 << 20
#: Bits of a bucket's number at most.
MOST_BITS = 18
#: Shingles of a bucket that are sorted at a time.
SORTED = 1 << 21


def shingle_sets(column: pa.Array, n: int = N) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its n-word shingles, A-Z lower-cased; one of all words where there are fewer; none without words."""
    w = Words(column, lower=True)
    h = w.runs(n)
    out = []
    for i in range(len(w.first) - 1):
        a, b = w.first[i], w.first[i + 1]
        if b - a >= n:
            s = h[a : b - n + 1]
        elif b > a:
            s = np.array([xxhash.xxh64_intdigest(w.hash[a:b].tobytes(), seed=int(b - a))], np.uint64)
        else:
            s = h[:0]
        s = np.sort(s)
        out.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s)
    return out


def digest(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63)


def similar(inter: int, a: int, b: int) -> bool:
    return 180 * inter >= 80 * (a + b)


ROWS = "bucket int, batch long, docs binary, places binary, counts binary, tokens binary"
SCHEMA = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("docs", pa.binary()), ("places", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary())])
#: Shingles that a batch has for each bucket, if it can.
SHARE = 32
#: Documents of a batch at most, so that two bytes tell their place.
MOST_DOCS = 60_000


def _batches(batches, bits: int):
    """Of each batch its number, doc_ids, shingle sets, digests and sizes. The more buckets, the longer the batches, so that rows don't get short."""
    part, seq, ids, sets, held = TaskContext.get().partitionId(), 0, [], [], 0

    def done():
        nonlocal seq, ids, sets, held
        seq += 1
        out = (part << 32) + seq - 1, np.concatenate(ids), sets, np.array([digest(s) for s in sets], np.int64), np.array([len(s) for s in sets], np.int64)
        ids, sets, held = [], [], 0
        return out

    for b in pieces(batches, rows=4000, most=2 << 20):
        own = shingle_sets(b.column(1))
        if ids and len(sets) + len(own) > MOST_DOCS:
            yield done()
        ids.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        sets.extend(own)
        held += sum(map(len, own))
        if held >= SHARE << bits:
            yield done()
    if ids:
        yield done()


def _deal(bits: int):
    """One row per batch and bucket: 4 bytes, after the bucket's bits, of the shingles of each different set there, set after set.

    A shingle that different sets of the batch share goes there once, as one of a
    set of its own, the last, and is counted at once; equal sets go once. So no
    shingle and no copy comes more often than there are batches, and a shingle that
    comes twice is in two batches.
    """

    def run(batches):
        for batch, ids, sets, marks, size in _batches(batches, bits):
            first = np.unique(marks, return_index=True)[1]
            first = first[size[first] > 0]
            tok = np.concatenate([sets[i] for i in first]) if len(first) else np.zeros(0, np.uint64)
            doc = np.repeat(first, size[first])
            o = np.argsort(tok, kind="stable")
            tok, doc = tok[o], doc[o]
            at = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]]) if len(tok) else np.zeros(0, np.int64)
            n = np.diff(np.r_[at, len(tok)])
            several = np.repeat(n > 1, n)
            here = np.bincount(doc[several], minlength=len(ids))
            tok, doc = np.r_[tok[~several], tok[at[n > 1]]], np.r_[doc[~several], np.full(int((n > 1).sum()), len(ids))]
            bucket = (tok >> np.uint64(64 - bits)).astype(np.int64)
            o = np.lexsort((tok, doc, bucket))
            tok, doc, bucket = ((tok[o] << np.uint64(bits)) >> np.uint64(32)).astype("<u4"), doc[o], bucket[o]
            # runs of one set in one bucket
            run_at = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])]) if len(tok) else np.zeros(0, np.int64)
            place, count = doc[run_at].astype("<u2"), np.diff(np.r_[run_at, len(tok)]).astype("<u4")
            used = np.unique(np.r_[0, bucket])
            cut, run_cut = np.searchsorted(bucket, np.r_[used, 1 << bits]), np.searchsorted(bucket[run_at], np.r_[used, 1 << bits])
            docs = np.stack([ids, marks, size, here]).tobytes()
            for a in range(0, len(used), 4096):
                out = {k: [] for k in SCHEMA.names}
                for i in range(a, min(a + 4096, len(used))):
                    x, y = run_cut[i], run_cut[i + 1]
                    out["bucket"].append(int(used[i])), out["batch"].append(batch)
                    out["docs"].append(docs if i == 0 else None)
                    out["places"].append(place[x:y].tobytes()), out["counts"].append(count[x:y].tobytes())
                    out["tokens"].append(tok[cut[i] : cut[i + 1]].tobytes())
                yield pa.RecordBatch.from_pydict(out, schema=SCHEMA)

    return run


def _deal_counted(bits: int):
    """One row per batch and bucket: the batch's different shingles there and in how many of its sets each is; and one row, in a bucket below 0, with its sets."""

    def run(batches):
        for batch, ids, sets, marks, size in _batches(batches, bits):
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            tok, n = np.unique(flat, return_counts=True)
            cut = np.searchsorted((tok >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
            used = [k for k in range(1 << bits) if cut[k] < cut[k + 1]]
            none = [None] * len(used)
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": [-1 - batch % (1 << 20), *used], "batch": [batch] * (len(used) + 1), "docs": [np.stack([ids, marks, size]).tobytes(), *none], "places": [None, *none],
                    "counts": [None, *(n[cut[k] : cut[k + 1]].astype("<u4").tobytes() for k in used)], "tokens": [flat.tobytes(), *(tok[cut[k] : cut[k + 1]].tobytes() for k in used)],
                },
                schema=SCHEMA,
            )

    return run


def runs_of(batches, key: int = 0):
    """Lists of the rows (as tuples) with an equal key, from batches sorted by it."""
    now, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[key] != now and held:
                yield held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield held


def _weigh(batches):
    """Bucket by bucket: back go, for each batch, how many shingles of each of its sets are in another batch too. Long buckets are sorted in ranges of their shingles."""
    for rows in runs_of(batches):
        tok = np.concatenate([np.frombuffer(r[5], "<u4") for r in rows])
        counts = [np.frombuffer(r[4], "<u4") for r in rows]
        n = np.concatenate(counts)
        doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        shared = np.zeros(len(n), np.int64)
        ranges = np.linspace(0, 1 << 32, -(-len(tok) // SORTED) + 1).astype(np.int64)
        for low, high in zip(ranges[:-1], ranges[1:], strict=True):
            t, d = tok, doc
            if len(ranges) > 2:
                on = (tok >= low) & (tok < high)
                t, d = tok[on], doc[on]
            if not len(t):
                continue
            o = np.argsort(t, kind="stable")
            t, d = t[o], d[o]
            same = t[1:] == t[:-1]
            shared += np.bincount(d[np.r_[False, same] | np.r_[same, False]], minlength=len(n))
        cut = np.cumsum([len(x) for x in counts])[:-1]
        out = {"batch": [r[1] for r in rows], "docs": [r[2] for r in rows], "place": [r[3] for r in rows], "shared": [x.astype("<u4").tobytes() for x in np.split(shared, cut)]}
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_pydict({k: v[i : i + 64] for k, v in out.items()}, schema=pa.schema([(k, pa.int64() if k == "batch" else pa.binary()) for k in out]))


def _weigh_counted(batches):
    """Bucket by bucket: back goes, for each batch, in how many sets of all batches each of its shingles is. Rows of sets pass."""
    for rows in runs_of(batches):
        if rows[0][0] < 0:
            out = {"batch": [r[1] for r in rows], "bucket": [r[0] for r in rows], "docs": [r[2] for r in rows], "data": [r[5] for r in rows]}
        else:
            tok = [np.frombuffer(r[5], "<u8") for r in rows]
            n = np.concatenate([np.frombuffer(r[4], "<u4") for r in rows])
            inv = np.unique(np.concatenate(tok), return_inverse=True)[1]
            df = np.bincount(inv, n)[inv]
            cut = np.cumsum([len(x) for x in tok])[:-1]
            out = {"batch": [r[1] for r in rows], "bucket": [r[0] for r in rows], "docs": [None] * len(rows), "data": [np.minimum(x, 2**32 - 1).astype("<u4").tobytes() for x in np.split(df, cut)]}
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_pydict({k: v[i : i + 64] for k, v in out.items()}, schema=pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("docs", pa.binary()), ("data", pa.binary())]))


def _gather_counts(batches):
    """Batch by batch: every document with its digest, size and whether enough of it is shared."""
    for rows in runs_of(batches):
        docs = next(np.frombuffer(r[1], np.int64).reshape(4, -1) for r in rows if r[1] is not None)
        shared = np.zeros(docs.shape[1] + 1, np.int64)  # the last is that of the sign
        for r in rows:
            np.add.at(shared, np.frombuffer(r[2], "<u2").astype(np.int64), np.frombuffer(r[3], "<u4").astype(np.int64))
        # equal sets were counted at the first of them
        first, of = np.unique(docs[1], return_index=True, return_inverse=True)[1:]
        shared = (shared[:-1] + docs[3])[first][of]
        alive = (docs[2] > 0) & (100 * shared >= 80 * docs[2])
        yield pa.RecordBatch.from_arrays([pa.array(docs[0]), pa.array(docs[1]), pa.array(docs[2]), pa.array(alive)], names=["doc_id", "digest", "n", "alive"])


def prefix_length(n: int) -> int:
    return n - -(-80 * n // 100) + 1


def _gather_prefixes(batches):
    """Batch by batch: sets ordered from rare to frequent, cut to their prefixes; (token, set) once per shingle, and links between the task's own sets."""
    forest, first = Forest(), {}
    for rows in runs_of(batches):
        docs, tok = next((np.frombuffer(r[2], np.int64).reshape(3, -1), np.frombuffer(r[3], "<u8")) for r in rows if r[1] < 0)
        df = [np.frombuffer(r[3], "<u4") for r in sorted((r for r in rows if r[1] >= 0), key=lambda r: r[1])]
        df = np.concatenate(df)[np.unique(tok, return_inverse=True)[1]] if df else np.zeros(0, np.uint32)
        begin = np.r_[0, np.cumsum(docs[2])]
        place = np.repeat(np.arange(docs.shape[1]), docs[2])
        shared = np.bincount(place, df > 1, docs.shape[1])
        o = np.lexsort((tok, df, place))
        tok, df = tok[o], df[o]
        for i in range(docs.shape[1]):
            n = int(docs[2, i])
            if 100 * shared[i] < 80 * n or not n:
                continue
            me = int(docs[1, i])
            a = begin[i]
            p = slice(a, a + prefix_length(n))
            for t in tok[p][df[p] > 1].astype(np.int64).tolist():
                other = first.setdefault(t, me)
                if other != me:
                    forest.join(other, me)
                    if me < other:
                        first[t] = me
    links, toks = forest.links(), list(first.items())
    for a in range(0, len(links), 50_000):
        x = links[a : a + 50_000]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), pa.array([u for u, _ in x], pa.int64()), pa.array([v for _, v in x], pa.int64())], names=["token", "u", "v"])
    for a in range(0, len(toks), 50_000):
        x = toks[a : a + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in x], pa.int64()), pa.array([u for _, u in x], pa.int64()), pa.nulls(len(x), pa.int64())], names=["token", "u", "v"])


class _Node:
    __slots__ = ("seg", "kids", "docs", "low", "high", "some", "one")

    def __init__(self, seg, size, doc):
        self.seg, self.kids, self.docs = seg, {}, []
        self.low = self.high = size
        self.some, self.one = doc, True  # a document below; whether all below were linked with it when last seen


class PrefixTree:
    """A trie of sets of ranks that finds, for one set after the other, those before it that are similar and not yet linked."""

    def __init__(self, forest: Forest):
        self.forest, self.root = forest, {}

    def add(self, doc, ranks: np.ndarray, marks: np.ndarray) -> None:
        """Links the set with all similar ones before it and puts it in. marks: a boolean array over ranks, all False."""
        marks[ranks] = True
        self._walk(doc, ranks, marks)
        marks[ranks] = False
        self._put(doc, ranks)

    def _walk(self, doc, x, marks):
        find, size = self.forest.find, len(x)
        stack = [(node, 0, 0) for node in self.root.values()]
        while stack:
            node, over, length = stack.pop()
            if node.high * 100 < 80 * size or node.low * 80 > 100 * size:
                continue
            if node.one and find(node.some) == find(doc):
                continue
            over += int(np.count_nonzero(marks[node.seg]))
            length += len(node.seg)
            left = size - int(np.searchsorted(x, node.seg[-1], "right"))
            if 180 * (over + min(left, node.high - length)) < 80 * (size + max(node.low, -(-80 * size // 100))):
                continue
            for other in node.docs:
                if similar(over, size, length):
                    self.forest.join(other, doc)
            stack.extend((kid, over, length) for kid in node.kids.values())

    def _put(self, doc, x):
        size, kids, at = len(x), self.root, 0
        while True:
            key = int(x[at])
            node = kids.get(key)
            if node is None:
                node = kids[key] = _Node(x[at:], size, doc)
                node.docs.append(doc)
                return
            seg, rest = node.seg, x[at:]
            m = min(len(seg), len(rest))
            off = np.flatnonzero(seg[:m] != rest[:m])
            same = int(off[0]) if len(off) else m
            if same < len(seg):
                low = _Node(seg[same:], size, node.some)
                low.kids, low.docs, low.low, low.high, low.one = node.kids, node.docs, node.low, node.high, node.one
                node.seg, node.kids, node.docs = seg[:same], {int(seg[same]): low}, []
            node.one = node.one and self.forest.find(node.some) == self.forest.find(doc)
            node.low, node.high = min(node.low, size), max(node.high, size)
            at += same
            if at == size:
                node.docs.append(doc)
                return
            kids = node.kids


def link_sets(ids: list[int], sets: list[np.ndarray], linked: list[int] | None = None) -> Forest:
    """Components of the similar sets; linked: what each is known to be linked with."""
    forest = Forest()
    for a, b in zip(ids, linked or [], strict=False):
        forest.join(a, b)
    full = [(i, s) for i, s in zip(ids, sets, strict=True) if len(s)]
    if len(full) < 2:
        return forest
    u, inv, n = np.unique(np.concatenate([s for _, s in full]), return_inverse=True, return_counts=True)
    rank = np.empty(len(u), np.int64)
    rank[np.lexsort((u, n))] = np.arange(len(u))
    inv, at = rank[inv], 0
    tree, marks = PrefixTree(forest), np.zeros(len(u), bool)
    todo = []
    for i, s in full:
        todo.append((len(s), i, np.sort(inv[at : at + len(s)])))
        at += len(s)
    for _, i, x in sorted(todo, key=lambda y: y[:2]):
        tree.add(i, x, marks)
    return forest


def _link_blocks(batches):
    """Block by block (block, digest, linked, text): links of a spanning forest of each component."""
    for rows in runs_of(batches):
        sets = shingle_sets(pa.array([r[3] for r in rows], pa.large_string()))
        # where a doc_id is there twice, only the row with the digest asked for counts
        seen = {r[1]: (s, r[2]) for r, s in zip(rows, sets, strict=True) if digest(s) == r[1]}
        ids = sorted(seen)
        links = link_sets(ids, [seen[i][0] for i in ids], [seen[i][1] for i in ids]).links()
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], pa.int64()), pa.array([v for _, v in links], pa.int64())], names=["u", "v"])


def _linked(rows: DataFrame) -> DataFrame:
    """Links within each block of rows (block, digest, linked, text)."""
    return rows.select("block", "digest", "linked", "text").repartition("block").sortWithinPartitions("block").mapInArrow(_link_blocks, "u long, v long")


def _large(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Links in blocks of more than block_bytes, in tasks of about as much.

    Each block is dealt by digest to parts. Parts are linked on their own; then
    the smallest member of each component stands for it in a round among such
    members. What is then in the block's largest component needs no more
    comparing with itself: the others, in chunks, are compared with every part.
    """
    size = rows.groupBy("block").agg(F.sum(F.octet_length("text")).alias("bytes"))
    parts = rows.join(size, "block").withColumn("part", F.pmod(F.xxhash64("digest"), F.ceil(2 * F.col("bytes") / block_bytes)).cast("int")).drop("bytes")
    own = settle(_linked(parts.withColumn("block", F.xxhash64("block", "part"))))
    comp = settle(components(own))
    told = rows.join(comp, rows["digest"] == comp["id"], "left").select("block", "digest", F.coalesce("component", "digest").alias("linked"), "text")
    heads = told.where("digest = linked")
    before, after = rows.count(), heads.count()
    links = own
    if after > 1:
        sizes = heads.groupBy("block").agg(F.sum(F.octet_length("text")).alias("bytes"))
        if sizes.where(F.col("bytes") > block_bytes).isEmpty():
            links = links.unionByName(_linked(heads))
        elif after < 0.7 * before:
            links = links.unionByName(_large(heads, block_bytes))
        links = settle(links)
        comp = settle(components(links))
    told = settle(parts.join(comp, parts["digest"] == comp["id"], "left").select("block", "digest", F.coalesce("component", "digest").alias("linked"), "text", "part"))
    most = told.groupBy("block", "linked").agg(F.count("*").alias("n")).groupBy("block").agg(F.max(F.struct("n", "linked")).alias("top")).select("block", F.col("top.linked").alias("main"))
    minor = told.join(most, "block").where("linked <> main").drop("main", "part")
    n_chunks = minor.groupBy("block").agg(F.ceil(2 * F.sum(F.octet_length("text")) / block_bytes).alias("chunks"))
    minor = minor.join(n_chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("digest", F.lit(3)), F.col("chunks")).cast("int"))
    n_parts = told.groupBy("block").agg((F.max("part") + 1).alias("parts"))
    left = minor.join(n_parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.xxhash64("block", "chunk", "part").alias("block"), "digest", "linked", "text")
    right = told.join(n_chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int")))).select(F.xxhash64("block", "chunk", "part").alias("block"), "digest", "linked", "text")
    return links.unionByName(_linked(left.unionByName(right)))


def _of(docs: DataFrame, chosen: DataFrame, rows: int) -> DataFrame:
    """The documents in chosen, which has `rows` rows: broadcast while few, else joined by shuffling."""
    return docs.join(F.broadcast(chosen) if rows <= BROADCAST_ROWS else chosen, "doc_id")


def _sizes(batches):
    """Rows without a doc_id: the number of shingles alone."""
    for b in pieces(batches, most=2 << 20):
        n = [len(s) for s in shingle_sets(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column(0)], names=["doc_id", "n_shingles", "component_id"])


def _bits(docs: DataFrame) -> int:
    """Bits of a bucket's number: some four buckets for each partition of the input or of a shuffle, so that their size doesn't grow with the input and partitions are even."""
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    return min(MOST_BITS, max(5, math.ceil(math.log2(4 * partitions))))


def jaccard_components(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Null and empty texts and texts of blanks have no shingles and are linked with
    nothing. Repeated doc_ids give a row each, with the component of its own set. A
    row without doc_id links with nothing and has no component. An empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    importable(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nameless = rows.where("doc_id is null").mapInArrow(_sizes, "doc_id long, n_shingles long, component_id long")
    docs = spread(rows.where("doc_id is not null"))
    bits = _bits(docs)
    dealt = docs.mapInArrow(_deal(bits), ROWS).repartition("bucket").sortWithinPartitions("bucket")
    counted = dealt.mapInArrow(_weigh, "batch long, docs binary, place binary, shared binary").repartition("batch").sortWithinPartitions("batch")
    known = settle(counted.mapInArrow(_gather_counts, "doc_id long, digest long, n long, alive boolean"))
    reps = settle(known.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("alive").alias("alive")))
    alive = reps.where("alive").select("doc_id", "digest")
    n_alive = alive.count()
    block_of = None
    if n_alive:
        texts = _of(docs, alive.select("doc_id"), n_alive)
        dealt = texts.mapInArrow(_deal_counted(bits), ROWS).repartition("bucket").sortWithinPartitions("bucket")
        weighed = dealt.mapInArrow(_weigh_counted, "batch long, bucket int, docs binary, data binary")
        pre = settle(weighed.repartition("batch").sortWithinPartitions("batch").mapInArrow(_gather_prefixes, "token long, u long, v long"))
        across = pre.where("token is not null").select("token", "u")
        low = across.groupBy("token").agg(F.min("u").alias("v"), F.max("u").alias("w")).where("v < w")
        links = pre.where("token is null").select("u", "v").unionByName(across.join(low, "token").where("u <> v").select("u", "v"))
        blocks = settle(components(links))
        discard(pre)
        members = settle(blocks.join(alive, blocks["id"] == alive["digest"]).select("doc_id", "digest", F.col("component").alias("block")))
        texts = settle(_of(docs, members, n_alive).select("block", "digest", F.col("digest").alias("linked"), "text"))
        large = settle(texts.groupBy("block").agg(F.sum(F.octet_length("text")).alias("bytes")).where(F.col("bytes") > block_bytes).select("block"))
        if large.isEmpty():
            similar_links = _linked(texts)
        else:
            similar_links = _linked(texts.join(large, "block", "left_anti")).unionByName(_large(settle(texts.join(large, "block", "left_semi")), block_bytes))
        block_of = settle(components(settle(similar_links)))
    out = known.join(reps.select("digest", F.col("doc_id").alias("rep")), "digest", "left")
    if block_of is not None:
        # components of digests to components of documents
        rep_of = block_of.join(reps.select(F.col("digest").alias("id"), F.col("doc_id").alias("rep")), "id")
        low = rep_of.groupBy("component").agg(F.min("rep").alias("component_rep"))
        named = rep_of.join(low, "component").select(F.col("id").alias("digest"), "component_rep")
        out = out.join(named, "digest", "left").withColumn("rep", F.coalesce("component_rep", "rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("component_id")).unionByName(nameless)
