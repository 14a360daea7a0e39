"""Embedding near-duplicates (operator 8): product quantisation over inverted lists.

Vectors are compared with those of their own length only; equal ones are one entry
of the index that counts as many times as there are rows. Unit vectors are put into
the inverted lists of their nearest coarse centroids, which second centroids of
what is left divide again where there are very many vectors, and their residuals
are coded per subspace. A point within radius r of x belongs to list c
only if its way from x crosses the plane between x's centroid and c's. Across a
given plane it goes r / sqrt(dim) on average if its direction is any, so that x
probes the lists whose planes are at most `reach` times that far away; a reach of
sqrt(dim) or more probes all lists that can hold a neighbour at all, and recall is
complete. In a list, distances to the coded vectors come from tables per subspace;
as each coded vector keeps its coding error, the triangle inequality makes table
distance minus error a lower bound, and what passes is ranked again by the exact
cosine in double precision. Centroids and codes are fitted on a bounded sample for
each length; all vectors are indexed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, components, discard, importable, settle, spread

#: Vectors on which centroids and codes are fitted at most (in expectation).
MOST_FITTED = 16384
#: Coarse centroids, and second ones, at most.
MOST_LISTS = 2048
MOST_SECOND = 128
#: Doubles of the samples that the driver holds at a time; further lengths come in later rounds.
SAMPLE_CELLS = 4_000_000
SUBSPACES = 8
CODES = 32
#: How far a probe reaches, in typical distances.
REACH = 4.0
#: Members of one list that one task holds.
BLOCK = 4096
#: Queries compared with a block at a time, and pairs that are ranked again at a time.
STEP = 256
PAIRS = 1 << 16


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty one keeps its place."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, 1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def unit_rows(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are usable vectors (of dim components), and these rows scaled to length 1."""
    values = column.values if hasattr(column, "values") else column
    at = np.asarray(column.offsets).astype(np.int64)
    size = np.diff(at)
    there = np.asarray(column.is_valid()) & (size > 0)
    if dim is not None:
        there &= size == dim
    rows = np.flatnonzero(there)
    if not len(rows):
        return rows, np.zeros((0, dim or 0))
    flat = np.asarray(values.cast(pa.float64()).to_numpy(zero_copy_only=False), float)  # null becomes nan
    d = dim if dim is not None else int(size[rows[0]])
    x = flat[at[rows][:, None] + np.arange(d)]
    with np.errstate(over="ignore", invalid="ignore"):
        top = np.abs(x).max(1)
        good = np.isfinite(x).all(1) & (top > 0)
        x, rows = x[good], rows[good]
        x = x / top[good][:, None]
        x = x / np.sqrt((x * x).sum(1))[:, None]
    return rows, x


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c."""
    return (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T


def apart(c: np.ndarray) -> np.ndarray:
    """Distances between centroids."""
    return np.sqrt(np.maximum(squares(c, c), 0))


class Index:
    """Coarse centroids, second centroids and subspace codebooks for the vectors of one length; list number c * len(second) + s."""

    def __init__(self, sample: np.ndarray, lists: int, second: int = 1):
        self.dim = sample.shape[1]
        self.centroids = kmeans(sample, min(lists, len(sample)))
        residual = sample - self.centroids[squares(sample, self.centroids).argmin(1)]
        self.second = kmeans(residual, min(second, len(sample))) if second > 1 else np.zeros((1, self.dim))
        self.lists = len(self.centroids) * len(self.second)
        residual -= self.second[squares(residual, self.second).argmin(1)]
        self.parts = [p for p in np.array_split(np.arange(self.dim), min(SUBSPACES, self.dim))]
        self.books = [kmeans(residual[:, p], min(CODES, len(sample)), 6) for p in self.parts]
        self.between, self.between_second = apart(self.centroids), apart(self.second)

    def centroid(self, lists):
        """The points around which lists are."""
        return self.centroids[lists // len(self.second)] + self.second[lists % len(self.second)]

    def nearest(self, x):
        """The list of each vector, and its squared distances to the coarse centroids."""
        d = squares(x, self.centroids)
        near = d.argmin(1)
        return near * len(self.second) + squares(x - self.centroids[near], self.second).argmin(1), d

    def encode(self, x, near):
        """Codes of the residuals and the distance between each vector and its code."""
        residual = x - self.centroid(near)
        codes, err = np.zeros((len(x), len(self.parts)), np.uint8), np.zeros(len(x))
        for k, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            r = residual[:, p]
            d = (r * r).sum(1)[:, None] + (book * book).sum(1) - 2 * r @ book.T
            codes[:, k] = d.argmin(1)
            err += ((r - book[codes[:, k]]) ** 2).sum(1)
        return codes, np.sqrt(err)

    def probes(self, near, d, x, radius, reach=math.inf):
        """Pairs (vector, list) of all lists whose planes are near enough, sorted."""
        far = radius * min(1.0, reach / math.sqrt(self.dim))

        def within(d, own, between):
            gap = d - d[np.arange(len(own)), own][:, None]  # 2 * distance to the plane between * distance of the centroids
            return np.nonzero(gap <= 2 * between[own] * far + 1e-9)

        who, coarse = within(d, near // len(self.second), self.between)
        if len(self.second) == 1:
            return who, coarse
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a in range(0, len(who), 1 << 14):
            w, c = who[a : a + (1 << 14)], coarse[a : a + (1 << 14)]
            d2 = squares(x[w] - self.centroids[c], self.second)
            i, s = within(d2, d2.argmin(1), self.between_second)
            out.append((w[i], c[i] * len(self.second) + s))
        return tuple(np.concatenate(z) for z in zip(*out, strict=True))

    def tables(self, x, centroid):
        """Squared distance of each query's residual to each code, by subspace."""
        r = x - centroid
        return [((r[:, p][:, None] - book[None]) ** 2).sum(2) for p, book in zip(self.parts, self.books, strict=True)]


def _assign(shared, radius, reach):
    """Rows (vec_id, sign, weight, embedding) with their list, code, coding error, unit vector and the lists they probe."""

    def run(batches):
        indexes = shared.value
        for b in batches:
            for first, index in indexes:
                rows, x = unit_rows(b.column("embedding"), index.dim)
                for a in range(0, len(rows), 2048):
                    part, y = rows[a : a + 2048], x[a : a + 2048]
                    near, d = index.nearest(y)
                    codes, err = index.encode(y, near)
                    which, lists = index.probes(near, d, y, radius, reach)
                    cut = np.cumsum(np.bincount(which, minlength=len(part)))[:-1]
                    own = b.take(pa.array(part))
                    yield pa.RecordBatch.from_arrays(
                        [own.column("vec_id"), own.column("sign"), own.column("weight"), pa.array((first + near).astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err), pa.array([v.tobytes() for v in y], pa.binary()), pa.array([p.astype(np.int32) for p in np.split(first + lists, cut)], pa.list_(pa.int32()))],
                        names=["vec_id", "sign", "weight", "list", "code", "err", "vec", "probes"],
                    )

    return run


PLACED = "vec_id long, sign long, weight long, list int, code binary, err double, vec binary, probes array<int>"
FOUND = "u long, sign long, weight long, v long, n long"


def ranked(x, vec, i, j, cosine):
    """Which candidate pairs have the cosine, in double precision."""
    return np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", x[i[a : a + PAIRS]], vec[j[a : a + PAIRS]]) >= cosine for a in range(0, len(i), PAIRS))])


class _Block:
    """The members of one block of a list."""

    def __init__(self, rows):
        ids, sign, weight, code, err, vec, probes = zip(*rows, strict=True)
        self.ids, self.sign, self.weight, self.err = (np.array(x) for x in (ids, sign, weight, err))
        self.code = np.frombuffer(b"".join(code), np.uint8).reshape(len(ids), -1)
        self.vec = np.frombuffer(b"".join(vec), float).reshape(len(ids), -1)
        self.comp = np.arange(len(ids))
        # pairs (member, list that it probes) as numbers
        self.lists = 1 + max((max(p) for p in probes if len(p)), default=0)
        self.asks = np.sort(np.repeat(np.arange(len(ids)), [len(p) for p in probes]) * self.lists + np.array([x for p in probes for x in p], np.int64))

    def probed(self, j, lists):
        """Whether member j probes the list."""
        key = j * self.lists + lists
        there = self.asks[np.minimum(np.searchsorted(self.asks, key), len(self.asks) - 1)] == key
        return there & (lists < self.lists)


def _compare(shared, cosine, radius):
    """Keys (list, block), members before queries: links per query, and per member whose own probes miss the query's list; and links of a spanning forest."""

    def run(batches):
        first, indexes = np.array([f for f, _ in shared.value]), [i for _, i in shared.value]
        key, members, block, todo = None, [], None, []

        def flush():
            nonlocal todo
            if not todo or block is None:
                todo = []
                return
            at = int(np.searchsorted(first, key[0], "right")) - 1
            index, edges, counts = indexes[at], [], []
            centroid = index.centroid(np.array(key[0] - first[at]))
            for a in range(0, len(todo), STEP):
                ids, sign, weight, vec, home = zip(*todo[a : a + STEP], strict=True)
                q, sign, weight = np.array(ids), np.array(sign), np.array(weight)
                x = np.frombuffer(b"".join(vec), float).reshape(len(q), -1)
                d = np.zeros((len(q), len(block.ids)))
                for k, table in enumerate(index.tables(x, centroid)):
                    d += table[:, block.code[:, k]]
                reach = radius + block.err + 1e-7
                i, j = np.nonzero(d <= reach * reach)
                other = (q[i] != block.ids[j]) | (sign[i] != block.sign[j])
                i, j = i[other], j[other]
                hit = ranked(x, block.vec, i, j, cosine)
                i, j = i[hit], j[hit]
                n = np.bincount(i, block.weight[j], len(q)).astype(np.int64)
                counts.extend((int(q[u]), int(sign[u]), int(weight[u]), int(n[u])) for u in np.flatnonzero(n))
                # the member doesn't find the query where it doesn't probe its list
                alone = ~block.probed(j, np.array(home, np.int64)[i])
                m = np.bincount(j[alone], weight[i[alone]], len(block.ids)).astype(np.int64)
                counts.extend((int(block.ids[u]), int(block.sign[u]), int(block.weight[u]), int(m[u])) for u in np.flatnonzero(m))
                links = np.bincount(i, minlength=len(q))
                at_q = np.r_[0, np.cumsum(links)]
                for u in np.flatnonzero(links).tolist():
                    roots = np.unique(block.comp[j[at_q[u] : at_q[u + 1]]])
                    edges.append((int(q[u]), int(block.ids[roots[0]])))
                    if len(roots) > 1:
                        edges.extend((int(block.ids[r]), int(block.ids[roots[0]])) for r in roots[1:])
                        block.comp[np.isin(block.comp, roots)] = roots[0]
            todo = []
            rows = [(u, None, None, v, None) for u, v in edges] + [(u, s, w, None, n) for u, s, w, n in counts]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["u", "sign", "weight", "v", "n"])

        for b in batches:
            for lst, blk, is_query, vid, sign, weight, code, err, vec, home, asked in zip(*(b.column(k).to_pylist() for k in ("list", "block", "is_query", "vec_id", "sign", "weight", "code", "err", "vec", "home", "probes")), strict=True):
                if (lst, blk) != key:
                    yield from flush()
                    key, members, block = (lst, blk), [], None
                if not is_query:
                    members.append((vid, sign, weight, code, err, vec, asked))
                elif members:
                    if block is None:
                        block = _Block(members)
                    todo.append((vid, sign, weight, vec, home))
            yield from flush()

    return run


def _copies(rows: DataFrame) -> DataFrame:
    """Of vectors that several rows have: vec_id, its rows k, the vector's rows m and least vec_id rep, and its two hashes."""
    by_id = rows.groupBy("sign", "other", "vec_id").agg(F.count("*").alias("k"))
    same = by_id.groupBy("sign", "other").agg(F.sum("k").alias("m"), F.min("vec_id").alias("rep")).where("m > 1")
    return settle(by_id.join(same, ["sign", "other"]))


def _found(rows: DataFrame, sizes: list[tuple[int, int]], cosine: float, reach: float, seed: int) -> DataFrame:
    """FOUND among rows (vec_id, sign, weight, embedding, dim) of the given lengths, each (dim, number of rows)."""
    spark, radius = rows.sparkSession, math.sqrt(max(0.0, 2 - 2 * cosine))
    share = F.broadcast(spark.createDataFrame([(d, int(min(1.0, MOST_FITTED / n) * (1 << 30))) for d, n in sizes], "dim int, share int"))
    rows = rows.join(share, "dim")  # rows of other lengths go
    picked = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < F.col("share")).select("vec_id", "sign", "embedding").toArrow().sort_by([("vec_id", "ascending"), ("sign", "ascending")])
    column, indexes, at = picked["embedding"].combine_chunks() if picked.num_rows else pa.array([], pa.list_(pa.float64())), [], 0
    for dim, n in sizes:
        sample = unit_rows(column, dim)[1]
        if len(sample):
            lists = min(MOST_LISTS, max(1, round(math.sqrt(n))))
            indexes.append((at, Index(sample, lists, min(MOST_SECOND, -(-n // (lists * BLOCK))))))
            at += indexes[-1][1].lists
    if not indexes:
        return spark.createDataFrame([], FOUND)
    shared = spark.sparkContext.broadcast(indexes)
    placed = settle(spread(rows).select("vec_id", "sign", "weight", "embedding").mapInArrow(_assign(shared, radius, reach), PLACED))
    # lists that are long are dealt to blocks
    counts = settle(placed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    side = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    no = F.lit(None)
    member = placed.join(side, "list").select("list", F.pmod(F.xxhash64("vec_id", "sign"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("is_query"), "vec_id", "sign", "weight", "code", "err", "vec", no.cast("int").alias("home"), "probes")
    asked = placed.select(F.explode("probes").alias("list"), F.col("list").alias("home"), "vec_id", "sign", "weight", "vec").join(side, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    query = asked.select("list", "block", F.lit(1).alias("is_query"), "vec_id", "sign", "weight", no.cast("binary").alias("code"), no.cast("double").alias("err"), "vec", "home", no.cast("array<int>").alias("probes"))
    found = settle(member.unionByName(query).repartition("list", "block").sortWithinPartitions("list", "block", "is_query").mapInArrow(_compare(shared, cosine, radius), FOUND))
    discard(placed)
    return found


def near_vectors(vectors: DataFrame, cosine: float = 0.95, reach: float = REACH, seed: int = 3) -> DataFrame:
    """One row per vec_id: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components, and
    rows without a vec_id, link with nothing; vectors link with those of their own
    length. Rows that share a vec_id are one vector, whose links are added up:
    equal ones don't link with each other, different ones do where they are near.
    A row without a vec_id makes a row without one. An empty table gives no rows;
    other columns are ignored.
    """
    spark = vectors.sparkSession
    importable(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    ids = rows.groupBy("vec_id").agg(F.count("*").alias("rows"))
    usable = rows.where("embedding is not null and vec_id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(embedding, x -> x <> 0)")
    usable = usable.select("vec_id", F.xxhash64("embedding").alias("sign"), F.xxhash64("embedding", F.lit(seed)).alias("other"), "embedding", F.size("embedding").alias("dim"))
    copies = _copies(usable)
    same = copies.select("sign", "other", "m", "rep").distinct()
    few = copies.count() <= BROADCAST_ROWS
    tagged = usable.join(F.broadcast(same) if few else same, ["sign", "other"], "left")
    once = tagged.where("m is null").unionByName(tagged.where("vec_id = rep").dropDuplicates(["sign", "other"])) if copies.head(1) else tagged
    once = once.select("vec_id", "sign", F.coalesce("m", F.lit(1)).cast("long").alias("weight"), "embedding", "dim")
    sizes = sorted((r["dim"], r["n"]) for r in usable.groupBy("dim").agg(F.count("*").alias("n")).where("n > 1").collect())
    found, part, cells = spark.createDataFrame([], FOUND), [], 0
    for dim, n in [*sizes, (None, 0)]:
        size = min(n, MOST_FITTED) * (dim or 0)
        if part and (dim is None or cells + size > SAMPLE_CELLS):
            found, part, cells = found.unionByName(_found(once, part, cosine, reach, seed)), [], 0
        part, cells = [*part, (dim, n)], cells + size
    links = found.where("n is not null").groupBy(F.col("u").alias("rep"), "sign", "weight").agg(F.sum("n").alias("n"))
    own = copies.join(links, ["rep", "sign"], "left").select("vec_id", (F.col("k") * (F.col("m") - F.col("k") + F.coalesce("n", F.lit(0)))).alias("n"))
    links = links.where("weight = 1").select(F.col("rep").alias("vec_id"), "n").unionByName(own).groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    # a vec_id of several different vectors joins their classes
    several = copies.join(ids, "vec_id").where("rows > k").select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))
    comp = settle(components(found.where("n is null").select("u", "v").unionByName(several)))
    member = copies.select("vec_id", "rep").join(comp, F.col("id") == F.col("rep"), "left").select("vec_id", F.coalesce("component", "rep").alias("component"))
    comp = comp.select(F.col("id").alias("vec_id"), "component").unionByName(member).groupBy("vec_id").agg(F.min("component").alias("component"))
    out = ids.join(links, "vec_id", "left").join(comp, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.col("component") == F.col("vec_id"), F.lit(True)).alias("kept"))
