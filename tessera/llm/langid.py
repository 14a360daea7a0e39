"""Language identification (operator 6): interpolated Kneser-Ney character models.

A text is lower-cased, every run of other characters than letters becomes one
blank, and each character is coded in 12 bits, so that five of them are one exact
60-bit key. All training documents are counted on the executors, which also derive
the absolute discounts of each language from all counts. The model keeps every
five-gram, in parts by the two characters before the last: one part holds all that
a five-gram and its back-offs of orders 5 to 3 need. For each part the driver
derives continuation counts and back-off weights, and stores the finished
interpolated log-probabilities of every order in sorted arrays of key hashes,
one column per language. Scoring looks each character's five-gram up in its part
and goes to lower orders for those that are missing; a worker holds one part at a
time. The lowest cross-entropy per character wins; a threshold per language, from
all its training texts, rejects.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, importable, mixed, pieces, settle, spread
from .learning import fold

ORDER = 5
BITS = 12
MASK = [np.uint64((1 << (BITS * n)) - 1) for n in range(ORDER + 1)]
PAD, BLANK = 1, 32
#: Counted five-grams times languages of a part of the model, which the driver builds and a worker holds at a time.
PART_CELLS = 8_000_000
#: Languages that are scored side by side.
SIDE = 16
#: Bytes of text that a worker scores with one part before it loads the next.
CHUNK = 16 << 20
#: Five-grams that a counting task holds before it sends them on.
HELD_GRAMS = 2_000_000

_letters: list = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, each after ORDER - 1 pads, and where each text's pads begin (with the end)."""
    lengths, parts = [0], []
    for t in texts:
        t = t.lower()
        parts.append(t)
        lengths.append(len(t) + 1)
    cp = np.frombuffer((" " + " ".join(parts)).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum(lengths)  # place of the blank before each text, and the end
    ok = letters()[cp]
    code = np.where(ok, np.where(cp < 3072, cp, 3072 + cp % 1024), BLANK).astype(np.uint64)
    first = np.zeros(len(cp), bool)
    first[ends[:-1]] = True
    keep = ok | np.r_[True, ok[:-1]] | first
    kept = np.cumsum(keep)
    at = kept[ends[:-1]] - 1  # the blanks before the texts, among what is kept
    code = code[keep]
    # pads before each text's blank
    pads = ORDER - 1
    out = np.insert(code, np.repeat(at, pads), np.uint64(PAD))
    begins = at + pads * np.arange(len(at))
    return out, np.r_[begins, len(out)].astype(np.int64)


def grams(code: np.ndarray) -> np.ndarray:
    """The key of the five-gram that ends at each code."""
    k = code.copy()
    for n in range(1, ORDER):
        k[n:] |= code[:-n] << np.uint64(BITS * n)
    return k


def _count(batches):
    held: dict[str, list] = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            keys = np.concatenate([k for k, _ in parts])
            n = np.concatenate([c for _, c in parts])
            u, inv = np.unique(keys, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.astype(np.int64)), pa.array(np.bincount(inv, n, len(u)).astype(np.int64))], names=["lang", "gram", "n"])
        held.clear()

    for b in pieces(batches):
        for lang in pc.unique(b.column("lang")).to_pylist():
            rows = b.filter(pc.equal(b.column("lang"), lang))
            code, begins = coded(rows.column("text").to_pylist())
            keys = grams(code)[code != PAD]
            u, n = np.unique(keys, return_counts=True)
            held.setdefault(lang, []).append((u, n))
            size += len(u)
        if size > HELD_GRAMS:
            yield from flush()
            size = 0
    yield from flush()


class Table:
    """Sorted key hashes with a row of values each; an index over their leading bits starts a search."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        h = mixed(keys)
        o = np.argsort(h)
        self.hashes, self.rows = h[o], rows[o]
        self.bits = max(1, min(22, int(len(keys)).bit_length() + 1))
        self.shift = np.uint64(64 - self.bits)
        self.first = np.searchsorted(self.hashes, np.arange(1 << self.bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.hashes = np.r_[self.hashes, np.uint64(2**64 - 1)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        h = mixed(keys)
        at = self.first[(h >> self.shift).astype(np.int64)]
        got = self.hashes[at]
        todo = np.flatnonzero(got < h)
        while len(todo):
            at[todo] += 1
            got[todo] = now = self.hashes[at[todo]]
            todo = todo[now < h[todo]]
        hit = (got == h) & (at < len(self.hashes) - 1)
        return np.where(hit, at, -1)


def part_of(keys, parts: int):
    """The part of the model that has a five-gram: by the two characters before the last, so that orders 5 to 3 and their contexts stay together. Keys are an array or a column."""
    if isinstance(keys, np.ndarray):
        return ((keys >> np.uint64(BITS) & MASK[2]) * np.uint64(2654435761) >> np.uint64(16)) % np.uint64(parts)
    return F.pmod(F.shiftright(F.shiftright(keys, BITS).bitwiseAND(F.lit(int(MASK[2]))) * F.lit(2654435761), 16), F.lit(parts))


class Whole:
    """What the parts of a model have to know of all counts: how many n-grams of orders 5 to 3 occur once and twice, the counts of order 2, the alphabet."""

    def __init__(self, counts: DataFrame):
        def level(order):
            return levels[order].groupBy("lang").agg(F.lit(order).alias("order"), F.count("*").alias("key"), F.count_if(F.col("c") == 1).alias("c"), F.count_if(F.col("c") == 2).alias("twice"))

        levels = {ORDER: counts.select("lang", F.col("gram").alias("key"), F.col("n").alias("c"))}
        for order in range(ORDER - 1, 1, -1):  # continuation counts: distinct characters to the left
            levels[order] = levels[order + 1].groupBy("lang", F.col("key").bitwiseAND(F.lit(int(MASK[order]))).alias("key")).agg(F.count("*").alias("c"))
        out = levels[2].select("lang", F.lit(2).alias("order"), "key", "c", F.lit(0).cast("long").alias("twice"))
        for order in range(ORDER, 2, -1):
            out = out.unionByName(level(order))
        t = out.toArrow()
        few = t.filter(pc.equal(t["order"], 2)).sort_by([("lang", "ascending"), ("key", "ascending")])
        rest = t.filter(pc.greater(t["order"], 2)).to_pylist()
        self.once = {(r["order"], r["lang"]): (r["c"], r["twice"]) for r in rest}
        self.size = {r["lang"]: r["key"] for r in rest if r["order"] == ORDER}
        keys, n = few["key"].to_numpy().astype(np.uint64), few["c"].to_numpy().astype(float)
        langs = few["lang"].to_pylist()
        ends = np.r_[np.flatnonzero([a != b for a, b in zip(langs, langs[1:], strict=False)]) + 1, len(langs)] if langs else []
        self.pairs, a = {}, 0
        for e in ends:
            self.pairs[langs[a]], a = (keys[a:e], n[a:e]), int(e)
        self.uniform = 1.0 / (len(np.unique(keys & MASK[1])) + 1)


class Model:
    """Interpolated Kneser-Ney models of some languages over the union of their n-grams.

    counts are all five-grams of each language, or those of one part if whole is given.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], whole: Whole | None = None):
        self.langs = sorted(counts)
        n_lang = len(self.langs)
        per: list[list] = [[None] * n_lang for _ in range(ORDER + 1)]  # (keys, counts) by order and language
        for j, lang in enumerate(self.langs):
            keys, n = counts[lang]
            o = np.argsort(keys)
            per[ORDER][j] = (keys[o], n[o].astype(float))
            for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters to the left
                u, c = np.unique(per[order + 1][j][0] & MASK[order], return_counts=True)
                per[order][j] = whole.pairs[lang] if whole and order == 2 else (u, c.astype(float))
        union = [None] + [np.unique(np.concatenate([per[o][j][0] for j in range(n_lang)])) if n_lang else np.zeros(0, np.uint64) for o in range(1, ORDER + 1)]
        self.uniform = whole.uniform if whole else 1.0 / (len(union[1]) + 1)
        self.tables: list = [None]
        self.backs: list = [None]
        below = None
        for order in range(1, ORDER + 1):
            keys = union[order]
            group = np.zeros(len(keys), np.uint64) if order == 1 else self._context(keys, order)
            ctx_keys = np.unique(group)
            probs, backs = np.zeros((len(keys), n_lang)), np.ones((len(ctx_keys), n_lang))
            lower = np.full((len(keys), n_lang), self.uniform) if order == 1 else below[np.searchsorted(union[order - 1], keys & MASK[order - 1])]
            for j, lang in enumerate(self.langs):
                k, c = per[order][j]
                n1, n2 = whole.once[order, lang] if whole and order > 2 else ((c == 1).sum(), (c == 2).sum())
                d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                g = np.searchsorted(ctx_keys, np.zeros(len(k), np.uint64) if order == 1 else self._context(k, order))
                total, types = np.bincount(g, c, len(ctx_keys)), np.bincount(g, minlength=len(ctx_keys))
                seen = total > 0
                backs[seen, j] = d * types[seen] / total[seen]
                if len(k):
                    probs[np.searchsorted(keys, k), j] = np.maximum(c - d, 0) / total[g]
            probs += backs[np.searchsorted(ctx_keys, group)] * lower
            below = probs
            self.tables.append(Table(keys, np.log(probs).astype(np.float32)))
            self.backs.append(Table(ctx_keys, np.log(backs).astype(np.float32)))

    @staticmethod
    def _context(keys: np.ndarray, order: int) -> np.ndarray:
        return keys >> np.uint64(BITS)

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """Log-probability of each five-gram's last character, by language."""
        at = self.tables[ORDER].find(keys)
        out = self.tables[ORDER].rows[np.maximum(at, 0)] if len(self.tables[ORDER].rows) else np.zeros((len(keys), len(self.langs)), np.float32)
        todo = np.flatnonzero(at < 0)
        if len(todo):
            sub = keys[todo]
            acc = np.zeros((len(todo), len(self.langs)), np.float32)
            left = np.arange(len(todo))
            for order in range(ORDER, 0, -1):
                k = sub[left] & MASK[order]
                if order < ORDER:
                    at = self.tables[order].find(k)
                    hit = at >= 0
                    acc[left[hit]] += self.tables[order].rows[at[hit]]
                    left, k = left[~hit], k[~hit]
                if not len(left):
                    break
                ctx = np.zeros(len(k), np.uint64) if order == 1 else k >> np.uint64(BITS)
                at = self.backs[order].find(ctx)
                hit = at >= 0
                acc[left[hit]] += self.backs[order].rows[at[hit]]
            acc[left] += np.float32(np.log(self.uniform))
            out[todo] = acc
        return out

    def sums(self, keys: np.ndarray, n: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Log-probability of texts of n characters by language, of all their characters or of those at some places."""
        begin = np.r_[0, np.cumsum(n)]
        if at is not None:
            begin, keys = np.searchsorted(at, begin), keys[at]
        out = np.zeros((len(n), len(self.langs)))
        full = begin[1:] > begin[:-1]
        if len(keys):
            out[full] = np.add.reduceat(self.logs(keys), begin[:-1][full], axis=0)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text by language, and the number of characters scored."""
        keys, n = characters(texts)
        return -self.sums(keys, n) / np.maximum(n, 1)[:, None], n


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The five-grams of all scored characters, and their number in each text."""
    code, begins = coded(texts)
    keys, real = grams(code), code != PAD
    # the blank before a text is context, not scored
    real[begins[:-1] + ORDER - 1] = False
    return keys[real], np.add.reduceat(real, begins[:-1]).astype(np.int64)


class Models:
    """The models of all languages, in broadcast parts: (first language, end, part, parts, model)."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.parts: list[tuple] = []
        self.limits = np.full(len(langs), np.inf)

    def entropies(self, groups: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Cross-entropies and numbers of characters of each group of texts; a part is loaded once for all groups."""
        held = [characters(texts) for texts in groups]
        sums = [np.zeros((len(n), len(self.langs))) for _, n in held]
        for a, b, k, parts, shared in self.parts:
            model = shared.value
            for (keys, n), out in zip(held, sums, strict=True):
                out[:, a:b] += model.sums(keys, n, np.flatnonzero(part_of(keys, parts) == k) if parts > 1 else None)
            if len(self.parts) > 1:  # else it would stay for good
                del model
                shared.__dict__.pop("_value", None)
        return [(-out / np.maximum(n, 1)[:, None], n) for (_, n), out in zip(held, sums, strict=True)]

    def chunks(self, batches):
        """Lists of slices of batches that are scored together."""
        held, size = [], 0
        for b in pieces(batches, most=(4 << 20) // max(4, min(SIDE, len(self.langs)))):
            held.append(b)
            size += b.nbytes
            if len(self.parts) < 2 or size >= CHUNK:
                yield held
                held, size = [], 0
        if held:
            yield held


def _has_letter(texts: list[str]) -> np.ndarray:
    return np.array([any(map(str.isalpha, t)) for t in texts], bool)


def _predict(m: Models):
    def run(batches):
        langs = np.array([*m.langs, "und"], object)
        for held in m.chunks(batches):
            groups = [[t or "" for t in b.column("text").to_pylist()] for b in held]
            got = m.entropies(groups) if m.langs else [None] * len(held)
            for b, texts, scored in zip(held, groups, got, strict=True):
                some = _has_letter(texts)
                best, score, ce = np.full(len(texts), len(m.langs)), np.zeros(len(texts)), np.full(len(texts), np.nan)
                if m.langs and some.any():
                    e, n = scored
                    pick = e.argmin(1)
                    best = np.where(some, pick, best)
                    low = e[np.arange(len(texts)), pick]
                    # evidence of at most 50 characters, so that the score stays a matter of degree
                    gap = np.exp(-(e - low[:, None]) * np.minimum(n, 50)[:, None])
                    score = np.where(some, 1 / gap.sum(1), 0.0)
                    ce = np.where(some, low, np.nan)
                reject = ~some | ~(np.nan_to_num(ce, nan=np.inf) <= np.r_[m.limits, -np.inf][best])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs[best], pa.string()), pa.array(score), pa.array(ce, mask=np.isnan(ce)), pa.array(reject)], names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    return run


def _own(m: Models):
    """The cross-entropy of texts of 20 characters and more in their own language."""
    at = {lang: j for j, lang in enumerate(m.langs)}

    def run(batches):
        for held in m.chunks(batches):
            for b, (e, n) in zip(held, m.entropies([b.column("text").to_pylist() for b in held]), strict=True):
                long = np.flatnonzero(n >= 20)
                own = np.array([at[x] for x in b.column("lang").to_pylist()])[long]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(e[long, own])], names=["j", "e"])

    return run


def train(docs: DataFrame, modulus: int = 4, held: int = 2) -> Models:
    """Counts every document with a language outside the held-out fold and builds the models."""
    spark = docs.sparkSession
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(modulus) != held))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    models = Models(sorted(sizes))
    if not sizes:
        return models
    counts = settle(rows.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    whole = Whole(counts)
    for a in range(0, len(models.langs), SIDE):
        side = models.langs[a : a + SIDE]
        parts = -(-sum(whole.size[x] for x in side) * len(side) // PART_CELLS)
        for k in range(parts):
            t = counts.where(F.col("lang").isin(side) & (part_of(F.col("gram"), parts) == k)).toArrow()
            keys, n, code = t["gram"].to_numpy().astype(np.uint64), t["n"].to_numpy(), pc.index_in(t["lang"], pa.array(side)).to_numpy()
            model = Model({x: (keys[code == j], n[code == j]) for j, x in enumerate(side)}, whole)
            models.parts.append((a, a + len(side), k, parts, spark.sparkContext.broadcast(model)))
            del t, keys, n, code, model
    discard(counts)
    own = rows.select("lang", "text").mapInArrow(_own(models), "j int, e double").groupBy("j").agg(F.count("*").alias("n"), F.avg("e").alias("mean"), F.stddev_pop("e").alias("spread"))
    for r in own.where("n >= 5").collect():
        models.limits[r["j"]] = r["mean"] + 5 * r["spread"] + 0.25
    return models


def identify(docs: DataFrame, train_docs: DataFrame | None = None, modulus: int = 4, held: int = 2) -> DataFrame:
    """The language of every whole text: doc_id, held_out, lang_pred, score, cross_entropy, rejected.

    Every lang value of a training row is learned. lang_pred is a learned language,
    or `und` for a null text or one without a letter (score 0, rejected). Ties go to
    the first language in order. Without training rows all are `und`. Repeated rows
    are predicted row by row, a row without a doc_id like any other; a text of any
    length is read whole. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    importable(spark)
    t = docs if train_docs is None else train_docs
    t = spread(t.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    models = train(t, modulus, held)
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold(modulus) == held).alias("held_out")))
    return rows.mapInArrow(_predict(models), "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")
