"""Merkle manifest of a dataset (operator 11): an external-memory node store.

Rows become leaf digests in one pass over their texts; from there on only digests
move. The leaves are sorted by ranges of (tree, order), so that a tree of very many
rows is many sorted runs, and each gets its coordinate from the counts of the runs
before it. The node store is Parquet, one partition a level, whose rows are the runs
of up to three nodes that have one parent, sorted by (tree, run): each level is
written from the one before, which it reads once. Proofs are taken from the top
down by merge-scans: the runs of a level meet the paths of their parents at the same
coordinate (tree, run), and every node's path is its siblings and its parent's path.

All is native; no tree, level or list of digests is ever in one task or the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, scratch_dir, settle

#: Nodes that have one parent.
FAN = 3
#: Runs of a level that one task holds.
RUNS = 20_000
STEP = "array<struct<left: string, right: string>>"


def digest(text: Column) -> Column:
    """The hash of all nodes: lowercase hex sha256."""
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as a leaf holds it: its length in UTF-8 bytes, a colon and itself, or - for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return digest(F.concat(*map(field, values)))


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def proof_digest(path: Column) -> Column:
    """The hash of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


@dataclass(frozen=True)
class Manifest:
    """Node stores: `trees` up to the root of each tree, `top` from these to the root of all.

    A store is the folder of a Parquet table partitioned by level, of (tree, run,
    n, nodes): nodes are (at, digest, row) with coordinate `at` in their level, n is
    the number of the tree's nodes there. heights: the levels above the leaves. row:
    what a leaf carries.
    """

    spark: SparkSession
    trees: str
    top: str
    heights: tuple[int, int]
    row: str


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree, order..., digest, row) with their place `at` in their tree and its number n of rows."""
    by = ["tree", *order]
    runs = settle(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("tree", "digest", "row", F.monotonically_increasing_id().alias("id")))
    runs = runs.withColumn("part", F.shiftright("id", 33))
    tree = Window.partitionBy("tree")
    counts = runs.groupBy("tree", "part").agg(F.min("id").alias("low"), F.count("*").alias("c"))
    before = F.sum("c").over(tree.orderBy("part")) - F.col("c")
    starts = settle(counts.select("tree", "part", "low", before.alias("before"), F.sum("c").over(tree).alias("n")))
    small = starts.count() <= BROADCAST_ROWS  # rows: sorted runs and trees
    out = runs.join(F.broadcast(starts) if small else starts, ["tree", "part"])
    return out.select("tree", (F.col("id") - F.col("low") + F.col("before")).alias("at"), "n", "digest", "row")


def _height(n: int) -> int:
    """Levels above n leaves."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def _level(spark: SparkSession, path: str, k: int, row: str) -> DataFrame:
    return spark.read.schema(f"tree string, run long, n long, nodes array<struct<at: long, digest: string, row: {row}>>").parquet(f"{path}/level={k}")


def _stored(nodes: DataFrame, path: str, k: int, parts: int) -> None:
    """Writes nodes (tree, at, n, digest, row) as the runs of level k."""
    runs = nodes.withColumn("run", F.expr(f"at div {FAN}")).repartition(parts, "tree", "run").groupBy("tree", "run").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "digest", "row"))).alias("nodes"))
    runs.sortWithinPartitions("tree", "run").write.option("compression", "zstd").parquet(f"{path}/level={k}")


def _grown(rows: DataFrame, order: list[str], path: str) -> tuple[int, str]:
    """Writes the node store of rows (tree, order..., digest, row), level by level; its height and the type of row."""
    spark, row = rows.sparkSession, rows.schema["row"].dataType.simpleString()
    rows = settle(rows)
    leaves = _placed(rows, order)
    total, trees, largest = leaves.agg(F.count("*"), F.count_if(F.col("at") == 0), F.max("n")).first()
    height = _height(largest or 0)
    nodes = leaves
    for k in range(height + 1):
        _stored(nodes, path, k, 1 + (total // FAN ** (k + 1) + trees) // RUNS)
        parent = digest(F.array_join(F.transform("nodes", lambda x: x["digest"]), ""))
        # FAN times as many nodes below: a whole number of nodes, the last run may be short
        nodes = _level(spark, path, k, row).where("n > 1").select("tree", F.col("run").alias("at"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), parent.alias("digest"), F.lit(None).cast(row).alias("row"))
    discard(rows)
    return height, row


def _paths(spark: SparkSession, path: str, height: int, row: str, roots: DataFrame) -> DataFrame:
    """The leaves of a store with their paths: tree, at, digest, row, steps and the columns of roots.

    roots: tree, height, steps (from the tree's root on) and what every leaf of the
    tree shall carry.
    """
    told = [c for c in roots.columns if c not in ("tree", "height", "steps")]
    above = None
    for k in range(height, -1, -1):
        own = roots.where(F.col("height") == k).select("tree", F.lit(0).cast("long").alias("run"), "steps", *told)
        above = own if above is None else own.unionByName(above.select("tree", F.col("at").alias("run"), "steps", *told))
        met = _level(spark, path, k, row).join(above, ["tree", "run"])
        step = F.struct(*[F.array_join(F.transform(F.filter("nodes", keep), lambda x: x["digest"]), "").alias(side) for side, keep in (("left", lambda x: x["at"] < F.col("node.at")), ("right", lambda x: x["at"] > F.col("node.at")))])
        steps = F.when(F.col("n") > 1, F.concat(F.array(step).cast(STEP), "steps")).otherwise(F.col("steps"))
        above = met.select("*", F.explode("nodes").alias("node")).select("tree", "node.at", "node.digest", "node.row", steps.alias("steps"), *told)
        if k and k % 4 == 0:
            above = settle(above.drop("row")).withColumn("row", F.lit(None).cast(row))
    return above


def manifest(df: DataFrame, columns: list[str], by: str, order: str, carry: dict[str, Column] | None = None) -> Manifest:
    """Builds the trees of df: one of each value of `by`, its leaves the rows' digests over `columns`, ascending by (order, digest), and one of the trees' roots, ascending by `by`.

    Nulls in any column are hashed as such; a null `by` is a tree like others, the
    first; null orders come first in their tree; rows of one order are in the order
    of their digests, so that equal rows are leaves next to each other. Texts of any
    length are hashed whole; an empty table has no nodes. carry: further columns, by
    name, that the leaves keep for proofs. Other columns are ignored, whatever their
    names.
    """
    spark = df.sparkSession
    trees, top = scratch_dir(spark), scratch_dir(spark)
    kept = F.struct(F.lit(0).alias("__"), *[c.alias(k) for k, c in (carry or {}).items()])
    tree = F.coalesce(F.concat(F.lit("1"), F.col(f"`{by}`").cast("string")), F.lit("0"))
    rows = df.select(tree.alias("tree"), F.col(f"`{order}`").alias("__order"), leaf_digest([F.col(f"`{c}`") for c in columns]).alias("digest"), kept.alias("row"))
    height, row = _grown(rows, ["__order", "digest"], trees)
    roots = None
    for k in range(height + 1):
        found = _level(spark, trees, k, row).where("n = 1").select(F.lit("").alias("tree"), F.col("tree").alias("__order"), F.col("nodes")[0]["digest"].alias("digest"), F.struct(F.col("tree").alias("of"), F.lit(k).alias("height")).alias("row"))
        roots = found if roots is None else roots.unionByName(found)
    top_height, _ = _grown(roots, ["__order"], top)
    return Manifest(spark, trees, top, (height, top_height), row)


def root_of(m: Manifest) -> DataFrame:
    """The root of all as one row (root); none for an empty table."""
    return _level(m.spark, m.top, m.heights[1], "struct<of: string, height: int>").where("n = 1").select(F.col("nodes")[0]["digest"].alias("root"))


def proofs(m: Manifest) -> DataFrame:
    """One row per leaf: what it carries, leaf, subroot (its tree's root), root, and path, the siblings to the left and right of each level from its tree's leaves to the root, as concatenated digests."""
    top = root_of(m).select(F.lit("").alias("tree"), F.lit(m.heights[1]).alias("height"), F.array().cast(STEP).alias("steps"), "root")
    roots = _paths(m.spark, m.top, m.heights[1], "struct<of: string, height: int>", top)
    roots = settle(roots.select(F.col("row.of").alias("tree"), F.col("row.height").alias("height"), "steps", F.col("digest").alias("subroot"), "root"))
    out = _paths(m.spark, m.trees, m.heights[0], m.row, roots)
    return out.select("row.*", F.col("digest").alias("leaf"), "subroot", "root", F.col("steps").alias("path")).drop("__")


#: What a document's leaf is made of.
DOCUMENT = ["doc_id", "source", "lang", "n_chars", "text"]


def verified_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A tree a source, by doc_id. Where 2 divides the unsigned crc32 of the decimal
    doc_id, the document is tampered with after the manifest was made: its text loses
    its line feeds. folded_root follows from the leaf as it then is and the siblings
    as they were; verified tells whether it is the root. Null texts stay, and rows
    without a doc_id aren't tampered with; for all else see manifest.
    """
    cut = F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))
    after = leaf_digest([cut if c == "text" else F.col(c) for c in DOCUMENT])
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & (F.instr("text", "\n") > 0)
    p = proofs(manifest(docs, DOCUMENT, "source", "doc_id", {"doc_id": F.col("doc_id").cast("long"), "bent": F.when(hit, after)}))
    out = p.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("bent", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
