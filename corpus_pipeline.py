"""The corpus pipeline: quality, near duplicates, repeats, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept;
all but the last return the columns of documents. SQL can't express the learned
first stage, so no stage has an oracle; tests hold each against brute force.

Rows are judged one by one: where several rows have a doc_id, each is kept or goes
for its own text. Null and empty texts, and rows without a doc_id, are rows like
others but for what a stage says of them; texts of any length are read whole; an
empty table stays empty; further columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, settle, settled_alone, table
from tessera.llm.decontamination import find_leaks
from tessera.llm.jaccard import jaccard_components
from tessera.llm.packing import pack
from tessera.llm.quality import keep_good
from tessera.llm.suffixes import PASSAGE, without_repeats


def _numbered(docs: DataFrame) -> DataFrame:
    """(row, doc): each row as a struct, and its number, which equal (doc_id, text) share and which is null without a doc_id."""
    row = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return docs.select(row.alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def _texts(rows: DataFrame) -> DataFrame:
    """The texts as the operators read them, under their rows' numbers."""
    return rows.select(F.col("row").alias("doc_id"), F.col("doc.text").cast("string").alias("text"))


def _sized(df: DataFrame) -> DataFrame:
    """df to be broadcast while it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows but those of the given numbers."""
    return rows.join(_sized(settle(gone.select("row").distinct())), "row", "left_anti")


def _once(rows: DataFrame) -> DataFrame:
    """One of each set of rows equal in doc_id and text: of equal ones, any stands for all."""
    again = settle(rows.where("row is not null").groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row"))
    if again.isEmpty():
        return rows
    again = _sized(again)
    return rows.join(again, "row", "left_anti").unionByName(rows.join(again, "row").dropDuplicates(["row"]))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (9) doesn't reject; null and empty texts have the score of no evidence."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join (7): that of the smallest doc_id, of several such the one of the smallest number.

    Texts without words and rows without a doc_id are in no class and stay, but of
    rows that are equal in doc_id and text one stays.
    """
    rows = _numbered(docs)
    found = settle(jaccard_components(_texts(rows)).where("doc_id <> component_id").select(F.col("doc_id").alias("row"), F.col("component_id").alias("class")))
    member = settle(found.unionByName(found.select(F.col("class").alias("row"), "class")).distinct())
    named = rows.select("row", F.col("doc.doc_id").cast("long").alias("name")).join(_sized(member), "row")
    first = named.groupBy("class").agg(F.min(F.struct("name", "row")).alias("first")).select("class", F.col("first.row").alias("stays"))
    return _once(_without(rows, member.join(first, "class").where("row <> stays"))).select("doc.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that suffix-array dedup (3) removes: those of strings of PASSAGE bytes, some 40 words, that are there twice. A null text stays null.

    A document that holds a benchmark item keeps its text: the next stage takes it
    out as a whole, and could not tell it by what a cut would leave of the item.
    """
    rows, spared = _numbered(docs), "spared"
    while spared in docs.columns:
        spared += "_"
    leaks = _leaks(spark, rows, sf_dir).withColumn(spared, F.lit(True))
    flagged = rows.join(_sized(leaks), "row", "left").select("doc.*", spared)
    return without_repeats(flagged, PASSAGE, spared).drop(spared)


def _leaks(spark: SparkSession, rows: DataFrame, sf_dir: str) -> DataFrame:
    """The numbers of rows that hold a benchmark item."""
    found = find_leaks(_texts(rows), table(spark, sf_dir, "benchmark"))
    return settle(found.where("doc_id is not null").select(F.col("doc_id").alias("row")).distinct())


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (1); rows without a doc_id stay."""
    rows = _numbered(docs)
    return _without(rows, _leaks(spark, rows, sf_dir)).select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed (5): a null or empty text is one id, repeated rows are packed row by row."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontaminate", decontaminate), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settled_alone(docs, lambda kept, stage=stage: stage(spark, kept, sf_dir))
    return docs
