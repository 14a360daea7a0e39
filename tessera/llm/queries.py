"""The queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .automata import remove_phrases
from .bitslices import top_products
from .common import table
from .decontamination import find_leaks
from .edits import count_edited, some_edits
from .jaccard import jaccard_components
from .langid import identify
from .merkle import verified_documents
from .oracles import ORACLE_SQL
from .packing import pack
from .quality import classify
from .radix import hard_negatives
from .suffixes import PASSAGE, remove_repeats
from .toxicity import score_toxicity
from .vectors import near_vectors


def op5_packing(spark, sf_dir):
    """Every document, packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def op1_decontamination(spark, sf_dir):
    """Every pair of a document and a benchmark item that it holds."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark, sf_dir):
    """Every document's toxicity."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_repeats(spark, sf_dir):
    """Every document without the bytes that repeats of 400 bytes cover; n_passage counts those that repeats of 200 bytes cover."""
    return remove_repeats(table(spark, sf_dir, "documents"), passage=PASSAGE)


def op4_phrases(spark, sf_dir):
    """Every document without the words that an earlier document's windows cover."""
    return remove_phrases(table(spark, sf_dir, "documents"))


def op6_langid(spark, sf_dir):
    """Every document's language."""
    return identify(table(spark, sf_dir, "documents"))


def op7_jaccard(spark, sf_dir):
    """Every document's class of near-equal shingle sets."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_vectors(spark, sf_dir):
    """Every vector's near duplicates."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_quality(spark, sf_dir):
    """Every document's quality."""
    docs = table(spark, sf_dir, "documents")
    return classify(docs, docs, table(spark, sf_dir, "labels"))


def op10_token_counts(spark, sf_dir):
    """Every document's tokens, before and after three edits."""
    return count_edited(some_edits(table(spark, sf_dir, "documents")))


def op11_manifest(spark, sf_dir):
    """Every document's leaf and proof in the manifest, and whether it still verifies after texts were tampered with."""
    return verified_documents(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    """The hard negatives of every anchor and positive; every seventh label is changed first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op13_top_products(spark, sf_dir):
    """The ten rows of the highest inner product with every hundredth vector."""
    return top_products(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_repeats": op3_suffix_repeats,
    "op4_phrases": op4_phrases,
    "op5_packing": op5_packing,
    "op6_langid": op6_langid,
    "op7_jaccard": op7_jaccard,
    "op8_vectors": op8_vectors,
    "op9_quality": op9_quality,
    "op10_token_counts": op10_token_counts,
    "op11_manifest": op11_manifest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_top_products": op13_top_products,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
