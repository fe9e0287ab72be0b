"""Corpus pipeline: documents to packed training sequences in five written stages.

Each stage takes what its predecessor kept. All but the last return the columns of ``documents``; the last
returns the packed pieces. A text that a stage empties stays a document, and packs as one closing id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpact.llm import near, packing, pii, substrings, weak
from signalpact.llm.text import free_names, quoted, table
from signalpact.session import cut_lineage


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of a changed text; other columns stay."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps."""
    score, kept = free_names(docs, "score", "kept")
    return weak.classify(docs, added=(score, kept)).where(F.col(kept)).select(*map(quoted, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of least doc_id."""
    return near.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 20 words and more that also start earlier."""
    return _counted(substrings.drop_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked and disclosing terms generalised or removed."""
    return _counted(pii.sanitise(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place."""
    # The executors of the stages before keep what they hold, so texts are looked up in smaller parts here.
    return packing.pack(packing.cut_pieces(docs, at_once=packing.AT_ONCE // 2, cache=60_000))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("PII", personal_data),
    ("best-fit packing", pack),
]

#: Trained scorers, hashing and the genetic search can't be written in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
