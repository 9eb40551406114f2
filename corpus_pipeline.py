"""Stages that take raw documents to packed training sequences.

Each stage works on all that the one before it kept, and an empty table goes through all of them. Rows
may hold nulls in any column, repeat each other, and have columns of any other names, which all stages
but the last keep; how a stage treats such rows is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from itemforge.llm import exact_dedup, packing, simhash, toxicity, workspace
from itemforge.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject. Null and empty texts have no word of
    abuse and stay; rows that repeat go or stay together; an id labelled twice counts as toxic if one
    label says so."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the greatest id. Null and empty texts are equal, null
    ids are least, and of rows that repeat id and text the last in the files stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id: five-word shingles, a
    similarity of 0.8 or more. Texts without words are equal; null ids come last."""
    return simhash.drop_near_copies(docs, words=5, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in sequences of at most 2048 ids. A null or empty
    text is the end id alone; rows that repeat are packed each for itself."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("packing", pack)]

#: The stages fit models and fingerprints, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder before the next reads it. What
    a stage wrote for itself goes as soon as its result is written, its result when the next one's is."""
    docs, folders, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), workspace.Folders(), None
    for name, stage in STAGES:
        with folders.stage(name):
            found = stage(spark, docs, sf_dir)
        with folders.stage(f"{name}, result"):
            docs = workspace.saved(found, f"stage-{name}")
        folders.drop(name, *([f"{before}, result"] if before else []))
        before = name
    return docs
