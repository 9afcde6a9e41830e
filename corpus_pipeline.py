"""A training corpus from documents: toxic texts go, copies and near copies go, sources are mixed, the rest is packed.

Each stage works on what its predecessor kept, written as Parquet and read again.

Cases, for all stages: rows are told apart as whole rows, other columns pass through whatever their names, and an empty table gives an empty one. What a null or empty text, a null or
repeated id and a tie mean is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, radix_dedup, token_groups, toxicity
from tessera.llm.common import read, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5. Null and empty texts have no window and stay unless toxic rows are the rule; repeated rows share a score and stay or go together."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    return toxicity.score(docs, model, carry=True).filter("score < 0.5").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space, the one with the smallest id (null ids last); of repeated rows one stays. Null counts as empty: of all null and empty texts one stays."""
    return radix_dedup.exact_dedup(docs, carry=True).filter("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of similar texts.

    Rows that share that id all stay, and rows with a null id stay only if no row of their component has one; null and empty texts have no shingle, are linked with nothing and stay.
    """
    kept = token_groups.ngram_components(docs).select(F.col("component_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the raked rates of their source, language and topic. Null sources and languages are values of their own; documents without tokens stay; repeated rows are drawn alike."""
    return mixing.mix(docs).filter("kept").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens. Null and empty texts are one end id; repeated rows and null ids are packed each."""
    return packing.op8_packing(spark, sf_dir, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Learned scores and tokenization have no SQL; the tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
