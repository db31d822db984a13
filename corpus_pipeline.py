"""The corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordtide.llm import classifier, decontamination, minhash, mixing
from wordtide.llm.queries import DOMAIN_WEIGHTS, SHARDS, TABLE_SIZE, table
from wordtide.llm.sharding import place
from wordtide.llm.storage import clear, materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier does not reject: those of a score of 0.3 or more. Null and empty texts have the
    score of the bias alone; repeated rows share their fate."""
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each component of near copies. Null and wordless texts are copies of nothing; of
    rows that repeat a doc_id the least stays; rows of null doc_id stay."""
    return minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of a benchmark item occurs. Null and empty texts stay; a row is judged by its own text."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as its rate says: left out, taken or repeated so that the domains' tokens come near to their
    weights. A domain without labelled examples among the documents has no target."""
    return mixing.resample(docs, mixing.label_domains(table(spark, sf_dir, "labels")), DOMAIN_WEIGHTS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with slot and shard; rows of one doc_id share them, a null one too."""
    return place(docs, "doc_id", SHARDS, TABLE_SIZE)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: The classifier has no SQL form; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{k}")
        clear(spark)
    return docs
