"""A corpus pipeline over documents: five stages, each of which takes all rows that the one before it kept.

Every stage but the last returns the columns of documents; each returned table is written and read again before
the next stage, so a lost executor never sets the pipeline back by more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skerry.llm import contamination, langid, mixing, near, shards
from skerry.llm.store import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts; it learns from labelled rows of these documents.

    Rows whose text is null or has no letter go, however many share a doc_id or have none; lang may be null, and with no labelled row at
    all every row goes, as every language is unknown. Whole texts are judged, repeated rows alike; an empty table gives an empty one.
    """
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of each component of near duplicates.

    Texts without a word and rows without a doc_id are linked with nothing and stay; rows that share a doc_id stay or go together.
    """
    return near.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows.

    Null and empty texts stay, as does every document where the benchmark is empty; each row is judged by itself.
    """
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times, from none to twice, as the mix to its source's target takes it.

    A null source is a source of its own, the last; documents without a word are never taken. Rows alike in every column share
    their copies evenly. Reruns agree.
    """
    return mixing.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard of 16, by jump consistent hashing of doc_id; rows without one share a shard.

    The new column is `shard`, with underscores after it if documents have a column of that name.
    """
    return shards.shard_column(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("sharding", sharding),
]

#: No stage but the last is expressible in SQL; tests hold the rows against brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
