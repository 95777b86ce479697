"""A pretraining-corpus pipeline of the training-data operators: each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternlog.llm.bpe import bpe_digests
from lanternlog.llm.common import settle
from lanternlog.llm.mixing import mix_sources, shuffled
from lanternlog.llm.neardup import near_duplicates, row_hash
from lanternlog.llm.quality import base_failed, judge

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose posterior quality is high enough; null and empty texts go."""
    judged = judge(docs)
    return judged.where(~base_failed(judged["_counts"]) & judged["_good"]).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id, or if none has an id, one of them. Rows that repeat
    its id and text are dropped too. Texts without words are in no group and stay, once for each id. An empty table stays empty."""
    first = near_duplicates(docs).where("first").select(F.col("row").alias("_row")).distinct()
    return docs.join(first, row_hash(docs["doc_id"], docs["text"]) == first["_row"], "left_semi").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, each document as often as it is drawn, shuffled in its shard. A null source is one of its own; texts
    that are null or without words are never drawn; an empty table gives an empty mix."""
    _, mixed = mix_sources(docs)
    return shuffled(mixed).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row of the mix, a document that was drawn twice included twice. A null text counts as
    empty: no ids, digests of no bytes. An empty mix gives an empty result."""
    return bpe_digests(docs)


STAGES = [("quality rules", quality), ("near-duplicate removal", deduplicate), ("source mixing", mix), ("byte-level BPE", encode)]

#: SQL can express neither the estimated accuracies nor the seeded draws; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
