"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import common, exact_dedup, mixing, ngram_join, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models call toxic go (score of 0.5 or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.add_score(docs, labels, "__toxicity").where("__toxicity < 0.5").drop("__toxicity")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a 5-word shingle similarity of 0.8 or more the smallest doc_id stays."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the block in which it starts is taken: not at all, once or twice."""
    return mixing.resample(docs)


def pack_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lengths are rounded up to 8 words before the boundaries are chosen: not the least padding (see README)."""
    return packing.pack(docs, grain=8)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_rows),
]

#: Models, signatures and dynamic programming are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage staged on its way, and its input, are deleted when its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with common.scratch(spark):
            docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}", lasting=True)
        if before is not None:
            common.discard(before)
        before = docs
    return docs
