"""Vectors of corpora as Parquet, one folder a corpus and embedding, joined with their rows by row id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], list[list[float]]]


def folder_of(folder: str, corpus: str, emb: str) -> str:
    return f"{folder}/corpus={corpus}/emb={emb}"


def write_vectors(rows: DataFrame, folder: str, corpus: str, emb: str, key: str = "row_id", vec: str = "vec") -> None:
    """row_id and vec as floats, whatever was there before."""
    rows.select(F.col(key).cast("long").alias("row_id"), F.col(vec).cast("array<float>").alias("vec")).write.mode("overwrite").parquet(folder_of(folder, corpus, emb))


def read_vectors(spark: SparkSession, folder: str, corpus: str, emb: str) -> DataFrame:
    """row_id, vec."""
    return spark.read.schema("row_id long, vec array<float>").parquet(folder_of(folder, corpus, emb))


def present(spark: SparkSession, folder: str) -> DataFrame:
    """corpus, emb of every table of vectors below the folder: file names alone are listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path")
    part = lambda name: F.regexp_extract("path", rf"/{name}=([^/]+)/", 1)
    return files.select(part("corpus").alias("corpus"), part("emb").alias("emb")).where("corpus != '' and emb != ''").distinct()


def of_rows(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """rows with their vec, one to one by row_id; rows without a vector and vectors without a row go (see lacking)."""
    return rows.join(vectors, "row_id")


def lacking(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """side, row_id of what has no partner: sound tables give no row."""
    without = lambda a, b, side: a.select("row_id").join(b.select("row_id"), "row_id", "left_anti").select(F.lit(side).alias("side"), "row_id")
    return without(rows, vectors, "no vector").unionByName(without(vectors, rows, "no row"))


def encoded(rows: DataFrame, text: str, load: Callable[[], Encoder], batch: int = 64, key: str = "row_id") -> DataFrame:
    """key, vec of every row by an encoder that each task loads once and gives batches of texts; null texts are empty ones."""
    kind = dict(rows.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = None
        for part in parts:
            encoder = encoder or load()
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                yield pd.DataFrame({key: some[key], "vec": encoder([t if isinstance(t, str) else "" for t in some[text]])})

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, vec array<float>")
