"""Saved models: discovery below the folder of all runs, and the score of one text."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import lru_cache

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.corpus import compose

KEYS = ["pipeline", "mode", "emb", "clf"]


def run_folder(folder: str, pipeline: int, mode: str) -> str:
    return f"{folder}/pipeline={pipeline}/mode={mode}"


def model_path(folder: str, pipeline: int, mode: str, emb: str, clf: str) -> str:
    return f"{run_folder(folder, pipeline, mode)}/emb={emb}/clf={clf}"


def available(spark: SparkSession, folder: str, embeddings: list[str]) -> DataFrame:
    """pipeline, mode, emb, clf, path of every saved model with a known embedding; models are found by their metadata folder, unread."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(f"{folder}/pipeline=*/mode=*/emb=*/clf=*/metadata")
    found = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at) or []
    paths = [(f.getPath().getParent().toString(),) for f in found]
    rows = spark.createDataFrame(paths, "path string")
    part = lambda name: F.regexp_extract("path", rf"/{name}=([^/]+)(/|$)", 1)
    named = rows.select(part("pipeline").cast("int").alias("pipeline"), *[part(k).alias(k) for k in KEYS[1:]], "path")
    return named.where(F.col("emb").isin(embeddings))


@lru_cache(maxsize=16)
def loaded(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def live_score(spark: SparkSession, folder: str, config: tuple[int, str, str, str], intent: str, context: str, encode: Callable[[DataFrame], DataFrame], known: list[str], threshold: float = 0.5) -> dict:
    """probability, verdict and milliseconds of one (intent, context) by the saved model of a (pipeline, mode, emb, clf).

    encode adds an array column vec to rows with a column text. A model is read once a session; a missing model and an empty
    text give {"error": ...}.
    """
    pipeline, mode, emb, clf = config
    if not available(spark, folder, known).where((F.col("pipeline") == pipeline) & (F.col("mode") == mode) & (F.col("emb") == emb) & (F.col("clf") == clf)).limit(1).count():
        return {"error": f"no saved model of {emb} and {clf} for {pipeline}/{mode}"}
    given = spark.createDataFrame([(context, intent)], "context string, user_intent string")
    text = given.select(compose(mode, F.col("context"), F.col("user_intent")).alias("text"))
    if not text.first()["text"].strip():
        return {"error": "empty input"}
    began = time.perf_counter()
    vector = encode(text).select("vec").first()["vec"]
    embedded = time.perf_counter()
    one = spark.createDataFrame([(list(map(float, vector)),)], "vec array<double>").select(array_to_vector("vec").alias("features"))
    p = loaded(model_path(folder, *config)).transform(one).select(vector_to_array("probability")[1].alias("p")).first()["p"]
    ended = time.perf_counter()
    return {"probability": p, "verdict": "malicious" if p >= threshold else "benign", "embed_ms": round((embedded - began) * 1000, 2), "classify_ms": round((ended - embedded) * 1000, 3)} | dict(zip(KEYS, config, strict=True))

