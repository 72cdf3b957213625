"""The predictions fixture: 3 pipelines x 3 modes x 3 embeddings x 5 classifiers over every event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["pipeline", "mode", "emb", "clf"]
MODES = [("normal", 0, 250), ("user_intent_only", 1, 0), ("context_only", 2, 200)]
EMBEDDINGS = [("minilm", 1), ("openai", 2), ("qwen3", 3)]
CLASSIFIERS = [("LightGBM", 1), ("LogisticRegression", 2), ("RandomForest", 3), ("SVM", 4), ("XGBoost", 5)]


def predictions(spark: SparkSession, sf_dir: str, pipeline: int | None = None, mode: str | None = None) -> DataFrame:
    """pipeline, mode, emb, clf, row_id, y_true, y_prob (FLOAT), y_pred; narrowed to one run if asked, before anything is computed."""
    grid = [(m, mi, e, ei, c, ci, 0 if base == 0 else base + ei * 20 + ci * 10) for m, mi, base in MODES for e, ei in EMBEDDINGS for c, ci in CLASSIFIERS if mode in (None, m)]
    cfg = F.broadcast(spark.createDataFrame(grid, "mode string, mi int, emb string, ei int, clf string, ci int, w int"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    rows = events.select(F.col("event_id").alias("row_id"), "user_id", (1 + F.col("user_id") % 3).cast("int").alias("pipeline"), F.col("event_type").isin("error", "purchase").cast("int").alias("y_true"))
    if pipeline is not None:
        rows = rows.where(F.col("pipeline") == pipeline)
    mixed = rows.crossJoin(cfg)  # a fixed grid of 135 configurations
    noise = (F.col("row_id") * F.col("row_id") * 7919 + F.col("row_id") * (F.col("ei") * 131 + F.col("ci") * 17 + F.col("mi") * 7) * 104729 + F.col("user_id") * 31) % 1009
    prob = ((noise * (1000 - F.col("w")) + F.col("y_true") * F.col("w") * 1009).cast("double") / F.lit(1009000.0)).cast("float")
    return mixed.select(*KEYS, "row_id", "y_true", prob.alias("y_prob")).withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("int"))


#: The same rows in SQL, as common table expressions.
PREDS_SQL = """cfg as (select m.mode, m.mi, e.emb, e.ei, c.clf, c.ci, case when m.base=0 then 0 else m.base + e.ei*20 + c.ci*10 end as w from
 (values ('normal',0,250),('user_intent_only',1,0),('context_only',2,200)) m(mode,mi,base)
 cross join (values ('minilm',1),('openai',2),('qwen3',3)) e(emb,ei)
 cross join (values ('LightGBM',1),('LogisticRegression',2),('RandomForest',3),('SVM',4),('XGBoost',5)) c(clf,ci)),
ev as (select event_id as row_id, user_id, cast(1 + user_id % 3 as int) as pipeline, case when event_type in ('error','purchase') then 1 else 0 end as y_true from events),
raw as (select pipeline, mode, emb, clf, row_id, y_true, w, (row_id*row_id*7919 + row_id*(ei*131+ci*17+mi*7)*104729 + user_id*31) % 1009 as noise from ev cross join cfg),
preds as (select *, case when y_prob >= 0.5 then 1 else 0 end as y_pred from (select pipeline, mode, emb, clf, row_id, y_true, cast(cast(noise*(1000-w) + y_true*w*1009 as double)/cast(1009000 as double) as float) as y_prob from raw))"""
