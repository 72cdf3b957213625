"""Corpora, pools, result tables and progress logs as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The columns by which results are broken down, and the label.
METADATA = ("category", "attack_category", "injection_position", "source", "label")
CORPUS = "context string, user_intent string, label int, source string"


def read_corpus(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """JSON Lines with row_id, the row's place in the files (files by name)."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    raw = raw.withColumn("p", F.shiftright("m", 33)).withColumn("i", F.col("m").bitwiseAND((1 << 33) - 1))
    sizes = raw.groupBy("f", "b", "p").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("f", "b", "p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    first = raw.join(before, ["f", "b", "p"]).withColumn("k", F.row_number().over(Window.partitionBy("f", "b", "p").orderBy("i")) - 1)
    return first.select((F.col("before") + F.col("k")).alias("row_id"), F.from_json("value", schema).alias("r")).select("row_id", "r.*")


def head(rows: DataFrame, n: int) -> DataFrame:
    return rows.where(F.col("row_id") < n)


def write_corpus(rows: DataFrame, path: str) -> None:
    rows.drop("row_id").write.mode("overwrite").json(path)


def read_attack_pool(spark: SparkSession, path: str, kind: str, part: str) -> DataFrame:
    """{category: [instruction]} as rows; an empty pool is an error."""
    pool = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("category", "l")).select(F.lit(kind).alias("kind"), F.lit(part).alias("part"), "category", F.explode("l").alias("instruction"))
    if not pool.limit(1).count():
        raise ValueError(f"no instruction in {path}")
    return pool


def read_results(spark: SparkSession, paths: dict[tuple[int, str], str]) -> DataFrame:
    """CSV tables of runs, (pipeline, mode) first; columns that a run lacks are null, unreadable rows dropped."""
    tables = [spark.read.csv(p, header=True, inferSchema=True, mode="DROPMALFORMED").select(F.lit(k[0]).alias("Pipeline"), F.lit(k[1]).alias("Mode"), "*") for k, p in sorted(paths.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_results(results: DataFrame, path: str) -> None:
    results.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').csv(path)


def write_predictions(preds: DataFrame, path: str) -> None:
    preds.write.mode("overwrite").partitionBy("pipeline", "mode").parquet(path)


def read_predictions(spark: SparkSession, path: str, pipeline: int | None = None, mode: str | None = None) -> DataFrame:
    """Written predictions, of one pipeline and one mode if they are named: only their folders are read."""
    rows = spark.read.parquet(path)
    for name, value in (("pipeline", pipeline), ("mode", mode)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


def metadata(rows: DataFrame, wanted: tuple[str, ...] = METADATA) -> DataFrame:
    """Those of the wanted columns that the corpus has; no other is read."""
    return rows.select(*[c for c in wanted if c in rows.columns])


def write_samples(samples: DataFrame, path: str, order: str, text: str = "sample") -> None:
    """Samples for a person, numbered, in one text file. The operators cut them to a few rows before."""
    numbered = samples.withColumn("__n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)))
    numbered.orderBy("__n").coalesce(1).select(F.concat(F.lit("--- sample "), F.col("__n").cast("string"), F.lit(" ---\n"), F.col(text)).alias("value")).write.mode("overwrite").text(path)


def copy_table(spark: SparkSession, source: str, target: str, kind: str = "json", parts: list[str] | None = None) -> None:
    """A staged corpus as JSON Lines, its parts (folders below the source) one after the other."""
    tables = [spark.read.format(kind).load(f"{source}/{p}" if p else source) for p in parts or [""]]
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).write.mode("overwrite").json(target)


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities become null."""
    return df.select(*[F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def log_state(lines: DataFrame) -> DataFrame:
    """lines: job, line_no, value. The last step and phase of each job; a phase counts only after its step's start."""
    step = F.get_json_object(F.regexp_extract("value", r"##step (\{.*\})", 1), "$.label")
    progress = F.regexp_extract("value", r"##progress (\{.*\})", 1)
    marks = lines.select("job", "line_no", step.alias("label"), F.get_json_object(progress, "$.phase").alias("phase")).where("label is not null or phase is not null")
    steps = marks.where("label is not null").groupBy("job").agg(F.count("*").alias("step"), F.max_by("label", "line_no").alias("label"), F.max("line_no").alias("since"))
    phases = marks.where("phase is not null").join(steps.select("job", "since"), "job").where("line_no > since").groupBy("job").agg(F.max_by("phase", "line_no").alias("phase"))
    return steps.join(phases, "job", "left").select("job", "step", "label", "phase")
