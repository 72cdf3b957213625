"""Run summaries, tables for people, file previews and saved models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources.files import finite


def write_summary(rows: DataFrame, path: str) -> None:
    """One JSON object a row; NaN and infinities become null, which is written."""
    finite(rows).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_summary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path and the fields of each file's one object; of corrupt files the fields are null."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("r"))
    return raw.select("path", "r.*")


def html_table(results: DataFrame, most_rows: int = 10_000) -> str:
    """A results table with four decimals. Tables beyond most_rows are no reports and are refused."""
    rows = results.limit(most_rows + 1).toPandas()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    return rows.to_html(index=False, float_format="{:.4f}".format, na_rep="")


def preview(spark: SparkSession, path: str, lines: int = 3, chars: int = 600) -> DataFrame:
    """The first lines of a text, JSON Lines or CSV file, each cut to so many characters."""
    return spark.read.text(path).limit(lines).select(F.substring("value", 1, chars).alias("value"))


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """line, value: what a person sees of a file. Three rows of JSON Lines, ten of CSV (as JSON), 4,000 characters of text; of Parquet files the
    columns, their types and the number of rows; of any other file its size."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "jsonl":
        rows = preview(spark, path)
    elif kind == "csv":
        rows = spark.read.csv(path, header=True, inferSchema=True).limit(10).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    elif kind == "parquet":
        table = spark.read.parquet(path)
        rows = table.agg(F.count("*").alias("n")).select(F.concat(F.lit(", ".join(f"{c} {t}" for c, t in table.dtypes) + " · "), F.col("n").cast("string"), F.lit(" rows")).alias("value"))
    elif kind in ("json", "log", "txt", "md", "html"):
        rows = spark.read.text(path, wholetext=True).select(F.when(F.length("value") > 4000, F.concat(F.substring("value", 1, 4000), F.lit("\n… (truncated)"))).otherwise(F.col("value")).alias("value"))
    else:
        rows = file_info(listing(spark, path)).select(F.format_string("%.2f MB", "size_mb").alias("value"))
    return rows.coalesce(1).select(F.monotonically_increasing_id().alias("line"), "value")


def file_info(files: DataFrame) -> DataFrame:
    """A listing with size_mb, two decimals of a million bytes, and mtime in whole seconds."""
    return files.withColumn("size_mb", F.round(F.col("size") / 1e6, 2)).withColumn("mtime", F.unix_seconds("mtime"))


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, size and mtime of the files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def artifact_grid(expected: DataFrame, present: DataFrame, key: str = "name") -> DataFrame:
    """expected with status, size and mtime: 'present' where a file of that name was listed, else 'missing'."""
    named = present.withColumn(key, F.element_at(F.split("path", "/"), -1)).groupBy(key).agg(F.max("size").alias("size"), F.max("mtime").alias("mtime"))
    return expected.join(named, key, "left").withColumn("status", F.when(F.col("size").isNull(), "missing").otherwise("present"))


def save_model(model: PipelineModel, folder: str, emb: str, clf: str) -> None:
    model.write().overwrite().save(f"{folder}/emb={emb}/clf={clf}")


def load_model(folder: str, emb: str, clf: str) -> PipelineModel:
    return PipelineModel.load(f"{folder}/emb={emb}/clf={clf}")
