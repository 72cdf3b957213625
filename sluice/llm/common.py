"""Helpers shared by the training-data operators.

Everything here is a composition of DataFrame functions; nothing depends on the
number of rows fitting in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.sources.shared import delete, discard, freed_shuffles, noted, scratch, shared_dir, staged  # noqa: F401

#: Characters that count as white space in word counts and normalised texts.
SPACE_CLASS = r"\x20\x09-\x0D"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def group_key(c: Column) -> Column:
    """A null-free key that keeps null apart from every string."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string")))


def seeded_key(seed: int, *cols: Column) -> Column:
    """md5 of the seed and the columns (null: empty); the same hex digits in any SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def key_number(key: Column) -> Column:
    """The first 32 bits of a hex key as a long."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def slices(spark: SparkSession, rows: int, rows_per_slice: int = 50_000) -> int:
    """How many slices to cut an ordered set into, so that none is large and every task has some."""
    return max(8 * shuffle_partitions(spark), -(-rows // rows_per_slice))


def running(df: DataFrame, group: str, number: str, order: list[str], n_slices: int, weight: str | None = None) -> DataFrame:
    """Adds start and total: the sum of weight (1 if None) before each row of its group, and over its group.

    number is a uniform 32-bit long that leads the order. The group is cut into n_slices by it; slice sums are
    accumulated in a small table that is joined back on (group, slice), the partitioning that the running sum
    within a slice needs anyway. No group meets in one task, however large.
    """
    w = F.col(weight) if weight else F.lit(1)
    cut = df.withColumn("__run_at", F.shiftright(F.col(number) * F.lit(n_slices), 32).cast("int"))
    sums = cut.groupBy(F.col(group).alias("__run_group"), F.col("__run_at").alias("__run_slice")).agg(F.sum(w).cast("long").alias("__run_sum"))
    by_group = Window.partitionBy("__run_group")
    before = by_group.orderBy("__run_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__run_group", "__run_slice", F.coalesce(F.sum("__run_sum").over(before), F.lit(0)).alias("__run_before"), F.sum("__run_sum").over(by_group).alias("total"))
    within = Window.partitionBy(group, "__run_at").orderBy(number, *order).rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumn("__run_upto", F.sum(w).over(within))
    joined = own.join(offsets.hint("merge"), (F.col(group) == F.col("__run_group")) & (F.col("__run_at") == F.col("__run_slice")))
    return joined.withColumn("start", F.col("__run_before") + F.col("__run_upto") - w).drop("__run_at", "__run_group", "__run_slice", "__run_before", "__run_upto")
