"""Sharding by proportional stratified interleaving.

Rows are put in a seeded shuffle within each source and given the fractional rank
(rank + j) / rows of the source, j being a fixed number in [0, 1) of the source.
Sorted by it, any contiguous run holds every source in its share, so the order is cut
into shards whose row counts differ by one at most (law "rows").

Native: DataFrame functions alone. A source's ranks and the global order are both found
slice by slice (common.running), so neither a hot source nor the whole table meets in one task.

Defined cases: a null text has size 1 and the crc of the empty text; a null source is a source of its own;
a null doc_id shuffles like an empty one; repeated rows are each placed; an empty table gives no rows.
The method has no groups: equal texts are rows like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C


def interleave(docs: DataFrame, shards: int = 16, seed: int = 17, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, source."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), C.group_key(F.col(source)).alias("__group"),
        (C.text_bytes(F.col(text)) + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("__key", C.seeded_key(seed, F.col("doc_id"), F.col("text_crc32"), F.col("size")))
    rows = C.staged(rows.withColumn("__number", C.key_number(F.col("__key"))), "shard-rows")
    n = rows.count()
    cuts = C.slices(spark, n)
    ranked = C.running(rows, "__group", "__number", ["__key", "doc_id", "text_crc32", "size"], cuts)
    jitter = C.key_number(C.seeded_key(seed, F.col("__group"))) / F.lit(2.0**32)
    placed = ranked.withColumn("__fraction", (F.col("start") + jitter) / F.col("total"))
    # The fraction is uniform by construction: it slices the global order as the key slices a source.
    placed = placed.withColumn("__cut", F.least(F.floor(F.col("__fraction") * cuts), F.lit(cuts - 1)).cast("int"))
    sums = placed.groupBy(F.col("__cut").alias("__c")).agg(F.count("*").alias("__n"))
    offsets = sums.select("__c", F.coalesce(F.sum("__n").over(Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__cut").orderBy("__fraction", "__key", "__group", "doc_id", "text_crc32", "size")
    global_order = placed.withColumn("__rank", F.row_number().over(within)).join(offsets.hint("merge"), F.col("__cut") == F.col("__c"))
    position = F.col("__before") + F.col("__rank") - 1
    return (
        global_order.withColumn("__position", position)
        .withColumn("shard", F.expr(f"cast(({shards} * (__position + 1) - 1) div {max(n, 1)} as int)"))
        .withColumn("slot", F.expr(f"__position - (shard * {n}L) div {shards}"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
    )
