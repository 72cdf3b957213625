"""Packing into optimal length buckets.

Dynamic programming over the global length histogram chooses the bucket boundaries with the least padding; inside
each bucket rows, in a seeded order, form batches of as many rows as the token budget holds at the bucket's length.

The histogram has one row per distinct length (rounded up to `grain` words, by default not at all): its size is bounded by
the longest text, not by the number of rows, and is the only thing that the driver sees. Positions in a bucket are found slice by
slice (common.running), so a bucket that holds most rows is spread over all tasks.

Defined cases: null and empty texts have length 0 and fall in the first bucket, which is at least one word long; a text longer than the budget is a batch of
its own; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def boundaries(lengths: list[int], counts: list[int], buckets: int, grain: int = 1) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least total padding. lengths ascend and are distinct.

    Each layer is solved by divide and conquer: the best previous cut never moves left as the length grows.
    """
    if not lengths:
        return []
    length, count = np.asarray(lengths, dtype=np.float64), np.asarray(counts, dtype=np.float64)
    n = np.concatenate([[0.0], np.cumsum(count)])
    words = np.concatenate([[0.0], np.cumsum(count * length)])
    m = len(length)
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    choice = []
    for _ in range(min(buckets, m)):
        new, cut = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        stack = [(1, m, 0, m - 1)]
        while stack:
            low, high, first, last = stack.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            cost = best[i] + length[j - 1] * (n[j] - n[i]) - (words[j] - words[i])
            k = int(np.argmin(cost))
            new[j], cut[j] = cost[k], i[k]
            stack += [(low, j - 1, first, int(i[k])), (j + 1, high, int(i[k]), last)]
        new[0] = 0.0
        choice.append(cut)
        best = new
    out, j = [], m
    for cut in reversed(choice):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
    return sorted(out)


def pack(docs: DataFrame, buckets: int = 16, budget: int = 16_384, grain: int = 1, seed: int = 31, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket, padded (length of the bucket), batch (within the bucket), slot (in the batch), padding."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), C.word_count(F.col(text)).alias("n_tokens"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("__crc"))
    rows = rows.withColumn("__key", C.seeded_key(seed, F.col("doc_id"), F.col("__crc"), F.col("n_tokens")))
    rows = C.staged(rows.withColumn("__number", C.key_number(F.col("__key"))), "pack-rows")
    rounded = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / grain)) * grain
    histogram = sorted((r[0], r[1]) for r in rows.groupBy(rounded.cast("long")).count().collect())
    bounds = boundaries([x[0] for x in histogram], [x[1] for x in histogram], buckets)
    if not bounds:
        bounds = [grain]
    table = F.array(*[F.lit(b).cast("long") for b in bounds])
    rows = rows.withColumn("bucket", F.size(F.filter(table, lambda b: b < F.col("n_tokens"))).cast("int"))
    rows = rows.withColumn("padded", F.element_at(table, F.col("bucket") + 1))
    placed = C.running(rows, "bucket", "__number", ["__key", "doc_id", "__crc", "n_tokens"], C.slices(spark, rows.count()))
    placed = placed.withColumn("__capacity", F.expr(f"greatest(1, {budget} div padded)"))
    return placed.select("doc_id", "n_tokens", "bucket", "padded", F.expr("start div __capacity").alias("batch"), F.expr("cast(start % __capacity as int)").alias("slot"), (F.col("padded") - F.col("n_tokens")).alias("padding"))
