"""Token batches, rolling budgets and latency figures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def token_batches(rows: DataFrame, shard: str, order: str, tokens: str, budget: int = 100_000, most: int = 256) -> DataFrame:
    """shard, batch, n_texts, n_tokens: greedy batches in order; a batch closes when the next text would pass the budget or the row limit.

    A shard's rows pass through one task in order; it holds a batch of rows and the open text batch, whatever the shard's size.
    """
    kind = dict(rows.dtypes)[shard]
    sorted_rows = rows.select(shard, order, F.col(tokens).cast("long").alias("tokens")).repartition(shard).sortWithinPartitions(shard, order)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, place, n, t = None, 0, 0, 0
        for batch in batches:
            out = []
            for own, part in batch.groupby(shard, sort=False, dropna=False)["tokens"]:
                if n and own != now:
                    out.append((now, place, n, t))
                if own != now:
                    now, place, n, t = own, 0, 0, 0
                values = part.to_numpy()
                total, at = np.concatenate([[0], np.cumsum(values)]), 0
                while at < len(values):
                    # As many more texts as fit; a batch takes one in any case.
                    fits = int(np.searchsorted(total, total[at] + budget - t, side="right")) - 1 - at
                    take = min(max(fits, 0 if n else 1), most - n, len(values) - at)
                    n, t, at = n + take, t + int(total[at + take] - total[at]), at + take
                    if at < len(values):
                        out.append((now, place, n, t))
                        place, n, t = place + 1, 0, 0
            if out:
                yield pd.DataFrame(out, columns=[shard, "batch", "n_texts", "n_tokens"])
        if n:
            yield pd.DataFrame([(now, place, n, t)], columns=[shard, "batch", "n_texts", "n_tokens"])

    return sorted_rows.mapInPandas(fold, f"{shard} {kind}, batch int, n_texts int, n_tokens long")


def rolling_budget(events: DataFrame, group: str, ts: str, amount: str, seconds: int = 60) -> DataFrame:
    """Adds spent: the group's amount in the last `seconds`, what is exactly that old having expired."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    window = Window.partitionBy(group).orderBy(micros).rangeBetween(-(seconds * 1_000_000) + 1, 0)
    return events.withColumn("spent", F.sum(amount).over(window))


def latency_percentiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = rows.groupBy(group).agg(F.avg(value).alias("mean"), p.alias("p"), F.min(value).alias("least"))
    return out.select(group, F.round("mean", 6).alias("mean"), *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))], F.round("least", 6).alias("least"))


def cost_summary(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, median and maximum of a cost column."""
    return rows.groupBy(group).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.median(value), 6).alias("median"), F.round(F.max(value), 6).alias("most"))
