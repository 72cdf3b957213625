"""What a block of work costs, how long one row takes, and the environment that both were measured in."""

from __future__ import annotations

import platform
import resource
import sys
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.views import drawn_rows


@dataclass
class Cost:
    """Of the driver's Python process; peak_mb is by how much the block raised its peak, 0 below an earlier one."""

    wall_seconds: float = 0.0
    cpu_seconds: float = 0.0
    peak_mb: float = 0.0


def _now() -> tuple[float, float, float]:
    used = resource.getrusage(resource.RUSAGE_SELF)
    return time.perf_counter(), used.ru_utime + used.ru_stime, used.ru_maxrss / (1e6 if sys.platform == "darwin" else 1e3)


@contextmanager
def measured() -> Iterator[Cost]:
    cost, before = Cost(), _now()
    try:
        yield cost
    finally:
        cost.wall_seconds, cost.cpu_seconds, cost.peak_mb = (max(0.0, b - a) for a, b in zip(before, _now(), strict=True))


def probe(score: Callable[[object], object], rows: DataFrame, key: str, value: str, seed: int = 42, n: int = 200, warm_up: int = 20, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """draw, ms of n single-row calls after warm-up calls; rows are drawn with replacement. No call, no row: n of 0 or an empty table."""
    spark = rows.sparkSession
    schema = "draw long, ms double"
    if n <= 0:
        return spark.createDataFrame([], schema)
    drawn = drawn_rows(rows, key, seed, n, warm_up).join(rows.select(key, value), key).orderBy("draw").collect()
    took = []
    for r in drawn:
        began = clock()
        score(r[value])
        took.append((r["draw"], (clock() - began) * 1000.0, r["warm"]))
    return spark.createDataFrame([(d, ms) for d, ms, warm in took if not warm], schema)


def latency(samples: DataFrame, value: str = "ms") -> DataFrame:
    """mean, p50, p95, p99, least and n of a probe's samples."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = samples.agg(F.avg(value).alias("mean"), p.alias("p"), F.min(value).alias("least"), F.count(value).alias("n"))
    return out.select("mean", *[F.col("p")[i].alias(c) for i, c in enumerate(("p50", "p95", "p99"))], "least", "n")


def environment(spark: SparkSession) -> DataFrame:
    """name, value of what the costs depend on."""
    context = spark.sparkContext
    facts = {
        "platform": platform.platform(), "processor": platform.processor(), "python": platform.python_version(), "spark": spark.version,
        "java": context._jvm.System.getProperty("java.version"), "master": context.master, "parallelism": context.defaultParallelism,
        "shuffle partitions": spark.conf.get("spark.sql.shuffle.partitions"), "adaptive": spark.conf.get("spark.sql.adaptive.enabled"),
        "executor memory": spark.conf.get("spark.executor.memory", "default"), "driver memory": spark.conf.get("spark.driver.memory", "default"),
    }
    return spark.createDataFrame([(k, str(v)) for k, v in facts.items()], "name string, value string")
