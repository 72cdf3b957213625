"""Ranks, cut-offs and running sums over whole tables without a task that sees a whole table or a whole group."""

from __future__ import annotations

from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FEW = 10_000  #: keys of a group that are looked at one by one
DIGITS = 3  #: hex digits by which a group of more is cut


def cutoffs(keyed: DataFrame, group: str, key: str, wanted: Callable[[Hashable, int], int]) -> dict:
    """Per group the key of the wanted(group, n)-th of its n rows in key order ("" for none).

    keys are uniform hex strings. Rows are counted by the key's first digits, then only the part where the wanted row lies by
    the next ones, and so on: what reaches the driver are counts (16 ** DIGITS a group) and at most FEW keys a group.
    """
    out: dict = {}
    counted = keyed.groupBy(group, F.substring(key, 1, DIGITS).alias("p")).count().collect()
    parts: dict = {}
    for r in counted:
        parts.setdefault(r[0], []).append((r["p"], r["count"]))
    left = {}
    for g, counts in parts.items():
        k = wanted(g, sum(n for _, n in counts))
        if k <= 0:
            out[g] = ""
        else:
            left[g] = (k, "", counts)
    digits = DIGITS
    while left:
        found = {}
        for g, (k, _, counts) in left.items():
            for prefix, n in sorted(counts):
                if k <= n:
                    found[g] = (k, prefix, n)
                    break
                k -= n
            else:
                out[g] = max(p for p, _ in counts) + "~"  # more than there are: all of them
        inside = F.lit(False)
        for g, (_, prefix, _) in found.items():
            inside |= F.col(group).eqNullSafe(F.lit(g)) & F.col(key).startswith(prefix)
        few = digits >= 32 or all(n <= FEW for _, _, n in found.values())
        digits = 32 if few else digits + DIGITS
        rows = keyed.where(inside).groupBy(group, F.substring(key, 1, digits).alias("p")).count().collect() if found else []
        left = {}
        for g, (k, prefix, _) in found.items():
            counts = sorted((r["p"], r["count"]) for r in rows if r[0] == g)
            if not few:
                left[g] = (k, prefix, counts)
                continue
            for value, n in counts:
                k -= n
                if k <= 0:
                    out[g] = value
                    break
    return out


def up_to(key: F.Column, group: F.Column, found: dict) -> F.Column:
    """Whether a row's key is at most its group's cut-off."""
    out = F.lit(False)
    for g, value in found.items():
        out = F.when(group.eqNullSafe(F.lit(g)), key <= F.lit(value)).otherwise(out)
    return out


def running(df: DataFrame, group: list[str], order: str, weight: F.Column | None = None, n_slices: int = 64) -> DataFrame:
    """Adds before: the sum of weight (1 if None) of the rows of the group that come earlier in the numeric order.

    The order is cut at approximate quantiles. A group's slices are summed map-side; their sums, at most n_slices a group, are
    accumulated and joined back on (group, slice), so a group that holds most rows is spread over n_slices tasks.
    """
    w = F.lit(1).cast("long") if weight is None else weight
    found = df.agg(F.percentile_approx(order, [i / n_slices for i in range(1, n_slices)], 1000)).first()[0] or []
    cuts = F.array(*[F.lit(x) for x in sorted(set(found))]) if found else F.array().cast("array<long>")
    cut = df.withColumn("__w", w).withColumn("__slice", F.size(F.filter(cuts, lambda x: x < F.col(order))))
    sums = cut.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__slice").alias("__s")).agg(F.sum("__w").alias("__n"))
    earlier = Window.partitionBy(*[f"__g{i}" for i in range(len(group))] or [F.lit(0)]).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    within = Window.partitionBy(*group, "__slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("__slice") == F.col("__s")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = cut.withColumn("__in", F.coalesce(F.sum("__w").over(within), F.lit(0))).join(sums, same)
    return out.withColumn("before", F.col("__before") + F.col("__in")).drop("__w", "__slice", "__s", "__before", "__in", *[f"__g{i}" for i in range(len(group))])
