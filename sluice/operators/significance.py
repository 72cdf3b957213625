"""McNemar tests, Holm adjustment, mode alignment and degradation.

All pairs of a run's configurations come from one bit mask per row: configurations that are right set their bit, rows are
counted by mask, and only the masks met are held against the pairs. One shuffle of the predictions, no self-join of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.functions.stats import binomial_two_sided, chi2_sf1
from sluice.operators.metrics import METRICS, rounded

EXACT_UP_TO = 25


def mcnemar(counts: DataFrame) -> DataFrame:
    """counts: b, c. Adds n_discordant, statistic, p_value, method."""
    b, c = F.col("b"), F.col("c")
    n = b + c
    few = n <= EXACT_UP_TO
    out = counts.withColumn("n_discordant", n)
    out = out.withColumn("statistic", F.when(n == 0, 0.0).when(few, F.least(b, c).cast("double")).otherwise(F.pow(F.abs(b - c) - 1, F.lit(2)) / n))
    exact = binomial_two_sided(F.least(b, c), n)
    out = out.withColumn("p_value", F.when(n == 0, 1.0).when(few, exact).otherwise(chi2_sf1(F.col("statistic"))))
    return out.withColumn("method", F.when(few, "exact").otherwise("chi2_continuity"))


def holm(tests: DataFrame, family: list[str], order: list[str], alpha: float = 0.05) -> DataFrame:
    """Adds p_holm and significant (strictly below alpha) within each family."""
    whole, rank = Window.partitionBy(*family), Window.partitionBy(*family).orderBy("p_value", *order)
    step = (F.count("*").over(whole) - F.row_number().over(rank) + 1) * F.col("p_value")
    out = tests.withColumn("__step", step).withColumn("p_holm", F.least(F.lit(1.0), F.max("__step").over(rank.rowsBetween(Window.unboundedPreceding, 0))))
    return out.withColumn("significant", F.col("p_holm") < alpha).drop("__step")


def pairs_by_mask(preds: DataFrame, run: list[str], config: list[str], other: list[str], ordered: list[str]) -> DataFrame:
    """run, config, a, b names, acc_a, acc_b, b, c over all pairs a < b of `other` values within (run, config).

    ordered: the values of `other`, at most 62, as joined names; their places are the bits.
    """
    name = F.concat_ws("__", *other)
    place = F.array_position(F.array(*[F.lit(x) for x in ordered]), name) - 1
    right = F.col("y_pred") == F.col("y_true")
    bit = F.when(right, F.expr("shiftleft(1L, cast(__place as int))")).otherwise(F.lit(0).cast("long"))
    masks = preds.withColumn("__place", place).where("__place >= 0").withColumn("__bit", bit)
    masks = masks.groupBy(*run, *config, "row_id").agg(F.bit_or("__bit").alias("mask"), F.sum(F.expr("shiftleft(1L, cast(__place as int))")).alias("has"))
    masks = masks.groupBy(*run, *config, "mask", "has").agg(F.count("*").alias("n"))
    spark = preds.sparkSession
    names = sorted(ordered)
    pairs = [(a, b, ordered.index(a), ordered.index(b)) for i, a in enumerate(names) for b in names[i + 1 :]]
    grid = F.broadcast(spark.createDataFrame(pairs, "a string, b_name string, ia int, ib int"))  # at most 62 * 61 / 2 rows
    both = masks.crossJoin(grid).where(F.expr("getbit(has, ia) = 1 and getbit(has, ib) = 1"))
    ra, rb = F.expr("getbit(mask, ia)"), F.expr("getbit(mask, ib)")
    n = F.col("n")
    return both.groupBy(*run, *config, "a", "b_name").agg(
        (F.sum(n * ra) / F.sum(n)).alias("acc_a"), (F.sum(n * rb) / F.sum(n)).alias("acc_b"), F.sum(n * ra * (1 - rb)).alias("b"), F.sum(n * (1 - ra) * rb).alias("c"),
    )


def within_run(preds: DataFrame, ordered: list[str], alpha: float = 0.05) -> DataFrame:
    tests = mcnemar(pairs_by_mask(preds, ["pipeline", "mode"], [], ["emb", "clf"], ordered))
    out = holm(tests, ["pipeline", "mode"], ["a", "b_name"], alpha)
    return rounded(out.withColumn("acc_diff", F.col("acc_a") - F.col("acc_b")))


def aligned(preds: DataFrame, modes: list[str]) -> DataFrame:
    """The predictions of each pipeline's aligned modes, of the configurations that all of them have."""
    kept = mode_alignment(preds, modes).where("aligned").select("pipeline", "mode")
    rows = preds.join(F.broadcast(kept), ["pipeline", "mode"], "left_semi")  # a row per pipeline and mode
    have = rows.select("pipeline", "emb", "clf", "mode").distinct()
    shared = have.groupBy("pipeline", "emb", "clf").agg(F.count("*").alias("n"))
    every = kept.groupBy("pipeline").agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(shared.join(every, ["pipeline", "n"]).drop("n")), ["pipeline", "emb", "clf"], "left_semi")


def across_modes(preds: DataFrame, modes: list[str], alpha: float = 0.05) -> DataFrame:
    """Per pipeline, embedding and classifier all pairs of its aligned modes; Holm over all tests of the pipeline."""
    tests = mcnemar(pairs_by_mask(aligned(preds, modes), ["pipeline"], ["emb", "clf"], ["mode"], modes))
    return rounded(holm(tests, ["pipeline"], ["emb", "clf", "a", "b_name"], alpha).withColumn("acc_diff", F.col("acc_a") - F.col("acc_b")))


def mode_alignment(preds: DataFrame, modes: list[str]) -> DataFrame:
    """pipeline, mode, n_rows, aligned: the largest set of modes with the same rows and labels; a tie goes to the set with the earliest mode.

    Row sets are compared by their size and 128 bits that do not depend on the rows' order.
    """
    one = preds.select("pipeline", "mode", "row_id", "y_true").distinct()
    prints = one.groupBy("pipeline", "mode").agg(F.count("*").alias("n_rows"), F.bit_xor(F.xxhash64("row_id", "y_true")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "row_id", "y_true")).alias("s2"))
    prints = prints.withColumn("place", F.array_position(F.array(*[F.lit(m) for m in modes]), F.col("mode")))
    same = Window.partitionBy("pipeline", "n_rows", "s1", "s2")
    ranked = prints.withColumn("members", F.count("*").over(same)).withColumn("earliest", F.min("place").over(same))
    best = Window.partitionBy("pipeline").orderBy(F.col("members").desc(), "earliest")
    top = ranked.withColumn("__rank", F.dense_rank().over(best))
    return top.select("pipeline", "mode", "n_rows", (F.col("__rank") == 1).alias("aligned"))


def degradation(results: DataFrame) -> DataFrame:
    """Reference minus variant of each metric, every ordered pair of modes; positive: the variant is worse. results: of aligned predictions."""
    key = ["pipeline", "emb", "clf"]
    other = results.select(*key, F.col("mode").alias("variant"), *[F.col(m).alias(f"v_{m}") for m in METRICS])
    both = results.join(other, key).where(F.col("mode") != F.col("variant"))
    return rounded(both.select(*key, F.col("mode").alias("reference"), "variant", *[(F.col(m) - F.col(f"v_{m}")).alias(f"deg_{m}") for m in METRICS]))


def headline(degraded: DataFrame) -> DataFrame:
    """Mean degradation in percentage points of each ordered pair of modes."""
    return degraded.groupBy("reference", "variant").agg(*[F.round(F.avg(f"deg_{m}") * 100, 2).alias(f"mean_{m}_pp") for m in METRICS])
