"""Detection-quality metrics, curves and breakdowns.

Rows are first reduced to one per (configuration, score), so everything after the first shuffle is as large as the
distinct scores; windows are partitioned by configuration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.functions.stats import ratio

METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]


def by_score(preds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score, pos, neg."""
    return preds.groupBy(*keys, F.col("y_prob").alias("score")).agg(F.sum("y_true").alias("pos"), F.sum(1 - F.col("y_true")).alias("neg"))


def cumulated(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Adds tp, fp (at the threshold of the score), P, N and the previous point's tp, fp."""
    down = Window.partitionBy(*keys).orderBy(F.col("score").desc())
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    out = scores.select("*", F.sum("pos").over(upto).alias("tp"), F.sum("neg").over(upto).alias("fp"), F.sum("pos").over(whole).alias("n_pos"), F.sum("neg").over(whole).alias("n_neg"))
    return out.withColumn("tp_before", F.col("tp") - F.col("pos")).withColumn("fp_before", F.col("fp") - F.col("neg"))


def detection_metrics(preds: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """One row per configuration. Precision, recall and F1 are 0 where undefined; specificity, FPR and FNR null."""
    points = cumulated(by_score(preds, keys), keys)
    p, n = F.col("n_pos"), F.col("n_neg")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.when(F.col("tp_before") + F.col("fp_before") > 0, F.col("tp_before") / (F.col("tp_before") + F.col("fp_before"))).otherwise(1.0)
    hit = F.col("score") >= threshold
    sums = points.groupBy(*keys).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"), F.first("n_pos").alias("p"), F.first("n_neg").alias("n"),
        # Pairs ordered right count 2, ties 1: integers, so exact in any order of summation.
        F.sum(F.col("pos") * (2 * (n - F.col("fp")) + F.col("neg"))).alias("ordered"),
        F.sum(ratio(F.col("pos"), p) * precision).alias("ap"), F.sum(ratio(F.col("pos"), p) * (precision + before) / 2).alias("trapz"),
    )
    sums = sums.withColumn("fn", F.col("p") - F.col("tp")).withColumn("tn", F.col("n") - F.col("fp"))
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    out = sums.select(
        *keys, ratio(F.col("tp") + F.col("tn"), F.col("p") + F.col("n")).alias("accuracy"), zero(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), zero(F.col("tp"), F.col("p")).alias("recall"),
        zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), ratio(F.col("ordered"), 2 * F.col("p") * F.col("n")).alias("roc_auc"), F.col("ap").alias("pr_auc"), F.col("trapz").alias("pr_auc_trapz"),
        "tn", "fp", "fn", "tp", ratio(F.col("tn"), F.col("n")).alias("specificity"), ratio(F.col("fp"), F.col("n")).alias("fpr"), ratio(F.col("fn"), F.col("p")).alias("fnr"),
    )
    return rounded(out)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def roc_curve(preds: DataFrame, keys: list[str], drop_collinear: bool = True) -> DataFrame:
    """keys, point, fpr, tpr: from (0, 0), thresholds falling; points on a straight line between their neighbours are dropped."""
    points = cumulated(by_score(preds, keys), keys)
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc())
    next_pos, next_neg = F.lead("pos").over(order), F.lead("neg").over(order)
    kept = points.withColumn("corner", next_pos.isNull() | (next_pos != F.col("pos")) | (next_neg != F.col("neg")))
    kept = kept.where("corner") if drop_collinear else kept
    start = points.select(*keys, F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "n_pos", "n_neg", F.lit(float("inf")).alias("score")).distinct()
    both = kept.select(*keys, "tp", "fp", "n_pos", "n_neg", F.col("score").cast("double").alias("score")).unionByName(start)
    point = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc())) - 1
    return rounded(both.select(*keys, point.alias("point"), ratio(F.col("fp"), F.col("n_neg")).alias("fpr"), ratio(F.col("tp"), F.col("n_pos")).alias("tpr")))


def pr_curve(preds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, point, recall, precision: thresholds rising, ended by recall 0 and precision 1."""
    points = cumulated(by_score(preds, keys), keys)
    rows = points.select(*keys, F.col("score").cast("double").alias("score"), ratio(F.col("tp"), F.col("n_pos")).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    end = points.select(*keys, F.lit(float("inf")).alias("score"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision")).distinct()
    point = F.row_number().over(Window.partitionBy(*keys).orderBy("score")) - 1
    return rounded(rows.unionByName(end).select(*keys, point.alias("point"), "recall", "precision"))


def area(curve: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Trapezoid area under an ordered curve."""
    order = Window.partitionBy(*keys).orderBy("point")
    step = F.abs(F.col(x) - F.lag(x).over(order)) * (F.col(y) + F.lag(y).over(order)) / 2
    return rounded(curve.select(*keys, step.alias("step")).groupBy(*keys).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("area")), 6)


def downsample(curve: DataFrame, keys: list[str], most: int = 250) -> DataFrame:
    """At most `most` points a curve: those at evenly spaced places, first and last included."""
    n = F.count("*").over(Window.partitionBy(*keys))
    numbered = curve.withColumn("n", n)
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * ((F.col("n") - 1) / F.lit(float(most - 1))) + F.lit(1e-9)).cast("int")))
    return numbered.where((F.col("n") <= most) | F.array_contains(places, F.col("point").cast("int"))).drop("n")


def score_histogram(preds: DataFrame, keys: list[str], bins: int = 200) -> DataFrame:
    """keys, bin, n_benign, n_malicious: equal bins on [0, 1], the last one closed; scores are set right against the real edges."""
    p = F.col("y_prob").cast("double")
    raw = F.floor(p * bins)
    fixed = raw + F.when(p < raw / bins, -1).when(p >= (raw + 1) / bins, 1).otherwise(0)
    return preds.where(p.between(0, 1)).groupBy(*keys, F.least(fixed, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.sum(1 - F.col("y_true")).alias("n_benign"), F.sum("y_true").alias("n_malicious"))


def breakdown(preds: DataFrame, keys: list[str], by: str) -> DataFrame:
    """keys, by, n, n_malicious, accuracy, detection_rate (null without positives), fpr (null without negatives); null groups go."""
    right = (F.col("y_pred") == F.col("y_true")).cast("int")
    out = preds.where(F.col(by).isNotNull()).groupBy(*keys, by).agg(
        F.count("*").alias("n"), F.sum("y_true").alias("n_malicious"), F.avg(right).alias("accuracy"),
        ratio(F.sum(F.col("y_true") * F.col("y_pred")), F.sum("y_true")).alias("detection_rate"), ratio(F.sum((1 - F.col("y_true")) * F.col("y_pred")), F.sum(1 - F.col("y_true"))).alias("fpr"),
    )
    return rounded(out)


def confusion_rates(results: DataFrame) -> DataFrame:
    """Row-normalised confusion matrix of each configuration; an empty row counts as 0."""
    negatives, positives = F.greatest(F.col("tn") + F.col("fp"), F.lit(1)), F.greatest(F.col("fn") + F.col("tp"), F.lit(1))
    rates = [F.round(F.col(c) / d, 9).alias(f"{c}_rate") for c, d in (("tn", negatives), ("fp", negatives), ("fn", positives), ("tp", positives))]
    return results.select("pipeline", "mode", "emb", "clf", *rates)
