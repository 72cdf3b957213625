"""The dashboard's queries: master table, shortcut flags, verdicts, best picks, heatmap, views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.operators.corpus import stripped
from sluice.operators.metrics import METRICS, rounded

#: The three thresholds of the three shortcut rules, and the verdict rule.
LEAK_AUC = 0.99
VERDICT_SHORTCUT, VERDICT_CHANCE, VERDICT_NORMAL = 0.90, 0.60, 0.80
CELL_POINTS = 0.5


def master_table(results: DataFrame, tests: DataFrame | None = None, reference: str = "normal", variants: tuple[str, ...] = ("user_intent_only", "context_only")) -> DataFrame:
    """One row per configuration of the reference mode, with each variant's AUC and degradation (null where it did not run) and, from
    tests of mode pairs, its adjusted p. One pass: modes are pivoted by conditional aggregation."""
    key = ["pipeline", "emb", "clf"]
    cells = [F.max(F.when(F.col("mode") == m, F.col(c))).alias(f"{m}_{c}") for m in (reference, *variants) for c in ("roc_auc", "accuracy")]
    wide = results.groupBy(*key).agg(*cells).where(F.col(f"{reference}_roc_auc").isNotNull())
    for v in variants:
        wide = wide.withColumn(f"{v}_deg", F.col(f"{reference}_roc_auc") - F.col(f"{v}_roc_auc"))
        if tests is not None:
            pair = tests.where((F.least("a", "b_name") == min(reference, v)) & (F.greatest("a", "b_name") == max(reference, v)))
            wide = wide.join(pair.select(*key, F.col("p_holm").alias(f"{v}_p"), F.col("significant").alias(f"{v}_significant")), key, "left")
    return rounded(wide)


def comparison(results: DataFrame, tests: DataFrame, reference: str, modes: list[str]) -> DataFrame:
    """The whole master table of any reference mode: its six metrics, and of each other mode the metric, the degradation, and the test's
    adjusted p, significance, b and c (null where there is none); flagged where intent alone reaches the leak threshold or loses nothing."""
    key, variants = ["pipeline", "emb", "clf"], [m for m in modes if m != reference]
    cells = [F.max(F.when(F.col("mode") == m, F.col(c))).alias(f"{m}_{c}") for m in (reference, *variants) for c in METRICS]
    wide = results.groupBy(*key).agg(F.count_if(F.col("mode") == reference).alias("__has"), *cells).where("__has > 0").drop("__has")
    for v in variants:
        wide = wide.withColumns({f"{v}_deg_{m}": F.col(f"{reference}_{m}") - F.col(f"{v}_{m}") for m in METRICS})
        pair = tests.where((F.least("a", "b_name") == min(reference, v)) & (F.greatest("a", "b_name") == max(reference, v)))
        wide = wide.join(pair.select(*key, F.col("p_holm").alias(f"{v}_p"), F.col("significant").alias(f"{v}_significant"), F.col("b").alias(f"{v}_b"), F.col("c").alias(f"{v}_c")), key, "left")
    flag = F.lit(False)
    if "user_intent_only" in variants:
        flag = F.when(F.col("user_intent_only_roc_auc") >= LEAK_AUC, True).otherwise(F.coalesce(F.col("user_intent_only_deg_roc_auc") <= 0, F.lit(False)))
    return rounded(wide.withColumn("shortcut", flag))


def comparison_notes(results: DataFrame, tests: DataFrame, reference: str) -> DataFrame:
    """note, n: configurations without a result of the reference mode, which the table leaves out, and pipelines without tests."""
    has = results.groupBy("pipeline", "emb", "clf").agg(F.count_if(F.col("mode") == reference).alias("n"))
    omitted = has.where("n = 0").agg(F.count("*").alias("n")).select(F.lit("no reference").alias("note"), "n")
    tested = results.select("pipeline").distinct().join(tests.select("pipeline").distinct(), "pipeline", "left_anti")
    return omitted.unionByName(tested.agg(F.count("*").alias("n")).select(F.lit("no tests").alias("note"), "n"))


def shortcut_flags(master: DataFrame, variant: str = "user_intent_only") -> DataFrame:
    """Suspected where intent alone reaches the leak threshold, or loses nothing; never where intent alone is the reference."""
    if f"{variant}_deg" not in master.columns:
        return master.select("pipeline", "emb", "clf", F.lit(None).cast("double").alias("intent_auc"), F.lit(None).cast("double").alias("degradation"), F.lit(False).alias("shortcut"))
    auc, deg = F.col(f"{variant}_roc_auc"), F.col(f"{variant}_deg")
    return master.select("pipeline", "emb", "clf", auc.alias("intent_auc"), deg.alias("degradation"), F.when(auc >= LEAK_AUC, True).otherwise(F.coalesce(deg <= 0, F.lit(False))).alias("shortcut"))


def first_by(results: DataFrame, group: list[str], metric: str, ties: list[str]) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col(metric).desc_nulls_last(), *ties)
    return results.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def pipeline_verdict(results: DataFrame) -> DataFrame:
    """Per pipeline: shortcut, detects or inconclusive, of the best AUC of each mode; accuracy is of the same row."""
    best = first_by(results, ["pipeline", "mode"], "roc_auc", ["emb", "clf"])
    pick = lambda m, c: F.max(F.when(F.col("mode") == m, F.col(c)))
    one = best.groupBy("pipeline").agg(pick("normal", "roc_auc").alias("normal_auc"), pick("normal", "accuracy").alias("normal_accuracy"), pick("user_intent_only", "roc_auc").alias("intent_auc"), pick("context_only", "roc_auc").alias("context_auc"))
    verdict = F.when(F.col("normal_auc").isNull() & F.col("intent_auc").isNull(), "no runs").when(F.col("intent_auc") >= VERDICT_SHORTCUT, "shortcut").when((F.col("intent_auc") <= VERDICT_CHANCE) & (F.col("normal_auc") >= VERDICT_NORMAL), "detects").otherwise("inconclusive")
    return one.withColumn("verdict", verdict)


def best_classifier(results: DataFrame, mode: str = "normal") -> DataFrame:
    """The classifier with the best AUC per pipeline and embedding; a tie goes to the first by name."""
    return first_by(results.where(F.col("mode") == mode), ["pipeline", "emb"], "roc_auc", ["clf"]).select("pipeline", "emb", "clf", "roc_auc")


def ablation_groups(results: DataFrame, modes: list[str], classifier: str = "best") -> DataFrame:
    """Per pipeline and embedding the AUC in every mode: of the best classifier, of all, or of a named one."""
    if classifier == "best":
        rows = results.join(F.broadcast(best_classifier(results).select("pipeline", "emb", "clf")), ["pipeline", "emb", "clf"])
    else:
        rows = results if classifier == "all" else results.where(F.col("clf") == classifier)
    return rows.groupBy("pipeline", "emb", "clf").pivot("mode", modes).agg(F.first("roc_auc"))


def metric_heatmap(results: DataFrame, embeddings: list[str], mode: str = "normal", metric: str = "accuracy") -> DataFrame:
    return results.where(F.col("mode") == mode).groupBy("pipeline", "clf").pivot("emb", embeddings).agg(F.first(metric))


def filtered_view(results: DataFrame, pipelines: list[int], modes: list[str], embeddings: list[str], classifiers: list[str]) -> DataFrame:
    """The rows in all four sets, best picks flagged, with 'n of m' counts."""
    shown = results.where(F.col("pipeline").isin(pipelines) & F.col("mode").isin(modes) & F.col("emb").isin(embeddings) & F.col("clf").isin(classifiers))
    picks = best_classifier(results).select("pipeline", "emb", "clf", F.lit(True).alias("pick"))
    flagged = shown.join(F.broadcast(picks), ["pipeline", "emb", "clf"], "left")
    total = results.agg(F.count("*").alias("total"))
    return flagged.crossJoin(F.broadcast(total)).select("pipeline", "mode", "emb", "clf", "roc_auc", F.coalesce("pick", F.lit(False)).alias("best"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("shown"), "total")


def cell_class(points: F.Column, intent: F.Column, significant: F.Column) -> F.Column:
    """The class of a degradation cell, points in percentage points."""
    base = F.when(points > CELL_POINTS, "pos").when(intent, "alarm").otherwise("flat")
    return F.when(F.coalesce(significant, F.lit(True)), base).otherwise(F.concat(base, F.lit(" ns")))


def p_text(p: F.Column) -> F.Column:
    return F.when(p == 0, "< 1e-300").otherwise(F.format_string("%.2e", p))


def degradation_cells(master: DataFrame, variants: tuple[str, ...] = ("user_intent_only", "context_only")) -> DataFrame:
    """The class of every variant's degradation cell of a master table with tests."""
    cells = [cell_class(F.col(f"{v}_deg") * 100, F.lit(v == "user_intent_only"), F.col(f"{v}_significant")).alias(f"{v}_class") for v in variants]
    return master.select("pipeline", "emb", "clf", *cells)


def progress(step: F.Column, steps: F.Column, done: F.Column, total: F.Column, elapsed: F.Column) -> tuple[F.Column, F.Column]:
    """The fraction done, a step marker meaning that the step began, and the whole seconds left (null up to 2 %)."""
    inner = F.when(total > 0, F.least(F.lit(1.0), done / total)).otherwise(0.0)
    fraction = F.least(F.lit(1.0), (F.greatest(F.lit(0), step - 1) + inner) / steps)
    return fraction, F.when(fraction > 0.02, F.floor(elapsed * (1 - fraction) / fraction + 0.5))


def upload_verdict(name: F.Column, text: F.Column, most_bytes: int = 1 << 20) -> F.Column:
    """Why an uploaded text is refused: type, size, binary or empty; else ok."""
    return (
        F.when(~F.lower(name).rlike(r"\.(txt|html|json|jsonl|csv|tsv|py|js)$"), "type").when(F.octet_length(text) > most_bytes, "size")
        .when(text.rlike(r"[\x00-\x08\x0e-\x1f]"), "binary").when(F.coalesce(F.length(stripped(text)), F.lit(0)) == 0, "empty").otherwise("ok")
    )


def lacking(requested: DataFrame, trained: DataFrame, run: list[str], item: str) -> DataFrame:
    """Per run: what was requested and not trained, in order, and whether the run is complete."""
    have = trained.select(*run, item).distinct().withColumn("__here", F.lit(True))
    both = requested.select(*run, item).distinct().join(have, [*run, item], "left")
    missing = F.array_sort(F.collect_list(F.when(F.col("__here").isNull(), F.col(item))))
    return both.groupBy(*run).agg(missing.alias("missing")).withColumn("complete", F.size("missing") == 0)
