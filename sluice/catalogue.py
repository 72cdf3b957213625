"""All registered queries of the engine and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.operators import batching, corpus, costs, deident, metrics, ml, readside, requests, significance, views
from sluice.oracles import ORACLES  # noqa: F401
from sluice.plans.predictions import CLASSIFIERS, EMBEDDINGS, KEYS, MODES, predictions
from sluice.sources import files, shared
from sluice.sources import vectors as vector_tables

SEED = 42
MODE_NAMES = [m for m, _, _ in MODES]
EMB_NAMES = [e for e, _ in EMBEDDINGS]
CONFIGS = [f"{e}__{c}" for e in EMB_NAMES for c, _ in CLASSIFIERS]
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.detection_metrics(predictions(spark, sf_dir), KEYS)


def one_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run whose curves are shown: pipeline 1, normal. The queries of all runs end in _all_runs."""
    return predictions(spark, sf_dir, 1, "normal")


@query
def detection_metrics(spark, sf_dir):
    return results(spark, sf_dir)


@query
def best_configuration(spark, sf_dir):
    return results(spark, sf_dir).orderBy(F.col("roc_auc").desc(), *KEYS).limit(1).select(*KEYS, "roc_auc", "accuracy")


@query
def top_k_preview(spark, sf_dir):
    return results(spark, sf_dir).orderBy(F.col("roc_auc").desc(), *KEYS).limit(6).select(*KEYS, "roc_auc", "accuracy", "f1")


@query
def roc_curve(spark, sf_dir):
    return metrics.roc_curve(one_run(spark, sf_dir), ["emb", "clf"])


@query
def pr_curve(spark, sf_dir):
    return metrics.pr_curve(one_run(spark, sf_dir), ["emb", "clf"])


@query
def pr_auc_trapz(spark, sf_dir):
    return metrics.area(metrics.pr_curve(one_run(spark, sf_dir), ["emb", "clf"]), ["emb", "clf"], "recall", "precision")


@query
def curve_downsample(spark, sf_dir):
    return metrics.downsample(metrics.pr_curve(one_run(spark, sf_dir), ["emb", "clf"]), ["emb", "clf"])


@query
def roc_curve_all_runs(spark, sf_dir):
    return metrics.roc_curve(predictions(spark, sf_dir), KEYS)


@query
def pr_curve_all_runs(spark, sf_dir):
    return metrics.pr_curve(predictions(spark, sf_dir), KEYS)


@query
def pr_auc_trapz_all_runs(spark, sf_dir):
    return metrics.area(metrics.pr_curve(predictions(spark, sf_dir), KEYS), KEYS, "recall", "precision")


@query
def curve_downsample_all_runs(spark, sf_dir):
    return metrics.downsample(metrics.pr_curve(predictions(spark, sf_dir), KEYS), KEYS)


@query
def score_histogram(spark, sf_dir):
    return metrics.score_histogram(predictions(spark, sf_dir), KEYS)


@query
def breakdown_by_group(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("category"))
    return metrics.breakdown(predictions(spark, sf_dir).join(events, "row_id"), KEYS, "category")


@query
def mcnemar_within(spark, sf_dir):
    return significance.within_run(predictions(spark, sf_dir), CONFIGS)


@query
def mcnemar_top3(spark, sf_dir):
    """The three clearest differences of each run."""
    tests = significance.within_run(predictions(spark, sf_dir), CONFIGS)
    place = F.row_number().over(Window.partitionBy("pipeline", "mode").orderBy("p_holm", F.col("statistic").desc(), "a", "b_name"))
    return tests.withColumn("place", place).where("place <= 3").select("pipeline", "mode", "a", "b_name", "b", "c", "p_holm")


@query
def ablation_mcnemar(spark, sf_dir):
    return significance.across_modes(predictions(spark, sf_dir), MODE_NAMES)


@query
def mode_alignment(spark, sf_dir):
    return significance.mode_alignment(predictions(spark, sf_dir), MODE_NAMES)


@query
def ablation_degradation(spark, sf_dir):
    return significance.degradation(results(spark, sf_dir))


@query
def degradation_headline(spark, sf_dir):
    return significance.headline(significance.degradation(results(spark, sf_dir)))


@query
def master_table(spark, sf_dir):
    return readside.master_table(results(spark, sf_dir), significance.across_modes(predictions(spark, sf_dir), MODE_NAMES))


@query
def shortcut_flags(spark, sf_dir):
    return readside.shortcut_flags(readside.master_table(results(spark, sf_dir)))


@query
def pipeline_verdict(spark, sf_dir):
    return readside.pipeline_verdict(results(spark, sf_dir))


@query
def best_classifier(spark, sf_dir):
    return readside.best_classifier(results(spark, sf_dir))


@query
def ablation_groups(spark, sf_dir):
    return readside.ablation_groups(results(spark, sf_dir), MODE_NAMES)


@query
def metric_heatmap(spark, sf_dir):
    return readside.metric_heatmap(results(spark, sf_dir), EMB_NAMES)


@query
def filtered_view(spark, sf_dir):
    return readside.filtered_view(results(spark, sf_dir), [1, 2], ["normal", "context_only"], EMB_NAMES[:2], ["SVM", "XGBoost"])


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query
def usable_documents(spark, sf_dir):
    low, high = corpus.BOUNDS["cnn"]
    return docs(spark, sf_dir).where(corpus.usable_length(F.col("text"), low, high)).select("doc_id", F.length("text").alias("n"))


@query
def prefix_truncation(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(F.substring(corpus.stripped(F.col("text")), 1, corpus.PREFIX)).alias("prefix_md5"))


@query
def first_occurrence(spark, sf_dir):
    return corpus.first_occurrence(docs(spark, sf_dir), "text", "doc_id").select("doc_id", "copy")


@query
def topup_pool(spark, sf_dir):
    return corpus.topup(docs(spark, sf_dir), "text", "doc_id", 950).select("doc_id", "copy")


@query
def template_cycle(spark, sf_dir):
    return corpus.template_cycle(docs(spark, sf_dir), "text", "doc_id").select("doc_id", "template")


@query
def attack_pool_strict(spark, sf_dir):
    return corpus.strict_pools(corpus.attack_pool(table(spark, sf_dir, "benchmark"))).select("kind", "part", "category", "item_id")


def assigned(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 == 0, "code").otherwise("text").alias("kind"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("part"), F.col("text").alias("original_context"))
    return corpus.assign_attacks(rows, corpus.attack_pool(table(spark, sf_dir, "benchmark")), SEED)


@query
def attack_assignment(spark, sf_dir):
    return assigned(spark, sf_dir).select("doc_id", "kind", "part", "attack_category", F.md5("attack_instruction").alias("instruction_md5"))


@query
def twin_build(spark, sf_dir):
    rows = corpus.twins(assigned(spark, sf_dir), SEED)
    return rows.select("doc_id", "label", "injection_position", "attack_category", F.length("context").alias("n"))


@query
def insert_start_end(spark, sf_dir):
    rows = corpus.twins(assigned(spark, sf_dir), SEED).where("injection_position in ('start', 'end')")
    return rows.select("doc_id", "injection_position", F.md5("context").alias("context_md5"))


@query
def insert_middle(spark, sf_dir):
    rows = corpus.twins(assigned(spark, sf_dir), SEED).where("injection_position = 'middle'")
    return rows.select("doc_id", F.md5("context").alias("context_md5"), F.length("context").alias("n"))


@query
def grouped_split(spark, sf_dir):
    return corpus.text_split(docs(spark, sf_dir), "text", SEED).select("doc_id", "split")


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").where("toxic is not null")


@query
def stratified_split(spark, sf_dir):
    return corpus.stratified_split(labelled(spark, sf_dir), "toxic", "doc_id", SEED).select("doc_id", "toxic", "split")


@query
def balance_pool(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("doc_id", (F.col("toxic") == 0).cast("int").alias("label"))
    return corpus.balance(rows, "label", "doc_id", SEED)


@query
def label_stats(spark, sf_dir):
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_texts"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("n_toxic"), F.round(F.avg("toxic"), 9).alias("toxic_share"))


@query
def split_overlap(spark, sf_dir):
    return corpus.split_overlap(corpus.attack_pool(table(spark, sf_dir, "benchmark")))


@query
def flatten_table(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.array(F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.col("n_name")))).alias("cells"))
    return rows.select("n_regionkey", corpus.flatten_table(F.col("cells")).alias("flat"))


@query
def selected_passage(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    flags = F.transform("l", lambda x: (x["n_nationkey"] % 4 == 2).cast("int"))
    return rows.select("n_regionkey", corpus.selected_passage(flags, F.col("l.n_name")).alias("passage"))


@query
def compose_mode_text(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("intent"))
    rows = docs(spark, sf_dir).join(first, F.col("doc_id") == F.col("conv_id"), "left")
    return rows.select("doc_id", *[F.md5(corpus.compose(m, F.col("text"), F.col("intent"))).alias(m) for m in MODE_NAMES])


@query
def pii_audit(spark, sf_dir):
    return deident.audit(docs(spark, sf_dir), "text")


@query
def pii_audit_checked(spark, sf_dir):
    """The rows of the audit whose patterns are the same in every regular-expression dialect on these texts."""
    return deident.audit(docs(spark, sf_dir), "text").where(F.col("label").isin("'intended recipient'", "'received in error'", "confidentiality wording", "'Forwarded by'", "attachment stub", "SSN-shaped"))


@query
def luhn_cards(spark, sf_dir):
    hits = docs(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\b(?:\d{4}[-\s]?){3}\d{4}\b)"))).alias("card"))
    return hits.groupBy("doc_id").agg(F.count("*").alias("n_shaped"), F.sum(deident.luhn_ok(F.col("card")).cast("long")).alias("n_valid"))


def mails(spark, sf_dir):
    """Documents with the user's first turn as their subject."""
    first = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("subject"))
    return docs(spark, sf_dir).join(first, F.col("doc_id") == F.col("conv_id"), "left").select("doc_id", "text", "subject")


@query
def scrub_documents(spark, sf_dir):
    return deident.scrub(docs(spark, sf_dir), "text").select("doc_id", F.md5("scrubbed").alias("scrubbed_md5"), F.length("scrubbed").alias("n"))


@query
def scrub_mails(spark, sf_dir):
    rows = deident.scrub(mails(spark, sf_dir), "text", "subject")
    return rows.select("doc_id", F.md5("scrubbed").alias("scrubbed_md5"), F.md5("scrubbed_subject").alias("subject_md5"), "n_names")


@query
def placeholder_counts(spark, sf_dir):
    return deident.placeholder_counts(deident.scrub(docs(spark, sf_dir), "text"), "scrubbed")


def reported(spark, sf_dir):
    rows = shared.staged(deident.scrub(docs(spark, sf_dir), "text").select("doc_id", "text", "scrubbed"), "scrubbed")
    return rows, deident.audit_report(deident.audit(rows, "text"), deident.audit(rows, "scrubbed"))


@query
def audit_report(spark, sf_dir):
    return reported(spark, sf_dir)[1]


@query
def audit_totals(spark, sf_dir):
    rows, report = reported(spark, sf_dir)
    return deident.audit_totals(rows, "text", "scrubbed", report)


@query
def review_samples(spark, sf_dir):
    return deident.review_samples(deident.scrub(mails(spark, sf_dir), "text", "subject"), "doc_id").select("doc_id", F.md5("sample").alias("sample_md5"))


@query
def name_vocabulary(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.coalesce("text", F.lit("")).alias("text"))
    return deident.name_vocabulary(shared.staged(deident.detect(rows, "text"), "names"), "text")


@query
def span_merge(spark, sf_dir):
    start = (F.col("event_id") * 37 % 200).cast("int")
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), start.alias("start"), (start + 1 + (F.col("event_id") % 7).cast("int")).alias("end"), F.col("event_type").alias("kind"), ((F.col("event_id") % 5) / F.lit(10.0)).alias("score"), F.lit("rule").alias("source"))
    return deident.merge_spans(events, ["user_id"]).select("user_id", "start", "end", "kind")


@query
def token_batches(spark, sf_dir):
    rows = docs(spark, sf_dir).select((F.col("doc_id") % 8).alias("shard"), "doc_id", F.regexp_count("text", F.lit(r"\S+")).alias("tokens"))
    return batching.token_batches(rows, "shard", "doc_id", "tokens", 5_000, 64)


@query
def rolling_token_budget(spark, sf_dir):
    return batching.rolling_budget(table(spark, sf_dir, "events").withColumn("tokens", F.col("event_id") % 97), "user_id", "ts", "tokens", 3600).select("event_id", "spent")


@query
def latency_percentiles(spark, sf_dir):
    return batching.latency_percentiles(table(spark, sf_dir, "events"), "event_type", "value")


@query
def reservoir_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("k", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return corpus.sample_rows(rows, "k", SEED, 25).select("conv_id", "turn", "role")


@query
def log_state(spark, sf_dir):
    step, phase = F.concat(F.lit('##step {"label": "'), F.col("event_type"), F.lit('"}')), F.concat(F.lit('50%|## ##progress {"phase": "p'), (F.col("event_id") % 7).cast("string"), F.lit('"}'))
    lines = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 11 == 0, step).when(F.col("event_id") % 3 == 0, phase).otherwise("noise").alias("value"))
    return files.log_state(lines)


@query
def pipeline_artifacts(spark, sf_dir):
    """Expected against present artifacts of the grid, rolled up: configurations whose run has a result."""
    grid = spark.createDataFrame([(p, m) for p in (1, 2, 3, 4) for m in MODE_NAMES], "pipeline int, mode string")
    present = predictions(spark, sf_dir).select("pipeline", "mode").distinct().withColumn("here", F.lit(1))
    both = grid.join(present, ["pipeline", "mode"], "left")
    return both.rollup("pipeline", "mode").agg(F.count("*").alias("n_expected"), F.coalesce(F.sum("here"), F.lit(0)).alias("n_present"))


def vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") % 2).cast("double").alias("label"), "embedding")
    rows = ml.with_vector(rows, "embedding").drop("embedding")
    return corpus.stratified_split(rows, "label", "row_id", SEED)


def train_eval(name):
    def run(spark, sf_dir):
        rows = shared.staged(vectors(spark, sf_dir), "vectors")
        model = ml.fit(rows.where("split = 'train'"), name)
        scored = ml.scores(model, rows.where("split = 'test'")).withColumn("clf", F.lit(name))
        return metrics.detection_metrics(scored, ["clf"])

    return run


for _name, _clf in (("train_eval_lr", "LogisticRegression"), ("train_eval_rf", "RandomForest"), ("train_eval_svc", "SVM"), ("train_eval_gbt", "XGBoost")):
    QUERIES[_name] = train_eval(_clf)


@query
def pca_projection(spark, sf_dir):
    return ml.pca_2d(vectors(spark, sf_dir))


@query
def hashed_embedding(spark, sf_dir):
    rows = ml.hashed_embedding(docs(spark, sf_dir), "text")
    return rows.select("doc_id", F.size("vec").alias("dim"), F.round(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)), 4).alias("norm"))


@query
def confusion_rates(spark, sf_dir):
    return metrics.confusion_rates(results(spark, sf_dir))


@query
def degradation_cells(spark, sf_dir):
    return readside.degradation_cells(master_table(spark, sf_dir))


@query
def trained_subset(spark, sf_dir):
    """Which requested embeddings a run lacks; pipeline 4 has none."""
    wanted = spark.createDataFrame([(p, m, e) for p in (1, 2, 3, 4) for m in MODE_NAMES for e in EMB_NAMES], "pipeline int, mode string, emb string")
    out = readside.lacking(wanted, predictions(spark, sf_dir), ["pipeline", "mode"], "emb")
    return out.select("pipeline", "mode", F.array_join("missing", ",").alias("missing"), "complete")


@query
def cost_summary(spark, sf_dir):
    return batching.cost_summary(table(spark, sf_dir, "events"), "event_type", "value")


@query
def embedding_plan(spark, sf_dir):
    return requests.plan(docs(spark, sf_dir), "lang", "text")


@query
def usable_by_source(spark, sf_dir):
    names = sorted(corpus.BOUNDS)
    rows = docs(spark, sf_dir).select("doc_id", "text", F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int")).alias("kind"))
    return corpus.usable_by_source(rows, "kind", "text", corpus.BOUNDS).select("doc_id", "kind")


@query
def renumbered_ids(spark, sf_dir):
    return corpus.renumbered(docs(spark, sf_dir), "text", "doc_id", "aeslc").select("doc_id", "new_id")


@query
def job_progress(spark, sf_dir):
    events = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.sum((F.col("event_type") == "click").cast("long")).alias("done"), (F.max(F.unix_seconds(F.col("ts").cast("timestamp"))) - F.min(F.unix_seconds(F.col("ts").cast("timestamp")))).alias("elapsed"))
    fraction, left = readside.progress(F.col("user_id") % 20, F.lit(19), F.col("done"), F.col("total"), F.col("elapsed"))
    return events.select("user_id", F.round(fraction, 9).alias("fraction"), left.cast("long").alias("seconds_left"))


@query
def upload_guard(spark, sf_dir):
    name = F.concat(F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, (".txt", ".JSONL", ".exe"))), (F.col("doc_id") % 3 + 1).cast("int")))
    return docs(spark, sf_dir).select("doc_id", readside.upload_verdict(name, F.col("text")).alias("verdict"))


@query
def dataset_peek(spark, sf_dir):
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(F.col(c))
    return docs(spark, sf_dir).select("doc_id", F.md5(cut("text", 110)).alias("short_md5"), F.md5(cut("text", 170)).alias("long_md5"))


def spoiled(spark, sf_dir):
    """Predictions with a mode over other rows (pipeline 2, context_only) and a missing one (pipeline 3, user_intent_only)."""
    other = (F.col("pipeline") == 2) & (F.col("mode") == "context_only") & (F.col("row_id") % 10 == 0)
    return predictions(spark, sf_dir).where(~other & ~((F.col("pipeline") == 3) & (F.col("mode") == "user_intent_only")))


@query
def alignment_spoiled(spark, sf_dir):
    return significance.mode_alignment(spoiled(spark, sf_dir), MODE_NAMES)


@query
def ablation_mcnemar_spoiled(spark, sf_dir):
    return significance.across_modes(spoiled(spark, sf_dir), MODE_NAMES)


@query
def ablation_degradation_spoiled(spark, sf_dir):
    return significance.degradation(metrics.detection_metrics(significance.aligned(spoiled(spark, sf_dir), MODE_NAMES), KEYS))


def compared(spark, sf_dir, reference):
    preds = spoiled(spark, sf_dir)
    return readside.comparison(metrics.detection_metrics(preds, KEYS), significance.across_modes(preds, MODE_NAMES), reference, MODE_NAMES)


@query
def comparison_normal(spark, sf_dir):
    return compared(spark, sf_dir, "normal")


@query
def comparison_intent(spark, sf_dir):
    return compared(spark, sf_dir, "user_intent_only")


@query
def comparison_notes(spark, sf_dir):
    preds = spoiled(spark, sf_dir)
    return readside.comparison_notes(metrics.detection_metrics(preds, KEYS), significance.across_modes(preds, MODE_NAMES), "user_intent_only")


@query
def ablation_groups_all(spark, sf_dir):
    return readside.ablation_groups(results(spark, sf_dir), MODE_NAMES, "all")


@query
def source_rows(spark, sf_dir):
    return views.source_rows(docs(spark, sf_dir), "src0", ["doc_id", "lang", "source", "n_chars"])


@query
def filled_rows(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("intent"))
    return docs(spark, sf_dir).join(first, F.col("doc_id") == F.col("conv_id"), "left").where(views.filled("text", "intent")).select("doc_id")


@query
def per_sample_ms(spark, sf_dir):
    events = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    return events.select("event_type", F.round(views.per_sample_ms(F.col("total"), F.col("n")), 6).alias("ms"))


@query
def without_empty(spark, sf_dir):
    rows = results(spark, sf_dir).select(*KEYS, "accuracy", F.lit(None).cast("double").alias("train_seconds"))
    return views.without_empty(rows, ["accuracy", "train_seconds"])


@query
def capabilities(spark, sf_dir):
    return views.capabilities(results(spark, sf_dir))


@query
def axis_range(spark, sf_dir):
    return views.axis_range(results(spark, sf_dir), ["mode"], "roc_auc")


@query
def group_separators(spark, sf_dir):
    rows = results(spark, sf_dir).where("mode = 'normal'").select("pipeline", "emb", "clf", "roc_auc")
    return views.separators(rows, "emb", F.col("pipeline"), F.col("emb"), F.col("clf"))


@query
def degradation_order(spark, sf_dir):
    rows = significance.degradation(results(spark, sf_dir)).select("pipeline", "emb", "clf", "reference", "variant", "deg_roc_auc")
    return views.placed(rows, F.col("reference"), F.col("variant"), F.col("deg_roc_auc").desc(), F.col("pipeline"), F.col("emb"), F.col("clf"))


@query
def configuration_order(spark, sf_dir):
    rows = results(spark, sf_dir).where("mode = 'normal'").select("pipeline", "emb", "clf").withColumn("ordinal", views.ordinal(F.col("pipeline"), [3, 1]))
    return views.placed(rows, F.col("ordinal"), F.col("pipeline"), F.col("emb"), F.col("clf"))


@query
def sorted_in_pipelines(spark, sf_dir):
    rows = results(spark, sf_dir).select(*KEYS, "f1")
    return views.placed(rows, F.col("f1").desc_nulls_last(), *[F.col(k) for k in KEYS], within=["pipeline"])


@query
def candidate_rows(spark, sf_dir):
    return views.candidates(docs(spark, sf_dir), "doc_id", SEED, 100).select("doc_id")


@query
def breakdown_order(spark, sf_dir):
    events = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_row"))
    return views.placed(events, F.col("n").desc(), F.col("first_row"))


@query
def merged_attack_pool(spark, sf_dir):
    pool = corpus.attack_pool(table(spark, sf_dir, "benchmark"))
    return pool.where("part = 'train'").unionAll(pool.where("part = 'test'")).groupBy("kind", "category").agg(F.count("*").alias("n"))


@query
def configuration_keys(spark, sf_dir):
    names = results(spark, sf_dir).select(F.concat_ws("__", "emb", "clf", F.concat("mode", F.lit("__x"))).alias("name")).distinct()
    emb, rest = views.split_key(F.col("name"))
    return names.select("name", F.upper(emb).alias("emb"), rest.alias("rest"))


@query
def normal_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", views.normal_path(F.col("url")).alias("path"))


@query
def stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm").alias("stamp"))


@query
def latency_draws(spark, sf_dir):
    return views.drawn_rows(table(spark, sf_dir, "embeddings"), "vec_id", SEED)


@query
def projection_sample(spark, sf_dir):
    return corpus.sample_rows(table(spark, sf_dir, "events").select("event_id"), "event_id", SEED, 5_000)


@query
def rows_to_embed(spark, sf_dir):
    """Documents without a vector of their id."""
    have = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return views.to_embed(docs(spark, sf_dir).select("doc_id"), have, ["doc_id"])


@query
def vectors_of_rows(spark, sf_dir):
    """Rows joined with their vectors by row id."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("dim"), F.col("label"))
    return docs(spark, sf_dir).select("doc_id", "lang").join(own, "doc_id")


@query
def twin_counts(spark, sf_dir):
    rows = corpus.twins(assigned(spark, sf_dir), SEED)
    return views.twin_counts(rows.withColumn("position", F.coalesce("injection_position", F.lit("none"))), "position")


@query
def rows_without_group(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("category"))
    return views.without_group(predictions(spark, sf_dir).join(events, "row_id"), KEYS, "category")


@query
def request_totals(spark, sf_dir):
    tokens = F.greatest(F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)), F.lit(1))
    return views.request_totals(docs(spark, sf_dir), tokens, 100_000, 1_000_000)


@query
def trained_groups(spark, sf_dir):
    texts = docs(spark, sf_dir).select("doc_id", F.md5("text").alias("digest"))
    return views.in_groups(texts, "digest", texts.where("doc_id % 4 = 0")).select("doc_id", "trained")


@query
def listing_print(spark, sf_dir):
    return views.fingerprint(table(spark, sf_dir, "events"), "event_id", "event_type")


@query
def tree_counts(spark, sf_dir):
    grid = spark.createDataFrame([(p, m) for p in (1, 2, 3, 4) for m in MODE_NAMES], "pipeline int, mode string")
    files = predictions(spark, sf_dir).select("pipeline", "mode", "emb").distinct()
    return views.tree_counts(grid, files, "pipeline", "mode")


@query
def usable_mails(spark, sf_dir):
    rows = corpus.usable_mails(mails(spark, sf_dir), "text", "subject")
    return rows.select("doc_id", F.md5("text").alias("text_md5"), F.length("subject").alias("n_subject"))


@query
def usable_articles(spark, sf_dir):
    return corpus.usable_articles(docs(spark, sf_dir), "text").select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n"))


@query
def usable_questions(spark, sf_dir):
    return corpus.usable_questions(mails(spark, sf_dir), "subject", "text", "ms_marco").select("doc_id", F.md5("subject").alias("question_md5"))


@query
def breakdown_columns(spark, sf_dir):
    """The columns of documents and labels by which results can be broken down: only those that are there."""
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    return files.metadata(rows).groupBy("source", "label").agg(F.count("*").alias("n"))


@query
def unpaired_vectors(spark, sf_dir):
    """Documents without a vector and vectors without a document."""
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("row_id"))
    return vector_tables.lacking(rows, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id")))


@query
def pca_variance(spark, sf_dir):
    return ml.pca_variance(vectors(spark, sf_dir))


@query
def environment(spark, sf_dir):
    return costs.environment(spark)


@query
def latency_figures(spark, sf_dir):
    """The figures of the events' own durations, as of a probe's samples."""
    found = costs.latency(table(spark, sf_dir, "events"), "value")
    return found.select(*[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99", "least")], "n")
