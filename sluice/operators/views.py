"""Smaller views and selections: orders, caps, separators, key and path forms, draws, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.functions.stats import ratio
from sluice.operators.corpus import shuffle_key, stripped

UNKNOWN = 99  #: Fixed value: the ordinal of a pipeline that is not listed.


def source_rows(rows: DataFrame, source: str, columns: list[str]) -> DataFrame:
    return rows.where(F.col("source") == source).select(*columns)


def filled(*columns: str) -> Column:
    """Whether every one of the columns holds more than white space."""
    out = F.lit(True)
    for c in columns:
        out &= F.coalesce(F.length(stripped(F.col(c))) > 0, F.lit(False))
    return out


def per_sample_ms(total_seconds: Column, samples: Column) -> Column:
    return ratio(total_seconds, samples) * 1000


def without_empty(rows: DataFrame, candidates: list[str]) -> DataFrame:
    """rows without those of the candidates that hold nothing anywhere; one aggregation decides."""
    held = rows.agg(*[F.count(c).alias(c) for c in candidates]).first()
    return rows.drop(*[c for c in candidates if not held[c]])


def capabilities(results: DataFrame) -> DataFrame:
    """Per pipeline: modes with results, configurations, and how many of them have an AUC and a defined false-positive rate."""
    return results.groupBy("pipeline").agg(F.countDistinct("mode").alias("n_modes"), F.count("*").alias("n_results"), F.count_if(F.col("roc_auc").isNotNull()).alias("n_auc"), F.count_if(F.col("fpr").isNotNull()).alias("n_fpr"))


def axis_range(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    return rows.groupBy(*group).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))


def ordinal(value: Column, listed: list) -> Column:
    """The place in a list, UNKNOWN if it is not there."""
    at = F.array_position(F.array(*[F.lit(x) for x in listed]), value)
    return F.when(at > 0, at - 1).otherwise(UNKNOWN).cast("int")


def placed(rows: DataFrame, *order: Column, within: list[str] | None = None) -> DataFrame:
    """Adds place: from 1, in the order (of result tables, a few rows a configuration)."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*(within or [F.lit(0)])).orderBy(*order)))


def separators(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """Adds opens: the row begins a new group in the order."""
    before = F.lag(group).over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return rows.withColumn("opens", before.isNull() | (before != F.col(group)))


def candidates(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """The seeded candidates for n rows: a fifth and 50 more."""
    return rows.orderBy(shuffle_key(seed, F.col(key)), key).limit(int(n * 1.2) + 50)


def split_key(name: Column) -> tuple[Column, Column]:
    """The parts before and after the first double underscore."""
    return F.substring_index(name, "__", 1), F.when(F.instr(name, "__") > 0, F.substr(name, F.instr(name, "__") + 2))


def normal_path(url: Column) -> Column:
    """The url without its fragment, its parameters sorted."""
    whole = F.substring_index(url, "#", 1)
    base, query = F.substring_index(whole, "?", 1), F.when(F.instr(whole, "?") > 0, F.substr(whole, F.instr(whole, "?") + 1))
    return F.when(query.isNull() | (query == ""), base).otherwise(F.concat(base, F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&")))


def drawn_rows(rows: DataFrame, key: str, seed: int, n: int = 200, warm_up: int = 20) -> DataFrame:
    """draw, warm, key: n draws with replacement after some warm-up draws. Rows are numbered by a seeded order of at most as many rows as are drawn
    from, the smallest 16 times as many as the draws."""
    pool = rows.select(key).orderBy(shuffle_key(seed, F.col(key)), key).limit(16 * (n + warm_up))
    numbered = pool.withColumn("at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(shuffle_key(seed, F.col(key)), key)) - 1).withColumn("pool", F.count("*").over(Window.partitionBy(F.lit(0))))
    draws = rows.sparkSession.range(n + warm_up).select(F.col("id").alias("draw"), F.conv(F.substring(shuffle_key(seed + 1, F.col("id")), 1, 8), 16, 10).cast("long").alias("r"))
    hit = draws.join(F.broadcast(numbered), F.col("r") % F.col("pool") == F.col("at"))
    return hit.select("draw", (F.col("draw") < warm_up).alias("warm"), key)


def to_embed(wanted: DataFrame, present: DataFrame, columns: list[str], force: bool = False) -> DataFrame:
    """What is still to be embedded: everything if forced."""
    return wanted if force else wanted.join(present.select(*columns).distinct(), columns, "left_anti")


def require(requested: list[str], produced: DataFrame, column: str) -> None:
    """Raises unless every requested backend produced something."""
    have = {r[0] for r in produced.where(F.col(column).isin(requested)).select(column).distinct().collect()}
    if missing := [x for x in requested if x not in have]:
        raise ValueError(f"nothing was produced by {', '.join(missing)}")


def twin_counts(twins: DataFrame, group: str) -> DataFrame:
    """Documents, injected and clean rows per group."""
    return twins.groupBy(group).agg(F.countDistinct("doc_id").alias("n_documents"), F.count_if(F.col("label") == 1).alias("n_injected"), F.count_if(F.col("label") == 0).alias("n_clean"))


def without_group(preds: DataFrame, keys: list[str], by: str) -> DataFrame:
    """How many rows of each configuration a breakdown leaves out for want of a group."""
    return preds.groupBy(*keys).agg(F.count_if(F.col(by).isNull()).alias("n_without"), F.count("*").alias("n"))


def request_totals(rows: DataFrame, tokens: Column, request_tokens: int, tokens_a_minute: int, headroom: float = 0.85) -> DataFrame:
    """Tokens, the least number of requests, and the least minutes at the paced rate."""
    total = rows.agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("n_tokens"))
    return total.select("n_tokens", F.ceil(F.col("n_tokens") / request_tokens).cast("long").alias("n_batches"), F.round(F.col("n_tokens") / F.lit(tokens_a_minute * headroom), 9).alias("minutes"))


def in_groups(rows: DataFrame, group: str, trained: DataFrame) -> DataFrame:
    """Adds trained: the row's group is one of those trained on."""
    own = trained.select(F.col(group).alias("__group")).distinct().withColumn("__in", F.lit(True))
    return rows.join(own, F.col(group) == F.col("__group"), "left").withColumn("trained", F.coalesce("__in", F.lit(False))).drop("__group", "__in")


def fingerprint(listing: DataFrame, *columns: str) -> DataFrame:
    """One row that changes whenever a listed value does: an order-free digest of the rows' digests, and their number."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    word = lambda i: F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    return listing.agg(F.count("*").alias("n"), *[word(i).cast("string").alias(f"w{i}") for i in range(4)]).select("n", F.md5(F.concat_ws("|", F.col("n").cast("string"), *[F.coalesce(f"w{i}", F.lit("0")) for i in range(4)])).alias("print"))


def tree_counts(expected: DataFrame, files: DataFrame, group: str, node: str) -> DataFrame:
    """group, node rolled up: how many nodes are expected, how many have files, and how many files."""
    own = files.groupBy(group, node).agg(F.count("*").alias("__files"))
    both = expected.join(own, [group, node], "left")
    return both.rollup(group, node).agg(F.count("*").alias("n_expected"), F.count("__files").alias("n_present"), F.coalesce(F.sum("__files"), F.lit(0)).alias("n_files"))
