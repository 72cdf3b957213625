"""Corpus building: length filters, first occurrence, top-up, attack pools, twins, insertion, splits, balance.

Random choices are md5 ranks of a seed and a key: reproducible in any engine and in any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.operators.ordered import cutoffs, running, up_to
from sluice.sources.shared import spread

#: Inclusive length bounds of each source.
BOUNDS = {"ms_marco": (150, 6000), "fetaqa": (50, 8000), "cosqa": (20, 6000), "aeslc": (200, 5000), "cnn": (200, 6000)}
PREFIX = 6000
LEAST_SUBJECT = 3
SEPARATOR = "\n\n---\n\n"


def stripped(text: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def usable_length(text: Column, low: int, high: int) -> Column:
    return F.coalesce(F.length(stripped(text)).between(low, high) & (F.length(text) > 0), F.lit(False))


def shuffle_key(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def first_occurrence(docs: DataFrame, text: str, order: str) -> DataFrame:
    """Adds copy: 1 for the first row of a text in the given numeric order, 2, 3 ... for later ones. Digests are compared, not texts."""
    keyed = docs.withColumn("__digest", F.sha2(F.coalesce(F.concat(F.lit("v"), F.col(text)), F.lit("n")), 256))
    return running(keyed, ["__digest"], order).withColumn("copy", (F.col("before") + 1).cast("int")).drop("before", "__digest")


def topup(docs: DataFrame, text: str, order: str, n: int) -> DataFrame:
    """n rows: first occurrences in order, then later copies if those do not suffice."""
    ranked = first_occurrence(docs, text, order)
    return ranked.orderBy(F.col("copy") > 1, order).limit(n)


def distinct_rank(docs: DataFrame, text: str, order: str) -> DataFrame:
    """Adds copy and rank: how many distinct texts came before this row."""
    ranked = first_occurrence(docs, text, order)
    return running(ranked, [], order, (F.col("copy") == 1).cast("long")).withColumnRenamed("before", "rank")


def template_cycle(docs: DataFrame, text: str, order: str, templates: int = 5) -> DataFrame:
    """Adds template: how many distinct texts came before this row, modulo the templates."""
    return distinct_rank(docs, text, order).withColumn("template", (F.col("rank") % templates).cast("int")).drop("rank")


def renumbered(docs: DataFrame, text: str, order: str, prefix: str) -> DataFrame:
    """First occurrences with new_id: prefix and a five-digit number in order."""
    first = distinct_rank(docs, text, order).where("copy = 1")
    return first.withColumn("new_id", F.format_string(f"{prefix}_%05d", "rank")).drop("copy", "rank")


def usable_by_source(docs: DataFrame, source: str, text: str, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows within their source's length bounds; rows of other sources go. The bounds are a literal map."""
    at = F.create_map(*[F.lit(x) for name, b in bounds.items() for x in (name, F.array(*map(F.lit, b)))])
    pair = F.try_element_at(at, F.col(source))
    return docs.where(F.coalesce(usable_length(F.col(text), pair[0], pair[1]), F.lit(False)))


def usable_mails(docs: DataFrame, body: str, subject: str) -> DataFrame:
    """Mails with a body within its bounds and a subject of three characters or more, both stripped."""
    subject_ok = F.coalesce(F.length(stripped(F.col(subject))) >= LEAST_SUBJECT, F.lit(False))
    return docs.where(usable_length(F.col(body), *BOUNDS["aeslc"]) & subject_ok).withColumns({body: stripped(F.col(body)), subject: stripped(F.col(subject))})


def usable_articles(docs: DataFrame, text: str) -> DataFrame:
    """Articles cut to their first characters, then held against the bounds: a long one stays, cut."""
    return docs.withColumn(text, F.substring(stripped(F.col(text)), 1, PREFIX)).where(usable_length(F.col(text), *BOUNDS["cnn"]))


def usable_questions(docs: DataFrame, question: str, passage: str, source: str) -> DataFrame:
    """Rows with a question and a passage that both hold more than white space, the passage within its source's bounds."""
    asked = F.coalesce(F.length(stripped(F.col(question))) > 0, F.lit(False))
    return docs.where(asked & usable_length(F.col(passage), *BOUNDS[source])).withColumns({question: stripped(F.col(question)), passage: stripped(F.col(passage))})


def attack_pool(benchmark: DataFrame) -> DataFrame:
    """kind, part, category, instruction out of the benchmark table: category item_id % 8; even categories train."""
    category = F.col("item_id") % 8
    return benchmark.select(F.when(F.col("item_id") % 3 == 0, "code").otherwise("text").alias("kind"), F.when(category % 2 == 0, "train").otherwise("test").alias("part"), F.concat(F.lit("cat"), category.cast("string")).alias("category"), F.col("text").alias("instruction"), "item_id")


def strict_pools(pool: DataFrame) -> DataFrame:
    """Test categories that train has too, per kind, leave the test part."""
    train = pool.where("part = 'train'").select("kind", "category").distinct()
    return pool.where("part = 'train'").unionByName(pool.where("part = 'test'").join(train, ["kind", "category"], "left_anti"))


def assign_attacks(docs: DataFrame, pool: DataFrame, seed: int, key: str = "doc_id") -> DataFrame:
    """docs: kind, part, key. Each document gets one instruction of its (kind, part)."""
    numbered = pool.withColumn("pick", F.row_number().over(Window.partitionBy("kind", "part").orderBy("item_id"))).withColumn("pool_size", F.count("*").over(Window.partitionBy("kind", "part")))
    sizes = numbered.select("kind", "part", "pool_size").distinct()
    number = F.conv(F.substring(shuffle_key(seed, F.col(key)), 1, 8), 16, 10).cast("long")
    drawn = docs.join(F.broadcast(sizes), ["kind", "part"]).withColumn("pick", (number % F.col("pool_size") + 1).cast("int"))
    return drawn.join(numbered.select("kind", "part", "pick", F.col("category").alias("attack_category"), F.col("instruction").alias("attack_instruction")), ["kind", "part", "pick"]).drop("pick", "pool_size")


def position(seed: int, key: Column) -> Column:
    number = F.conv(F.substring(shuffle_key(seed, key), 9, 8), 16, 10).cast("long")
    return F.element_at(F.array(F.lit("start"), F.lit("middle"), F.lit("end")), (number % 3 + 1).cast("int"))


def sentence_start(text: Column, number: Column) -> Column:
    """The 0-based start of sentence number modulo the sentences: the text's start, or what follows . ! or ? and white space."""

    def start(parts: Column) -> Column:
        k = (number % F.size(parts)).cast("int")
        before = F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda n, p: n + F.length(p))
        own = F.element_at(parts, k + 1)
        return before + F.when(k > 0, F.length(own) - F.length(F.regexp_replace(own, r"^\s+", ""))).otherwise(0)

    # A one-element array binds the parts, so that the text is split once.
    return F.element_at(F.transform(F.array(F.split(text, r"(?<=[.!?])(?=\s)")), start), 1)


def insert(context: Column, attack: Column, where: Column, seed: int, key: Column) -> Column:
    """The attack on its own line at the start, the end, or before a seeded sentence."""
    number = F.conv(F.substring(shuffle_key(seed, key), 17, 8), 16, 10).cast("long")
    at = sentence_start(context, number)
    middle = F.element_at(F.transform(F.array(at), lambda a: F.concat(F.substr(context, F.lit(1), a), F.lit("\n"), attack, F.lit("\n"), F.substr(context, a + 1))), 1)
    return F.when(where == "start", F.concat_ws("\n", attack, context)).when((where == "end") | (F.length(stripped(context)) == 0), F.concat_ws("\n", context, attack)).otherwise(middle)


def twins(docs: DataFrame, seed: int, key: str = "doc_id") -> DataFrame:
    """docs: key, context, attack columns. A clean and an injected row of each document, attack fields null on the clean one."""
    where = position(seed, F.col(key))
    injected = F.struct(F.lit(1).alias("label"), insert(F.col("original_context"), F.col("attack_instruction"), where, seed, F.col(key)).alias("context"), where.alias("injection_position"), F.col("attack_category").alias("attack_category"))
    clean = F.struct(F.lit(0).alias("label"), F.col("original_context").alias("context"), F.lit(None).cast("string").alias("injection_position"), F.lit(None).cast("string").alias("attack_category"))
    return spread(docs).withColumn("__t", F.explode(F.array(clean, injected))).select(key, "original_context", "__t.*")


def text_split(docs: DataFrame, text: str, seed: int, train: float = 0.8) -> DataFrame:
    """Adds split: every distinct text on one side; round(half even) of the texts' number times train are train.

    Rows are told their side by their text's key alone: the key at the cut is found first, and no row is moved.
    """
    key = F.coalesce(shuffle_key(seed, F.col(text)), F.lit(""))
    keys = docs.select(F.lit(0).alias("g"), key.alias("k")).distinct()
    found = cutoffs(keys, "g", "k", lambda _, n: round(n * train))
    return docs.withColumn("split", F.when(up_to(key, F.lit(0), found), "train").otherwise("test"))


def stratified_split(rows: DataFrame, label: str, key: str, seed: int, test: float = 0.2) -> DataFrame:
    """Adds split: round(half even) of each label's rows times test are test, by the row key's place in a seeded order."""
    order = shuffle_key(seed, F.col(key))
    found = cutoffs(rows.select(F.col(label).alias("g"), order.alias("k")), "g", "k", lambda _, n: round(n * test))
    return rows.withColumn("split", F.when(up_to(order, F.col(label), found), "test").otherwise("train"))


def assign_split(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """By priority: the split column if there is one, else by group (original_context, else doc_id), else stratified by label."""
    if "split" in rows.columns:
        return rows
    for group in ("original_context", "doc_id"):
        if group in rows.columns and group != key:
            return text_split(rows, group, seed)
    return stratified_split(rows, label, key, seed)


def balance(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """All benign rows and as many malicious ones at most, drawn without replacement; benign rows are never padded."""
    benign = rows.where(F.col(label) == 0).count()
    order = shuffle_key(seed, F.col(key))
    bad = rows.where(F.col(label) == 1)
    found = cutoffs(bad.select(F.lit(1).alias("g"), order.alias("k")), "g", "k", lambda _, n: min(n, benign))
    return rows.where((F.col(label) == 0) | ((F.col(label) == 1) & up_to(order, F.lit(1), found)))


def sample_rows(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """Exactly n rows (or all), without replacement."""
    return rows.orderBy(shuffle_key(seed, F.col(key)), key).limit(n)


def flatten_table(table: Column) -> Column:
    """Cells joined by ' | ', rows by a newline."""
    return F.array_join(F.transform(table, lambda r: F.array_join(r, " | ")), "\n")


def selected_passage(selected: Column, texts: Column) -> Column:
    """The first text whose flag is 1, else the first."""
    pairs = F.arrays_zip(selected.alias("s"), texts.alias("t"))
    return F.coalesce(F.get(F.filter(pairs, lambda x: x["s"] == 1), F.lit(0))["t"], F.get(texts, F.lit(0)))


def compose(mode: str, context: Column, intent: Column) -> Column:
    """The text to embed; missing parts become the text None, an empty text one space."""
    c, i = F.coalesce(context, F.lit("None")), F.coalesce(intent, F.lit("None"))
    text = {"user_intent_only": i, "context_only": c}.get(mode, F.concat(c, F.lit(SEPARATOR), i))
    return F.when(F.length(stripped(text)) == 0, " ").otherwise(text)


def split_overlap(pool: DataFrame) -> DataFrame:
    """Per kind: distinct categories of either part and how many are in both (0 for sound pools)."""
    sets = pool.groupBy("kind").agg(F.collect_set(F.when(F.col("part") == "train", F.col("category"))).alias("a"), F.collect_set(F.when(F.col("part") == "test", F.col("category"))).alias("b"))
    return sets.select("kind", F.size("a").cast("long").alias("n_train"), F.size("b").cast("long").alias("n_test"), F.size(F.array_intersect("a", "b")).cast("long").alias("n_both"))
