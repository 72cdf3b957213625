"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source's words, its documents in a seeded order, form a stream that is cut into blocks of equal length.
Seats of the mix are apportioned to the sources by highest quotients weight / (2k - 1); seats in that order are
dealt to shards, so every shard has an integer quota per source and the quotas of the first j shards are the
apportionment of the first j shards' seats; the seats of a source at its limit are spread evenly in the same way. Then every
shard draws its quota of blocks: a source's blocks stand in a seeded order, and the shards take them in turn, from the
front again after the last one. So every block is taken floor(quota / blocks) times, and the first (quota mod blocks) once more.

Targets: the mix holds `share` of all words, split by weight; none exceeds `limit` times its source's words, and
the excess is split again by weight (closed form: sources sorted by limit / weight). Sources at the limit are taken whole.

Native: DataFrame functions alone. Streams, seats and blocks are ordered slice by slice (common.running); a document finds the
words it gives from the cumulated extra words of the blocks where it starts and ends, so long documents and
documents within one block cost the same.

Defined cases: null text has size 0 and gives 0 words; null source is a source of its own, ordered last; repeated rows
are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

CUTS = 64  #: slices of the seats and of a source's blocks


@dataclass(frozen=True)
class Mix:
    rows: DataFrame  #: one row per document
    quotas: DataFrame  #: shard, source, blocks
    blocks: DataFrame  #: source, at, length, shards: which shards took the block, once for each time
    targets: DataFrame  #: source, size, weight, target


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """sizes: __g, source, size. Adds weight, target and capped; one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    out = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    out = out.withColumn("cap", F.col("size") * F.lit(float(limit)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "__g")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    out = out.withColumn("level", (F.sum("size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    out = out.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    # All sources from the first that is below its limit on share one level.
    out = out.withColumn("final", F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return out.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("final") * F.col("weight"))).drop("cap", "level", "final")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, shards: int = 16, seats_per_shard: int = 512, least_seats: int = 16, seed: int = 23, source: str = "source", key: str = "doc_id", text: str = "text") -> Mix:
    """rows: doc_id, size, source_size, target, taken, copies (how often the block in which the document starts is taken),
    shards (by which shards, ascending), source, text_crc32. seats_per_shard grows where the smallest weight would get fewer than least_seats."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), C.group_key(F.col(source)).alias("__group"), C.word_count(F.col(text)).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("__key", C.seeded_key(seed, F.col("doc_id"), F.col("text_crc32"), F.col("size")))
    rows = C.staged(rows.withColumn("__number", C.key_number(F.col("__key"))), "mix-rows")
    sizes = rows.groupBy(F.col("__group").alias("__g")).agg(F.first("source").alias("source"), F.sum("size").alias("size"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    plan = targets(sizes, weights, share, limit)
    open_weight = F.when(~F.col("capped") & (F.col("size") > 0), F.col("weight"))
    plan = plan.withColumn("open_w", F.coalesce(open_weight, F.lit(0.0)))
    plan = (
        plan.withColumn("sum_w", F.sum("open_w").over(everything)).withColumn("min_w", F.min(open_weight).over(everything)).withColumn("n_open", F.count(open_weight).over(everything))
        .withColumn("per_shard", F.coalesce(F.greatest(F.lit(seats_per_shard), F.ceil(least_seats * F.col("sum_w") / F.col("min_w"))), F.lit(seats_per_shard)).cast("long"))
        .withColumn("open_words", F.sum(F.when(F.col("open_w") > 0, F.col("target")).otherwise(0.0)).over(everything))
        .withColumn("block", F.greatest(F.lit(1), F.ceil(F.col("open_words") / (F.col("per_shard") * shards))).cast("long"))
        # Whole blocks that the open words fill; fewer than planned where texts are short.
        .withColumn("seats", F.round(F.col("open_words") / F.col("block")).cast("long"))
        .withColumn("per_shard", F.greatest(F.lit(1), F.ceil(F.col("seats") / shards)).cast("long"))
        .withColumn("blocks", F.ceil(F.col("size") / F.col("block")).cast("long"))
    )
    plan = C.staged(plan, "mix-plan")
    # No source gets more than w (seats + n/2) / sum(w) + 1/2 seats; so many candidates suffice.
    most = F.floor(F.col("open_w") * (F.col("seats") + F.col("n_open") / 2) / F.col("sum_w") + 0.5).cast("long")
    seats = plan.where("open_w > 0").select("__g", "seats", "per_shard", "weight", "min_w", F.lit(0).alias("__all"), F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(most, F.lit(1)))).alias("k"))
    # In order of the quotients: weight / (2k - 1) falls as its inverse, scaled to 32 bits, rises.
    bound = F.col("seats") * 2 + F.lit(3)
    seats = seats.withColumn("__quotient", -F.col("weight") / (2 * F.col("k") - 1)).withColumn("__number", F.least(F.lit((1 << 32) - 1), F.floor((2 * F.col("k") - 1) / F.col("weight") * F.col("min_w") / bound * F.lit(1 << 32))).cast("long"))
    seats = C.running(seats, "__all", "__number", ["__quotient", "__g", "k"], CUTS).where("start < seats")
    won = C.staged(seats.select("__g", (F.col("k") - 1).alias("draw"), F.expr("start div per_shard").cast("int").alias("shard")), "mix-seats")
    counts = won.groupBy(F.col("__g").alias("__won")).agg(F.count("*").alias("quota"))
    plan = plan.join(counts, F.col("__g") == F.col("__won"), "left").drop("__won")
    plan = plan.withColumn("quota", F.when(F.col("capped"), F.floor(F.col("blocks") * F.lit(float(limit)))).otherwise(F.least(F.coalesce("quota", F.lit(0)), F.floor(F.col("blocks") * F.lit(float(limit))))))
    plan = plan.withColumn("base", F.coalesce(F.expr("quota div nullif(blocks, 0)"), F.lit(0))).withColumn("more", F.coalesce(F.expr("quota % nullif(blocks, 0)"), F.lit(0)))
    plan = C.staged(plan.select("__g", "source", F.col("size").alias("source_size"), "target", "capped", "block", "blocks", "quota", "base", "more"), "mix-quota")
    full = plan.where("capped and quota > 0").select("__g", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("draw"))
    full = full.select("__g", "draw", F.expr(f"cast({shards} * (2 * draw + 1) div (2 * quota) as int)").alias("shard"))
    draws = won.unionByName(full).join(plan.select(F.col("__g").alias("__d"), "source", "quota", "blocks"), F.col("__g") == F.col("__d")).where("draw < quota")
    quotas = draws.groupBy("shard", "__g").agg(F.first("source").alias("source"), F.count("*").alias("blocks")).drop("__g")
    taken_by = draws.groupBy("__g", F.expr("draw % blocks").alias("place")).agg(F.array_sort(F.collect_list("shard")).alias("shards"))
    blocks = plan.where("blocks > 0").select("__g", "source", "block", "blocks", "more", "source_size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("at"))
    blocks = blocks.withColumn("__key", C.seeded_key(seed, F.col("__g"), F.col("at"))).withColumn("__number", C.key_number(F.col("__key")))
    blocks = C.running(blocks, "__g", "__number", ["__key", "at"], CUTS).withColumnRenamed("start", "place").drop("total")
    blocks = blocks.withColumn("chosen", (F.col("place") < F.col("more")).cast("long"))
    blocks = blocks.withColumn("length", F.least(F.col("block"), F.col("source_size") - F.col("at") * F.col("block")))
    blocks = blocks.withColumn("__number", F.expr("cast((at << 32) div blocks as long)")).withColumn("__more", F.col("chosen") * F.col("length"))
    blocks = C.running(blocks, "__g", "__number", ["at"], CUTS, weight="__more").withColumnRenamed("start", "extra")
    told = taken_by.select(F.col("__g").alias("__t"), F.col("place").alias("__p"), "shards").hint("merge")
    blocks = blocks.join(told, (F.col("__g") == F.col("__t")) & (F.col("place") == F.col("__p")), "left")
    blocks = C.staged(blocks.select("__g", "source", "at", "chosen", "extra", "length", F.coalesce("shards", F.array().cast("array<int>")).alias("shards")), "mix-blocks")
    # One row per source: broadcast when their number is small, else a join whose hot sources AQE splits.
    placed = C.running(rows, "__group", "__number", ["__key", "doc_id", "text_crc32", "size"], C.slices(spark, rows.count()), weight="size")
    known = plan.select("__g", "source_size", "target", "block", "base")
    placed = placed.join(F.broadcast(known) if plan.count() <= 10_000 else known, F.col("__group") == F.col("__g")).drop("__g", "total")
    placed = placed.withColumn("first", F.expr("start div block")).withColumn("last", F.expr("greatest(start, start + size - 1) div block"))

    def at(name: str) -> DataFrame:
        return blocks.select(F.col("__g").alias(f"g_{name}"), F.col("at").alias(f"at_{name}"), F.col("chosen").alias(f"c_{name}"), F.col("extra").alias(f"e_{name}"), F.col("shards").alias(f"s_{name}"))

    for name in ("first", "last"):
        placed = placed.join(at(name), (F.col("__group") == F.col(f"g_{name}")) & (F.col(name) == F.col(f"at_{name}")), "left")

    def extra(name: str, position: F.Column) -> F.Column:
        return F.coalesce(F.col(f"e_{name}") + F.col(f"c_{name}") * (position - F.col(name) * F.col("block")), F.lit(0))

    taken = F.col("base") * F.col("size") + F.when(F.col("size") > 0, extra("last", F.col("start") + F.col("size")) - extra("first", F.col("start"))).otherwise(0)
    out = placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), (F.col("base") + F.coalesce("c_first", F.lit(0))).cast("int").alias("copies"), F.coalesce("s_first", F.array().cast("array<int>")).alias("shards"), "source", "text_crc32")
    return Mix(out, quotas, blocks.select("source", "at", "length", "shards"), plan)


def resample(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with every row as often as the block in which it starts is taken.

    Rows equal in doc_id and text share their copies: they are taken as often together as they are apart.
    """
    mixed = mix(docs, source=source, key=key, text=text, **options).rows
    copies = mixed.groupBy(F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__crc"), F.col("size").alias("__size"), C.group_key(F.col("source")).alias("__src")).agg(F.sum("copies").alias("__all"), F.count("*").alias("__n"))
    rows = docs.withColumn("__c", F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))).withColumn("__s", C.word_count(F.col(text))).withColumn("__g", C.group_key(F.col(source)))
    joined = rows.join(copies.hint("merge"), F.col(key).eqNullSafe(F.col("__id")) & (F.col("__c") == F.col("__crc")) & (F.col("__s") == F.col("__size")) & (F.col("__g") == F.col("__src")))
    times = F.ceil(F.col("__all") / F.col("__n")).cast("int")
    return joined.where(times > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
