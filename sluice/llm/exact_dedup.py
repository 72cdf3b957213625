"""Exact deduplication over a persistent digest index.

The index is a table bucketed and sorted by digest. A batch of new rows is reduced to one row per digest, deduplicated
by a sort-merge anti-join whose index side needs no shuffle (its buckets are the partitioning), and what is new is appended.

Every append bears a batch id. A batch that is ingested again, say after a lost job, is compared with the other batches alone
and not appended twice: its verdicts come out the same.

Native: DataFrame functions alone. Copies are combined map-side before any shuffle; where verdicts return to the rows,
the digest is salted, so that a text with a third of all rows spreads over all tasks.

Defined cases: null counts as empty; texts are equal when identical after every white-space character of
[\\x20\\x09-\\x0D] is deleted; the row with the most code points in the original text, then the smallest doc_id (null
last), stays; of rows equal in doc_id, length and digest exactly one is kept; an empty table gives no rows; extra columns
are ignored (verdicts) or stay (keep_first).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

def normalised(text: F.Column) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{C.SPACE_CLASS}]+", "")


class DigestIndex:
    """digest, keep_id, keep_len, batch of every text seen so far, in `buckets` buckets."""

    def __init__(self, spark: SparkSession, table: str, buckets: int, path: str | None = None):
        self.spark, self.table, self.buckets, self.path = spark, table, buckets, path

    @classmethod
    def temporary(cls, spark: SparkSession) -> DigestIndex:
        """A new index in the shared folder."""
        name = f"digests_{uuid.uuid4().hex}"
        return cls(spark, name, C.shuffle_partitions(spark), C.noted(f"{C.shared_dir(spark)}/{name}"))

    def read(self) -> DataFrame | None:
        return self.spark.table(self.table) if self.spark.catalog.tableExists(self.table) else None

    def forget(self) -> None:
        """Takes the name out of the catalog; the files of an index with a path stay."""
        self.spark.sql(f"drop table if exists {self.table}")

    def append(self, new: DataFrame) -> None:
        writer = new.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet")
        with C.freed_shuffles(self.spark):
            (writer.option("path", self.path) if self.path else writer).saveAsTable(self.table)

    def others(self, groups: DataFrame, batch: str) -> DataFrame:
        """The digests that other batches listed. A new index begins as an empty table."""
        if self.read() is None:
            self.append(groups.select("digest", "keep_id", "keep_len", F.lit(batch).alias("batch")).limit(0))
        return self.read().where(F.col("batch") != batch).select("digest")

    def ingest(self, groups: DataFrame, batch: str) -> DataFrame:
        """groups: digest, keep_id, keep_len, one row per digest. Appends those that no other batch listed, once, and returns the index."""
        new = groups.select("digest", "keep_id", "keep_len", F.lit(batch).alias("batch")).join(self.others(groups, batch).hint("merge"), "digest", "left_anti")
        if not self.read().where(F.col("batch") == batch).limit(1).count():
            self.append(new)
        return self.read()


def tuples(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, len and how many rows have them."""
    rows = docs.select(F.col(key).alias("doc_id"), F.sha2(normalised(F.col(text)), 256).alias("digest"), F.coalesce(F.length(text), F.lit(0)).alias("len"))
    return rows.groupBy("digest", "len", "doc_id").agg(F.count("*").alias("n"))


def grouped(distinct: DataFrame) -> DataFrame:
    """One row per digest: how many rows have it, and which of them stays."""
    better = F.struct("len", F.col("doc_id").isNotNull().cast("int"), F.bitwise_not("doc_id"))
    best = F.max_by(F.struct("doc_id", "len", "n"), better).alias("best")
    return distinct.groupBy("digest").agg(F.sum("n").alias("group_size"), best).select("digest", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.len").alias("keep_len"), F.col("best.n").alias("ties"))


def verdicts(docs: DataFrame, index: DigestIndex, key: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; the index then lists the batch's texts.

    A text that another batch listed keeps that batch's row: none of the new rows is kept. Without a name the batch is a new one.
    """
    batch = batch or uuid.uuid4().hex
    distinct = C.staged(tuples(docs, key, text), "exact-rows")
    groups = C.staged(grouped(distinct), "exact-groups")
    listed = index.ingest(groups, batch).select("digest", "keep_id", "keep_len", (F.col("batch") == batch).alias("fresh"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(max(64, C.shuffle_partitions(docs.sparkSession)))).cast("int")
    salted = distinct.withColumn("salt", salt)
    known = listed.hint("merge").join(groups.select("digest", "group_size"), "digest")
    told = salted.select("digest", "salt").distinct().join(known, "digest")
    rows = salted.join(told.hint("merge"), ["digest", "salt"])
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    kept = F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("keep_len")) & (F.col("copy") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, index: DigestIndex | None = None, key: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of docs that stay, all columns: one of each text that no other batch listed; of fully tied rows the largest text's."""
    own, batch = index is None, batch or uuid.uuid4().hex
    index = index or DigestIndex.temporary(docs.sparkSession)
    groups = C.staged(grouped(tuples(docs, key, text)), "exact-groups")
    fresh = index.ingest(groups, batch).where(F.col("batch") == batch).select(F.col("digest").alias("__sha"))
    stays = fresh.hint("merge").join(groups, F.col("__sha") == F.col("digest")).select("__sha", F.col("keep_id").alias("__keep"), F.col("keep_len").alias("__most"), F.col("ties").alias("__ties"))
    stays = C.staged(stays, "exact-stays")
    if own:
        index.forget()
    rows = docs.withColumn("__digest", F.sha2(normalised(F.col(text)), 256)).withColumn("__len", F.coalesce(F.length(text), F.lit(0)))

    def meet(kept: DataFrame) -> DataFrame:
        same = (F.col("__digest") == F.col("__sha")) & (F.col("__len") == F.col("__most")) & F.col(key).eqNullSafe(F.col("__keep"))
        return rows.join(kept.hint("merge"), same)

    single = meet(stays.where("__ties = 1")).select(*docs.columns)
    if not stays.where("__ties > 1").limit(1).count():
        return single
    # Rows that share doc_id, digest and length still have to be told apart: by the text itself, then any one.
    tied = meet(stays.where("__ties > 1")).groupBy("__digest").agg(F.max_by(F.struct(*docs.columns), F.col(text)).alias("__row")).select("__row.*")
    return single.unionByName(tied)
