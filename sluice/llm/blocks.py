"""Pair checks inside groups, in blocks, and connected components of the links found.

A group's rows are cut into chunks by a hash of the id; a block is a pair of chunks. So no group meets in one task,
all its pairs are checked, and none is emitted: a block returns one row per id that has a link, with its
number of links and the smallest id of its part of the block's link graph.

A row is sent once for each chunk of its group. A group has as many chunks as spread its share of all pairs over the
tasks (the square root of their number at most, whatever the group's size), and more only where a chunk would
exceed the memory bounds MOST_ROWS and MOST_BYTES. Up to that size the rows sent are linear in the group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Broadcast only tables of so many rows of a few numbers.
SMALL = 50_000
#: Rows of a chunk: not cut below the first, not above the second; bytes of a chunk's rows.
LEAST_ROWS, MOST_ROWS, MOST_BYTES = 64, 2_048, 16 << 20
STRIP = 256  #: rows of a matrix that are looked at together
NONE = np.iinfo(np.int64).max

Check = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]


def into_blocks(rows: DataFrame, group: str, size: str | None, least: int, most: int) -> DataFrame:
    """rows: group (long), id, more; size: a binary column that makes up a row's bytes. Adds a, b (the block) and own (the row's chunk)."""
    spark = rows.sparkSession
    weight = F.sum(F.octet_length(size)) if size else F.lit(0)
    counted = rows.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__rows"), weight.alias("__bytes")).where(F.col("__rows") > least)
    counted = C.staged(counted, "blocks")
    pairs = counted.agg(F.sum(F.col("__rows").cast("double") * F.col("__rows"))).first()[0] or 1.0
    spread = math.sqrt(C.shuffle_partitions(spark) / pairs)
    chunks = F.greatest(F.ceil(F.least(F.col("__rows") * spread, F.col("__rows") / least)), F.ceil(F.col("__rows") / most), F.ceil(F.col("__bytes") / MOST_BYTES))
    large = counted.select("__g", chunks.cast("int").alias("__n")).where("__n > 1")
    joined = rows.join(F.broadcast(large) if large.count() <= SMALL else large.hint("merge"), F.col(group) == F.col("__g"), "left")
    joined = joined.withColumn("__n", F.coalesce("__n", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("__n")).cast("int"))
    joined = joined.withColumn("__c", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return joined.withColumn("a", F.least("own", "__c")).withColumn("b", F.greatest("own", "__c")).drop("__g", "__n", "__c")


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of rows sorted by keys, each cut where a key ends, with the bounds of the keys' runs."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        both = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        values = [both[k].to_numpy() for k in keys]
        new = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1
        if len(new):
            yield both.iloc[: new[-1]], np.concatenate([[0], new])
            rest = both.iloc[new[-1] :].reset_index(drop=True)
        else:
            rest = both
    if rest is not None:
        yield rest, np.array([0, len(rest)])


def near(linked: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The smallest label that each row of a link matrix is linked to."""
    parts = [np.where(linked[i : i + STRIP], label[None, :], NONE).min(axis=1, initial=NONE) for i in range(0, len(linked), STRIP)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def smallest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id reachable from each row and each column of a link matrix between ids."""
    while True:
        to_left = np.minimum(left, near(linked, right))
        to_right = np.minimum(right, near(linked.T, to_left))
        if (to_left == left).all() and (to_right == right).all():
            return left, right
        left, right = to_left, to_right


def counted(linked: np.ndarray, copies: np.ndarray) -> np.ndarray:
    parts = [linked[i : i + STRIP] @ copies.astype(np.float64) for i in range(0, len(linked), STRIP)]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def links(rows: DataFrame, group: str, columns: list[str], check: Check, size: str | None = None, distinct: tuple[str, ...] = (), most: int = MOST_ROWS) -> DataFrame:
    """rows: group, id, copies and columns. check(values, left, right) gets the columns of one block and the places of two chunks, and
    returns a matrix of links; a link counts the other side's copies. Rows that are equal in the columns `distinct` are one.
    Result: group, id, n_links, root; parts of one id still to be added up."""
    blocks = into_blocks(rows.select(group, "id", "copies", *columns), group, size, min(LEAST_ROWS, most), most)
    keys = [group, "a", "b"]
    dealt = blocks.repartition(C.shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, bounds in runs(batches, keys):
            held = {c: batch[c].to_numpy() for c in (group, "id", "copies", "own", "a", "b", *columns)}
            out = []
            for start, end in zip(bounds[:-1], bounds[1:], strict=True):
                if end - start < 2:
                    continue
                place = np.arange(start, end)
                if distinct:
                    place = place[~batch.iloc[start:end].duplicated(list(distinct)).to_numpy()]
                a, b = held["a"][start], held["b"][start]
                left = place[held["own"][place] == a]
                right = left if a == b else place[held["own"][place] == b]
                if not len(left) or not len(right):
                    continue
                found = check(held, left, right)
                if not found.any():
                    continue
                ids = held["id"]
                roots = smallest(found, ids[left], ids[right])
                for linked, own, other, root in ((found, left, right, roots[0]), (found.T, right, left, roots[1])):
                    some = linked.any(axis=1)
                    out.append(pd.DataFrame({group: held[group][start], "id": ids[own][some], "n_links": counted(linked[some], held["copies"][other]), "root": root[some]}))
                    if a == b:
                        break
            if out:
                yield pd.concat(out, ignore_index=True)

    return dealt.mapInPandas(find, f"{group} long, id long, n_links long, root long")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (smallest node reachable): of every node with an edge to another.

    Labels take the smallest label next to them and are then replaced by their label's label, until none changes; the
    number of rounds follows the logarithm of the longest path. Every round is a written table. The joins' hot nodes are
    split by AQE; labels are combined map-side.
    """
    one = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = C.staged(one.union(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    label = C.staged(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(label.hint("merge"), F.col("y") == F.col("node")).groupBy("x").agg(F.min("component").alias("m"))
        new = label.join(near.hint("merge"), F.col("node") == F.col("x")).select("node", F.least("component", "m").alias("next"), F.col("component").alias("old"))
        new = C.staged(new, "labels")
        up = new.select(F.col("node").alias("up"), F.col("next").alias("top"))
        jumped = C.staged(new.join(up.hint("merge"), F.col("next") == F.col("up")).select("node", F.least("next", "top").alias("component"), "old"), "labels")
        changed = jumped.where("component <> old").limit(1).count()
        label = jumped.select("node", "component")
        if not changed:
            return label
