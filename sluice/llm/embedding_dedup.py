"""Near-duplicate embeddings by an inverted multi-index.

Vectors are normalised and cut in halves; each half has its own codebook of k words, fitted by k-means on a bounded
sample, and the pair of codes is a cell of the k x k grid. A vector is stored in its own cell and visits the cells
nearest to it: multi-sequence traversal takes pairs of codes in order of their summed lower bounds on the squared
distance, until the reach. The reach is the quantile, at the target recall, of that bound for links exactly at
the threshold, simulated on the sample; closer links are found more often. A pair is found when the smaller
id visits the cell of the larger, so counts agree on both sides. Every found pair is verified in double precision.

Equal vectors are one row with a count until the end. Pairs are checked in blocks (blocks.links): a cell with a third of
all vectors spreads over all tasks, and no pair is emitted. Through the shuffle vectors go as they were given (four bytes a
component for floats); they become doubles of length one only in the block that compares them.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, null labels and null ids link with nothing;
vectors of one component point one way or the other: those of one label and sign are one class; vectors of different length are not compared; lengths after the `most_indexes` most frequent have no index of their own: all
vectors of such a length and label meet in one cell, which is exact; rows repeating an id and vector count as copies of each other; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import common as C


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        code = (((centres**2).sum(1))[None, :] - 2 * x @ centres.T).argmin(axis=1)
        for j in range(len(centres)):
            own = x[code == j]
            if len(own):
                centres[j] = own.mean(axis=0)
    return np.unique(centres, axis=0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class MultiIndex:
    centres: tuple[np.ndarray, np.ndarray]
    reach: float

    def bounds(self, half: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and squared lower bounds on the distance from each x to every code's region."""
        c = self.centres[half]
        d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T
        code = d.argmin(axis=1)
        apart = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(-1), 1e-30))[code]
        low = np.maximum(d - d[np.arange(len(x)), code][:, None], 0) / (2 * apart)
        low[np.arange(len(x)), code] = 0
        return code, low * low

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """The cell of each row, and the cells it visits, nearest first."""
        (c1, low1), (c2, low2) = (self.bounds(h, v) for h, v in enumerate(self.halves(x)))
        k = len(self.centres[1])
        order1, order2 = low1.argsort(axis=1, kind="stable"), low2.argsort(axis=1, kind="stable")
        out = []
        for l1, l2, o1, o2 in zip(low1, low2, order1, order2, strict=True):
            cells, heap, seen = [], [(0.0, 0, 0)], {(0, 0)}
            while heap:
                cost, i, j = heapq.heappop(heap)
                if cost > self.reach:
                    break
                cells.append(int(o1[i]) * k + int(o2[j]))
                for p, q in ((i + 1, j), (i, j + 1)):
                    if p < len(o1) and q < len(o2) and (p, q) not in seen:
                        seen.add((p, q))
                        heapq.heappush(heap, (l1[o1[p]] + l2[o2[q]], p, q))
            out.append(cells)
        return c1 * k + c2, out

    @classmethod
    def fit(cls, x: np.ndarray, k: int, threshold: float, recall: float, seed: int = 5) -> MultiIndex:
        rng = np.random.default_rng(seed)
        cut = x.shape[1] // 2
        index = cls((kmeans(x[:, :cut], k, 12, rng), kmeans(x[:, cut:], k, 12, rng)), 0.0)
        noise = rng.standard_normal(x.shape)
        noise = unit(noise - (noise * x).sum(1, keepdims=True) * x + 1e-12)
        other = threshold * x + np.sqrt(1 - threshold**2) * noise
        cost = np.zeros(len(x))
        for h, (own, far) in enumerate(zip(index.halves(x), index.halves(other), strict=True)):
            _, low = index.bounds(h, own)
            code, _ = index.bounds(h, far)
            cost += low[np.arange(len(x)), code]
        index.reach = float(np.quantile(cost, recall))
        return index


def alike(threshold: float, kind: type):
    """Pairs of vectors with a cosine of at least the threshold; one of a pair has to be at home in the cell."""

    def check(held: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        def matrix(at: np.ndarray) -> np.ndarray:
            return unit(np.frombuffer(b"".join(held["raw"][at]), dtype=kind).reshape(len(at), -1))

        close = matrix(left) @ matrix(right).T >= threshold
        (il, bl, sl), (ir, br, sr) = ((held["id"][at], held["base"][at], held["space"][at]) for at in (left, right))
        # Every row visits; the larger id has to be at home here.
        close &= np.where(il[:, None] < ir[None, :], br[None, :], bl[:, None]) & (il[:, None] != ir[None, :])
        return close & (sl[:, None] == sr[None, :])

    return check


def link(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.99, sample_rows: int = 8_192, per_cell: int = 64, most_codes: int = 256, most_indexes: int = 64, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    v = F.col("v")
    single = dict(vectors.dtypes)[vector] == "array<float>"
    kind, array = (np.float32, "array<float>") if single else (np.float64, "array<double>")
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast(array).alias("v"), F.col(label).alias("label"))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)
    # The class of a vector: its label and components, as text; of a single component the sign.
    parts = F.when(F.size(v) == 1, F.transform(v, lambda x: F.signum(x).cast("string"))).otherwise(v.cast("array<string>"))
    digest = F.sha2(F.concat_ws(",", F.col("label").cast("string"), parts), 256)
    rows = C.staged(rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("digest", F.when(F.col("good"), digest)).withColumn("v", F.when(F.col("good"), v)), "vectors")
    classes = rows.where("good").groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = C.staged(classes.withColumn("space", F.xxhash64("label", F.size("v"))).drop("label"), "vector-classes")
    long = classes.where(F.size("v") > 1)
    sizes = [r["n"] for r in long.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(most_indexes + 1).collect()]
    indexed, others = sizes[:most_indexes], len(sizes) > most_indexes
    n = long.count()
    found = None
    for size in [*indexed, None] if others else indexed:
        if size is None:
            own, index = long.where(~F.size("v").isin(indexed)), None
        else:
            own = long.where(F.size("v") == size)
            # The first by digest of each of so many hash classes: one row a class and task, whatever the table's size.
            drawn = own.groupBy(F.pmod(F.xxhash64("digest"), F.lit(sample_rows)).alias("c")).agg(F.min_by("v", "digest").alias("v"), F.min("digest").alias("digest"))
            x = unit(np.stack(drawn.orderBy("digest").select("v").toPandas()["v"].to_numpy()))
            k = int(np.clip(np.ceil(np.sqrt(n / per_cell)), 4, most_codes))
            index = vectors.sparkSession.sparkContext.broadcast(MultiIndex.fit(x, k, threshold, recall))

        def visit(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 512):
                    part = batch.iloc[at : at + 512]
                    if index is None:
                        cell, visited = np.full(len(part), -1), [[-1]] * len(part)
                    else:
                        cell, visited = index.value.visits(unit(np.stack(part["v"].to_numpy())))
                    place = np.repeat(np.arange(len(part)), [len(c) for c in visited])
                    cells = np.concatenate([np.asarray(c, dtype=np.int64) for c in visited])
                    raw = np.array([np.asarray(v, kind).tobytes() for v in part["v"]], dtype=object)
                    for low in range(0, len(cells), 4096):  # rows that a yield holds
                        some = place[low : low + 4096]
                        yield pd.DataFrame({"space": part["space"].to_numpy()[some], "cell": cells[low : low + 4096], "id": part["id"].to_numpy()[some], "copies": part["copies"].to_numpy()[some], "base": cells[low : low + 4096] == cell[some], "raw": raw[some]})

        visits = own.select("space", "id", "copies", "v").mapInPandas(visit, "space long, cell long, id long, copies long, base boolean, raw binary")
        part = B.links(visits.withColumn("grp", F.xxhash64("space", "cell")), "grp", ["space", "base", "raw"], alike(threshold, kind), size="raw")
        found = part if found is None else found.unionByName(part)
    linked_classes = classes.select("digest", "id", "copies")
    if found is None:
        reps = linked_classes.select(F.col("digest").alias("d"), (F.col("copies") - 1).alias("n_links"), F.col("id").alias("component_id"))
    else:
        found = C.staged(found, "vector-links")
        linked = found.groupBy("id").agg(F.sum("n_links").alias("n_links"))
        joined = B.components(found.select("id", "root"), "id", "root")
        reps = linked_classes.join(linked.hint("merge"), "id", "left").join(joined.hint("merge"), F.col("id") == F.col("node"), "left")
        reps = reps.select(F.col("digest").alias("d"), (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    reps = C.staged(reps, "vector-reps")
    out = rows.select("vec_id", "digest").join(reps.hint("merge"), F.col("digest") == F.col("d"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
