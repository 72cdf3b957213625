"""N-gram Jaccard self-join by a MinHash LSH forest.

A document's set of word 5-grams gets `trees` * `depth` minimum hashes. Each tree is the trie of one run of `depth` of them,
held as rows (tree, path, id) sorted by path: documents that share a prefix of a path stand next to each other, whatever
its length. The matched prefix starts at the full depth and is shortened level by level until the recall that was measured
reaches the target. Two recalls are measured, and both have to: of the links that a seeded sample of documents has to all
documents, found by comparing the sample's sets with every set; and of pairs made out of the sample's sets that stand
right at the threshold, the hardest ones. At that prefix, documents that meet in a tree are compared by whole signatures; those
that may reach the threshold (a margin of several standard errors below it) are verified exactly on their 5-gram sets. A pair
counts in the first tree where it meets, so it is verified once, and no chain of resemblances has to be gathered first.

Documents with equal sets are one row with a count until the end. Comparisons run in blocks (blocks.links): no
group meets in one task and no pair is emitted.

Words are the lower-cased text's runs of characters outside [\\x20\\x09-\\x0D] and other Unicode space; 5-grams are compared by 64-bit hashes
of their bytes. Defined cases: a text of one to four words has its whole word sequence as single shingle; null, empty and
blank texts and null ids link with nothing; rows repeating an id and text count as copies; rows that share an
id with different texts are one node: keep_one drops the id if any of them is a near copy of a smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import common as C

_RNG = np.random.default_rng(2024)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.multiply.accumulate(np.full(n - 1, base, np.uint64), out=out[1:])
    return out


_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer((" ".join(words) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    m = max(1, len(words) - n + 1)
    first, last = starts[:m], ends[min(n, len(words)) - 1 :][:m]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(int(_STEP), len(raw)), out=total[1:])
    return np.unique(mixed((total[last] - total[first]) * _powers(int(_INVERSE), len(raw))[first]))


def signature(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For every factor the smallest of hashes * factor (upper 32 bits)."""
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048]
        for i in range(0, len(factors), 16):
            f = factors[i : i + 16]
            out[i : i + 16] = np.minimum(out[i : i + 16], (part[None, :] * f[:, None]).min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32)


@dataclass
class Probe:
    """The sets of a bounded sample of documents and their signatures: what the forest's recall is measured with."""

    sets: list[np.ndarray]
    paths: np.ndarray  #: sample x trees x depth
    values: np.ndarray
    begins: np.ndarray
    owners: np.ndarray

    @classmethod
    def of(cls, sets: list[np.ndarray], factors: np.ndarray, trees: int) -> Probe:
        everything = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(everything, kind="stable")
        values, begins = np.unique(everything[order], return_index=True)
        paths = np.array([signature(h, factors).astype(np.uint16) for h in sets]).reshape(len(sets), trees, len(factors) // trees)
        return cls(sets, paths, values, np.append(begins, len(order)), np.repeat(np.arange(len(sets)), [len(h) for h in sets])[order])

    def levels(self, h: np.ndarray, path: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
        """How many of the sample's sets that h is linked to, without being equal, match it down to each level at best."""
        depth = path.shape[1]
        if not len(self.values):
            return np.zeros(depth + 1, np.int64)
        at = np.minimum(np.searchsorted(self.values, h), len(self.values) - 1)
        at = at[self.values[at] == h]
        count = self.begins[at + 1] - self.begins[at]
        place = np.repeat(self.begins[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(self.owners[place], minlength=len(self.sets))
        union = len(h) + np.array([len(x) for x in self.sets]) - both
        linked = np.flatnonzero((both * threshold[1] >= union * threshold[0]) & (both < union))
        return np.bincount(matched(self.paths[linked], path), minlength=depth + 1)


def matched(paths: np.ndarray, path: np.ndarray) -> np.ndarray:
    """The longest prefix of any tree that each of the paths has in common with path."""
    return np.cumprod(paths == path, axis=2).sum(axis=2).max(axis=1, initial=0)


def at_threshold(probe: Probe, factors: np.ndarray, trees: int, threshold: tuple[int, int], each: int = 8) -> np.ndarray:
    """Levels of made pairs: each set of the sample against copies with as many 5-grams replaced as the threshold lets."""
    rng = np.random.default_rng(19)
    depth = len(factors) // trees
    total = np.zeros(depth + 1, np.int64)
    for h, path in zip(probe.sets, probe.paths, strict=True):
        # m - r of m shared: similarity (m - r) / (m + r).
        r = len(h) * (threshold[1] - threshold[0]) // (threshold[1] + threshold[0])
        for _ in range(each if r else 0):
            other = np.concatenate([rng.permutation(h)[r:], rng.integers(0, 1 << 63, r, dtype=np.uint64)])
            total += np.bincount(matched(signature(other, factors).astype(np.uint16).reshape(1, trees, -1), path), minlength=depth + 1)
    return total


def shortened(measured: list[np.ndarray], depth: int, recall: float) -> int:
    """The longest prefix at which every measurement (pairs by their longest matched prefix) reaches the recall; 1 if none does."""
    level = depth
    while level > 1 and any(m[level:].sum() < recall * m.sum() for m in measured):
        level -= 1
    return level


def drawn(known: DataFrame, rows: int, longest: int, n: int) -> list[np.ndarray]:
    """The sets of at most `rows` documents of up to `longest` bytes: the first in a seeded order of each of so many hash classes of ids.

    Map-side, every task keeps one id a class; only the chosen documents' texts leave the executors.
    """
    short = known.where(F.octet_length("text") <= longest)
    first = F.min_by("id", C.seeded_key(29, F.col("id"))).alias("id")
    ids = [r["id"] for r in short.groupBy(F.pmod(F.xxhash64("id"), F.lit(rows)).alias("c")).agg(first).collect()]
    texts = short.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("text").alias("text")).orderBy("id").collect()
    sets = [shingles(r["text"], n) for r in texts]
    return [h for h in sets if len(h)]


def identity(h: np.ndarray) -> np.ndarray:
    """128 bits that stand for a set."""
    return np.array([h.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(h + _STEP))], np.uint64).astype(np.int64)


def sketches(docs: DataFrame, factors: np.ndarray, trees: int, probe: Broadcast, threshold: tuple[int, int], n: int) -> DataFrame:
    """docs: id, text. id, set_a and set_b (128 bits that stand for the set), size, sig (16 bits of each minimum, high byte first), levels (null: none)."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                h = shingles(text, n)
                if not len(h):
                    continue
                s = signature(h, factors).astype(np.uint16)
                a, b = identity(h)
                levels = probe.value.levels(h, s.reshape(trees, -1), threshold)
                rows.append((i, a, b, len(h), s.astype(">u2").tobytes(), levels.tolist() if levels.any() else None))
            yield pd.DataFrame(rows, columns=["id", "set_a", "set_b", "size", "sig", "levels"])

    return docs.mapInPandas(sketch, "id long, set_a long, set_b long, size int, sig binary, levels array<long>")


def meets(classes: DataFrame, trees: int, depth: int, prefix: int) -> DataFrame:
    """id, tree, grp of the forest's rows that share a prefix of that length with a neighbour in the sorted order.

    The rows that begin and end a range may go on in the next one and are passed on in any case.
    """
    path = lambda t: F.struct(t.alias("tree"), F.substr("sig", t * (2 * depth) + 1, F.lit(2 * depth)).alias("path"))
    rows = classes.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), path)).alias("t")).select("id", "t.*")
    order = ["tree", "path", "id"]
    ordered = rows.repartitionByRange(C.shuffle_partitions(classes.sparkSession), *order).sortWithinPartitions(*order)

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, met = None, True
        for batch in batches:
            if not len(batch):
                continue
            both = batch if last is None else pd.concat([last, batch], ignore_index=True)
            grp = grouped(both["tree"].to_numpy(), both["path"], prefix)
            same = grp[1:] == grp[:-1]
            before = np.concatenate([[met], same])
            keep = before[:-1] | same
            yield pd.DataFrame({"id": both["id"].to_numpy()[:-1][keep], "tree": both["tree"].to_numpy()[:-1][keep], "grp": grp[:-1][keep]})
            last, met = both.iloc[-1:], before[-1]
        if last is not None:
            yield pd.DataFrame({"id": last["id"], "tree": last["tree"], "grp": grouped(last["tree"].to_numpy(), last["path"], prefix)})

    return ordered.mapInPandas(neighbours, "id long, tree int, grp long")


def prefix_keys(values: np.ndarray, prefix: int) -> np.ndarray:
    """64 bits of the first values of each path (the last axis)."""
    key = np.zeros(values.shape[:-1], np.uint64)
    for k in range(prefix):
        key = mixed(key * _STEP + values[..., k])
    return key


def grouped(tree: np.ndarray, path: pd.Series, prefix: int) -> np.ndarray:
    values = np.frombuffer(b"".join(path), ">u2").reshape(len(path), -1).astype(np.uint64)
    return mixed(prefix_keys(values, prefix) + tree.astype(np.uint64)).astype(np.int64)


def first_meeting(sigs: np.ndarray, tree: int, trees: int, prefix: int, n_left: int) -> np.ndarray:
    """Pairs whose prefixes are equal in the tree and in no tree before it."""
    key = prefix_keys(sigs.astype(np.uint64).reshape(len(sigs), trees, -1), prefix)
    out = key[:n_left, None, tree] == key[None, n_left:, tree]
    for t in range(tree):
        out &= key[:n_left, None, t] != key[None, n_left:, t]
    return out


def signatures(held: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(held["sig"][at]), ">u2").reshape(len(at), -1).astype(np.uint16)


def alike(least: int, trees: int, prefix: int):
    """Pairs that meet first in this tree and whose signatures agree in so many places."""

    def check(held: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        a, b = signatures(held, left), signatures(held, right)
        out = np.stack([(row[None, :] == b).sum(axis=1) >= least for row in a])
        out &= held["id"][left][:, None] != held["id"][right][None, :]
        return out & first_meeting(np.concatenate([a, b]), held["tree"][left[0]], trees, prefix, len(a)) if out.any() else out

    return check


def exact(numerator: int, denominator: int, trees: int, prefix: int):
    """Pairs that meet first in this tree, of sets with intersection / union of at least numerator / denominator, counted exactly."""

    def check(held: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        parts = [np.frombuffer(held["grams"][i], np.uint64) for i in np.concatenate([left, right])]
        size = np.array([len(p) for p in parts])
        owner = np.repeat(np.arange(len(parts)), size)
        values, code, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = count[code] > 1  # what one document alone has adds to no intersection
        order = np.argsort(code[shared], kind="stable")
        code, owner = code[shared][order], owner[shared][order]
        code = np.unique(code, return_inverse=True)[1]
        both = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2**24, exact
        width = max(256, (1 << 22) // len(parts))
        for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
            low, high = np.searchsorted(code, [at, at + width])
            table = np.zeros((len(parts), width), np.float32)
            table[owner[low:high], code[low:high] - at] = 1
            both += table[: len(left)] @ table[len(left) :].T
        union = size[: len(left), None] + size[None, len(left) :] - both.astype(np.int64)
        out = (both.astype(np.int64) * denominator >= union * numerator) & (held["id"][left][:, None] != held["id"][right][None, :])
        return out & first_meeting(signatures(held, np.concatenate([left, right])), held["tree"][left[0]], trees, prefix, len(left))

    return check


def link(docs: DataFrame, threshold: tuple[int, int] = (4, 5), n: int = 5, trees: int = 16, depth: int = 6, recall: float = 0.999, margin: float = 0.17, sample_rows: int = 256, longest: int = 100_000, chunk: int = B.MOST_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its equal sets), n_links, component_id, kept.

    The recall is measured with at most sample_rows documents of up to `longest` bytes, against all documents.
    """
    ids = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    known = ids.where("id is not null and text is not null")
    factors = np.random.default_rng(7).integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    probe = Probe.of(drawn(known, sample_rows, longest, n), factors, trees)
    shared = docs.sparkSession.sparkContext.broadcast(probe)
    rows = C.staged(sketches(known, factors, trees, shared, threshold, n), "shingle-sketches")
    real = np.array(rows.agg(*[F.coalesce(F.sum(F.col("levels")[k]), F.lit(0)) for k in range(depth + 1)]).first(), np.int64)
    prefix = shortened([real, at_threshold(probe, factors, trees, threshold)], depth, recall)
    classes = rows.groupBy("set_a", "set_b", "size").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    classes = C.staged(classes, "shingle-classes")
    met = C.staged(meets(classes, trees, depth, prefix), "forest-meets")
    with_signature = met.join(classes.select("id", "sig").hint("merge"), "id").withColumn("copies", F.lit(1).cast("long"))
    maybe = B.links(with_signature, "grp", ["tree", "sig"], alike(int((threshold[0] / threshold[1] - margin) * trees * depth), trees, prefix), most=chunk)
    maybe = C.staged(maybe.select("grp", "id").distinct(), "forest-candidates")
    members = maybe.join(met.distinct().hint("merge"), ["grp", "id"]).join(classes.select("id", "set_a", "set_b", "copies", "sig").hint("merge"), "id")
    wanted = C.staged(members, "forest-members")
    texts = known.join(wanted.select("id").distinct().hint("merge"), "id")

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(t, n) for t in batch["text"]]
            a, b = np.array([identity(h) for h in found], np.int64).reshape(-1, 2).T
            yield pd.DataFrame({"i": batch["id"], "x": a, "y": b, "grams": [h.tobytes() for h in found]})

    sent = texts.mapInPandas(grams, "i long, x long, y long, grams binary")
    sets = wanted.join(sent.hint("merge"), (F.col("id") == F.col("i")) & (F.col("set_a") == F.col("x")) & (F.col("set_b") == F.col("y")))
    links = C.staged(B.links(sets, "grp", ["tree", "sig", "grams", "set_a", "set_b"], exact(*threshold, trees, prefix), size="grams", distinct=("id", "set_a", "set_b"), most=chunk), "shingle-links")
    n_links = links.groupBy(F.col("id").alias("i")).agg(F.sum("n_links").alias("n_links"))
    joined = B.components(links.select("id", "root").where("id <> root"), "id", "root")
    reps = classes.select("set_a", "set_b", "size", "id", "copies").join(n_links.hint("merge"), F.col("id") == F.col("i"), "left").join(joined.hint("merge"), F.col("id") == F.col("node"), "left")
    reps = C.staged(reps.select(F.col("set_a").alias("a"), F.col("set_b").alias("b"), F.col("size").alias("s"), F.col("id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "shingle-reps")
    sketched = rows.select("id", "set_a", "set_b", "size")
    own = sketched.join(reps.hint("merge"), (F.col("set_a") == F.col("a")) & (F.col("set_b") == F.col("b")) & (F.col("size") == F.col("s")))
    linked = own.select(F.col("id").alias("doc_id"), "class_id", "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    alone = ids.where(F.col("id").isNull() | F.col("text").isNull() | (F.length(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", "")) == 0))
    return linked.unionByName(alone.select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that stay: of each linked group the one of the smallest doc_id; all columns.

    Rows that repeat the id that stays are one row, the one with the smallest text.
    """
    verdict = C.staged(link(docs, key=key, text=text, **options), "near-verdicts")
    goes = verdict.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    repeated = verdict.where("kept and n_links > 0").groupBy(F.col("doc_id").alias("__id")).count().where("count > 1").select("__id")
    stays = docs.join(goes.hint("merge"), F.col(key) == F.col("__gone"), "left_anti")
    marked = stays.join(repeated.hint("merge"), F.col(key) == F.col("__id"), "left")
    once = marked.where("__id is not null").groupBy("__id").agg(F.min_by(F.struct(*docs.columns), F.col(text)).alias("__row")).select("__row.*")
    return marked.where("__id is null").select(*docs.columns).unionByName(once)
