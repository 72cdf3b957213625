"""Toxicity by class-conditional Kneser-Ney models.

A bigram model of the toxic and one of the ordinary class are smoothed by absolute discounting: bigrams back off to the
class's continuation counts, and these to the continuation counts of both classes together, so an expression that a
class has rarely seen is judged by what all texts say of it. A text's evidence is the difference of its
length-normalised log-likelihoods, over the whole text and over its most toxic window of words; a logistic curve
fitted on labelled rows that the counts have not seen turns it into a score.

The models are fitted on a bounded sample: at most `sample_rows` labelled rows in a seeded order, texts up to
`longest` characters (bounds of the broadcast model; scoring reads every text whole). Counting is distributed;
the driver gets the words that `least_documents` of the sample hold and the bigrams that occur as often. All rarer words are one word, whose
counts back off like any other's: with each rare word apart, the toxic class, a tenth of the texts, overfits on what it has seen once (README has
the held-out figures with and without).

Defined cases: null and empty texts and texts without a letter score like a text without evidence (the curve at 0); labels without
a document and null labels are ignored, of several labels of a document the highest counts; without labels of both
classes every score is the share of toxic labels (0 without any); where the rows set apart for the curve are of one class, the curve is
the fixed FALLBACK; a column of docs that bears the score's name is replaced by it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WORD = re.compile(r"[^\W\d_]+")
WINDOW = 2  #: words
LEAST, MOST = -1.0, 8.0  #: bounds of one word's influence
FALLBACK = (-1.0, 1.0, 1.0, 0.0)  #: intercept, mean ratio, ratio of the most toxic window, share of unknown words


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class Model:
    """Log-likelihood ratios, toxic against ordinary. Index 0 stands for all words out of the vocabulary."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    word: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))  #: of a word by the class's own smoothed unigrams
    backoff: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))  #: of the backoff weights after a word
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  #: sorted previous * len(word) + word
    pair: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """Mean ratio a word of the text, of its most toxic window, and the share of words out of the vocabulary."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words(text)), dtype=np.int64)
        if not len(ids):
            return 0.0, LEAST, 0.0
        previous = np.concatenate([[0], ids[:-1]])
        ratio = self.word[ids] + self.backoff[previous]
        if len(self.pairs):
            key = previous * len(self.word) + ids
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            ratio = np.where(self.pairs[at] == key, self.pair[at], ratio)
        ratio = np.clip(ratio, LEAST, MOST)
        total = np.concatenate([[0.0], np.cumsum(ratio, dtype=np.float64)])
        n = min(WINDOW, len(ids))
        return float(total[-1] / len(ids)), float((total[n:] - total[:-n]).max() / WINDOW), float((ids == 0).mean())

    def score(self, text: str | None) -> float:
        z = float(self.curve @ np.array([1.0, *self.evidence(text)]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton's method; the intercept comes first."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def discount(counts: np.ndarray) -> float:
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    return float(once / (once + 2 * twice)) if once and twice else 0.5


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int, longest: int, key: str, text: str, label: str) -> DataFrame:
    """text, y, part (0: for the curve, else for the counts). The chosen ids, at most sample_rows, are broadcast."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("__id")).agg((F.max(label) > 0).cast("int").alias("y"))
    known = C.staged(known.withColumn("__order", C.seeded_key(41, F.col("__id"))), "toxicity-known")
    # The first sample_rows in the seeded order have small keys: four times as many rows as wanted are ordered, not all.
    low = known.where(C.key_number(F.col("__order")) < int(min(1.0, 4 * sample_rows / max(1, known.count())) * (1 << 32)))
    low = low if low.count() >= sample_rows else known
    chosen = low.orderBy("__order", "__id").limit(sample_rows)
    chosen = chosen.withColumn("part", F.pmod(F.xxhash64("__order"), F.lit(5)).cast("int")).drop("__order")
    texts = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= longest))
    return C.staged(texts.join(F.broadcast(chosen), F.col("__key") == F.col("__id")).select("text", "y", "part"), "toxicity-sample")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, longest: int = 20_000, least_documents: int = 5, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    spark = docs.sparkSession
    rows = sample(docs, labels, sample_rows, longest, key, text, label)
    classes = {r["y"]: r["count"] for r in rows.where("part > 0").groupBy("y").count().collect()}
    if len(classes) < 2:
        share = classes.get(1, 0) / max(1, sum(classes.values()))
        return Model(curve=np.array([math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0, 0.0]))
    counted = rows.where("part > 0")

    def in_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            count: Counter[str] = Counter()
            for t in batch["text"]:
                count.update(set(words(t)))
            if count:
                yield pd.DataFrame({"word": list(count), "n": list(count.values())})

    frequent = counted.mapInPandas(in_documents, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_documents)
    vocabulary = {w: i for i, w in enumerate(sorted(frequent.select("word").toPandas()["word"]), 1)}
    size = len(vocabulary) + 1
    shared = spark.sparkContext.broadcast(vocabulary)

    def bigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = shared.value.get
        for batch in batches:
            for y, texts in batch.groupby("y")["text"]:
                keys = []
                for t in texts:
                    ids = np.fromiter((get(w, 0) for w in words(t)), dtype=np.int64)
                    keys.append(np.concatenate([[0], ids[:-1]]) * size + ids if len(ids) else ids)
                pair, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pd.DataFrame({"pair": pair, "c0": n * (y == 0), "c1": n * (y == 1)})

    table = counted.mapInPandas(bigrams, "pair long, c0 long, c1 long").groupBy("pair").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    table = C.staged(table, "toxicity-bigrams")
    seen = [F.sum((F.col(f"c{y}") > 0).cast("long")).alias(f"t{y}") for y in (0, 1)]
    totals = [F.sum(f"c{y}").alias(f"n{y}") for y in (0, 1)]
    few = [F.sum((F.col(f"c{y}") == k).cast("long")).alias(f"f{y}{k}") for y in (0, 1) for k in (1, 2)]
    ends = table.groupBy((F.col("pair") % size).alias("w")).agg(*seen, F.count("*").alias("t")).toPandas()
    starts = table.groupBy(F.expr(f"pair div {size}").alias("w")).agg(*seen, *totals).toPandas()
    f = table.agg(*few).first().asDict()
    kept = table.where(F.col("c0") + F.col("c1") >= least_documents).toPandas().sort_values("pair")
    shared.unpersist()

    continued = np.zeros((3, size))
    for y, name in enumerate(("t0", "t1", "t")):
        continued[y, ends["w"]] = ends[name]
    both = (continued[2] + 0.5) / (continued[2] + 0.5).sum()
    unigram, weight, after = [], [], np.zeros((2, size))
    for y in (0, 1):
        d = discount(continued[y][1:])
        own = continued[y].sum()
        unigram.append(np.maximum(continued[y] - d, 0) / own + (np.minimum(continued[y], d).sum() / own) * both)
        d = f[f"f{y}1"] / max(1, f[f"f{y}1"] + 2 * f[f"f{y}2"]) or 0.5
        n, types = np.zeros(size), np.zeros(size)
        n[starts["w"]], types[starts["w"]] = starts[f"n{y}"], starts[f"t{y}"]
        after[y] = n
        weight.append((np.where(n > 0, d * types / np.maximum(n, 1), 1.0), d))
    pairs = kept["pair"].to_numpy(np.int64)
    v, w = pairs // size, pairs % size
    p = [np.maximum(kept[f"c{y}"].to_numpy() - weight[y][1], 0) / np.maximum(after[y][v], 1) + weight[y][0][v] * unigram[y][w] for y in (0, 1)]
    model = Model(vocabulary, np.log(unigram[1] / unigram[0]).astype(np.float32), np.log(weight[1][0] / weight[0][0]).astype(np.float32), pairs, np.log(p[1] / p[0]).astype(np.float32))
    trial = spark.sparkContext.broadcast(model)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [trial.value.evidence(t) for t in batch["text"]]
            yield pd.DataFrame(got, columns=["a", "b", "c"]).assign(y=batch["y"].to_numpy())

    # One row of numbers for each of at most sample_rows / 5 texts.
    unseen = rows.where("part = 0").mapInPandas(judged, "a double, b double, c double, y int").toPandas()
    trial.unpersist()
    if unseen["y"].nunique() < 2:
        model.curve = np.array(FALLBACK)
    else:
        model.curve = logistic(unseen[["a", "b", "c"]].to_numpy(), unseen["y"].to_numpy())
    return model


def scorer(model: Model, docs: DataFrame):
    """A column function that scores whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shared.value.score(t) for t in batch], dtype="float64")

    return score


def add_score(docs: DataFrame, labels: DataFrame, name: str = "toxicity", text: str = "text", **options) -> DataFrame:
    """docs with the score of each text as column name."""
    return docs.withColumn(name, scorer(fit(docs, labels, text=text, **options), docs)(F.col(text)))
