"""Language ID: multinomial naive Bayes over hashed character n-grams.

N-grams of 1 to 3 letters (lower case; everything else is one kind of gap) are hashed into `buckets`; the smoothed
log-probabilities, one row per language, are broadcast (languages x buckets floats). Texts are scored in batches:
the hashed n-grams of many texts stand in one array, each language's row is gathered through it and summed between
the texts' bounds.

Fitted on a bounded sample: about `per_language` rows of each language, chosen by a hash of the id at a rate that
follows from the language's row count, whole texts. Prediction reads every text whole.

The broadcast matrix has at most MOST_CELLS entries: beyond MOST_CELLS / 2 ** BITS languages the n-grams share fewer buckets (2 ** LEAST_BITS at
least), so any number of languages is learned.

Defined cases: null texts and texts without a letter are `und` with score 0; null langs are not learned from; without any known
language every prediction is `und`; ties go to the language first in code-point order; columns of docs that bear a result's
name are replaced by the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from .blocks import SMALL
from .toxicity import held_out

BITS, LEAST_BITS = 15, 8
MOST_CELLS = 1 << 25  #: entries of the matrix, 4 bytes each
CHUNK = 1 << 20  #: characters that are hashed at once
MOST_SUMS = 1 << 21  #: texts that are scored at once, times languages


@cache
def letters() -> np.ndarray:
    """Of every code point, itself if a letter, else 0."""
    points = np.arange(0x110000, dtype=np.uint32)
    alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return np.where(alpha, points, 0).astype(np.uint32)


def hashed(points: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3: the bucket of the n-gram that starts at each place, and whether it holds a letter."""
    mixed = points.astype(np.uint64)
    gram, some = np.zeros(len(points), np.uint64), np.zeros(len(points), bool)
    for n in range(3):
        if len(points) <= n:
            return
        gram[: len(points) - n] = gram[: len(points) - n] * np.uint64(0x9E3779B97F4A7C15) + mixed[n:] + np.uint64(n + 1)
        some[: len(points) - n] |= mixed[n:] > 0
        spread = gram[: len(points) - n] * np.uint64(0xD6E8FEB86659FD93)
        yield (spread >> np.uint64(64 - bits)).astype(np.int64), some[: len(points) - n]


def groups(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts in runs of about CHUNK characters: their places, their letters one text after another, their bounds. Gaps as long as the
    n-grams reach surround each text, so none of its n-grams depends on its neighbours."""
    run, size = [], 0
    for i, t in enumerate([*texts, None]):
        if i < len(texts) and t:
            run.append(i)
            size += len(t)
        if run and (size >= CHUNK or len(run) >= most or i == len(texts)):
            parts = [np.frombuffer(("\n\n" + texts[k].lower() + "\n\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for k in run]
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            yield run, letters()[np.concatenate(parts)], bounds
            run, size = [], 0


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  #: languages x buckets
    prior: np.ndarray
    bits: int = BITS

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        for run, points, bounds in groups(texts, max(1, MOST_SUMS // len(self.languages))):
            total = np.tile(self.prior, (len(run), 1))
            for bucket, some in hashed(points, self.bits):
                for k, row in enumerate(self.logp):
                    value = np.append(row[bucket] * some, np.zeros(len(points) - len(bucket), np.float32))
                    total[:, k] += np.add.reduceat(value, bounds[:-1], dtype=np.float64)
            best = total.argmax(axis=1)
            share = 1 / np.exp(np.minimum(total - total.max(axis=1, keepdims=True), 0)).sum(axis=1)
            lettered = np.add.reduceat(points > 0, bounds[:-1]) > 0
            for i, b, s, real in zip(run, best, share, lettered, strict=True):
                if real:
                    names[i], scores[i] = self.languages[b], s
        return names, scores


def fit(docs: DataFrame, per_language: int = 4_000, key: str = "doc_id", text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> Model:
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    listed = C.staged(rows.groupBy("l").agg(F.count("*").alias("n")), "languages")
    counts = {r["l"]: r["n"] for r in listed.collect()}
    languages = sorted(counts, key=lambda x: x.encode("utf-8", "surrogatepass"))
    if not languages:
        return Model([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0))
    bits = int(np.clip(np.floor(np.log2(MOST_CELLS / len(languages))), LEAST_BITS, BITS))
    # One row per language: the place in code-point order, and the rate at which rows are drawn.
    place = F.row_number().over(Window.orderBy(F.col("l"))) - 1
    rates = listed.select(F.col("l").alias("__l"), place.cast("int").alias("i"), F.least(F.lit(1.0), per_language / F.col("n")).alias("__rate"))
    rates = F.broadcast(rates) if len(languages) <= SMALL else rates
    known = rows.join(rates, F.col("l") == F.col("__l"))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(43), "k"), F.lit(1 << 20)) < F.col("__rate") * (1 << 20))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, texts in batch.groupby("i")["t"]:
                total = np.zeros(1 << bits, np.int64)
                for _, points, _ in groups(list(texts)):
                    for bucket, some in hashed(points, bits):
                        total += np.bincount(bucket[some], minlength=1 << bits)
                at = np.flatnonzero(total)
                yield pd.DataFrame({"i": np.full(len(at), language), "b": at, "n": total[at]})

    table = drawn.select("t", "i").mapInPandas(count, "i int, b int, n long").groupBy("i", "b").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.full((len(languages), 1 << bits), smoothing)
    matrix[table["i"], table["b"]] += table["n"]
    prior = np.log(np.array([counts[x] for x in languages]) / sum(counts.values()))
    return Model(languages, np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32), prior, bits)


def predictor(model: Model, docs: DataFrame):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            names, scores = shared.value.predict([t if isinstance(t, str) else None for t in batch])
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return predict


def add_language(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with lang_pred and lang_score."""
    predict = predictor(fit(docs, text=text, **options), docs)
    kept = [F.col(c) for c in docs.columns if c.lower() not in ("lang_pred", "lang_score")]
    scored = docs.select(F.struct(*kept).alias("__row"), predict(F.col(text)).alias("__found"))
    return scored.select("__row.*", F.col("__found.lang_pred").alias("lang_pred"), F.col("__found.score").alias("lang_score"))
