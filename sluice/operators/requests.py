"""Embedding by paid requests: truncation, packing into requests, pacing and retries, one client a task.

The rate is shared out: every task keeps to its part of the tokens a minute, so no task has to know of the others.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vector length of each embedding.
DIMENSIONS = {"openai": 1536, "qwen3": 2560, "minilm": 384}
PIECE = re.compile(r"\s*\S+")

Client = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class Limits:
    request_tokens: int = 100_000
    request_texts: int = 256
    text_tokens: int = 8_191
    tokens_a_minute: int = 1_000_000
    headroom: float = 0.85
    tries: int = 6
    longest_wait: float = 30.0


class Pacer:
    """Keeps the tokens of any 60 seconds within the rate; a request larger than the rate goes when none is recent."""

    def __init__(self, rate: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.clock, self.sleep, self.spent = max(1, rate), clock, sleep, []

    def spend(self, tokens: int) -> None:
        while True:
            now = self.clock()
            self.spent = [(t, n) for t, n in self.spent if now - t < 60]
            if not self.spent or sum(n for _, n in self.spent) + tokens <= self.rate:
                break
            self.sleep(60 - (now - self.spent[0][0]))
        self.spent.append((now, tokens))


def truncated(text: str | None, most: int) -> tuple[str, int]:
    """The text's first `most` tokens and their number; blank texts become one space."""
    pieces = PIECE.findall(text or "")
    return ("".join(pieces[:most]) if len(pieces) > most else text, min(len(pieces), most)) if pieces else (" ", 1)


def asked(client: Client, texts: list[str], limits: Limits, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """The client's answer, tried again after the wait that its error names (retry_after, seconds), else 1, 2, 4 ... seconds."""
    for k in range(limits.tries):
        try:
            return client(texts)
        except Exception as e:
            if k + 1 == limits.tries:
                raise
            named = getattr(e, "retry_after", None)
            sleep(min(2.0**k, limits.longest_wait) if named is None else float(named))
    raise ValueError("tries has to be positive")


def embed(rows: DataFrame, key: str, text: str, connect: Callable[[], Client], limits: Limits | None = None, tasks: int = 8) -> DataFrame:
    """key, vec of every row; connect makes a task's client. A missing answer is an error, not a null."""
    limits = limits or Limits()
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, pacer = connect(), Pacer(int(limits.tokens_a_minute * limits.headroom) // tasks)
        keys, texts, tokens = [], [], 0

        def send() -> pd.DataFrame:
            pacer.spend(tokens)
            vectors = asked(client, texts, limits)
            if len(vectors) != len(texts):
                raise ValueError("the client answered fewer vectors than texts")
            return pd.DataFrame({key: keys, "vec": vectors})

        for batch in batches:
            for k, t in zip(batch[key], batch[text], strict=True):
                t, n = truncated(t, limits.text_tokens)
                if texts and (tokens + n > limits.request_tokens or len(texts) == limits.request_texts):
                    yield send()
                    keys, texts, tokens = [], [], 0
                keys, texts, tokens = [*keys, k], [*texts, t], tokens + n
        if texts:
            yield send()

    return rows.select(key, text).repartition(tasks).mapInPandas(run, f"{key} {kind}, vec array<float>")


def plan(rows: DataFrame, group: str, text: str, limits: Limits | None = None) -> DataFrame:
    """Per group: texts, tokens after truncation, texts truncated, and the least minutes at the paced rate."""
    limits = limits or Limits()
    n = F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))
    counted = rows.select(group, n.alias("n"))
    out = counted.groupBy(group).agg(F.count("*").alias("n_texts"), F.sum(F.least(F.greatest("n", F.lit(1)), F.lit(limits.text_tokens))).alias("n_tokens"), F.sum((F.col("n") > limits.text_tokens).cast("long")).alias("n_truncated"))
    return out.withColumn("minutes", F.round(F.col("n_tokens") / F.lit(limits.tokens_a_minute * limits.headroom), 9))
