"""URL filters: exact rule lists in Bloom filter cascades.

Rules are (host, path) keys to block or to allow. A url's candidate keys are its host's suffixes of as many labels as some rule's
host has, joined to the prefixes of its path as long as some rule's path: their number depends on the rules, not on the url. The universe of keys is that of the corpus. Level 0 of a cascade encodes
the listed keys; level 1 the universe's keys that pass level 0 without being listed; level 2 the listed keys that
pass level 1; and so on, until no key of either kind is left over. Over that universe, membership is
exact: a key is listed when the first level that refuses it has an odd number. Lookups need no join.

Building scans the urls' keys once a level; what leaves a scan is only the keys that pass all levels so far, a set
that shrinks with every level. Filters hold `bits` bits for each key of what they encode, so their size follows the
listed keys; lists beyond `most_keys` are refused, which bounds the broadcast.

Defined cases: a null url or one without :// has an empty host and path, fits no rule and is allowed; an empty path fits no rule
whose path begins with /; hosts and paths are taken literally otherwise; repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Empty strings where url is null or has no ://."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


@dataclass(frozen=True)
class Shape:
    """How many labels the rules' hosts have, and how long their paths are."""

    labels: tuple[int, ...]
    lengths: tuple[int, ...]

    @classmethod
    def of(cls, rules: list[tuple[str, str, str]]) -> Shape:
        return cls(tuple(sorted({h.count(".") + 1 for _, h, _ in rules})), tuple(sorted({len(p) for _, _, p in rules})))


def keys(host: str, path: str, shape: Shape) -> Iterator[str]:
    """Candidate keys, longest first; of equally long ones the longer host first."""
    # The part before the last labels, if any, comes first and in one piece; it is in no candidate.
    parts = host.rsplit(".", max(shape.labels, default=1))
    hosts = [".".join(parts[-n:]) for n in shape.labels if n <= len(parts)]
    found = [(len(h) + n, len(h), h + "\0" + path[:n]) for h in hosts if h for n in shape.lengths if len(path) >= n]
    for _, _, key in sorted(found, key=lambda x: (-x[0], -x[1])):
        yield key


@dataclass
class Bloom:
    bits: np.ndarray
    rounds: int
    level: int = 0  #: seeds the hash: levels err independently

    @classmethod
    def of(cls, listed: list[str], per_key: float, level: int = 0) -> Bloom:
        size = max(64, int(per_key * len(listed)))
        bloom = cls(np.zeros(-(-size // 8), np.uint8), max(1, round(per_key * 0.693)), level)
        for key in listed:
            for at in bloom.places(key):
                bloom.bits[at >> 3] |= 1 << (at & 7)
        return bloom

    def places(self, key: str) -> list[int]:
        h = xxhash.xxh128_intdigest(key.encode("utf-8", "surrogatepass"), seed=self.level)
        a, b, n = h & (1 << 64) - 1, h >> 64 | 1, 8 * len(self.bits)
        return [((a + i * b) & (1 << 64) - 1) % n for i in range(self.rounds)]

    def __contains__(self, key: str) -> bool:
        return all(self.bits[at >> 3] >> (at & 7) & 1 for at in self.places(key))


@dataclass
class Cascade:
    levels: list[Bloom] = field(default_factory=list)

    def passes(self, key: str) -> int:
        """How many levels accept the key before one refuses it."""
        for i, level in enumerate(self.levels):
            if key not in level:
                return i
        return len(self.levels)

    def __contains__(self, key: str) -> bool:
        # All levels passed: the last one encodes the side that had keys left over.
        return self.passes(key) % 2 == 1


def build(universe: DataFrame, listed: DataFrame, first_bits: float, bits: float, most_keys: int, most_levels: int = 64) -> Cascade:
    """universe: column key, repeats allowed; listed: column key."""
    own = sorted({r["key"] for r in listed.limit(most_keys + 1).collect()})
    if len(own) > most_keys:
        raise ValueError(f"more than {most_keys} listed keys: split the list")
    cascade, side = Cascade(), own
    left = [own, None]
    while side and len(cascade.levels) < most_levels:
        cascade.levels.append(Bloom.of(side, bits if cascade.levels else first_bits, len(cascade.levels)))
        level = len(cascade.levels)
        if level % 2:  # it encodes listed keys: which others pass everything so far?
            if left[1] is None:
                shared = universe.sparkSession.sparkContext.broadcast(cascade)

                @F.pandas_udf("boolean")
                def passing(batch: pd.Series) -> pd.Series:
                    return pd.Series([shared.value.passes(k) == 1 for k in batch], dtype=bool)

                through = universe.where(passing("key")).distinct()
                # False positives only: about 2 ** (-0.69 first_bits) of the universe.
                wrong = through.join(listed.select("key").distinct(), "key", "left_anti").limit(most_keys + 1).collect()
                if len(wrong) > most_keys:
                    raise ValueError("too many false positives at level 0: raise first_bits")
                left[1] = sorted(r["key"] for r in wrong)
            else:
                left[1] = [k for k in left[1] if k in cascade.levels[-1]]
            side = left[1]
        else:
            left[0] = [k for k in left[0] if k in cascade.levels[-1]]
            side = left[0]
    if side:
        raise ValueError("the cascade does not end: raise bits")
    return cascade


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", default: str = "allow", first_bits: float = 32.0, bits: float = 12.0, most_keys: int = 4_000_000) -> DataFrame:
    """rules: (verdict, host, path). One row per page: key, host, path, rule, verdict."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("__page"), host.alias("host"), path.alias("path"))
    shape = Shape.of(rules)

    @F.pandas_udf("array<string>")
    def candidates(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([list(keys(h, p, shape)) for h, p in zip(hosts, paths, strict=True)])

    # Hosts and paths cut to what the longest rule can reach: equal candidates fall together before Python sees them.
    short_host, short_path = F.substring_index("host", ".", -max(shape.labels, default=1)), F.substring("path", 1, max(shape.lengths, default=0))
    short = rows.where("host <> ''").select(short_host.alias("host"), short_path.alias("path")).distinct()
    universe = short.select(F.explode(candidates("host", "path")).alias("key"))
    cascades = {}
    for verdict in sorted({v for v, _, _ in rules}):
        listed = spark.createDataFrame([(h + "\0" + p,) for v, h, p in rules if v == verdict], "key string")
        cascades[verdict] = build(universe, listed, first_bits, bits, most_keys)
    shared = spark.sparkContext.broadcast(cascades)

    @F.pandas_udf("rule string, verdict string")
    def decide(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        out = []
        for h, p in zip(hosts, paths, strict=True):
            hit = next(((k.replace("\0", "", 1), v) for k in keys(h, p, shape) for v, c in shared.value.items() if k in c), (None, default))
            out.append(hit)
        return pd.DataFrame(out, columns=["rule", "verdict"])

    hit = decide(short_host, short_path)
    return rows.withColumn("__d", hit).select(F.col("__page").alias(key), "host", "path", F.col("__d.rule").alias("rule"), F.col("__d.verdict").alias("verdict"))
