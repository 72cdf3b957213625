"""Statistical functions as column expressions: no Python in the plan."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0: series below 2.5, continued fraction above."""
    term = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(z.alias("t"), z.alias("s")), lambda a, k: F.struct((a.t * 2 * z * z / (2 * k + 1)).alias("t"), (a.s + a.t * 2 * z * z / (2 * k + 1)).alias("s")))
    series = 1 - F.lit(2 / math.sqrt(math.pi)) * F.exp(-z * z) * term["s"]
    tail = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda t, k: (k / 2) / (z + t))
    return F.when(z < 2.5, series).otherwise(F.exp(-z * z) / F.lit(math.sqrt(math.pi)) / (z + tail))


def chi2_sf1(x: Column) -> Column:
    """Survival function of chi-square with one degree of freedom."""
    return erfc(F.sqrt(x / 2))


def binomial_two_sided(k: Column, n: Column) -> Column:
    """min(1, 2 P(X <= k)) for X ~ Binomial(n, 1/2); terms are accumulated, so n is not bound by factorials."""
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    upto = F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), zero, lambda a, i: F.struct((a.term * (n - i + 1) / i).alias("term"), (a["sum"] + a.term * (n - i + 1) / i).alias("sum")))
    total = F.when(k < 1, 1.0).otherwise(upto["sum"])
    return F.least(F.lit(1.0), 2 * total * F.pow(F.lit(0.5), n))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))
