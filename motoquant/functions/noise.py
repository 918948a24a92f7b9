"""Repeatable noise drawn from a hash of the row key.

``randn(seed)`` depends on how rows fall into partitions, so a retried or re-partitioned job
would give other values. Hashing the key gives the same draw wherever the row is processed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from motoquant.functions.numeric import _c


def uniform(keys: list[Column | str], salt: str, seed: int) -> Column:
    """Uniform draw strictly inside (0, 1) with 52 random bits."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[_c(k).cast("string") for k in keys])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / float(2**52)


def gaussian(keys: list[Column | str], salt: str, seed: int, std: float = 1.0) -> Column:
    """Normal draw by the Box-Muller formula."""
    u = uniform(keys, f"{salt}-a", seed)
    v = uniform(keys, f"{salt}-b", seed)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2.0 * math.pi) * v) * std


LARGEST_STEP = 500.0


def poisson(mean: Column | str, keys: list[Column | str], salt: str, seed: int) -> Column:
    """Poisson draw by walking the distribution function up to the uniform draw.

    The walk is long enough for any draw: its length follows the mean, and the tail that only a larger
    uniform can reach gets a longer one. A mean beyond ``LARGEST_STEP``, whose first mass
    no double holds, is the sum of draws with equal shares of it.
    """
    lam = _c(mean)
    parts = F.ceil(lam / LARGEST_STEP).cast("int")
    shares = F.transform(F.sequence(F.lit(1), parts), lambda j: _walk(lam / parts, uniform([*keys, j], salt, seed)))
    total = F.aggregate(shares, F.lit(0), lambda acc, x: acc + x)
    return F.when(lam > LARGEST_STEP, total).otherwise(_walk(lam, uniform(keys, salt, seed)))


def _walk(lam: Column, u: Column) -> Column:
    """The draw of one mean. Mean and uniform are bound first: written out, the hash would be taken at every step."""
    return F.transform(F.array(F.struct(lam.alias("lam"), u.alias("u"))), lambda x: _bound_walk(x["lam"], x["u"]))[0]


def _bound_walk(lam: Column, u: Column) -> Column:
    # the median is at most the mean and a third; beyond two deviations and two lies less than exp(-2) by Bernstein's bound
    half, most = lam + 1.0, lam + 2.0 * F.sqrt(lam) + 2.0
    short, long = lam + 5.0 * F.sqrt(lam) + 6.0, lam + 10.0 * F.sqrt(lam) + 12.0
    steps = F.when((lam >= 0) & (u < 0.4999), half).when((lam >= 0) & (u < 0.86), most).when(u < 0.999999, short).otherwise(long)
    last = F.ceil(steps).cast("int")
    start = F.struct(
        F.exp(-lam).alias("mass"),
        F.exp(-lam).alias("total"),
        F.when(F.exp(-lam) < u, 1).otherwise(0).alias("k"),
    )

    def step(acc: Column, i: Column) -> Column:
        mass = acc["mass"] * lam / i
        total = acc["total"] + mass
        return F.struct(
            mass.alias("mass"),
            total.alias("total"),
            F.when(total < u, acc["k"] + 1).otherwise(acc["k"]).alias("k"),
        )

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["k"])
