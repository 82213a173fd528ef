"""Stateless random numbers: a uniform draw is a hash of its coordinates.

A draw depends on nothing but the values that name it (seed, run, generation, parent, child, position, ...), so results don't
change with partitioning, retries or the number of executors, and SQL can recompute them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def uniform(*coordinates) -> Column:
    """In (0, 1), from the first 32 bits of the MD5 of the coordinates joined by bars; texts among them are taken as literals."""
    name = F.concat_ws("|", *(col(c).cast("string") for c in coordinates))
    return (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") + 0.5) / F.lit(4294967296.0)


def uniform_int(u: Column, low, high) -> Column:
    """low to high, both included."""
    return (col(low) + F.floor(u * (col(high) - col(low) + 1))).cast("int")


def poisson(u: Column, mean) -> Column:
    """The Poisson quantile of u: how many terms of the distribution stay below it. Terms run to
    mean + 6.5 deviations + 12, beyond which less than 2**-33 is left, the least step of a draw.

    The first term is the exponential of -mean, which a double can't hold beyond 745. Terms and their sum are therefore kept without a
    part of it (``left``, nothing up to 700) that is taken in whenever they grow large."""
    mean = col(mean).cast("double")
    top = F.ceil(mean + 6.5 * F.sqrt(mean) + 12).cast("int")
    first = F.exp(-F.least(mean, F.lit(700.0)))
    start = F.struct(F.lit(0).alias("k"), first.alias("p"), first.alias("total"), F.greatest(mean - 700, F.lit(0.0)).alias("left"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * mean / i
        taken = F.when(p > 1e200, F.least(s["left"], F.lit(400.0))).otherwise(0.0)
        after = F.struct((s["k"] + 1).alias("k"), (p * F.exp(-taken)).alias("p"), ((s["total"] + p) * F.exp(-taken)).alias("total"), (s["left"] - taken).alias("left"))
        return F.when(u > s["total"] * F.exp(-s["left"]), after).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda s: s["k"])
