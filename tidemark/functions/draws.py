"""Seeded draws as Columns (M11): reproducible from a seed and keys, whatever the partitioning.

A uniform number is 52 bits of an MD5 digest of the seed, the keys and the number of the draw.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | str, *keys: Column, draw: int | Column = 0) -> Column:
    """In (0, 1)."""
    number = draw if isinstance(draw, Column) else F.lit(draw)
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys], number.cast("string"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))


def normal(seed: int | str, *keys: Column, draw: int = 0) -> Column:
    """Standard normal, of two uniforms (Box and Muller)."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys, draw=2 * draw))) * F.cos(2 * math.pi * uniform(seed, *keys, draw=2 * draw + 1))


def poisson(rate: Column, seed: int | str, *keys: Column) -> Column:
    """Count of arrivals: by multiplying uniforms up to a rate of 40, by a rounded normal beyond; 0 for no rate."""
    few = F.aggregate(
        F.sequence(F.lit(0), F.lit(200)),
        F.struct(F.lit(1.0).alias("p"), F.lit(-1).alias("k")),
        lambda a, i: F.when(a.p > F.exp(-rate), F.struct((a.p * uniform(seed, *keys, draw=i)).alias("p"), (a.k + 1).alias("k"))).otherwise(a),
        lambda a: a.k.cast("long"),
    )
    many = F.greatest(F.lit(0.0), F.floor(rate + F.sqrt(rate) * normal(seed, *keys) + 0.5)).cast("long")
    return F.when(rate <= 0, F.lit(0).cast("long")).when(rate > 40, many).otherwise(few)


def integer(low: int, high: int, seed: int | str, *keys: Column) -> Column:
    """From ``low`` to ``high``, both included."""
    return (low + F.floor(uniform(seed, *keys) * (high - low + 1))).cast("long")


def pick(values: Column, seed: int | str, *keys: Column) -> Column:
    """An element of an array; null of an empty one."""
    return F.get(values, F.floor(uniform(seed, *keys) * F.size(values)).cast("int"))


def chance(p: float, seed: int | str, *keys: Column) -> Column:
    return uniform(seed, *keys) < p
