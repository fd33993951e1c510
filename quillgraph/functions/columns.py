"""Scalar expressions of the walk and the trainer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def accept(src_degree: Column, dst_degree: Column, common: Column) -> Column:
    """Chance that a walker at the source moves on: tanh of the degree ratio over the source's own neighbours;
    1 where no neighbour is its own (the limit)."""
    own = src_degree - common
    ratio = F.greatest(src_degree, dst_degree) / F.least(src_degree, dst_degree)
    return F.when(own == 0, F.lit(1.0)).otherwise(F.tanh(ratio / own))


def xlog2x(x: Column) -> Column:
    """x log2 x, 0 at 0."""
    return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))


def keep_chance(count: Column, total: Column, sample: float) -> Column:
    """Chance that a token survives frequency subsampling."""
    t = F.lit(sample) * total / count
    return F.least(F.lit(1.0), F.sqrt(t) + t)


def sigmoid(x: Column, clip: float = 6.0) -> Column:
    """Logistic function, saturated outside the clip."""
    return F.when(x > clip, 1.0).when(x < -clip, 0.0).otherwise(1 / (1 + F.exp(-x)))


def trailing_zeros(x: Column) -> Column:
    """Zero bits below the lowest one of a long; 64 for zero."""
    return F.bit_count(x.bitwiseAND(-x) - 1)


def word_hash(word: Column, size: int) -> Column:
    """Polynomial hash of a word's characters (base 257, in 32 bits) below ``size``."""
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.pmod(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 257 + c).bitwiseAND(F.lit((1 << 32) - 1))), F.lit(size))
