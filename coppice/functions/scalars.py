"""Scalar expressions of the labelled-table data model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The multipliers and modulus of the portable generator, and the smallest argument of a logarithm.
MULTIPLIER, HIGH, MODULUS, TINY = 16807, 48271, 2147483647, 1e-6


def log2(x: Column) -> Column:
    """Base-2 logarithm, 0 below 1e-6, so that 0 log 0 is 0."""
    return F.when(x < TINY, F.lit(0.0)).otherwise(F.log2(F.greatest(x, F.lit(TINY))))


def draw(key: Column, seed: int = 1, rounds: int = 3) -> Column:
    """A portable pseudo-random integer in [0, MODULUS) of a 64-bit key: the same in any engine with 64-bit integers.

    The shifted xor keeps it from being a linear map of the key, under which neighbouring keys would be spaced evenly. What
    the key has above the modulus is stirred in, so that draws don't repeat with it."""
    key = key.cast("long")
    low, high = key.bitwiseAND(F.lit(MODULUS)), F.shiftright(key, 31).bitwiseAND(F.lit(MODULUS))
    x = (low + seed * 7919 % MODULUS).bitwiseXOR(high * HIGH % MODULUS) % MODULUS
    for _ in range(rounds):
        x = (x * MULTIPLIER + 12345) % MODULUS
        x = x.bitwiseXOR(F.shiftright(x, 15)) % MODULUS
    return x


def draw_sql(key: str, seed: int = 1, rounds: int = 3) -> str:
    """The same as SQL text, for keys of 0 and above."""
    key = f"CAST({key} AS BIGINT)"
    x = f"(xor(({key} & {MODULUS}) + {seed * 7919 % MODULUS}, (({key} >> 31) & {MODULUS}) * {HIGH} % {MODULUS}) % {MODULUS})"
    for _ in range(rounds):
        x = f"(({x} * {MULTIPLIER} + 12345) % {MODULUS})"
        x = f"(xor({x}, {x} >> 15) % {MODULUS})"
    return x


def drawn(key: np.ndarray, seed: int = 1, rounds: int = 3) -> np.ndarray:
    """The same of an array of 64-bit keys."""
    key = np.asarray(key, np.int64)
    x = ((key & MODULUS) + seed * 7919 % MODULUS ^ (key >> 31 & MODULUS) * HIGH % MODULUS) % MODULUS
    for _ in range(rounds):
        x = (x * MULTIPLIER + 12345) % MODULUS
        x = (x ^ (x >> 15)) % MODULUS
    return x


def draw_for_filter(key: Column, seed: int = 1) -> Column:
    """draw by arrays, for conditions on rows: there Spark repeats the formula's parts, and the code gets too long to be compiled."""

    @F.arrow_udf("long")
    def of(keys: pa.Array) -> pa.Array:
        return pa.array(drawn(keys.fill_null(0).to_numpy(zero_copy_only=False), seed), pa.int64(), mask=keys.is_null().to_numpy(zero_copy_only=False))

    return of(key.cast("long"))


def wide_draw(key: Column, seed: int = 1) -> Column:
    """A portable pseudo-random integer below MODULUS ** 2, about 2 ** 62: where the remainder by a number of rows is wanted."""
    return draw(key, seed) * MODULUS + draw(key, seed + 1)


def wide_sql(key: str, seed: int = 1) -> str:
    """The same as SQL text."""
    return f"({draw_sql(key, seed)} * {MODULUS} + {draw_sql(key, seed + 1)})"


def class_from_thresholds(value: Column, thresholds: list[float]) -> Column:
    """The first i with value <= thresholds[i], else the last class; null stays null."""
    out = F.lit(len(thresholds))
    for i, t in reversed(list(enumerate(thresholds))):
        out = F.when(value <= t, i).otherwise(out)
    return F.when(value.isNotNull(), out)


def nearly_equal(a: Column, b: Column) -> Column:
    """Equality within a relative float epsilon."""
    return F.abs(a - b) <= 1.1920929e-07 * F.greatest(F.abs(a), F.abs(b))


def lower_median(column: str) -> Column:
    return F.expr(f"percentile_disc(0.5) within group (order by {column})")


def smallest_mode(column: str) -> Column:
    return F.expr(f"mode({column}, true)")
