"""The public generator mulberry32, for layouts that must be the same everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sequence_of(seed: int, n: int) -> list[float]:
    """The first ``n`` numbers in [0, 1) of mulberry32 for a 32-bit seed."""
    mask, out, state = 0xFFFFFFFF, [], seed & 0xFFFFFFFF
    for _ in range(n):
        state = (state + 0x6D2B79F5) & mask
        t = ((state ^ (state >> 15)) * (state | 1)) & mask
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & mask)) & mask
        out.append(((t ^ (t >> 14)) & mask) / 4294967296)
    return out


def seeded(seed: Column, n: Column) -> Column:
    """array<double> of the first ``n`` numbers for each row's seed, in Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def numbers(seeds, counts):
        import pandas as pd

        return pd.Series([sequence_of(int(s), int(c)) for s, c in zip(seeds, counts)])

    return numbers(seed, n)
