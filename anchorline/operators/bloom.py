"""A set of hashes as bits of bounded size: what isn't in it can be dropped before a shuffle, what is goes on to an exact join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest filter is two megabytes (or what the caller allows); a fuller one drops less but never a member.
MOST_BITS = 1 << 24
BITS_PER_MEMBER = 16


def bits_of(df: DataFrame, hash_column: Column, n: int, most: int = MOST_BITS) -> np.ndarray:
    """The bits of the hashes of n rows as 64-bit words. At most `most` / 64 rows come to the driver, however many rows df has."""
    bits = 1 << 10
    while bits < min(n * BITS_PER_MEMBER, most):
        bits *= 2
    at = hash_column.bitwiseAND(F.lit(bits - 1))
    words = df.select(F.shiftrightunsigned(at, 6).alias("i"), F.expr("1L").alias("one"), at.bitwiseAND(F.lit(63)).cast("int").alias("b"))
    rows = words.groupBy("i").agg(F.bit_or(F.call_function("shiftleft", "one", "b")).alias("w")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[rows["i"].to_numpy(np.int64)] = rows["w"].to_numpy(np.int64)
    return out


def may_contain(words: np.ndarray, hash_column: Column) -> Column:
    """Whether a hash may be a member; false is certain. Computed inside generated code."""
    table = F.split(F.lit(",".join(map(str, words.tolist()))), ",").cast("array<bigint>")  # folded to one constant by the optimizer
    at = hash_column.bitwiseAND(F.lit(words.size * 64 - 1))
    word = F.element_at(table, F.shiftrightunsigned(at, 6).cast("int") + 1)
    return F.call_function("bit_get", word, at.bitwiseAND(F.lit(63)).cast("int")) == 1


def as_bytes(words: np.ndarray) -> bytes:
    """For Python: hash h may be a member if bit h % 8 of byte h // 8 is set, h taken modulo eight times the length."""
    return words.astype("<i8").tobytes()
