"""Rows that may be among given ones, told by a broadcast Bloom filter: what is surely not among them
isn't shuffled to find that out.

The filter is a table of words of 64 bits: a hash picks a word and three bits in it. Words are made by an
aggregation and broadcast; they are fewer than MOST_WORDS, so the broadcast is bounded, and with more
given rows the filter lets more pass. It never loses a row that is among the given ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Given rows up to this many are broadcast themselves.
FEW = 100_000
#: Given rows for a word (16 bits each), and most words.
A_WORD, MOST_WORDS = 4, 1 << 22


def sift(rows: DataFrame, some: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows whose columns `on` may be those of one of `some` (a kept table), and all that are."""
    on = list(on)
    n = some.count()
    if n <= FEW:
        return rows.join(F.broadcast(some.select(*on)), on, "left_semi")
    words = 1 << min((n // A_WORD).bit_length(), MOST_WORDS.bit_length() - 1)
    h = F.xxhash64(F.lit("sieve"), *on)
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.col("_h"), at).bitwiseAND(F.lit(63)).cast("int"))
    mask = bit(32).bitwiseOR(bit(40)).bitwiseOR(bit(48))
    word = F.col("_h").bitwiseAND(F.lit(words - 1).cast("long"))
    given = some.select(h.alias("_h")).groupBy(word.alias("_w")).agg(F.bit_or(mask).alias("_bits"))
    hashed = rows.withColumn("_h", h)
    has = (word == F.col("_w")) & (F.col("_bits").bitwiseAND(mask) == mask)
    return hashed.join(F.broadcast(given), has, "left_semi").drop("_h")
