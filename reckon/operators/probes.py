"""Probes of a query's joins and filters, as DataFrames that run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n of keys that several rows have."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def key_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """rows and distinct_keys, in one row: two counts over partial counts by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_keys"))


def lost_rows(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Rows of left that an inner join would lose."""
    r = right.select(*[F.col(b).alias(f"_{i}") for i, (_, b) in enumerate(on)]).distinct()
    return left.join(r, reduce(lambda x, y: x & y, [F.col(a) == F.col(f"_{i}") for i, (a, _) in enumerate(on)]), "left_anti")


def fan_out(right: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n of the right side's keys that multiply rows of the left."""
    return repeated_keys(right.dropna(subset=keys), keys)


def filter_ladder(df: DataFrame, conditions: list[str]) -> DataFrame:
    """place, condition and n: rows left after each condition, with all before it, in one pass."""
    passed, sums = F.lit(True), [F.count("*").alias("n0")]
    for i, c in enumerate(conditions, 1):
        passed = passed & F.expr(c)
        sums.append(F.count_if(passed).alias(f"n{i}"))
    rungs = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(("all", *conditions)[i]).alias("condition"), F.col(f"n{i}").alias("n")) for i in range(len(conditions) + 1)])
    return df.agg(*sums).select(F.inline(rungs))
