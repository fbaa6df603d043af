"""Coordinated samples of two tables: the same keys are drawn on both sides, so what a sample says of
missing and differing rows holds for the tables.

A key is in the sample if the hash of its normalised form is among the `most` least hashes of all keys
of both sides (a bottom-k sample). That depends on the key alone, not on which side has it or on what else
is there, so a key that one side lacks is drawn as well. The sample is uniform over keys, hence the share
of keys that differ is estimated without bias, and a Wilson interval bounds it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.functions.cells import Dialect, FileDialect, kind_of
from reckon.functions.names import fresh, quoted
from reckon.operators.keyed_diff import KEY, KeyedDiff

#: Standard deviations of the interval (2.576: 99 of 100 such intervals hold the true share).
WIDTH = 2.576


@dataclass
class Sample:
    """Rows of both sides whose keys were drawn; whole: no key was left out."""

    a: DataFrame
    b: DataFrame
    whole: bool


def _hashed(df: DataFrame, keys: list[str], dialect: Dialect, name: str) -> DataFrame:
    kind = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    return df.withColumn(name, F.xxhash64(F.lit(11), *[dialect(quoted(k), kind[k]) for k in keys]))


def draw(a: DataFrame, b: DataFrame, keys: list[str], most: int, dialect: Dialect = FileDialect()) -> Sample:
    """The rows of the `most` keys with the least hashes. Each task passes on at most `most` hashes."""
    (name,) = fresh(a, "h")
    while name.lower() in {c.lower() for c in b.columns}:
        name = "_" + name
    own = [_hashed(df, keys, dialect, name) for df in (a, b)]
    hashes = own[0].select(name).union(own[1].select(name)).distinct()
    least = [r[0] for r in hashes.orderBy(name).limit(most + 1).collect()]  # at most `most` and one numbers
    if len(least) <= most:
        return Sample(a, b, True)
    return Sample(*[df.where(F.col(name) <= F.lit(least[most - 1])).drop(name) for df in own], False)


def share(diff: KeyedDiff) -> DataFrame:
    """keys, differing, share, low and high of a diff of a drawn sample: how many keys it has, how many
    of them differ in any way, and the bounds of the share among all keys of both tables."""
    differs = (F.col("na") != F.col("exact")) | (F.col("nb") != F.col("exact"))
    one = diff.groups.select(*KEY, differs.alias("d")).agg(F.count("*").alias("keys"), F.count_if("d").alias("differing"))
    n, p, z2 = F.col("keys"), F.col("share"), WIDTH * WIDTH
    middle, half = (p + z2 / (2 * n)) / (1 + z2 / n), WIDTH * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    own = one.withColumn("share", F.when(n > 0, F.col("differing") / n).otherwise(F.lit(0.0)))
    some = lambda c, none: F.when(n > 0, c).otherwise(F.lit(none))
    return own.select("keys", "differing", "share", some(F.greatest(F.lit(0.0), middle - half), 0.0).alias("low"), some(F.least(F.lit(1.0), middle + half), 1.0).alias("high"))
