"""Which columns may be the key of two tables, and which sets of columns of one."""

from __future__ import annotations

from itertools import combinations
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.functions.cells import KEY_HINTS, MEASURE_HINTS, name_hit, strip
from reckon.functions.names import quoted

DECIMAL = r"^-?[0-9]+\.[0-9]+$"


#: Sketches have 2 ** LG_K cells (a relative error of 0.8 %); estimates count as within SLACK.
LG_K, SLACK = 14, 0.05
#: Sets of columns that are looked at in one pass.
SETS_A_PASS = 200
#: One in so many hashes is looked at first (a power of two).
SLICES = 64


def _sketched(df: DataFrame, sets: list[tuple[str, ...]], cell) -> list[int]:
    """Estimates of how many distinct values each set of columns has, in one pass for SETS_A_PASS."""
    out: list[int] = []
    for at in range(0, len(sets), SETS_A_PASS):
        some = [F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*map(cell, cs)), LG_K)).alias(f"d{i}") for i, cs in enumerate(sets[at : at + SETS_A_PASS])]
        out += list(df.agg(*some).first())
    return out


def guess_keys(a: DataFrame, b: DataFrame, most: int = 4) -> DataFrame:
    """column, unique_rate, blank, score, measure and is_unique of the best common columns.

    unique_rate is the lesser of both sides' parts of distinct values (blank is a value); key-like
    names gain, measure-like names and columns of mostly decimals lose, columns further left gain a
    little. One aggregation of each side counts blanks and decimals and sketches the distinct values of
    all columns; exact distinct counts are made only of columns that can be among the best by their
    sketches."""
    spark = a.sparkSession
    common = [c for c in a.columns if c in set(b.columns)]
    if not common:
        return spark.createDataFrame([], "column string, unique_rate double, blank long, score double, measure boolean, is_unique boolean")
    cell = lambda c: strip(F.coalesce(quoted(c).cast("string"), F.lit("")))

    def profile(df: DataFrame) -> list[tuple[int, int, int, int]]:
        """(rows, about how many distinct, blank, decimal) of each column."""
        sums = [[F.hll_sketch_estimate(F.hll_sketch_agg(cell(c), LG_K)), F.count_if(cell(c) == ""), F.count_if(cell(c).rlike(DECIMAL))] for c in common]
        n, *flat = df.agg(F.count("*").alias("n"), *[x.alias(f"c{i}_{j}") for i, own in enumerate(sums) for j, x in enumerate(own)]).first()
        return [(n, *flat[3 * i : 3 * i + 3]) for i in range(len(common))]

    sides = profile(a), profile(b)
    if not all(p[0][0] for p in sides):
        return spark.createDataFrame([], "column string, unique_rate double, blank long, score double, measure boolean, is_unique boolean")
    plus, measure = [], []
    for i, c in enumerate(common):
        measure.append(sides[0][i][3] > sides[0][i][0] * 0.5 or name_hit(c, MEASURE_HINTS))
        plus.append(0.35 * name_hit(c, KEY_HINTS) - 0.8 * measure[i] + max(0.0, 0.05 - 0.01 * i))
    about = [min(p[i][1] / p[i][0] for p in sides) for i in range(len(common))]
    floor = sorted((min(1.0, r * (1 - SLACK)) + x for r, x in zip(about, plus)), reverse=True)[:most][-1]
    can = [i for i, (r, x) in enumerate(zip(about, plus)) if min(1.0, r * (1 + SLACK)) + x >= floor - 1e-4]

    def distinct(df: DataFrame, side: str) -> DataFrame:
        # long form, so the counts are two plain aggregations with partial counts
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), cell(common[i]).alias("v")) for i in can]))
        return df.select(each.alias("x")).select("x.*").distinct().groupBy("pos").agg(F.count("*").alias(f"d_{side}"))

    known = [(i, common[i], *(p[i][0] for p in sides), sum(p[i][2] for p in sides), plus[i], measure[i]) for i in can]
    facts = spark.createDataFrame(known, "pos int, column string, n_a long, n_b long, blank long, plus double, measure boolean")
    both = facts.join(distinct(a, "a"), "pos").join(distinct(b, "b"), "pos")
    rate = F.least(F.col("d_a") / F.col("n_a"), F.col("d_b") / F.col("n_b"))
    out = both.select("column", F.round(rate, 4).alias("unique_rate"), "blank", F.round(rate + F.col("plus"), 4).alias("score"), "measure", ((rate >= 0.999) & (F.col("blank") == 0)).alias("is_unique"), "pos")
    return out.orderBy(F.desc("score"), "blank", "pos").limit(most).drop("pos")


def _repeating(df: DataFrame, sets: list[tuple[str, ...]]) -> set[int]:
    """Which of sets have rows alike among those whose hash by the set is divisible by SLICES. Rows that are
    alike have one hash, so these are no keys; the others may be. All sets in one pass, and a few
    rows in a hundred for each are shuffled."""
    names = df.columns
    row = df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)])
    own = [[names.index(c) for c in s] for s in sets]
    hashes = F.array(*[F.xxhash64(*[f"c{i}" for i in s]) for s in own])
    some = row.select("*", F.posexplode(hashes).alias("s", "h")).where(F.col("h").bitwiseAND(F.lit(SLICES - 1)) == 0)
    of = [F.when(F.col("s").isin([j for j, s in enumerate(own) if i in s]), F.col(f"c{i}")).alias(f"c{i}") for i in range(len(names))]
    again = some.select("s", *of).groupBy("s", *[f"c{i}" for i in range(len(names))]).count().where("count > 1")
    return {r["s"] for r in again.select("s").distinct().collect()}


def _is_key(df: DataFrame, columns: tuple[str, ...]) -> bool:
    """Whether no two rows of df are alike in columns. Hashes that are all different prove it; if some
    are not, the values themselves are counted."""
    repeated = lambda x: not x.count().where("count > 1").isEmpty()
    own = [quoted(c) for c in columns]
    return not repeated(df.groupBy(F.xxhash64(*own).alias("h"))) or not repeated(df.groupBy(*own))


def composite_keys(df: DataFrame, most_columns: int = 3) -> DataFrame:
    """columns (comma-joined, in df's order) and size of each least set of up to most_columns columns
    that tells all rows apart (null is a value). Level by level: a set is looked at only if no part of it
    is a key already, and if its columns' distinct values could make as many combinations as there are
    rows. Rows alike in a slice of hashes disprove most of those at once; what is left is counted
    over all rows. No rows have no key."""
    spark, names = df.sparkSession, df.columns
    n = df.count()
    keys: list[tuple[str, ...]] = []
    single = dict(zip(names, _sketched(df, [(c,) for c in names], quoted))) if n else {}
    for size in range(1, most_columns + 1):
        sets = [s for s in combinations(names, size) if not any(set(k) <= set(s) for k in keys)]
        sets = [s for s in sets if prod((1 + SLACK) * single.get(c, 0) for c in s) >= n] if n else []
        for at in range(0, len(sets), SETS_A_PASS):
            some = sets[at : at + SETS_A_PASS]
            no = _repeating(df, some)
            keys += [s for i, s in enumerate(some) if i not in no and _is_key(df, s)]
    return spark.createDataFrame([(",".join(k), len(k)) for k in keys], "columns string, size int")
