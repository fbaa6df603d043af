"""Verdicts that never claim more than the data proves.

A verdict is level (ok, warn or diff) and cause (codes, comma-joined). Qualifiers only lower an ok.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _causes(**cases: Column) -> Column:
    return F.array_join(F.filter(F.array(*[F.when(c, name) for name, c in cases.items()]), lambda x: x.isNotNull()), ",")


def file_verdict(stats: DataFrame) -> DataFrame:
    """level and cause of the one row of a file diff's stats."""
    c = F.col
    rows = (c("only_a") > 0) | (c("only_b") > 0) | (c("diff_cells") > 0)
    structure = (c("only_cols_a") > 0) | (c("only_cols_b") > 0)
    level = F.when(rows | structure, "diff").when((c("cmp_cols") == 0) | (c("dup_keys") > 0) | (c("matched") == 0), "warn").otherwise("ok")
    cause = (
        F.when(~rows & structure, "structure").when(~rows & (c("cmp_cols") == 0), "key_only").when(~rows & (c("dup_keys") > 0), "duplicate_keys")
        .when(~rows & (c("matched") == 0), "empty").when(~rows, "equal")
        .otherwise(_causes(missing_in_b=c("truly_only_a") > 0, missing_in_a=c("truly_only_b") > 0, unmatched_duplicates=(c("dup_unmatched_a") + c("dup_unmatched_b")) > 0, cells=c("diff_cells") > 0))
    )
    return stats.select(level.alias("level"), cause.alias("cause"))


def sql_verdict(stats: DataFrame) -> DataFrame:
    """level and cause of the one row of a result diff's stats."""
    c = F.col
    differs = (c("only_a") > 0) | (c("only_b") > 0) | (c("diff_cells") > 0)
    structure = (c("only_cols_a") > 0) | (c("only_cols_b") > 0) | (c("ambiguous_cols") > 0)
    unsure = (c("matched") == 0) | (c("duplicate_keys_a") > 0) | (c("duplicate_keys_b") > 0) | (c("approximate_groups") > 0)
    level = F.when(structure, "diff").when(c("cmp_cols") == 0, "warn").when(differs, "diff").when(unsure, "warn").otherwise("ok")
    cause = (
        F.when(structure, "structure").when(c("cmp_cols") == 0, "key_only")
        .when(differs, _causes(lost_in_b=(c("only_a") > 0) & (c("only_b") == 0), more_in_b=(c("only_b") > 0) & (c("only_a") == 0), own_keys=(c("only_a") > 0) & (c("only_b") > 0), null_flip=c("null_flip") > 0, values=(c("diff_cells") > 0) & (c("null_flip") == 0)))
        .when(c("matched") == 0, "empty").when(c("approximate_groups") > 0, "approximate").when(unsure, "duplicate_keys").otherwise("equal")
    )
    return stats.select(level.alias("level"), cause.alias("cause"))


def _lower(verdict: DataFrame, why: str, when: Column) -> DataFrame:
    level = F.when(when & (F.col("level") == "ok"), "warn").otherwise(F.col("level"))
    return verdict.withColumn("level", level).withColumn("cause", F.when(when, F.concat(F.lit(why + ","), F.col("cause"))).otherwise(F.col("cause")))


def sampled(verdict: DataFrame, is_sample: Column | None = None) -> DataFrame:
    return _lower(verdict, "sample_only", F.lit(True) if is_sample is None else is_sample)


def incomplete(verdict: DataFrame, issues: int) -> DataFrame:
    return _lower(verdict, "scan_incomplete", F.lit(issues > 0))
