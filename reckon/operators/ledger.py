"""Ledger of differences over rounds: open, fixed, back again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States of an entry.
OPEN, FIXED, BACK = "未修复", "已修复", "又出现"
SCHEMA = "pk string, col string, a string, b string, kind string, first_seen string, last_seen string, state string, tag string"
DIFF_SCHEMA = "pk string, col string, a string, b string, kind string"


def merge(ledger: DataFrame, diffs: DataFrame, scope: DataFrame, round_label: str) -> DataFrame:
    """The ledger after a round: found and fixed before: back again; found and back: still back;
    found otherwise: open; not found, though its pk is in scope (pk): fixed; all else stays.

    Of several diffs of one (pk, col) the greatest by (kind, a, b) counts. An empty scope fixes
    nothing. Entries of ledger are one for each (pk, col); null pk or col count as empty texts."""
    if not round_label:
        raise ValueError("a round needs a label")
    c = F.col
    clean = lambda df: df.withColumns({k: F.coalesce(c(k), F.lit("")) for k in ("pk", "col")})
    new = clean(diffs).groupBy("pk", "col").agg(F.max(F.struct("kind", "a", "b")).alias("x")).select("pk", "col", c("x.a").alias("na"), c("x.b").alias("nb"), c("x.kind").alias("nkind"), F.lit(True).alias("found"))
    seen = clean(scope.select("pk").withColumn("col", F.lit(""))).select("pk").distinct().withColumn("in_scope", F.lit(True))
    both = clean(ledger).join(new, ["pk", "col"], "full_outer").join(seen, "pk", "left")
    found, old = F.coalesce("found", F.lit(False)), c("state").isNotNull()
    state = (
        F.when(found & c("state").isin(FIXED, BACK), BACK).when(found, OPEN)
        .when((c("state") != FIXED) & F.coalesce("in_scope", F.lit(False)), FIXED).otherwise(c("state"))
    )
    label = F.lit(round_label)
    return both.select(
        "pk", "col", F.when(found, c("na")).otherwise(c("a")).alias("a"), F.when(found, c("nb")).otherwise(c("b")).alias("b"),
        F.when(found, c("nkind")).otherwise(c("kind")).alias("kind"), F.when(old, c("first_seen")).otherwise(label).alias("first_seen"),
        F.when(found, label).otherwise(c("last_seen")).alias("last_seen"), state.alias("state"),
        F.when(old, c("tag")).otherwise("").alias("tag"),
    )


def summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """added, fixed, kept (active and not found again), updated, total and was_empty, in one row."""
    b = before.select("pk", "col", F.col("state").alias("was"), F.col("last_seen").alias("seen"))
    x = after.join(b, ["pk", "col"], "left")
    new, again = F.col("was").isNull(), F.col("was").isNotNull() & (F.col("last_seen") != F.col("seen"))
    fixed = (F.col("state") == FIXED) & (F.col("was") != FIXED)
    kept = F.col("was").isNotNull() & ~again & (F.col("state") != FIXED)
    return x.agg(F.count_if(new).alias("added"), F.count_if(fixed).alias("fixed"), F.count_if(kept).alias("kept"), F.count_if(again).alias("updated"), F.count("*").alias("total"), (F.count("was") == 0).alias("was_empty"))
