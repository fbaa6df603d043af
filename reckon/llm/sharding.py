"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt to virtual partitions by a hash of the row. How many rows of each partition go to each
shard is drawn on the driver from the exact multivariate hypergeometric law: partition sizes are the
matrix's row sums and the shard sizes (at most one apart) its column sums. Each partition is permuted
locally (order of a seeded hash), its ranks are cut by its row of the matrix, rows are exchanged, and
each shard is permuted again: by buckets of a second seeded hash, whose offsets come from their
counts, and order within the bucket; so no task ever holds a whole shard. Only narrow rows move.

Rows that are equal in id, size and checksum are counted first and numbered by blocks, and their
number enters the hashes, so however often a row (or a null id) is repeated, its copies spread over
all partitions and buckets like any others.

The law is `rows`: counts of shards differ by at most one. Equal texts aren't kept together: a
uniform shuffle places each row for itself.

Defined cases: a null text has size 1 and the crc32 of no bytes (0), and so has an empty one; a null
doc_id is an id like others; repeated rows each get a place of their own; an empty table gives no
rows; other columns are not looked at. The same rows and seed give the same places, in whatever order
or split the rows come.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reckon.llm.common import through_store

SHARDS = 16
#: Rows aimed at for a virtual partition and for a bucket of a shard.
ROWS_EACH = 2_000
#: Bounds of the tables that the driver makes; beyond, partitions and buckets hold more rows.
MOST_PARTITIONS = 16_384
MOST_BUCKETS = 4_096
#: Copies of a row that are numbered together.
COPIES = 4_096
#: numpy draws from fewer than this.
NUMPY_MOST = 10**9


def hypergeometric(good: int, bad: int, draws: int, rng: random.Random) -> int:
    """An exact draw of how many of `draws` taken without return are good, by inversion over the
    values around the mode (all that have a share of more than 1e-20 of the mode's)."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(draws * (good / total) * (bad / total) * max(1, total - draws) / max(1, total - 1))
    width = int(12 * spread) + 64
    up = np.arange(mode, min(high, mode + width), dtype=float)
    down = np.arange(mode, max(low, mode - width), -1, dtype=float)
    rise = np.log((good - up) * (draws - up)) - np.log((up + 1) * (bad - draws + up + 1))
    fall = np.log(down * (bad - draws + down)) - np.log((good - down + 1) * (draws - down + 1))
    weight = np.exp(np.concatenate([np.cumsum(fall)[::-1], [0.0], np.cumsum(rise)]))
    at = int(np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), "right"))
    return mode - len(down) + min(at, len(weight) - 1)


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """Counts with the given sums, as a uniform shuffle of all rows would have them. Rows are halved
    again and again; how much of a half's columns goes to its first part is drawn column by column,
    for all halves of a level at once."""
    rng, many = random.Random(seed), np.random.default_rng(seed)
    sums = np.concatenate([[0], np.cumsum(np.array(rows, np.int64))])

    def draw(good: np.ndarray, bad: np.ndarray, draws: np.ndarray) -> np.ndarray:
        large = good + bad >= NUMPY_MOST
        out = many.hypergeometric(np.where(large, 0, good), np.where(large, 0, bad), np.where(large, 0, draws))
        for i in np.nonzero(large)[0]:
            out[i] = hypergeometric(int(good[i]), int(bad[i]), int(draws[i]), rng)
        return out

    spans, held = [(0, len(rows))], np.array([columns], np.int64).reshape(1, len(columns))
    while any(z - a > 1 for a, z in spans):
        whole = [(a, z, (a + z) // 2) for a, z in spans]
        take = np.array([sums[m] - sums[a] if z - a > 1 else sums[z] - sums[a] for a, z, m in whole])
        first, rest = np.zeros_like(held), held.sum(1)
        for k in range(len(columns)):
            rest = rest - held[:, k]
            first[:, k] = draw(held[:, k], rest, take)
            take = take - first[:, k]
        spans, halves = [], []
        for i, (a, z, m) in enumerate(whole):
            spans += [(a, m), (m, z)] if z - a > 1 else [(a, z)]
            halves += [first[i], held[i] - first[i]] if z - a > 1 else [held[i]]
        held = np.array(halves)
    return held.tolist() if rows else []


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (k < n % shards) for k in range(shards)]


def _table(spark: SparkSession, keys: str, lines: list[tuple[int, list[int]]]) -> DataFrame:
    """A small table (part, list of longs) that the plan makes from one literal."""
    text = ";".join(f"{p}:{','.join(map(str, x))}" for p, x in lines)
    row = spark.range(1).select(F.explode(F.split(F.lit(text), ";")).alias("x"))
    part, rest = F.split("x", ":")[0], F.split("x", ":")[1]
    return row.select(part.cast("int").alias(keys), F.split(rest, ",").cast("array<bigint>").alias("cuts"))


def _hash(seed: int, salt: int) -> Column:
    return F.xxhash64("doc_id", "size", "text_crc32", "copy", F.lit(seed), F.lit(salt))


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and copy (the number of the row among its equals), in parts that no
    repeated row makes large."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    ids = ["doc_id", "size", "text_crc32"]
    runs = narrow.groupBy(*ids).agg(F.count("*").alias("n")).select(*ids, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))).alias("first"))
    last = F.least(F.col("n"), F.col("first") + COPIES) - 1
    one = runs.where("n = 1").select(*ids, F.lit(0).cast("long").alias("copy"))
    more = runs.where("n > 1").repartition(*ids, "first").select(*ids, F.explode(F.sequence("first", last)).alias("copy"))
    return one.union(more)


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    base = through_store(_numbered(docs), "numbered")  # texts are read once, all else is narrow
    n = base.count()
    parts = max(1, min(MOST_PARTITIONS, math.ceil(n / ROWS_EACH)))
    buckets = max(1, min(MOST_BUCKETS, math.ceil(n / shards / ROWS_EACH)))
    narrow = base.withColumn("part", F.pmod(_hash(seed, 1), F.lit(parts)).cast("int"))
    sizes = {r["part"]: r["n"] for r in narrow.groupBy("part").agg(F.count("*").alias("n")).collect()}  # at most MOST_PARTITIONS rows
    order = sorted(sizes)
    matrix = communication_matrix([sizes[p] for p in order], shard_sizes(n, shards), seed)
    cuts = [(p, list(accumulate(line))) for p, line in zip(order, matrix)] or [(0, [0] * shards)]
    ids = ["doc_id", "size", "text_crc32"]
    local = Window.partitionBy("part").orderBy(_hash(seed, 2), *ids, "copy")
    ranked = narrow.withColumn("rank", F.row_number().over(local) - 1).join(F.broadcast(_table(spark, "part", cuts)), "part")
    # written once: counts and places are then of the same rows
    dealt = ranked.select(
        *ids, "copy", F.size(F.filter("cuts", lambda c: c <= F.col("rank"))).alias("shard"), _hash(seed, 3).alias("h")
    ).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(buckets)).cast("int"))
    dealt = through_store(dealt, "dealt")
    counts = {(r["shard"], r["bucket"]): r["n"] for r in dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n")).collect()}  # shards x buckets
    offsets = []
    for s in range(shards):
        before, line = 0, []
        for b in range(buckets):
            line.append(before)
            before += counts.get((s, b), 0)
        offsets.append((s, line))
    again = Window.partitionBy("shard", "bucket").orderBy("h", *ids, "copy")
    placed = dealt.join(F.broadcast(_table(spark, "shard", offsets)), "shard").select(
        *ids, F.lit("rows").alias("law"), "shard",
        (F.element_at("cuts", F.col("bucket") + 1) + F.row_number().over(again) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
    return placed
