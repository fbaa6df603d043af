"""Target-distribution importance resampling: draws the documents that look most like a target.

Features are runs of 1 to `runs` consecutive words, hashed into BUCKETS buckets. A bucket's gain is
the log of its share in the target against its share in the documents (each count plus one), in
thousandths, floored; a document's weight is the floored mean of its features' gains, and its score
adds Gumbel noise of a hash of its id, so that the highest scores are a draw without replacement.

1. Executors count features by bucket; a task passes on at most BUCKETS numbers, and the driver gets
   BUCKETS sums. From them it makes one array of gains.
2. Executors score each text by summing the gains at its features' places in that array. Scores are
   written once, as narrow rows.
3. Distributed quickselect finds the k-th composite key (score downwards, doc_id, n_features, number
   of the row): each round draws PIVOTS random keys among the rows that are still in question, counts
   exactly how many rows lie before, at and between them, and goes on with the gap that holds rank k.
   Keys differ by the row's number, so a round leaves at most the rows between two pivots, ties never
   stop it, and exactly k rows are at or before the key that is found.
4. Only these winners are sorted (by ranges) and ranked, by the sizes of the ranges before.

Defined cases: null texts have no words; texts without words have weight 0; a null doc_id is hashed
as an empty text and comes last among equal scores; rows that repeat a doc_id are rows of their own
(those of equal score and n_features give equal rows but for the rank, so which is which doesn't
show); a target without words leaves gains of the smoothing alone; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reckon.llm.common import map_batches, through_store

BUCKETS = 10_000
RUNS = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
PIVOTS = 32
#: Lower-cases A-Z and makes blanks of the bytes that stand in no word (fixed values).
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def features(text: bytes | None, runs: int = RUNS) -> tuple[np.ndarray, int]:
    """The bucket of each feature of a text (in UTF-8), and how many words it has."""
    words = text.translate(_TABLE).split() if text else []
    own = list(words)
    for n in range(2, runs + 1):
        own += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return (np.fromiter(map(crc32, own), np.uint32, len(own)) % np.uint32(BUCKETS)).astype(np.int64), len(words)


def bucket_counts(texts: DataFrame, runs: int = RUNS) -> np.ndarray:
    """How many features of all rows of texts (text) each bucket has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.column(0):
                total += np.bincount(features(t.as_py(), runs)[0], minlength=BUCKETS)
        found = np.nonzero(total)[0]
        yield pa.RecordBatch.from_pydict({"bucket": found.astype(np.int32), "n": total[found]})

    by_task = map_batches(texts.select(F.col("text").cast("binary").alias("text")), run, "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in by_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))) of each bucket, in doubles."""
    all_s, all_t = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _noise(seed: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, target: DataFrame, runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """number, doc_id, n_words, n_features, weight and score of each row of docs (doc_id, text);
    target (text) has the texts to be like. Kept, so that row numbers stay."""
    gain = gains(bucket_counts(docs, runs), bucket_counts(target, runs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.as_py(), runs) for t in b.column("text")]
            n = [len(x) for x, _ in found]
            weight = [int(gain[x].sum()) // len(x) if len(x) else 0 for x, _ in found]
            yield pa.RecordBatch.from_pydict({"number": b.column("number"), "doc_id": b.column("doc_id"), "n_words": pa.array([w for _, w in found], pa.int64()), "n_features": pa.array(n, pa.int64()), "weight": pa.array(weight, pa.int64())})

    numbered = docs.select(F.monotonically_increasing_id().alias("number"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = map_batches(numbered, run, "number long, doc_id long, n_words long, n_features long, weight long")
    return through_store(rows.withColumn("score", F.col("weight") + _noise(seed)), "resample-scores")


# -- the k-th key ---------------------------------------------------------------------------------

_KEY = ("score", "none", "id", "n_features", "number")


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with key: comes first by score downwards, then doc_id, n_features and number."""
    own = (-F.col("score"), F.col("doc_id").isNull().cast("int"), F.coalesce("doc_id", F.lit(0)), F.col("n_features"), F.col("number"))
    return rows.withColumn("key", F.struct(*[c.cast("long").alias(n) for n, c in zip(_KEY, own)]))


def _literal(key: tuple[int, ...]) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(_KEY, key)])


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS) -> tuple[int, ...]:
    """The k-th (from 1) of the distinct keys of rows (number, key), which has k rows at least."""
    low: tuple[int, ...] | None = None
    high: tuple[int, ...] | None = None
    before, turn = 0, 0
    while True:
        inside = rows
        if low is not None:
            inside = inside.where(F.col("key") > _literal(low))
        if high is not None:
            inside = inside.where(F.col("key") < _literal(high))
        drawn = inside.select("key", F.xxhash64("number", F.lit(turn)).alias("h")).orderBy("h", "key").limit(pivots).collect()
        cuts = sorted(tuple(r["key"]) for r in drawn)
        at = F.array(*map(_literal, cuts))
        # 2 i: between the pivots i - 1 and i; 2 i + 1: the pivot i itself
        place = 2 * F.size(F.filter(at, lambda p: p < F.col("key"))) + F.array_contains(at, F.col("key")).cast("int")
        count = {r["place"]: r["n"] for r in inside.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()}  # at most 2 pivots + 1
        for i in range(2 * len(cuts) + 1):
            if before + count.get(i, 0) >= k:
                break
            before += count.get(i, 0)
        if i % 2:
            return cuts[i // 2]
        low, high = cuts[i // 2 - 1] if i else low, cuts[i // 2] if i // 2 < len(cuts) else high
        turn += 1


def draw(rows: DataFrame, k: int) -> DataFrame:
    """rows (as `scored` gives them; the k best of those with LEAST_WORDS words or more) with rank,
    null for the others."""
    keyed = _keyed(rows)
    some = keyed.where(F.col("n_words") >= LEAST_WORDS)
    if not k:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    last = _literal(kth_key(some.select("number", "key"), k))
    won = (F.col("n_words") >= LEAST_WORDS) & (F.col("key") <= last)
    # partition numbers are written, so sizes and ranks are of the same ranges
    placed = through_store(keyed.where(won).repartitionByRange("key").withColumn("part", F.spark_partition_id()), "resample-winners")
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a number a range
    base, so_far = [], 0
    for p in range(max(sizes) + 1):
        base.append(so_far)
        so_far += sizes.get(p, 0)
    offset = F.get(F.split(F.lit(",".join(map(str, base))), ",").cast("array<bigint>"), F.col("part"))
    ranked = placed.withColumn("rank", offset + F.row_number().over(Window.partitionBy("part").orderBy("key")))
    return keyed.where(~won).select(*rows.columns, F.lit(None).cast("long").alias("rank")).union(ranked.select(*rows.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs (doc_id, text): of the N with
    LEAST_WORDS words or more, floor(percent N / 100) are drawn and ranked from 1."""
    rows = scored(docs, target, runs, seed)
    n = rows.where(F.col("n_words") >= LEAST_WORDS).count()
    return draw(rows, percent * n // 100).select("doc_id", "n_features", "weight", "score", "rank")
