"""Line dedup: lines that many documents share stay in one of them only.

A text is split at \\n. A line's key is the line without blanks (`[\\x20\\x09-\\x0D]`) at both ends and
with A-Z lower-cased. Keys of LEAST_CHARS code points or more that stand in LEAST_DOCS documents or
more lose all their lines but those of the largest doc_id that holds them.

1. Every task hashes its lines' keys, once for each document, and writes the hashes (8 bytes a line).
2. Two Bloom filters of one size are filled from the hashes: one of hashes seen, one of hashes seen
   twice. Every task fills its own pair and passes on the blocks that have bits; pairs are merged
   block by block, with `twice` getting also what is in `once` of two tasks. A repeated hash so never
   misses `twice`; a single one gets there by chance only (about one in a hundred).
3. A second pass over the texts tests lines against `twice`. A document without a suspect is done
   where it stands. Only suspected keys are shuffled, reduced by task first, and counted exactly, by
   their bytes; the largest doc_id comes with the count.
4. Documents with suspects meet their keys that go, and are put together without them.

Filters grow with the number of lines up to MOST_BITS; beyond that they hold back fewer lines from the
count, which is exact whatever they pass. So neither is the memory of a task unbounded nor a result
approximate. Keys that very many documents hold meet them by broadcast (`common.meet`).

Defined cases: null and empty texts are one empty line; every row is a document of its own, also one
that repeats a doc_id (all rows of the largest doc_id keep their lines); a null doc_id is smaller
than any other; lines of equal keys within a document count once and stay or go together; other
columns are not looked at by `digest`, and carried by `drop_repeated_lines`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from reckon.llm.common import map_arrow, map_batches, meet, quoted, shared_dir, through_store

LEAST_CHARS = 40
LEAST_DOCS = 5
#: Bits of each filter for each hash, and the bounds of a filter.
BITS_A_HASH = 12
LEAST_BITS = 1 << 20
MOST_BITS = 1 << 29
#: Places that a hash has.
PLACES = 4
#: Bits of a block, in which filters travel.
BLOCK_BITS = 1 << 19
#: Keys that more documents hold are met by broadcast (there are at most lines / HOT of them).
HOT = 100_000


def line_key(line: bytes) -> bytes:
    return line.strip(b" \t\n\x0b\x0c\r").lower()  # of bytes: A-Z only


def _long(key: bytes) -> bool:
    return len(key) >= LEAST_CHARS and (key.isascii() or len(key.decode("utf-8", "replace")) >= LEAST_CHARS)


def long_keys(text: bytes | None) -> list[tuple[int, bytes]]:
    """(number of the line, key) of each line that is long enough."""
    return [(i, k) for i, line in enumerate(text.split(b"\n")) if len(line) >= LEAST_CHARS and _long(k := line_key(line))] if text else []


def _hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def hashes(docs: DataFrame) -> DataFrame:
    """h: the hashes of the long keys of each row of docs (text) that has any, each once."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.array(sorted({_hash(k) for _, k in long_keys(t.as_py())}), np.uint64).view(np.int64) for t in b.column(0)]
        return pa.RecordBatch.from_pydict({"h": pa.array([x for x in found if len(x)], pa.list_(pa.int64()))})

    return map_arrow(docs.select(F.col("text").cast("binary").alias("text")), run, "h array<long>")


# -- filters --------------------------------------------------------------------------------------


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """The places of each hash (uint64): PLACES rows."""
    step = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20) | np.uint64(1)
    return np.stack([((h + np.uint64(i) * step) >> np.uint64(7)) & np.uint64(bits - 1) for i in range(PLACES)]).astype(np.int64)


class Pair:
    """The filters `once` and `twice`, as bytes of 8 bits."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def put(self, h: np.ndarray) -> None:
        """Takes in hashes; those that are repeated here, or are in `once` already, go to `twice`."""
        h, n = np.unique(h, return_counts=True)
        at = places(h, self.bits)
        again = (n > 1) | self._has(self.once, at)
        self._set(self.once, at)
        self._set(self.twice, at[:, again])

    @staticmethod
    def _has(of: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((of[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(0)

    @staticmethod
    def _set(of: np.ndarray, at: np.ndarray) -> None:
        np.bitwise_or.at(of, at.ravel() >> 3, (1 << (at.ravel() & 7)).astype(np.uint8))

    def suspects(self, h: np.ndarray) -> np.ndarray:
        return self._has(self.twice, places(h, self.bits))


def filter_bits(n: int) -> int:
    return int(min(MOST_BITS, max(LEAST_BITS, 1 << int(np.ceil(np.log2(max(1, n) * BITS_A_HASH))))))


def write_filter(kept: DataFrame, bits: int) -> str:
    """The path of the blocks (block, twice) of the merged filter of hashes that stand in several
    rows of kept (h)."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = Pair(bits), BLOCK_BITS // 8
        for b in batches:
            own.put(b.column("h").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        for i in np.nonzero(own.once.reshape(-1, size).any(1))[0].tolist():
            a, z = i * size, (i + 1) * size
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "once": [own.once[a:z].tobytes()], "twice": [own.twice[a:z].tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None
        done = lambda: pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int32()), "twice": [twice.tobytes()]})
        for b in batches:
            for i, x, y in zip(b.column("block").to_pylist(), b.column("once"), b.column("twice")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
                if i != now:
                    if now is not None:
                        yield done()
                    now, once, twice = i, x.copy(), y.copy()
                else:
                    twice |= y | (once & x)
                    once |= x
        if now is not None:
            yield done()

    parts = map_batches(kept, fill, "block int, once binary, twice binary")
    merged = map_batches(parts.repartition("block").sortWithinPartitions("block"), merge, "block int, twice binary")
    path = shared_dir(kept.sparkSession, "line-filter")
    merged.write.parquet(path)
    return path


@lru_cache(maxsize=1)
def _read(path: str, bits: int, block_bits: int) -> Pair:
    """The merged filter from the shared folder."""
    store, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))
    own, size = Pair(bits), block_bits // 8
    for f in store.get_file_info(fs.FileSelector(at)):
        if f.base_name.endswith(".parquet"):
            for b in pq.ParquetFile(store.open_input_file(f.path)).iter_batches(16):
                for i, y in zip(b.column("block").to_pylist(), b.column("twice")):
                    own.twice[i * size : (i + 1) * size] = np.frombuffer(y.as_buffer(), np.uint8)
    return own


# -- documents ------------------------------------------------------------------------------------


def without(text: bytes | None, gone: set[bytes]) -> tuple[bytes, int, int]:
    """A text without the lines whose keys are in gone; how many lines it had, and how many go."""
    lines = (text or b"").split(b"\n")
    kept = [x for x in lines if len(x) < LEAST_CHARS or line_key(x) not in gone] if gone else lines
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


_DIGEST = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def _digests(ids: pa.Array, found: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    columns = ids, pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in found], pa.string())
    return pa.RecordBatch.from_pydict(dict(zip(("doc_id", "n_lines", "n_dropped", "kept_sha256"), columns)))


def _suspected(docs: DataFrame) -> DataFrame:
    """number, id, text (as bytes), row (the other columns, as a struct) and keys of each row of docs:
    keys that may stand in several rows, each once."""
    kept = through_store(hashes(docs), "line-hashes")
    bits = filter_bits(kept.agg(F.sum(F.size("h"))).first()[0] or 0)
    path = write_filter(kept, bits)
    rows = docs.select(
        F.monotonically_increasing_id().alias("number"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"),
        F.struct(F.lit(0).alias("any"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]).alias("row"),
    )

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        held, found = _read(path, bits, BLOCK_BITS), []
        for t in b.column("text"):
            keys = list(dict.fromkeys(k for _, k in long_keys(t.as_py())))
            bad = held.suspects(np.array([_hash(k) for k in keys], np.uint64)) if keys else []
            found.append([k for k, s in zip(keys, bad) if s])
        return b.append_column("keys", pa.array(found, pa.list_(pa.binary())))

    return map_arrow(rows, run, StructType([*rows.schema.fields, StructField("keys", ArrayType(BinaryType()))]))


def _with_gone(some: DataFrame) -> DataFrame:
    """some (number, id, text, row and keys, from the store) with gone: the keys whose lines it loses."""
    each = some.select("number", "id", F.explode("keys").alias("key"))
    counted = each.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    real = through_store(counted.where(f"n >= {LEAST_DOCS}"), "line-repeats")
    less = meet(each, real, "key", f"n > {HOT}").where(~F.col("id").eqNullSafe(F.col("last")))
    return some.drop("keys").join(less.groupBy("number").agg(F.collect_list("key").alias("gone")), "number", "left")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 (of the text without its dropped lines) of each row
    of docs (doc_id, text). Only rows with suspects are kept with their texts."""
    found = _suspected(docs.select("doc_id", "text"))

    def first(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, keys = b.column("text").to_pylist(), b.column("keys")
        done = _digests(b.column("id"), [(b"", 0, 0) if n else without(t, set()) for t, n in zip(texts, keys.value_lengths().to_pylist())])
        left = pa.array([t if n else None for t, n in zip(texts, keys.value_lengths().to_pylist())], pa.binary())
        return pa.RecordBatch.from_arrays([b.column("number"), *done.columns, left, keys], names=["number", *done.schema.names, "text", "keys"])

    parts = through_store(map_arrow(found, first, f"number long, {_DIGEST}, text binary, keys array<binary>"), "line-suspects")
    some = parts.where("size(keys) > 0").select("number", F.col("doc_id").alias("id"), "text", "keys")

    def last(b: pa.RecordBatch) -> pa.RecordBatch:
        return _digests(b.column("id"), [without(t, set(g or ())) for t, g in zip(b.column("text").to_pylist(), b.column("gone").to_pylist())])

    return parts.where("size(keys) = 0").select("doc_id", "n_lines", "n_dropped", "kept_sha256").union(map_arrow(_with_gone(some), last, _DIGEST))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, ...) with all their columns, their texts without the lines that
    go. Null texts stay null."""
    parts = through_store(_suspected(docs), "line-suspects")
    clean = parts.where("size(keys) = 0").select("text", "row")

    def last(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [without(t, set(g or ()))[0] for t, g in zip(b.column("text").to_pylist(), b.column("gone").to_pylist())]
        return pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.binary()), "row": b.column("row")})

    some = map_arrow(_with_gone(parts.where("size(keys) > 0")), last, StructType([f for f in parts.schema.fields if f.name in ("text", "row")]))
    back = [F.col("text").cast("string").alias(c) if c == "text" else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return clean.union(some).select(*back)
