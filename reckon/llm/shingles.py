"""Near copies by five-word shingles, found with the keys of SimHash segments (simhash.py).

Likeness is the Jaccard similarity of the sets of five-word shingles (lower-cased A-Z, fewer words: the
whole sequence), NEAR at least, told from SKETCH bits of one-bit min-hashing: a bit of two texts differs
with half the probability that a shingle of either isn't in the other, so pairs at NEAR differ in a
tenth of the bits, and those that differ in MOST bits or fewer are near.

Search. A text has SEGMENTS fingerprint segments of 23 bits, SimHashes of its distinct words (a changed
word spoils five shingles, but one word, so of near copies about one bit in fifteen differs). Each segment
is a word of the Golay code: a text is filed under its codeword's index, and looked up under the indices of
all words within one bit. A key has one of the text's least shingle hashes beside the index, so that it
tells texts apart at any size of the corpus. Near copies at NEAR share each least hash in eight of ten
cases, and the index in most; of SEGMENTS such keys one at least nearly always. Keys with over CROWDED
filed texts (a passage that very many share) are split by each of the other least hashes.

Members of a key are verified by their sketches, component by component, and a spanning forest of what
is verified is passed on. Texts with one fingerprint and sketch are one member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.llm.common import map_arrow, through_store

SHINGLE = 5
NEAR = 0.8
SEGMENTS = 6
SKETCH = 256
#: Bits in which sketches of near texts may differ: a tenth for NEAR, and one standard deviation.
MOST = 30
CROWDED = 20_000
#: Members that are compared at once, and how many nodes grow a component at a time.
TILE, GROW = 512, 16
_RNG = np.random.default_rng(20)
#: Odd factors and addends of the permutations.
_A, _B = (_RNG.integers(0, 1 << 63, SKETCH, np.uint64) << np.uint64(1) | np.uint64(1)), _RNG.integers(0, 1 << 63, SKETCH, np.uint64)
COLUMNS = [*(f"m{i}" for i in range(SEGMENTS)), *(f"s{i}" for i in range(SEGMENTS)), *(f"b{i}" for i in range(SKETCH // 64))]
SCHEMA = ", ".join(f"{c} {'int' if c[0] == 's' else 'long'}" for c in COLUMNS)


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """The distinct hashes of a text's shingles; of no words one of the empty text."""
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    digest, own = xxhash.xxh3_64_intdigest, {b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
    return np.fromiter(map(digest, own), np.uint64, len(own))


def sketch(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least hashes, segments and sketch (in words of 64 bits) of a text of lower-cased words."""
    h, least = shingle_hashes(words), np.full(SKETCH, np.iinfo(np.uint64).max)
    for at in range(0, len(h), 4096):
        least = np.minimum(least, (h[None, at : at + 4096] * _A[:, None] + _B[:, None]).min(1))
    bits = np.packbits(((least >> np.uint64(20)) & np.uint64(1)).astype(bool), bitorder="little").view("<u8")
    own = sorted(set(words)) or [b""]
    digests = np.array([xxhash.xxh3_128_digest(w, 1) + xxhash.xxh3_64_digest(w, 2) for w in own], "S24")
    table = np.frombuffer(digests.tobytes(), np.uint8).reshape(len(own), 24)
    total = np.zeros(192, np.int64)
    for at in range(0, len(table), 1 << 15):
        total += np.unpackbits(table[at : at + (1 << 15)], axis=1).sum(0, dtype=np.int64)
    flags = (2 * total > len(own))[: 23 * SEGMENTS].reshape(SEGMENTS, 23)
    return least[:SEGMENTS], (flags << np.arange(23)).sum(1).astype(np.int32), bits


def columns(sketches: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """COLUMNS of sketches."""
    m, s, b = (np.array([x[i] for x in sketches], kind).reshape(len(sketches), n) for i, kind, n in ((0, np.uint64, SEGMENTS), (1, np.int32, SEGMENTS), (2, np.uint64, SKETCH // 64)))
    parts = [*m.view(np.int64).T, *s.T, *b.view(np.int64).T]
    return dict(zip(COLUMNS, parts))


def _mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    x = (a ^ np.uint64(b) if isinstance(b, int) else a ^ b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


def forest(bits: np.ndarray, filed: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (pairs that differ in `most` bits or fewer) among the first
    `filed` rows of bits, and of these with the others: ends a, b."""
    near = lambda x, y: np.bitwise_count(x[:, None, :] ^ y[None, :, :]).sum(2) <= most
    label = np.arange(len(bits))
    left = [np.arange(filed), np.arange(filed, len(bits))]
    while len(left[0]):
        seed, left[0] = left[0][0], left[0][1:]
        todo = np.array([seed])
        while len(todo) and (len(left[0]) or len(left[1])):
            now, todo = todo[:GROW], todo[GROW:]
            for k, own in enumerate((now, now[now < filed])):
                if len(own) and len(left[k]):
                    hit = np.concatenate([near(bits[own], bits[left[k][at : at + TILE]]).any(0) for at in range(0, len(left[k]), TILE)])
                    new, left[k] = left[k][hit], left[k][~hit]
                    label[new] = seed
                    todo = np.concatenate([todo, new])
    other = np.nonzero(label != np.arange(len(bits)))[0]
    return label[other], other


def links(prints: DataFrame) -> DataFrame:
    """a, b: links between fp of prints (fp and COLUMNS), whose components are those of near texts."""
    from reckon.llm.simhash import _all, _indices, near_indices

    rows = through_store(prints.select("fp", *COLUMNS).distinct(), "shingle-prints")
    words = SKETCH // 64
    sketch_names = [f"b{i}" for i in range(words)]

    def make(b: pa.RecordBatch, sides: tuple[int, ...] = (0, 1)) -> pa.Table:
        fp, bits = b.column("fp").to_numpy(zero_copy_only=False), [b.column(c).to_numpy(zero_copy_only=False) for c in sketch_names]
        out, index = [], _indices()[0]
        for i in range(SEGMENTS):
            least = _mix(b.column(f"m{i}").to_numpy(zero_copy_only=False).view(np.uint64), i + 1)
            seg = b.column(f"s{i}").to_numpy(zero_copy_only=False).astype(np.int64)
            own = index[seg]
            every = np.arange(len(fp))
            for side in sides:
                if side == 0:
                    r, other = every, own
                else:
                    n = near_indices(seg)
                    new = np.ones(n.shape, bool)
                    new[:, 1:] = n[:, 1:] != n[:, :-1]
                    r, c = np.nonzero(new & (n != own[:, None]))
                    other = n[r, c]
                key = _mix(least[r], other.astype(np.int64) + 1)
                out.append(pa.table({"key": key.view(np.int64), "fp": fp[r], **{x: y[r] for x, y in zip(sketch_names, bits)}, "asked": np.full(len(r), bool(side))}))
        return pa.concat_tables(out).combine_chunks()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _all(batches, words + 3):
            key, fp, asked, bits = cols[0], cols[1], cols[-1], np.stack(cols[2:-1], 1).view(np.uint64)
            start = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
            size = np.diff(start)
            two = start[:-1][size == 2]  # most keys with several members
            two = two[~(asked[two] & asked[two + 1]) & (np.bitwise_count(bits[two] ^ bits[two + 1]).sum(1) <= MOST)]
            outs = [(fp[two], fp[two + 1])]
            for g in np.nonzero(size > 2)[0].tolist():
                own = np.arange(start[g], start[g + 1])
                own = own[np.argsort(asked[own], kind="stable")]
                if not asked[own[0]]:
                    a, z = forest(bits[own], int((~asked[own]).sum()), MOST)
                    outs.append((fp[own[a]], fp[own[z]]))
            a, z = (np.concatenate([x[k] for x in outs]) for k in (0, 1))
            pairs = np.unique(np.stack([np.maximum(a, z), np.minimum(a, z)], 1)[a != z], axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]})

    schema = "key long, fp long, " + ", ".join(f"{c} long" for c in sketch_names) + ", asked boolean"
    keyed = map_arrow(rows, make, schema)
    filed = map_arrow(rows, lambda b: make(b, (0,)), schema)
    crowd = through_store(filed.groupBy("key").count().where(f"count > {CROWDED}").select("key"), "shingle-crowds")
    if not crowd.isEmpty():
        apart = F.array(*[F.xxhash64("key", F.lit(i), F.col(f"m{i}")) for i in range(SEGMENTS)])
        least = rows.select("fp", *sketch_names, *[f"m{i}" for i in range(SEGMENTS)])
        split = keyed.join(crowd, "key", "left_semi").join(least, ["fp", *sketch_names]).select(F.explode(apart).alias("key"), "fp", *sketch_names, "asked")
        keyed = keyed.join(crowd, "key", "left_anti").union(split)
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(join, "a long, b long")
