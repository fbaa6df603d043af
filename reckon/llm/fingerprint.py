"""Document fingerprints from prefix polynomial hashes.

For code points c0, c1, ... the prefix array is S[i] = sum of (c_j + 1) B^j for j < i, modulo two
primes. Two spans of one length are equal (but for a chance of about 2^-60) if their differences of
S agree once the one that stands earlier is multiplied by B to the distance; the longest common
extension of two places is found by binary search over span equality.

A fingerprint is the length, the hash of the whole text, and hashes of prefixes and of suffixes at
multiples of a step, the least power of two that makes at most GRID of them.

The likeness of two texts is taken from the texts' prefix arrays, not from their fingerprints. A code
point is shared if it lies in the longest common prefix or suffix, or in a span of at least SPAN code
points that stands anywhere in the other text: the hashes of all spans of SPAN that reach out of
both are looked up among the other's. Likeness is the lesser of both texts' shared code points, by the length of the longer
text: 1 for equal texts. The order of shared spans doesn't count, so texts with the same long spans
in another order are alike too.

Defined cases: a null text counts as empty; two empty texts have likeness 1; the next document of
each is that of the next row by doc_id (null first) and then text, of the last the first; a single
document is its own next; repeated rows are documents of their own; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckon.llm.common import map_arrow
from reckon.ship import ship

PRIMES = (2147483647, 2147483629)
BASES = (1000003019, 777767777)
GRID = 32
#: The least length of a span within both texts that counts as shared.
SPAN = 16
#: Rows aimed at for one range of doc_id, and the most ranges.
RANGE_ROWS = 250
MOST_RANGES = 20_000

_powers = {(k, sign): np.ones(1, np.uint64) for k in (0, 1) for sign in (1, -1)}


def powers(k: int, n: int, sign: int = 1) -> np.ndarray:
    """B^0 ... B^(n-1), or with sign -1 their inverses, modulo the k-th prime, kept and doubled as
    longer texts come."""
    p, have = np.uint64(PRIMES[k]), _powers[k, sign]
    while len(have) < n:
        step = np.uint64(pow(BASES[k], sign * len(have), PRIMES[k]))
        have = np.concatenate([have, have * step % p])
    _powers[k, sign] = have
    return have[:n]


def _slot(windows: np.ndarray, slots: int) -> np.ndarray:
    return (windows & np.uint64(slots - 1)).view(np.int64)


class PrefixHash:
    """Prefix arrays of one text; answers for any spans of it and of others."""

    def __init__(self, text: str | None, base: "PrefixHash | None" = None, common: int = 0):
        """Of text; where its first `common` code points are those of base, base's arrays are taken over."""
        text = text or ""
        self.n, self.base, self.common = len(text), base, common
        c = np.frombuffer(text[common:].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.sums = []
        for k, prime in enumerate(PRIMES):
            p = np.uint64(prime)
            s = np.zeros(self.n + 1, np.uint64)
            if common:
                s[: common + 1] = base.sums[k][: common + 1]
            np.cumsum(c * powers(k, self.n)[common:] % p, out=s[common + 1 :])  # under 2^31 each: no overflow below 2^33 of them
            s[common + 1 :] = (s[common + 1 :] + s[common]) % p
            self.sums.append(s)

    def span(self, a: int, z: int) -> tuple[int, int]:
        """The hash of text[a:z], the same wherever the span stands."""
        return tuple(int(s[z] + np.uint64(p) - s[a]) * pow(b, -a, p) % p for s, p, b in zip(self.sums, PRIMES, BASES))

    def equal(self, a: int, other: "PrefixHash", b: int, n: int) -> bool:
        if a + n > self.n or b + n > other.n:
            return False
        for s, t, p, base in zip(self.sums, other.sums, PRIMES, BASES):
            x, y = (int(s[a + n]) - int(s[a])) % p, (int(t[b + n]) - int(t[b])) % p
            shift = pow(base, abs(b - a), p)
            if (x * shift if b > a else x) % p != (y * shift if a > b else y) % p:
                return False
        return True

    def extension(self, a: int, other: "PrefixHash", b: int) -> int:
        """The length of the longest common span from place a of this text and place b of other."""
        low, high = 0, max(0, min(self.n - a, other.n - b))
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(a, other, b, mid) else (low, mid - 1)
        return low

    def suffix(self, other: "PrefixHash") -> int:
        """The length of the longest common suffix."""
        low, high = 0, min(self.n, other.n)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(self.n - mid, other, other.n - mid, mid) else (low, mid - 1)
        return low

    @cached_property
    def windows(self) -> np.ndarray:
        """The hashes of all spans of SPAN code points, by place."""
        n = max(0, self.n - SPAN + 1)
        out = np.zeros(n, np.uint64)
        have = max(0, min(n, self.common - SPAN + 1))
        for k, s in enumerate(self.sums if n > have else ()):
            p = np.uint64(PRIMES[k])
            out[have:] = (out[have:] << np.uint64(31)) | (s[have + SPAN :] + p - s[have:n]) % p * powers(k, n, -1)[have:] % p
        if have:
            out[:have] = self.base.windows[:have]
        return out

    @cached_property
    def slots(self) -> np.ndarray:
        """Which of a power of two of slots the windows' low bits fall into: eight or more for each."""
        out = np.zeros(1 << max(8, (8 * len(self.windows)).bit_length()), bool)
        out[_slot(self.windows, len(out))] = True
        return out

    def shared(self, other: "PrefixHash", a: int, z: int) -> np.ndarray:
        """Whether each code point from a to z lies in a span of SPAN that other has too. What falls
        into no slot of other's is passed over; the rest, and what of other falls into its slots,
        meet sorted."""
        start = max(0, a - SPAN + 1)
        mine, theirs = self.windows[start:z], other.windows
        if not len(mine) or not len(theirs):
            return np.zeros(z - a, bool)
        maybe = np.flatnonzero(other.slots[_slot(mine, len(other.slots))])
        if len(maybe):
            mine = mine[maybe]
            taken = np.zeros(len(other.slots), bool)
            taken[_slot(mine, len(taken))] = True
            theirs = np.sort(theirs[taken[_slot(theirs, len(taken))]])
            maybe = maybe[theirs[np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)] == mine]
        edges = np.zeros(self.n - start + 1, np.int64)
        edges[maybe] += 1
        edges[maybe + SPAN] -= 1
        return np.cumsum(edges)[a - start : z - start] > 0

    def likeness(self, other: "PrefixHash") -> float:
        longer, shorter = max(self.n, other.n), min(self.n, other.n)
        head = self.extension(0, other, 0)
        if head == longer:
            return 1.0
        tail = min(self.suffix(other), shorter - head)
        covered = []
        for one, two in ((self, other), (other, self)):
            covered.append(head + tail + int(one.shared(two, head, one.n - tail).sum()))
        return min(covered) / longer

    def fingerprint(self) -> "Fingerprint":
        n, step = self.n, 1
        while n > GRID * step:
            step *= 2
        k = n // step
        ends = np.arange(1, k + 1) * step
        head, tail = np.zeros(k, np.uint64), np.zeros(k, np.uint64)
        for i, (s, p) in enumerate(zip(self.sums, PRIMES)):
            p = np.uint64(p)
            head = (head << np.uint64(31)) | s[ends]
            # a suffix of length L starts at n - L: brought to one place by B^L, then B^-n
            t = (s[n] + p - s[n - ends]) % p * powers(i, n + 1)[ends] % p
            inverse = np.uint64(pow(BASES[i], -n, PRIMES[i]))
            tail = (tail << np.uint64(31)) | (t * inverse % p)
        whole = (int(self.sums[0][n]) << 31) | int(self.sums[1][n])
        return Fingerprint(n, whole, step, head, tail)


class Fingerprint:
    """n, whole (62 bits), and hashes of the prefixes and suffixes of lengths step, 2 step, ..."""

    __slots__ = ("n", "whole", "step", "head", "tail")

    def __init__(self, n: int, whole: int, step: int, head: np.ndarray, tail: np.ndarray):
        self.n, self.whole, self.step, self.head, self.tail = n, whole, step, head, tail

    def text(self) -> str:
        """Length, whole hash, step, and 32 bits of each prefix and suffix hash, in hexadecimal."""
        short = lambda x: ((x ^ (x >> np.uint64(29))) & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes().hex()
        return f"{self.n:x}.{self.whole:016x}.{self.step:x}.{short(self.head)}.{short(self.tail)}"


def edited(text: str | None, following: str | None) -> str:
    """text with its last quarter (rounded down) of code points replaced by as many of following's
    first, or all of them."""
    text = text or ""
    k = len(text) // 4
    return text[: len(text) - k] + (following or "")[:k]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row of docs (doc_id, text)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = [PrefixHash(t).fingerprint().text() for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "fingerprint": out})

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """part, doc_id, text, guest: docs dealt to ranges of doc_id, with the first document of each
    range once more (guest) as the end of the range before it (of the last range, that before the
    first). Ranges are cut at quantiles of all ids, so no task gets them all."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = base.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    at = [i / ranges for i in range(1, ranges)]
    cuts = (base.agg(F.percentile_approx("doc_id", at, 5 * MOST_RANGES)).first()[0] or []) if at else []
    cuts = sorted(set(cuts))
    part = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_below(cuts))
    firsts = base.select("doc_id", part.alias("part")).groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("x")).orderBy("part").collect()  # a row for each range
    before = {}
    for here, ahead in zip(firsts, firsts[1:] + firsts[:1]):
        before.setdefault((ahead["part"], ahead["x"]["known"], ahead["x"]["doc_id"]), here["part"])
    rows = base.withColumn("part", part)
    spark = docs.sparkSession
    small = spark.createDataFrame([(a, k, i, h) for (a, k, i), h in before.items()], "part int, known boolean, id long, host int")
    r = rows.alias("r").join(F.broadcast(small.alias("s")), (F.col("r.part") == F.col("s.part")) & F.col("r.doc_id").eqNullSafe(F.col("s.id")), "left")
    both = F.array(F.struct(F.col("r.part").alias("part"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("part"), F.lit(True).alias("guest")))
    dealt = r.select(F.col("r.doc_id").alias("doc_id"), F.col("r.text").alias("text"), F.explode(F.when(F.col("host").isNull(), F.slice(both, 1, 1)).otherwise(both)).alias("x"))
    return dealt.select("x.part", "doc_id", "text", "x.guest")


def _below(cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most doc_id: halving over every g-th, then a look at g."""
    if not cuts:
        return F.lit(0)
    g = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + g] for i in range(0, len(cuts), g)]

    def coarse(a: int, z: int) -> Column:
        """The last of groups a to z - 1 that starts at or below doc_id, or else a."""
        if z - a == 1:
            return F.lit(a)
        mid = (a + z) // 2
        return F.when(F.col("doc_id") < groups[mid][0], coarse(a, mid)).otherwise(coarse(mid, z))

    of = coarse(0, len(groups))
    return of * g + F.size(F.filter(F.element_at(F.lit(groups), of + 1), lambda c: c <= F.col("doc_id")))


def edited_and_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of
    each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*(b.column(i).to_pylist() for i in range(4))) for b in batches)
        out: list[tuple] = []
        last: tuple | None = None  # part, doc_id, text, prefix hashes, fingerprint
        size = 0
        for part, doc_id, text, guest in rows:
            mine = PrefixHash(text)
            if last is not None and last[0] == part:
                new = edited(last[2], text)
                theirs = PrefixHash(new, last[3], len(last[2]) - len(last[2]) // 4)
                sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((last[1], len(last[2]), sha, last[4], theirs.fingerprint().text(), last[3].likeness(theirs), last[3].likeness(mine)))
                size += 1
                if size >= 2000:
                    yield _rows(out)
                    out, size = [], 0
            last = None if guest else (part, doc_id, text, mine, mine.fingerprint().text())
        if out:
            yield _rows(out)

    ship(docs.sparkSession)
    dealt = with_next(docs)
    placed = dealt.repartition("part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "text")
    return placed.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
    return pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in out], t) for i, (k, t) in enumerate(types.items())})
