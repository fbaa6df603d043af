"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared lower-cased, with each run of white space as one blank. An item's passages are
its windows of WINDOW characters, every STRIDE and one at its end (a shorter item is one passage). A
passage is found in a document if a region is within the edit budget (RATE of the passage's length).
A document is contaminated by an item if the passages found, with the q-grams that the item shares with
the region around them (its own length before and after), cover COVER characters of the item, or PART
of it if that is less. So one passage alone, which may be a turn of phrase ("which of the following
statements is true"), is no proof, unless the item is little longer; while an item whose words are
partly replaced is found by one passage that has few of them and by what is left between the others.

By the q-gram lemma a region within e edits of a passage of m characters shares at least
m - Q + 1 - Q e of its q-grams, all on diagonals of a band of e either way. So:

1. q-grams shared with each passage are counted in bands of diagonals that overlap by half (a diagonal
   tells where in the text the passage would begin, so a band is also a place);
2. the regions of bands that meet the bound are retained;
3. retained regions are verified by banded alignment.

None of these drops a region that is within the budget. Items of fewer than SHORT
characters say too little for edits: they match where they stand verbatim and aren't part of a longer
word, found by a look-up of each text's substrings of their lengths.

The benchmark is never on the driver: its passages are cut by executors and written to the shared
folder in blocks of about BLOCK_CHARS (by hash of the item, so all passages of an item are in one
block, and blocks are even); a task reads the blocks one after the other, and holds one or two.
Documents are read once, whatever the benchmark's size, and nothing is shuffled.

Defined cases: null and empty texts and items match nothing; repeated rows, of documents or of the
benchmark, give repeated results; a null doc_id or item_id is carried; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.llm.common import blocks, map_arrow, map_batches, shared_dir, through_store

Q = 9
RATE = 0.06
WINDOW = 36
STRIDE = 12
#: Characters of an item that passages must cover, and the part of a short one.
COVER = 52
PART = 0.8
#: Items shorter than this match verbatim only.
SHORT = 32
BLOCK_CHARS = 2_000_000
#: Characters of documents that are held while blocks are read, where there are several.
HELD_CHARS = 16_000_000
TABLE_BITS = 22
#: Positions by which portions of a text overlap; no region is longer.
TILE = 128
#: Shared q-grams held at a time.
MOST_SHARED = 4_000_000


class Hit(NamedTuple):
    passage: int
    start: int
    end: int
    edits: int


def compared(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(m: int) -> int:
    """Edits allowed for a passage of m characters: RATE of it, but few enough for a positive bound;
    none for a short one."""
    return max(0, min(int(RATE * m), (m - Q) // Q)) if m >= SHORT else 0


def bound(m: int) -> int:
    return m - Q + 1 - Q * budget(m)


def passages(text: str) -> list[tuple[int, str]]:
    """(place, passage) of a text as compared."""
    n = len(text)
    if n <= WINDOW:
        return [(0, text)] if n else []
    at = [*range(0, n - WINDOW, STRIDE), n - WINDOW]
    return [(a, text[a : a + WINDOW]) for a in dict.fromkeys(at)]


def _bounded(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] isn't part of a longer word at either end."""
    cut = lambda i: not 0 < i < len(text) or not (text[i - 1].isalnum() and text[i].isalnum())
    return cut(start) and cut(end)


def _grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of each q-gram."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    return h ^ (h >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Index:
    """The q-grams of all passages: by hash, the passages and places where they stand."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.short: dict[int, dict[str, int]] = {}
        for k, p in enumerate(texts):
            if len(p) < SHORT:
                self.short.setdefault(len(p), {})[p] = k
        self.short_hashes = {m: np.unique([_grams(_codes(p), m)[0] for p in own]) for m, own in self.short.items()}
        grams = [_grams(_codes(p)) if len(p) >= SHORT else np.empty(0, np.uint64) for p in texts]
        sizes = np.array([len(g) for g in grams], np.int64)
        h = np.concatenate([*grams, np.empty(0, np.uint64)])
        where = np.repeat(np.arange(len(grams)), sizes)
        start = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
        order = np.argsort(h, kind="stable")
        self.passage, self.at = where[order], (np.arange(len(h)) - np.repeat(start, sizes))[order]
        self.hash, self.n = np.unique(h, return_counts=True)
        self.first = np.cumsum(self.n) - self.n
        self.marked = np.zeros(1 << TABLE_BITS, bool)
        self.marked[_slot(self.hash)] = True
        lengths = np.array([len(p) for p in self.texts], np.int64)
        self.edits = np.array([budget(m) for m in lengths], np.int64)
        self.bounds = np.array([bound(m) for m in lengths], np.int64)

    def shared(self, grams: np.ndarray):
        """(position, passage, place in it) of q-grams shared with passages, in portions of about
        MOST_SHARED: each a triple and the first of its tiles that the portion before had too."""
        pos = np.nonzero(self.marked[_slot(grams)])[0]
        u = np.minimum(np.searchsorted(self.hash, grams[pos]), len(self.hash) - 1)
        real = self.hash[u] == grams[pos]
        pos, u = pos[real], u[real]
        total = np.cumsum(self.n[u])
        a = 0
        while a < len(pos):
            z = int(np.searchsorted(total, (total[a - 1] if a else 0) + MOST_SHARED, "right"))
            z = max(z, int(np.searchsorted(pos, (pos[a] // TILE + 2) * TILE)))  # two whole tiles at least
            z = int(np.searchsorted(pos, pos[z] // TILE * TILE)) if z < len(pos) else z
            n = self.n[u[a:z]]
            row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[u[a:z]], n)
            yield np.repeat(pos[a:z], n), self.passage[row], self.at[row]
            if z == len(pos):
                return
            again = int(np.searchsorted(pos, (pos[z - 1] // TILE) * TILE))  # its last tile again, with the next
            a = again if again > a else z

    def regions(self, grams: np.ndarray):
        """(passage, first diagonal, positions, places in it) of all bands that share q-grams enough
        with a passage. Bands have twice e + 1 diagonals and start at each (e + 1)-th, so one has all
        diagonals of a path, which are at most e + 1."""
        if not len(self.hash):
            return
        steps = len(grams) + 2 * WINDOW
        for pos, p, at in self.shared(grams):
            half = self.edits[p] + 1
            key = p * steps + (pos - at + WINDOW) // half
            order = np.argsort(key, kind="stable")
            key = key[order]
            head = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
            own, band = np.diff(head), key[head[:-1]]
            beside = np.append((band[1:] == band[:-1] + 1) * own[1:], 0)
            for g in np.nonzero(own + beside >= self.bounds[band // steps])[0].tolist():
                of, k = divmod(int(band[g]), steps)
                span = order[head[g] : head[g + 1] + beside[g]]
                yield of, k * (int(self.edits[of]) + 1) - WINDOW, pos[span], at[span]

    def verbatim(self, text: str) -> list[Hit]:
        """The first place of each short passage where it isn't part of a longer word."""
        codes, out = _codes(text) if self.short else None, []
        for m, own in self.short.items():
            h, found = _grams(codes, m), set()
            for at in np.nonzero(np.isin(h, self.short_hashes[m]))[0].tolist():
                k = own.get(text[at : at + m])
                if k is not None and k not in found and _bounded(text, at, at + m):
                    found.add(k)
                    out.append(Hit(k, at, at + m, 0))
        return out

    def verify(self, text: str, regions: list[tuple[int, int]]) -> list[Hit]:
        hits = []
        for p, diagonal in regions:
            passage, e = self.texts[p], int(self.edits[p])
            start = max(0, diagonal - e)
            end = min(len(text), diagonal + 2 * (e + 1) + len(passage) + e)
            found = align(passage, text[start:end], e, diagonal - start, 2 * (e + 1))
            if found:
                hits.append(Hit(p, start + found[1], start + found[2], found[0]))
        return hits


def align(passage: str, region: str, most: int, diagonal: int, width: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best match of passage in region that starts on one of `width`
    diagonals from `diagonal` on and strays at most `most` from them, or None beyond `most`."""
    exact = region.find(passage)
    if exact >= 0:
        return 0, exact, exact + len(passage)
    a = np.frombuffer(passage.encode("utf-32-le", "surrogatepass"), np.uint32)
    pad = most + 1
    raw = np.frombuffer(region.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = diagonal - most  # column j of row i is place low + i + j of the region
    w = width + 2 * most
    far = len(a) * 2 + w
    b = np.full(max(0, -low) + max(len(raw), low + len(a) + w) + pad, 0xFFFFFFFF, np.uint32)
    b[max(0, -low) : max(0, -low) + len(raw)] = raw
    off = max(0, -low) + low
    column = np.arange(w)
    place = low + column
    cost = np.where((place >= 0) & (place <= len(raw)), 0, far)
    begin = place.copy()
    for i, c in enumerate(a):
        # row i + 1: a match or change stays on its column, a char of the passage alone moves left
        changed = cost + (b[off + i : off + i + w] != c)
        alone = np.append(cost[1:] + 1, far)
        take = alone < changed
        new = np.where(take, alone, changed)
        src = np.where(take, np.append(begin[1:], begin[-1]), begin)
        # a char of the region alone moves right: the least of new[k] + (j - k) over k <= j
        lead = new - column
        run = np.minimum.accumulate(lead)
        at = np.maximum.accumulate(np.where(lead == run, column, 0))
        place = low + i + 1 + column
        cost = np.where((place >= 0) & (place <= len(raw)), run + column, far)
        begin = src[at]
        if cost.min() > most:
            return None
    j = int(cost.argmin())
    return int(cost[j]), int(begin[j]), int(low + len(a) + j)


def search(index: Index, low: list[str]) -> list[list[Hit]]:
    """The hits of each text (as compared)."""
    out: list[list[Hit]] = [index.verbatim(t) for t in low]
    for a, z in blocks(low):
        grams = _grams(_codes("\x00".join(low[a:z])))
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low[a:z]])])
        found: list[set[tuple[int, int]]] = [set() for _ in range(z - a)]
        for p, diagonal, pos, at in index.regions(grams):
            least = index.bounds[p]
            of = np.searchsorted(starts, pos, "right") - 1  # bands can reach over texts
            for i in set(of.tolist()):
                # positions and places count once
                if len(set(pos[of == i].tolist())) >= least and len(set(at[of == i].tolist())) >= least:
                    found[i].add((p, diagonal - int(starts[i])))
        for i, regions in enumerate(found):
            if regions:
                out[a + i] += index.verify(low[a + i], sorted(regions))
    return out


# -- items ------------------------------------------------------------------------------------------


class Item(NamedTuple):
    row: int
    item_id: int | None
    length: int


class Block:
    """Items with the index of their passages; places: of each passage, the items that have it and
    where it stands in them; grams: the q-grams of each item."""

    def __init__(self, rows: list[tuple[int, int | None, str, int, str]]):
        """rows: (item_row, item_id, the item's text with its first passage and else '', at, passage)."""
        whole = {r[0]: (r[1], r[2]) for r in rows if r[2]}
        self.items = [Item(row, item_id, len(text)) for row, (item_id, text) in whole.items()]
        self.grams = [_grams(_codes(text)) for _, text in whole.values()]
        number = {x.row: i for i, x in enumerate(self.items)}
        self.index = Index(sorted({r[4] for r in rows}))
        of = {p: k for k, p in enumerate(self.index.texts)}
        self.places: list[list[tuple[int, int]]] = [[] for _ in self.index.texts]
        for row, _, _, at, passage in rows:
            self.places[of[passage]].append((number[row], at))

    def proven(self, text: str, hits: list[Hit]) -> dict[int, list[Hit]]:
        """The items (by number) that passages found in a text prove, with these."""
        found: dict[int, list[tuple[int, Hit]]] = {}
        for h in hits:
            for item, at in self.places[h.passage]:
                found.setdefault(item, []).append((at, h))
        out = {}
        for i, own in found.items():
            n = self.items[i].length
            has = np.zeros(n, bool)
            for at, h in own:
                has[at : at + len(self.index.texts[h.passage])] = True
            if has.sum() < needed(n):
                starts, ends = [h.start for _, h in own], [h.end for _, h in own]
                for a, z in _joined([(max(0, a - n), min(len(text), z + n)) for a, z in zip(starts, ends)]):
                    for at in np.nonzero(np.isin(self.grams[i], _grams(_codes(text[a:z]))))[0].tolist():
                        has[at : at + Q] = True
            if has.sum() >= needed(n):
                out[i] = [h for _, h in own]
        return out


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans with those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def needed(length: int) -> int:
    """Characters of an item of this length that must be found."""
    return min(COVER, math.ceil(PART * length)) if length >= SHORT else length


# -- the benchmark, in blocks in the shared folder --------------------------------------------------


def passage_table(benchmark: DataFrame) -> DataFrame:
    """item_row (its number), item_id, item (its text as compared, beside its first passage only), at and
    passage: each passage once for an item, kept in the shared folder."""

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for r, i, t in zip(*(b.column(c).to_pylist() for c in ("item_row", "item_id", "text"))):
            low = compared(t)
            first: dict[str, int] = {}
            for at, p in passages(low):
                first.setdefault(p, at)
            rows += [(r, i, low if at == 0 else "", at, p) for p, at in first.items()]
        kinds = {"item_row": pa.int64(), "item_id": pa.int64(), "item": pa.string(), "at": pa.int32(), "passage": pa.string()}
        return pa.RecordBatch.from_pydict({c: pa.array([x[k] for x in rows], kind) for k, (c, kind) in enumerate(kinds.items())})

    numbered = benchmark.select(F.monotonically_increasing_id().alias("item_row"), F.col("item_id").cast("long").alias("item_id"), "text")
    return through_store(map_arrow(numbered, cut, "item_row long, item_id long, item string, at int, passage string"), "passages")


def write_blocks(table: DataFrame) -> tuple[str, int]:
    """Passages by block below a folder of the shared store: its path, and how many blocks."""
    total = table.agg(F.sum(F.length("passage"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    path = shared_dir(table.sparkSession, "passage-blocks")
    if n:
        by_block = table.withColumn("block", F.pmod(F.xxhash64("item_row"), F.lit(n)).cast("int"))
        by_block.repartition(min(n, 64), "block").write.partitionBy("block").parquet(path)
    return path, n


@lru_cache(maxsize=2)
def _block(path: str, i: int) -> Block:
    """A block; one without passages is empty."""
    store, own = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))
    at = f"{own}/block={i}"
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return Block([])
    names = ["item_row", "item_id", "item", "at", "passage"]
    t = pq.read_table(at, filesystem=store, partitioning=None, columns=names)
    return Block(sorted(zip(*(t.column(c).to_pylist() for c in names)), key=lambda r: (r[0], r[3])))


def _held(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.Table]:
    """Batches, put together up to HELD_CHARS where there are several blocks to go through."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if n == 1 or size >= HELD_CHARS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


_HITS = "doc_id long, item_id long, edits long, matched_chars long, passages long, start long, end long"


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, matched_chars, passages, start and end for each document of docs
    (doc_id, text) and item of benchmark (item_id, text) that contaminates it: the edits and length
    of its closest passage, how many places match, and the span of all in the text as compared.
    Rows of docs that have no hit give no row."""
    path, n = write_blocks(passage_table(benchmark))
    if not n:
        return docs.sparkSession.createDataFrame([], _HITS)
    names = [x.split()[0] for x in _HITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _held(batches, n):
            ids, low = b.column("doc_id").to_pylist(), [compared(t) for t in b.column("text").to_pylist()]
            for i in range(n):
                block, found = _block(path, i), []
                for d, hs in enumerate(search(block.index, low)):
                    for item, own in block.proven(low[d], hs).items() if hs else ():
                        length = lambda h: len(block.index.texts[h.passage])  # noqa: B023, E731
                        best = min(own, key=lambda h: (h.edits / length(h), h.start, h.edits, length(h)))
                        places = {(h.start, h.end) for h in own}
                        found.append((ids[d], block.items[item].item_id, best.edits, length(best), len(places), min(a for a, _ in places), max(z for _, z in places)))
                if found:
                    yield pa.RecordBatch.from_pydict({c: pa.array([x[k] for x in found], pa.int64()) for k, c in enumerate(names)})

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _HITS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns: one pass, nothing is
    shuffled."""
    path, n = write_blocks(passage_table(benchmark))
    if not n:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _held(batches, n):
            low = [compared(t) for t in b.column("text").to_pylist()]
            clean = np.ones(len(low), bool)
            for i in range(n):
                left = np.nonzero(clean)[0]  # what is found dirty isn't looked at again
                block = _block(path, i)
                clean[left] = [not (hs and block.proven(low[d], hs)) for d, hs in zip(left, search(block.index, [low[d] for d in left]))]
            yield from b.filter(pa.array(clean)).to_batches()

    return map_batches(docs, run, docs.schema)
