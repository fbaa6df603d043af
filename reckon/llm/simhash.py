"""SimHash near-duplicates found with Golay-code fuzzy hashing.

Fingerprint: text with A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles of three words (repeats
included; all words if there are fewer), XXH64 (seed 42) of each; a bit is 1 if set in over half of
the hashes; no word at all gives zero. Fingerprints that differ in at most 3 of 64 bits are linked.

Search. The 64 bits are cut into segments of 22, 21 and 21 bits, each a word of the perfect
(23,12,7) Golay code with zeros on top. A word's index is the data part of its nearest codeword;
the indices of all words within one bit of it are at most 6. Three errors over three segments leave
(pigeonhole) either a segment without error and another with at most one, or one error in each:

* exact segment i with fuzzy segment j, for the six ordered pairs (i, j): filed under (bits of i,
  index of j), looked up under (bits of i, each of up to 6 indices of j);
* one error in each: the error of the first and of the second segment spares one half of each, so
  filed under (a half of the first, a half of the second, index of the third) in four ways, looked
  up under the same halves with each of the third's indices.

Each pair within reach so meets under some key of 31 bits or more. Those who meet under a key are
verified by their bit difference, component by component, and only a spanning forest of the key's verified links
is passed on: its members' components are kept, with at most one link for each member, so a
large group of near copies never makes all its pairs. Copies (equal fingerprints) are one node.
A key with more than CROWDED filed fingerprints is split, twice if need be: each member is put under
its key with each of four 16-bit parts of the fingerprint, of which two within reach have one in
common, so nothing is lost; and since members are distinct, a part's group is bounded by the bits
that are left.

Defined cases: null and empty texts have fingerprint zero and are linked with each other (and with
any other within reach); rows with a null doc_id take part, but component_id is the smallest
non-null doc_id of the component (null if it has none); repeated rows each give a row; other
columns are not looked at, but `one_of_each` carries them, and settles ties by them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.llm import shingles
from reckon.llm.common import fresh, map_arrow, meet, quoted, through_store
from reckon.llm.graph import components

SHINGLE = 3
REACH = 3
#: Groups of up to TILE fingerprints are compared at once; larger ones GROW against SPAN at a time.
TILE = 2048
GROW = 32
SPAN = 1 << 16
#: Keys with more filed fingerprints are split.
CROWDED = 1 << 16
#: Texts of more rows are met by broadcast (there are at most rows / HOT of them).
HOT = 100_000
#: The four parts of a fingerprint at each splitting: 16-bit runs, and every fourth bit.
PARTS = (tuple(0xFFFF << 16 * i for i in range(4)), tuple(0x1111111111111111 << i for i in range(4)))
#: Widths of the segments, from the lowest bit.
WIDTHS = (22, 21, 21)
#: Generator polynomial of the binary Golay code (fixed value): x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    cuts = list(zip(starts[:n].tolist(), ends[shingle - 1 :].tolist()))
    for at in range(0, n, 1 << 16):
        part = cuts[at : at + (1 << 16)]
        h = np.fromiter((digest(flat[a:z], 42) for a, z in part), np.uint64, len(part))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row of docs (doc_id, text)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "fp": fp.view(np.int64)})

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


# -- the code -----------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _indices() -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word: the index of its nearest codeword; for each syndrome: the error."""

    def syndrome(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x ^= np.where((x >> bit) & 1, GENERATOR << (bit - 11), 0)
        return x

    single = 1 << np.arange(23)
    pairs = [0, *single, *(a | b for i, a in enumerate(single) for b in single[i + 1 :])]
    errors = np.array(pairs + [a | b | c for i, a in enumerate(single) for j, b in enumerate(single[i + 1 :], i + 1) for c in single[j + 1 :]], np.int64)
    leader = np.zeros(1 << 11, np.int64)
    leader[syndrome(errors)] = errors
    index = np.empty(1 << 23, np.int16)
    for at in range(0, len(index), 1 << 17):
        words = np.arange(at, at + (1 << 17))
        index[at : at + (1 << 17)] = (words ^ leader[syndrome(words)]) >> 11
    return index, leader


def near_indices(words: np.ndarray) -> np.ndarray:
    """Codeword indices of the words within one bit of each word (rows of 24, in ascending order,
    repeats included); the word's own index is among them."""
    index, _ = _indices()
    around = np.concatenate([[0], 1 << np.arange(23)])
    return np.sort(index[words[:, None] ^ around[None, :]], axis=1)


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for w in WIDTHS:
        out.append(((fp >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64))
        at += w
    return out


def keys(fp: np.ndarray, both: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, key) under which fingerprints (uint64) are filed, and (unless not wanted) under which
    they are looked up beside those; a key tells its family in its top bits."""
    seg, index = _segments(fp), _indices()[0]
    own = [index[s].astype(np.int64) for s in seg]
    rows = np.arange(len(fp))
    near = []  # (row, other index) by segment
    for s, o in zip(seg, own) if both else ():
        n = near_indices(s)
        new = np.ones(n.shape, bool)
        new[:, 1:] = n[:, 1:] != n[:, :-1]
        new &= n != o[:, None]
        r, c = np.nonzero(new)
        near.append((r, n[r, c].astype(np.int64)))
    filed, asked = [], []

    def family(tag: int, rest: np.ndarray, j: int) -> None:
        base = (np.int64(tag) << np.int64(58)) | (rest << np.int64(12))
        filed.append((rows, base | own[j]))
        if both:
            r, other = near[j]
            asked.append((r, base[r] | other))

    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                family(tag, seg[i], j)
                tag += 1
    cut = [w // 2 for w in WIDTHS[:2]]
    for a in (0, 1):
        for b in (0, 1):
            first = seg[0] >> cut[0] if a else seg[0] & ((1 << cut[0]) - 1)
            second = seg[1] >> cut[1] if b else seg[1] & ((1 << cut[1]) - 1)
            family(tag, (first << np.int64(11)) | second, 2)
            tag += 1
    flat = lambda xs: (np.concatenate([x[0] for x in xs]), np.concatenate([x[1] for x in xs]))
    return [flat(filed), flat(asked)] if both else [flat(filed)]


def _forest(filed: np.ndarray, asked: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within reach among filed, and of filed with asked
    (both uint64, each without repeats): ends a, b."""
    nodes, f = np.concatenate([filed, asked]), len(filed)
    label = np.arange(len(nodes))
    if len(nodes) <= TILE:
        r, c = np.nonzero(np.bitwise_count(filed[:, None] ^ nodes[None, :]) <= reach)
        while len(r):  # join the labels that the links tie together
            low = np.minimum(label[r], label[c])
            np.minimum.at(label, label[r], low)
            np.minimum.at(label, label[c], low)
            while (label[label] != label).any():
                label = label[label]
            keep = label[r] != label[c]
            r, c = r[keep], c[keep]
    else:
        # A component is grown from a seed: only nodes that aren't reached yet are compared, so a
        # dense group is done after a few of its nodes.
        left = [np.arange(f), np.arange(f, len(nodes))]
        while len(left[0]):
            seed, left[0] = left[0][0], left[0][1:]
            todo = np.array([seed])
            while len(todo) and (len(left[0]) or len(left[1])):
                now, todo = todo[:GROW], todo[GROW:]
                for k, own in enumerate((now, now[now < f])):
                    if len(own) and len(left[k]):
                        near = np.concatenate([(np.bitwise_count(nodes[own][:, None] ^ nodes[left[k][at : at + SPAN]][None, :]) <= reach).any(0) for at in range(0, len(left[k]), SPAN)])
                        new, left[k] = left[k][near], left[k][~near]
                        label[new] = seed
                        todo = np.concatenate([todo, new])
    other = np.nonzero(label != np.arange(len(nodes)))[0]
    a, b = nodes[label[other]], nodes[other]
    same = a != b
    return a[same], b[same]


def _all(batches: Iterator[pa.RecordBatch], columns: int = 3) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of whole keys from batches that are sorted by key, their first column."""
    kept: list[np.ndarray] | None = None
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut:
            yield tuple(c[:cut] for c in cols)
        kept = [c[cut:] for c in cols]
    if kept is not None and len(kept[0]):
        yield tuple(kept)


def _links_in(key: np.ndarray, fp: np.ndarray, is_asked: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key. Keys with one filed and few asked rows are done at once."""
    start = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1])
    end = np.concatenate([start[1:], [len(key)]])
    outs: list[tuple[np.ndarray, np.ndarray]] = []
    # neighbours at a distance of 1 to 3 rows settle all keys of up to 4 rows
    small = end - start <= 4
    group = np.repeat(np.arange(len(start)), end - start)
    in_small = small[group]
    for d in (1, 2, 3):
        if len(key) > d:
            meet = (key[d:] == key[:-d]) & in_small[d:] & ~(is_asked[d:] & is_asked[:-d]) & (fp[d:] != fp[:-d])
            meet &= np.bitwise_count(fp[d:] ^ fp[:-d]) <= reach
            k = np.nonzero(meet)[0]
            outs.append((fp[k], fp[k + d]))
    for g in np.nonzero(~small)[0]:
        rows = slice(start[g], end[g])
        asked = is_asked[rows]
        if not asked.all():
            outs.append(_forest(np.unique(fp[rows][~asked]), np.unique(fp[rows][asked]), reach))
    a, b = (np.concatenate([x[i] for x in outs]) if outs else np.empty(0, np.uint64) for i in (0, 1))
    return a, b


def links(distinct: DataFrame, reach: int = REACH) -> DataFrame:
    """a, b: links whose components are those of all fp (distinct signed longs) that differ in at
    most `reach` (up to 3) bits. Not all pairs: of those who meet under a key a spanning forest."""
    if reach > 3:
        raise ValueError("the keys are complete for up to 3 bits")

    def make(b: pa.RecordBatch, sides: tuple[int, ...] = (0, 1)) -> pa.Table:
        fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        tables = []
        for at in range(0, len(fp), 2048):
            x = fp[at : at + 2048]
            for asked, (r, k) in zip(sides, keys(x, len(sides) > 1)):
                tables.append(pa.table({"key": k, "fp": x[r].view(np.int64), "asked": pa.array(np.full(len(r), asked, bool))}))
        return pa.concat_tables(tables).combine_chunks()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, asked in _all(batches):
            a, b = _links_in(key, fp.view(np.uint64), asked, reach)
            pairs = np.unique(np.stack([np.maximum(a.view(np.int64), b.view(np.int64)), np.minimum(a.view(np.int64), b.view(np.int64))], 1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]})

    schema, signed = "key long, fp long, asked boolean", lambda x: x - (1 << 64) if x >> 63 else x
    keyed = map_arrow(distinct.select("fp"), make, schema)
    filed = map_arrow(distinct.select("fp"), lambda b: make(b, (0,)), schema)
    for parts in PARTS:
        crowd = through_store(filed.groupBy("key").count().where(f"count > {CROWDED}").select("key"), "crowded")
        if crowd.isEmpty():
            break
        apart = F.array(*[F.xxhash64("key", F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(p)))) for i, p in enumerate(parts)])
        split = lambda df: df.join(crowd, "key", "left_semi").select(F.explode(apart).alias("key"), "fp", "asked")  # noqa: E731, B023
        keyed, filed = keyed.join(crowd, "key", "left_anti").union(split(keyed)), split(filed)
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(join, "a long, b long")


def classes(prints: DataFrame, reach: int = REACH, more: DataFrame | None = None) -> DataFrame:
    """fp, n (its rows), root (fp of the component) and component_id of each distinct fp of prints
    (doc_id, fp). more: further links (a, b) between fp."""
    nodes = through_store(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-nodes")
    found = components(links(nodes, reach) if more is None else links(nodes, reach).union(more))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    rooted = through_store(rooted, "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    return meet(rooted, least, "root", f"members > {HOT}").select("fp", "n", "root", "component_id")


def near_duplicates(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of docs (doc_id, text)."""
    prints = through_store(fingerprints(docs), "simhash-prints")
    by_fp = through_store(classes(prints, reach), "simhash-classes")
    out = meet(prints, by_fp, "fp", f"n > {HOT}")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """The rows of docs (doc_id, text, ...) with all their columns, less all but one of each
    component: that with the smallest doc_id stays. Documents are linked by their fingerprints, and
    where they are near copies by five-word shingles (shingles.py). Of several rows with that id (or where
    no row of the component has one) the least by a hash of all its columns, each with whether it is null,
    stays; rows that are equal in all columns are copies, of which any is the same.

    Rows are numbered and written once, so all else is done on narrow rows; the texts are read once
    more, for the last semi-join."""
    (number,) = fresh(docs, "number")
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]  # Spark hashes no maps
    rows = through_store(docs.withColumn(number, F.monotonically_increasing_id()), "simhash-rows")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column("text").to_pylist()
        found = np.array([fingerprint(t) for t in texts], np.uint64)
        sketches = [shingles.sketch(t.encode("utf-8", "surrogatepass").lower().split() if t else []) for t in texts]
        return pa.RecordBatch.from_pydict({x: b.column(x) for x in ("number", "hash", "doc_id")} | {"fp": found.view(np.int64)} | shingles.columns(sketches))

    parts = [x for c in plain for x in (quoted(c).isNull(), quoted(c))]  # Spark's hash passes nulls by
    slim = rows.select(F.col(number).alias("number"), F.xxhash64(*parts).alias("hash"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = through_store(map_arrow(slim, run, f"number long, hash long, doc_id long, fp long, {shingles.SCHEMA}"), "simhash-prints")
    by_fp = through_store(classes(prints, reach, shingles.links(prints)), "simhash-classes")
    # only rows that have the component's doc_id are grouped, so a large component isn't gathered
    own = meet(prints.select("number", "hash", "doc_id", "fp"), by_fp, "fp", f"n > {HOT}").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = own.groupBy("root").agg(F.min(F.struct("hash", "number")).alias("x")).select(F.col("x.number").alias(number))
    return rows.join(stay, number, "left_semi").select(*map(quoted, docs.columns))
