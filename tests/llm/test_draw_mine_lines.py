"""Importance resampling, hard negatives, line dedup: against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reckon.llm import line_dedup, negatives, resample
from tests.llm.conftest import SCHEMA, prose

# -- importance resampling ------------------------------------------------------------------------

UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def plain_resample(rows, target, percent=10):
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = (Counter(bucket(w) for x in texts for w in plain_words(x)) for texts in ([r[1] for r in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in rows:
        ws = plain_words(text)
        g = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in map(bucket, ws)]
        weight = math.floor(sum(g) / len(g)) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(ws), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted(map(str, out))


@pytest.mark.parametrize("percent", [10, 100, 0])
def test_resample_is_as_the_plain_version(docs, rows, spark, percent):
    target = [r[1] for r in rows[:20]] + [None, "", "ÄÖ x1"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(docs, bench, percent).collect()
    assert sorted(str(list(r)) for r in got) == plain_resample([(r[0], r[1]) for r in rows], target, percent)


def test_resample_edges(spark, docs, empty):
    bench = docs.select("text").limit(0)
    assert resample.resample(empty, docs).count() == 0
    assert {r["weight"] is not None for r in resample.resample(docs, bench).collect()} == {True}
    # ties: many rows of one doc_id and text; exactly the share is drawn, in ranks without gaps
    same = spark.range(200).select(F.lit(7).cast("long").alias("doc_id"), F.lit("word " * 30).alias("text"), F.lit(1).alias("key"), F.lit(2).alias("rank"))
    drawn = resample.resample(same, docs).where("rank is not null").collect()
    assert sorted(r["rank"] for r in drawn) == list(range(1, 21)) and {r["doc_id"] for r in drawn} == {7}


@pytest.mark.parametrize("k", [1, 2, 499, 500, 777, 1000])
def test_quickselect_finds_the_kth_key(spark, k):
    rng = random.Random(k)
    rows = [(i, None if i % 50 == 0 else rng.randint(0, 20), rng.randint(20, 25), rng.randint(-3, 3)) for i in range(1000)]
    keyed = resample._keyed(spark.createDataFrame(rows, "number long, doc_id long, n_features long, score long"))
    want = sorted((-s, int(d is None), d or 0, n, i) for i, d, n, s in rows)[k - 1]
    for pivots in (1, 5, 32):
        assert resample.kth_key(keyed.select("number", "key"), k, pivots if k in (1, 777) else 32) == want


def test_features_of_longer_runs():
    found, n = resample.features("Ab c, d".encode(), 2)
    assert n == 3 and found.tolist() == [zlib.crc32(x) % 10000 for x in (b"ab", b"c", b"d", b"ab c", b"c d")]


# -- hard negatives -------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_negatives(rows, every=50):
    v = []
    for number, (i, x, y) in enumerate(rows):
        if i is not None and x is not None and y is not None and all(c is not None and math.isfinite(c) for c in x):
            v.append((number, i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * float(np.float32(c))) for c in x]))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for number, i, y, x in v:
        if i % every:
            continue
        scores = sorted(((-dot(x, x2), j, n2, y2) for n2, j, y2, x2 in v if n2 != number))
        for p, j, _, y2 in [s for s in scores if s[3] == y][:5]:
            own = [s for s in scores if s[3] != y and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(i, j, k, n[1], -p, -n[0]) for k, n in enumerate(own, 1)]
    return sorted(out)


def vectors(n, width, seed, spread):
    """Rows around a few centres, some equal, some of other lengths, some broken."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = []
    for i in range(n):
        c = int(rng.integers(6))
        x = (centres[c] + spread * rng.normal(size=width)) / 4
        rows.append((i, [float(np.float32(v)) for v in x], int(rng.integers(4)) if i % 3 else c % 4))
    for i in range(0, n // 3, 2):  # a group of equal vectors, with several labels
        rows[i] = (i, rows[0][1], i % 3)
    rows += [(50, rows[3][1], 1), (50, rows[3][1], 1), (None, rows[3][1], 1), (100, None, 1), (150, rows[5][1], None), (200, [1.0, None], 2), (250, [float("nan")] * width, 1), (300, [float("inf")] + [0.0] * (width - 1), 1)]
    return rows + [(350, [0.5] * (width - 2), 1), (400, [], 1), (-50, rows[7][1], 2)]


@pytest.mark.parametrize("n, width, spread", [(400, 8, 0.2), (700, 16, 1.0), (60, 3, 0.0)])
def test_negatives_are_as_the_plain_version(spark, n, width, spread, monkeypatch):
    for name, value in (("SAMPLE", 150), ("LEAF_ROWS", 8), ("CHUNK", 16), ("FAN", 4)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(n, width, n, spread)
    df = spark.createDataFrame(rows, VECTORS).withColumn("leaf", F.lit(1)).withColumn("x", F.lit("clash"))
    got = sorted(tuple(r) for r in negatives.mine(df).collect())
    assert got == plain_negatives(rows)


def test_the_tree_skips_and_its_bounds_hold(monkeypatch):
    monkeypatch.setattr(negatives, "FAN", 4)
    x = np.floor(64 * np.random.default_rng(3).normal(size=(10, 12)))[np.arange(600) % 10] + np.floor(6 * np.random.default_rng(4).normal(size=(600, 12)))
    most = float((x * x).sum(1).max())
    tree = negatives.build(x[:200], most, 8)
    leaf_of = np.zeros(600, int)
    for node, own, d in tree.paths(x):
        tree.radii[node], tree.rows[node] = d.max(), len(own)
        if not tree.children[node]:
            leaf_of[own] = node
    nodes = list(range(len(tree.centres)))
    low, high = tree.bounds(x[:20], nodes)
    for node, own, _ in tree.paths(x):
        s = x[:20] @ x[own].T
        assert (s >= low[:, node][:, None]).all() and (s <= high[:, node][:, None]).all()

    class Held:
        def of(self, leaf):
            own = np.nonzero(leaf_of == leaf)[0]
            yield own, own, own % 3, x[own]

    found, scored = negatives.mine_block(tree, Held(), np.arange(20), np.arange(20), np.arange(20) % 3, x[:20])
    assert found and scored < 2 * 20 * 600 * 0.8  # a fifth at least isn't looked at


def test_no_vectors(spark):
    assert negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert negatives.mine(spark.createDataFrame([(50, None, 1), (None, [1.0], 1)], VECTORS)).count() == 0
    assert negatives.mine(spark.createDataFrame([(51, [1.0], 1)], VECTORS)).count() == 0


# -- line dedup -----------------------------------------------------------------------------------


def plain_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    n, last = Counter(), {}
    for doc_id, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            n[k] += 1
            last[k] = max(last.get(k, -math.inf), -math.inf if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        own = -math.inf if doc_id is None else doc_id
        kept = [x for x in lines if len(key(x)) < 40 or n[key(x)] < 5 or last[key(x)] == own]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return out


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(11)
    common = ["All rights are with those who wrote it, as it says here.", "ünïcödé line of exactly forty code points", "x" * 39, "y" * 40, "Z" * 40]
    rows = []
    for i in range(120):
        lines = [prose(rng, "en", rng.randint(1, 20)) for _ in range(rng.randint(0, 6))]
        lines += [rng.choice(("", " ", "\t\x0b")) + (c.upper() if rng.random() < 0.3 and c.isascii() else c) + rng.choice(("", " \r")) for c in rng.sample(common, rng.randint(0, 3))]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(119, rows[119][1]), (None, common[0]), (None, common[0]), (500, None), (501, ""), (502, "\n\n"), (503, "\n".join([common[3]] * 5000))]
    rows += [(600 + i, "all the same text, which stands in six of the rows") for i in range(5)] + [(-3, "all the same text, which stands in six of the rows")]
    return rows


def test_line_digests_are_as_the_plain_version(spark, lined):
    docs = spark.createDataFrame(lined, "doc_id long, text string").repartition(7).withColumn("keys", F.lit(1)).withColumn("n", F.lit("x"))
    got = sorted(str(list(r)) for r in line_dedup.digest(docs).collect())
    assert got == sorted(str(list(r[:4])) for r in plain_lines(lined))
    assert any(r[2] for r in plain_lines(lined))


def test_repeated_lines_go(spark, lined):
    docs = spark.createDataFrame([(*r, "k", None) for r in lined], "doc_id long, text string, key string, `od``d.name` int").repartition(5)
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    assert {r["text"] for r in out.where("doc_id = 500").collect()} == {None}
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect()) == sorted((str(r[0]), r[4]) for r in plain_lines(lined))


def test_hot_keys_meet_by_broadcast(spark, lined, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 6)
    docs = spark.createDataFrame(lined, "doc_id long, text string")
    assert sorted(str(list(r)) for r in line_dedup.digest(docs).collect()) == sorted(str(list(r[:4])) for r in plain_lines(lined))


def test_full_filters_lose_nothing(spark, lined, monkeypatch):
    for name, value in (("LEAST_BITS", 1 << 10), ("MOST_BITS", 1 << 10), ("BLOCK_BITS", 1 << 8)):
        monkeypatch.setattr(line_dedup, name, value)
    docs = spark.createDataFrame(lined, "doc_id long, text string").repartition(6)
    assert sorted(str(list(r)) for r in line_dedup.digest(docs).collect()) == sorted(str(list(r[:4])) for r in plain_lines(lined))


def test_filters_hold_back_single_hashes():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, 30000).astype(np.uint64)
    parts = []
    for i in range(6):  # each with rows of its own and a few of another's
        own = line_dedup.Pair(line_dedup.filter_bits(len(h)))
        own.put(np.concatenate([h[i * 5000 : (i + 1) * 5000], h[:100]]))
        parts.append(own)
    once, twice = parts[0].once.copy(), parts[0].twice.copy()
    for p in parts[1:]:
        twice |= p.twice | (once & p.once)
        once |= p.once
    whole = line_dedup.Pair(parts[0].bits)
    whole.twice = twice
    assert whole.suspects(h[:100]).all() and whole.suspects(h[100:]).mean() < 0.02


def test_lines_of_no_rows(empty):
    assert line_dedup.digest(empty).count() == 0 and line_dedup.drop_repeated_lines(empty).count() == 0


def test_all_operators_take_clashing_columns(clashing, rows, spark):
    for op in (line_dedup.digest, lambda d: resample.resample(d, d)):
        assert sorted(str(r["doc_id"]) for r in op(clashing).select("doc_id").collect()) == sorted(str(r[0]) for r in rows)
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA)
    assert line_dedup.digest(nulls).count() == 3 and resample.resample(nulls, nulls).count() == 3
