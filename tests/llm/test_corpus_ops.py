"""Fingerprints, WARC, SimHash, sharding, decontamination, pipeline: against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from reckon.llm import decontam, fingerprint, graph, sharding, shingles, simhash, warc
from tests.llm.conftest import SCHEMA, prose

# -- fingerprints ---------------------------------------------------------------------------------


def test_arrays_taken_over_and_shared_spans():
    rng = random.Random(4)
    for _ in range(150):
        a = "".join(rng.choice("aé𝄞") for _ in range(rng.randint(0, 120)))
        cut = rng.randint(0, len(a))
        b = a[:cut] + "".join(rng.choice("aé") for _ in range(rng.randint(0, 40))) + a[10:40]
        x, fresh = fingerprint.PrefixHash(a), fingerprint.PrefixHash(b)
        y = fingerprint.PrefixHash(b, x, cut)
        assert all((s == t).all() for s, t in zip(y.sums, fresh.sums)) and (y.windows == fresh.windows).all()
        assert y.fingerprint().text() == fresh.fingerprint().text()
        spans = {a[i : i + fingerprint.SPAN] for i in range(len(a) - fingerprint.SPAN + 1)}
        want = np.zeros(len(b), bool)
        for i in range(len(b) - fingerprint.SPAN + 1):
            if b[i : i + fingerprint.SPAN] in spans:
                want[i : i + fingerprint.SPAN] = True
        low, high = sorted(rng.randint(0, len(b)) for _ in range(2))
        assert (y.shared(x, 0, len(b)) == want).all()
        inside = y.shared(x, low, high)  # of spans that reach out of low to high, all points within count
        assert len(inside) == high - low and (inside == want[low:high]).all()


def test_span_equality_and_extensions():
    rng = random.Random(1)
    for _ in range(200):
        a = "".join(rng.choice("abé𝄞") for _ in range(rng.randint(0, 40)))
        b = "".join(rng.choice("abé𝄞") for _ in range(rng.randint(0, 40))) + a[5:25]
        x, y = fingerprint.PrefixHash(a), fingerprint.PrefixHash(b)
        i, j, n = rng.randint(0, len(a)), rng.randint(0, len(b)), rng.randint(0, 10)
        assert x.equal(i, y, j, n) == (i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n])
        if i + n <= len(a) and j + n <= len(b):
            assert (x.span(i, i + n) == y.span(j, j + n)) == (a[i : i + n] == b[j : j + n])
        want = 0
        while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
            want += 1
        assert x.extension(i, y, j) == want


def test_edited_and_next(docs, rows, empty, spark):
    got = fingerprint.edited_and_next(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        new = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        want.append((-1 if r[0] is None else r[0], len(text), hashlib.sha256(new.encode()).hexdigest()))
    assert sorted((-1 if r[0] is None else r[0], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    texts = {r[0]: r[1] or "" for r in rows}
    prints = {}
    for r in got:
        assert prints.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert len(set(prints.values())) == len(prints)
    after = {r[0]: order[(k + 1) % len(order)][1] or "" for k, r in enumerate(order)}
    once = Counter(r[0] for r in rows)
    for r in got:
        text, other = texts[r["doc_id"]], after[r["doc_id"]]
        if once[r["doc_id"]] == 1 and max(len(text), len(other)) < 2000:
            new = text[: len(text) - len(text) // 4] + other[: len(text) // 4]
            assert abs(r["near_edited"] - slow_likeness(text, new)) < 1e-9 and abs(r["near_next"] - slow_likeness(text, other)) < 1e-9
    long = [r for r in got if r["n_chars"] > 100]
    # three quarters are alike, less at most one step of a sixteenth
    assert min(r["near_edited"] for r in long) >= 0.75 - 1 / 16 - 0.01 and np.mean([r["near_next"] for r in long]) < 0.1
    assert fingerprint.edited_and_next(empty).collect() == []
    one = fingerprint.edited_and_next(spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def slow_likeness(a, b):
    if a == b:
        return 1.0
    head = tail = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    while tail < min(len(a), len(b)) - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    found = []
    for x, y in ((a, b), (b, a)):
        own = set(range(head)) | set(range(len(x) - tail, len(x)))
        for i in range(len(x) - fingerprint.SPAN + 1):
            if x[i : i + fingerprint.SPAN] in y:
                own |= set(range(i, i + fingerprint.SPAN))
        found.append(len(own))
    return min(found) / max(len(a), len(b))


def test_likeness_of_spans_inside(spark):
    rng = random.Random(3)
    a = prose(rng, "en", 300)
    near = "First " + a[:700] + " between " + a[700:] + " last"  # no common prefix or suffix
    pairs = [(a, near), (a, prose(rng, "en", 300)), (a, a[5:-5]), (a * 3, "x" + a), ("", "a"), ("", ""), ("ab", "b"), ("x𝄞" * 40, "y" + "x𝄞" * 30 + "z")]
    pairs += [("".join(rng.choice("ab") for _ in range(rng.randint(0, 90))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))) for _ in range(50)]
    for x, y in pairs:
        p, q = fingerprint.PrefixHash(x), fingerprint.PrefixHash(y)
        assert p.likeness(q) == q.likeness(p) == slow_likeness(x, y)
    got = fingerprint.edited_and_next(spark.createDataFrame([(1, a), (2, near)], "doc_id long, text string")).collect()
    assert min(r["near_next"] for r in got) > 0.95


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 7)
    data = [(i * i % 997, f"text number {i} " * (i % 5)) for i in range(300)]
    got = fingerprint.edited_and_next(spark.createDataFrame(data, "doc_id long, text string")).collect()
    order = sorted(data)
    want = []
    for k, (i, t) in enumerate(order):
        want.append((i, hashlib.sha256(fingerprint.edited(t, order[(k + 1) % 300][1]).encode()).hexdigest()))
    assert sorted((r["doc_id"], r["edited_sha256"]) for r in got) == sorted(want)


# -- WARC -----------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big, rng = "x" * 150, random.Random(3)
    data = [(i, f"http://e.org/{i}", rng.choice([big, "short", None, "", "é\r\n\r\nü" * 40, prose(rng, "de", 60)])) for i in range(200)]
    data += [(None, None, big), (None, "http://a b\n", "only null id" * 20), (7, "again", data[7][2]), (400, "u", "z" * 300000)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    path = warc.write(pages, warc.shared_dir(spark, "t"))
    back = warc.read(spark, path)
    first: dict[bytes, int] = {}
    for i, _, h in data:
        p = (h or "").encode()
        if i is not None:
            first[p] = min(i, first.get(p, i))
    want = []
    for i, _, h in data:
        p = (h or "").encode()
        to = first.get(p) if len(p) >= 100 and first.get(p) not in (None, i) else None
        want.append((str(i), len(p), hashlib.sha256(p).hexdigest(), "response" if to is None else "revisit", str(to)))
    got = back.collect()
    assert sorted((str(r[0]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == sorted(want)
    assert all(r["payload"] is None for r in got if r["record_type"] == "revisit")
    full = warc.resolve(back).collect()
    assert Counter(bytes(r["payload"]) for r in full) == Counter((h or "").encode() for *_, h in data)
    assert "http://a%20b%0A" in {r["url"] for r in got}


def test_warc_of_nothing_and_damage(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, record string, salt int, digest string")
    assert warc.round_trip(none).collect() == []
    one = spark.createDataFrame([(1, "u", "<p>")], "page_id long, url string, html string")
    text = (warc.records(one).collect()[0][0] + "\r\n\r\n").encode()
    same = [(3, "http://e.org/c d", "y" * 120), (2, "http://e.org/b", "y" * 120), (5, None, "w" * 120), (6, "u", "w" * 120)]
    heads = {}
    for r in warc.records(spark.createDataFrame(same, "page_id long, url string, html string")).collect():
        head, _ = next(warc.parse((r[0] + "\r\n\r\n").encode()))
        heads[int(head["X-Page"])] = head
    assert heads[3]["WARC-Refers-To"] == heads[2]["WARC-Record-ID"] and heads[3]["WARC-Refers-To-Target-URI"] == heads[2]["WARC-Target-URI"]
    assert heads[3]["WARC-Refers-To-Date"] == heads[2]["WARC-Date"] and "WARC-Refers-To-Target-URI" not in heads[2]
    assert "WARC-Refers-To-Target-URI" not in heads[6] and heads[6]["WARC-Refers-To"] == heads[5]["WARC-Record-ID"]
    assert len(list(warc.parse(text))) == 1
    with pytest.raises(ValueError):
        list(warc.parse(text[:-3]))


# -- SimHash --------------------------------------------------------------------------------------


def slow_fingerprint(text):
    raw = bytearray((text or "").encode())
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw).decode()
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(values, reach=3):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= reach:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_near_duplicates_as_all_pairs_have_them(docs, rows, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = [slow_fingerprint(r[1]) for r in rows]
    roots = slow_components(prints)
    least = {}
    for r, root in zip(rows, roots):
        if r[0] is not None:
            least[root] = min(r[0], least.get(root, r[0]))
    want = sorted((str(r[0]), f"{p:016x}", str(least.get(root))) for r, p, root in zip(rows, prints, roots))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    assert simhash.near_duplicates(empty).collect() == []


def test_one_of_each(clashing, rows, empty):
    kept = simhash.one_of_each(clashing)
    assert kept.columns == clashing.columns
    roots = slow_components([slow_fingerprint(r[1]) for r in rows])
    least = {}
    for r, root in zip(rows, roots):
        if root not in least or (r[0] is not None and (least[root] is None or r[0] < least[root])):
            least[root] = r[0]
    got, by_fingerprint = {r["doc_id"] for r in kept.collect()}, set(least.values())
    assert kept.count() == len(got) and got <= by_fingerprint
    texts = {r[0]: shingle_set(r[1]) for r in rows if r[1]}
    for i in by_fingerprint - got:  # near copies by shingles, beyond the fingerprints' reach
        assert max(len(texts[i] & y) / len(texts[i] | y) for j, y in texts.items() if j != i) >= 0.7
    assert simhash.one_of_each(empty).collect() == []


def test_links_lose_no_pair_within_reach(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    values = [int(x) for x in base]
    for x in base:
        for _ in range(2):
            y = int(x)
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                y ^= 1 << int(b)
            values.append(y)
    center = int(base[0])  # a dense group, far larger than what is done row by row
    values += [center ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]
    values = list(dict.fromkeys(values))
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    found = {r["node"]: r["root"] for r in graph.components(simhash.links(df)).collect()}
    roots = slow_components(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    groups: dict[int, set[int]] = {}
    for v, r in zip(signed, roots):
        groups.setdefault(r, set()).add(v)
    for group in groups.values():
        assert {found.get(v, v) for v in group} == {min(group)}


def test_crowded_keys_and_hot_rows_change_nothing(spark, docs, monkeypatch):
    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 1 << 63))
    values = {center ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (250, 3))}
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    want = {r["node"]: r["root"] for r in graph.components(simhash.links(df)).collect()}
    near = sorted(map(str, simhash.near_duplicates(docs).collect()))
    for module, name in ((simhash, "CROWDED"), (simhash, "HOT"), (graph, "HOT")):
        monkeypatch.setattr(module, name, 3)
    assert {r["node"]: r["root"] for r in graph.components(simhash.links(df)).collect()} == want and len(want) > 100
    assert sorted(map(str, simhash.near_duplicates(docs).collect())) == near


def test_one_of_each_of_ties_and_odd_names(spark):
    text = "some words that are here twice or more"
    data = [(1, text, 7, 8, "x"), (1, text, 9, 8, "y"), (1, text, 9, 8, "y"), (2, text + " or", 1, 1, "z"), (3, "entirely other words in this one", 5, 6, "k")]
    df = spark.createDataFrame(data, "doc_id long, text string, `number` int, fp int, `a``b.c` string")
    found = [sorted(map(tuple, simhash.one_of_each(x).collect())) for x in (df, df.repartition(5), df.orderBy("number"))]
    assert found[0] == found[1] == found[2] and [r[0] for r in found[0]] == [1, 2, 3] and set(found[0]) <= set(data)
    assert simhash.one_of_each(df).columns == df.columns
    odd = [(1, "one and the same text of some words", None, "a"), (1, "one and the same text of some words", "a", None)]
    both = [spark.createDataFrame(x, "doc_id long, text string, p string, q string") for x in (odd, odd[::-1])]
    assert simhash.one_of_each(both[0]).collect() == simhash.one_of_each(both[1]).collect()


def test_forests_of_large_and_small_groups_agree(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    flip = lambda x: x ^ (np.uint64(1) << rng.integers(0, 64, x.shape).astype(np.uint64))
    nodes = rng.permutation(np.unique(np.concatenate([base, flip(base), flip(flip(base)), flip(flip(flip(flip(base))))])))
    filed, asked = nodes[:70], nodes[70:]
    found = []
    for tile in (2048, 8):
        monkeypatch.setattr(simhash, "TILE", tile)
        monkeypatch.setattr(simhash, "SPAN", 16)
        root = {int(x): int(x) for x in nodes}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(*simhash._forest(filed, asked, 3)):
            x, y = top(int(a)), top(int(b))
            root[max(x, y)] = min(x, y)
        found.append({x: top(x) for x in root})
    assert found[0] == found[1] and len(set(found[0].values())) < len(nodes)


def test_codewords_near_words():
    index, _ = simhash._indices()
    assert np.bincount(index, minlength=4096).tolist() == [2048] * 4096  # perfect: equal spheres
    words = np.random.default_rng(1).integers(0, 1 << 23, 500)
    near = simhash.near_indices(words)
    assert max(len(set(r)) for r in near.tolist()) == 6
    for bit in range(23):
        assert all(index[w ^ (1 << bit)] in set(r) for w, r in zip(words.tolist(), near.tolist()))


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 400) if i % 50] + [(1000 + i, 1000) for i in range(300)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(150)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingle_set(text, n=5):
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def test_near_copies_by_shingles_are_found(spark):
    """Of pairs with five-word Jaccard of 0.8 or more nine of ten at least; of unlike ones none."""
    rng, data, pairs = random.Random(9), [], []
    for i in range(0, 600, 2):
        words = prose(rng, "en", rng.randint(30, 300)).split()
        changed = list(words)
        for _ in range(max(1, round(len(words) * (rng.uniform(0.003, 0.05) if i % 6 else 0.15)))):
            changed[rng.randrange(len(words))] = "other" + str(rng.random())
        data += [(i, " ".join(words)), (i + 1, " ".join(changed))]
        x, y = shingle_set(data[-2][1]), shingle_set(data[-1][1])
        pairs.append((i, len(x & y) / len(x | y)))
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    near = [i for i, j in pairs if j >= 0.8]
    far = [i for i, j in pairs if j < 0.6]
    assert len(near) > 60 and len(far) > 30 and {i for i, _ in pairs} <= kept
    assert sum(i + 1 not in kept for i in near) >= 0.9 * len(near) and sum(i + 1 not in kept for i in far) <= 0.1 * len(far)


def test_sketches_and_forests():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (5, 4), np.uint64)
    bits = np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, (n, 4), np.uint64)) for b, n in zip(base, (900, 3, 1, 40, 2))])
    filed = rng.random(len(bits)) < 0.5
    order = np.argsort(~filed, kind="stable")
    bits, n = bits[order], int(filed.sum())
    near = np.bitwise_count(bits[:, None] ^ bits[None]).sum(2) <= 8
    near[n:, n:] = False
    want = np.arange(len(bits))
    for _ in range(12):
        want = np.array([want[np.nonzero(row)[0]].min() if row.any() else w for row, w in zip(near | near.T | np.eye(len(bits), dtype=bool), want)])
    got = np.arange(len(bits))
    a, b = shingles.forest(bits, n, 8)
    got[b] = got[a]
    same = lambda x: {frozenset(np.nonzero(x == v)[0].tolist()) for v in set(x.tolist())}
    assert same(got) == same(want)
    words = [b"w%d" % i for i in range(400)]
    x, y = shingles.sketch(words)[2], shingles.sketch(words[:360] + [b"z%d" % i for i in range(40)])[2]
    true = 356 / (396 + 40)
    assert abs(1 - 2 * np.bitwise_count(x ^ y).sum() / 256 - true) < 0.15 and (shingles.sketch([])[2] == shingles.sketch([])[2]).all()


def test_crowded_shingle_keys_are_split(spark, monkeypatch):
    rng = random.Random(2)
    text = prose(rng, "en", 120).split()
    data = [(i, " ".join(w if rng.random() > 0.004 else "x" + str(rng.random()) for w in text)) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    whole = simhash.one_of_each(df).count()
    monkeypatch.setattr(shingles, "CROWDED", 5)
    assert whole <= 3 and simhash.one_of_each(df).count() <= 3


# -- sharding -------------------------------------------------------------------------------------


def test_shards(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_EACH", 9)
    got = sharding.shuffle_into_shards(docs).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    n = Counter(r["shard"] for r in got)
    assert set(n) == set(range(16)) and max(n.values()) - min(n.values()) <= 1
    for k in n:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(n[k]))
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    again = sharding.shuffle_into_shards(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    other = sharding.shuffle_into_shards(docs, seed=8).collect()
    assert {(r["doc_id"], r["shard"]) for r in other} != {(r["doc_id"], r["shard"]) for r in got}
    assert sharding.shuffle_into_shards(empty).collect() == []


def test_shards_by_hand(docs, rows, monkeypatch):
    """Every place computed again, row by row, but for the matrix's draws (whose law has its own test)."""
    monkeypatch.setattr(sharding, "ROWS_EACH", 5)
    seed = 3
    counts = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    items = [(*ids, copy) for ids, n in counts.items() for copy in range(n)]

    def signed(item, salt):  # hashes chained through the values, nulls passed over
        h = 42
        for value, width in (*((v, 8) for v in item), (seed, 4), (salt, 4)):
            if value is not None:
                h = xxhash.xxh64(value.to_bytes(width, "little", signed=True), seed=h).intdigest()
        return h - (1 << 64) if h >> 63 else h

    def by(item):
        return (item[0] is not None, item[0] or 0, *item[1:])

    parts = -(-len(items) // 5)
    held = {}
    for x in items:
        held.setdefault(signed(x, 1) % parts, []).append(x)
    order = sorted(held)
    matrix = sharding.communication_matrix([len(held[p]) for p in order], sharding.shard_sizes(len(items), 16), seed)
    dealt = [[] for _ in range(16)]
    for p, line in zip(order, matrix):
        own = iter(sorted(held[p], key=lambda x: (signed(x, 2), by(x))))
        for k, n in enumerate(line):
            dealt[k] += [next(own) for _ in range(n)]
    buckets = -(-len(items) // (16 * 5))
    want = []
    for k, own in enumerate(dealt):
        own.sort(key=lambda x: ((signed(x, 3) % (1 << 64) >> 20) % buckets, signed(x, 3), by(x)))
        want += [(*x[:3], k, slot) for slot, x in enumerate(own)]
    got = sharding.shuffle_into_shards(docs, seed=seed).collect()
    assert buckets > 1 and Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == Counter(want)


def test_repeated_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_EACH", 20)
    monkeypatch.setattr(sharding, "COPIES", 7)
    df = spark.createDataFrame([(None, "same")] * 300 + [(5, "other")] * 33 + [(i, "t") for i in range(40)], "doc_id long, text string")
    numbered = sharding._numbered(df).collect()
    assert sorted(r["copy"] for r in numbered if r["doc_id"] is None) == list(range(300)) and len(numbered) == 373
    got = sharding.shuffle_into_shards(df).collect()
    shards = Counter(r["shard"] for r in got if r["doc_id"] is None)
    assert len(got) == 373 and len(shards) == 16 and max(shards.values()) <= 24
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s, n in enumerate(sharding.shard_sizes(373, 16)) for k in range(n)]


def test_matrix_has_exact_sums_and_the_right_law():
    rng = random.Random(1)
    rows = [rng.randint(0, 50) for _ in range(40)]
    cols = sharding.shard_sizes(sum(rows), 7)
    m = sharding.communication_matrix(rows, cols, 3)
    assert [sum(x) for x in m] == rows and [sum(x) for x in zip(*m)] == cols
    draws = Counter(sharding.hypergeometric(5, 7, 4, rng) for _ in range(20000))
    from math import comb

    for k in range(5):
        assert abs(draws[k] / 20000 - comb(5, k) * comb(7, 4 - k) / comb(12, 4)) < 0.015
    spread = np.std([sharding.hypergeometric(3000, 5000, 1000, rng) for _ in range(3000)])
    assert abs(spread / (1000 * 3 / 8 * 5 / 8 * 7000 / 7999) ** 0.5 - 1) < 0.05
    large = sharding.communication_matrix([10**9, 2 * 10**9, 5], sharding.shard_sizes(3 * 10**9 + 5, 3), 1)
    assert [sum(x) for x in large] == [10**9, 2 * 10**9, 5] and [sum(x) for x in zip(*large)] == sharding.shard_sizes(3 * 10**9 + 5, 3)
    cells = [sharding.communication_matrix([3, 4, 5], [6, 6], k)[0][0] for k in range(4000)]
    for k in range(4):
        assert abs(cells.count(k) / 4000 - comb(6, k) * comb(6, 3 - k) / comb(12, 3)) < 0.03
    big = [sharding.hypergeometric(10**10, 3 * 10**10, 10**9, rng) for _ in range(20)]
    assert abs(np.mean(big) / 10**9 - 0.25) < 1e-4


# -- decontamination ------------------------------------------------------------------------------


def edits(passage, codes):
    """The fewest edits of passage against any region of a text (its code points)."""
    row, column = np.zeros(len(codes) + 1, np.int64), np.arange(len(codes) + 1)
    for i, x in enumerate(np.frombuffer(passage.encode("utf-32-le"), np.uint32), 1):
        new = np.empty_like(row)
        new[0], new[1:] = i, np.minimum(row[:-1] + (codes != x), row[1:] + 1)
        row = np.minimum.accumulate(new - column) + column
    return row.min()


def slow_match(passage, low):
    """Whether a text as compared has a passage, by full alignment; a short one as whole words."""
    if len(passage) < decontam.SHORT:
        return re.search(r"(?<!(?=\w)[^_])" * passage[0].isalnum() + re.escape(passage) + r"(?!(?=\w)[^_])" * passage[-1].isalnum(), low) is not None
    return edits(passage, np.frombuffer(low.encode("utf-32-le"), np.uint32)) <= decontam.budget(len(passage))


def slow_found(item, low):
    """How many characters of an item passages found by full alignment cover (both as compared)."""
    found, seen = set(), set()
    for at, p in decontam.passages(item):
        if p not in seen and slow_match(p, low):
            found |= set(range(at, at + len(p)))
        seen.add(p)
    return len(found)


def slow_hits(data, items):
    """Pairs that must be found (passages alone cover enough), and those that may (some passage is found
    and the text around can have the rest)."""
    must, may = Counter(), Counter()
    for i, text in data:
        low = decontam.compared(text)
        for k, item in items:
            own = decontam.compared(item)
            n = slow_found(own, low)
            must[(i, k)] += n > 0 and n >= decontam.needed(len(own))
            may[(i, k)] += n > 0
    return +must, +may


def test_decontamination_as_full_alignment_has_it(spark, empty):
    rng = random.Random(6)
    items = [(k, prose(rng, rng.choice(["en", "es"]), rng.randint(8, 60))) for k in range(15)]
    items += [(50, None), (51, ""), (52, "too short"), (53, "Yes"), (54, "a sentence of 29 characters."), (55, "\u0130" * 20), (3, items[3][1]), (None, prose(rng, "de", 30))]
    data = []
    for i in range(120):
        text = prose(rng, "en", rng.randint(0, 120))
        if i % 2:
            s = list(rng.choice(items[:15])[1])
            for _ in range(rng.randint(0, max(1, len(s) // 7))):
                p = rng.randrange(len(s))
                s[p : p + rng.randint(0, 1)] = rng.choice(["", "q", "Z"])
            text = text[: len(text) // 2] + "  " + "".join(s) + "\n" + text[len(text) // 2 :]
        data.append((i, text))
    data += [(200, None), (201, ""), (None, items[0][1]), (202, "the " * 20000), (1, data[1][1])]
    data += [(210, "He said Yes."), (211, "eyes and yest"), (212, "Here is A  sentence of 29\ncharacters. And more."), (213, "see " + "\u0130" * 20 + " there"), (214, "eyes; yes"), (215, "not too shorter"), (216, "x yes" * 9)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.hits(docs, bench).collect()
    must, may = slow_hits(data, items)
    want = Counter((r["doc_id"], r["item_id"]) for r in got)
    assert must <= want <= may and len(must) > 30
    assert {(210, 53), (212, 54), (213, 55), (214, 53)} <= set(want) and not {i for i, _ in want} & {211, 215}
    kept = decontam.drop_contaminated(docs, bench)
    dirty = {i for i, _ in want}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in data if i not in dirty)
    assert decontam.hits(empty, bench).collect() == [] and decontam.hits(docs, bench.where("item_id = 50")).collect() == []


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, prose(rng, "en", 40)) for k in range(6)] + [(9, "short one")]
    data = [(k, "Start. " + t + " end.") for k, t in items] + [(20, prose(rng, "en", 50)), (21, items[0][1] + " " + items[1][1])]
    docs, bench = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontam.hits(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 300)
    monkeypatch.setattr(decontam, "HELD_CHARS", 500)
    monkeypatch.setattr(decontam, "MOST_SHARED", 50)
    assert sorted(map(tuple, decontam.hits(docs, bench).collect())) == whole
    assert {r[:2] for r in whole} == set(slow_hits(data, items)[0])
    assert [r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()] == [20]


def test_recall_of_changed_items():
    """Items with words replaced, and halves of items, each within other text."""
    rng = random.Random(5)
    items = [decontam.compared(prose(rng, "en", rng.randint(14, 60))) for _ in range(200)]
    words, found = [w for t in items for w in t.split()], Counter()
    rows = []
    for k, t in enumerate(items):
        first = dict.fromkeys(p for _, p in decontam.passages(t))
        rows += [(k, k, t if j == 0 else "", t.index(p), p) for j, p in enumerate(first)]
    block = decontam.Block(rows)
    other = lambda: " ".join(rng.choice(words) for _ in range(30))
    for k, t in enumerate(items):
        half = t[: len(t) // 2] if rng.random() < 0.5 else t[len(t) // 2 :]
        changed = {share: " ".join(rng.choice(words) if rng.random() < share else w for w in t.split()) for share in (0.1, 0.2)}
        for name, s in (changed | {"half": half, "none": other()}).items():
            low = f"{other()} {s} {other()}"
            found[name] += k in block.proven(low, decontam.search(block.index, [low])[0])
    assert found[0.1] >= 190 and found[0.2] >= 180 and found["half"] >= 180 and not found["none"], found


#: Turns of phrase that stand in questions and in any text.
PHRASES = (
    "which of the following statements is true", "which of the following is not an example of", "the president of the united states of america", "what is the most likely reason for this",
    "at the end of the nineteenth century", "according to the information in the passage", "as a result of the industrial revolution", "in the first half of the twentieth century",
    "one of the most important characteristics of", "the author of the passage would most likely agree", "a quick brown fox jumps over the lazy dog", "on the other hand it is important to note that",
    "for the purpose of this question assume that", "the government of the united kingdom and", "all of the above answers are correct", "none of the above answers are correct",
    "the secretary general of the united nations", "the second law of thermodynamics states that", "how many of the following are prime numbers", "select the answer that best completes the sentence",
    "the speed of light in a vacuum is constant", "what was the main cause of the first world war", "the chief executive officer of the company", "it has been shown in a number of studies that",
    "this work is licensed under the terms of the",
)


def test_turns_of_phrase_prove_nothing(spark):
    """A hundred documents with a phrase that an item begins, ends or goes on with."""
    rng = random.Random(3)
    tails = [" of cells that take part in photosynthesis in the leaves of most plants?", " when a body of two kilograms slides down a slope of thirty degrees?"]
    items = [(2 * i + k, (p + t if (i + k) % 3 else t.strip("? ") + " " + p + "?").capitalize()) for i, p in enumerate(PHRASES) for k, t in enumerate(tails)]
    items += [(900, "Which of the following statements is true about photosynthesis in green plants?"), (901, "Who was the president of the united states of america in 1850?")]
    docs = [(n, prose(rng, "en", 20) + " " + p + (". Nobody knows. " if n % 2 else " ") + prose(rng, "en", 20)) for n, p in enumerate(PHRASES * 4)]
    docs += [(200, "Which of the following statements is true? Nobody knows."), (201, "The president of the united states of america is coming to dinner.")]
    copies = [(1000 + k, prose(rng, "en", 10) + " " + t + " " + prose(rng, "en", 10)) for k, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"] for r in decontam.hits(spark.createDataFrame(docs + copies, "doc_id long, text string"), bench).collect()}
    assert got == {i for i, _ in copies}


# -- pipeline -------------------------------------------------------------------------------------


def test_pipeline_runs_its_stages_in_order(spark, rows, tmp_path):
    import corpus_pipeline
    from reckon.llm import pii

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontamination", "pii", "byte_bpe"]
    item = prose(random.Random(11), "en", 40)
    own = [*rows, (600, "Some words before. " + item + " Some words after.", "en", "s", 1), (601, "Write to ann@example.org about the orders and the rest of it.", "en", "s", 1)]
    spark.createDataFrame(own, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, str(tmp_path))
        if name != "byte_bpe":
            assert new.columns == docs.columns
            new.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            left.append({r["doc_id"]: r["text"] for r in docs.collect()})
    lang, one, clean, masked = left
    assert not {170, 171, 172, 173} & set(lang) and 600 in one and 600 not in clean
    assert len(set(map(slow_fingerprint, one.values()))) == len(one)
    assert set(one) - set(clean) == {600} and set(masked) == set(clean)
    assert masked[601] == "Write to [EMAIL] about the orders and the rest of it."
    assert all(masked[i] == pii.mask_text(t) for i, t in clean.items())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(map(str, masked))
