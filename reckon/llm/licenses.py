"""Licence scans: a trained paragraph classifier with template comparison.

Training (driver, fixed size): a sparse multinomial logistic regression over word 1- and 2-grams. Its
examples are the paragraphs in licence_texts: notices and full texts of licence families, short notices
made of names and forms (NAMES, FORMS), and for the class `unknown` those of other licences and prose (contracts, terms of service, talk about licences).
Weights are driven to zero by soft thresholding. Probabilities are calibrated, by a temperature and a
bias of the class unknown, on folds left out of training: variants of the families' paragraphs, and
other licences as a whole; below CONFIDENT a paragraph is unknown. The winning family is confirmed by template
comparison: n-grams weigh by in how few families they stand, and the paragraph must share COVERED of
the weight of one of the family's templates (it holds the template), or COVERED of its own weight and
at least LEAST with one (it is a piece of it). So words that all licences share confirm nothing.

Scanning (JVM only, no shuffle of n-grams): every text is cut into blocks between blank lines, and
blocks into lines; each line, and each block of several lines as a whole (notices are often wrapped),
is a paragraph. Hashes of its n-grams (within lines) are looked up in literal arrays (two tables, each
entry at one of two places), weights and shared weights are summed within the row, and only
paragraphs of a family go on to be counted by document.

Defined cases: null and empty texts have no paragraph and no family; rows that repeat doc_id and text
give the same result once each; a null doc_id is carried; a block counts a family once, whether it
is found in the block, in one of its lines or in several; other columns are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from importlib import resources

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckon.llm.common import through_store

UNKNOWN = "unknown"
CONFIDENT = 0.5
COVERED = 0.6
#: Least weight that a piece of a template must share with it (a rare n-gram weighs about 2).
LEAST = 8.0
#: n-grams below this weight are in too many families to tell anything.
TELLING = 0.5
ROUNDS = 120
SPARSE = 5e-5
#: Of paragraphs with more n-grams, pairs are learned only if another paragraph has them.
PAIRS_OF = 60
FOLDS = 2
#: What a short notice counts beside a paragraph; there are many of them.
NOTICE = 0.3

_WORDS = re.compile(r"[^a-z0-9]+")


def words(text: str) -> list[str]:
    return [w for w in _WORDS.split(text.lower()) if w]


def ngrams(text: str) -> set[str]:
    """Words and pairs of neighbours; a pair doesn't reach over the end of a line."""
    found: set[str] = set()
    for line in text.split("\n"):
        w = words(line)
        found.update(w, (f"{a} {b}" for a, b in zip(w, w[1:])))
    return found


def gram_hash(gram: str) -> int:
    """The hash that xxhash64(word) or xxhash64(word, next) has in Spark."""
    h = 42
    for w in gram.split(" "):
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h


@lru_cache(maxsize=1)
def paragraphs_of() -> dict[str, list[str]]:
    """Paragraphs by family, of _other_licences and of _prose."""
    folder = resources.files(__package__) / "licence_texts"
    files = sorted((f for f in folder.iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return {f.name[:-4]: [p for p in f.read_text(encoding="utf-8").split("\n\n") if p.strip()] for f in files}


# Names and identifiers of licences, as short notices have them.
NAMES = {
    "mit": ("MIT", "MIT License", "Expat License"),
    "apache-2.0": ("Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 license"),
    "bsd": ("BSD-3-Clause", "BSD-2-Clause", "BSD License", "3-clause BSD license", "New BSD License", "Simplified BSD License"),
    "bsl-1.0": ("BSL-1.0", "Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "gpl": ("GPL-3.0", "GPL-2.0", "GPL-3.0-or-later", "GPL-2.0-only", "GPLv3", "GPLv2", "GNU GPL v3", "GNU General Public License v3.0", "GNU General Public License version 2"),
    "lgpl": ("LGPL-2.1", "LGPL-3.0", "LGPL-3.0-or-later", "LGPLv3", "GNU LGPL v2.1", "GNU Lesser General Public License v3.0", "GNU Lesser General Public License version 2.1"),
    "agpl": ("AGPL-3.0", "AGPL-3.0-or-later", "AGPLv3", "GNU AGPL v3", "GNU Affero General Public License v3.0", "GNU Affero General Public License version 3"),
    "mpl-2.0": ("MPL-2.0", "MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "epl-2.0": ("EPL-2.0", "EPL 2.0", "Eclipse Public License 2.0", "Eclipse Public License, version 2.0"),
    "isc": ("ISC", "ISC License"),
    "zlib": ("Zlib", "zlib License", "zlib/libpng License"),
    "unlicense": ("Unlicense", "The Unlicense"),
    "cc0": ("CC0-1.0", "CC0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
    "cc-by": ("CC-BY-4.0", "CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-3.0"),
    "cc-by-sa": ("CC-BY-SA-4.0", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-3.0"),
    "cc-by-nc": ("CC-BY-NC-4.0", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-3.0"),
}
OTHER_NAMES = (
    "CDDL-1.0", "Common Development and Distribution License 1.1", "Artistic-2.0", "Artistic License 2.0", "EUPL-1.2", "European Union Public Licence 1.2", "OFL-1.1", "SIL Open Font License 1.1",
    "MS-PL", "Microsoft Public License", "SSPL-1.0", "Server Side Public License", "CPL-1.0", "Common Public License 1.0", "Sleepycat", "Sleepycat License", "QPL-1.0", "Q Public License", "WTFPL",
    "PostgreSQL License", "PostgreSQL", "Python-2.0", "Python Software Foundation License", "OpenSSL", "OpenSSL License", "AFL-3.0", "Academic Free License 3.0", "Ruby License", "Vim License",
    "PHP-3.01", "PHP License 3.01", "IPL-1.0", "IBM Public License 1.0", "OSL-3.0", "Open Software License 3.0", "ECL-2.0", "Educational Community License 2.0", "NCSA", "Elastic License 2.0",
    "Business Source License 1.1", "BUSL-1.1", "Open Data Commons Open Database License", "ODbL-1.0", "Commercial License", "Enterprise License 2.0", "Nokia Open Source License", "Sun Public License 1.0",
)
#: Short notices, as they are written about any licence.
FORMS = (
    "Licensed under {}.", "Licensed under the {}.", "License: {}", "SPDX-License-Identifier: {}", "This project is licensed under the {}.", "Released under the {}.", "Distributed under the {}.",
    "This software is released under the terms of the {}.", "@license {}", "Code is available under the {}, see the LICENSE file.", "The source code is licensed {}.", "Published under {}.",
)


def notices(forms: tuple[str, ...] = FORMS) -> dict[str, list[str]]:
    """Short notices by family, and of _other_licences."""
    own = {family: [f.format(n) for n in names for f in forms] for family, names in NAMES.items()}
    return own | {"_other_licences": [f.format(n) for n in OTHER_NAMES for f in forms]}


def examples(forms: tuple[str, ...] = FORMS) -> dict[str, list[str]]:
    """What is learned from: the paragraphs in licence_texts, and short notices."""
    more = notices(forms)
    return {family: own + more.get(family, []) for family, own in paragraphs_of().items()}


def variants(paragraph: str) -> list[str]:
    """A paragraph, its beginning and end, as they stand in texts that wrap or shorten it, and the
    whole with each fifth word lost."""
    w = paragraph.split()
    if len(w) < 12:
        return [paragraph, "Note: " + paragraph]
    return [paragraph, " ".join(w[: 3 * len(w) // 5]), " ".join(w[2 * len(w) // 5 :]), " ".join(x for i, x in enumerate(w) if i % 5 != 2)]


@dataclass(frozen=True)
class Classifier:
    """weights: by n-gram, for each family (calibrated; the last is unknown); idf: n-grams' weights
    in comparisons; templates: (family's index, n-grams)."""

    families: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    intercepts: tuple[float, ...]
    idf: dict[str, float]
    rare: float
    templates: tuple[tuple[int, frozenset[str]], ...]


class _Rows:
    """Sparse rows of ones: columns by row, and products with dense matrices."""

    def __init__(self, rows: list[list[int]]):
        sizes = np.array([len(r) for r in rows])
        self.columns = np.concatenate([np.array(r, np.int64) for r in rows])
        self.starts = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(rows)), sizes)
        self.order = np.argsort(self.columns, kind="stable")
        self.used, self.column_starts = np.unique(self.columns[self.order], return_index=True)

    def times(self, m: np.ndarray) -> np.ndarray:
        return np.add.reduceat(m[self.columns], self.starts, axis=0)

    def transposed_times(self, m: np.ndarray, out: np.ndarray) -> np.ndarray:
        out[self.used] = np.add.reduceat(m[self.owner[self.order]], self.column_starts, axis=0)
        return out


def _fit(rows: list[list[int]], y: np.ndarray, counts: np.ndarray, columns: int, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts by proximal gradient steps with momentum."""
    x, one = _Rows(rows), np.eye(k, dtype=np.float32)[y]
    share = counts * (1 / np.bincount(y, counts, k).clip(1))[y] ** 0.5  # rare families count for more
    share = (share / share.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((columns, k), np.float32), np.zeros(k, np.float32)
    v, last, gradient = w.copy(), w.copy(), np.zeros_like(w)
    step = 1.0
    for t in range(rounds):
        z = x.times(v) + b
        q = np.exp(z - z.max(1, keepdims=True))
        d = (one - q / q.sum(1, keepdims=True)) * share
        if t == 0:  # the largest curvature, by a few power steps
            u = np.random.default_rng(1).random((columns, 1), np.float32)
            for _ in range(8):
                u = x.transposed_times(x.times(u) * share, np.zeros_like(u))
                size = float(np.linalg.norm(u))
                u /= size
            step = 2.0 / size
        w = v + step * x.transposed_times(d, gradient)
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * SPARSE)
        b = b + step * d.sum(0)
        v, last = w + t / (t + 3) * (w - last), w
    return w, b


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The temperature and the bias of the last class with the least loss."""

    def loss(t: float, bias: float) -> float:
        s = z / t
        s[:, -1] += bias
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), y]))

    return min(((0.1 * 1.25**i, 0.5 * j) for i in range(16) for j in range(-4, 9)), key=lambda x: loss(*x))


def train(texts: dict[str, list[str]]) -> Classifier:
    """A classifier of paragraphs by family; names that begin with _ are examples of unknown."""
    names = [f for f in texts if not f.startswith("_")]
    families = (*names, UNKNOWN)
    x, y, fold, counts = [], [], [], []
    short = {n for own in notices().values() for n in own}
    for family, own in texts.items():
        for i, p in enumerate(own):
            for j, v in enumerate(variants(p)):
                counts.append(NOTICE if p in short else 1.0)
                x.append(ngrams(v))
                y.append(families.index(family if family in names else UNKNOWN))
                # known paragraphs are left out as variants, other licences in runs, so as a whole
                fold.append((i + j) % FOLDS if family in names else i * FOLDS // len(own) if family == "_other_licences" else i % FOLDS)
    prose = texts.get("_prose", [])
    for i in range(0, len(prose), 3):  # long texts, of which each word is there once
        x.append(set().union(*(ngrams(p) for p in prose[i : i + 20])))
        y.append(len(names))
        counts.append(1.0)
        fold.append(i % FOLDS)
    # pairs that stand in a single long paragraph tell no more than their words
    kept, once = set(), set()
    for own in texts.values():
        for p in own:
            grams = ngrams(p)
            kept |= {g for g in grams if " " not in g or g in once or len(grams) <= PAIRS_OF}
            once |= grams
    x = [grams & kept for grams in x]
    column = {g: i for i, g in enumerate(sorted(set().union(*x)))}
    rows, target, fold, counts = [sorted(column[g] for g in grams) for grams in x], np.array(y), np.array(fold), np.array(counts, np.float32)
    z = np.zeros((len(x), len(families)))
    for f in range(FOLDS):
        own = np.nonzero(fold != f)[0]
        w, b = _fit([rows[i] for i in own], target[own], counts[own], len(column), len(families), ROUNDS // 2)
        out = np.nonzero(fold == f)[0]
        if len(out):
            z[out] = _Rows([rows[i] for i in out]).times(w) + b
    temperature, bias = _calibrated(z, target)
    w, b = _fit(rows, target, counts, len(column), len(families), ROUNDS)
    b = b.astype(float) / temperature
    b[-1] += bias
    weights = {g: tuple((w[i].astype(float) / temperature).round(2).tolist()) for g, i in column.items() if np.abs(w[i]).max() > 1e-5}
    seen: dict[str, set[str]] = {}
    for family, own in texts.items():
        for p in own:
            for g in ngrams(p) & kept:
                seen.setdefault(g, set()).add(family)
    idf = {g: round(float(np.log((len(texts) + 1) / (len(fs) + 0.5))), 3) for g, fs in seen.items()}
    templates = tuple((k, frozenset(ngrams(p) & kept)) for k, family in enumerate(names) for p in texts[family])
    return Classifier(families, weights, tuple(b.round(5).tolist()), idf, round(float(np.log((len(texts) + 1) / 1.5)), 3), templates)


@lru_cache(maxsize=1)
def classifier() -> Classifier:
    return train(examples())


def classify(paragraph: str, m: Classifier | None = None) -> tuple[str, float, bool]:
    """Family, calibrated probability and confirmation of one paragraph, by sets and sums of plain
    Python (the brute-force version in tests)."""
    m = m or classifier()
    grams = ngrams(paragraph)
    z = list(m.intercepts)
    for g in grams:
        for k, w in enumerate(m.weights.get(g, ())):
            z[k] += w
    top = max(z)
    p = 1 / sum(np.exp(v - top) for v in z)
    k = z.index(top)
    if m.families[k] == UNKNOWN or p < CONFIDENT:
        return UNKNOWN, float(p), False
    telling = lambda gs: sum(v for g in gs if (v := m.idf.get(g, 0.0)) >= TELLING)
    # a word of no example counts for itself and for a pair
    whole, confirmed = telling(grams) + 2 * m.rare * sum(w not in m.idf for w in words(paragraph)), False
    for family, template in m.templates:
        if family == k:
            shared = telling(grams & template)
            confirmed |= shared > 0 and (shared >= COVERED * telling(template) or (shared >= LEAST and shared >= COVERED * whole))
    return m.families[k], float(p), confirmed


# -- the scan -------------------------------------------------------------------------------------


def _numbers(values, kind: str) -> Column:
    """A literal array, made once from one text (the optimizer folds it)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


@dataclass(frozen=True)
class _Tables:
    """The classifier as arrays. Entries are numbered from 1, telling ones (of any weight) first."""

    mask: int
    hashes: tuple[tuple[int, ...], tuple[int, ...]]
    entries: tuple[tuple[int, ...], tuple[int, ...]]
    strong: int
    weights: tuple[float, ...]
    idf: tuple[float, ...]
    template_entries: tuple[int, ...]
    first: tuple[int, ...]
    size: tuple[int, ...]
    total: tuple[float, ...]
    families: tuple[tuple[int, int], ...]


def _two_places(hashes: list[int], bits: int) -> list[dict[int, int]] | None:
    """Each hash at the place of its low bits in one table or of its bits from the 33rd in the other."""
    mask, tables = (1 << bits) - 1, [{}, {}]
    for i in range(len(hashes)):
        item, side = i, 0
        for _ in range(500):
            place = (hashes[item] >> (32 * side)) & mask
            item, tables[side][place] = tables[side].get(place, -1), item
            if item < 0:
                break
            side = 1 - side
        else:
            return None
    return tables


@lru_cache(maxsize=1)
def _tables() -> _Tables:
    m = classifier()
    k = len(m.families)
    used = lambda g: g in m.weights or m.idf.get(g, 0.0) >= TELLING
    grams = sorted(set(m.weights) | set(m.idf), key=lambda g: (not used(g), g))
    entry = {g: i for i, g in enumerate(grams, 1)}
    strong = sum(map(used, grams))
    hashes = [gram_hash(g) for g in grams]
    bits = max(8, int(np.ceil(np.log2(len(grams) * 1.5))))
    while (places := _two_places(hashes, bits)) is None:
        bits += 1
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    sides = []
    for t in places:
        h, e = [0] * (1 << bits), [0] * (1 << bits)
        for place, i in t.items():
            h[place], e[place] = signed(hashes[i]), i + 1
        sides.append((tuple(h), tuple(e)))
    zero = (0.0,) * k
    idf = [v if (v := m.idf.get(g, 0.0)) >= TELLING else 0.0 for g in grams[:strong]]
    order = sorted(range(len(m.templates)), key=lambda i: m.templates[i][0])
    lists = [sorted(e for g in m.templates[i][1] if (e := entry[g]) <= strong and idf[e - 1]) for i in order]
    of = [m.templates[i][0] for i in order]
    return _Tables(
        (1 << bits) - 1, (sides[0][0], sides[1][0]), (sides[0][1], sides[1][1]), strong,
        tuple(x for g in grams[:strong] for x in m.weights.get(g, zero)), tuple(idf),
        tuple(e for x in lists for e in x), tuple(np.cumsum([0, *map(len, lists)])[:-1].tolist()), tuple(map(len, lists)),
        tuple(round(sum(idf[e - 1] for e in x), 6) for x in lists), tuple((of.index(f), len(of) - 1 - of[::-1].index(f)) for f in range(k - 1)),
    )


def _entry(t: _Tables):
    """The entry of an n-gram's hash, as a function of columns; 0 if it has none."""
    mask = F.lit(t.mask).cast("long")
    hashes, entries = [_numbers(x, "bigint") for x in t.hashes], [_numbers(x, "int") for x in t.entries]

    def of(h: Column) -> Column:
        a, b = h.bitwiseAND(mask).cast("int"), F.shiftrightunsigned(h, 32).bitwiseAND(mask).cast("int")
        return F.when(F.get(hashes[0], a) == h, F.get(entries[0], a)).when(F.get(hashes[1], b) == h, F.get(entries[1], b)).otherwise(F.lit(0))

    return of


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, block (its number), line (its number in the block; -1 for a block of
    several lines), e (entries of its n-grams) and n (how many of its words are in no example)."""
    t = _tables()
    entry = _entry(t)
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", r"\n[ \t\r]*\n")).alias("block", "body"))
    ids = ["doc_id", "text_hash", "block"]
    # each step works on all lines of a block; arrays within arrays, so that nothing is shuffled
    lines = cut.select(*ids, F.transform(F.split(F.lower("body"), r"\n"), lambda x: F.filter(F.split(x, "[^a-z0-9]+"), lambda w: w != "")).alias("w"))
    lines = lines.withColumn("one", F.transform("w", lambda ws: F.transform(ws, lambda x: entry(F.xxhash64(x)))))
    # a pair can have an entry only if both its words have
    two = F.zip_with("w", "one", lambda ws, es: F.transform(ws, lambda x, i: F.when((F.get(es, i) > 0) & (F.get(es, i + 1) > 0), entry(F.xxhash64(x, F.get(ws, i + 1)))).otherwise(F.lit(0))))
    lines = lines.withColumn("two", two)
    strong = lambda es: F.filter(es, lambda x: (x > 0) & (x <= t.strong))
    each = F.zip_with("one", "two", lambda a, b: F.struct(F.array_distinct(strong(F.concat(a, b))).alias("e"), F.size(F.filter(a, lambda x: x == 0)).alias("n")))
    lines = lines.select(*ids, each.alias("each"))
    whole = F.struct(F.array_distinct(F.flatten(F.transform("each", lambda x: x["e"]))).alias("e"), F.aggregate("each", F.lit(0), lambda acc, x: acc + x["n"]).alias("n"))
    own = F.concat(F.array(F.when(F.size("each") > 1, whole)), F.col("each"))
    return lines.select(*ids, F.posexplode(own).alias("line", "own")).where("size(own.e) > 0").select(*ids, (F.col("line") - 1).alias("line"), "own.e", "own.n")


def scan_paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, block, line, family, probability and confirmed of every paragraph but those
    that no family can have: the sum of each n-gram's best lead over unknown doesn't reach CONFIDENT."""
    m, t = classifier(), _tables()
    k = len(m.families)
    leads = [max(0.0, max(t.weights[i : i + k - 1]) - t.weights[i + k - 1]) for i in range(0, len(t.weights), k)]
    need = float(np.log(CONFIDENT / (1 - CONFIDENT))) + m.intercepts[-1] - max(m.intercepts[:-1]) - 1e-6
    lead = _numbers([0, *(round(x, 3) for x in leads)], "double")
    rows = paragraphs(docs).where(F.aggregate("e", F.lit(0.0), lambda acc, x: acc + F.get(lead, x)) >= need)

    def logit(c: int) -> Column:
        own = _numbers([0, *(round(100 * w) for w in t.weights[c::k])], "int")  # hundredths
        return F.aggregate("e", F.lit(0), lambda acc, x: acc + F.get(own, x)) / 100 + F.lit(m.intercepts[c])

    z = F.array(*map(logit, range(k)))
    rows = rows.withColumn("z", z).withColumn("top", F.array_max("z"))
    rows = rows.withColumn("probability", 1 / F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("top"))))
    rows = rows.withColumn("winner", F.array_position("z", F.col("top")).cast("int") - 1)
    found = (F.col("winner") < k - 1) & (F.col("probability") >= CONFIDENT)
    # template comparison, of the winner's templates only
    idf, ids = _numbers([0, *t.idf], "double"), _numbers(t.template_entries, "int")
    first, size, total = _numbers(t.first, "int"), _numbers(t.size, "int"), _numbers(t.total, "double")
    low, high = (_numbers([x[i] for x in t.families], "int") for i in (0, 1))
    weigh = lambda es: F.aggregate(es, F.lit(0.0), lambda acc, x: acc + F.get(idf, x))
    rows = rows.withColumn("whole", F.when(found, 2 * F.col("n") * m.rare + weigh(F.col("e"))))
    shared = F.transform(F.sequence(F.get(low, F.col("winner")), F.get(high, F.col("winner"))), lambda i: F.struct(
        weigh(F.array_intersect("e", F.slice(ids, F.get(first, i) + 1, F.get(size, i)))).alias("s"), F.get(total, i).alias("t")))
    rows = rows.withColumn("shared", F.when(found, shared))
    agrees = F.exists("shared", lambda x: (x["s"] > 0) & ((x["s"] >= x["t"] * COVERED) | ((x["s"] >= LEAST) & (x["s"] >= F.col("whole") * COVERED))))
    family = F.when(found, F.element_at(F.lit(list(m.families)), F.col("winner") + 1)).otherwise(UNKNOWN)
    return rows.select("doc_id", "text_hash", "block", "line", family.alias("family"), "probability", F.when(found, agrees).otherwise(F.lit(False)).alias("confirmed"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, families (confirmed, in alphabetical order, comma-joined), n_confirmed and
    n_unconfirmed (blocks by family), and score (highest probability of a confirmed paragraph, else
    0) of each row of docs (doc_id, text). A block that confirms a family isn't counted as
    unconfirmed for it."""
    # kept: a job of one stage for the plan that holds the arrays, small plans for the rest
    found = through_store(scan_paragraphs(docs).where(F.col("family") != UNKNOWN), "licence-paragraphs")
    blocks = found.groupBy("doc_id", "text_hash", "block", "family").agg(
        F.max("confirmed").alias("confirmed"), F.max(F.when(F.col("confirmed"), F.round("probability", 6))).alias("score")
    )
    by_doc = blocks.groupBy("doc_id", "text_hash").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.sum(F.col("confirmed").cast("long")).alias("n_confirmed"), F.sum((~F.col("confirmed")).cast("long")).alias("n_unconfirmed"),
        F.max("score").alias("score"),
    )
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    a, b = base.alias("a"), by_doc.alias("b")
    out = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")), "left")
    zero = lambda c, v: F.coalesce(F.col(f"b.{c}"), F.lit(v)).alias(c)
    return out.select("a.doc_id", zero("families", ""), zero("n_confirmed", 0), zero("n_unconfirmed", 0), zero("score", 0.0))
