"""Quality scores from a generalised additive model with pairwise interactions.

Features of the whole text (shares of kinds of characters, word and line statistics, repetition)
are cut into bins at quantiles. Boosting goes through the features in turn, round after round, and
fits to the current gradient a shallow tree of one feature (up to LEAVES leaves over its bins), whose
leaf values, shrunk, are added to that feature's look-up table. Pairs of features whose residuals
still gain most from a cut of both get tables over both features' bins, boosted in the same way.
A score is the logistic of the intercept plus a table entry for each feature and pair, that is one
vectorised look-up and addition each.

Labels are learned from a bounded sample of SAMPLE labelled documents at most, drawn by a hash.

Defined cases: null and empty texts have all features zero and get that score; without labelled
rows of both kinds all scores are the share of label 1 (0.5 without any); a doc_id with several
labels counts as 1 if half of them are, and one with several texts is learned from once (by the
least of their features); rows with null quality or doc_id are not learned from; repeated rows each
give a row; other columns are not looked at.
"""

from __future__ import annotations


from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.llm.common import map_arrow, remainder

SAMPLE = 12_000
BINS = 24
LEAVES = 4
ROUNDS = 120
PAIRS = 6
PAIR_ROUNDS = 40
RATE = 0.15
SMOOTH = 4.0

FEATURES = (
    "chars", "words", "word_length", "longest_word", "upper", "lower", "digits", "blanks", "symbols", "marks", "commas", "stops",
    "distinct_words", "top_word", "repeat_next", "lines", "line_words", "distinct_lines", "top_line", "bars", "wordless", "non_ascii",
)




def features(text: str | None) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    n, words = len(text), text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    w, k = max(1, len(words)), max(1, len(lines))
    data = text.encode("utf-8", "surrogatepass")
    codes = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digits = int(codes[65:91].sum()), int(codes[97:123].sum()), int(codes[48:58].sum())
    blanks = int(codes[9:14].sum() + codes[32])
    plain = sum(int(codes[ord(c)]) for c in ".,;:'\"()!?-_")
    symbols = int(codes[33:127].sum()) - upper - lower - digits - plain
    count = Counter(words)
    line_count = Counter(lines)
    sizes = list(map(len, words)) or [0]
    alone = int(codes[33]) + int(codes[63])
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), sum(sizes) / w, float(min(max(sizes), 200)), upper / n, lower / n, digits / n, blanks / n,
        symbols / n, alone / n, int(codes[44]) / w, int(codes[46]) / w,
        len(count) / w, max(count.values(), default=0) / w, sum(a == b for a, b in zip(words, words[1:])) / w,
        float(np.log1p(len(lines))), len(words) / k, len(line_count) / k, max(line_count.values(), default=0) / k,
        count.get("|", 0) / w, sum(not x.isalpha() for x in count) / max(1, len(count)), (len(data) - n) / n,
    ]


@dataclass
class Model:
    """cuts: bin limits by feature; tables: additions by bin; pairs: (feature, feature, table)."""

    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1) if self.cuts else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            total += t[b[:, j]]
        for i, j, t in self.pairs:
            total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaves(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values by bin of the best tree of up to `leaves` leaves over ordered bins with gradient sums
    g and weights h: the leaf whose cut gains most is cut, again and again."""
    gain = lambda a, b: a * a / (b + SMOOTH)
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for k, (a, z) in enumerate(parts):
            m = np.arange(a + 1, z)
            if len(m):
                left, right = gain(cg[m] - cg[a], ch[m] - ch[a]), gain(cg[z] - cg[m], ch[z] - ch[m])
                up = left + right - gain(cg[z] - cg[a], ch[z] - ch[a])
                if up.max() > best[0]:
                    best = (up.max(), k, int(m[up.argmax()]))
        if best[1] is None:
            break
        a, z = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], z)]
    out = np.zeros(len(g))
    for a, z in parts:
        out[a:z] = (cg[z] - cg[a]) / (ch[z] - ch[a] + SMOOTH)
    return out


def _pair_values(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of the best tree with a cut of each of two features (four leaves) over a grid."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total_g, total_h = cg[-1, -1], ch[-1, -1]
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    tops = [(a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b)]
    tops.append((total_g - a - tops[1][0] - tops[2][0], total_h - b - tops[1][1] - tops[2][1]))
    gain = sum(x * x / (y + SMOOTH) for x, y in tops)
    if not gain.size:
        return np.zeros(g.shape)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros(g.shape)
    for k, (rows, cols) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        out[rows, cols] = tops[k][0][i, j] / (tops[k][1][i, j] + SMOOTH)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of labels y (0 or 1) from features x."""
    rate = float(y.mean()) if len(y) else 0.5
    if not len(y) or rate in (0.0, 1.0):
        return Model(float(np.log((rate + 1e-6) / (1 - rate + 1e-6))))
    model = Model(float(np.log(rate / (1 - rate))))
    for j in range(x.shape[1]):
        model.cuts.append(np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])))
    b = model.bins(x)
    sizes = [len(c) + 1 for c in model.cuts]
    model.tables = [np.zeros(s) for s in sizes]
    total = np.full(len(y), model.intercept)
    p = lambda: 1 / (1 + np.exp(-total))
    for _ in range(ROUNDS):
        for j, s in enumerate(sizes):
            q = p()
            step = RATE * _leaves(np.bincount(b[:, j], y - q, s), np.bincount(b[:, j], q * (1 - q), s), LEAVES)
            model.tables[j] += step
            total += step[b[:, j]]
    q = p()
    ranked = []
    for i in range(len(sizes)):
        for j in range(i + 1, len(sizes)):
            v, _, _ = _grid(b, i, j, sizes, y - q, q * (1 - q))
            ranked.append((float(((y - q) * v[b[:, i], b[:, j]]).sum()), i, j))
    chosen = [(i, j) for _, i, j in sorted(ranked, reverse=True)[:PAIRS]]
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            q = p()
            v, _, _ = _grid(b, i, j, sizes, y - q, q * (1 - q))
            table += RATE * v
            total += RATE * v[b[:, i], b[:, j]]
    return model


def _grid(b: np.ndarray, i: int, j: int, sizes: list[int], gradient: np.ndarray, weight: np.ndarray):
    cell = b[:, i] * sizes[j] + b[:, j]
    g = np.bincount(cell, gradient, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
    h = np.bincount(cell, weight, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
    return _pair_values(g, h), g, h


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, quality), of which all may be used."""
    own = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    n = own.count()
    if not n:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    picked = own.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 20)) < int(min(1.0, sample / n) * (1 << 20)))
    texts = docs.select(F.col("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")  # about `sample` ids

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "x": [features(t) for t in b.column("text").to_pylist()], "y": b.column("y")})

    one = map_arrow(texts, run, "doc_id long, x array<double>, y int").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    rows = sorted((r["x"], r["y"]) for r in one.collect())  # one for each of the sample's ids
    x = np.array([r for r, _ in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([y for _, y in rows], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of docs (doc_id, text)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in b.column("text").to_pylist()], float)
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": model.score(x)})

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs; learned from the labels of rows
    whose crc32(doc_id as text) mod 3 isn't 1."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    model = train(docs, labels.where(remainder("doc_id", 3) != 1))
    out = score(docs, model)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
