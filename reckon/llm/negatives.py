"""Hard-negative mining by inner product, with a cover tree over norm-augmented candidates.

Components x become floor(256 x); a score is the integer inner product of two rows. An anchor's
positives are its POSITIVES best other rows of its label; its negatives for a positive are the
NEGATIVES best rows of another label whose score lies between LOW and HIGH hundredths of the positive's.

Augmenting each candidate by sqrt(M - |x|^2), with M the largest squared norm, puts all of them on one
sphere, where inner products are distances: q.x = (|q|^2 + M - d^2) / 2. So a ball of radius r around
a centre c at distance d of q has inner products between those at d + r and at d - r.

1. The tree is built on the driver from a bounded sample (SAMPLE rows, those of least hash): a node's
   rows go to centres that are drawn farthest first until none is farther than the node's radius /
   BASE, or there are FAN; a node of few rows is a leaf. It only routes: any tree gives right results.
2. Executors send every row down the tree (to the nearest centre at each level) and measure its
   distance to each centre that it passes. The largest of a node is its covering radius, over all
   rows, so bounds hold for every row. Rows are written by leaf, in files of at most CHUNK rows; a
   leaf with very many rows (equal ones, say) is spread over several tasks.
3. Anchors are grouped by leaf into blocks. A block descends the tree best first: the node with the
   highest bound in any anchor's window comes next. Nodes whose bounds lie outside the windows of all
   anchors, or below the scores that all have found already, are skipped; rows of a leaf are read from
   the shared folder and scored exactly. First for the positives, then for the windows that they give.

Only the tree (at most SAMPLE centres, and a radius and a count of each) is on the driver and in every
task; leaves come one file at a time. Bounds have a margin for rounding, and a node whose bound
equals the last score found is visited, so ties by vec_id are right too. Scores are exact while squared
norms are below 2**53.

Defined cases: rows with a null label or vector, or a null, infinite or NaN component, take no part,
nor do those without a vec_id (no result could name them); shorter vectors count as if filled up with
zeros; rows that repeat a vec_id are rows of their own (an anchor is not its own positive, another
row of that vec_id can be); an anchor without positives, and a positive without negatives, gives no
row; no rows or no anchors give none; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.llm.common import map_arrow, map_batches, shared_dir, through_store

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
SAMPLE = 4096
BASE = 1.6
FAN = 16
#: Rows that a leaf is to have, about; no leaf has fewer than LEAST rows of the sample.
LEAF_ROWS = 512
LEAST = 4
CHUNK = 8192
BLOCK = 128
#: Bytes of leaves that a worker holds.
HELD = 64 << 20
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def prepared(embeddings: DataFrame) -> DataFrame:
    """number, vec_id, label (changed where vec_id is divisible by 7) and x (floors of 256 times the
    components, as doubles) of the rows that take part; kept."""
    x = F.transform("embedding", lambda v: F.floor(256 * v.cast("double")).cast("double"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    some = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    return through_store(some.select(F.monotonically_increasing_id().alias("number"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.alias("x")), "vectors")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of doubles, filled up with zeros."""
    n, sizes = len(column), np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width))
    out[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with one more component, so that each has the squared norm most."""
    return np.hstack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a to each of b."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, d))


# -- the tree -------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Centres (augmented) by node, children by node (none for a leaf), covering radii and rows."""

    most: float
    centres: np.ndarray
    children: list[list[int]]
    radii: np.ndarray
    rows: np.ndarray

    @property
    def width(self) -> int:
        return self.centres.shape[1] - 1

    def paths(self, x: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(node, rows of x, their distances to its centre) of each node that rows pass."""
        a, out = augmented(x, self.most), []
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            out.append((node, own, distances(a[own], self.centres[node : node + 1])[:, 0]))
            if kids := self.children[node]:
                nearest = distances(a[own], self.centres[kids]).argmin(1)
                todo += [(kid, own[nearest == k]) for k, kid in enumerate(kids) if (nearest == k).any()]
        return out

    def bounds(self, q: np.ndarray, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The least and the highest inner product that each row of q can have with rows of each node."""
        half = ((q * q).sum(1)[:, None] + self.most) / 2
        d = distances(np.hstack([q, np.zeros((len(q), 1))]), self.centres[nodes])
        r, slack = self.radii[nodes][None, :], 1 + 1e-9 * half
        return half - (d + r) ** 2 / 2 - slack, half - np.maximum(0.0, d - r) ** 2 / 2 + slack


def build(sample: np.ndarray, most: float, leaf: int) -> Tree:
    """A tree of the rows of sample; leaves have at most `leaf` of them, or rows that are all equal."""
    a = augmented(sample, most)
    centres, children = [], []

    def grow(own: np.ndarray, centre: int) -> int:
        node = len(centres)
        centres.append(a[centre])
        children.append([])
        d = distances(a[own], a[centre : centre + 1])[:, 0] if len(own) else np.zeros(0)
        if len(own) <= leaf or d.max() <= 1e-6:
            return node
        heads, near, which = [centre], d, np.zeros(len(own), np.int64)
        while len(heads) < FAN and near.max() > d.max() / BASE:
            heads.append(int(own[near.argmax()]))
            new = distances(a[own], a[heads[-1] : heads[-1] + 1])[:, 0]
            which[new < near] = len(heads) - 1
            near = np.minimum(near, new)
        kids = [(h, own[which == k]) for k, h in enumerate(heads) if (which == k).any()]
        if len(kids) > 1:
            children[node] = [grow(rows, h) for h, rows in kids]
        return node

    # the root is the row nearest to the middle
    grow(np.arange(len(a)), int(distances(a, a.mean(0, keepdims=True)).argmin()))
    return Tree(most, np.array(centres), children, np.zeros(len(centres)), np.zeros(len(centres), np.int64))


def fit(rows: DataFrame) -> tuple[Tree, DataFrame] | None:
    """The tree of rows (as `prepared` gives them), with radii over all of them, and rows with leaf
    (kept); None if there are none."""
    norm = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v * v)
    n, most, width = rows.agg(F.count("*"), F.max(norm), F.max(F.size("x"))).first()
    if not n:
        return None
    drawn = rows.select("x", F.xxhash64("vec_id", "number").alias("h")).orderBy("h").limit(SAMPLE).toArrow()  # at most SAMPLE rows
    sample = matrix(drawn.column("x").combine_chunks(), width)
    tree = build(sample, float(most), max(LEAST, LEAF_ROWS * len(sample) // n))

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        leaf = np.zeros(b.num_rows, np.int32)
        for node, own, _ in tree.paths(matrix(b.column("x"), width)):
            if not tree.children[node]:
                leaf[own] = node
        return b.append_column("leaf", pa.array(leaf))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius, n = np.zeros(len(tree.centres)), np.zeros(len(tree.centres), np.int64)
        for b in batches:
            for node, own, d in tree.paths(matrix(b.column("x"), width)):
                radius[node] = max(radius[node], d.max())
                n[node] += len(own)
        used = np.nonzero(n)[0]
        yield pa.RecordBatch.from_pydict({"node": used.astype(np.int32), "radius": radius[used], "n": n[used]})

    placed = through_store(map_arrow(rows, place, "number long, vec_id long, label long, x array<double>, leaf int"), "vectors-by-leaf")
    of_task = map_batches(rows.select("x"), measure, "node int, radius double, n long")
    for r in of_task.groupBy("node").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect():  # a row a node
        tree.radii[r["node"]], tree.rows[r["node"]] = r["radius"] * (1 + 1e-9) + 1e-6, r["n"]
    return tree, placed


def write_leaves(tree: Tree, placed: DataFrame) -> str:
    """The path of the rows by leaf, in files of at most CHUNK rows."""
    parts = F.split(F.lit(",".join(str(-(-int(n) // CHUNK) or 1) for n in tree.rows)), ",").cast("array<int>")
    salt = F.pmod(F.xxhash64("number"), F.get(parts, F.col("leaf")))
    path = shared_dir(placed.sparkSession, "leaves")
    spread = placed.withColumn("salt", salt).repartition("leaf", "salt").drop("salt")
    spread.write.option("maxRecordsPerFile", CHUNK).partitionBy("leaf").parquet(path)
    return path


class Leaves:
    """Rows of leaves from the shared folder, the last HELD bytes of them in memory."""

    def __init__(self, path: str, width: int):
        self.store, self.at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))
        self.width, self.held, self.size = width, OrderedDict(), 0
        self.files: dict[int, list[str]] = {}

    def of(self, leaf: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(number, vec_id, label, x) of each file of a leaf."""
        if leaf not in self.files:
            found = self.store.get_file_info(fs.FileSelector(f"{self.at}/leaf={leaf}", allow_not_found=True))
            self.files[leaf] = sorted(f.path for f in found if f.base_name.endswith(".parquet"))
        for path in self.files[leaf]:
            if path not in self.held:
                t = pq.ParquetFile(self.store.open_input_file(path)).read().combine_chunks()
                own = (*(t.column(c).to_numpy() for c in ("number", "vec_id", "label")), matrix(t.column("x").combine_chunks(), self.width))
                self.held[path] = own
                self.size += own[3].nbytes
                while self.size > HELD and len(self.held) > 1:
                    self.size -= self.held.popitem(last=False)[1][3].nbytes
            else:
                self.held.move_to_end(path)
            yield self.held[path]


# -- search ---------------------------------------------------------------------------------------


class Best:
    """The k best rows of each of several windows: score downwards, then vec_id, then number."""

    def __init__(self, windows: int, k: int):
        self.k = k
        self.score, self.id, self.number = np.full((windows, k), -np.inf), np.zeros((windows, k), np.int64), np.zeros((windows, k), np.int64)

    @property
    def last(self) -> np.ndarray:
        return self.score[:, -1]

    def take(self, window: np.ndarray, score: np.ndarray, vec_id: np.ndarray, number: np.ndarray) -> None:
        """Rows found, in any order; window numbers may repeat."""
        if not len(window):
            return
        own = np.unique(window)
        k = self.k
        all_w = np.concatenate([np.repeat(own, k), window])
        cols = [np.concatenate([old[own].ravel(), new]) for old, new in ((self.score, score), (self.id, vec_id), (self.number, number))]
        order = np.lexsort((cols[2], cols[1], -cols[0], all_w))
        w = all_w[order]
        first = np.searchsorted(w, own)
        pick = order[first[:, None] + np.arange(k)]
        self.score[own], self.id[own], self.number[own] = (c[pick] for c in cols)


def descend(tree: Tree, leaves: Leaves, q: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, best: Best, allowed) -> int:
    """Fills best with the rows of each window: window w is of the anchor of[w] (a row of q) and takes
    scores from low[w] to high[w]. allowed(label, number) tells which rows each anchor may take.
    Returns how many rows were scored (for each anchor)."""
    scored = 0

    def wanted(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Windows to which a node can still give rows."""
        return (most[of] >= np.maximum(low, best.last)) & (least[of] <= high)

    def push(nodes: list[int]) -> None:
        least, most = tree.bounds(q, nodes)
        for i, node in enumerate(nodes):
            if tree.rows[node] and (w := wanted(least[:, i], most[:, i])).any():
                heapq.heappush(heap, (-float(np.minimum(most[of][w, i], high[w]).max()), node, least[:, i], most[:, i]))

    heap: list = []
    push([0])
    while heap:
        _, node, least, most = heapq.heappop(heap)
        w = np.nonzero(wanted(least, most))[0]
        if not len(w):
            continue
        if tree.children[node]:
            push(tree.children[node])
            continue
        anchors, row = np.unique(of[w], return_inverse=True)
        for number, vec_id, label, x in leaves.of(node):
            s = q[anchors] @ x.T
            s[~allowed(anchors, label, number)] = -np.inf
            scored += s.size
            own = s[row]
            hit, at = np.nonzero((own >= np.maximum(low, best.last)[w, None]) & (own <= high[w, None]) & (own > -np.inf))
            best.take(w[hit], own[hit, at], vec_id[at], number[at])
    return scored


def mine_block(tree: Tree, leaves: Leaves, number: np.ndarray, vec_id: np.ndarray, label: np.ndarray, q: np.ndarray) -> tuple[list[tuple], int]:
    """Result rows of a block of anchors, and how many rows were scored."""
    n = len(q)
    found = Best(n, POSITIVES)
    none, all_of = np.full(n, -np.inf), np.arange(n)
    scored = descend(tree, leaves, q, all_of, none, -none, found, lambda a, y, m: (y[None, :] == label[a][:, None]) & (m[None, :] != number[a][:, None]))
    of, j = np.nonzero(found.score > -np.inf)
    p = found.score[of, j]
    negatives = Best(len(of), NEGATIVES)
    # 100 s between LOW p and HIGH p, in whole numbers
    low, high = np.ceil(LOW * p / 100), np.floor(HIGH * p / 100)
    if len(of):
        scored += descend(tree, leaves, q, of, low, high, negatives, lambda a, y, m: y[None, :] != label[a][:, None])
    out = []
    for w, k in zip(*np.nonzero(negatives.score > -np.inf)):
        out.append((int(vec_id[of[w]]), int(found.id[of[w], j[w]]), int(k) + 1, int(negatives.id[w, k]), int(p[w]), int(negatives.score[w, k])))
    return out, scored


def mine(embeddings: DataFrame, anchors_every: int = 50) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, for the anchors
    (rows whose vec_id is divisible by anchors_every) of embeddings (vec_id, embedding, label)."""
    rows = prepared(embeddings)
    fitted = fit(rows)
    if fitted is None:
        return embeddings.sparkSession.createDataFrame([], _RESULT)
    tree, placed = fitted
    path = write_leaves(tree, placed)
    names = [x.split()[0] for x in _RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = Leaves(path, tree.width)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                b = batch.slice(a, BLOCK)
                x = matrix(pa.array(b.column("x").to_pylist(), pa.list_(pa.float64())), tree.width)
                out, _ = mine_block(tree, leaves, *(b.column(c).to_numpy() for c in ("number", "vec_id", "label")), x)
                if out:
                    yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out], kind) for i, (c, kind) in enumerate(zip(names, kinds))})

    anchors = placed.where(F.col("vec_id") % anchors_every == 0)
    n = anchors.count()
    # anchors of a leaf, and of leaves beside each other, come into one block
    near = anchors.repartitionByRange(max(1, -(-n // BLOCK)), "leaf", "vec_id", "number").sortWithinPartitions("leaf", "vec_id", "number")
    return map_batches(near, run, _RESULT)
