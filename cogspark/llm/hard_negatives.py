"""Hard negatives by a multiway hyperplane tree with distance ranges between siblings.

The tree is fitted on a bounded sample: a node has a few split points far from each other, and a row belongs to the
nearest one's subtree. Then every row is indexed: Spark sends each one to its leaf, and for each split point and each
sibling subtree the least and the largest distance, and the range of lengths, are taken over all rows.

A window of inner products [low, high] is an annulus around the anchor, as |a - x|^2 = |a|^2 + |x|^2 - 2 a.x. A subtree
is eliminated if for any split point the distances that its range allows do not meet the annulus. Anchors go to the
leaves that are left, leaves being searched whole and exactly, cut into chunks so that a hot leaf is many tasks.

Two searches: the positives of an anchor (window from the k-th best score of its label in the sample on), then for each
positive the negatives (window from `least` to `most` of the positive's score, its lower end raised to the k-th best
that the sample has inside it).

Defined cases: rows without id or label, or whose vector is null or holds null or non-finite components, take no part;
shorter vectors count as ending in zeros; an id with several different rows is one anchor, by its least label and
vector; rows with the anchor's id are neither its positives nor its negatives; of repeated rows each is a candidate;
ties go to the smaller id; scores beyond a long are cut to its range; fewer rows than asked for are all returned; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import matrix, quantised, tidy, whole, written
from .topk import _EXACT, _best

#: Rows of the sample (fewer for long vectors: SAMPLE_CELLS numbers), split points of a node, leaves at most, rows of a leaf.
SAMPLE_ROWS, SAMPLE_CELLS, WAYS, MOST_LEAVES, LEAF_ROWS = 20_000, 2_000_000, 16, 1024, 2048
#: Rows of a chunk at most, numbers in it, anchors that meet it at once, rows of a task about.
CHUNK_ROWS, CHUNK_CELLS, ANCHORS, TASK_ROWS = 1 << 15, 1 << 22, 128, 1 << 17
_MOST = (1 << 63) - 1


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances (n, m)."""
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (points**2).sum(1) - 2 * x @ points.T, 0))


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: doubles where these are exact, else longs, cut to their range."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1] < _EXACT:
        return a @ x.T
    whole_numbers = lambda m: np.array([[int(c) for c in row] for row in m], object).reshape(m.shape)
    return np.clip(whole_numbers(a) @ whole_numbers(x).T, -_MOST, _MOST).astype(np.int64)


class Tree:
    """Nodes of split points; leaves are numbered so that those of a subtree follow one another.

    nodes: (points (m, d), first leaf of each child and of what follows, child node or -1 for a leaf)
    """

    def __init__(self, sample: np.ndarray, leaves: int, ways: int = WAYS, seed: int = 11):
        self.nodes: list[tuple[np.ndarray, np.ndarray, list[int]]] = []
        self.n_leaves, self.ranges = 0, {}
        self._rng = np.random.default_rng(seed)
        self._least = max(2, -(-len(sample) // max(1, leaves)))
        self.root = self._grow(sample, leaves, ways)
        del self._rng

    def _far_apart(self, x: np.ndarray, m: int) -> np.ndarray:
        """m rows: each the one that is farthest from those before, of a few candidates (outliers are no split points)."""
        some = x[self._rng.permutation(len(x))[: 3 * m]]
        chosen = [0]
        near = distances(some, some[:1])[:, 0]
        while len(chosen) < m and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, distances(some, some[chosen[-1:]])[:, 0])
        return some[chosen]

    def _grow(self, x: np.ndarray, leaves: int, ways: int) -> int:
        points = self._far_apart(x, min(ways, leaves, len(x))) if leaves > 1 and len(x) > self._least else x[:0]
        if len(points) < 2:
            self.n_leaves += 1
            return -1
        at = len(self.nodes)
        self.nodes.append(None)
        near = distances(x, points).argmin(1)
        first, children = [], []
        for j in range(len(points)):
            first.append(self.n_leaves)
            part = x[near == j]
            children.append(self._grow(part, round(leaves * len(part) / len(x)), ways))
        self.nodes[at] = (points, np.array([*first, self.n_leaves]), children)
        return at

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: from node to node the nearest split point's."""
        out = np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0 or not len(rows):
                continue
            points, first, children = self.nodes[node]
            near = distances(x[rows], points).argmin(1)
            for j, child in enumerate(children):
                out[rows[near == j]] = first[j]
                todo.append((child, rows[near == j]))
        return out

    def widen(self, found: dict, x: np.ndarray, leaf: np.ndarray) -> None:
        """found[node] = (least, largest) distances (m, m) from split point i to rows of subtree j; row m: squared lengths."""
        length = (x**2).sum(1)
        for node, (points, first, _) in enumerate(self.nodes):
            rows = np.flatnonzero((leaf >= first[0]) & (leaf < first[-1]))
            if not len(rows):
                continue
            m = len(points)
            lo, hi = found.setdefault(node, (np.full((m + 1, m), np.inf), np.full((m + 1, m), -np.inf)))
            d = np.column_stack([distances(x[rows], points), length[rows]])
            child = np.searchsorted(first, leaf[rows], side="right") - 1
            for j in np.unique(child):
                mine = d[child == j]
                lo[:, j], hi[:, j] = np.minimum(lo[:, j], mine.min(0)), np.maximum(hi[:, j], mine.max(0))

    def alive(self, a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(n, leaves): which leaves may hold a row with a score inside any of an anchor's windows low, high (n, w)."""
        out = np.zeros((len(a), self.n_leaves), bool)
        length = (a**2).sum(1)
        todo = [(self.root, np.arange(len(a)), 0)]
        while todo:
            node, rows, leaf = todo.pop()
            if node < 0:
                out[rows, leaf] = True
                continue
            if node not in self.ranges or not len(rows):
                continue
            points, first, children = self.nodes[node]
            lo, hi = self.ranges[node]
            d = distances(a[rows], points)
            for j, child in enumerate(children):
                if hi[-1, j] < 0:
                    continue  # no row there
                # the annulus, a little wider than rounding can matter
                slack = 1e-6 * (np.sqrt(length[rows]) + np.sqrt(hi[-1, j])) + 1e-9
                inner = np.sqrt(np.maximum(length[rows, None] + lo[-1, j] - 2 * high[rows], 0)) - slack[:, None]
                square = length[rows, None] + hi[-1, j] - 2 * low[rows]
                outer = np.sqrt(np.maximum(square, 0)) + slack[:, None]
                empty = square < -1e-6 * (1 + length[rows, None] + hi[-1, j])
                least = np.maximum(lo[:-1, j] - d, d - hi[:-1, j]).max(1)
                most = (d + hi[:-1, j]).min(1)
                live = ((least[:, None] <= outer) & (most[:, None] >= inner) & (low[rows] <= high[rows]) & ~empty).any(1)
                todo.append((child, rows[live], first[j]))
        return out


def _indexed(rows: DataFrame, tree, d: int) -> DataFrame:
    """(leaf, id, label, v) of every row."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.value.leaf_of(matrix(batch.column(2), d))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["leaf", "id", "label", "v"])

    return rows.mapInArrow(run, "leaf int, id long, label long, v array<double>")


def _ranges(indexed: DataFrame, tree, d: int) -> dict:
    """The ranges of every node over all rows, merged by Spark: some (m + 1) * m numbers a node."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            tree.value.widen(found, matrix(batch.column(1), d), batch.column(0).to_numpy())
        for node, (lo, hi) in found.items():
            i, j = np.indices(lo.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(lo.size, node, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(lo.ravel()), pa.array(hi.ravel())], ["node", "i", "j", "lo", "hi"])

    out = {}
    for node, i, j, lo, hi in indexed.select("leaf", "v").mapInArrow(run, "node int, i int, j int, lo double, hi double").groupBy("node", "i", "j").agg(F.min("lo"), F.max("hi")).collect():
        m = len(tree.value.nodes[node][0])
        a, b = out.setdefault(node, (np.full((m + 1, m), np.inf), np.full((m + 1, m), -np.inf)))
        a[i, j], b[i, j] = lo, hi
    return out


def _top_bound(s: np.ndarray, k: int) -> float:
    """The k-th largest, or none."""
    return float(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else -np.inf


def _positive_bounds(state: dict, ids, labels, a, k) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the positives: from the k-th best of the sample's rows of that label on."""
    s = scores(a, state["x"])
    low = np.array([_top_bound(s[i][(state["label"] == labels[i]) & (state["id"] != ids[i])], k) for i in range(len(a))])
    return low[:, None], np.full((len(a), 1), np.inf)


def _negative_bounds(state: dict, ids, labels, a, windows, k) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the negatives (low, high lists), their lower ends raised by what the sample has inside them; padded by empty ones."""
    s = scores(a, state["x"])
    width = max((len(w[0]) for w in windows), default=1) or 1
    low, high = np.full((len(a), width), np.inf), np.full((len(a), width), -np.inf)
    for i, (lows, highs) in enumerate(windows):
        other = s[i][(state["label"] != labels[i]) & (state["id"] != ids[i])]
        for p, (x, y) in enumerate(zip(lows, highs)):
            low[i, p], high[i, p] = max(float(x), _top_bound(other[(other >= x) & (other <= y)], k)), y
    return low, high


def _routed(anchors: DataFrame, state, d: int, k: int) -> DataFrame:
    """Each anchor once for each chunk of the leaves that its windows leave. anchors: (id, label, v, low, high)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = state.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, labels, a = part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2), d)
                if part.column(3).null_count:
                    low, high = _positive_bounds(held, ids, labels, a, k)
                else:
                    low, high = _negative_bounds(held, ids, labels, a, list(zip(part.column(3).to_pylist(), part.column(4).to_pylist())), k)
                who, leaf = np.nonzero(held["tree"].alive(a, low, high))
                chunks = held["chunks"][leaf]
                who, leaf = np.repeat(who, chunks), np.repeat(leaf, chunks)
                nth = np.arange(len(who)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
                tile = held["first"][leaf] + nth
                if len(tile):
                    yield pa.RecordBatch.from_arrays([pa.array(tile.astype(np.int64)), pa.array(np.ones(len(tile), bool)), *(c.take(pa.array(who)) for c in part.columns)], ["tile", "asks", "id", "label", "v", "low", "high"])

    return anchors.mapInArrow(run, "tile long, asks boolean, id long, label long, v array<double>, low array<long>, high array<long>")


def _search(d: int, k: int):
    """Rows (tile, asks, id, label, v, low, high), a tile's rows before its anchors, to the best k of each anchor and window."""

    def found(ids, labels, a, windows, rows):
        """(anchor, window, row, score) of a few anchors against a chunk."""
        r_ids, r_labels, x = rows
        out = []
        if windows is None:
            for label in np.unique(labels):
                mine, same = np.flatnonzero(labels == label), slice(*np.searchsorted(r_labels, [label, label + 1])) if label < _MOST else r_labels == label
                s, names = scores(a[mine], x[same]), r_ids[same]
                for i, row in zip(mine, s):
                    other = names != ids[i]
                    best = _best(row[other], names[other], k)
                    out.append((ids[i], 0, best[1], best[0]))
            return out
        s = scores(a, x)
        for i, (lows, highs) in enumerate(windows):
            if not lows:
                continue
            at = np.flatnonzero((s[i] >= min(lows)) & (s[i] <= max(highs)) & (r_labels != labels[i]) & (r_ids != ids[i]))
            row, names = s[i][at], r_ids[at]
            for p, (lo, hi) in enumerate(zip(lows, highs)):
                inside = (row >= lo) & (row <= hi)
                best = _best(row[inside], names[inside], k)
                out.append((ids[i], p, best[1], best[0]))
        return out

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, rows = None, [], None
        for batch in batches:
            tile, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((tile[1:] != tile[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(tile)]):
                if hi == lo:
                    continue
                if tile[lo] != now:
                    now, parts, rows = tile[lo], [], None
                part = batch.slice(lo, hi - lo)
                if not asks[lo]:
                    parts.append((part.column(2).to_numpy(), part.column(3).to_numpy(), matrix(part.column(4), d)))
                    continue
                if rows is None:
                    if not parts:
                        continue
                    rows = [np.concatenate([p[i] for p in parts]) for i in range(3)]
                    order = np.argsort(rows[1], kind="stable")
                    rows, parts = [x[order] for x in rows], []
                out = []
                for at in range(0, part.num_rows, ANCHORS):
                    some = part.slice(at, ANCHORS)
                    windows = None if some.column(5).null_count else list(zip(some.column(5).to_pylist(), some.column(6).to_pylist()))
                    out += found(some.column(2).to_numpy(), some.column(3).to_numpy(), matrix(some.column(4), d), windows, rows)
                n = [len(x[2]) for x in out]
                if sum(n):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([x[0] for x in out], np.int64), n)), pa.array(np.repeat(np.array([x[1] for x in out], np.int32), n)), pa.array(np.concatenate([x[2] for x in out])), pa.array(np.concatenate([x[3] for x in out]).astype(np.int64))], ["anchor_id", "place", "vec_id", "score"])

    return run


class Index:
    """Every row of (id, label, v) in the leaf of a tree fitted on a sample, as a table in the shared folder."""

    def __init__(self, rows: DataFrame, d: int, leaf_rows: int = LEAF_ROWS, ways: int = WAYS):
        spark, self.d = rows.sparkSession, d
        n = rows.count()
        most = max(256, min(SAMPLE_ROWS, SAMPLE_CELLS // max(d, 1)))
        sample = rows.sample(False, min(1.0, 0.9 * most / max(n, 1)), 11).limit(most).toPandas()  # bounded
        x = np.array(sample["v"].tolist(), np.float64).reshape(len(sample), d)
        self.tree = Tree(x, max(1, min(MOST_LEAVES, n // leaf_rows)), ways)
        shared = spark.sparkContext.broadcast(self.tree)
        self.rows = written(_indexed(rows, shared, d), "negatives")
        self.tree.ranges = _ranges(self.rows, shared, d)
        counts = np.zeros(self.tree.n_leaves, np.int64)
        for leaf, c in self.rows.groupBy("leaf").count().collect():  # a row a leaf
            counts[leaf] = c
        chunk = max(1024, min(CHUNK_ROWS, CHUNK_CELLS // max(d, 1)))
        chunks = -(-counts // chunk)
        first = np.cumsum(chunks) - chunks
        self.n_tiles, self.parts = int(chunks.sum()), int(max(2 * spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS)))
        self.state = spark.sparkContext.broadcast({"tree": self.tree, "chunks": chunks, "first": first, "x": x, "id": sample["id"].to_numpy(np.int64), "label": sample["label"].to_numpy(np.int64)})
        at = lambda values: F.get(F.lit([int(v) for v in values]), F.col("leaf"))
        tile = at(first) + F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), at(np.maximum(chunks, 1)))
        nothing = F.lit(None).cast("array<long>")
        self.tiles = self.rows.select(tile.cast("long").alias("tile"), F.lit(False).alias("asks"), "id", "label", "v", nothing.alias("low"), nothing.alias("high"))

    def search(self, anchors: DataFrame, k: int) -> DataFrame:
        """(anchor_id, place, vec_id, score): the best k of each tile. anchors: (id, label, v, low, high).

        Null windows: rows of the anchor's label; else rows of other labels, `place` being the window's.
        """
        asked = _routed(anchors, self.state, self.d, k)
        both = self.tiles.unionByName(asked)
        dealt = both.repartitionById(self.parts, F.pmod(F.col("tile"), F.lit(self.parts)).cast("int")).sortWithinPartitions("tile", "asks")
        return dealt.mapInArrow(_search(self.d, k), "anchor_id long, place int, vec_id long, score long")


def hard_negatives(vectors: DataFrame, is_anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, k: int = 5, least: int = 80, most: int = 100, scale: float = 256.0, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Of each row that is_anchor marks the `positives` rows of its label with the highest inner products, and for each of
    them the k rows of other labels with the highest scores from least to most percent of the positive's score.
    """
    marked = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows, d = quantised(marked.filter("id is not null and label is not null").filter(whole("v")), scale)
    index = Index(rows.select("id", "label", "v"), d, leaf_rows)
    nothing = F.lit(None).cast("array<long>")
    anchors = rows.filter("asks").groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v")
    anchors = written(anchors, "anchors")
    best = W.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    top = index.search(anchors.withColumns({"low": nothing, "high": nothing}), positives).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= positives)
    found = F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col("vec_id"), F.col("score"))))  # at most `positives`
    by = written(top.groupBy("anchor_id").agg(found.alias("p")), "positives")
    p = F.col("p.score")
    # whole numbers: least * s <= 100 * n means n >= ceil(least * s / 100)
    low = F.transform(p, lambda s: F.ceil(s.cast("decimal(38,0)") * least / 100).cast("long"))
    high = F.transform(p, lambda s: F.floor(s.cast("decimal(38,0)") * most / 100).cast("long"))
    asked = anchors.join(by.withColumnRenamed("anchor_id", "id"), "id").select("id", "label", "v", low.alias("low"), high.alias("high"))
    negatives = index.search(asked, k).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    named = by.select("anchor_id", F.posexplode("p").alias("place", "q"))
    out = negatives.join(named, ["anchor_id", "place"])
    return out.select("anchor_id", F.col("q.vec_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("q.score").alias("positive_score"), F.col("score").alias("negative_score"))
