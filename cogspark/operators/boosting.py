"""Gradient-boosted trees over binned features, for many configurations and folds in the same passes over the data.

Features are cut into bins once, for all configurations and folds; a row is one byte a feature. A run is a
configuration with a fold that it does not see. Each level of each round's trees is one pass: the tasks bring the
gradients of their rows up to date, add them up by (run, class, node, feature, bin), Spark sums these histograms and
finds each node's best split where they meet, and only the splits, a row a node, come to the driver. Gradients are
added up as whole numbers (2^-20 units), so the trees do not depend on how the rows are dealt. Every few rounds the
rows' margins are written to the shared folder and go on from there.

Runs are trained in waves, so that the histograms which a task holds stay within CELLS numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from .evaluate import auroc_interval, macro_f1, soft_truth
from .shared import written

#: A gradient's unit, numbers of a task's histograms, rounds between two tables of margins, rows taken at once.
UNIT, CELLS, KEEP_EVERY, ROWS = float(1 << 20), 1 << 24, 8, 4096


@dataclass(frozen=True)
class Config:
    """What a configuration sets: leaves of a tree and its depth, rows of a leaf, share of the features that a tree sees, step, penalty."""

    leaves: int = 15
    min_rows: int = 20
    feature_fraction: float = 0.7
    depth: int = 5
    rate: float = 0.05
    l2: float = 1.0


def grid(leaves=(7, 15, 31), min_rows=(10, 30), feature_fraction=(0.6, 0.9), **fixed) -> list[Config]:
    """Every combination, in order."""
    return [Config(leaves=n, min_rows=m, feature_fraction=f, **fixed) for n in leaves for m in min_rows for f in feature_fraction]


@dataclass
class Binned:
    """rows: (id, fold, stop, y, weight, x), a byte of x for each feature. Null and NaN are bin 0, below all values."""

    rows: DataFrame
    features: list[str]
    labels: list[str]
    edges: list[np.ndarray]

    @property
    def bins(self) -> int:
        return max((len(e) for e in self.edges), default=0) + 2


@dataclass
class Ensemble:
    """trees[run][round][class] = (feature, bin, value) by node, children of i at 2i + 1 (bin at most) and 2i + 2."""

    runs: list[tuple[Config, int | None]]
    base: np.ndarray
    trees: list[list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]] = field(default_factory=list)
    losses: list[list[float]] = field(default_factory=list)
    gains: list[np.ndarray] = field(default_factory=list)

    def best(self, run: int) -> int:
        """Rounds that the early-stopping rows are best with; all without such rows."""
        losses = self.losses[run]
        return int(np.argmin(losses)) if losses else len(self.trees[run])


def quantile_edges(rows: DataFrame, features: list[str], bins: int = 32) -> list[np.ndarray]:
    """Cuts between bins: the different quantiles of each feature, at most bins - 1 of them."""
    at = [i / bins for i in range(1, bins)]
    clean = [F.percentile_approx(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), at, F.lit(10_000)).alias(f) for f in features]
    row = rows.agg(*clean).first()
    return [np.unique(np.array(row[f] or [], float)) for f in features]


def bin_rows(rows: DataFrame, features: list[str], edges: list[np.ndarray], label: str = "label", id: str = "id", fold: Column | None = None, stop: Column | None = None, weight: Column | None = None, soft: bool = False) -> Binned:
    """Rows with their features as bins. Unless soft, an id that occurs twice is an error; soft rows repeat an id with a weight for each label.

    stop marks the rows that early stopping looks at instead of training; rows without a label are left out.
    """
    rows = rows.filter(F.col(label).isNotNull())
    if not soft:
        twice = rows.groupBy(id).count().filter("count > 1").select(id).head(1)
        if twice:
            raise ValueError(f"id {twice[0][0]} has more than one row")
    labels = [r[0] for r in rows.select(F.col(label).cast("string").alias("l")).distinct().sort("l").collect()]  # a vocabulary
    place = F.array_position(F.lit(labels) if labels else F.array().cast("array<string>"), F.col(label).cast("string")) - 1
    part = rows.select(
        F.col(id).cast("long").alias("id"),
        (F.lit(0) if fold is None else fold).cast("int").alias("fold"),
        F.coalesce(F.lit(False) if stop is None else stop, F.lit(False)).alias("stop"),
        place.cast("int").alias("y"),
        (F.lit(1.0) if weight is None else weight).cast("double").alias("weight"),
        F.array(*[F.col(f).cast("double") for f in features]).alias("v"),
    )
    d = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(5).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
            x = np.zeros(v.shape, np.uint8)
            for f, e in enumerate(edges):
                x[:, f] = np.where(np.isnan(v[:, f]), 0, 1 + np.searchsorted(e, v[:, f], side="left"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([r.tobytes() for r in x], pa.binary())], ["id", "fold", "stop", "y", "weight", "x"])

    return Binned(written(part.mapInArrow(run, "id long, fold int, stop boolean, y int, weight double, x binary"), "bins"), features, labels, edges)


def _bytes(column: pa.Array, dtype, width: int) -> np.ndarray:
    """(n, width) of a binary column of equally long values."""
    if not len(column):
        return np.zeros((0, width), dtype)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype).reshape(-1, width)


def walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node in which each row ends."""
    node = np.zeros(len(x), np.int64)
    every = np.arange(len(x))
    for _ in range(depth):
        f = feature[node]
        go = x[every, np.maximum(f, 0)] > cut[node]
        node = np.where(f >= 0, 2 * node + 1 + go, node)
    return node


def _probabilities(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def gradients(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted log-loss by margin, (n, classes), in whole units."""
    p = _probabilities(margins)
    k = margins.shape[1]
    g = p.copy()
    g[np.arange(len(y)), y] -= 1
    return np.rint(g * weight[:, None] * UNIT), np.rint(p * (1 - p) * weight[:, None] * (k / max(k - 1, 1)) * UNIT)


def best_split(hist: np.ndarray, allowed: np.ndarray, min_rows: int, l2: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of a node's histogram (features, 3, bins): the first of the best; no gain without one."""
    left = hist.cumsum(2).astype(float)
    total = left[:, :, -1:]
    right = total - left
    score = lambda s: (s[:, 0] / UNIT) ** 2 / (s[:, 1] / UNIT + l2 + 1e-12)
    gain = score(left) + score(right) - score(total)
    gain[~allowed] = -np.inf
    gain[(left[:, 2] < min_rows) | (right[:, 2] < min_rows)] = -np.inf
    at = int(gain.argmax())
    f, b = divmod(at, gain.shape[1])
    return float(gain[f, b]), f, b


def seen_features(config: Config, nth: int, cls: int, d: int, seed: int) -> np.ndarray:
    """The features that a tree may split on, the same in every fold."""
    m = max(1, round(config.feature_fraction * d))
    out = np.zeros(d, bool)
    out[np.random.default_rng([seed, nth, cls, config.leaves, config.min_rows, round(1000 * config.feature_fraction)]).permutation(d)[:m]] = True
    return out


def _trains(run, fold: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return ~stop if run[1] is None else (fold != run[1]) & ~stop


def _apply(margins: np.ndarray, x: np.ndarray, rounds: list, runs: list) -> None:
    """Adds rounds of trees (round, run, class) to margins (n, run, class)."""
    for trees in rounds:
        for r, of in enumerate(trees):
            for k, (feature, cut, value) in enumerate(of or ()):
                margins[:, r, k] += value[walk(x, feature, cut, runs[r][0].depth)]


def _pass(binned: Binned, rows: DataFrame, state, d: int, level: int, seed: int) -> dict:
    """One level of the trees that grow: {(run, class, node): (gain, feature, bin, left g, h, n, right g, h, n)}, and the losses at its start."""
    K, bins = len(binned.labels), binned.bins

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = state.value
        runs, growing = s["runs"], s["growing"]
        first, width = 2**level - 1, 2**level
        total, losses = {}, np.zeros((len(runs), 2))
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                fold, stop = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
                y, weight, x = batch.column(2).to_numpy(), batch.column(3).to_numpy(), _bytes(batch.column(4), np.uint8, d)
                margins = _bytes(batch.column(5), np.float64, len(runs) * K).reshape(-1, len(runs), K).copy()
                _apply(margins, x, s["since"], runs)
                for r, run in enumerate(runs):
                    if growing[r] is None:
                        continue
                    if level == 0:
                        held = stop if run[1] is None else stop & (fold != run[1])
                        if held.any():
                            p = _probabilities(margins[held, r])[np.arange(held.sum()), y[held]]
                            losses[r] += np.rint(-np.log(np.maximum(p, 1e-12)) * weight[held] * UNIT).sum(), weight[held].sum()
                    mine = np.flatnonzero(_trains(run, fold, stop))
                    if not len(mine):
                        continue
                    g, h = gradients(margins[mine, r], y[mine], weight[mine])
                    for k in range(K):
                        feature, cut, live = growing[r][k]
                        node = walk(x[mine], feature, cut, level) - first if level else np.zeros(len(mine), np.int64)
                        inside = (node >= 0) & live[np.clip(node, 0, width - 1)]
                        if not inside.any():
                            continue
                        into = total.setdefault((r, k), np.zeros((width, d, 3, bins), np.int64))
                        own, rows_x, gk, hk = node[inside] * bins, x[mine[inside]], g[inside, k], h[inside, k]
                        for f in range(d):
                            key = own + rows_x[:, f]
                            for c, w in enumerate((gk, hk, None)):
                                into[:, f, c] += np.rint(np.bincount(key, w, width * bins)).astype(np.int64).reshape(width, bins)
        for r in np.flatnonzero(losses[:, 1]):
            yield pa.RecordBatch.from_arrays([pa.array([-1 - int(r)], pa.int64()), pa.array([0], pa.int32()), pa.array([losses[r].tobytes()], pa.binary())], ["key", "f", "h"])
        for (r, k), h in total.items():
            for node in np.flatnonzero(h[:, 0, 2].sum(1)):
                key = (r * K + k) * width + int(node)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d, key)), pa.array(np.arange(d, dtype=np.int32)), pa.array([a.tobytes() for a in h[node]], pa.binary())], ["key", "f", "h"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = state.value
        now, hist = None, None

        def close():
            if now < 0:
                return [now, float(hist[0]), 0, 0, float(hist[1]), *[0.0] * 5]
            rk, _ = divmod(now, 2**level)
            r, k = divmod(rk, K)
            config = s["runs"][r][0]
            gain, f, b = best_split(hist, seen_features(config, s["round"], k, d, seed), config.min_rows, config.l2)
            left = hist[f, :, : b + 1].sum(1)
            return [now, gain, f, b, *map(float, left), *map(float, hist[f].sum(1) - left)]

        out = []
        for batch in batches:
            for key, f, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if key != now:
                    if now is not None:
                        out.append(close())
                    now, hist = key, np.zeros(2) if key < 0 else np.zeros((d, 3, bins), np.int64)
                if key < 0:
                    hist += np.frombuffer(h, np.float64)
                else:
                    hist[f] += np.frombuffer(h, np.int64).reshape(3, bins)
        if now is not None:
            out.append(close())
        names = ["key", "gain", "f", "b", "lg", "lh", "ln", "rg", "rh", "rn"]
        kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), *[pa.float64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(10)], names)

    parts = rows.select("fold", "stop", "y", "weight", "x", "m").mapInArrow(add, "key long, f int, h binary")
    met = parts.repartition("key").sortWithinPartitions("key")
    found = met.mapInArrow(choose, "key long, gain double, f int, b int, lg double, lh double, ln double, rg double, rh double, rn double").collect()  # a row a node
    return {r["key"]: tuple(r)[1:] for r in found}


def _wave(binned: Binned, runs: list, rounds: int, patience: int | None, seed: int, base: np.ndarray) -> tuple[list, list, list]:
    """(trees by run, losses by run, gains by run and feature) of some runs."""
    spark, d, K = binned.rows.sparkSession, len(binned.features), len(binned.labels)
    start = base.tobytes()
    rows = binned.rows.withColumn("m", F.lit(bytearray(start)))
    trees, losses, gains = [[] for _ in runs], [[] for _ in runs], [np.zeros(d) for _ in runs]
    live, since = set(range(len(runs))), []
    for nth in range(rounds + 1):
        if not live:
            break
        growing: list = [None] * len(runs)
        for r in live:
            size = 2 ** (runs[r][0].depth + 1) - 1
            growing[r] = [[np.full(size, -1, np.int32), np.zeros(size, np.int32), np.array([True]), np.zeros(size)] for _ in range(K)]
        leaves = {(r, k): 1 for r in live for k in range(K)}
        for level in range(max(runs[r][0].depth for r in live)):
            sent = {"runs": runs, "since": since, "round": nth, "growing": [g and [tuple(t[:3]) for t in g] for g in growing]}
            shared = spark.sparkContext.broadcast(sent)
            found = _pass(binned, rows, shared, d, level, seed)
            shared.unpersist()
            if level == 0:
                for r in sorted(live):
                    if -1 - r in found:
                        losses[r].append(found[-1 - r][0] / UNIT / found[-1 - r][3])
                        if patience is not None and len(losses[r]) - 1 - int(np.argmin(losses[r])) >= patience:
                            live.discard(r)
                            growing[r] = None
                if nth == rounds or not live:
                    return trees, losses, gains
            width, again = 2**level, False
            for r in live:
                config = runs[r][0]
                for k in range(K):
                    tree = growing[r][k]
                    if level >= config.depth:
                        tree[2] = np.zeros(2 * width, bool)
                        continue
                    splits = sorted(((-v[0], node, v) for node in range(width) if (v := found.get((r * K + k) * width + node))), key=lambda t: t[:2])
                    nxt = np.zeros(2 * width, bool)
                    for _, node, (gain, f, b, lg, lh, ln, rg, rh, rn) in splits:
                        at = width - 1 + node
                        if level == 0:
                            tree[3][0] = -config.rate * (lg + rg) / (lh + rh + config.l2 * UNIT)
                        if gain <= 1e-9 or leaves[r, k] >= config.leaves:
                            continue
                        leaves[r, k] += 1
                        gains[r][f] += gain
                        tree[0][at], tree[1][at] = f, b
                        tree[3][2 * at + 1], tree[3][2 * at + 2] = -config.rate * lg / (lh + config.l2 * UNIT), -config.rate * rg / (rh + config.l2 * UNIT)
                        nxt[2 * node], nxt[2 * node + 1] = True, True
                    tree[2] = nxt
                    again |= nxt.any() and level + 1 < config.depth and leaves[r, k] < config.leaves
            if not again:
                break
        since.append([[(t[0], t[1], t[3]) for t in growing[r]] if growing[r] else None for r in range(len(runs))])
        for r in live:
            trees[r].append(since[-1][r])
        if len(since) == KEEP_EVERY:
            rows, since = written(_margins(rows, runs, since, d, K), "margins"), []
    return trees, losses, gains


def _margins(rows: DataFrame, runs: list, since: list, d: int, K: int) -> DataFrame:
    """rows with the margins m brought up to date."""
    schema, shared = rows.schema, rows.sparkSession.sparkContext.broadcast(since)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            margins = _bytes(batch.column(names.index("m")), np.float64, len(runs) * K).reshape(-1, len(runs), K).copy()
            _apply(margins, _bytes(batch.column(names.index("x")), np.uint8, d), shared.value, runs)
            yield pa.RecordBatch.from_arrays([pa.array([m.tobytes() for m in margins], pa.binary()) if n == "m" else c for n, c in zip(names, batch.columns)], names)

    return rows.mapInArrow(run, schema)


def boost(binned: Binned, configs: list[Config], folds: list[int | None] | None = None, rounds: int = 400, patience: int | None = 30, seed: int = 42) -> Ensemble:
    """An ensemble for each configuration and fold; the fold None trains on all rows. Folds are those of the rows unless given.

    With rows marked `stop`, a run ends after `patience` rounds without a better loss on those outside its fold.
    """
    mass = binned.rows.groupBy("fold", "y").agg(F.sum("weight").alias("w")).collect()  # folds by labels
    if folds is None:
        folds = sorted({r["fold"] for r in mass})
    runs = [(c, f) for c in configs for f in folds]
    base = np.zeros((len(runs), len(binned.labels)))
    for i, (_, f) in enumerate(runs):
        w = np.zeros(len(binned.labels))
        for r in sorted(mass, key=lambda r: (r["fold"], r["y"])):
            if r["fold"] != f:
                w[r["y"]] += r["w"]
        base[i] = np.log(np.maximum(w, 1e-9) / max(w.sum(), 1e-9))
    base = np.round(base, 9)
    out = Ensemble(runs, base)
    width = max(c.depth for c in configs)
    at_once = max(1, CELLS // max(1, len(binned.labels) * 2 ** (width - 1) * len(binned.features) * 3 * binned.bins))
    for lo in range(0, len(runs), at_once):
        trees, losses, gains = _wave(binned, runs[lo : lo + at_once], rounds, patience, seed, base[lo : lo + at_once])
        out.trees += trees
        out.losses += losses
        out.gains += gains
    return out


def out_of_fold(binned: Binned, model: Ensemble, temperature: float = 1.0) -> DataFrame:
    """(config, fold, id, label, p) of every row and label by the runs whose fold it is; config counts the configurations from 0."""
    configs = list(dict.fromkeys(c for c, _ in model.runs))
    d, labels = len(binned.features), binned.labels
    shared = binned.rows.sparkSession.sparkContext.broadcast([(configs.index(c), f, c.depth, model.base[i], model.trees[i][: model.best(i)]) for i, (c, f) in enumerate(model.runs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                fold, x = batch.column(1).to_numpy(), _bytes(batch.column(2), np.uint8, d)
                for config, f, depth, base, rounds in shared.value:
                    own = np.flatnonzero(np.full(len(fold), True) if f is None else fold == f)
                    if not len(own):
                        continue
                    margins = np.repeat(base[None], len(own), 0)
                    for trees in rounds:
                        for k, (feature, cut, value) in enumerate(trees):
                            margins[:, k] += value[walk(x[own], feature, cut, depth)]
                    p = _probabilities(margins / temperature)
                    n = len(own) * len(labels)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, config, np.int32)), pa.array(np.repeat(fold[own], len(labels))), batch.column(0).take(pa.array(np.repeat(own, len(labels)))), pa.array(labels * len(own)), pa.array(p.ravel())], ["config", "fold", "id", "label", "p"])

    return binned.rows.select("id", "fold", "x").dropDuplicates(["id"]).mapInArrow(run, "config int, fold int, id long, label string, p double")


def mask(p: DataFrame, features: DataFrame, preconditions: dict[str, list[str]] = C.MASK_PRECONDITIONS, id: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """M5: p of classes whose structure is absent becomes 0 and the rest adds up to 1 again. p: (by…, id, label, p).

    A class is possible if one of its features is not 0, or is null or NaN (unknown); where nothing would be left the
    row stays as it is. features: one row an id.
    """
    there = lambda f: F.coalesce(F.isnan(F.col(f).cast("double")) | (F.col(f) != 0), F.lit(True))
    allowed = F.array_compact(F.array(*[F.when(~F.greatest(*[there(f) for f in need], F.lit(False)), cls) for cls, need in preconditions.items()]))
    rows = p.join(features.select(id, allowed.alias("__gone")), id, "left")
    own = W.partitionBy(*by, id)
    left = F.when(F.array_contains(F.coalesce("__gone", F.array().cast("array<string>")), F.col("label")), 0.0).otherwise(F.col("p"))
    total = F.sum(left).over(own)
    return rows.withColumn("p", F.when(total > 0, left / total).otherwise(F.col("p") / F.sum("p").over(own))).drop("__gone")


def config_scores(p: DataFrame, truths: DataFrame) -> DataFrame:
    """(config, macro_f1_mean, macro_f1_std, log_loss_mean, n): means over folds.

    p: (config, fold, id, label, p); truths: (id, truths), a map of each label's share. The likeliest label, the first
    of equals, counts as right if the row has any share of it; the log-loss is the cross-entropy to the shares.
    """
    best = p.groupBy("config", "fold", "id").agg(F.max_by("label", F.struct("p", F.lit(0))).alias("any"), F.map_from_entries(F.collect_list(F.struct("label", "p"))).alias("ps"))
    first = F.element_at(F.array_sort(F.transform(F.map_entries("ps"), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), 1)["k"]
    rows = best.withColumn("pred", first).drop("any").join(truths, "id")
    loss = -F.aggregate(F.map_entries("truths"), F.lit(0.0), lambda s, e: s + e["value"] * F.log(F.greatest(F.coalesce(F.element_at("ps", e["key"]), F.lit(0.0)), F.lit(1e-12))))
    rows = rows.withColumn("loss", loss)
    by = ("config", "fold")
    f1 = macro_f1(soft_truth(rows), by).select(*by, "macro_f1")
    each = rows.groupBy(*by).agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n")).join(f1, list(by))
    return each.groupBy("config").agg(F.avg("macro_f1").alias("macro_f1_mean"), F.stddev_pop("macro_f1").alias("macro_f1_std"), F.avg("loss").alias("log_loss_mean"), F.sum("n").alias("n"))


def select_config(scores: DataFrame) -> DataFrame:
    """The configuration with the highest mean macro-F1 (six digits), of equals the one with the lowest log-loss, then the first."""
    return scores.orderBy(F.desc(F.round("macro_f1_mean", 6)), "log_loss_mean", "config").limit(1)


def cross_validate(binned: Binned, configs: list[Config], truths: DataFrame, rounds: int = 400, patience: int | None = 30, refit: bool = False, seed: int = 42) -> tuple[Ensemble, DataFrame]:
    """M4: the ensembles and config_scores of every configuration, by the early-stopped runs.

    refit: each fold's training part is fitted whole again, for as many rounds as were best.
    """
    model = boost(binned, configs, None, rounds, patience, seed)
    if refit:
        whole = Binned(binned.rows.withColumn("stop", F.lit(False)), binned.features, binned.labels, binned.edges)
        again = Ensemble(model.runs, model.base)
        for i, (c, f) in enumerate(model.runs):
            one = boost(whole, [c], [f], max(1, model.best(i)), None, seed)
            again.trees += one.trees
            again.losses += one.losses
            again.gains += one.gains
        model = again
    return model, config_scores(written(out_of_fold(binned, model), "oof"), truths)


def check_shift(rows: DataFrame, features: list[str], side: str, group: str, id: str = "id", folds: int = 5, rounds: int = 100, config: Config = Config(min_rows=5), limit: float = C.SHIFT_AUC, top: int = 5, reps: int = 200) -> DataFrame:
    """Q8: (rule_id, status, key, value): how well boosted trees tell two corpora (side 0 or 1) apart out of fold.

    Folds keep groups together. Rows: auroc, which fails above the limit, lo and hi from drawing whole groups again
    (null where too few draws have both sides), and the `top` features by their share of the splits' gains over all
    folds. With fewer than two groups on a side there is one row, SKIP.
    """
    rows = rows.filter(F.col(side).isNotNull())
    groups = rows.groupBy(side).agg(F.countDistinct(group).alias("n")).collect()  # two rows
    schema = "rule_id string, status string, key string, value double"
    if len(groups) < 2 or min(r["n"] for r in groups) < 2:
        return rows.sparkSession.createDataFrame([("Q8", "SKIP", "auroc", None)], schema)
    fold = F.pmod(F.xxhash64(F.col(group).cast("string")), F.lit(min(folds, *(r["n"] for r in groups))))
    named = rows.withColumn("__side", F.when(F.col(side) == 1, "b").otherwise("a"))
    binned = bin_rows(named, features, quantile_edges(named, features), "__side", id, fold)
    model = boost(binned, [config], None, rounds, None)
    p = out_of_fold(binned, model).filter("label = 'b'").select("id", "p")
    scored = written(p.join(named.select(F.col(id).cast("long").alias("id"), F.col(side).cast("int").alias("y"), F.col(group).cast("string").alias("g")), "id"), "shift")
    auc = auroc_interval(scored, "g", "p", "y", reps).first()
    gain = np.sum(model.gains, axis=0)
    order = [f for f in np.argsort(-gain, kind="stable")[:top] if gain[f] > 0]
    status = "FAIL" if auc["estimate"] is not None and auc["estimate"] > limit else "PASS"
    out = [("Q8", status, "auroc", auc["estimate"]), ("Q8", status, "lo", auc["lo"]), ("Q8", status, "hi", auc["hi"])]
    return rows.sparkSession.createDataFrame([*out, *(("Q8", status, f"gain:{features[f]}", float(gain[f] / gain.sum())) for f in order)], schema)


def text_columns(weights: DataFrame, terms: int = 256) -> tuple[DataFrame, list[str]]:
    """M3: (id, t0, t1, …) of TF-IDF weights (id, term, weight): a column for each of the terms most texts have, 0 where absent."""
    top = weights.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(terms)  # `terms` rows
    names = [r[0] for r in top.collect()]
    held = F.map_from_entries(F.collect_list(F.when(F.col("term").isin(names), F.struct("term", "weight"))))
    wide = weights.groupBy("id").agg(held.alias("m"))
    columns = [f"t{i}" for i in range(len(names))]
    return wide.select("id", *[F.coalesce(F.element_at("m", F.lit(n)), F.lit(0.0)).alias(c) for n, c in zip(names, columns)]), columns
