"""Baselines, rules, trees and novelty: fitted on Spark or from aggregates, scored in batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from .evaluate import auroc
from .quality import stumps
from .shared import written


def majority(train: DataFrame, label: str = "label") -> DataFrame:
    """One row with the most frequent label, ties to the larger name."""
    return train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", label))[label].alias(label))


def rule_engine(features: DataFrame, rules: dict[str, str] = C.RULES, passed: str = "b_pass_frac", fallback: str = "OTHER") -> DataFrame:
    """Adds pred: the first rule that holds, else CORRECT if all tests passed or none is known, else the fallback.

    Rules are SQL over features; a feature by itself means that it is not 0, null and NaN read as 0.
    """
    def condition(rule: str) -> Column:
        return F.expr(re.sub(r"\b([abr]_\w+)\b(\s*(?:>=|<=|>|<|=)\s*[\d.]+)?", lambda m: f"(coalesce(nanvl(cast({m[1]} as double), 0), 0) {m[2] or '<> 0'})", rule))

    out = None
    for label, rule in rules.items():
        out = F.when(condition(rule), label) if out is None else out.when(condition(rule), label)
    all_passed = F.col(passed).isNull() | F.isnan(F.col(passed).cast("double")) | (F.col(passed) >= 1)
    return features.withColumn("pred", out.otherwise(F.when(all_passed, "CORRECT").otherwise(fallback)))


def zero(c: str) -> Column:
    """A feature as rules read it."""
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))


def fit_trees(train: DataFrame, features: list[str], label: str, weight: str | None = None, trees: int = 20, depth: int = 6, seed: int = 42):
    """A random forest pipeline over the features (null as -1) with string labels and row weights."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    rf = RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=trees, maxDepth=depth, seed=seed)
    if weight:
        rf = rf.setWeightCol(weight)
    rows = train.fillna(-1.0, features)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x"), StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc", handleInvalid="keep"), rf]).fit(rows)


def score(model, rows: DataFrame, features: list[str], id: str, temperature: float = 1.0) -> DataFrame:
    """(id, label, p) of a fitted pipeline, probabilities softened by a temperature on their logarithms."""
    from pyspark.ml.functions import vector_to_array

    labels = model.stages[1].labels
    p = model.transform(rows.fillna(-1.0, features)).select(id, vector_to_array("probability").alias("p"))
    soft = F.transform(F.slice("p", 1, len(labels)), lambda x: F.pow(F.greatest(x, F.lit(1e-9)), F.lit(1 / temperature)))
    return p.withColumn("s", soft).select(id, F.posexplode("s").alias("k", "v"), F.aggregate("s", F.lit(0.0), lambda a, x: a + x).alias("t")).select(id, F.element_at(F.lit(labels), F.col("k") + 1).alias("label"), (F.col("v") / F.col("t")).alias("p"))


def oof(rows: DataFrame, fold: str, fit, predict) -> DataFrame:
    """Each row's prediction by the model of the fold that did not train on it: fit(train) and predict(model, test) over the folds."""
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())  # a handful
    out = None
    for k in folds:
        part = predict(fit(rows.filter(F.col(fold) != k)), rows.filter(F.col(fold) == k))
        out = part if out is None else out.unionByName(part)
    return out


def adversarial_auc(rows: DataFrame, features: list[str], side: str, fold: str, id: str) -> DataFrame:
    """Q8: AUC of telling two corpora apart out of fold: (auroc, n)."""
    name = F.when(F.col(side) == 1, "b").otherwise("a")
    rows = rows.withColumn("__side", name)
    p = oof(rows, fold, lambda t: fit_trees(t, features, "__side", trees=10, depth=4), lambda m, t: score(m, t, features, id).filter("label = 'b'"))
    return auroc(p.join(rows.select(id, side), id), "p", side)


def stump_auc(rows: DataFrame, features: list[str], id: str, y: str, fold: str | None = None) -> DataFrame:
    """M9: (feature, threshold, auc) of the best depth-1 split of a binary label; with fold, (feature, auc) out of fold.

    Out of fold each row is judged by the split that the other folds' rows chose: its score is the share of label 1 on
    its side of that split.
    """
    as_label = lambda df: df.withColumn("label", F.col(y).cast("string"))
    if fold is None:
        return stumps(as_label(rows), id, features).select("feature", "threshold", F.col("macro_recall").alias("auc"))
    cells = rows.select(id, y, fold, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])))

    def fit(train):
        cut = stumps(as_label(train), id, features).select("feature", "threshold")
        side = cells.join(train.select(fold).distinct(), fold, "left_semi").join(F.broadcast(cut), "feature")  # a row a feature
        return side.groupBy("feature", (F.col("x") <= F.col("threshold")).alias("low")).agg(F.first("threshold").alias("threshold"), F.avg(y).alias("p"))

    def predict(model, test):
        both = model.groupBy("feature").agg(F.first("threshold").alias("threshold"), F.max(F.when(F.col("low"), F.col("p"))).alias("below"), F.max(F.when(~F.col("low"), F.col("p"))).alias("above"))
        own = cells.join(test.select(fold).distinct(), fold, "left_semi").join(F.broadcast(both), "feature")
        return own.select("feature", y, F.when(F.col("x") <= F.col("threshold"), F.col("below")).otherwise(F.col("above")).alias("p"))

    return auroc(oof(rows, fold, fit, predict), "p", y, ("feature",)).select("feature", F.col("auroc").alias("auc"))


def fit_novelty(train: DataFrame, features: list[str], id: str, rows: int = 4000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(stats, reference): median, mean and deviation of each varying feature; about `rows` standardised reference rows by hash."""
    inf = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    med = train.select(inf).groupBy("feature").agg(F.percentile("x", F.lit(0.5)).alias("median"))
    filled = train.select(inf).join(F.broadcast(med), "feature").withColumn("x", F.coalesce("x", "median"))
    stats = filled.groupBy("feature").agg(F.first("median").alias("median"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).filter("sd > 0")
    n = train.agg(F.count(F.lit(1)).alias("n")).scalar()
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(id).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    return stats, standardise(train.filter(u < F.lit(float(rows)) / n), stats, features, id)


def standardise(rows: DataFrame, stats: DataFrame, features: list[str], id: str) -> DataFrame:
    """(id, vector): features by name, median for null, less the mean, by the deviation."""
    inf = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    z = rows.select(id, inf).join(F.broadcast(stats), "feature").select(id, "feature", ((F.coalesce("x", "median") - F.col("mean")) / F.col("sd")).alias("z"))
    return z.groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "z"))), lambda s: s["z"]).alias("vector"))


#: Pivots at most, reference rows for each, numbers of a chunk's distances.
PIVOTS, PIVOT_ROWS, CHUNK_CELLS = 256, 1024, 1 << 22


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _to_points(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (points**2).sum(1) - 2 * x @ points.T, 0))


def _few_of_equal(ids: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with equal vectors those with the least ids: no more can be among anyone's nearest."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order] + 0.0)
    _, which = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    by = np.argsort(which, kind="stable")
    first = np.flatnonzero(np.diff(which[by], prepend=-1))
    place = np.empty(len(ids), np.int64)
    place[by] = np.arange(len(ids)) - np.repeat(first, np.diff(first, append=len(ids)))
    return ids[place < most], x[place < most]


def _nearest(k: int, exclude_self: bool):
    """Rows (tile, is_row, id, vector), a tile's queries before its rows, to the k nearest rows of each query and tile."""

    def first_k(who, near, ids):
        """Of each query the k first by distance (nine digits) and id."""
        order = np.lexsort((ids, np.round(near, 9), who))
        who, near, ids = who[order], near[order], ids[order]
        begin = np.maximum.accumulate(np.where(np.diff(who, prepend=-1) != 0, np.arange(len(who)), 0))
        keep = np.arange(len(who)) - begin < k
        return who[keep], near[keep], ids[keep]

    def merge(q, q_ids, best, ref_ids, ref):
        ref_ids, ref = _few_of_equal(ref_ids, ref, k + 1)
        # squared distance of each query's k-th row so far
        held = np.full(len(q), np.inf)
        full = np.bincount(best[0], minlength=len(q)) >= k
        held[full] = best[1][np.flatnonzero(np.diff(best[0], append=-1))[full[np.unique(best[0])]]] ** 2 if full.any() else held[full]
        parts, length = [best], (ref**2).sum(1)
        step = max(1, CHUNK_CELLS // len(ref_ids))
        for lo in range(0, len(q), step):
            some, own = q[lo : lo + step], (q[lo : lo + step] ** 2).sum(1)
            square = (-2 * some) @ ref.T
            square += length
            if exclude_self:
                order = np.argsort(ref_ids, kind="stable")
                first, last = (np.searchsorted(ref_ids[order], q_ids[lo : lo + step], side=x) for x in ("left", "right"))
                for i in np.flatnonzero(last > first):
                    square[i, order[first[i] : last[i]]] = np.inf
            reach = held[lo : lo + step].copy()
            new = np.flatnonzero(~np.isfinite(reach))
            if len(new):
                at = min(k, len(ref_ids)) - 1
                reach[new] = np.partition(square[new], at, 1)[:, at] + own[new]
            # all that may be as near as the k-th, rounding included
            reach += 1e-9 * (1 + own + length.max()) - own
            who, which = np.nonzero(square <= reach[:, None])
            some_there = np.isfinite(square[who, which])
            who, which = who[some_there], which[some_there]
            for cut in range(0, len(who), 1 << 16):
                w, r = who[cut : cut + (1 << 16)], which[cut : cut + (1 << 16)]
                parts.append((w + lo, np.sqrt(((some[w] - ref[r]) ** 2).sum(1)), ref_ids[r]))
        return first_k(*(np.concatenate([p[i] for p in parts]) for i in range(3)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        now, asked, ids, held, best = None, [], [], [], none

        def flush():
            nonlocal best, asked, ids
            if held and asked:
                asked, ids = [np.concatenate(asked)], [np.concatenate(ids)]
                best = merge(asked[0], ids[0], best, np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            held.clear()

        def close():
            flush()
            if len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(ids[0][best[0]]), pa.array(best[2]), pa.array(best[1])], ["id", "ref_id", "dist"])

        for batch in batches:
            tile, is_row = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((tile[1:] != tile[:-1]) | (is_row[1:] != is_row[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(tile)]):
                if hi == lo:
                    continue
                if tile[lo] != now and now is not None:
                    yield from close()
                    asked, ids, best = [], [], none
                now = tile[lo]
                part = batch.slice(lo, hi - lo)
                names, x = part.column(2).to_numpy(), _matrix(part.column(3))
                if is_row[lo]:
                    held.append((names, x))
                    if sum(len(y) for y, _ in held) >= 4096:
                        flush()
                else:
                    asked.append(x)
                    ids.append(names)
        if now is not None:
            yield from close()

    return run


def knn_join(query: DataFrame, reference: DataFrame, id: str, vector: str = "vector", k: int = 5, exclude_self: bool = True, block: int = 1 << 14, group: int = 1 << 17, pivot_rows: int = PIVOT_ROWS) -> DataFrame:
    """(id, ref_id, dist, rank): the k nearest reference rows by Euclidean distance, exact, ties (nine digits) to the smaller id.

    Pivots, a bounded sample of reference rows, cut the space into cells. A cell's queries find k rows no farther than
    their distance to the pivot and that of a cell's k + 1 first rows to theirs, so by the triangle inequality a row
    whose distance to the pivot is larger than both together can be left out. What is left meets the queries of
    neighbouring cells in blocks and groups of bounded expected size, a pair of them a task, that streams the rows through matrix products.
    Rows are thus sent once for each block that they may matter to: where the vectors form clusters, to a few; where they
    do not, to all, and every query is compared with every row, as any exact search has to. k rows a query and group are then ranked.
    """
    spark = query.sparkSession
    narrow = lambda df: df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter("id is not null and vector is not null")
    asked, given = narrow(query), narrow(reference)
    n = given.count()
    m = max(1, min(PIVOTS, n // pivot_rows))
    found = given.sample(False, min(1.0, 8 * m / max(n, 1)), 7).select("vector").limit(8 * m).collect() or given.select("vector").limit(1).collect()  # bounded
    if not found:
        return given.select(F.col("id").alias(id), F.col("id").alias("ref_id"), F.lit(0.0).alias("dist"), F.lit(1).alias("rank"))  # no rows
    pivots = np.unique(np.array([r[0] for r in found], float).reshape(len(found), -1), axis=0)
    pivots = pivots[np.random.default_rng(7).permutation(len(pivots))[:m]]
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _to_points(_matrix(batch.column(1)), shared.value) if len(shared.value) else np.zeros((batch.num_rows, 1))
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["id", "vector", "pivot", "far"])

    placed = lambda df, name: written(df.mapInArrow(assign, "id long, vector array<double>, pivot int, far double"), name)
    asked, given = placed(asked, "knn_queries"), placed(given, "knn_rows")
    place = F.row_number().over(W.partitionBy("pivot").orderBy("far"))
    near = given.select("pivot", "far").withColumn("n", place).filter(F.col("n") <= k + 1).groupBy("pivot").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n"))
    # a row a pivot each
    kth = np.full(len(pivots), np.inf)
    for r in near.collect():
        kth[r["pivot"]] = r["far"] if r["n"] > k else np.inf
    cells = {r["pivot"]: (r["far"], r["n"]) for r in asked.groupBy("pivot").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
    between = _to_points(pivots, pivots) if len(pivots) else np.zeros((0, 0))
    slack = 1e-6 * (1 + float(np.abs(pivots).max(initial=0)))
    about = max(1, -(-sum(count for _, count in cells.values()) // block))  # blocks; with few of them rows are cut finer, for all cores to have work
    groups = max(1, -(-n // group), -(-2 * spark.sparkContext.defaultParallelism // about) if n > PIVOT_ROWS else 1)
    tiles, reach, first, blocks = 0, {}, {}, []
    centred = pivots - pivots.mean(0)
    along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0] if pivots.shape[1] else np.zeros(len(pivots))
    held = block
    for c in sorted(cells, key=lambda c: (along[c], c)):
        # cells beside each other share a block as long as it has room; one with more queries has several blocks
        far, count = cells[c]
        reach[c] = (2 * far + float((between[c] + kth).min())) * (1 + 1e-9) + slack
        if held + count > block:
            blocks.append(([], tiles, max(1, -(-count // block))))
            tiles, held = tiles + blocks[-1][2] * groups, 0
        blocks[-1][0].append(c)
        first[c], held = blocks[-1][1:], held + count
    plan = spark.sparkContext.broadcast((reach, blocks))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach, blocks = plan.value
        for batch in batches:
            d = _to_points(_matrix(batch.column(1)), shared.value)
            g = batch.column(2).to_numpy()
            for of, start, many in blocks:
                rows = np.flatnonzero((d[:, of] <= np.array([reach[c] for c in of])).any(1))
                for b in range(many if len(rows) else 0):
                    tile = start + b * groups + g[rows]
                    yield pa.RecordBatch.from_arrays([pa.array(tile.astype(np.int32)), pa.array(np.ones(len(rows), bool)), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows))], ["tile", "is_row", "id", "vector"])

    # groups and blocks are salted by the partition a row comes from, so that repeated rows are spread
    of = lambda n: F.pmod(F.xxhash64("id") + F.spark_partition_id() * F.lit(0x9E3779B1), n).cast("int")
    b = given.select("id", "vector", of(F.lit(groups)).alias("g")).mapInArrow(spread, "tile int, is_row boolean, id long, vector array<double>")
    start, many = (F.get(F.lit([first.get(c, (0, 1))[i] for c in range(len(pivots))] or [1]), F.col("pivot")) for i in (0, 1))
    a = asked.select(start.alias("start"), of(many).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "id", "vector")
    a = a.select((F.col("start") + F.col("b") * groups + F.col("g")).cast("int").alias("tile"), F.lit(False).alias("is_row"), "id", "vector")
    parts = max(1, min(tiles, 64 * spark.sparkContext.defaultParallelism))
    met = a.unionByName(b).repartitionById(parts, F.pmod("tile", F.lit(parts)).cast("int")).sortWithinPartitions("tile", "is_row")
    found = met.mapInArrow(_nearest(k, exclude_self), "id long, ref_id long, dist double")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.round("dist", 9), "ref_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).withColumnRenamed("id", id)


def oof_distance(rows: DataFrame, fold: str, features: list[str], id: str, k: int = 5) -> DataFrame:
    """M7 out of fold: (id, knn_dist) of each row to the training rows of the fold that did not see it, standardised by those.

    Folds are a handful; null features take the training rows' median.
    """
    def fit(train):
        stats, _ = fit_novelty(train, features, id, rows=1)
        return stats, standardise(train, stats, features, id)

    def predict(model, test):
        stats, reference = model
        return novelty_distance(knn_join(standardise(test, stats, features, id), reference, id, k=k, exclude_self=False), id)

    return oof(rows, fold, fit, predict)


def novelty_distance(neighbours: DataFrame, id: str) -> DataFrame:
    """(id, knn_dist): mean distance to the neighbours."""
    return neighbours.groupBy(id).agg(F.avg("dist").alias("knn_dist"))


def assess_novelty(df: DataFrame, tau_d: float, tau_p: float) -> DataFrame:
    """Adds abstain: far from all reference rows, OTHER likely, or too unsure with two top labels that are no look-alikes.

    df: (knn_dist, p1, p_other, twin_set).
    """
    unsure = (F.col("p1") < tau_p) & F.col("twin_set").isNull()
    return df.withColumn("abstain", (F.col("knn_dist") > tau_d) | (F.col("p_other") >= C.NOVEL_P_OTHER) | unsure)


def nearest_description(rows: DataFrame, anchors: DataFrame, vector: str = "vector") -> DataFrame:
    """(id, label, cosine, rank) of each row against every label's anchor, which are few. anchors: (label, vector)."""
    norm = lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)))
    every = anchors.agg(F.collect_list(F.struct("label", norm(F.col(vector)).alias("a"))).alias("anchors")).scalar()
    r = rows.select("id", norm(F.col(vector)).alias("v"), every.alias("anchors")).select("id", "v", F.inline("anchors"))
    cos = F.aggregate(F.zip_with("v", "a", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    r = r.select("id", "label", cos.alias("cosine"))
    return r.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc(F.round("cosine", 12)), "label")))


def projection(rows: DataFrame, features: list[str], id: str, label: str) -> DataFrame:
    """Q9: two principal components (median for null, standardised): (id, label, pc1, pc2)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    stats, _ = fit_novelty(rows, features, id, rows=1)
    z = standardise(rows, stats, features, id).withColumn("v", array_to_vector("vector"))
    out = PCA(k=2, inputCol="v", outputCol="pc").fit(z).transform(z).select(id, vector_to_array("pc").alias("pc"))
    return out.join(rows.select(id, label), id).select(id, label, F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))


def silhouette(points: DataFrame, label: str) -> float:
    """Mean silhouette by squared Euclidean distance of (label, pc1, pc2)."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    v = VectorAssembler(inputCols=["pc1", "pc2"], outputCol="features").transform(points)
    v = StringIndexer(inputCol=label, outputCol="prediction").fit(v).transform(v)
    return ClusteringEvaluator().evaluate(v)


def check_projection(rows: DataFrame, features: list[str], id: str, label: str, limit: float = C.SILHOUETTE_LIMIT) -> DataFrame:
    """Q9: (rule_id, status, key, value): the silhouette of the labels on two components, which fails from the limit on, and how often a row's nearest neighbour has its label.

    rows: one for each hash.
    """
    flat = silhouette(projection(rows, features, id, label), label)
    stats, _ = fit_novelty(rows, features, id, rows=1)
    z = standardise(rows, stats, features, id)
    near = knn_join(z, z, id, k=1).join(rows.select(id, F.col(label).alias("__a")), id).join(rows.select(F.col(id).alias("ref_id"), F.col(label).alias("__b")), "ref_id")
    share = near.agg(F.avg((F.col("__a") == F.col("__b")).cast("double")).alias("value"))
    first = rows.sparkSession.createDataFrame([("Q9", "FAIL" if flat >= limit else "PASS", "silhouette", float(flat))], "rule_id string, status string, key string, value double")
    return first.unionByName(share.select(F.lit("Q9").alias("rule_id"), F.lit("PASS").alias("status"), F.lit("one_nn").alias("key"), "value"))
