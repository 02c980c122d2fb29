"""Evaluation of predictions: confusion, scores, calibration, rank statistics, bootstrap intervals, slices and audits.

Predictions are rows (id, truth, pred, conf, ...); grouped results are built from sufficient statistics, so that their
cost after one aggregation does not depend on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.columns import softmax
from .shared import running


def confusion(pred: DataFrame, by=()) -> DataFrame:
    """(by…, truth, pred, n, share): share of a truth's rows."""
    n = pred.groupBy(*by, "truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by, "truth")))


def row_stochastic(pred: DataFrame, labels: list[str]) -> DataFrame:
    """(truth, pred, p): the share of each prediction for each truth over all labels; a label without rows stands for itself."""
    grid = pred.sparkSession.createDataFrame([(x,) for x in labels], "truth string")
    grid = grid.crossJoin(grid.withColumnRenamed("truth", "pred"))  # a vocabulary by itself
    n = confusion(pred).select("truth", "pred", "share")
    rows = grid.join(n, ["truth", "pred"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    none = F.sum("share").over(W.partitionBy("truth")) == 0
    return rows.select("truth", "pred", F.when(none, (F.col("truth") == F.col("pred")).cast("double")).otherwise(F.col("share")).alias("p"))


def soft_truth(pred: DataFrame) -> DataFrame:
    """truths MAP label to mass: a prediction that names one with mass counts as that one, else as the heaviest (ties by name)."""
    heavy = F.element_at(F.array_sort(F.transform(F.map_entries("truths"), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), 1)["k"]
    return pred.withColumn("truth", F.when(F.coalesce(F.element_at("truths", F.col("pred")), F.lit(0.0)) > 0, F.col("pred")).otherwise(heavy))


def prf(pred: DataFrame, by=()) -> DataFrame:
    """(by…, class, precision, recall, f1, support, predicted); 0 where a denominator is 0."""
    cells = pred.groupBy(*by, "truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    t = cells.select(*by, F.col("truth").alias("class"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), hit.alias("tp"))
    p = cells.select(*by, F.col("pred").alias("class"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp"))
    c = t.unionByName(p).groupBy(*by, "class").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return c.select(*by, "class", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"), "support", "predicted")


def macro_f1(pred: DataFrame, by=(), mode: str = "truth") -> DataFrame:
    """(by…, macro_f1, macro_recall, accuracy). mode: labels of the truth, or all labels seen."""
    rows = prf(pred, by)
    use = F.col("support") > 0 if mode == "truth" else F.lit(True)
    own = rows.groupBy(*by).agg(F.avg(F.when(use, F.col("f1"))).alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("macro_recall"), (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"))
    return own


def calibration(logits: DataFrame, t: float = 1.0, vector: str = "logits", y: str = "y") -> DataFrame:
    """One row: nll, brier, ece of softmax(logits / t); y is the index of the truth."""
    b = _bins(_calibrated(logits, t, vector, y))
    total = F.sum("count")
    return b.agg((F.sum("nll") / total).alias("nll"), (F.sum("brier") / total).alias("brier"), (F.sum(F.abs(F.col("hits") - F.col("conf"))) / total).alias("ece"))


def _calibrated(logits, t, vector, y):
    rows = logits.select(softmax(F.col(vector), t).alias("p"), F.col(y).alias("y"))
    truth = F.get("p", F.col("y"))
    square = F.aggregate("p", F.lit(0.0), lambda a, x: a + x * x)
    return rows.select(F.array_max("p").alias("conf"), (F.array_position("p", F.array_max("p")) - 1 == F.col("y")).cast("int").alias("hit"), (-F.log(F.greatest(truth, F.lit(1e-12)))).alias("nll"), (square - 2 * truth + 1).alias("brier"))


def _bins(rows):
    # a confidence on an edge belongs to the bin above, 1 to the last
    edges = [i / C.BINS for i in range(1, C.BINS)]
    at = sum(((F.col("conf") >= e).cast("int") for e in edges[1:]), (F.col("conf") >= edges[0]).cast("int"))
    return rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.sum("conf").alias("conf"), F.sum("hit").alias("hits"), F.sum("nll").alias("nll"), F.sum("brier").alias("brier"))


def reliability(logits: DataFrame, t: float = 1.0, vector: str = "logits", y: str = "y") -> DataFrame:
    """(bin, lo, hi, count, confidence, accuracy) of the bins that have rows."""
    b = _bins(_calibrated(logits, t, vector, y))
    return b.select("bin", (F.col("bin") / C.BINS).alias("lo"), ((F.col("bin") + 1) / C.BINS).alias("hi"), "count", (F.col("conf") / F.col("count")).alias("confidence"), (F.col("hits") / F.col("count")).alias("accuracy"))


def fit_temperature(logits: DataFrame, vector: str = "logits", y: str = "y", steps: int = 19, rounds: int = 3) -> float:
    """The temperature with the least mean NLL: a grid over the bounds in one pass, narrowed round by round."""
    lo, hi = C.T_LOW, C.T_HIGH
    for _ in range(rounds):
        grid = [lo + (hi - lo) * i / (steps - 1) for i in range(steps)]
        p = lambda t: -F.log(F.greatest(F.get(softmax(F.col(vector), t), F.col(y)), F.lit(1e-12)))
        got = logits.agg(*[F.avg(p(t)).alias(f"t{i}") for i, t in enumerate(grid)]).first()
        best = min(range(steps), key=lambda i: (got[i], i))
        lo, hi = grid[max(0, best - 1)], grid[min(steps - 1, best + 1)]
    return (lo + hi) / 2


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two columns of ratings: (n, observed, expected, kappa)."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    n = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    m = cells.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("x")).join(cells.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("y")), "k")
    both = m.agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    out = n.withColumn("xy", F.coalesce(both.scalar(), F.lit(0)))
    po, pe = F.col("same") / F.col("n"), F.col("xy") / (F.col("n") * F.col("n"))
    return out.select("n", po.alias("observed"), pe.alias("expected"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0).alias("kappa"))


def auroc(df: DataFrame, score: str, y: str, by=()) -> DataFrame:
    """(by…, auroc, n): from rank sums over distinct scores, ties at half; null with one class; non-finite scores go."""
    ok = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf"))
    cells = df.filter(ok).groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("neg"))
    upto = running(cells, "s", by, upto="neg")
    cells = upto.withColumn("below", F.col("upto") - F.col("neg"))
    out = cells.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return out.select(*by, F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("u") / (F.col("p") * F.col("q"))).alias("auroc"), (F.col("p") + F.col("q")).alias("n"))


def draws(clusters: DataFrame, cluster: str, reps: int, seed: int) -> DataFrame:
    """(rep, cluster, w): how often each replicate draws each cluster, from hashes of (rep, pick).

    The clusters are numbered in their order; there are as many picks as clusters, and reps times as many rows.
    """
    names = clusters.select(cluster).distinct().withColumn("__one", F.lit(1).cast("long"))
    numbered = running(names, cluster, __k="__one").select(cluster, (F.col("__k") - 1).alias("k"))
    n = numbered.agg(F.count(F.lit(1)).alias("n")).scalar()
    picks = numbered.select(F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"), "k", n.alias("n"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "rep", F.col("k").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("n")
    return picks.select("rep", pick.alias("k")).groupBy("rep", "k").agg(F.count(F.lit(1)).alias("w")).join(numbered, "k").select("rep", cluster, "w")


def draw_vectors(clusters: DataFrame, cluster: str, reps: int, seed: int) -> DataFrame:
    """(cluster, w): how often each replicate draws a cluster, as an array over the replicates; clusters that none draws are left out."""
    by = draws(clusters, cluster, reps, seed).groupBy(cluster).agg(F.map_from_entries(F.collect_list(F.struct("rep", F.col("w").cast("double")))).alias("m"))  # `reps` at most
    return by.select(cluster, F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), lambda r: F.coalesce(F.try_element_at("m", r), F.lit(0.0))).alias("w"))


def _weighted(w: str, value: Column) -> Column:
    """An array of weights times a value (null as 0), as a vector to add up."""
    from pyspark.ml.functions import array_to_vector

    x = F.coalesce(value.cast("double"), F.lit(0.0))
    return array_to_vector(F.transform(w, lambda c: c * x))


def _replicates(rows: DataFrame, sums: list[str], statistic: Column) -> DataFrame:
    """(s) for each replicate: a statistic of sums that are weighted by the array w, added up as vectors: a row is never repeated."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    total = rows.agg(*[vector_to_array(Summarizer.sum(_weighted("w", F.col(k)))).alias(k) for k in sums])
    return total.select(F.inline(F.arrays_zip(*sums))).select(statistic.alias("s"))


def cluster_bootstrap(df: DataFrame, cluster: str, sums: dict[str, Column], statistic: Column, reps: int = 200, seed: int = 42) -> DataFrame:
    """(estimate, lo, hi, n, n_clusters, valid) of a statistic of sums, whole clusters drawn again.

    sums: named aggregates of the rows; statistic: an expression of their names. Undefined draws are left out; with
    fewer than MIN_DRAWS others there is no interval. Each cluster has an array of its weights in the replicates.
    """
    cells = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(v).alias(k) for k, v in sums.items()])
    point = cells.agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("n_clusters"), *[F.sum(k).alias(k) for k in sums]).select("n", "n_clusters", statistic.alias("estimate"))
    each = _replicates(cells.join(draw_vectors(cells, cluster, reps, seed), cluster), list(sums), statistic)
    ends = each.agg(F.percentile("s", F.lit(0.025)).alias("lo"), F.percentile("s", F.lit(0.975)).alias("hi"), F.count("s").alias("valid"))
    return _interval(point, ends)


def _interval(point: DataFrame, ends: DataFrame) -> DataFrame:
    """point with lo, hi and valid of the draws; null ends where too few draws are defined."""
    enough = lambda c: ends.select(F.when(F.col("valid") >= C.MIN_DRAWS, F.col(c))).scalar().alias(c)
    return point.select("*", enough("lo"), enough("hi"), ends.select("valid").scalar().alias("valid"))


def mean_intervals(rows: DataFrame, by: str, values: dict[str, Column], cluster: str, whole: str | None = None, reps: int = 200, seed: int = 42) -> DataFrame:
    """(by, n, n_clusters, for each value its mean, …_lo and …_hi, valid): means with intervals, whole clusters drawn again.

    A draw weights the sums by (by, cluster), of which there is one row each; it counts where it has rows of the group,
    and fewer than MIN_DRAWS of these give no interval. whole: the name of a group of all rows.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    sums = ["__n", *values]
    cells = rows.groupBy(by, F.col(cluster).alias("__c")).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(v.cast("double")).alias(k) for k, v in values.items()])
    if whole is not None:
        cells = cells.unionByName(cells.groupBy("__c").agg(*[F.sum(k).alias(k) for k in sums]).withColumn(by, F.lit(whole)))
    weighed = cells.join(draw_vectors(cells, "__c", reps, seed), "__c")
    total = weighed.groupBy(by).agg(*[vector_to_array(Summarizer.sum(_weighted("w", F.col(k)))).alias(k) for k in sums])
    drawn = F.col("__n") > 0
    each = total.select(by, F.inline(F.arrays_zip(*sums))).select(by, drawn.alias("drawn"), *[F.when(drawn, F.col(k) / F.col("__n")).alias(k) for k in values])
    ends = each.groupBy(by).agg(F.count_if("drawn").alias("valid"), *[F.percentile(k, F.lit(q)).alias(k + end) for k in values for q, end in ((0.025, "_lo"), (0.975, "_hi"))])
    point = cells.groupBy(by).agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("n_clusters"), *[(F.sum(k) / F.sum("__n")).alias(k) for k in values])
    enough = lambda c: F.when(F.col("valid") >= C.MIN_DRAWS, F.col(c)).alias(c)
    own = [c for k in values for c in (F.col(k), enough(k + "_lo"), enough(k + "_hi"))]
    return point.join(ends, by, "left").select(by, "n", "n_clusters", *own, F.coalesce("valid", F.lit(0)).cast("long").alias("valid"))


def _range_ranks(reps: int):
    """Sorted rows (s, pos, neg) of a range to its least score, its share of each replicate's U, and its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, u, p, q = None, *(np.zeros(reps) for _ in range(3))
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, neg = (batch.column(i).flatten().to_numpy().reshape(-1, reps) for i in (1, 2))
            least = batch.column(0)[0].as_py() if least is None else least
            below = q + np.cumsum(neg, 0) - neg
            u, p, q = u + (pos * (below + neg / 2)).sum(0), p + pos.sum(0), q + neg.sum(0)
        if least is not None:
            yield pa.RecordBatch.from_arrays([pa.array([float(least)]), *(pa.array([x.tolist()]) for x in (u, p, q))], ["least", "u", "p", "q"])

    return run


def auroc_interval(df: DataFrame, cluster: str, score: str, y: str, reps: int = 200, seed: int = 42) -> DataFrame:
    """(estimate, lo, hi, n, n_clusters, valid) of the AUROC, whole clusters drawn again.

    The rows are counted by cluster, score and class once; each distinct score has arrays of its counts in the draws.
    Scores are cut into ranges, each of which is ranked in itself; together with the counts below it that is the whole.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    ok = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf"))
    cells = df.filter(ok).groupBy(cluster, F.col(score).alias("s")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("neg"))
    both = cells.join(draw_vectors(cells, cluster, reps, seed), cluster).groupBy("s").agg(*[vector_to_array(Summarizer.sum(_weighted("w", F.col(c)))).alias(c) for c in ("pos", "neg")])
    parts = both.select("s", "pos", "neg").repartitionByRange("s").sortWithinPartitions("s").mapInArrow(_range_ranks(reps), "least double, u array<double>, p array<double>, q array<double>").collect()  # a row a range
    u, p, q = (np.zeros(reps) for _ in range(3))
    for r in sorted(parts, key=lambda r: r["least"]):
        own = np.array(r["p"])
        u, p, q = u + np.array(r["u"]) + own * q, p + own, q + np.array(r["q"])
    ok = (p > 0) & (q > 0)
    each = df.sparkSession.createDataFrame([(float(x),) for x in u[ok] / (p[ok] * q[ok])], "s double")  # the replicates
    ends = each.agg(F.percentile("s", F.lit(0.025)).alias("lo"), F.percentile("s", F.lit(0.975)).alias("hi"), F.count("s").alias("valid"))
    point = auroc(df, score, y).select(F.col("auroc").alias("estimate"), "n", F.lit(None).cast("long").alias("n_clusters")).withColumn("n_clusters", df.agg(F.countDistinct(cluster)).scalar())
    return _interval(point, ends)


#: The distribution function of a Poisson variable of mean 1 at 0 to 6.
POISSON = [0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815, 0.999916759]


def bootstrap(df: DataFrame, id: str, sums: dict[str, Column], statistic: Column, reps: int = 200, seed: int = 42) -> DataFrame:
    """(estimate, lo, hi, n, valid) of a statistic of sums over rows drawn again.

    Each row's weight in a replicate is Poisson, by a hash of (seed, replicate, id), in an array over the replicates: rows
    are not repeated, numbered or shuffled, only the vectors of sums are.
    """
    def weight(rep):
        u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), rep.cast("string"), F.col("__id"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
        return F.array_position(F.transform(F.lit([*POISSON, 2.0]), lambda t: u < t), True) - 1

    rows = df.select(F.col(id).cast("string").alias("__id"), *[v.alias(k) for k, v in sums.items()])
    w = F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), lambda r: weight(r).cast("double"))
    each = _replicates(rows.withColumn("w", w), list(sums), statistic)
    ends = each.agg(F.percentile("s", F.lit(0.025)).alias("lo"), F.percentile("s", F.lit(0.975)).alias("hi"), F.count("s").alias("valid"))
    point = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in sums]).select("n", statistic.alias("estimate"))
    return _interval(point, ends)


def t_interval(df: DataFrame, value: str, by) -> DataFrame:
    """(by…, mean, lo, hi, n) over seeds with Student's 97.5 % point; nulls left out; one value is a point."""
    q = F.array(*map(F.lit, T_975))
    s = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    half = F.when(F.col("n") > 1, F.get(q, F.least(F.col("n") - 2, F.lit(len(T_975) - 1)).cast("int")) * F.col("sd") / F.sqrt("n")).otherwise(0.0)
    return s.select(*by, "mean", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"), "n")


#: 97.5 % points of Student's distribution for 1 to 30 degrees of freedom, then the normal one's.
T_975 = [12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139, 2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963, 2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272, 1.959964]


def risk_coverage(df: DataFrame, distance: str, wrong: str, coverages=tuple(i / 10 for i in range(1, 11))) -> DataFrame:
    """(coverage, rows, risk): mean of `wrong` among the rows nearest by distance.

    Rows are counted by distinct distance first, so that what is ordered has a row for each distance.
    """
    cells = df.groupBy(F.col(distance).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum(wrong).alias("w"))
    cells = running(cells, "d", upto="n", bad="w").withColumn("total", cells.agg(F.sum("n")).scalar())
    at = cells.select("*", F.explode(F.array(*map(F.lit, coverages))).alias("coverage")).withColumn("k", F.greatest(F.lit(1), F.round(F.col("coverage") * F.col("total"))))
    # the border group counts by the share of it that is taken
    inside = at.filter((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))
    risk = (F.col("bad") - F.col("w") + F.col("w") / F.col("n") * (F.col("k") - (F.col("upto") - F.col("n")))) / F.col("k")
    return inside.select("coverage", F.col("k").cast("long").alias("rows"), risk.alias("risk"))


def abstain_report(df: DataFrame, abstain: str, foreign: str, wrong: str) -> DataFrame:
    """One row: how often rows are abstained from, the share of those that were foreign or wrong, and of foreign rows that are caught."""
    out, bad = F.col(abstain), F.col(foreign) | F.col(wrong)
    mean = lambda hit, of: F.avg(F.when(of, hit.cast("double")))
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(out.cast("double")).alias("abstained"), mean(bad, out).alias("abstain_precision"), mean(out, F.col(foreign)).alias("foreign_caught"), mean(F.col(wrong), ~out & ~F.col(foreign)).alias("risk_kept"))


def threshold_on_grid(df: DataFrame, conf: str, hit: str, precision: float = C.READER_PRECISION, grid=tuple(round(0.05 + i / 100, 2) for i in range(91))) -> DataFrame:
    """One row: the least value of the grid from which on precision holds, else the grid's last."""
    cells = df.groupBy(F.least(F.floor(F.round((F.col(conf) - grid[0]) / F.lit(round(grid[1] - grid[0], 6)), 9)), F.lit(len(grid) - 1)).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("h"))
    top = W.partitionBy(F.lit(0)).orderBy(F.desc("k"))  # a row for each value of the grid
    cells = cells.withColumns({"n": F.sum("n").over(top), "h": F.sum("h").over(top)}).filter("k >= 0 and k is not null")
    # the first value that takes in the same rows as the least cell that holds
    held = cells.filter(F.col("h") / F.col("n") >= precision)
    before = F.coalesce(F.max("k").over(W.partitionBy(F.lit(0)).orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(-1)) + 1
    first = cells.withColumn("from", before).join(held.select("k"), "k", "left_semi").agg(F.min("from").alias("k"))
    return first.select(F.coalesce(F.get(F.array(*map(F.lit, grid)), F.col("k").cast("int")), F.lit(grid[-1])).alias("tau"))


def threshold_at_precision(df: DataFrame, conf: str, hit: str, precision: float = C.READER_PRECISION, accepted: int = C.READER_ACCEPTED, digits: int = 2) -> DataFrame:
    """One row: the least rounded confidence from which on precision holds with enough rows, else the value for never."""
    cells = df.groupBy(F.round(conf, digits).alias("tau")).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("h"))
    top = W.partitionBy(F.lit(0)).orderBy(F.desc("tau"))
    cells = cells.withColumns({"n": F.sum("n").over(top), "h": F.sum("h").over(top)})
    return cells.agg(F.coalesce(F.min(F.when((F.col("n") >= accepted) & (F.col("h") / F.col("n") >= precision), F.col("tau"))), F.lit(C.READER_NEVER)).alias("tau"))


def tau_d(df: DataFrame, distance: str, q: float = 0.99) -> DataFrame:
    """The exact percentile of a distance, linear between values; NaN left out."""
    return df.filter(~F.isnan(distance)).agg(F.percentile(distance, F.lit(q)).alias("tau_d"))


def twin_accuracy(df: DataFrame, pairs: dict = C.TWIN_SETS) -> DataFrame:
    """(twin_set, n, accuracy) for rows whose truth is in a pair: p of the truth above that of its twin, ties by label order.

    df: (id, truth, probs MAP).
    """
    cells = [F.struct(F.lit(k).alias("twin_set"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in pairs.items()]
    rows = df.select("truth", "probs", F.inline(F.array(*cells))).filter((F.col("truth") == F.col("a")) | (F.col("truth") == F.col("b")))
    p = lambda c: F.coalesce(F.element_at("probs", F.col(c)), F.lit(0.0))
    right = F.when(F.col("truth") == F.col("a"), p("a") >= p("b")).otherwise(p("b") > p("a"))
    return rows.groupBy("twin_set").agg(F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"))


def twin_summary(sets: DataFrame) -> DataFrame:
    """One row of twin_accuracy's sets: (n, mean_of_sets, micro)."""
    return sets.agg(F.sum("n").alias("n"), F.avg("accuracy").alias("mean_of_sets"), (F.sum(F.col("n") * F.col("accuracy")) / F.sum("n")).alias("micro"))


def answer_rate(pred: DataFrame, by=()) -> DataFrame:
    """(by…, n, answer_rate, right_when_answers): a null prediction is no answer."""
    spoke = F.col("pred").isNotNull()
    return pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(spoke.cast("double")).alias("answer_rate"), F.avg(F.when(spoke, (F.col("pred") == F.col("truth")).cast("double"))).alias("right_when_answers"))


def topk_accuracy(df: DataFrame, ks=(1, 3)) -> DataFrame:
    """df: (id, truth, label, p) to (k, accuracy, n): share of rows whose truth is among the k most probable labels."""
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("p"), "label"))
    r = df.withColumn("rank", rank).filter("label = truth")
    n = df.select("id").distinct().count()
    return r.select("id", "rank", F.explode(F.array(*map(F.lit, ks))).alias("k")).groupBy("k").agg((F.sum((F.col("rank") <= F.col("k")).cast("int")) / n).alias("accuracy"), F.lit(n).cast("long").alias("n"))


def slice_report(pred: DataFrame, slices: list[str]) -> DataFrame:
    """(slice, value, n, accuracy) for each value of each slice, in one pass."""
    each = F.array(*[F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in slices])
    return pred.select(F.inline(each), (F.col("truth") == F.col("pred")).cast("double").alias("hit")).groupBy("slice", "value").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("accuracy"))


def slice_intervals(pred: DataFrame, slices: list[str], cluster: str, reps: int = 200, seed: int = 42) -> DataFrame:
    """(slice, value, n, accuracy, lo, hi, valid): slice_report with intervals, whole clusters drawn again in each slice.

    A draw weights the clusters' counts, of which there is a row for each slice value and cluster.
    """
    each = F.array(*[F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in slices])
    hit = (F.col("truth") == F.col("pred")).cast("double")
    cells = pred.select(F.inline(each), F.col(cluster).alias("__c"), hit.alias("hit")).groupBy("slice", "value", "__c").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("h"))
    rows = draws(cells, "__c", reps, seed).join(cells, "__c").groupBy("slice", "value", "rep").agg((F.sum(F.col("h") * F.col("w")) / F.sum(F.col("n") * F.col("w"))).alias("s"))
    ends = rows.groupBy("slice", "value").agg(F.percentile("s", F.lit(0.025)).alias("lo"), F.percentile("s", F.lit(0.975)).alias("hi"), F.count("s").alias("valid"))
    point = cells.groupBy("slice", "value").agg(F.sum("n").alias("n"), (F.sum("h") / F.sum("n")).alias("accuracy"))
    enough = lambda c: F.when(F.col("valid") >= C.MIN_DRAWS, F.col(c)).alias(c)
    return point.join(ends, ["slice", "value"], "left").select("slice", "value", "n", "accuracy", enough("lo"), enough("hi"), F.coalesce("valid", F.lit(0)).cast("long").alias("valid"))


def rejection_report(pred: DataFrame) -> DataFrame:
    """(status, n, share, mean_conf) over out-of-domain rows; status unsure, matched or correct_reasoning."""
    n = pred.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean_conf"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))).select("status", "n", "share", "mean_conf")


def rejection_by_grade(pred: DataFrame, grade: str, least: float = 4.0) -> DataFrame:
    """(graded, n, unsure, matched_wrongly) of out-of-domain rows with a grade of `least` or more, and of those under it; rows without one are left out."""
    share = lambda s: F.avg((F.col("status") == s).cast("double"))
    rows = pred.filter(F.col(grade).isNotNull() & ~F.isnan(F.col(grade).cast("double")))
    return rows.groupBy(F.when(F.col(grade) >= least, "or_more").otherwise("under").alias("graded")).agg(F.count(F.lit(1)).alias("n"), share("unsure").alias("unsure"), share("matched").alias("matched_wrongly"))


def rejection_errors(pred: DataFrame, k: int = 5) -> DataFrame:
    """The k classes that out-of-domain rows are most often matched to: (pred, n, rank); ties by name."""
    n = pred.filter("status = 'matched'").groupBy("pred").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "pred").limit(k).withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("n"), "pred")))


def top_confusions(pred: DataFrame, k: int = 10) -> DataFrame:
    """(truth, pred, n, rank) of the k most frequent mistakes; ties by name."""
    n = pred.filter("truth <> pred").groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "truth", "pred").limit(k).withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("n"), "truth", "pred")))


def failure_audit(pred: DataFrame, by: list[str], conf: float = C.AUDIT_CONFIDENCE) -> DataFrame:
    """Sure mistakes clustered: (by…, truth, pred, n, first_id)."""
    return pred.filter((F.col("truth") != F.col("pred")) & (F.col("conf") >= conf)).groupBy(*by, "truth", "pred").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def failure_members(pred: DataFrame, by: list[str], conf: float = C.AUDIT_CONFIDENCE) -> DataFrame:
    """(by…, truth, pred, n, id): the rows of each of failure_audit's clusters, one each, beside the cluster's size."""
    key = [*by, "truth", "pred"]
    rows = pred.filter((F.col("truth") != F.col("pred")) & (F.col("conf") >= conf)).select(*key, "id")
    n = rows.groupBy(*[F.col(k).alias("__" + k) for k in key]).agg(F.count(F.lit(1)).alias("n"))
    same = [F.col(k).eqNullSafe(F.col("__" + k)) for k in key]  # a null in the cluster's columns is a value
    return rows.join(n, same).select(*key, "n", "id")


def robustness(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rewrite, n, unchanged, acc_before, acc_after) of pairs (id) of which the rewrite keeps the behaviour."""
    rows = before.select("id", "truth", F.col("pred").alias("b")).join(after.filter("keeps").select("id", "rewrite", F.col("pred").alias("a")), "id")
    mean = lambda c: F.avg(c.cast("double"))
    return rows.groupBy("rewrite").agg(F.count(F.lit(1)).alias("n"), mean(F.col("a") == F.col("b")).alias("unchanged"), mean(F.col("b") == F.col("truth")).alias("acc_before"), mean(F.col("a") == F.col("truth")).alias("acc_after"))


def robustness_report(before: DataFrame, after: DataFrame, cluster: str) -> DataFrame:
    """(rewrite, applicable, dropped, n, n_clusters, unchanged, identical, acc_before, acc_after, each with …_lo and …_hi, valid).

    before: (id, truth, pred, cluster); after: (id, rewrite, pred, keeps, identical), identical: the features are those
    of before. Of the applicable pairs those whose rewrite does not keep the behaviour are dropped; a rewrite of which
    none is left has nulls.
    """
    rows = before.select("id", "truth", F.col("pred").alias("b"), cluster).join(after.select("id", "rewrite", F.col("pred").alias("a"), "keeps", "identical"), "id")
    counts = rows.groupBy("rewrite").agg(F.count(F.lit(1)).alias("applicable"), F.count_if(~F.coalesce("keeps", F.lit(False))).alias("dropped"))
    values = {"unchanged": F.col("a") == F.col("b"), "identical": F.col("identical"), "acc_before": F.col("b") == F.col("truth"), "acc_after": F.col("a") == F.col("truth")}
    return counts.join(mean_intervals(rows.filter("keeps"), "rewrite", values, cluster), "rewrite", "left")


def false_alarms(after: DataFrame) -> DataFrame:
    """(rewrite, n, false_alarm): of rewrites that keep a right program's behaviour, the share that is called something else than CORRECT."""
    return after.filter(F.col("keeps") & (F.col("truth") == "CORRECT")).groupBy("rewrite").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("pred") != "CORRECT").cast("double")).alias("false_alarm"))


def metric_table(rows: DataFrame, names: list[str]) -> DataFrame:
    """(name, split, value) to a row for each name with a column for each split of `names`; means over folds."""
    return rows.groupBy("name").pivot("split", names).agg(F.avg("value"))


def fold_stats(rows: DataFrame) -> DataFrame:
    """(name, mean, std): over folds, population deviation."""
    return rows.groupBy("name").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def profile_f1(df: DataFrame) -> DataFrame:
    """df: (id, class, p, truth) to (id, f1, brier): set F1 at one half (two empty sets: 1), mean squared error."""
    on, t = F.col("p") >= 0.5, F.col("truth")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    rows = df.groupBy("id").agg(n(on & t).alias("tp"), n(on).alias("a"), n(t).alias("b"), F.avg(F.pow(F.col("p") - t.cast("double"), F.lit(2))).alias("brier"))
    return rows.select("id", F.when(F.col("a") + F.col("b") == 0, 1.0).otherwise(2 * F.col("tp") / (F.col("a") + F.col("b"))).alias("f1"), "brier")


def policy_outcomes(episodes: DataFrame, by=("type", "policy", "seed")) -> DataFrame:
    """(by…, false_resolve, false_not_yet, items): shares among those that have, or have not, the misconception; null if none."""
    share = lambda hit, of: F.avg(F.when(of, hit.cast("double")))
    return episodes.groupBy(*by).agg(share(F.col("resolved"), F.col("active")).alias("false_resolve"), share(~F.col("resolved"), ~F.col("active")).alias("false_not_yet"), F.avg(F.when(F.col("resolved"), F.col("n_items"))).alias("items"))


def agreement(df: DataFrame, a: str, b: str, by=()) -> DataFrame:
    """(by…, n, covered, agree): rows where both spoke, and how often alike."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(both.cast("double")).alias("covered"), F.avg(F.when(both, (F.col(a) == F.col(b)).cast("double"))).alias("agree"))


def holdout_scores(pred: DataFrame) -> DataFrame:
    """(class_mean, micro, n_classes, n): accuracies by class averaged, and over all rows."""
    by = pred.groupBy("truth").agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("a"), F.count(F.lit(1)).alias("n"))
    return by.agg(F.avg("a").alias("class_mean"), (F.sum(F.col("a") * F.col("n")) / F.sum("n")).alias("micro"), F.count(F.lit(1)).alias("n_classes"), F.sum("n").alias("n"))


def holdout_report(pred: DataFrame, cluster: str, micro: str = "_micro") -> DataFrame:
    """(truth, n, n_clusters, accuracy, primary, each with …_lo and …_hi, valid) of rows of held-out operators, by class and over all rows (`micro`).

    pred: (truth, pred, labels ARRAY, cluster): accuracy takes any of a row's labels, primary its truth alone.
    """
    values = {"accuracy": F.array_contains("labels", F.col("pred")), "primary": F.col("pred") == F.col("truth")}
    return mean_intervals(pred, "truth", values, cluster, micro)


def holdout_skips(rows: DataFrame, labels: list[str], least: int = 2) -> DataFrame:
    """(label, operators, reason): the classes that no operator can be held out of, as they have fewer base operators than `least`.

    rows: (label, op_id), where an op_id with a plus is of two bugs and no base operator.
    """
    dim = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    base = rows.filter(~F.contains("op_id", F.lit("+"))).groupBy("label").agg(F.countDistinct("op_id").alias("operators"))
    n = F.broadcast(dim).join(base, "label", "left").withColumn("operators", F.coalesce("operators", F.lit(0)))
    return n.filter(F.col("operators") < least).withColumn("reason", F.concat(F.col("operators").cast("string"), F.lit(" base operator(s), at least "), F.lit(str(least)), F.lit(" are needed")))


def external_counts(corpus: DataFrame, bank: DataFrame, family: str, key: str) -> DataFrame:
    """(family, n, in_bank, problems) of an outside corpus, and which keys the bank has."""
    known = bank.select(key).distinct().withColumn("known", F.lit(1))
    return corpus.join(known, key, "left").groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("in_bank"), F.countDistinct(key).alias("problems"))


def why_trials(df: DataFrame, *carry: str) -> DataFrame:
    """df: (id, pair, label, truth, p_option, p_text) to (id, pair, carry…, option_alone, with_text, always_text), one row an id.

    A tie among k best labels gives each 1 / k; the text multiplies as in a posterior. Where df has `unsure`, the text of
    such rows is not heard in with_text, but in always_text.
    """
    def credit(p):
        best = F.max(p).over(W.partitionBy("id"))
        tied = (p >= best - 1e-9).cast("double")
        return tied / F.sum(tied).over(W.partitionBy("id"))

    text = F.col("p_option") * F.pow(C.TEXT_EPSILON + F.col("p_text"), F.lit(C.TEXT_BETA))
    heard = F.when(F.col("unsure"), F.col("p_option")).otherwise(text) if "unsure" in df.columns else text
    rows = df.withColumns({"option_alone": credit(F.col("p_option")), "with_text": credit(heard), "always_text": credit(text)})
    return rows.filter("label = truth").select("id", "pair", *carry, "option_alone", "with_text", "always_text")


def why_gain(df: DataFrame) -> DataFrame:
    """(pair, n, option_alone, with_text, gain): means of why_trials."""
    rows = why_trials(df)
    return rows.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.avg("option_alone").alias("option_alone"), F.avg("with_text").alias("with_text"), F.avg(F.col("with_text") - F.col("option_alone")).alias("gain"))


def why_report(df: DataFrame, clusters: list[str], whole: str = "_all") -> DataFrame:
    """(cluster, pair, n, n_clusters, option_alone, with_text, always_text, gain, gain_always, each with …_lo and …_hi, valid).

    By pair and over all trials (`whole`), once for each column of `clusters` (items, contexts), whose groups are drawn
    again whole.
    """
    trials = why_trials(df, *clusters)
    gain = lambda c: F.col(c) - F.col("option_alone")
    values = {**{c: F.col(c) for c in ("option_alone", "with_text", "always_text")}, "gain": gain("with_text"), "gain_always": gain("always_text")}
    each = [mean_intervals(trials, "pair", values, c, whole).select(F.lit(c).alias("cluster"), "*") for c in clusters]
    return reduce(DataFrame.unionByName, each)


def learning_curve(df: DataFrame, last: int) -> DataFrame:
    """(policy, item, f1): mean F1 after each item, learners that stopped keeping their last value up to `last`."""
    spine = df.groupBy("policy", "learner").agg(F.max("item").alias("m")).select("policy", "learner", F.explode(F.sequence(F.lit(1), F.lit(last))).alias("item"))
    w = W.partitionBy("policy", "learner").orderBy("item")
    rows = spine.join(df, ["policy", "learner", "item"], "left").withColumn("f1", F.last("f1", ignorenulls=True).over(w))
    return rows.groupBy("policy", "item").agg(F.avg("f1").alias("f1"))
