"""Quality rules over a labelled corpus: each gives (rule_id, status, key, value), status PASS or FAIL (or SKIP)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from .shared import broadcast_if_small, running


def _rule(df: DataFrame, rule: str, key: Column, value: Column, fail: Column, skip: Column | None = None) -> DataFrame:
    status = F.when(fail, "FAIL").otherwise("PASS")
    if skip is not None:
        status = F.when(skip, "SKIP").otherwise(status)
    return df.select(F.lit(rule).alias("rule_id"), status.alias("status"), key.cast("string").alias("key"), value.cast("double").alias("value"))


def check_counts(rows: DataFrame, labels: list[str], floor: int = C.LABEL_FLOOR) -> DataFrame:
    """Q1: rows of each label, zero-filled, against the floor."""
    dim = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    n = F.broadcast(dim).join(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _rule(n, "Q1", F.col("label"), F.col("n"), F.col("n") < floor)


def check_drops(report: DataFrame, limit: float = C.DROP_LIMIT) -> DataFrame:
    """Q2: operators whose loss exceeds the limit even at its lower bound; inconsistent counts fail."""
    return _rule(report, "Q2", F.col("op_id"), F.col("drop_high"), F.col("inconsistent") | (F.col("drop_low") > limit), F.col("attempts") == 0)


def check_duplicates(rows: DataFrame, allowed=("M01", "M08")) -> DataFrame:
    """Q3: hashes with several labels other than the allowed pair."""
    by = rows.groupBy("hash").agg(F.array_sort(F.collect_set("label")).alias("labels")).filter(F.size("labels") > 1)
    return _rule(by, "Q3", F.col("hash"), F.size("labels"), F.col("labels") != F.array(*[F.lit(x) for x in sorted(allowed)]))


def ks(rows: DataFrame, value: str, side: Column, by=()) -> DataFrame:
    """(by…, n1, n2, d, p): two-sample Kolmogorov-Smirnov over distinct values, asymptotic p."""
    c = rows.groupBy(*by, F.col(value).alias("x")).agg(F.sum(F.when(side, 1).otherwise(0)).alias("a"), F.sum(F.when(side, 0).otherwise(1)).alias("b"))
    c = running(c, "x", tuple(by), ca="a", cb="b")
    # the sums at the largest value are all there is
    n = c.groupBy(*by).agg(F.max("ca").alias("n1"), F.max("cb").alias("n2"))
    both = c.join(broadcast_if_small(n), list(by)) if by else c.crossJoin(F.broadcast(n))  # one row without keys
    d = both.groupBy(*by).agg(F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.max(F.abs(F.col("ca") / F.col("n1") - F.col("cb") / F.col("n2"))).alias("d"))
    en = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    lam = (en + 0.12 + 0.11 / en) * F.col("d")
    sign = lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0)
    p = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + sign(k) * F.exp(-2.0 * k * k * lam * lam))
    return d.withColumn("p", F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))))


def check_length(rows: DataFrame, length: str = "n_chars") -> DataFrame:
    """Q4: a label whose lengths stand apart from the other labels'."""
    labels = [r["label"] for r in rows.select("label").distinct().orderBy("label").collect()]  # a vocabulary
    sides = rows.select(F.explode(F.array(*map(F.lit, labels))).alias("key"), "label", length)
    d = ks(sides, length, F.col("label") == F.col("key"), ("key",))
    return _rule(d, "Q4", F.col("key"), F.col("d"), (F.col("d") >= C.KS_D) & (F.col("p") < C.KS_P), F.least("n1", "n2") < C.KS_N)


def unpivoted(rows: DataFrame, id: str, features: list[str], *carry: str) -> DataFrame:
    return rows.select(id, *carry, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])))


def stumps(rows: DataFrame, id: str, features: list[str], y: str = "label") -> DataFrame:
    """(feature, threshold, macro_recall): the best depth-1 tree of each feature, each side naming its best label by recall.

    Class counts by distinct value are cumulated once; a split's macro recall is the larger of the two namings summed.
    """
    c = unpivoted(rows, id, features, y).filter("x is not null").groupBy("feature", "x", F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    total = c.groupBy("feature", "y").agg(F.sum("n").alias("t"))
    k = total.groupBy("feature").agg(F.count(F.lit(1)).alias("k"))
    run = W.partitionBy("feature", "y").orderBy("x")
    c = c.join(total, ["feature", "y"]).withColumn("below", F.sum("n").over(run) / F.col("t"))
    # a label's share below a value is that of its last value up to it: carried over a grid of (value, label)
    grid = c.select("feature", "x").distinct().join(total, "feature")
    full = grid.join(c.select("feature", "x", "y", "below"), ["feature", "x", "y"], "left").withColumn("below", F.coalesce(F.last("below", ignorenulls=True).over(run), F.lit(0.0)))
    best = full.groupBy("feature", "x").agg(F.max("below").alias("lo"), F.max(1 - F.col("below")).alias("hi")).join(k, "feature")
    return best.groupBy("feature").agg(F.max(F.struct(((F.col("lo") + F.col("hi")) / F.col("k")).alias("m"), (-F.col("x")).alias("x"))).alias("b")).select("feature", (-F.col("b.x")).alias("threshold"), F.col("b.m").alias("macro_recall"))


def check_stumps(rows: DataFrame, id: str, features: list[str], limit: float = C.STUMP_LIMIT) -> DataFrame:
    """Q5: one feature that alone tells labels apart."""
    return _rule(stumps(rows, id, features), "Q5", F.col("feature"), F.col("macro_recall"), F.col("macro_recall") > limit)


def check_bleed(fired: DataFrame, limit: float = C.BLEED_LIMIT) -> DataFrame:
    """Q6: share of a label's rows in which another label's predicate fires. fired: (label, predicate, share or null) by row group."""
    m = fired.groupBy("label", "predicate").agg(F.avg("share").alias("m"))
    return _rule(m.filter("m is not null"), "Q6", F.concat_ws(">", "label", "predicate"), F.col("m"), (F.col("label") != F.col("predicate")) & (F.col("m") > limit))


def feature_health(rows: DataFrame, id: str, features: list[str]) -> DataFrame:
    """(feature, n, distinct, mode_share): over finite values."""
    c = unpivoted(rows, id, features).filter(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("feature").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct"), (F.max("n") / F.sum("n")).alias("mode_share"))


def correlations(rows: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, r, n): pairwise-complete Pearson correlations, all in one pass of sums."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    both = {(a, b): F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs}
    got = rows.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.when(both[a, b], F.col(a).cast("double")), F.when(both[a, b], F.col(b).cast("double"))).alias("r"), F.sum(F.when(both[a, b], 1).otherwise(0)).alias("n")).alias(f"{a}|{b}") for a, b in pairs])
    return got.select(F.inline(F.array(*[F.col(f"`{a}|{b}`") for a, b in pairs]))).filter("n >= 3")


def check_health(rows: DataFrame, id: str, features: list[str]) -> DataFrame:
    """Q7: constant or nearly constant features, and pairs that say the same."""
    h = feature_health(rows, id, features)
    one = _rule(h, "Q7", F.col("feature"), F.col("mode_share"), F.col("mode_share") >= C.CONSTANT_SHARE)
    r = correlations(rows, features).filter("r is not null")
    return one.unionByName(_rule(r, "Q7", F.concat_ws("~", "a", "b"), F.col("r"), F.abs("r") > C.CORRELATION_LIMIT))


def check_events(events: DataFrame, share: float = C.EVENT_SHARE) -> DataFrame:
    """Q11: an event type that occurs in at least so many of a class's rows. events: (id, class, type); a row counts once a type."""
    n = events.groupBy("class").agg(F.countDistinct("id").alias("n"))
    e = events.select("id", "class", "type").distinct().groupBy("class", "type").agg(F.count(F.lit(1)).alias("k")).join(n, "class")
    return _rule(e, "Q11", F.concat_ws(":", "class", "type"), F.col("k") / F.col("n"), F.col("k") / F.col("n") >= share)


def check_exposure(results: DataFrame, authored: DataFrame, gap: float = C.EXPOSURE_GAP) -> DataFrame:
    """Q13: measured against authored exposure. results: (problem_id, class, failed BOOLEAN)."""
    m = results.groupBy("problem_id", "class").agg(F.avg(F.col("failed").cast("double")).alias("m")).join(authored, ["problem_id", "class"])
    return _rule(m, "Q13", F.concat_ws(":", "problem_id", "class"), F.abs(F.col("m") - F.col("exposure")), F.abs(F.col("m") - F.col("exposure")) > gap)


def check_masking(masked: DataFrame) -> DataFrame:
    """Q14: rows whose true label the mask removes. masked: (key, label, allowed, truth)."""
    lost = masked.filter(F.col("label") == F.col("truth")).groupBy("truth").agg(F.sum((~F.col("allowed")).cast("long")).alias("n"))
    return _rule(lost, "Q14", F.col("truth"), F.col("n"), F.col("n") > 0)


def check_kappa(kappa: DataFrame, limit: float = 0.6) -> DataFrame:
    """Q12: raters that agree too little."""
    return _rule(kappa, "Q12", F.lit("kappa"), F.col("kappa"), F.col("kappa") < limit, F.col("n") == 0)


def check_items(items: DataFrame) -> DataFrame:
    """Q16: violations (item_id, rule) of choice items: 3 or 4 different options, the correct one and the beliefs among them."""
    n = F.size(F.array_distinct("options"))
    beliefs = F.coalesce(F.map_values("belief"), F.array().cast("array<string>"))
    rules = F.filter(F.array(F.when((n < 3) | (n > 4) | (n != F.size("options")), "options"), F.when(~F.array_contains("options", F.col("correct")), "correct"), F.when(F.size(F.array_except(beliefs, F.col("options"))) > 0, "belief"), F.when(F.array_contains(beliefs, F.col("correct")), "belief_correct")), lambda x: x.isNotNull())
    return items.select("item_id", F.explode(rules).alias("rule"))


def check_problems(problems: DataFrame) -> DataFrame:
    """Q15: violations (problem_id, rule): a test, a sample test, exposures from 0 to 1, a variant."""
    rules = F.filter(F.array(F.when(F.col("n_tests") < 1, "tests"), F.when(F.col("n_samples") < 1, "samples"), F.when(F.exists("exposures", lambda x: (x < 0) | (x > 1)), "exposure"), F.when(F.col("n_variants") < 1, "variants")), lambda x: x.isNotNull())
    return problems.select("problem_id", F.explode(rules).alias("rule"))


def check_targets(items: DataFrame, targets: dict[str, int], by: str) -> DataFrame:
    """Q17: realised numbers against targets."""
    dim = items.sparkSession.createDataFrame([(k, v) for k, v in targets.items()], f"{by} string, target int")
    n = F.broadcast(dim).join(items.groupBy(by).agg(F.count(F.lit(1)).alias("n")), by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _rule(n, "Q17", F.col(by), F.col("n"), F.col("n") < F.col("target"))


def label_sets(rows: DataFrame) -> DataFrame:
    """(labels, hashes, rows): how many hashes have which set of labels."""
    by = rows.groupBy("hash").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.count(F.lit(1)).alias("n"))
    return by.groupBy("labels").agg(F.count(F.lit(1)).alias("hashes"), F.sum("n").alias("rows"))


def outlier_trees(rows: DataFrame, id: str, features: list[str], trees: int = 25, sample: int = 256, seed: int = 7) -> DataFrame:
    """Q10: (id, score) of an isolation forest. Each tree grows on a hash sample of about `sample` rows; rows are scored in batches."""
    import numpy as np
    import pandas as pd

    total = rows.count()
    share = min(1.0, 2.0 * sample / max(total, 1))
    cols = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]
    pick = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    drawn = rows.select(F.col(id).cast("string").alias("id"), *cols).withColumn("tree", pick).withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "tree", "id"), F.lit(1 << 30)) / float(1 << 30)).filter(F.col("u") < share)

    def grow(pdf):
        pdf = pdf.sort_values(["u", "id"]).head(sample)
        x, rng, nodes = pdf[features].to_numpy(float), np.random.default_rng(int(pdf["tree"].iloc[0]) + seed), []
        limit = int(np.ceil(np.log2(max(2, len(x)))))

        def build(own, depth):
            at = len(nodes)
            nodes.append([-1, 0.0, -1, -1, float(depth + _average_path(len(own)))])
            spread = np.flatnonzero(own.max(0) > own.min(0)) if len(own) > 1 and depth < limit else []
            if len(spread):
                f = int(rng.choice(spread))
                cut = float(rng.uniform(own[:, f].min(), own[:, f].max()))
                left = own[:, f] < cut
                nodes[at][:4] = [f, cut, build(own[left], depth + 1), build(own[~left], depth + 1)]
            return at

        build(x, 0)
        return pd.DataFrame({"tree": [int(pdf["tree"].iloc[0])], "n": [len(x)], "nodes": [np.array(nodes).tobytes()]})

    # as many rows as trees, each of bounded size
    forest = drawn.groupBy("tree").applyInPandas(grow, "tree int, n int, nodes binary").toPandas().sort_values("tree")
    grown = [(np.frombuffer(x, float).reshape(-1, 5), n) for x, n in zip(forest["nodes"], forest["n"])]

    def score(batches):
        for pdf in batches:
            x, depth = pdf[features].to_numpy(float), np.zeros(len(pdf))
            for nodes, n in grown:
                at = np.zeros(len(x), int)
                for _ in range(64):
                    f = nodes[at, 0].astype(int)
                    inner = f >= 0
                    if not inner.any():
                        break
                    left = x[np.arange(len(x)), np.maximum(f, 0)] < nodes[at, 1]
                    at = np.where(inner, np.where(left, nodes[at, 2], nodes[at, 3]), at).astype(int)
                depth += nodes[at, 4] / max(_average_path(n), 1e-9)
            yield pd.DataFrame({"id": pdf["id"], "score": 2.0 ** (-depth / max(1, len(grown)))})

    return rows.select(F.col(id).cast("string").alias("id"), *cols).mapInPandas(score, "id string, score double")


def outlier_report(scores: DataFrame, k: int = 20, contamination: float = 0.02) -> DataFrame:
    """The k rows of the highest score of outlier_trees, ties by id: (id, score, rank, outlier), outlier: above the cut.

    The cut leaves the share `contamination` of all rows above it: the percentile of the scores, linear between values.
    """
    cut = scores.agg(F.percentile("score", F.lit(1 - contamination)).alias("cut")).scalar()
    top = scores.orderBy(F.desc("score"), "id").limit(k).withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")))  # k rows
    return top.select("id", "score", "rank", (F.col("score") > cut).alias("outlier"))


def _average_path(n: int) -> float:
    """Mean depth of an unsuccessful search among n."""
    import math

    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def run_rules(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)
