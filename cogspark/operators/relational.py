"""Numbering, bounded histories, top groups, cross-tabs and joins that several families share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C


def attempt_seq(attempts: DataFrame, by: str = "learner_id", order=("ts", "attempt_id")) -> DataFrame:
    """Adds seq: the arrival number of each learner's attempt."""
    return attempts.withColumn("seq", F.row_number().over(W.partitionBy(by).orderBy(*order)))


def last_n(events: DataFrame, by, order, n: int = 20) -> DataFrame:
    """The last n rows of each key with `age`, 1 for the most recent."""
    w = W.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= n)


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the least order, which is unique in a key: found by aggregation, not by sorting rows."""
    best = rows.groupBy(key).agg(F.min(order).alias("__first"))
    return rows.join(best.withColumnRenamed(key, "__key"), (F.col(key) == F.col("__key")) & (F.col(order) == F.col("__first"))).drop("__key", "__first")


def top_groups(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    """(key, n) of the n largest groups, ties by key."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(n)


def top_labels(posterior: DataFrame, k: int = 2, floor: float = C.TOP_MIN_P, by=("key",)) -> DataFrame:
    """The k most probable labels of each key with at least the floor, ranked; ties by label."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.round("p", 12)), "label"))
    return posterior.filter(F.col("p") >= floor).withColumn("rank", rank).filter(F.col("rank") <= k)


def crosstab(rows: DataFrame, a: str, b: str, values_a: list, values_b: list) -> DataFrame:
    """(a, b, n) for every pair of the given values, zero-filled."""
    grid = rows.sparkSession.createDataFrame([(x, y) for x in values_a for y in values_b], f"{a} string, {b} string")
    return F.broadcast(grid).join(rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")), [a, b], "left").fillna(0, ["n"])


def collision_trials(items: DataFrame, sentences: DataFrame) -> DataFrame:
    """(item_id, option, label, sentence_id): sentences whose label is one of those that share a wrong answer of an item.

    items: (item_id, label, believed). Groups of one label do not collide.
    """
    groups = items.groupBy("item_id", "believed").agg(F.collect_set("label").alias("labels")).filter(F.size("labels") > 1)
    return groups.select("item_id", F.col("believed").alias("option"), F.explode("labels").alias("label")).join(sentences.select(F.col("id").alias("sentence_id"), "label"), "label").select("item_id", "option", "label", "sentence_id")


def cross_domain_plan(rows: DataFrame, domain: Column, train: str, test: str) -> DataFrame:
    """Adds part: train and test by domain, null for others."""
    return rows.withColumn("part", F.when(domain == train, "train").when(domain == test, "test"))


def fact_with_items(facts: DataFrame, items: DataFrame, on: str, limit: int = 500_000) -> DataFrame:
    """Facts with their items' columns; items are broadcast if their counted rows are few."""
    few = items.limit(limit + 1).count() <= limit
    return facts.join(F.broadcast(items) if few else items, on)


def register_functions(spark) -> None:
    """SQL surface: belief_product(history) as a grouped aggregate over (if_active, if_not), likelihood_rows as a table function."""
    from pyspark.sql.functions import pandas_udf, udtf

    @pandas_udf("double")
    def belief_product(a: pd.Series, b: pd.Series) -> float:
        x = np.log(C.POPULATION_PRIOR / (1 - C.POPULATION_PRIOR)) + np.log(a / b).sum()
        return float(1 / (1 + np.exp(-x)))

    @udtf(returnType="option string, p double")
    class LikelihoodRows:
        def eval(self, options: list, correct: str, believed: str):
            names = list(dict.fromkeys(options))
            hit = believed in names and believed != correct
            raw = {}
            for o in names:
                if hit:
                    others = max(1, len(names) - 2)
                    raw[o] = C.P_BELIEF if o == believed else (1 - C.P_BELIEF) * C.Q_CORRECT if o == correct else (1 - C.P_BELIEF) * (1 - C.Q_CORRECT) / others
                else:
                    raw[o] = 1 - C.SLIP if o == correct else C.SLIP / max(1, len(names) - 1)
            raw = {o: max(C.PROB_FLOOR, v) for o, v in raw.items()}
            for o, v in raw.items():
                yield o, v / sum(raw.values())

    spark.udf.register("belief_product", belief_product)
    spark.udtf.register("likelihood_rows", LikelihoodRows)


def public_view(rows: DataFrame, kind: str) -> DataFrame:
    """The columns of an entity that a learner's client may see; all others, answer keys among them, are left out.

    allow_no_bug of code items is shown for debug_line items alone.
    """
    out = rows.select(*[c for c in C.PUBLIC_FIELDS[kind] if c in rows.columns])
    if "allow_no_bug" in out.columns and "type" in out.columns:
        out = out.withColumn("allow_no_bug", F.when(F.col("type") == "debug_line", F.coalesce("allow_no_bug", F.lit(True))))
    return out
