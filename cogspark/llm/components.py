"""Connected components of an edge table by alternating stars, round by round, in the shared folder.

The edges of a node are dealt over several tasks, so that a star's centre is no task's alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, written

#: Tasks that a node's edges are dealt over.
SALTS = 16


def _with_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """edges with the least neighbour of a. A node's edges are dealt over SALTS tasks, unless all n of them are few."""
    if n < HOT:
        return edges.join(least, "a")
    side = least.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(side, ["a", "salt"]).drop("salt")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _with_least(both, least, n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of those."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return _with_least(down, least, n).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, root): root is the least node of the component. Nodes without another are left out."""
    tidy = lambda df: df.filter("a <> b").distinct()
    state = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    now = written(tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "edges")
    before = None
    while (at := state(now)) != before:
        before = at
        if not at[0]:
            break
        now = written(tidy(_small_star(_large_star(now, at[0]), at[0])), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
