"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words: a share of all words by its weight, at most `most` times the source's own
words, what exceeds that going to the others by weight. Within a source a document is expected `e` times, where e
grows with the document's length class to a small power, is at most `most`, and adds up to the target in words. Of
that, floor(e) whole copies are certain; the rest, p = e - floor(e), is an inclusion probability. Documents are
ranked by [u / (1 - u)] / [p / (1 - p)], u being a hash of the document, and taken in that order up to the words
that the certain copies leave to the target: a sample of fixed size in words with unequal probabilities.

Only DataFrame expressions. Texts are read once for their lengths; what follows works on ids and numbers, the
totals it joins have a row for each source and length class, and the order is found by bins, so that no source has
to be sorted in one task.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last in order;
repeated rows (one id and text) are documents of their own, tied in rank, and of the tied ones on a source's border as
many are taken as come nearest to its target, whichever they are; without any words all targets are 0; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.shared import numbered
from .common import WORD, broadcast_if_small, written

WEIGHTS = (5, 2, 1)
SHARE, MOST, TILT, SEED = 1.5, 2, 0.125, 20
#: Bits of the rank that each pass of binning settles, and the passes.
BIN_BITS, PASSES = 10, 2


def n_words(text: Column) -> Column:
    """Number of words; 0 for null. Each word becomes one letter, which makes no string of its own as matching all would."""
    short = F.regexp_replace(text, rf"[\x20\x09-\x0D]*{WORD}[\x20\x09-\x0D]*", "w")
    return F.when(text.rlike(WORD), F.length(short)).otherwise(0).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, size) summed by source to (source, source_size, target).

    A source is full when its weight's part exceeds `most` times its words. In order of words for each unit of
    weight, the full ones are a prefix: the first k for which the next would not be full with what is then left.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # a row for each source: few, and summed before
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", weight)
    every, order = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    by = by.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    by = by.withColumn("left", F.col("budget") - F.coalesce(F.sum(F.col("source_size") * F.lit(float(most))).over(before), F.lit(0.0)))
    by = by.withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    by = by.withColumn("fits", F.col("left") * F.col("weight") / F.col("rest") <= F.col("source_size") * F.lit(float(most)))
    unit = F.first(F.when(F.col("fits"), F.col("left") / F.col("rest")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    full = F.col("source_size") * F.lit(float(most))
    return by.withColumn("unit", unit).select("source", "source_size", F.when(F.col("unit").isNull(), full).otherwise(F.least(full, F.col("unit") * F.col("weight"))).alias("target"))


def _class(size: Column) -> Column:
    """Length class: the floor of the binary logarithm of size + 1."""
    return F.floor(F.log2(size + 1)).cast("int")


def expected_copies(sizes: DataFrame, targets: DataFrame, most: float = MOST, tilt: float = TILT) -> DataFrame:
    """(source, class, e): copies expected of a document of that source and length class, e = min(most, c * 2^(tilt * class)).

    The classes that reach `most` are the longest ones; c is the one that makes the words add up to the target.
    """
    by = sizes.withColumn("class", _class(F.col("size"))).groupBy("source", "class").agg(F.sum("size").alias("words"))
    by = by.join(broadcast_if_small(targets).withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    by = by.withColumn("pull", F.pow(F.lit(2.0), F.col("class") * F.lit(float(tilt))))
    longest = W.partitionBy("source").orderBy(F.desc("class"))
    before, on = longest.rowsBetween(W.unboundedPreceding, -1), longest.rowsBetween(W.currentRow, W.unboundedFollowing)
    by = by.withColumn("left", F.col("target") - F.coalesce(F.sum(F.col("words") * F.lit(float(most))).over(before), F.lit(0.0)))
    by = by.withColumn("c", F.try_divide(F.col("left"), F.sum(F.col("words") * F.col("pull")).over(on)))
    fits = F.col("c") * F.col("pull") <= F.lit(float(most))
    c = F.first(F.when(fits, F.col("c")), ignorenulls=True).over(longest.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return by.withColumn("c", c).select("source", "class", F.when(F.col("c").isNull(), float(most)).otherwise(F.least(F.lit(float(most)), F.greatest(F.col("c"), F.lit(0.0)) * F.col("pull"))).alias("e"))


def pareto_rank(u: Column, p: Column) -> Column:
    """Random odds by inclusion odds, as x / (1 + x) from 0 to 1."""
    x = (u / (1 - u)) / (p / (1 - p))
    return x / (1 + x)


def _cuts(docs: DataFrame) -> DataFrame:
    """docs: (source, size, p, rank, tie). For each source the place `to` (rank, tie) up to which documents are taken.

    The words wanted are the sum of size * p. Passes of binning find the bin in which they are reached; only what
    lies in that bin is ordered, repeated rows as one place. The document on the border is taken if that comes nearer:
    of the `n` rows on the last place the first `m`.
    """
    bins = 1 << BIN_BITS
    at = docs.withColumn("path", F.lit(0).cast("long"))
    state = None
    for i in range(PASSES):
        at = at.withColumn("bin", F.floor(F.col("rank") * F.lit(float(bins ** (i + 1)))).cast("long"))
        if state is None:
            want = at.groupBy("source").agg(F.sum(F.col("size") * F.col("p")).alias("want"))
            by = at.groupBy("source", "bin").agg(F.sum("size").alias("words"))
        else:
            want = state.select("source", F.col("left").alias("want"))
            inside = at.join(_side(state.select("source", F.col("bin").alias("__bin"))), F.col("source").eqNullSafe(F.col("__source"))).filter(F.floor(F.col("bin") / bins) == F.col("__bin")).drop("__source", "__bin")
            by = inside.groupBy("source", "bin").agg(F.sum("size").alias("words"))
        order = W.partitionBy("source").orderBy("bin")
        by = by.withColumn("before", F.sum("words").over(order) - F.col("words"))
        by = by.join(_side(want), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        # the last bin that begins before the wanted words are reached
        state = written(by.filter("before <= want").groupBy("source").agg(F.max_by("bin", "before").alias("bin"), F.max("before").alias("before"), F.first("want").alias("want")).withColumn("left", F.col("want") - F.col("before")), "cut")
    last = at.join(_side(state.select("source", F.col("bin").alias("__bin"), "left")), F.col("source").eqNullSafe(F.col("__source"))).filter(F.col("bin") == F.col("__bin"))
    places = last.groupBy("source", "rank", "tie", "size").agg(F.first("left").alias("left"), F.count(F.lit(1)).alias("n"))
    words = F.col("size") * F.col("n")
    order = W.partitionBy("source").orderBy("rank", "tie", "size")
    places = places.withColumn("before", F.sum(words).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - words)
    m = F.least(F.col("n"), F.floor((F.col("left") - F.col("before")) / F.col("size") + 0.5).cast("long"))
    place = F.struct("rank", "tie")
    near = places.withColumn("m", m).filter("m > 0").groupBy("source").agg(F.max(place).alias("to"), F.max_by("m", place).alias("m"), F.max_by("n", place).alias("n"))
    out = state.select("source", (F.col("bin") / F.lit(float(bins**PASSES))).alias("floor")).join(near.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left")
    return out.select("source", "floor", "to", "m", "n")


def _side(df: DataFrame) -> DataFrame:
    return broadcast_if_small(df.withColumnRenamed("source", "__source"))


class Mix:
    """The tables that tell what the mix takes: of sources, of sources' length classes, and the border of each source."""

    def __init__(self, docs: DataFrame, id: str = "doc_id", weights=WEIGHTS, share: float = SHARE, most: int = MOST, tilt: float = TILT, seed: int = SEED):
        self.seed = seed
        narrow = docs.select(F.col(id).alias("id"), F.col("source"), n_words(F.col("text")).alias("size"), _tie(F.col("text"), seed).alias("tie"))
        self.narrow = written(narrow, "sizes")
        self.targets = written(source_targets(self.narrow, weights, share, most), "targets")
        self.copies = written(expected_copies(self.narrow, self.targets, most, tilt), "copies")
        ranked = self._ranked(self.narrow).filter("__rank is not null")
        self.cuts = written(_cuts(ranked.select("source", "size", F.col("__p").alias("p"), F.col("__rank").alias("rank"), F.col("__order").alias("tie"))), "cuts")

    def _ranked(self, rows: DataFrame, id: str = "id", size: str = "size", tie: str = "tie") -> DataFrame:
        side = broadcast_if_small(self.copies.withColumnsRenamed({"source": "__s", "class": "__c", "e": "__e"}))
        at = rows.withColumn("__class", _class(F.col(size))).join(side, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__class") == F.col("__c"))).drop("__s", "__c", "__class")
        # whole copies are those of the expected number up to rounding of doubles
        at = at.withColumn("__whole", F.floor(F.col("__e") + F.lit(1e-9)).cast("long"))
        at = at.withColumn("__p", F.greatest(F.lit(0.0), F.col("__e") - F.col("__whole")))
        u = (F.pmod(F.xxhash64(F.lit(self.seed), F.lit("u"), F.col(id), F.col(tie)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        at = at.withColumn("__rank", F.when((F.col("__p") > 0) & (F.col(size) > 0), F.least(pareto_rank(u, F.least(F.col("__p"), F.lit(1 - 1e-9))), F.lit(1 - 1e-12))))
        return at.withColumn("__order", F.xxhash64(F.lit(self.seed), F.lit("tie"), F.col(id), F.col(tie)))

    def decide(self, rows: DataFrame, id: str = "id", size: str = "size", tie: str = "tie") -> DataFrame:
        """Adds __copies, and __source_size and __target; joins small tables only.

        Where a border lies within repeated rows, these rows alone are numbered, in ranges.
        """
        at = self._ranked(rows, id, size, tie)
        at = at.join(_side(self.targets.withColumnsRenamed({"source_size": "__source_size", "target": "__target"})), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        at = at.join(_side(self.cuts.withColumnsRenamed({"floor": "__floor", "to": "__to", "m": "__m", "n": "__n"})), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
        place = F.struct(F.col("__rank").alias("rank"), F.col("__order").alias("tie"))
        more = F.col("__rank").isNotNull() & ((F.col("__rank") < F.col("__floor")) | (place <= F.col("__to")))
        at = at.withColumn("__copies", F.when(F.col(size) > 0, F.col("__whole") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)).otherwise(0).cast("long"))
        keep = [c for c in at.columns if c not in ("__e", "__whole", "__p", "__rank", "__order", "__floor", "__to", "__m", "__n")]
        if self.cuts.filter("m < n").isEmpty():
            return at.select(*keep)
        split = F.coalesce((F.col("__m") < F.col("__n")) & F.col("__rank").isNotNull() & (place == F.col("__to")), F.lit(False))
        edge = numbered(at.filter(split).select(*keep, "__m", F.monotonically_increasing_id().alias("__row")), ("source",), ["__row"], "__nth")
        edge = edge.withColumn("__copies", F.col("__copies") - F.when(F.col("__nth") > F.col("__m"), 1).otherwise(0))
        return at.filter(~split).select(*keep).unionByName(edge.select(*keep))


def _tie(text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(text, F.lit("")))


def mix_sources(docs: DataFrame, id: str = "doc_id", **settings) -> DataFrame:
    """docs: (id, text, source) to (id, size, source_size, target, copies, taken)."""
    mix = Mix(docs, id, **settings)
    out = mix.decide(mix.narrow)
    return out.select(F.col("id").alias(id), "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"), (F.col("__copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, id: str = "doc_id", **settings) -> DataFrame:
    """The rows themselves, each as often as the mix takes it; the texts are not shuffled."""
    mix = Mix(docs, id, **settings)
    rows = docs.select(F.struct("*").alias("row"), F.col(id).alias("id"), "source", n_words(F.col("text")).alias("size"), _tie(F.col("text"), mix.seed).alias("tie"))
    out = mix.decide(rows).filter("__copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return out.select("row.*")
