"""URL filters: host and path rules, then a Bloom filter cascade for the keys that no rule settles.

The cascade's first level encodes the listed keys; the second encodes the keys of the universe that the first
takes for listed though they are not; the third the listed keys that the second takes for those; and so on until
a level errs on nothing. Walking the levels then tells listed from other keys of that universe without error.
Everything is DataFrame expressions; a probe is arithmetic on an array that a scalar subquery holds.

Defined cases: a null URL or one without "://" has an empty host and an empty path; an empty table gives an empty
result; repeated rows are judged alike; other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (verdict, host, path prefix)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Share of errors at the first and the later levels.
FIRST, LATER = 0.01, 0.1
#: A level's bits up to which it travels with the tasks (8 MB); a larger one stays a table and is probed by a join.
MOST_BITS = 1 << 26


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    part = lambda i: F.coalesce(F.regexp_extract(url, _URL, i), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as its text and its verdict; null where none fits."""
    text = said = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, said = F.when(fits, h + p).otherwise(text), F.when(fits, verdict).otherwise(said)
    return text, said


@dataclass
class Level:
    bits: int
    hashes: int
    seed: int
    words: DataFrame  # (word, mask), and beside it as one row with an array
    row: DataFrame | None

    def position(self, key: Column, i: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(i), key), F.lit(self.bits))

    def has(self, key: Column) -> Column:
        words = self.row.scalar()
        out = F.lit(True)
        for i in range(self.hashes):
            at = self.position(key, i)
            mask = F.element_at(words, (F.shiftright(at, 6) + 1).cast("int"))
            out = out & (F.call_function("shiftrightunsigned", mask, (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
        return out

    def kept(self, keys: DataFrame) -> DataFrame:
        """The keys that the level takes in."""
        if self.row is not None:
            return keys.filter(self.has(F.col("key")))
        at = F.explode(F.array(*[self.position(F.col("key"), i) for i in range(self.hashes)]))
        found = keys.select("key", at.alias("at")).withColumn("word", F.shiftright("at", 6)).join(self.words, "word", "left")
        hit = F.call_function("shiftrightunsigned", F.coalesce("mask", F.lit(0).cast("long")), (F.col("at") % 64).cast("int")).bitwiseAND(F.lit(1).cast("long"))
        return found.groupBy("key").agg(F.min(hit).alias("hit")).filter("hit = 1").select("key")


def _level(keys: DataFrame, n: int, rate: float, seed: int, most_bits: int) -> Level:
    bits = 64 * max(1, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))
    level = Level(bits, max(1, round(bits / max(n, 1) * math.log(2))) if n else 1, seed, None, None)
    level.hashes = min(level.hashes, 16)
    at = F.explode(F.array(*[level.position(F.col("key"), i) for i in range(level.hashes)]))
    masks = keys.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, int(at % 64))").alias("mask"))
    level.words = masks.groupBy("word").agg(F.bit_or("mask").alias("mask"))
    if bits <= most_bits:
        zeros = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
        level.row = written(level.words.unionByName(zeros).groupBy("word").agg(F.bit_or("mask").alias("mask")).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"]).alias("words")), "bloom")
    else:
        level.words = written(level.words, "bloom")
    return level


def build_cascade(universe: DataFrame, first: float = FIRST, later: float = LATER, most_bits: int = MOST_BITS) -> list[Level]:
    """universe: (key, listed boolean), each key once. Levels until one errs on none of the universe."""
    universe = written(universe, "keys")
    own, other = universe.filter("listed").select("key"), universe.filter("not listed").select("key")
    levels, n = [], own.count()
    while n and len(levels) < 64:
        level = _level(own, n, later if levels else first, len(levels), most_bits)
        levels.append(level)
        own, other = written(level.kept(other), "errors"), own
        n = own.count()
    if n:
        raise ValueError("the cascade does not end: keys that no hash tells apart")
    return levels


def is_listed(levels: list[Level], key: Column) -> Column:
    """Walks the levels; exact for keys of the universe. All levels must be small enough to travel."""
    out = F.lit(len(levels) % 2 == 1)
    for i, level in reversed(list(enumerate(levels))):
        out = F.when(level.has(key), out).otherwise(F.lit(i % 2 == 1))
    return out


def listed_keys(levels: list[Level], keys: DataFrame) -> DataFrame:
    """The listed ones of the universe's keys, for cascades with levels too large to travel."""
    out, at = None, keys
    for i, level in enumerate(levels):
        passed = level.kept(at)
        if i % 2 == 1:
            leave = at.join(passed, "key", "left_anti")
            out = leave if out is None else out.unionByName(leave)
        at = passed
    return at if out is None else out.unionByName(at) if len(levels) % 2 else out


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, url: str = "url", most_bits: int = MOST_BITS) -> DataFrame:
    """Adds host, path, rule and verdict. listed: (key), key being host and path put together."""
    host, path = url_parts(F.col(url))
    at = pages.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    keys = at.select(F.concat("host", "path").alias("key")).distinct()
    universe = keys.withColumn("on", F.lit(0)).unionByName(listed.select("key").filter("key is not null").withColumn("on", F.lit(1))).groupBy("key").agg((F.max("on") == 1).alias("listed"))
    levels = build_cascade(universe, most_bits=most_bits)
    key = F.concat("host", "path")
    if all(x.row is not None for x in levels):
        at = at.withColumn("__listed", is_listed(levels, key))
    else:
        found = listed_keys(levels, keys).withColumn("__listed", F.lit(True)).withColumnRenamed("key", "__key")
        at = at.withColumn("__key", key).join(found, "__key", "left").drop("__key").withColumn("__listed", F.coalesce("__listed", F.lit(False)))
    text, said = rule_of(F.col("host"), F.col("path"), rules)
    return at.withColumn("rule", text).withColumn("verdict", F.coalesce(said, F.when(F.col("__listed"), "block").otherwise("allow"))).drop("__listed")
