"""N-gram Jaccard join: which texts share at least `threshold` of their word n-grams.

Candidates come from a MinHash LSH forest: TREES prefix tries over signatures of DEPTH values of 16 bits. All
signatures of all trees are sorted in ranges over the cluster (tree first, then value by value, so that a hot prefix is
cut by the ranges too); neighbours in that order, over the ranges' edges as well, tell the longest prefix that each text
shares with any other. A text is tied to the first of its run of that prefix, never pair by pair. The prefix that has
to be shared is then shortened from DEPTH value by value: trees are independent trials, so of all (text, tree) meetings
the share that only one tree has seen tells how likely a further tree is to show a text none has (Good and Turing's
estimate), and shortening goes on until that share is below 1 - RECALL, or until texts of just the threshold meet with
that probability by the formula. The components of the ties are verified: every pair of different texts in one is
compared exactly, so a component may find links that no prefix showed. A large component is cut into chunks, and each
pair of chunks is a task that multiplies incidence matrices of the shared n-grams and hands on a number of links for
each text and a spanning forest, never the pairs.

Words are runs of `[^\\x20\\x09-\\x0D]`, A-Z lower-cased. Texts with equal sets of n-grams are one class from the
start. 64-bit hashes stand for n-grams.

Defined cases: a text of fewer words than n has one n-gram, all its words; a null text or one without words is like
no other and is its own group; repeated rows are copies; rows without an id can be in a group, whose id is the least
there is; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, SpanHash, blocks, broadcast_if_small, join_apart, mix, parts_for, release, text_bytes, tidy, words, written
from .components import components

N, THRESHOLD = 5, 0.8
#: Trees (32 at most), values of a signature (8 at most), target recall.
TREES, DEPTH, RECALL = 24, 8, 0.9999
#: Text bytes that a task looks at together; texts and n-grams in a chunk of a component; columns of a matrix.
BLOCK, CHUNK, CHUNK_GRAMS, COLUMNS = 2 << 20, 384, 1 << 20, 2048
#: Bytes of signatures in a range of the sorted tries.
RANGE = 64 << 20


def text_tie(text: Column) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.lit(0), F.coalesce(text, F.lit("")))


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with which texts of just the threshold meet with the recall: none shorter is ever needed."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def gram_sets(texts: pa.Array | pa.ChunkedArray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The different n-gram hashes of each text, sorted, one text after another, and where each begins."""
    body, offsets = text_bytes(texts)
    body, start, end, of = words(body, offsets)
    word = SpanHash(body).of(start, end)
    count = np.bincount(of, minlength=len(offsets) - 1)
    gram = np.zeros(len(word), np.uint64)
    for i in range(n):
        gram[: len(word) - i] += mix(word[i:] + np.uint64(i + 1))
    place = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    size = np.repeat(count, count)
    whole = place + n <= size
    short = np.flatnonzero((place == 0) & (size < n))
    for i in short:
        gram[i] = sum((int(mix(word[i + j : i + j + 1] + np.uint64(j + 1))[0]) for j in range(size[i])), int(size[i])) & (2**64 - 1)
    whole[short] = True
    gram, of = mix(gram[whole]), of[whole]
    order = np.lexsort((gram, of))
    gram, of = gram[order], of[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])
    gram, of = gram[new], of[new]
    return gram, np.r_[0, np.cumsum(np.bincount(of, minlength=len(offsets) - 1))].astype(np.int64)


def set_keys(gram: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """16 bytes for each set: equal sets, equal keys; None for an empty one."""
    one = np.r_[np.uint64(0), np.cumsum(mix(gram ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)]
    two = np.r_[np.uint64(0), np.cumsum(mix(gram + np.uint64(0x14057B7EF767814F)), dtype=np.uint64)]
    pair = np.stack([one[at[1:]] - one[at[:-1]], two[at[1:]] - two[at[:-1]] + np.diff(at).astype(np.uint64)], 1)
    return [x.tobytes() if y else None for x, y in zip(pair, np.diff(at))]


def signatures(gram: np.ndarray, at: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """(texts, trees, 2): two numbers that hold the tree (5 bits) and its values (11 bits, then 16 each); rows of empty sets mean nothing."""
    rng = np.random.default_rng(2024)
    factor = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)
    halves = [(gram & np.uint64(0xFFFFFFFF)).astype(np.uint32), (gram >> np.uint64(32)).astype(np.uint32)]
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, trees, 2), np.uint64)
    if not len(full):
        return out
    for t in range(trees):
        for d in range(depth):
            k = t * depth + d
            x = halves[k & 1] * factor[k] + add[k]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            value = mix(np.minimum.reduceat(x, at[:-1][full]).astype(np.uint64)) >> np.uint64(48 if d else 53)
            if d == 0:
                value |= np.uint64(t << 11)
            out[full, t, d // 4] |= value << np.uint64(48 - 16 * (d % 4))
    return out


def shared_values(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """How many leading values each sorted signature shares with the one before it; 0 for the first."""
    out, same = np.zeros(len(hi), np.int64), np.ones(max(0, len(hi) - 1), bool)
    for d in range(8):
        x, shift = (hi, lo)[d // 4], np.uint64(48 - 16 * (d % 4))
        same = same & ((x[1:] >> shift) == (x[:-1] >> shift))
        out[1:] += same
    return out


_TIES = "part int, kind int, hi long, lo long, a binary, b binary, level int, own int"
TIE, FIRST, LAST = 0, 1, 2


def _tries(floor: int, depth: int):
    """Sorted signatures of a range to the ties of its texts: a to b, the first of the run that shares a's `level` values.

    own is the longest prefix that a shares with either neighbour; the range's first and last signatures come beside.
    """

    def rows(part, kind, hi, lo, a, b, level, own):
        n = len(a)
        x = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), a.cast(pa.binary()), b, pa.array(level.astype(np.int32)), pa.array(own.astype(np.int32))]
        return pa.RecordBatch.from_arrays(x, [c.split()[0] for c in _TIES.split(", ")])

    def edge(part, kind, hi, lo, sets):
        return rows(part, kind, hi, lo, sets, pa.nulls(1, pa.binary()), np.zeros(1), np.zeros(1))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, leaders = None, [None] * (depth + 1)

        def ties(hi, lo, sets, level, after):
            """Of all given rows; after: what the row behind them shares with the last."""
            n = len(hi)
            own = np.maximum(level, np.r_[level[1:], after])
            to = np.full(n, -1)
            for d in range(floor, depth + 1):
                start = np.maximum.accumulate(np.where(level < d, np.arange(n), -1))
                mine = level == d
                to[mine] = np.where(start[mine] < 0, n + d, start[mine])
                if start[-1] >= 0:
                    leaders[d], was = sets[int(start[-1])].as_py(), leaders[d]
                    before[d] = was
                else:
                    before[d] = leaders[d]
            some = np.flatnonzero(own >= floor)
            if len(some):
                every = pa.concat_arrays([sets, pa.array(before, pa.binary())])
                b = every.take(pa.array(np.where(to[some] < 0, some, to[some])))
                yield rows(part, TIE, hi[some], lo[some], sets.take(pa.array(some)), b, level[some], own[some])

        before = [None] * (depth + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            sets = batch.column(2).cast(pa.binary())
            if held is None:
                yield edge(part, FIRST, hi[:1], lo[:1], sets[:1])
                level = np.minimum(shared_values(hi, lo), depth)
            else:
                hi, lo, sets = np.r_[held[0], hi], np.r_[held[1], lo], pa.concat_arrays([held[2], sets])
                level = np.minimum(shared_values(hi, lo), depth)
                level[0] = held[3]
            if len(hi) > 1:
                yield from ties(hi[:-1], lo[:-1], sets[:-1], level[:-1], level[-1])
            held = (hi[-1:], lo[-1:], sets[-1:], level[-1])
        if held is not None:
            yield from ties(*held[:3], np.array([held[3]]), 0)
            yield edge(part, LAST, *held[:3])

    return run


def forest_ties(classes: DataFrame, floor: int, trees: int, depth: int) -> DataFrame:
    """classes (set, keys) to ties (tree's values hi, a, b, level, own) of texts that share `floor` values or more in a tree."""
    spark = classes.sparkSession
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(F.get("keys", 2 * t).alias("hi"), F.get("keys", 2 * t + 1).alias("lo"))))
    keyed = classes.select("set", pair.alias("k")).select("k.hi", "k.lo", "set")
    ranges = parts_for(spark, classes.count() * trees * 40, RANGE)
    sorted_ = keyed.repartitionByRange(ranges, "hi", "lo", "set").sortWithinPartitions("hi", "lo", "set")
    found = written(sorted_.mapInArrow(_tries(floor, depth), _TIES), "ties")
    # two rows a range: neighbours over the edges
    ends = sorted(found.filter(F.col("kind") != TIE).collect(), key=lambda r: (r["part"], r["kind"]))
    across = []
    for x, y in zip(ends[1::2], ends[2::2]):
        hi, lo = (np.array([x[c], y[c]], np.int64).view(np.uint64) for c in ("hi", "lo"))
        level = min(depth, int(shared_values(hi, lo)[1]))
        if level >= floor:
            across += [(y["hi"], bytes(y["a"]), bytes(x["a"]), level, level), (x["hi"], bytes(x["a"]), bytes(x["a"]), 0, level)]
    return found.filter(F.col("kind") == TIE).select("hi", "a", "b", "level", "own").unionByName(spark.createDataFrame(across, "hi long, a binary, b binary, level int, own int"))


def shortened(ties: DataFrame, floor: int, depth: int, recall: float) -> int:
    """The values that texts have to share: as many as give the recall on what was found, `floor` at least."""
    if floor == depth:
        return depth
    at = range(floor + 1, depth + 1)
    met = ties.groupBy("a", F.shiftright("hi", 59).alias("tree")).agg(F.max("own").alias("own"))
    by = met.groupBy("a").agg(*[F.count_if(F.col("own") >= d).alias(f"m{d}") for d in at])
    got = by.agg(*[F.sum(f"m{d}").alias(f"n{d}") for d in at], *[F.count_if(F.col(f"m{d}") == 1).alias(f"o{d}") for d in at]).first()
    return next((d for d in reversed(at) if ((got[f"o{d}"] or 0) + 1) / ((got[f"n{d}"] or 0) + 1) <= 1 - recall), floor)


def _signatures(n: int, trees: int, depth: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, "text", BLOCK):
            gram, at = gram_sets(table.column("text"), n)
            keys = signatures(gram, at, trees, depth).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * (2 * trees)), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), table.column("tie").combine_chunks(), pa.array(set_keys(gram, at), pa.binary()), pa.array(np.diff(at)), lists], ["id", "tie", "set", "grams", "keys"])

    return run


def _sets(n: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, "text", BLOCK):
            gram, at = gram_sets(table.column("text"), n)
            same = [x == y for x, y in zip(set_keys(gram, at), table.column("set").to_pylist())]
            sets = pa.array([gram[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())
            out = pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("set", "root", "copies", "chunks", "chunk")), sets], ["set", "root", "copies", "chunks", "chunk", "sets"])
            yield out.filter(pa.array(same))

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Numbers of n-grams that sets of a and b (or of a and a) share."""
    every = [*a, *(b or ())]
    values, code = np.unique(np.concatenate(every), return_inverse=True)
    row = np.repeat(np.arange(len(every)), [len(x) for x in every])
    in_a = np.bincount(code[row < len(a)], minlength=len(values))
    common = in_a > 1 if b is None else (in_a > 0) & (np.bincount(code[row >= len(a)], minlength=len(values)) > 0)
    stay = common[code]
    row, code = row[stay], (np.cumsum(common) - 1)[code[stay]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    out = np.zeros((len(a), len(a) if b is None else len(b)), np.float32)
    for lo in range(0, int(common.sum()), COLUMNS):
        i, j = np.searchsorted(code, (lo, lo + COLUMNS))
        m = np.zeros((len(every), COLUMNS), np.float32)
        m[row[i:j], code[i:j] - lo] = 1
        out += m[: len(a)] @ (m if b is None else m[len(a) :]).T
    return out


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a boolean adjacency matrix: rows to columns' numbers, all in one numbering."""
    n, seen, out = len(links), np.zeros(len(links), bool), []
    for root in range(n):
        if seen[root]:
            continue
        seen[root], open_ = True, [root]
        while open_:
            x = open_.pop()
            new = np.flatnonzero(links[x] & ~seen)
            seen[new] = True
            out.extend((x, int(y)) for y in new)
            open_.extend(new.tolist())
    return out


def _verify(threshold: float):
    def run(pdf):
        import pandas as pd

        rows = []
        for (root, i, j), part in pdf.groupby(["root", "i", "j"], sort=False):
            part = part.drop_duplicates("set")
            own = part[part["chunk"] == i]
            other = part[part["chunk"] == j] if j != i else None
            if not len(own) or other is not None and not len(other):
                continue
            a = [np.frombuffer(x, np.uint64) for x in own["sets"]]
            b = None if other is None else [np.frombuffer(x, np.uint64) for x in other["sets"]]
            inter = overlaps(a, b).astype(np.float64)
            size_a = np.array([len(x) for x in a], float)
            size_b = size_a if b is None else np.array([len(x) for x in b], float)
            link = inter >= threshold * (size_a[:, None] + size_b[None, :] - inter) - 1e-9
            copies_a = own["copies"].to_numpy()
            if b is None:
                np.fill_diagonal(link, False)
                keys = list(own["set"])
                rows += [(s, None, int(n), int(m)) for s, n, m in zip(keys, link.sum(1), link @ copies_a) if n]
                rows += [(keys[x], keys[y], 0, 0) for x, y in _forest(link)]
            else:
                copies_b = other["copies"].to_numpy()
                keys = [*own["set"], *other["set"]]
                for s, n, m in zip(keys, [*link.sum(1), *link.sum(0)], [*(link @ copies_b), *(copies_a @ link)]):
                    if n:
                        rows.append((s, None, int(n), int(m)))
                whole = np.zeros((len(keys), len(keys)), bool)
                whole[: len(a), len(a) :] = link
                whole |= whole.T
                rows += [(keys[x], keys[y], 0, 0) for x, y in _forest(whole)]
        release()
        return pd.DataFrame(rows, columns=["set", "other", "texts", "docs"])

    return run


def ngram_join(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, firsts: bool = False) -> DataFrame:
    """(id, class_id, n_links, n_texts) of each row.

    class_id is the least id of the texts that links tie together, n_links the number of other rows that are copies
    or linked, n_texts the number of other sets of n-grams that are linked. With firsts, (id, tie, grouped, first) of
    each row instead: tie hashes the text, grouped is false without words, and first marks the rows of the least id
    and tie of their group.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), text_tie(F.col(text)).alias("tie"))
    floor = prefix_depth(threshold, trees, depth, recall)
    signed = written(plain.mapInArrow(_signatures(n, trees, depth), "id long, tie long, set binary, grams long, keys array<long>"), "signatures")
    classes = written(signed.filter("set is not null").groupBy("set").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("grams").alias("grams"), F.first("keys").alias("keys")), "classes")
    ties = forest_ties(classes, floor, trees, depth)
    depth = shortened(ties, floor, depth, recall)
    roots = written(components(ties.filter(F.col("level") >= depth).select("a", "b")), "candidates")
    size = roots.join(classes, roots["node"] == classes["set"]).select("set", "rep", "copies", "grams", "root")
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("grams") / CHUNK_GRAMS)).cast("long")
    # only components of several chunks, of which there are few, have to be looked up
    large = written(size.groupBy("root").agg(chunks.alias("chunks")).filter("chunks > 1"), "large")
    size = size.join(broadcast_if_small(large), "root", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    member = written(size.withColumn("chunk", F.pmod(F.xxhash64(F.lit(5), "set"), "chunks")), "members")
    total = member.agg(F.sum(F.col("grams") * F.col("chunks") * 8)).first()[0] or 0
    texts = member.hint("shuffle_hash").join(plain, member["rep.id"].eqNullSafe(plain["id"]) & (member["rep.tie"] == plain["tie"])).select("set", "root", "copies", "chunks", "chunk", "text")
    sets = texts.mapInArrow(_sets(n), "set binary, root binary, copies long, chunks long, chunk long, sets binary")
    pair = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("to")
    tiles = sets.select("set", "root", "copies", "chunk", "sets", pair).select("set", "root", "copies", "chunk", "sets", F.least("chunk", "to").alias("i"), F.greatest("chunk", "to").alias("j"))
    parts = parts_for(spark, total, 8 << 20)
    tiles = tiles.withColumn("part", F.pmod(F.xxhash64("root", "i", "j"), F.lit(parts)))
    found = written(tiles.groupBy("part").applyInPandas(_verify(threshold), "set binary, other binary, texts long, docs long"), "links")
    links = found.filter("other is null").groupBy("set").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    tied = written(components(found.filter("other is not null").select(F.col("set").alias("a"), F.col("other").alias("b"))), "tied")
    joined = classes.select("set", "rep", "copies").join(tied.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = written(joined.groupBy("root").agg(F.min("rep").alias("class"), F.count(F.lit(1)).alias("n")), "least")
    of = join_apart(joined, least, "root", "n", HOT).join(links, "set", "left").select("set", "copies", "class", (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_texts"))
    out = _with_classes(signed.select("id", "tie", "set"), written(of, "of"))
    if firsts:
        first = F.col("set").isNull() | F.col("id").eqNullSafe(F.col("class.id")) & (F.col("tie") == F.col("class.tie"))
        return out.select(F.col("id").alias(id), "tie", F.col("set").isNotNull().alias("grouped"), first.alias("first"))
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id), F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("class.id")).alias("class_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_texts", zero).alias("n_texts"))


def _with_classes(rows: DataFrame, of: DataFrame) -> DataFrame:
    """Each row with what is known of its set; rows without a set have nothing to join."""
    some = join_apart(rows.filter("set is not null"), of, "set", "copies", HOT)
    return some.unionByName(rows.filter("set is null").select("*", *[F.lit(None).cast(of.schema[c].dataType).alias(c) for c in ("class", "n_links", "n_texts")]))
