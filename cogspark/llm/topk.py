"""Exact top-k search by inner product over integer vectors: columnar branch-and-bound.

Spark deals the work in tiles: blocks of queries by groups of rows, both of bounded expected size, meet in a shuffle;
nothing goes through the driver. A task holds a tile's queries, streams its rows through a vertical layout (a row for
each dimension) and adds up the products dimension block by block. After each block a query keeps only the candidates
whose sum so far, plus the most that the remaining dimensions can add (the product of the remaining lengths, by
Cauchy-Schwarz), reaches the query's k-th best full score so far. Each tile hands on k rows a query; a window picks the
best of those. Groups are salted by the partition a row comes from, so that repeated rows are spread.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as
ending in zeros; ties go to the smaller id; rows with the query's own id are no candidates; of repeated rows each is a
candidate, but all are one query; rows without an id take no part; scores beyond a long are cut to its range; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import tidy

SCHEMA = "query_id long, vec_id long, score long"
#: Queries and rows of a tile (about, as a hash deals them), candidates that are searched at once, dimensions in a block.
QUERY_BLOCK, GROUP, ROWS, DIMS = 2048, 1 << 18, 16384, 16
#: Whole numbers that doubles add up exactly.
_EXACT = float(1 << 53)


def to_ints(vectors: list, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of each component as doubles (n, d), and which vectors take part."""
    arrays = [None if v is None else np.array([np.nan if x is None else x for x in v] if any(x is None for x in v) else v, np.float64) for v in vectors]
    ok = np.array([v is not None and bool(np.isfinite(v).all()) for v in arrays], bool)
    d = max((len(v) for v, y in zip(arrays, ok) if y), default=0)
    out = np.zeros((len(arrays), d))
    for i in np.flatnonzero(ok):
        out[i, : len(arrays[i])] = arrays[i]
    return np.floor(scale * out), ok


def _batch_ints(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The same from an Arrow list column, at once if all vectors are whole and equally long."""
    if column.null_count == 0 and len(column):
        lengths = np.diff(column.offsets.to_numpy())
        flat = column.flatten()
        if len(set(lengths.tolist())) == 1 and lengths[0] and flat.null_count == 0:
            x = flat.to_numpy().astype(np.float64).reshape(len(column), lengths[0])
            ok = np.isfinite(x).all(1)
            return np.floor(scale * np.where(ok[:, None], x, 0)), ok
    return to_ints(column.to_pylist(), scale)


def _wide(x: np.ndarray, d: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, d - x.shape[1]))) if x.shape[1] < d else x


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= least
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search_block(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, best: list) -> None:
    """Improves best[i] = (scores, ids) of each query by the candidates c (n, d)."""
    d = max(q.shape[1], c.shape[1])
    q, c = _wide(q, d), _wide(c, d)
    if not len(c) or not d:
        if len(c):
            for i in range(len(q)):
                other = c_ids != q_ids[i]
                best[i] = _best(np.concatenate([best[i][0], np.zeros(other.sum())]), np.concatenate([best[i][1], c_ids[other]]), k)
        return
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * d >= _EXACT:
        _search_large(q, q_ids, c, c_ids, k, best)
        return
    columns = np.ascontiguousarray(c.T)  # vertical layout
    cuts = [*range(0, d, DIMS), d]
    tail = lambda x: [np.sqrt((x[:, b:] ** 2).sum(1)) for b in cuts[1:]]
    q_left, c_left = tail(q), tail(c)
    first = q[:, : cuts[1]] @ columns[: cuts[1]]
    for i in range(len(q)):
        held, ids = best[i]
        at, part = np.flatnonzero(c_ids != q_ids[i]), None
        part = first[i, at]
        for b in range(1, len(cuts)):
            if len(held) >= k:
                reach = part + q_left[b - 1][i] * c_left[b - 1][at]
                live = reach * (1 + 1e-9) + 1e-6 * (1 + np.abs(reach)) >= held[-1]
                at, part = at[live], part[live]
            if b == len(cuts) - 1 or not len(at):
                break
            lo, hi = cuts[b], cuts[b + 1]
            part = part + q[i, lo:hi] @ columns[lo:hi][:, at]
            if b == 1 and len(held) < k and len(at) > 64 * k:  # a first bound: the full scores of those that lead
                lead = np.argpartition(part, len(part) - k)[len(part) - k :]
                full = q[i] @ columns[:, at[lead]]
                held = np.sort(full)[::-1]
                held = held[:k]
                ids = None
        if ids is None:
            held, ids = best[i]
        if len(at):
            best[i] = _best(np.concatenate([held, part]), np.concatenate([ids, c_ids[at]]), k)


def _search_large(q, q_ids, c, c_ids, k, best) -> None:
    """The same in Python's whole numbers, for products that doubles do not hold."""
    most, least = (1 << 63) - 1, -(1 << 63)
    whole = [[int(x) for x in row] for row in c]
    for i in range(len(q)):
        a = [int(x) for x in q[i]]
        new = [(min(most, max(least, sum(x * y for x, y in zip(a, row)))), int(j)) for row, j in zip(whole, c_ids) if j != q_ids[i]]
        every = sorted([*zip(map(int, best[i][0]), map(int, best[i][1])), *new], key=lambda x: (-x[0], x[1]))[:k]
        best[i] = (np.array([x[0] for x in every], object), np.array([x[1] for x in every], np.int64))


def _tiles(k: int, scale: float):
    """Rows (tile, is_row, id, vector), each tile's queries before its rows, to the best k of each query and tile."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries, held = None, [], []
        best: list = []

        def stack(parts):
            d = max((x.shape[1] for x, _ in parts), default=0)
            return np.concatenate([np.zeros((0, d)), *(_wide(x, d) for x, _ in parts)]), np.concatenate([np.zeros(0, np.int64), *(y for _, y in parts)])

        def flush():
            q, q_ids = queries[0] if len(queries) == 1 else stack(queries)
            queries[:] = [(q, q_ids)]
            if len(best) < len(q_ids):
                best.extend((np.zeros(0), np.zeros(0, np.int64)) for _ in range(len(q_ids) - len(best)))
            if held:
                search_block(q, q_ids, *stack(held), k, best)
                held.clear()

        def close():
            flush()
            q_ids = queries[0][1]
            for lo in range(0, len(q_ids), 4096):
                some = [(int(q_ids[i]), int(y), int(s)) for i in range(lo, min(lo + 4096, len(q_ids))) for s, y in zip(*best[i])]
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*some)], ["query_id", "vec_id", "score"])
            queries.clear()
            best.clear()

        for batch in batches:
            tile, is_row = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((tile[1:] != tile[:-1]) | (is_row[1:] != is_row[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(tile)]):
                if hi == lo:
                    continue
                if tile[lo] != now and now is not None:
                    yield from close()
                now = tile[lo]
                x, ok = _batch_ints(batch.column(3).slice(lo, hi - lo), scale)
                (held if is_row[lo] else queries).append((x[ok], batch.column(2).to_numpy()[lo:hi][ok]))
                if sum(len(y) for _, y in held) >= ROWS:
                    flush()
        if now is not None:
            yield from close()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding", scale: float = 1024.0, block: int = QUERY_BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows with the highest inner products for each row that is_query marks."""
    spark = vectors.sparkSession
    whole = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    narrow = lambda df: df.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector")).filter("id is not null and vector is not null").filter(whole)
    rows, queries = narrow(vectors), narrow(vectors.filter(is_query)).distinct()
    n_rows, n_queries = rows.count(), queries.count()
    blocks = max(1, -(-n_queries // block))
    groups = max(1, -(-n_rows // group), -(-2 * spark.sparkContext.defaultParallelism // blocks) if n_rows > ROWS else 1)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    of_block, of_group = F.pmod(F.xxhash64("id"), F.lit(blocks)), F.pmod(F.xxhash64("id") + F.spark_partition_id() * F.lit(0x9E3779B1), F.lit(groups))
    asked = queries.select("id", "vector", of_block.alias("b"), each(groups).alias("g")).select((F.col("g") * blocks + F.col("b")).alias("tile"), F.lit(False).alias("is_row"), "id", "vector")
    given = rows.select("id", "vector", of_group.alias("g"), each(blocks).alias("b")).select((F.col("g") * blocks + F.col("b")).alias("tile"), F.lit(True).alias("is_row"), "id", "vector")
    tiles = asked.unionByName(given).repartitionById(blocks * groups, F.col("tile").cast("int")).sortWithinPartitions("tile", "is_row")
    found = tiles.mapInArrow(_tiles(k, scale), SCHEMA)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").filter(F.col("rank") <= k)
