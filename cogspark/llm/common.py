"""What the operators of this subpackage share: shared-folder tables, folds, size-checked broadcasts and byte hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts' words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows a broadcast side may have, after a count; wider or longer sides are shuffled instead.
BROADCAST_ROWS = 500_000
#: Rows from which on a key is joined apart: those are few, and a hot one's rows stay where they are.
HOT = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        if found.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            warnings.warn(f"spark.checkpoint.dir is not set and {found} may be a folder of this machine alone", stacklevel=2)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder."""
    spark, to = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """Like written(), bucketed by key, so that later joins on it leave these rows where they are."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    (df.write.option("compression", "zstd").option("path", scratch(spark, name)).bucketBy(n, key).saveAsTable(table))
    return spark.table(table)


def fold(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % mod


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the counted rows are few; without it Spark shuffles the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_apart(rows: DataFrame, side: DataFrame, key: str, n: str, hot: int = HOT) -> DataFrame:
    """rows with side's columns by key. Keys of which side says that they have `hot` rows or more are joined apart."""
    large, rest = broadcast_if_small(side.filter(F.col(n) >= hot).drop(n)), side.filter(F.col(n) < hot).drop(n)
    return rows.join(large, key).unionByName(rows.join(large.select(key), key, "left_anti").join(rest, key))


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one made from it, that is no column of df."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def parts_for(spark: SparkSession, n_bytes: float, per_part: float) -> int:
    """Partitions of about per_part bytes each, at least two a core."""
    return int(max(2 * spark.sparkContext.defaultParallelism, np.ceil(n_bytes / per_part)))


def release() -> None:
    """Gives a worker's freed memory back to the system: workers are kept between tasks, beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A task's function over batches that releases memory at its end."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and the offset of each (nulls are empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, (offsets - offsets[0]).astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    """Tables of about `most` text bytes each; a longer text is a table of its own."""
    held, size = [], 0
    for batch in batches:
        lengths = np.diff(text_bytes(batch.column(column))[1])
        start = 0
        for i, n in enumerate(lengths):
            if size and size + n > most:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, size, start = [], 0, i
            size += int(n)
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_R = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        n = 1 << int(n - 1).bit_length() if n > 1 else 1
        for k, r in (("p", _R), ("q", pow(_R, -1, 1 << 64))):
            x = np.full(n, r, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS["p"], _POWERS["q"]


class SpanHash:
    """64-bit hashes of any spans of a byte array: equal bytes, equal hash."""

    def __init__(self, body: np.ndarray):
        n = len(body)
        p, self.inverse = _powers(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((body.astype(np.uint64) + np.uint64(1)) * p[:n], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])


def words(body: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts that lie one after another: bytes (A-Z lower-cased), starts, ends, and the text of each."""
    if lower:
        body = body + np.where((body >= 65) & (body <= 90), 32, 0).astype(np.uint8)
    inside = ~((body == 32) | ((body >= 9) & (body <= 13)))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(body))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return body, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def whole(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def quantised(vectors: DataFrame, scale: float, vector: str = "v") -> tuple[DataFrame, int]:
    """vectors (whole ones, as doubles) with floor(scale * c) cut to a long's range, zeros up to the longest one's length d, and d."""
    d = vectors.agg(F.max(F.size(vector))).first()[0] or 0
    x = F.transform(vector, lambda c: F.floor(c * F.lit(float(scale))).cast("double") + F.lit(0.0))
    x = F.when(F.size(vector) == d, x).otherwise(F.concat(x, F.array_repeat(F.lit(0.0), F.lit(d) - F.size(vector))))
    return vectors.withColumn(vector, x), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """(n, d) doubles of a list column of whole, equally long vectors."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)
