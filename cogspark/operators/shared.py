"""Tables in the folder that all executors share, and broadcasts behind a check of their size."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a side that travels to all executors may have: rows, and bytes of its rows as text.
SMALL_ROWS, SMALL_BYTES = 1_000_000, 64 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, or the warehouse where that is unset."""
    top = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder."""
    spark, to = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    """A broadcast hint, if the rows and bytes that are counted are few; without it Spark shuffles the join."""
    n, width = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if n <= rows and (width or 0) <= size else df


def _ranges(cells: DataFrame, by: tuple, order: list[str], sums: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The rows in ranges of (by, order), numbered as __part, and for each key that goes on from an earlier range what lies before.

    A range can go on with one key only, its first: the second table has at most a row for each partition.
    """
    cut = written(cells.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "running")
    total = cut.groupBy(*by, "__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    earlier = W.partitionBy(*(by or (F.lit(0),))).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    total = total.withColumn("__goes_on", F.lag("__part").over(W.partitionBy(*(by or (F.lit(0),))).orderBy("__part"))).withColumns({f"__{n}": F.sum(f"__{n}").over(earlier) for n in sums})
    return cut, total.filter("__goes_on is not null").select(*[F.col(c).alias(f"__by_{i}") for i, c in enumerate(by)], F.col("__part").alias("__p"), *[f"__{n}" for n in sums])


def _added(cut: DataFrame, before: DataFrame, by: tuple, own: dict, columns: list[str]) -> DataFrame:
    """own (a running expression by name) plus what lies before."""
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__by_{i}"))
    out = cut.join(F.broadcast(before), same, "left")  # at most a row for each partition
    out = out.withColumns({n: F.coalesce(F.col(f"__{n}"), F.lit(0)) + x for n, x in own.items()})
    return out.select(*[c for c in columns if c not in own], *own)


def running(cells: DataFrame, order: str, by: tuple = (), **sums: str) -> DataFrame:
    """Adds running sums over all rows, or all of a key, in one order, name=column; rows that are equal in order count in full for each.

    The order is cut into ranges; their totals, of which there are as many as keys and partitions, are added up first,
    and each range then goes on from what lies before it. No task sees more than its range, however hot a key is.
    """
    cut, before = _ranges(cells, tuple(by), [order], sums)
    inside = W.partitionBy(*by, "__part").orderBy(order)
    return _added(cut, before, tuple(by), {n: F.sum(c).over(inside) for n, c in sums.items()}, cells.columns)


def numbered(rows: DataFrame, by: tuple, order: list[str], name: str = "rank") -> DataFrame:
    """Adds each row's place from 1 within its key, in order, by ranges as in running(): no task has to hold a key.

    The ranges are written whole: select the columns that are needed first.
    """
    at = rows.withColumn(name, F.lit(1).cast("long"))
    cut, before = _ranges(at, tuple(by), order, {name: name})
    return _added(cut, before, tuple(by), {name: F.row_number().over(W.partitionBy(*by, "__part").orderBy(*order)).cast("long")}, rows.columns)


def chunked(rows: DataFrame, by: str, item: str = "item_id", size: int = 4096) -> DataFrame:
    """(by, chunk, ids ARRAY): each key's items in order, so many to a row; no task has to hold a key."""
    at = numbered(rows.select(by, item), (by,), [item], "place").withColumn("chunk", F.floor((F.col("place") - 1) / size))
    return written(at.groupBy(by, "chunk").agg(F.array_sort(F.collect_list(item)).alias("ids")), "chunks")


def changes(columns: list, before: list | None) -> tuple[np.ndarray, list]:
    """Where a key of several Arrow columns begins in sorted rows, given the last row before them, and the last row."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    for i, c in enumerate(columns):
        if n > 1:
            a, b = c.slice(1), c.slice(0, n - 1)
            differs = pc.fill_null(pc.not_equal(a, b), True)
            out[1:] |= pc.and_(differs, pc.invert(pc.and_(pc.is_null(a), pc.is_null(b)))).to_numpy(zero_copy_only=False)
        if before is None or c[0].as_py() != before[i]:
            out[0] = True
    return out, [c[n - 1].as_py() for c in columns]
