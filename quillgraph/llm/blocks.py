"""A stated query set against all rows, in blocks.

Vectors are dealt by a hash of their id into shards of about `shard_rows`, queries into
blocks of about `block_rows`; each (block, shard) pair is one group that holds both, so
a task's memory has a bound at any input size, and a lost task is one pair to redo.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_ROWS = 16_384
BLOCK_ROWS = 2_048


def usable(vectors: DataFrame, *, zero: bool) -> DataFrame:
    """(vec_id, v array<double>) of the rows whose vectors take part: not null, all
    components finite, and, unless `zero`, one of them not 0."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.lit(True) if zero else F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~odd & some)


def once(vectors: DataFrame) -> DataFrame:
    """The rows with each vec_id once: of several, the one with the least vector. Ids
    alone are counted first, so vectors move only where an id is repeated."""
    n = vectors.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("ids")).first()
    return vectors if n.n == n.ids else vectors.groupBy("vec_id").agg(F.min("v").alias("v"))


def dealt(rows: DataFrame, n_rows: int, size: int, seed: int) -> tuple[Column, int]:
    n = max(1, -(-n_rows // size))
    return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int"), n


def paired(vectors: DataFrame, queries: DataFrame, n_vectors: int, n_queries: int, *, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (block, shard, is_query, ...) such that each group (block, shard) has the
    block's queries and the shard's vectors. Both frames have the same columns."""
    shard, n_shards = dealt(vectors, n_vectors, shard_rows, 1)
    block, n_blocks = dealt(queries, n_queries, block_rows, 2)
    left = vectors.select("*", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(False).alias("is_query"))
    right = queries.select("*", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.lit(True).alias("is_query"))
    return left.unionByName(right)


def matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.float64()))
    offsets = lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(width or 0, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def merged_top(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query's rows, highest score
    first, ties to the smaller vec_id. Groups hold k rows a shard at most; the window's
    group limit keeps k of them in each task before the shuffle."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
