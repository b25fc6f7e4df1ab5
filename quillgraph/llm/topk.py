"""Exact top-k search by a three-phase uniform threshold.

A vector's inner product is the sum of LISTS local scores, one for each group of
dimensions.

1. Gather: the heads of the lists. Each dimension's list, sorted by value, gives its
   highest and lowest vectors; they are at most HEADS in all, so they may be broadcast.
   A query scores them exactly, and its k-th best is a safe cutoff: k vectors reach it.
2. Cut: if all local scores were below cutoff / LISTS, so would be their sum below the
   cutoff. Entries of the lists that are read are known; the last list is bounded by its
   norms. A vector goes on only if some local score can reach the uniform threshold, and
   the sum of what is known and the bound can reach the cutoff.
3. Resolve: what is left gets its last local score and with it the exact total. The k
   best of a task so far raise its cutoffs as it goes on.

All arithmetic is on integers. A cutoff belongs to a query's row, since queries grow
with the data.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.blocks import matrix, merged_top, once, paired, usable
from quillgraph.llm.common import table, written

LISTS = 4
SCALE = 256
#: Head vectors in all, at most, and components that they have in all, at most.
HEADS, HEAD_CELLS = 8192, 1 << 22
#: Queries by vectors whose local scores a task holds at once.
CHUNK, TILE = 256, 4096


def quantised(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(256 * x) of both; doubles where all sums are exact in them, else integers
    of any size."""
    x, y = np.floor(SCALE * x), np.floor(SCALE * y)
    bound = np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(1, x.shape[1])
    if bound < 2.0**53:
        return x, y
    big = np.frompyfunc(int, 1, 1)
    return big(x).astype(object), big(y).astype(object)


def groups(width: int) -> list[np.ndarray]:
    """The dimensions of each list; lists without dimensions are left out."""
    return [g for g in np.array_split(np.arange(width), LISTS) if len(g)]


def resolve(x: np.ndarray, ids: np.ndarray, y: np.ndarray, query_ids: np.ndarray, cutoff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Phases 2 and 3: (query place, vec_id, score) of the k best of each query that
    reach its cutoff (-inf: all), and how many pairs were resolved."""
    x, y = quantised(x, y)
    if x.dtype == object:
        return _resolve_big(x, ids, y, query_ids, cutoff, k)
    lists = groups(x.shape[1])
    rest = lists[-1] if lists else np.arange(0)
    x_rest, y_rest = np.sqrt((x[:, rest] ** 2).sum(1)), np.sqrt((y[:, rest] ** 2).sum(1))
    cut = cutoff.astype(np.float64).copy()
    q, v, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    resolved = 0
    for at in range(0, len(y), CHUNK):
        own = slice(at, at + CHUNK)
        for lo in range(0, len(x), TILE):
            part = slice(lo, lo + TILE)
            # bounds are rounded up, so nothing that can reach the cutoff is lost
            bound = y_rest[own, None] * x_rest[None, part] * (1 + 1e-12) + 1e-6
            known, top = np.zeros(bound.shape), bound.copy()
            for g in lists[:-1]:
                local = y[own][:, g] @ x[part][:, g].T
                known += local
                np.maximum(top, local, out=top)
            least = cut[own, None]
            with np.errstate(invalid="ignore"):
                look = (len(lists) * top >= least) & (known + bound >= least) & (ids[None, part] != query_ids[own, None])
            r, c = np.nonzero(look)
            if not len(r):
                continue
            resolved += len(r)
            last = (y[own][:, rest] @ x[part][:, rest].T)[r, c] if 8 * len(r) > look.size else np.einsum("ij,ij->i", y[at + r][:, rest], x[lo + c][:, rest])
            total = known[r, c] + last
            good = total >= cut[at + r]
            q, v, s = np.concatenate([q, at + r[good]]), np.concatenate([v, lo + c[good]]), np.concatenate([s, total[good]])
            order = np.lexsort((ids[v], -s, q))
            q, v, s = q[order], v[order], s[order]
            heads = np.flatnonzero(np.diff(q, prepend=-1))
            place = np.arange(len(q)) - np.repeat(heads, np.diff(np.append(heads, len(q))))
            q, v, s, place = q[place < k], v[place < k], s[place < k], place[place < k]
            kth = place == k - 1
            cut[q[kth]] = np.maximum(cut[q[kth]], s[kth])
    return q, ids[v], s.astype(np.int64), resolved


def _resolve_big(x: np.ndarray, ids: np.ndarray, y: np.ndarray, query_ids: np.ndarray, cutoff: np.ndarray, k: int):
    """The same on integers of any size, without bounds by norms."""
    q, v, s = [], [], []
    for i in range(len(y)):
        total = x @ y[i]
        best = sorted((-t, int(j)) for t, j in zip(total, ids) if j != query_ids[i] and t >= cutoff[i])[:k]
        q += [i] * len(best)
        v += [j for _, j in best]
        s += [_long(-t) for t, _ in best]
    return np.array(q, np.int64), np.array(v, np.int64), np.array(s, np.int64), len(x) * len(y)


def _long(v) -> int:
    """Within 64 bits: sums beyond them are held at the bounds."""
    return max(-(2**63), min(2**63 - 1, int(v)))


def list_heads(vectors: DataFrame, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(vec_ids, vectors): the heads of the dimensions' lists, both ends.

    Each task keeps its own heads before the shuffle; where HEADS don't suffice for all
    dimensions, the first ones are taken: any vectors make a safe cutoff."""
    most = max(2 * (k + 1), min(HEADS, HEAD_CELLS // width))
    each = max(k + 1, most // (2 * width))
    dims = max(1, min(width, most // (2 * each)))

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_ids, kept = np.zeros(0, np.int64), np.zeros((0, width))
        for b in batches:
            kept_ids = np.concatenate([kept_ids, b.column(0).to_numpy()])
            kept = np.concatenate([kept, matrix(pa.chunked_array([b.column(1)]), width)])
            if len(kept) > 4 * most:
                stay = np.unique(np.concatenate([e for d in range(dims) for o in [_order(kept[:, d], kept_ids)] for e in (o[:each], o[-each:])]))
                kept_ids, kept = kept_ids[stay], kept[stay]
        rows = [(2 * d + up, place, score) for d in range(dims) for o in [_order(kept[:, d], kept_ids)] for up, e in ((0, o[:each]), (1, o[::-1][:each])) for place, score in zip(e, kept[e, d] * (1, -1)[up])]
        if rows:
            lists, place, score = (np.array(c) for c in zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(score), pa.array(kept_ids[place]), pa.array([kept[p].tobytes() for p in place], pa.binary())], names=["list", "score", "vec_id", "v"])

    heads = vectors.select("vec_id", "v").mapInArrow(own, "list int, score double, vec_id long, v binary")
    rank = F.row_number().over(Window.partitionBy("list").orderBy("score", "vec_id"))
    rows = heads.withColumn("rank", rank).where(F.col("rank") <= each).groupBy("vec_id").agg(F.first("v").alias("v")).orderBy("vec_id").collect()  # at most `most` rows
    return np.array([r.vec_id for r in rows], np.int64), np.array([np.frombuffer(r.v) for r in rows]).reshape(-1, width)


def _order(values: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, values))


def cutoffs(queries: DataFrame, ids: np.ndarray, heads: np.ndarray, width: int, k: int) -> DataFrame:
    """Phase 1: the queries with a column cutoff, null where there are fewer than k heads
    or numbers beyond 62 bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = quantised(heads, matrix(pa.chunked_array([b.column(1)]), width))
            own = b.column(0).to_numpy()
            out: list[int | None] = []
            for at in range(0, len(y), CHUNK):
                for i, score in zip(own[at : at + CHUNK], y[at : at + CHUNK] @ x.T):
                    rest = score[ids != i]
                    kth = int(sorted(rest)[-k] if rest.dtype == object else np.partition(rest, len(rest) - k)[len(rest) - k]) if len(rest) >= k else None
                    out.append(kth if kth is not None and abs(kth) < 2**62 else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=["vec_id", "v", "cutoff"])

    return queries.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, cutoff long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k highest integer scores of each query: (query_id, rank, vec_id, score).

    Both are (vec_id, v array<double>); of rows that repeat a vec_id the one with the
    least vector takes part. Shorter vectors end in zeros; with fewer than k candidates
    all are returned."""
    vectors, queries = once(vectors), once(queries)
    seen = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    asked_size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    width = max(1, seen.width or 0, asked_size.width or 0)
    ids, heads = list_heads(vectors, width, k)
    asked = written(cutoffs(queries, ids, heads, width, k), "topk-cutoffs")
    rows = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def second(group: pa.Table) -> pa.Table:
        is_query = group.column("is_query").combine_chunks()
        q, v = group.filter(is_query), group.filter(pc.invert(is_query))
        if not q.num_rows or not v.num_rows:
            return rows.empty_table()
        query_ids = q.column("vec_id").to_numpy()
        cut = np.array([-np.inf if c is None else c for c in q.column("cutoff").to_pylist()], np.float64)
        cut = np.where(np.abs(cut) < 2.0**53, cut, cut - 2 * np.spacing(np.abs(np.nan_to_num(cut, neginf=0.0))))
        r, vec, score, _ = resolve(matrix(v.column("v"), width), v.column("vec_id").to_numpy(), matrix(q.column("v"), width), query_ids, cut, k)
        return pa.table({"query_id": query_ids[r], "vec_id": vec, "score": score}, schema=rows)

    both = paired(vectors.select("vec_id", "v", F.lit(None).cast("long").alias("cutoff")), asked, seen.n, asked_size.n)
    return merged_top(both.groupBy("block", "shard").applyInArrow(second, "query_id long, vec_id long, score long"), k)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer scores of every vector whose vec_id is divisible by 50.

    Null vectors and those with null or non-finite components take no part, zero vectors
    do; shorter ones end in zeros; of rows that repeat a vec_id the one with the least
    vector takes part; other columns are ignored; an empty table gives no rows; scores
    beyond 64 bits are held at the bounds."""
    vectors = usable(table(spark, sf_dir, "embeddings"), zero=True)
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


ORACLE = """
WITH u AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM u q JOIN u c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
