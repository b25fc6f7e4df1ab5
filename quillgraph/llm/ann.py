"""Approximate nearest neighbours by stable projections and kd-trees.

Gaussian (2-stable) projections to PROJECTED dimensions keep distances in distribution:
projected over true squared distance is chi-square with PROJECTED degrees of freedom.
The largest inner products are nearest points once norms are alike: in a band of norms
up to r, a query scaled to norm r has  q.x = |q| (r^2 + |x|^2 - |q' - x|^2) / 2r, so a
vector that beats the k-th best score lies within a known distance of q', and if its
projected distance is beyond what the chi-square law lets such a vector have with
probability CONFIDENCE, it is passed over. The test is about the original coordinates
alone; norms enter it exactly.

Index. Vectors are assigned to the cells of a kd-tree over projected points (fitted on
a bounded sample, every row indexed), cells are cut into shards, and each shard is
sorted once into the leaves of its own kd-trees, one for each band of norms, and kept
as a row of a table.

Search. Queries visit cells in the order of the best score that the test lets these
have, in rounds of 1, 2, 4, ... cells; inside a shard they take leaves in the same way,
and project leaf points incrementally: only points that pass the test at their own
projected distance are verified by the true inner product. All three levels stop by the
same test against the best k found so far, so a neighbour is lost only if its own
projected distance is unlikely.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.blocks import BLOCK_ROWS, SHARD_ROWS, matrix, merged_top, once, usable
from quillgraph.llm.common import table, written

PROJECTED = 16
LEAF = 64
CONFIDENCE = 0.95
SEED = 20
#: Vectors that fit the tree of cells, and cells, at most (larger cells have several
#: shards): the routing table has at most CELLS * BANDS rows and is broadcast.
SAMPLE = 65_536
CELLS = 2048
#: Bands of norms: each reaches down to 1 / BAND of its largest; the last one to 0.
BAND, BANDS = 1.15, 32
#: Queries of a task that advance together; found rows beyond k that are kept until
#: scores are summed in a fixed order.
CHUNK = 256
SPARE = 4


def projection(width: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(width, PROJECTED))


def chi2_quantile(p: float, k: int) -> float:
    """Of the chi-square distribution with an even number of degrees of freedom:
    its tail is a Poisson sum; found by bisection."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - tail(mid) < p else (lo, mid)
    return (lo + hi) / 2


def bands(norms: np.ndarray, radius: float) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.minimum(BANDS - 1, np.floor(np.log(radius / norms) / math.log(BAND) + 1e-9)).astype(np.int64)


def kd_leaves(points: np.ndarray, leaf: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(order, leaves as ranges of it): cut at the median of the widest side; points
    that are all the same stay together."""
    order, done, todo = np.arange(len(points)), [], [(0, len(points))]
    while todo:
        a, b = todo.pop()
        own = points[order[a:b]]
        if b - a <= leaf or not (side := own.max(0) - own.min(0)).any():
            done.append((a, b))
            continue
        mid = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, int(np.argmax(side))], mid)]
        todo += [(a + mid, b), (a, a + mid)]
    return order, [c for c in sorted(done) if c[1] > c[0]]


class Cells:
    """A kd-tree of about `n` cells over a sample of projected points."""

    def __init__(self, points: np.ndarray, n: int):
        self.cuts: list[tuple[int, float, int, int]] = []  # axis, value, child below, child above; children < 0 are cells
        self.n = 0
        self._grow(points, n)

    def _grow(self, points: np.ndarray, n: int) -> int:
        side = points.max(0) - points.min(0) if len(points) else np.zeros(0)
        if n <= 1 or not side.any():
            self.n += 1
            return -self.n
        axis = int(np.argmax(side))
        value = float(np.quantile(points[:, axis], (n // 2) / n))
        below = points[:, axis] < value
        if not below.any():
            value = float(points[points[:, axis] > value, axis].min())
            below = points[:, axis] < value
        at = len(self.cuts)
        self.cuts.append((axis, value, 0, 0))
        self.cuts[at] = (axis, value, self._grow(points[below], n // 2), self._grow(points[~below], n - n // 2))
        return at

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(0 if self.cuts else -1, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                axis, value, low, high = self.cuts[node]
                below = points[rows, axis] < value
                todo += [(low, rows[below]), (high, rows[~below])]
        return out


class Shard:
    """Vectors by leaf, with each leaf's box of projected points and largest norm."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, radius: float, leaf: int = LEAF):
        a = projection(x.shape[1])
        norms = np.sqrt((x**2).sum(1))
        band = bands(norms, radius)
        points = x @ a
        order, starts, low, high, top, own_band = [], [], [], [], [], []
        for b in np.unique(band):
            rows = np.flatnonzero(band == b)
            cut, leaves = kd_leaves(points[rows], leaf)
            base = sum(map(len, order))
            order.append(rows[cut])
            for s, e in leaves:
                own = rows[cut[s:e]]
                starts.append(base + s)
                low.append(points[own].min(0))
                high.append(points[own].max(0))
                top.append(norms[own].max())
                own_band.append(b)
        order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.x, self.ids, self.points, self.norms = x[order], ids[order], points[order], norms[order]
        self.starts = np.array([*starts, len(order)], np.int64)
        self.low, self.high = (np.array(v).reshape(-1, PROJECTED) for v in (low, high))
        self.top, self.band = np.array(top), np.array(own_band, np.int64)

    def row(self, cell: int, shard: int) -> dict:
        boxes = [(int(b), float(self.top[w].max()), self.low[w].min(0).tolist(), self.high[w].max(0).tolist()) for b in np.unique(self.band) for w in [self.band == b]]
        keep = {"x": self.x, "ids": self.ids, "starts": self.starts, "low": self.low, "high": self.high, "top": self.top}
        return {"cell": cell, "shard": shard, **{k: np.ascontiguousarray(v).tobytes() for k, v in keep.items()}, "boxes": [dict(zip(("band", "top", "low", "high"), b)) for b in boxes]}

    @classmethod
    def of(cls, row: dict, width: int) -> Shard:
        own = cls.__new__(cls)
        own.x = np.frombuffer(row["x"]).reshape(-1, width)
        own.ids, own.starts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["starts"], np.int64)
        own.low, own.high, own.top = (np.frombuffer(row[k]) for k in ("low", "high", "top"))
        own.low, own.high = own.low.reshape(-1, PROJECTED), own.high.reshape(-1, PROJECTED)
        own.points, own.norms = own.x @ projection(width), np.sqrt((own.x**2).sum(1))
        return own


def reach(points: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray, top: np.ndarray, limit: float) -> np.ndarray:
    """The best score that the test lets each query (projected, with its norm) have in
    each box whose vectors have norms up to `top`."""
    out = np.empty((len(points), len(top)))
    for at in range(0, len(points), CHUNK):
        own = slice(at, at + CHUNK)
        scale = top[None, :] / norms[own, None]
        far = np.zeros(scale.shape)
        for j in range(points.shape[1]):
            q = points[own, j : j + 1] * scale
            far += np.maximum(0, np.maximum(low[None, :, j] - q, q - high[None, :, j])) ** 2
        out[own] = norms[own, None] * (top[None, :] - far / (2 * top[None, :] * limit))
    return out


def search(shard: Shard, y: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int, *, confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query place, vec_id, inner product) of up to k found neighbours of each query
    that beat its floor (the k-th best found elsewhere), and how many pairs were
    verified."""
    limit, keep = chi2_quantile(confidence, PROJECTED), k + SPARE
    all_points, all_norms = y @ projection(y.shape[1]), np.sqrt((y**2).sum(1))
    out_q, out_v, verified = [], [], 0
    lengths = (shard.points**2).sum(1)
    for at in range(0, len(y), CHUNK):
        q, points, norms, ids = y[at : at + CHUNK], all_points[at : at + CHUNK], all_norms[at : at + CHUNK], query_ids[at : at + CHUNK]
        able = reach(points, norms, shard.low, shard.high, shard.top, limit)
        visit = np.argsort(-able, axis=1, kind="stable")
        able = np.take_along_axis(able, visit, 1)
        n_leaves = able.shape[1]
        best, where = np.full((len(q), keep), -np.inf), np.full((len(q), keep), -1)
        least = floor[at : at + CHUNK].copy()
        bar = least - 1e-9 * np.abs(np.nan_to_num(least, neginf=0.0))  # sums differ in their last bits
        live, step, per = np.flatnonzero(able[:, 0] >= least) if n_leaves else np.zeros(0, np.int64), 0, 2
        while len(live):
            take = visit[live, step : step + per]
            fit = able[live, step : step + per] >= least[live][:, None]
            owner, leaf = np.repeat(live, take.shape[1])[fit.ravel()], take.ravel()[fit.ravel()]
            order = np.argsort(leaf, kind="stable")
            owner, leaf = owner[order], leaf[order]
            starts = np.flatnonzero(np.diff(leaf, prepend=-1))
            got_q, got_s, got_v = [], [], []
            for s, e in zip(starts, np.append(starts[1:], len(leaf))):
                x0, x1 = shard.starts[leaf[s]], shard.starts[leaf[s] + 1]
                rows, top = owner[s:e], shard.top[leaf[s]]
                scale = (top / norms[rows])[:, None]
                p = points[rows] * scale
                far = (p**2).sum(1)[:, None] - 2 * p @ shard.points[x0:x1].T + lengths[None, x0:x1]
                with np.errstate(invalid="ignore"):
                    room = top**2 + shard.norms[None, x0:x1] ** 2 - 2 * scale * least[rows][:, None]
                look = (far <= limit * room) & (shard.ids[None, x0:x1] != ids[rows][:, None])
                r, c = np.nonzero(look)
                if not len(r):
                    continue
                verified += len(r)
                # where a good part of the tile passes, one matrix product is the cheaper way to the same numbers
                score = (q[rows] @ shard.x[x0:x1].T)[r, c] if 8 * len(r) > look.size else np.einsum("ij,ij->i", q[rows[r]], shard.x[x0 + c])
                good = score >= np.maximum(best[rows[r], keep - 1], bar[rows[r]])
                got_q.append(rows[r[good]])
                got_s.append(score[good])
                got_v.append(x0 + c[good])
            if got_q and sum(map(len, got_q)):
                gq, gs, gv = np.concatenate(got_q), np.concatenate(got_s), np.concatenate(got_v)
                touched = np.unique(gq)
                qq, ss, vv = np.concatenate([np.repeat(touched, keep), gq]), np.concatenate([best[touched].ravel(), gs]), np.concatenate([where[touched].ravel(), gv])
                order = np.lexsort((np.where(vv >= 0, shard.ids[vv], np.iinfo(np.int64).max), -ss, qq))
                qq, ss, vv = qq[order], ss[order], vv[order]
                heads = np.flatnonzero(np.diff(qq, prepend=-1))
                place = np.arange(len(qq)) - np.repeat(heads, np.diff(np.append(heads, len(qq))))
                stay = place < keep
                best[qq[stay], place[stay]], where[qq[stay], place[stay]] = ss[stay], vv[stay]
                least = np.maximum(least, best[:, k - 1])
            step, per = step + per, 2 * per
            if step >= n_leaves:
                break
            live = live[able[live, step] >= least[live]]
        r, c = np.nonzero(where >= 0)
        out_q.append(at + r)
        out_v.append(where[r, c])
    r, v = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in (out_q, out_v))
    return r, shard.ids[v], summed(y, r, shard.x, v), verified


def summed(y: np.ndarray, r: np.ndarray, x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last, whatever the batch."""
    out = np.zeros(len(r))
    for j in range(y.shape[1]):
        out += y[r, j] * x[v, j]
    return out


BOXES = "array<struct<band: long, top: double, low: array<double>, high: array<double>>>"
PARTS = ("x", "ids", "starts", "low", "high", "top")


def index(vectors: DataFrame, n: int, width: int, radius: float, *, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index table of vectors(vec_id, v): a row per shard of about shard_rows."""
    n_cells = min(CELLS, max(1, -(-n // shard_rows)))
    cells = Cells(np.zeros((0, PROJECTED)), 1)
    if n_cells > 1:
        some = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 20)) < max(1, int((1 << 20) * SAMPLE / n))) if n > SAMPLE else vectors

        def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in matrix(pa.chunked_array([b.column(0)]), width) @ projection(width)], pa.binary())], names=["p"])

        points = np.array([np.frombuffer(r.p) for r in some.select("v").mapInArrow(project, "p binary").collect()]).reshape(-1, PROJECTED)
        cells = Cells(points, n_cells)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = matrix(pa.chunked_array([b.column(1)]), width) @ projection(width)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.of(points))], names=["vec_id", "v", "cell"])

    put = written(vectors.select("vec_id", "v").mapInArrow(assign, "vec_id long, v array<double>, cell long"), "ann-cells")
    sizes = put.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"))  # at most CELLS rows
    dealt = put.join(F.broadcast(sizes), "cell").withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("shards")))

    def build(group: pa.Table) -> pa.Table:
        own = Shard(matrix(group.column("v"), width), group.column("vec_id").to_numpy(), radius)
        row = own.row(group.column("cell")[0].as_py(), group.column("shard")[0].as_py())
        boxes = pa.list_(pa.struct([("band", pa.int64()), ("top", pa.float64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))
        schema = pa.schema([("cell", pa.int64()), ("shard", pa.int64()), *((k, pa.binary()) for k in PARTS), ("boxes", boxes)])
        return pa.Table.from_pylist([row], schema=schema)

    kinds = ", ".join(f"{k} binary" for k in PARTS)
    return written(dealt.select("cell", "shard", "vec_id", "v").groupBy("cell", "shard").applyInArrow(build, f"cell long, shard long, {kinds}, boxes {BOXES}"), "ann-index")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, *, confidence: float = CONFIDENCE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest found of each query: (query_id, rank, vec_id, score).

    Both are (vec_id, v array<double>); a query's own vec_id is no candidate. Of rows
    that repeat a vec_id, the one with the least vector takes part, on both sides.
    Zero vectors must not be among the queries."""
    vectors, queries = once(vectors), once(queries)
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    seen = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("radius"), F.max(F.size("v")).alias("width")).first()
    width = max(seen.width or 0, queries.agg(F.max(F.size("v"))).first()[0] or 0)
    spark, schema = vectors.sparkSession, "query_id long, vec_id long, score double"
    if not seen.n or not width:
        return merged_top(spark.createDataFrame([], schema), k)
    shards = index(vectors, seen.n, width, seen.radius, shard_rows=shard_rows)
    box = shards.select("cell", F.explode("boxes").alias("b"))
    edges = [e for j in range(PROJECTED) for e in (F.min(F.col("b.low")[j]).alias(f"low{j}"), F.max(F.col("b.high")[j]).alias(f"high{j}"))]
    routes = box.groupBy("cell", F.col("b.band").alias("band")).agg(F.max("b.top").alias("top"), *edges).orderBy("cell", "band").collect()  # at most CELLS * BANDS rows
    low, high = (np.array([[r[f"{w}{j}"] for j in range(PROJECTED)] for r in routes]) for w in ("low", "high"))
    top, cell = np.array([r.top for r in routes]), np.array([r.cell for r in routes])
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    limit = chi2_quantile(confidence, PROJECTED)

    def routing(done: int, step: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                y = matrix(pa.chunked_array([b.column(1)]), width)
                able = np.maximum.reduceat(reach(y @ projection(width), np.sqrt((y**2).sum(1)), low, high, top, limit), first, axis=1)
                order = np.argsort(-able, axis=1, kind="stable")[:, done : done + step]
                able = np.take_along_axis(able, order, 1)
                floor = b.column(2).to_numpy(zero_copy_only=False)
                r, c = np.nonzero(able >= floor[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(cell[first][order[r, c]]), *(b.column(i).take(pa.array(r)) for i in range(3))], names=["cell", "query_id", "q", "floor"])

        return run

    def visit(group: pa.Table) -> pa.Table:
        is_query = pc.is_valid(group.column("query_id")).combine_chunks()
        asked, held = group.filter(is_query), group.filter(pc.invert(is_query))
        out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not asked.num_rows or not held.num_rows:
            return out.empty_table()
        ids = asked.column("query_id").to_numpy()
        r, vec, score, _ = search(Shard.of({p: held.column(p)[0].as_py() for p in PARTS}, width), matrix(asked.column("q"), width), ids, asked.column("floor").to_numpy(), k, confidence=confidence)
        return pa.table({"query_id": ids[r], "vec_id": vec, "score": score}, schema=out)

    state = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.lit(float("-inf")).alias("floor"))
    best, done, step = None, 0, 1
    while done < len(first):
        visits = written(state.mapInArrow(routing(done, step), "cell long, query_id long, q array<double>, floor double"), "ann-visits")
        done, step = done + step, 2 * step
        if visits.isEmpty():
            break
        blocks = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))  # at most CELLS rows
        own = visits.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(2)), F.col("blocks"))).drop("blocks")
        numbers = shards.select("cell", "shard")
        asks = own.join(numbers, "cell").select("cell", "shard", "block", "query_id", "q", "floor", *(F.lit(None).cast("binary").alias(p) for p in PARTS))
        holds = shards.join(F.broadcast(blocks), "cell").select("cell", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("q"), F.lit(None).cast("double").alias("floor"), *PARTS)
        found = asks.unionByName(holds).groupBy("cell", "shard", "block").applyInArrow(visit, schema)
        found = found if best is None else found.unionByName(best.select("query_id", "vec_id", "score"))
        best = written(merged_top(found, k), "ann-best")
        kth = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        state = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).join(kth, "query_id", "left").select("query_id", "q", F.coalesce("kth", F.lit(float("-inf"))).alias("floor"))
    return best if best is not None else merged_top(spark.createDataFrame([], schema), k)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose vec_id is divisible by 20, by inner
    product. Null, zero, or non-finite vectors take no part; shorter ones end in zeros;
    with fewer than 20 candidates all are returned; of rows that repeat a vec_id the one
    with the least vector takes part; other columns are ignored; an empty table gives no
    rows."""
    vectors = usable(table(spark, sf_dir, "embeddings"), zero=False)
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)
