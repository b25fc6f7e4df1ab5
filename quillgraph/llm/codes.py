"""Vector code compression: codebooks by k-means on parts of vectors, entries found by
annular norm pruning.

A vector is cut into equal consecutive parts; a part's code is the number of the nearest
entry of that position's codebook. Since | |q| - |e| | <= d(q, e), an entry can only be as
near as the best found if its norm lies within that distance of the part's own norm. So
entries are sorted by norm, the two whose norms lie around the part's give a first distance,
a binary search finds the interval of norms it allows, ends included, and only that annulus
is evaluated, exactly, in whole numbers; from the part's own norm outwards, so that nearer
entries narrow it on the way.

Codebooks have parts x entries x width / parts numbers, whatever the rows: they alone pass
through the driver. Sums for the next codebook are added up in each task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.blocks import matrix
from quillgraph.llm.common import small_batches, table, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Components are held within these bounds, so that distances of 4,096 components fit in 64 bits.
MOST = 1 << 26
#: Numbers in an annulus' working table.
WORKING = 1 << 22
SALTS = 16


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v array<int>) of the rows whose vectors are whole: not null, no
    component null, NaN or infinite. Components become floor(256 x)."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    odd = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform("x", lambda c: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), c * SCALE))).cast("int"))
    rows = vectors.select("vec_id", "label", x.alias("x")).where(F.col("x").isNotNull())
    return rows.where(~odd).select("vec_id", "label", scaled.alias("v"))


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) of each row of `parts`, ties to the lower entry, and how
    many distances were evaluated."""
    squares = (entries * entries).sum(1)
    order = np.argsort(squares, kind="stable")
    ring, norms = entries[order], np.sqrt(squares[order].astype(np.float64))
    codes, found, evaluated = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), 0
    step = max(1, WORKING // max(1, entries.size))
    for begin in range(0, len(parts), step):
        x = parts[begin : begin + step]
        own = np.sqrt((x * x).sum(1).astype(np.float64))
        best, code = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(order))

        def evaluate(low: np.ndarray, high: np.ndarray, x=x, best=best, code=code) -> int:
            """Entries low to high of the ring, for each row exactly."""
            some = np.flatnonzero(high > low)
            sizes = (high - low)[some]
            starts = np.cumsum(sizes) - sizes
            row = np.repeat(some, sizes)
            at = np.arange(len(row)) - np.repeat(starts - low[some], sizes)
            far = ((x[row] - ring[at]) ** 2).sum(1)
            if len(some):
                least = np.minimum(np.minimum.reduceat(far, starts), best[some])
                code[some] = np.where(least < best[some], len(order), code[some])
                best[some] = least
                code[some] = np.minimum(np.minimum.reduceat(np.where(far == best[row], order[at], len(order)), starts), code[some])
            return len(row)

        # what is evaluated grows outwards from the part's own norm, within what the best
        # distance so far allows
        low = np.clip(np.searchsorted(norms, own) - 1, 0, len(norms) - 1)
        high, spread = np.minimum(low + 2, len(norms)), 2
        evaluated += evaluate(low, high)
        while True:
            reach = np.sqrt(best.astype(np.float64))
            reach += 1e-12 * (own + reach) + 1e-9  # rounding never narrows the annulus
            first, last = np.searchsorted(norms, own - reach, "left"), np.searchsorted(norms, own + reach, "right")
            if (low <= first).all() and (high >= last).all():
                break
            next_low, next_high = np.minimum(low, np.maximum(first, low - spread)), np.maximum(high, np.minimum(last, high + spread))
            evaluated += evaluate(next_low, low) + evaluate(high, next_high)
            low, high, spread = next_low, next_high, 2 * spread
        codes[begin : begin + step], found[begin : begin + step] = code, best
    return codes, found, evaluated


def cut_parts(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """(rows, parts, width / parts) whole numbers; shorter vectors end in zeros."""
    return matrix(pa.chunked_array([column]), parts * width).astype(np.int64).reshape(-1, parts, width)


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), a column for each part."""
    pairs = [nearest(x[:, p], books[p])[:2] for p in range(x.shape[1])]
    return np.stack([c for c, _ in pairs], 1), np.stack([d for _, d in pairs], 1)


def start_books(kept: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """The parts of the `entries` smallest vec_ids (ties by vector, null last), at most that
    many rows; the width is the longest vector's, raised to a multiple of `parts`."""
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    width = max(1, -(-longest // parts))
    x = np.zeros((len(rows), parts * width), np.int64)
    for i, r in enumerate(rows):
        x[i, : len(r.v)] = r.v
    return x.reshape(-1, parts, width).transpose(1, 0, 2).copy()


def next_books(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part goes to its nearest entry, every used entry becomes the floor of
    its parts' mean. A task sends a row for each entry it used."""
    shared = kept.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for b in batches:
            x = cut_parts(b.column(0), parts, width)
            codes, _ = assigned(x, shared.value)
            flat = (codes + entries * np.arange(parts)).ravel()
            np.add.at(total, flat, x.reshape(-1, width))
            count += np.bincount(flat, minlength=parts * entries)
        used = np.flatnonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(total[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), lists], names=["entry", "n", "total"])

    made = kept.select("v").mapInArrow(sums, "entry long, n long, total array<long>")
    each = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(width)]
    out = books.reshape(-1, width).copy()
    for r in made.groupBy("entry").agg(F.sum("n").alias("n"), *each).collect():
        out[r.entry] = [int(r[f"t{i}"]) // int(r.n) for i in range(width)]
    return out.reshape(books.shape)


def encoded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, codes array<int>, error long) of all rows."""
    shared = kept.sparkSession.sparkContext.broadcast(books)
    parts, _, width = books.shape

    def codes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, far = assigned(cut_parts(b.column(2), parts, width), shared.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * parts, pa.int32()), pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(far.sum(1))], names=["vec_id", "label", "codes", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.select("vec_id", "label", "v").mapInArrow(codes_of, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long")


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that rows of codes stand for."""
    return np.concatenate([books[p][codes[:, p]] for p in range(books.shape[0])], 1)


def train(kept: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts, entries, width / parts); None if no row is kept."""
    books = start_books(kept, parts=parts, entries=entries)
    for _ in range(rounds if books is not None else 0):
        books = next_books(kept, books)
    return books


def books_digest(books: np.ndarray) -> str:
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole vectors as codes: a row for each row kept. Null vectors and those holding
    null or non-finite components are dropped; zero vectors stay; shorter vectors (empty ones
    too) end in zeros; components beyond 2**18 in size count as that; repeated vec_ids are
    own rows, ties go to the lower entry; a null label is a label; fewer than 64 rows give
    fewer entries; other columns are ignored; an empty table gives no rows."""
    small_batches(spark, 4096)
    kept = written(whole_vectors(table(spark, sf_dir, "embeddings")), "codes-vectors")
    books = train(kept)
    if books is None:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = written(encoded(kept, books), "codes")
    # a label may hold a third of the rows: its one sum is copied, its rows are dealt
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "sum_label").withColumn("sum_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    both = dealt.join(sums, F.col("label").eqNullSafe(F.col("sum_label")) & (F.col("salt") == F.col("sum_salt")))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return both.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _assign_sql(k: int) -> str:
    return f""", assign{k} AS MATERIALIZED (
  SELECT r, p, min(d * {ENTRIES} + e) % {ENTRIES} AS e, min(d) AS d
  FROM (SELECT r, p, e, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM part JOIN book{k} USING (p)) GROUP BY r, p
)"""


def _book_sql(k: int) -> str:
    return f""", book{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(z, y) AS y FROM book{k} LEFT JOIN (
    SELECT p, e, list((s - ((s % c) + c) % c) // c ORDER BY i) AS z
    FROM (SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*) AS c FROM part JOIN assign{k} USING (r, p), (SELECT unnest(range(1, w + 1)) AS i FROM wide) GROUP BY p, e, i) GROUP BY p, e
  ) USING (p, e)
)"""


ORACLE = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), wide AS MATERIALIZED (SELECT max(len(v)) // {PARTS} AS w FROM kept), part AS MATERIALIZED (
  SELECT r, p, vec_id, v[p * w + 1 : (p + 1) * w] AS x FROM kept, wide, (SELECT unnest(range({PARTS})) AS p)
), book0 AS MATERIALIZED (
  SELECT p, e, x AS y FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM part) WHERE e < {ENTRIES}
){"".join(_assign_sql(k) + _book_sql(k) for k in range(ROUNDS))}{_assign_sql(ROUNDS)}, coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM assign{ROUNDS} GROUP BY r
), digest AS (
  SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(y) AS v, generate_subscripts(y, 1) AS i FROM book{ROUNDS})
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), digest
"""
