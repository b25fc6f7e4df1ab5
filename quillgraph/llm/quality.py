"""Quality scores by a factorisation machine.

A document is a sparse vector: hashed words (weighted by log counts and scaled to unit
length), structure statistics, and metadata of the text itself (its length). The
machine adds low-rank pairwise interactions to a linear model; all pairs are summed in
linear time by  1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].

It is fitted on a bounded sample of labelled rows and scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import small_batches, table
from quillgraph.llm.text import hashed_words, texts_of

#: Labelled rows that fit the machine, at most.
TRAIN_ROWS = 8000
WORD_BUCKETS = 1 << 14
FACTORS = 8
CUT = 0.3
KEEP_WEIGHT = 4
BINS = 8

#: Byte classes of the structure statistics; bytes over 127 are letters here.
CLASSES = ("lower", "upper", "digit", "space", "newline", "!", "|", "symbol", "stop", "other")
_CLASS = np.full(256, CLASSES.index("lower"), np.uint8)
for _chars, _name in (
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"), ("0123456789", "digit"), (" \t", "space"), ("\n\r", "newline"),
    ("!", "!"), ("|", "|"), ("#$%&*+<>=@^_~\\/{}[]", "symbol"), (".,;:?", "stop"), ("\"'()-`", "other"),
):
    for _c in _chars:
        _CLASS[ord(_c)] = CLASSES.index(_name)
for _b in range(0x20):
    if _CLASS[_b] == 0:
        _CLASS[_b] = CLASSES.index("other")

STATS = (*CLASSES, "word length", "distinct words", "most frequent word", "distinct lines", "adjacent repeats", "words a line", "log bytes")
#: Columns: hashed words, then each statistic as itself and as one of BINS bins.
COLUMNS = WORD_BUCKETS + len(STATS) * (1 + BINS)


def statistics(texts: pa.Array, offsets: np.ndarray, hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A row of STATS per text, each between 0 and 1 or so; empty texts are all 0."""
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    size = np.diff(bounds)
    counts = np.zeros((n, len(CLASSES)))
    for i in range(n):
        if size[i]:
            counts[i] = np.bincount(_CLASS[data[bounds[i] : bounds[i + 1]]], minlength=len(CLASSES))
    words = np.diff(offsets)
    owner = np.repeat(np.arange(n), words)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    starts = np.flatnonzero(first)
    runs = np.diff(np.append(starts, len(h)))
    most = np.zeros(n)
    np.maximum.at(most, o[starts], runs)
    distinct = np.bincount(o[starts], minlength=n)
    again = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner[1:][again], minlength=n)
    lines = pc.split_pattern(texts, "\n")
    flat = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    line_owner = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    n_lines = np.bincount(line_owner, minlength=n)
    pairs = np.unique(np.stack([line_owner, flat]), axis=1) if len(flat) else np.zeros((2, 0), np.int64)
    distinct_lines = np.bincount(pairs[0], minlength=n)
    chars = np.bincount(owner, weights=lengths, minlength=n)
    some, w = np.maximum(size, 1), np.maximum(words, 1)
    rest = [chars / w / 20, distinct / w, most / w, distinct_lines / np.maximum(n_lines, 1), repeats / w, np.log1p(words / np.maximum(n_lines, 1)) / 8, np.log1p(size) / 14]
    out = np.column_stack([counts / some[:, None], *rest])
    out[size == 0] = 0
    return out


def sparse_rows(column: pa.Array, edges: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row offsets, columns, values, statistics) of a batch. Without `edges`, the
    statistics' columns are left out (their bins come from the sample)."""
    texts = texts_of(column)
    n = len(texts)
    offsets, hashes, lengths = hashed_words(texts, bits=32)
    stats = statistics(texts, offsets, hashes, lengths)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    keys, counts = np.unique(owner * WORD_BUCKETS + (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), return_counts=True)
    row, col, value = keys // WORD_BUCKETS, keys % WORD_BUCKETS, np.log1p(counts)
    norm = np.sqrt(np.bincount(row, weights=value**2, minlength=n))
    value = value / np.maximum(norm[row], 1e-9)
    if edges is not None:
        r2, c2, v2 = stat_columns(stats, edges)
        row, col, value = np.concatenate([row, r2]), np.concatenate([col, c2]), np.concatenate([value, v2])
        order = np.argsort(row, kind="stable")
        row, col, value = row[order], col[order], value[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int64)
    return starts, col.astype(np.int64), value, stats


def stat_columns(stats: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each statistic as a value and as a bin between the sample's quantiles."""
    n, m = stats.shape
    bins = np.stack([np.searchsorted(edges[j], stats[:, j], side="right") for j in range(m)], 1) if n else np.zeros((0, m), np.int64)
    rows = np.repeat(np.arange(n), m)
    base = WORD_BUCKETS + np.tile(np.arange(m) * (1 + BINS), n)
    return np.concatenate([rows, rows]), np.concatenate([base, base + 1 + bins.ravel()]), np.concatenate([stats.ravel(), np.full(n * m, 0.5)])


def machine(model: dict, starts: np.ndarray, col: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-odds, factor sums, v*x): the factorisation machine in linear time."""
    n, k = len(starts) - 1, model["v"].shape[1]
    row = np.repeat(np.arange(n), np.diff(starts))
    vx = model["v"][col] * value[:, None]
    sums, squares = np.zeros((n, k)), np.zeros((n, k))
    for f in range(k):
        sums[:, f] = np.bincount(row, weights=vx[:, f], minlength=n)
        squares[:, f] = np.bincount(row, weights=vx[:, f] ** 2, minlength=n)
    linear = np.bincount(row, weights=model["w"][col] * value, minlength=n)
    return model["b"] + linear + 0.5 * (sums**2 - squares).sum(1), sums, vx


def fit(starts: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, *, epochs: int = 12, batch: int = 256, rate: float = 0.02, l2: float = 2e-4, seed: int = 11) -> dict:
    """Logistic loss by mini-batches with Adagrad steps; the order is seeded.

    Classes weigh the same. With one class or no rows the score is that class's share."""
    rng = np.random.default_rng(seed)
    model = {"w": np.zeros(COLUMNS), "v": rng.normal(0, 0.02, (COLUMNS, FACTORS)), "b": 0.0}
    n, share = len(y), float(y.mean()) if len(y) else 0.5
    prior = np.log((share * n + 0.5) / ((1 - share) * n + 0.5))
    if n == 0 or share in (0.0, 1.0):
        model["b"] = prior
        model["v"][:] = 0
        return model
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    gw, gv, gb = np.full(COLUMNS, 1e-2), np.full((COLUMNS, FACTORS), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows = order[at : at + batch]
            own, c, x = _rows(starts, col, value, rows)
            sizes = np.diff(own)
            z, sums, vx = machine(model, own, c, x)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows]
            each = np.repeat(d, sizes) * x
            used, place = np.unique(c, return_inverse=True)
            dw = np.bincount(place, weights=each, minlength=len(used)) / len(rows) + l2 * model["w"][used]
            dv = np.stack([np.bincount(place, weights=each * (np.repeat(sums[:, f], sizes) - vx[:, f]), minlength=len(used)) for f in range(FACTORS)], 1) / len(rows) + l2 * model["v"][used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += d.mean() ** 2
            model["w"][used] -= 5 * rate * dw / np.sqrt(gw[used])
            model["v"][used] -= rate * dv / np.sqrt(gv[used])
            model["b"] -= rate * d.mean() / np.sqrt(gb)
    return model


def best_cut(z: np.ndarray, y: np.ndarray) -> float | None:
    """The log-odds that part the classes best, a share of lost good rows counting as
    KEEP_WEIGHT shares of kept bad ones; the middle, where several cuts are best.
    None where one class is missing."""
    if not (0 < y.sum() < len(y)):
        return None
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    caught = np.concatenate([[0], np.cumsum(1 - y)]) / (1 - y).sum() + KEEP_WEIGHT * (y.sum() - np.concatenate([[0], np.cumsum(y)])) / y.sum()
    caught[1:-1][z[1:] == z[:-1]] = -np.inf  # equal scores can't be parted
    best = np.flatnonzero(caught >= caught.max() - 1e-12)
    lo, hi = best[0], best[-1]
    below = z[lo - 1] if lo else z[0] - 1
    above = z[hi] if hi < len(z) else z[-1] + 1
    return float((below + above) / 2)


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, *, keep: bool) -> DataFrame:
    """(doc_id, text, y) of labelled rows whose crc32 remainder is (keep) or isn't it.

    A document labelled more than once counts once, by its largest label."""
    clean = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    rest = fold(F.col("doc_id"), modulus) == remainder
    return docs.select("doc_id", "text").join(clean, "doc_id").where(rest if keep else ~rest)


def fold(doc_id: Column, modulus: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def bounded(rows: DataFrame, limit: int) -> DataFrame:
    """At most about `limit` different rows of (doc_id, text, y), by a seeded hash of id
    and text: all where there are fewer. Rows that repeat both count once, so a hot row
    or null ids neither fill the sample nor empty it."""
    parts, n = 1_000_000, rows.count()
    share = parts if n <= limit else max(1, int(parts * limit / n))
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")), F.lit(7))
    return rows.select("doc_id", "text", "y").where(F.pmod(h, F.lit(parts)) < share).dropDuplicates(["doc_id", "text"])


SPARSE = "doc_id long, y int, col binary, value binary, stats binary"


def _rows(starts: np.ndarray, col: np.ndarray, value: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = starts[rows + 1] - starts[rows]
    own = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    take = np.repeat(starts[rows] - own[:-1], sizes) + np.arange(own[-1])
    return own, col[take], value[take]


def train(learn: DataFrame, *, limit: int = TRAIN_ROWS) -> dict:
    """Fit on a bounded sample of (doc_id, text, y); features are made by the executors.

    A fifth of the sample is kept from fitting: the score CUT is put where it parts
    the two classes of that fifth best."""

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, col, value, stats = sparse_rows(b.column(1))
            cut = lambda a, t: pa.array([a[starts[i] : starts[i + 1]].astype(t).tobytes() for i in range(b.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), cut(col, np.uint16), cut(value, np.float32), pa.array([s.tobytes() for s in stats], pa.binary())], names=["doc_id", "y", "col", "value", "stats"])

    sample = bounded(learn, limit).select(F.col("doc_id").cast("long"), "text", F.col("y").cast("int"))
    rows = sorted(sample.mapInArrow(extract, SPARSE).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    y = np.array([r.y for r in rows], np.float64)
    stats = np.array([np.frombuffer(r.stats) for r in rows]).reshape(len(rows), len(STATS))
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(rows) else np.zeros((len(STATS), BINS - 1))
    word_col = [np.frombuffer(r.col, np.uint16).astype(np.int64) for r in rows]
    word_val = [np.frombuffer(r.value, np.float32).astype(np.float64) for r in rows]
    r2, c2, v2 = stat_columns(stats, edges)
    row = np.concatenate([np.repeat(np.arange(len(rows)), [len(c) for c in word_col]), r2]).astype(np.int64)
    col, value = np.concatenate([*word_col, c2]).astype(np.int64), np.concatenate([*word_val, v2])
    order = np.argsort(row, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(rows)))]).astype(np.int64)
    col, value = col[order], value[order]
    part = lambda rows: _rows(starts, col, value, rows)
    checked = np.arange(len(rows)) % 5 == 0
    model = fit(*part(np.flatnonzero(~checked)), y[~checked])
    cut = best_cut(machine(model, *part(np.flatnonzero(checked)))[0], y[checked])
    if cut is not None:
        model["b"] += np.log(CUT / (1 - CUT)) - cut
    return {"w": model["w"], "v": model["v"].astype(np.float64), "b": model["b"], "edges": edges}


def score(model: dict, column: pa.Array) -> np.ndarray:
    starts, col, value, _ = sparse_rows(column, model["edges"])
    z, _, _ = machine(model, starts, col, value)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """The documents with a column `score` (0 to 1; null and empty texts have one too);
    a column score that is there already is replaced."""
    docs = docs.drop("score")
    names = docs.columns
    schema = docs.withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score(model, b.column(names.index("text"))), pa.float64())], names=[*names, "score"])

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: dict, *, cut: float = CUT) -> DataFrame:
    """The documents that score `cut` or more, with their own columns, whatever these are
    called; null and empty texts have a score like any other."""
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(score(model, b.column(at)) >= cut))

    return docs.mapInArrow(run, docs.schema)


def train_query(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict:
    return train(learning_rows(docs, table(spark, sf_dir, "labels"), "quality", 5, 0, keep=False))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of documents; fitted on labelled rows outside the
    held-out fold. A row for each row: null and empty texts have a score, repeated rows
    are kept, other columns are ignored; an empty table gives no rows."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs.select("doc_id", "text"), train_query(spark, docs, sf_dir))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
