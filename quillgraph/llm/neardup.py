"""Near-duplicate documents by BagMinHash.

A document is a multiset of word 5-shingles. Its signature has M components; each is
the least point of Poisson processes, one per shingle, whose rate is the shingle's
count, so two signatures agree in a component with probability equal to the weighted
Jaccard similarity  sum min / sum max.

Counts are levels 0, 1, 2, ...; the process of a shingle is the union of processes over
the dyadic level intervals [0,1), [1,2), [2,4), [4,8) ... . An interval below the count
is used whole; one that the count cuts is split in halves again and again, each point
falling into a half by its own hash, so shingles with other counts see the same points.
No count is too large. Points above a document's running maximum can't change its
signature, so nearly all shingles cost one hash; everything is vectorised over the
shingles of an Arrow batch.

Exact copies collapse first. Representatives are banded. In each round, each bucket
compares its members with one of them (another one each round) by the exact overlap of
their multisets; buckets of one class are done, and what then is left in buckets of
several classes is compared pair by pair, in large buckets in blocks. Sketches of 4 bits a component sort out
pairs that can't be similar before any text moves. Classes are the connected components
of the verified links. Links and classes are tables throughout.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import small_batches, table, written
from quillgraph.llm.text import hashed_words, mix64, texts_of

SHINGLE = 5
SIMILARITY = 0.8
#: 1 - (1 - 0.8^6)^24 = 0.9993 of the pairs at 0.8 share a bucket.
BANDS, ROWS = 24, 6
M = BANDS * ROWS
#: Rounds in which each bucket compares with one member, before pairs are: so many at
#: least, and further ones while they halve the rows of large buckets with several classes.
ROUNDS, MOST_ROUNDS = 1, 12
#: Pairs of one leader that share a key.
SALT = 1024
#: Up to so many such leaders are broadcast.
HOT_ROWS = 200_000
#: Larger buckets are compared in blocks of so many rows instead of by a join.
SMALL_BUCKET = 64
BLOCK = 1024

_U = np.uint64


def shingles(column: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of a batch, sorted. A text with fewer words than
    a shingle is one shingle of all its words; a text without words has none."""
    offsets, words, _ = hashed_words(texts_of(column))
    n_words = np.diff(offsets)
    size = np.minimum(n_words, width)
    n_shingles = np.where(n_words > 0, n_words - size + 1, 0)
    doc = np.repeat(np.arange(len(n_words)), n_shingles)
    start = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(n_shingles)])[:-1], n_shingles) + np.arange(int(n_shingles.sum()))
    h = np.zeros(len(start), np.uint64)
    length = size[doc]
    for k in range(width):
        inside = length > k
        h[inside] = mix64(h[inside] ^ words[start[inside] + k])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def _intervals(count: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """(elements, k, width) of the dyadic level intervals that counts reach into:
    k = 0 is [0, 1), k >= 1 is [2^(k-1), 2^k)."""
    yield np.arange(len(count)), 0, 1
    k = 1
    while len(at := np.flatnonzero(count > 1 << (k - 1))):
        yield at, k, 1 << (k - 1)
        k += 1


def bag_minhash(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n_docs: int, m: int = M) -> np.ndarray:
    """Signatures (n_docs x m hashes) of multisets given as (doc, element, count).

    A document's points are drawn up to a bound on x that its total count makes likely
    to fill all components; where one stays empty the bound is doubled and the document
    done again, so the result doesn't depend on the bound. Without elements: zeros."""
    best_x, best_h = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, np.uint64)
    total = np.bincount(doc, weights=count, minlength=n_docs)
    bound = np.where(total > 0, m * (np.log(m) + 2) / np.maximum(total, 1), 0.0)
    todo = total > 0
    while todo.any():
        some = todo[doc]
        _draw(doc[some], h[some], count[some], bound, m, best_x, best_h)
        empty = np.isinf(best_x.reshape(n_docs, m)).any(1) & todo
        again = np.repeat(empty, m)
        best_x[again], best_h[again] = np.inf, 0
        bound[empty] *= 2
        todo = empty
    return best_h.reshape(n_docs, m)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _draw(doc, h, count, bound, m, best_x, best_h) -> None:
    for at, k, width in _intervals(count):
        d, seed, c = doc[at], mix64(h[at] ^ mix64(np.full(1, 0xB46 + k, np.uint64))[0]), count[at]
        low = 0 if k == 0 else 1 << (k - 1)
        x, step = np.zeros(len(at)), 0
        while len(d):
            step += 1
            u = mix64(seed + _U((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
            x = x - np.log(_uniform(u)) / width
            top = np.minimum(bound, best_x.reshape(-1, m).max(1))  # the running maximum, once all are filled
            live = np.flatnonzero(x <= top[d])
            if not len(live):
                break
            d, seed, c, x, u = d[live], seed[live], c[live], x[live], u[live]
            keep = np.ones(len(d), bool)
            lo, w, bits = np.full(len(d), low), width, u
            cut = np.flatnonzero(c < low + width)
            while len(cut) and w > 1:
                w //= 2
                bits = mix64(bits)
                lo[cut] += np.where(bits[cut] >> _U(63) == 1, w, 0)
                keep[cut] = lo[cut] < c[cut]
                cut = cut[keep[cut] & (lo[cut] + w > c[cut])]
            place = mix64(u ^ _U(0x5851F42D4C957F2D))
            slot = (d * m + (place % _U(m)).astype(np.int64))[keep]
            _keep_least(slot, x[keep], mix64(place[keep]), best_x, best_h)


def _keep_least(slot, x, value, best_x, best_h) -> None:
    np.minimum.at(best_x, slot, x)
    won = x == best_x[slot]
    best_h[slot[won]] = value[won]


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band."""
    out = np.empty((len(signatures), bands), np.int64)
    for b in range(bands):
        key = np.full(len(signatures), b + 1, np.uint64)
        for r in range(rows):
            key = mix64(key ^ signatures[:, b * rows + r])
        out[:, b] = key.view(np.int64)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, sketch, bands) of (doc_id, text), in one pass over the texts.

    `key` is the digest of the whole text (null for a null text). `sketch` has 4 bits of
    each signature component, 16 components in a long; a text without words has neither
    sketch nor bands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, h, count = shingles(b.column(2))
            signatures = bag_minhash(doc, h, count, b.num_rows)
            empty = np.bincount(doc, minlength=b.num_rows) == 0
            lists = lambda x: pa.array([None if e else r for r, e in zip(x.tolist(), empty)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(packed(signatures)), lists(band_keys(signatures))], names=["doc_id", "key", "sketch", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.unhex(F.sha2("text", 256)).alias("key"), "text").mapInArrow(run, "doc_id long, key binary, sketch array<long>, bands array<long>")


def packed(signatures: np.ndarray) -> np.ndarray:
    """4 bits of each component, 16 to a long."""
    out = np.zeros((len(signatures), M // 16), np.uint64)
    for j in range(M):
        out[:, j // 16] |= (signatures[:, j] & _U(15)) << _U(4 * (j % 16))
    return out.view(np.int64)


def agreement(a: str, b: str) -> Column:
    """In how many components two sketches agree: equal nibbles, by bit arithmetic."""
    total = F.lit(0)
    for i in range(M // 16):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        odd = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + (16 - F.bit_count(odd))
    return total


def least_agreement(similarity: float) -> int:
    """The agreement that pairs of the similarity miss with a chance of some 1 in
    30,000: four standard deviations below their mean (components also agree by chance,
    1 in 16)."""
    p = similarity + (1 - similarity) / 16
    return int(np.floor(M * p - 4 * np.sqrt(M * p * (1 - p))))


def similarities(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, similarity): the exact weighted Jaccard similarity of pairs(a, b) of
    doc_ids; of rows that repeat a doc_id, the most similar count.

    The texts of documents in pairs are shuffled to their pairs; nothing is sent that
    isn't compared. A document in very many pairs (a bucket's leader) is dealt
    to keys of about SALT pairs each, so no task gets them all, and its text is sent
    once a key, not once a pair."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(wanted, "doc_id", "left_semi"), "neardup-texts")
    n = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / SALT).alias("salts"))
    hot = written(n.where("salts > 1"), "neardup-hot")
    side = hot if hot.count() > HOT_ROWS else F.broadcast(hot)  # a row has two longs, so the broadcast has 16 HOT_ROWS bytes at most
    counted = pairs.join(side.select(F.col("doc_id").alias("a"), F.col("salts").alias("na")), "a", "left").join(side.select(F.col("doc_id").alias("b"), F.col("salts").alias("nb")), "b", "left").fillna(1, ["na", "nb"])
    turned = counted.select(F.when(F.col("nb") > F.col("na"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))).otherwise(F.struct("a", "b")).alias("p"), F.greatest("na", "nb").alias("salts"))
    salted = turned.select("p.a", "p.b", F.pmod(F.xxhash64("p.b", F.lit(3)), F.col("salts")).alias("salt"))
    of_b = salted.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    every = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).join(side.select(F.col("doc_id").alias("a"), "salts"), "a", "left").fillna(1, ["salts"])
    of_a = every.select("a", "text_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    both = of_b.join(of_a, ["a", "salt"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in (2, 3):
                coded = batch.column(c).dictionary_encode()  # a bucket's least member comes again and again
                doc, h, count = shingles(coded.dictionary)
                starts = np.searchsorted(doc, np.arange(len(coded.dictionary) + 1))
                sides.append((coded.indices.to_numpy(), starts, h, count))
            out = np.empty(batch.num_rows)
            (ia, sa, ha, ca), (ib, sb, hb, cb) = sides
            for i in range(batch.num_rows):
                x, y = slice(sa[ia[i]], sa[ia[i] + 1]), slice(sb[ib[i]], sb[ib[i] + 1])
                _, p, q = np.intersect1d(ha[x], hb[y], assume_unique=True, return_indices=True)
                least = np.minimum(ca[x][p], cb[y][q]).sum()
                out[i] = least / max(1, ca[x].sum() + cb[y].sum() - least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "similarity"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"))


def components(links: DataFrame) -> DataFrame:
    """(rep, least): the least member of each linked row's component.

    Each step points every row to its least smaller neighbour, links its other smaller
    neighbours to that one, and then moves each link's smaller end to where that points.
    A row has few smaller neighbours (one a bucket and round at most, and those of its
    blocks), so its window is small; the many rows below one least member are met by a
    join only. Steps are tables; they end when nothing changes any more."""
    edges = written(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct(), "neardup-edges")
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(edges)
    while True:
        parent = edges.groupBy("v").agg(F.min("u").alias("p"))
        least = F.min("u").over(Window.partitionBy("v"))
        hooked = edges.withColumn("p", least).select(F.explode(F.when(F.col("u") == F.col("p"), F.array(F.struct("u", "v"))).otherwise(F.array(F.struct(F.col("p").alias("u"), F.col("u").alias("v"))))).alias("e")).select("e.*")
        moved = hooked.join(parent.withColumnRenamed("v", "w"), F.col("u") == F.col("w"), "left").select(F.coalesce("p", "u").alias("u"), "v").distinct()
        edges = written(moved, "neardup-edges")
        now = state(edges)
        if now == before:
            return edges.select(F.col("v").alias("rep"), F.col("u").alias("least"))
        before = now


def _agreements(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The agreement of each sketch of x with each of y."""
    total = np.zeros((len(x), len(y)), np.int32)
    for k in range(x.shape[1]):
        d = x[:, None, k] ^ y[None, :, k]
        d |= d >> _U(1)
        d |= d >> _U(2)
        total += 16 - np.bitwise_count(d & _U(0x1111111111111111)).astype(np.int32)
    return total


def _dealt_blocks(rows: DataFrame) -> DataFrame:
    """Rows of large buckets for pairs of blocks (bucket, i, j), i <= j: a row of block
    b comes to (b, j) as `left` and to (i, b) as right, so each group has at most about
    2 * BLOCK rows, however large its bucket is."""
    n = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_blocks"))
    own = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("n_blocks")).cast("int")
    put = rows.join(n, "bucket").withColumn("own", own)
    left = F.transform(F.sequence(F.col("own"), F.col("n_blocks") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(True).alias("left")))
    right = F.transform(F.sequence(F.lit(0), F.col("own")), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(False).alias("left")))
    return put.withColumn("to", F.explode(F.concat(left, right))).select(*rows.columns, "to.*")


def _sides(group: pa.Table, least_agree: int):
    """The rows of both sides, and which pairs of them are to be looked at."""
    left = group.column("left").to_numpy()
    rep, cls = group.column("rep").to_numpy(), group.column("least").to_numpy()
    sketch = np.array(group.column("sketch").to_pylist(), np.int64).view(np.uint64).reshape(len(rep), -1)
    x, y = np.flatnonzero(left), np.flatnonzero(~left)
    look = (_agreements(sketch[x], sketch[y]) >= least_agree) & (cls[x][:, None] != cls[y][None, :])
    same_block = group.column("i")[0].as_py() == group.column("j")[0].as_py() if group.num_rows else False
    if same_block:
        look &= rep[x][:, None] < rep[y][None, :]
    return rep, x, y, look


def block_links(rows: DataFrame, slim: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all links between classes within large buckets, rows(bucket, rep, sketch,
    least). Pairs are never rows: a first pass over sketches finds the members that have
    any pair to look at; their texts are then compared block by block, each pair only
    in the first of the buckets that it shares."""
    least = least_agreement(similarity)

    def active(group: pa.Table) -> pa.Table:
        rep, x, y, look = _sides(group, least)
        some = np.unique(np.concatenate([x[look.any(1)], y[look.any(0)]])) if len(rep) else np.zeros(0, np.int64)
        return group.select(["bucket", "rep"]).take(pa.array(some))

    found = _dealt_blocks(rows).groupBy("bucket", "i", "j").applyInArrow(active, "bucket long, rep long").distinct()
    found = written(found.join(rows, ["bucket", "rep"]), "neardup-active")
    wanted = found.select(F.col("rep").alias("doc_id")).distinct()
    texts = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(wanted, "doc_id", "left_semi").join(slim.select("doc_id", "bands").where("bands is not null").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "doc_id"), "neardup-texts")
    whole = found.join(texts.select(F.col("doc_id").alias("rep"), "text", "bands"), "rep").select("bucket", "rep", "sketch", "least", "text", "bands")

    def compare(group: pa.Table) -> pa.Table:
        rep, x, y, look = _sides(group, least)
        bucket = group.column("bucket")[0].as_py() if group.num_rows else 0
        bands = np.array(group.column("bands").to_pylist(), np.int64).reshape(len(rep), -1)
        coded = group.column("text").combine_chunks()
        doc, h, count = shingles(coded if isinstance(coded, pa.Array) else pa.concat_arrays(coded.chunks))
        starts = np.searchsorted(doc, np.arange(len(rep) + 1))
        sizes = np.array([count[starts[i] : starts[i + 1]].sum() for i in range(len(rep))])
        out_a, out_b = [], []
        for p, q in zip(*np.nonzero(look)):
            i, j = x[p], y[q]
            small, large = sorted((sizes[i], sizes[j]))
            shared = np.flatnonzero(bands[i] == bands[j])
            if small < similarity * large or not len(shared) or bands[i][shared[0]] != bucket:
                continue
            u, v = slice(starts[i], starts[i + 1]), slice(starts[j], starts[j + 1])
            _, r, t = np.intersect1d(h[u], h[v], assume_unique=True, return_indices=True)
            both = np.minimum(count[u][r], count[v][t]).sum()
            if both >= similarity * (sizes[i] + sizes[j] - both):
                out_a.append(min(rep[i], rep[j]))
                out_b.append(max(rep[i], rep[j]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return _dealt_blocks(whole).groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_classes(members: DataFrame, slim: DataFrame, docs: DataFrame, *, similarity: float = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """(rep, least) of members(rep, bucket), for those with near duplicates.

    Each round, each bucket that still has several classes compares its members with one
    of them, another one each round; verified links merge classes. Rounds go on while
    they shrink what large buckets have left; pairs of one bucket and two classes that
    then remain are compared pair by pair, in large buckets block by block. Sketches say beforehand which pairs can be similar enough;
    texts decide."""
    least = least_agreement(similarity)
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    # sketches come to the rows of shared buckets only: most buckets have one member
    sketch = slim.select(F.col("doc_id").alias("rep"), "sketch").where("sketch is not null").dropDuplicates(["rep"])
    grouped = written(members.join(shared, "bucket", "left_semi").join(sketch, "rep"), "neardup-buckets")
    classes, links, judged = None, None, None

    k, before, last = 0, None, False
    while not last:
        placed = grouped.withColumn("least", F.col("rep")) if classes is None else grouped.join(classes, "rep", "left").withColumn("least", F.coalesce("least", "rep"))
        if k:
            mixed = placed.groupBy("bucket").agg(F.min("least").alias("lo"), F.max("least").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("bucket", "n")
            placed = written(placed.join(mixed, "bucket"), "neardup-mixed")
        if k >= max(1, rounds):
            in_large = placed.where(F.col("n") > SMALL_BUCKET).count()
            last = not in_large or k >= MOST_ROUNDS or before is not None and 2 * in_large > before
            before = in_large
        if last:
            if in_large:
                large = placed.where(F.col("n") > SMALL_BUCKET).drop("n")
                blocked = written(block_links(large, slim, docs, similarity), "neardup-links")
                links = blocked if links is None else links.union(blocked)
            placed = placed.where(F.col("n") <= SMALL_BUCKET)
            one = placed.select(F.col("bucket").alias("bucket_a"), F.col("rep").alias("a"), F.col("sketch").alias("sa"), F.col("least").alias("la"))
        else:
            order = F.col("rep") if k == 0 else F.xxhash64("rep", "bucket", F.lit(k))
            one = placed.groupBy("bucket").agg(F.min_by(F.struct("rep", "sketch", "least"), F.struct(order, "rep")).alias("one")).select(F.col("bucket").alias("bucket_a"), F.col("one.rep").alias("a"), F.col("one.sketch").alias("sa"), F.col("one.least").alias("la"))
        side = placed.select(F.col("bucket").alias("bucket_b"), F.col("rep").alias("b"), F.col("sketch").alias("sb"), F.col("least").alias("lb"))
        apart = (F.col("la") != F.col("lb")) & (agreement("sa", "sb") >= least)
        if last:
            apart = apart & (F.col("a") < F.col("b"))
        pairs = one.join(side, (F.col("bucket_a") == F.col("bucket_b")) & apart).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if judged is not None:
            pairs = pairs.join(judged, ["a", "b"], "left_anti")
        pairs = written(pairs, "neardup-pairs")
        if not pairs.isEmpty():
            found = written(similarities(pairs, docs), "neardup-judged")
            judged = found.select("a", "b") if judged is None else judged.union(found.select("a", "b"))
            more = found.where(F.col("similarity") >= similarity).select("a", "b")
            links = more if links is None else links.union(more)
        if links is not None:
            classes = components(links)
        k += 1
    return classes if classes is not None else docs.sparkSession.createDataFrame([], "rep long, least long")


def _once_each(docs: DataFrame) -> bool:
    """Whether every row has its own doc_id; only ids are read."""
    n = docs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids")).first()
    return n.n == n.ids


def _classify(docs: DataFrame, similarity: float) -> DataFrame:
    """classify() for doc_ids that are each one row's."""
    slim = written(sketches(docs), "neardup-sketches")
    copies = slim.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    copies = written(copies, "neardup-copies")
    reps = slim.where("bands is not null").join(copies.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    members = reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("bucket"))
    classes = near_classes(members, slim, docs, similarity=similarity)
    final = copies.join(classes, "rep", "left").select("key", F.coalesce("least", "rep").alias("class_id"))
    whole = slim.where("key is not null").select("doc_id", "key").join(final, "key").select("doc_id", "class_id")
    return whole.unionByName(slim.where("key is null").select("doc_id", F.col("doc_id").alias("class_id")))


def _classified_rows(docs: DataFrame, similarity: float) -> DataFrame:
    """(doc struct, row, class_row): every row numbered, and the class of its number."""
    rows = written(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row")), "neardup-rows")
    found = _classify(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), similarity)
    return rows.join(written(found, "neardup-row-classes").select(F.col("doc_id").alias("row"), F.col("class_id").alias("class_row")), "row")


def classify(docs: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, class_id): the least doc_id of each document's
    class of exact and near copies.

    Texts are equal if all characters are. Texts with the same words in the same order
    are near copies of similarity 1; texts without words are only copies of their
    equals. A null text is its own class, the row's doc_id; repeated rows share a class;
    rows that repeat a doc_id with other texts are documents of their own, each in its
    text's class; a null doc_id gets the class of its text's others, or null."""
    docs = docs.select("doc_id", "text")
    if _once_each(docs):
        return _classify(docs, similarity)
    both = written(_classified_rows(docs, similarity).select("doc.doc_id", "class_row"), "neardup-both")
    least = both.groupBy("class_row").agg(F.min("doc_id").alias("class_id"))
    return both.join(least, "class_row").select("doc_id", "class_id")


def keep_one(docs: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, one of each class: the row with the class's least doc_id, the first of
    several equal ones. Rows with null doc_id stay; a doc_id repeated with other texts
    stays once for each of their classes."""
    if _once_each(docs):
        chosen = _classify(docs.select("doc_id", "text"), similarity).where("doc_id = class_id").select("doc_id")
        return docs.join(chosen, "doc_id", "left_semi")
    rows = written(_classified_rows(docs, similarity), "neardup-classified")
    first = rows.where("doc.doc_id is not null").groupBy("class_row").agg(F.min(F.struct(F.col("doc.doc_id").alias("d"), F.sha2(F.coalesce("doc.text", F.lit("")), 256).alias("h"), F.col("row").alias("r"))).alias("one")).select(F.col("one.r").alias("row"))
    kept = rows.where("doc.doc_id is not null").join(first, "row", "left_semi").unionByName(rows.where("doc.doc_id is null"))
    return kept.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of exact and near copies over five-word shingles: a row for
    each row. Null and empty texts, repeated rows and ids are as classify() says; other
    columns are ignored; an empty table gives no rows."""
    small_batches(spark)
    return classify(table(spark, sf_dir, "documents"))
