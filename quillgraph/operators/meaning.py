"""Text analytics: vocabulary, TF-IDF, neighbours, places, groups and their names."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.geometry import dot
from quillgraph.lineage import cut
from quillgraph.operators.nearest import blocks_for, largest_products, matrix
from quillgraph.operators.order import numbered


def term_counts(tokens: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of (doc_id, tokens)."""
    return tokens.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n_docs: int, *, min_docs: int = 2, max_share: float = 0.5, max_terms: int = 30_000) -> DataFrame:
    """(term, df, idf): terms in at least min_docs and at most max(min_docs, max_share n)
    documents, most frequent first, ties by term; idf = ln(n / df). A top-k."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kept = df.where((F.col("df") >= min_docs) & (F.col("df") <= max(min_docs, max_share * n_docs)))
    return kept.orderBy(F.desc("df"), "term").limit(max_terms).withColumn("idf", F.log(n_docs / F.col("df")))


def tfidf(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, term, weight): (1 + ln tf) idf, of unit length per document. The
    vocabulary has at most max_terms rows, so it may be broadcast."""
    raw = counts.join(F.broadcast(vocab.select("term", "idf")), "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term", (F.col("w") / length).alias("weight"))


def top_per(rows: DataFrame, key: str, k: int, *order) -> DataFrame:
    """The first k rows of each key with their rank; Spark keeps k per task before the
    shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_cosine(vectors: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, similarity, rank): exact, of unit vectors (id, v), self excluded.

    A block of vectors is one row of a table, and Spark's cross join reads each block for
    each other one, so a vector is shuffled and written once, however many blocks there
    are. A pair of blocks is compared by matrix products in Arrow batches; each keeps k
    candidates per row, so the shuffle has k rows for each pair of a row and a block. All
    pairs are looked at; a task holds few blocks and the products of some hundred rows."""
    import pyarrow as pa

    n_blocks = blocks_for(vectors.count())
    listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        return pa.table({"ids": listed(group.column("id").to_numpy()), "vs": listed(matrix(group.column("v")).ravel())})

    def compare(batches):
        for b in batches:
            for i in range(b.num_rows):
                q, x, c, y = (column.slice(i, 1).flatten().to_numpy() for column in b.columns)
                x, y = x.reshape(len(q), -1), y.reshape(len(c), -1)
                r, j, score = largest_products(x, y, k, (np.searchsorted(c, q), np.searchsorted(c, q, "right")))
                yield pa.RecordBatch.from_arrays([pa.array(q[r]), pa.array(c[j]), pa.array(score)], names=["id", "neighbour", "similarity"])

    own = vectors.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("own")).repartition(n_blocks, "own")
    blocks = cut(own.groupBy("own").applyInArrow(packed, "ids array<long>, vs array<double>"), "near-blocks")
    pairs = blocks.crossJoin(blocks.select(F.col("ids").alias("there"), F.col("vs").alias("theirs")).hint("shuffle_replicate_nl"))
    found = pairs.mapInArrow(compare, "id long, neighbour long, similarity double")
    return top_per(found, "id", k, F.desc("similarity"), F.col("neighbour"))


#: Places of one tile of the plane.
TILE = 2048


def _near_places(q: np.ndarray, at: np.ndarray, c: np.ndarray, there: np.ndarray, k: int, chunk: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of c, distance): each place's k nearest, nearest first, ties to the
    smaller row of c; a place isn't near itself."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i in range(0, len(q) if len(c) else 0, chunk):
        some = slice(i, i + chunk)
        d = np.hypot(there[None, :, 0] - at[some, None, 0], there[None, :, 1] - at[some, None, 1])
        d[q[some, None] == c[None, :]] = np.inf
        floor = np.partition(d, k - 1, axis=1)[:, k - 1] if k < len(c) else np.full(len(d), np.inf)
        r, j = np.nonzero((d <= floor[:, None]) & np.isfinite(d))
        order = np.lexsort((j, d[r, j], r))
        r, j = r[order], j[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, j = r[keep], j[keep]
        out.append((i + r, j, d[r, j]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def knn_plane(places: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, distance, closeness, rank) of (id, x, y): exact in the plane.

    Places are dealt into tiles of bounded size along a Z-curve. A place's nearest of its own
    tile bound how far it must look; only where that circle reaches other tiles is the place
    sent to them. So the shuffle has a few rows for each place and neighbour, however the
    places lie, and pairs are made in Arrow batches only. The driver sees one box a tile."""
    import pyarrow as pa

    from quillgraph.operators.neighbour_map import blocks_of

    given = places.where("x is not null and y is not null").select("id", "x", "y")
    stats = given.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n")).first()
    schema = "id long, neighbour long, distance double, closeness double, rank int"
    if not stats.n or stats.n < 2:
        return places.sparkSession.createDataFrame([], schema)
    extent = max(stats.x1 - stats.x0, stats.y1 - stats.y0, 1e-9)
    scale = extent / max(1, int(np.ceil(np.sqrt(stats.n / max(1, k))))) / 2
    tiles = cut(blocks_of(given, TILE), "plane-tiles")
    boxes = tiles.groupBy("block").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("id").alias("least")).collect()
    box, least = np.array([[b.x0, b.x1, b.y0, b.y1] for b in boxes]), np.array([b.least for b in boxes])
    tile = np.array([b.block for b in boxes], np.int32)
    shared = places.sparkSession.sparkContext.broadcast((tile, box, least))

    def own(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, at, here = group.column("id").to_numpy(), np.stack([group.column("x").to_numpy(), group.column("y").to_numpy()], 1), group.column("block")[0].as_py()
        r, j, d = _near_places(ids, at, ids, at, k)
        ends = np.searchsorted(r, np.arange(len(ids) + 1))
        full = np.diff(ends) == k
        far, last = np.full(len(ids), np.inf), np.full(len(ids), np.iinfo(np.int64).max)
        far[full], last[full] = d[ends[1:][full] - 1], ids[j[ends[1:][full] - 1]]
        tile, box, least = shared.value
        visits, sizes = [], []
        for i in range(0, len(ids), 256):
            x, y, reach = at[i : i + 256, 0, None], at[i : i + 256, 1, None], far[i : i + 256, None]
            gap = np.hypot(np.maximum(0, np.maximum(box[:, 0] - x, x - box[:, 1])), np.maximum(0, np.maximum(box[:, 2] - y, y - box[:, 3])))
            goes = ((gap < reach) | ((gap <= reach * (1 + 1e-12)) & (least < last[i : i + 256, None]))) & (tile != here)
            visits.append(tile[np.nonzero(goes)[1]])
            sizes.append(goes.sum(1))
        list_of = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
        to = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return pa.table({"id": ids, "x": at[:, 0], "y": at[:, 1], "far": far, "neighbours": list_of(ends, ids[j]), "distances": list_of(ends, d), "visits": list_of(to, np.concatenate(visits))})

    def visited(asks: pa.Table, group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        xy = lambda t: np.stack([t.column("x").to_numpy(), t.column("y").to_numpy()], 1)
        q, c = asks.column("id").to_numpy(), group.column("id").to_numpy()
        r, j, d = _near_places(q, xy(asks), c, xy(group), k)
        near = d <= asks.column("far").to_numpy()[r]
        return pa.table({"id": q[r[near]], "neighbour": c[j[near]], "distance": d[near]})

    first = tiles.groupBy("block").applyInArrow(own, "id long, x double, y double, far double, neighbours array<long>, distances array<double>, visits array<int>")
    first = cut(first, "plane-near")
    pairs = lambda rows: rows.select("id", F.posexplode(F.arrays_zip("neighbours", "distances")).alias("at", "n")).select("id", F.col("n.neighbours").alias("neighbour"), F.col("n.distances").alias("distance"), (F.col("at") + 1).alias("rank"))
    asks = first.select("id", "x", "y", "far", F.explode("visits").alias("block"))
    found = asks.groupBy("block").cogroup(tiles.groupBy("block")).applyInArrow(visited, "id long, neighbour long, distance double")
    both = top_per(pairs(first.where("size(visits) > 0")).drop("rank").unionByName(found), "id", k, "distance", "neighbour")
    done = pairs(first.where("size(visits) = 0")).unionByName(both)
    return done.select("id", "neighbour", "distance", (1 / (1 + F.col("distance") / scale)).alias("closeness"), "rank")


def blend_neighbours(own: DataFrame, neighbours: DataFrame, weight: float = 1.0) -> DataFrame:
    """(id, v): own vector plus weight times the unit mean of neighbours(id, v), scaled
    to unit length; whichever is missing leaves the other."""
    from quillgraph.functions.geometry import unit

    mean = neighbours.select("id", F.posexplode("v")).groupBy("id", "pos").agg(F.avg(F.col("col").cast("double")).alias("m")).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    both = own.join(mean.withColumn("mean", unit(F.col("mean"))), "id", "full")
    mixed = F.when(F.col("v").isNull(), F.col("mean")).when(F.col("mean").isNull(), F.transform("v", lambda x: x.cast("double"))).otherwise(F.zip_with("v", "mean", lambda a, b: a.cast("double") + weight * b))
    return both.select("id", mixed.alias("v")).select("id", unit(F.col("v")).alias("v"))


def place_among(similar: DataFrame, places: DataFrame, *, temperature: float = 20.0) -> DataFrame:
    """(id, x, y): the mean place of neighbours(id, neighbour, similarity), weighted by
    exp(temperature (s - best s))."""
    top = F.max("similarity").over(Window.partitionBy("id"))
    w = similar.join(places.select(F.col("id").alias("neighbour"), "x", "y"), "neighbour").withColumn("w", F.exp(temperature * (F.col("similarity") - top)))
    return w.groupBy("id").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y"))


def centred(places: DataFrame) -> DataFrame:
    """(id, x, y) less the mean place, over the root mean square distance from it."""
    m = places.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    moved = places.crossJoin(F.broadcast(m)).select("id", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    rms = moved.agg(F.sqrt(F.avg(F.col("x") ** 2 + F.col("y") ** 2)).alias("rms"))
    return moved.crossJoin(F.broadcast(rms)).select("id", (F.col("x") / F.col("rms")).alias("x"), (F.col("y") / F.col("rms")).alias("y"))


def align(places: DataFrame, onto: DataFrame) -> DataFrame:
    """(id, x, y) turned, and mirrored where that fits better, onto the shared ids'
    places; with fewer than 3 shared ids as they are. Four sums decide, in one row."""
    pair = places.join(onto.select("id", F.col("x").alias("u"), F.col("y").alias("v")), "id")
    s = pair.agg(*(F.sum(F.col(a) * F.col(b)).alias(a + b) for a in "xy" for b in "uv"), F.count(F.lit(1)).alias("n"))
    plain, cross = F.col("xu") + F.col("yv"), F.col("xv") - F.col("yu")
    m_plain, m_cross = F.col("xu") - F.col("yv"), F.col("xv") + F.col("yu")
    mirror = F.hypot(m_plain, m_cross) > F.hypot(plain, cross)
    angle = F.when(mirror, F.atan2(m_cross, m_plain)).otherwise(F.atan2(cross, plain))
    turn = s.select(F.when(F.col("n") >= 3, angle).otherwise(0.0).alias("angle"), F.when((F.col("n") >= 3) & mirror, -1.0).otherwise(1.0).alias("flip"))
    c, d, y = F.cos("angle"), F.sin("angle"), F.col("y") * F.col("flip")
    return places.crossJoin(F.broadcast(turn)).select("id", (c * F.col("x") - d * y).alias("nx"), (d * F.col("x") + c * y).alias("ny")).toDF("id", "x", "y")


def quantile_of(rows: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """(key, value): the value at place floor(share * n) of each key's sorted values.

    Rows are sorted once over all tasks by key and value; a row's place in its key is its
    place less the key's first, so no task and no array holds a whole key."""
    placed = numbered(rows.where(F.col(value).isNotNull()).select(key, value), key, value, name="at")
    span = placed.groupBy(key).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    return placed.join(span, key).where(F.col("at") == F.col("first") + F.floor(share * F.col("n"))).select(key, value)


def kmeans_step(places: DataFrame, centres: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assignments(id, grp), centres(grp, x, y)): nearest centre, ties to the smaller;
    an empty group keeps its centre. Centres are at most a few dozen rows."""
    c = centres.agg(F.sort_array(F.collect_list(F.struct(F.col("grp").alias("g"), F.col("x").alias("cx"), F.col("y").alias("cy")))).alias("cs"))
    far = lambda s: (s["cx"] - F.col("x")) ** 2 + (s["cy"] - F.col("y")) ** 2
    nearest = F.array_min(F.transform("cs", lambda s: F.struct(far(s).alias("d"), s["g"].alias("g"))))["g"]
    assigned = places.where("x is not null").crossJoin(F.broadcast(c)).select("id", "x", "y", nearest.alias("grp"))
    means = assigned.groupBy("grp").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    moved = centres.join(means, "grp", "left").select("grp", F.coalesce("mx", "x").alias("x"), F.coalesce("my", "y").alias("y"))
    return assigned.select("id", "grp"), moved


def kmeans(places: DataFrame, k: int, *, rounds: int = 25) -> tuple[DataFrame, list[tuple[int, float, float]]]:
    """Groups of placed works; first centres are spread by the angle: the works in the middle
    of k equal runs. Only k centres come to the driver between rounds."""
    spark = places.sparkSession
    placed = places.where("x is not null").withColumn("angle", F.atan2("y", "x"))
    n = placed.count()
    count = max(1, min(k, n))
    middle = {(2 * c + 1) * n // (2 * count): c for c in range(count)}
    ordered = numbered(placed, "angle", "id", name="at").where(F.col("at").isin(*middle))
    centres = [(middle[r["at"]], r.x, r.y) for r in ordered.select("at", "x", "y").collect()]
    assigned = None
    for _ in range(rounds):
        assigned, moved = kmeans_step(places, spark.createDataFrame(centres, "grp int, x double, y double"))
        new = sorted((r.grp, r.x, r.y) for r in moved.collect())
        if new == sorted(centres):
            break
        centres = new
    return assigned, centres


def group_name_scores(words: DataFrame, *, min_works: int = 5) -> DataFrame:
    """(grp, term, score) of words(id, grp, term): share of the group times share of the
    uses in it, 2.5 times for terms of several words; at least min_works."""
    distinct = words.select("id", "grp", F.lower("term").alias("term")).distinct()
    sizes = words.groupBy("grp").agg(F.countDistinct("id").alias("size"))
    per = distinct.groupBy("grp", "term").agg(F.count(F.lit(1)).alias("c"))
    total = distinct.groupBy("term").agg(F.count(F.lit(1)).alias("total"))
    boost = F.when(F.col("term").contains(" "), 2.5).otherwise(1.0)
    return per.where(F.col("c") >= min_works).join(sizes, "grp").join(total, "term").select("grp", "term", ((F.col("c") / F.col("size")) * (F.col("c") / F.col("total")) * boost).alias("score"))


def unique_names(scores: DataFrame) -> list[tuple[int, str]]:
    """Greedy on the few candidates: best score first, a name once, a group once."""
    names, used = {}, set()
    for r in sorted(scores.collect(), key=lambda r: (-r.score, r.term)):
        if r.grp not in names and r.term not in used:
            names[r.grp] = r.term[:1].upper() + r.term[1:]
            used.add(r.term)
    return sorted(names.items())


def class_tfidf(words: DataFrame) -> DataFrame:
    """(grp, term, score): (c / size) ln(1 + mean size / everywhere), 1.5 times for
    terms of several words."""
    distinct = words.select("id", "grp", "term").distinct()
    sizes = words.groupBy("grp").agg(F.countDistinct("id").alias("size"))
    mean = sizes.agg(F.avg("size").alias("mean"))
    per = distinct.groupBy("grp", "term").agg(F.count(F.lit(1)).alias("c"))
    total = distinct.groupBy("term").agg(F.count(F.lit(1)).alias("total"))
    boost = F.when(F.col("term").contains(" "), 1.5).otherwise(1.0)
    return per.join(sizes, "grp").join(total, "term").crossJoin(F.broadcast(mean)).select("grp", "term", (F.col("c") / F.col("size") * F.log(1 + F.col("mean") / F.col("total")) * boost).alias("score"))


def region_topics(topics: DataFrame, *, coverage: float = 0.3, lift: float = 1.2) -> DataFrame:
    """(grp, topic, score): each region's best topic of topics(id, grp, topic), by
    coverage ln(1 + lift); shares are of works with topics."""
    works = topics.groupBy("grp").agg(F.countDistinct("id").alias("size"))
    every = topics.agg(F.countDistinct("id").alias("n"))
    per = topics.groupBy("grp", "topic").agg(F.countDistinct("id").alias("c"))
    total = topics.groupBy("topic").agg(F.countDistinct("id").alias("total"))
    rated = per.join(works, "grp").join(total, "topic").crossJoin(F.broadcast(every)).withColumn("coverage", F.col("c") / F.col("size")).withColumn("lift", F.col("coverage") / (F.col("total") / F.col("n")))
    fit = rated.where((F.col("coverage") >= coverage) & (F.col("lift") >= lift)).withColumn("score", F.col("coverage") * F.log(1 + F.col("lift")))
    return top_per(fit, "grp", 1, F.desc("score"), F.col("topic")).select("grp", "topic", "score")
