"""Citation graph operators: edges with provenance, degrees, budgets, neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.lineage import cut
from quillgraph.operators.order import numbered, running_sum


def merge_edges(citations: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One edge per (source, target) with the sorted set of its kinds. Self loops go;
    with `nodes`, so do edges whose ends aren't both nodes."""
    kept = citations.where("source <> target")
    if nodes is not None:
        ids = nodes.select("id")
        kept = kept.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept.groupBy("source", "target").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


def first_source(citations: DataFrame, priority: tuple[str, ...]) -> DataFrame:
    """(source, target, kind): each pair counts once, the first kind by priority stays."""
    order = F.array_position(F.array(*map(F.lit, priority)), F.col("kind"))
    return citations.groupBy("source", "target").agg(F.min_by("kind", order).alias("kind"))


def in_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, cited_by): edges into each node, 0 for none."""
    counts = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("cited_by"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("cited_by", F.lit(0)).alias("cited_by"))


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree) of nodes with any edge."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def hover_counts(edges: DataFrame) -> DataFrame:
    """(id, cites, cited_by) of nodes with any edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("o").alias("cites"), F.sum("i").alias("cited_by"))


def node_radius(depth: Column, cited_by: Column, cites: Column) -> Column:
    """8 + 4.4 sqrt(c) for works of the collection, 4 + 2.4 sqrt(c) outside, at most 40."""
    root = F.sqrt(F.greatest(cited_by, cites))
    return F.least(F.lit(40.0), F.when(depth == 0, 8 + 4.4 * root).otherwise(4 + 2.4 * root))


def most_cited(counts: DataFrame, *, minimum: int, limit: int) -> DataFrame:
    """The `limit` rows of (id, n) with n >= minimum, most first, ties by id. A top-k:
    no global sort."""
    return counts.where(F.col("n") >= minimum).orderBy(F.desc("n"), "id").limit(limit)


def left_out(counts: DataFrame, *, minimum: int, limit: int) -> DataFrame:
    """One row: eligible works, those kept, and those left out by the budget."""
    eligible = F.count(F.when(F.col("n") >= minimum, 1))
    return counts.agg(eligible.alias("eligible"), F.least(eligible, F.lit(limit)).cast("long").alias("kept"), F.greatest(eligible - limit, F.lit(0)).cast("long").alias("left_out"))


def allowed_sources(citations: DataFrame, off: set[str]) -> DataFrame:
    """Citations whose kind isn't switched off; it goes below the merge's shuffle."""
    return citations.where(~F.col("kind").isin(*off)) if off else citations


def without_isolated(nodes: DataFrame, edges: DataFrame, center: str | None = None) -> DataFrame:
    """Nodes with any edge, and the centre."""
    touched = edges.select(F.col("source").alias("id")).union(edges.select("target"))
    if center is not None:
        touched = touched.union(nodes.sparkSession.createDataFrame([(center,)], "id string"))
    return nodes.join(touched, "id", "left_semi")


def local_graph(edges: DataFrame, center: str, *, depth: int = 2, direction: str = "both") -> DataFrame:
    """(id, distance) within depth (at most 3) steps of the centre.

    A breadth-first search of at most three joins; each frontier is distinct and
    excludes what was reached before, so a hub is expanded once."""
    if direction == "out":
        steps = edges.select("source", "target")
    elif direction == "in":
        steps = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    else:
        steps = edges.select("source", "target").union(edges.select("target", "source"))
    reached = edges.sparkSession.createDataFrame([(center, 0)], "id string, distance int")
    frontier = reached
    for d in range(1, min(depth, 3) + 1):
        found = steps.join(frontier.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
        frontier = found.join(reached.select("id"), "id", "left_anti").withColumn("distance", F.lit(d))
        reached = reached.union(frontier)
    return reached


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges between the given ids."""
    own = ids.select("id")
    return edges.join(own.withColumnRenamed("id", "source"), "source", "left_semi").join(own.withColumnRenamed("id", "target"), "target", "left_semi")


def cited_by_stage(citing: DataFrame, *, minimum: int, limit: int) -> DataFrame:
    """(id, n, cites) of citing works: the sorted works of the collection they cite."""
    listed = citing.groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_set("target")).alias("cites")).withColumn("n", F.size("cites").cast("long"))
    return most_cited(listed, minimum=minimum, limit=limit)


def edge_classes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, in_vault): whether both ends belong to the collection."""
    side = nodes.select("id", "depth")
    return edges.join(side.select(F.col("id").alias("source"), F.col("depth").alias("ds")), "source").join(side.select(F.col("id").alias("target"), F.col("depth").alias("dt")), "target").select("source", "target", ((F.col("ds") == 0) & (F.col("dt") == 0)).alias("in_vault"))


def status_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: works by depth, and citations."""
    works = nodes.agg(F.count(F.when(F.col("depth") == 0, 1)).alias("vault_works"), F.count(F.when(F.col("depth") == 1, 1)).alias("outside_works"))
    return works.crossJoin(edges.agg(F.count(F.lit(1)).alias("citations")))  # one row by one row


def union_edges(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), sources)


def common_citers(edges: DataFrame, *, minimum: int) -> DataFrame:
    """(id, citers) of targets with at least `minimum` citers: the core."""
    return edges.groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("citers")).where(F.col("citers") >= minimum)


#: Links of core works and of targets that a task holds, and what a target counts at least,
#: which bounds a block's targets.
CORE_LINKS, ROW_LINKS, LEAST = 1 << 25, 1 << 24, 32


def _union_sizes(places, counts, core, sizes):
    """(place, n): the size of the union of its sources' core works, for each place. Source
    i has counts[i] of `places` and sizes[i] of `core`, one after another. Sources that cite
    much of the block are rows of bits, the others lists."""
    import numpy as np

    core = core.astype("i8")  # numpy looks places up by these
    width = int(core.max()) + 1 if len(core) else 1
    words = -(-width // 64)
    ends = np.cumsum(sizes)
    starts = (ends - sizes).tolist()
    dense = np.flatnonzero(sizes > words)
    row = np.full(len(sizes), -1)
    row[dense] = np.arange(len(dense))
    bits, mark = np.zeros((len(dense), words), "u8"), np.zeros(words * 64, bool)
    for i, j in enumerate(dense.tolist()):
        mark[:] = False
        mark[core[starts[j] : ends[j]]] = True
        bits[i] = np.packbits(mark, bitorder="little").view("u8")
    lists, row, order = [core[a:b] for a, b in zip(starts, ends.tolist(), strict=True)], row.tolist(), np.argsort(places, kind="stable")
    sources, (found, first) = np.repeat(np.arange(len(counts)), counts)[order].tolist(), np.unique(places[order], return_index=True)
    last, out = np.append(first[1:], len(sources)).tolist(), np.zeros(len(found), "i8")
    owner = np.zeros(width, "i4")
    for at, (a, b) in enumerate(zip(first.tolist(), last, strict=True)):
        mine = sources[a:b]
        if len(mine) == 1:
            out[at] = len(lists[mine[0]])
            continue
        full, thin = [row[j] for j in mine if row[j] >= 0], [lists[j] for j in mine if row[j] < 0]
        if len(thin) > 64:  # a list is no longer than a 64th of the block
            mark[:] = False
            for x in thin:
                mark[x] = True
            thin, both = [], np.packbits(mark, bitorder="little").view("u8")
        else:
            both = np.zeros(words, "u8") if full else None
        for k in range(0, len(full), 64):
            both |= np.bitwise_or.reduce(bits[full[k : k + 64]], axis=0)
        n = 0 if both is None else int(np.bitwise_count(both).sum(dtype="i8"))
        if thin:
            x = np.concatenate(thin)
            if both is not None:
                x = x[(both[x >> 6] >> (x & 63).astype("u8")) & np.uint64(1) == 0]
            i = np.arange(len(x), dtype="i4")
            owner[x] = i  # of equal works one is last
            n += int(np.count_nonzero(owner[x] == i))
        out[at] = n
    return found, out


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(position, n): sizes of unions within blocks. Rows (rows, base, bits, places, core) come
    sorted by block: `core` is what a source cites of the block's core works, `places` its
    targets among the block's, whose first one is at `base`."""
    import numpy as np

    held: list[tuple] = []
    here = base = None

    def block() -> pa.RecordBatch:
        found, n = _union_sizes(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(found.astype("i8") + base), pa.array(n)], names=["position", "n"])

    for batch in batches:
        keys = np.stack([batch[k].to_numpy() for k in ("rows", "bits")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if tuple(keys[a]) != here:
                if held:
                    yield block()
                here, base = tuple(keys[a]), batch["base"][a].as_py()
            part = batch.slice(a, b - a)
            held.append(tuple(x for c in ("places", "core") for x in (part[c].flatten().to_numpy(), part[c].value_lengths().to_numpy())))
    if held:
        yield block()


def co_cited(edges: DataFrame, *, minimum: int = 2) -> DataFrame:
    """(id, co_cited, core_size) of each target: how many works of the core share a
    citer with it, itself excluded; and the core's size without it.

    That is the size of a union of its citers' core works, so a product of two matrices, taken
    by blocks. Targets are numbered so that those with a citer in common are near each other.
    A source's places in a block of targets and its core works in a block of core works are a
    row each; the two meet once for each source, not for each target, and a task unites them.
    Blocks have as many links as a task can hold, so that a source, even one whose targets lie
    all over, is sent to few. Unions are never shuffled, only sizes."""
    spark = edges.sparkSession
    distinct = cut(edges.select("source", "target").distinct(), "co-edges")
    per = distinct.groupBy("target").agg(F.count(F.lit(1)).alias("citers"), F.min(F.struct(F.length("source"), "source")).alias("first"))
    weight = F.greatest("citers", F.lit(LEAST))
    numbers = cut(running_sum(per.withColumn("weight", weight), "weight", "first", "target").select("target", "position", "citers", "before"), "co-places")
    whole = numbers.agg(F.sum(weight)).first()[0] or 0
    # several blocks of targets lie in one of core works, and there are two tasks for each core
    across = max(-(-CORE_LINKS // ROW_LINKS), -(-2 * spark.sparkContext.defaultParallelism * CORE_LINKS // max(1, whole * -(-whole // CORE_LINKS))))
    links = max(LEAST, CORE_LINKS // across)
    blocks = numbers.withColumn("rows", F.floor(F.col("before") / links)).withColumn("bits", F.floor(F.col("rows") / across))
    firsts = lambda c, name: blocks.groupBy(c).agg(F.min("position").alias(name))
    bases = blocks.select("rows", "bits").distinct().join(firsts("rows", "base"), "rows").join(firsts("bits", "bit_base"), "bits")
    bases = cut(bases.select("rows", "base", "bits", (F.col("base") - F.col("bit_base")).cast("int").alias("shift")), "co-bases")
    places = blocks.join(F.broadcast(bases.select("rows", "base")), "rows").select("target", "rows", (F.col("position") - F.col("base")).cast("int").alias("at"), (F.col("citers") >= minimum).alias("core"))
    placed = distinct.join(places.hint("merge"), "target")
    lists = placed.groupBy("source", "rows").agg(F.collect_list("at").alias("places"), F.collect_list(F.when(F.col("core"), F.col("at"))).alias("core"))
    lists = cut(lists.join(F.broadcast(bases), "rows"), "co-lists")
    core = lists.where(F.size("core") > 0).groupBy("source", "bits").agg(F.flatten(F.collect_list(F.transform("core", lambda x: x + F.col("shift")))).alias("core"))
    met = lists.select("source", "rows", "base", "places").join(core.hint("merge"), "source").select("rows", "base", "bits", "places", "core")
    high = -(-whole // CORE_LINKS) + 1
    united = met.repartitionById(max(1, (whole // links + 1) * high), (F.col("rows") * high + F.col("bits")).cast("int")).sortWithinPartitions("rows", "bits").mapInArrow(_united, "position long, n long")
    sizes = cut(united.groupBy("position").agg(F.sum("n").alias("n")), "co-sizes")
    size = numbers.agg(F.count(F.when(F.col("citers") >= minimum, 1)).alias("core_size"))
    mine = F.when(F.col("citers") >= minimum, 1).otherwise(0)
    return numbers.join(sizes.hint("merge"), "position", "left").crossJoin(F.broadcast(size)).select(F.col("target").alias("id"), (F.coalesce("n", F.lit(0)) - mine).alias("co_cited"), (F.col("core_size") - mine).alias("core_size"))


def timeline(works: DataFrame) -> DataFrame:
    """(year, n, shown): works of each plausible year, and those up to it."""
    per = works.where("year > 1000 and year < 3000").groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("shown", F.sum("n").over(Window.orderBy("year")))


def year_scale(works: DataFrame, width: float) -> DataFrame:
    """(year, x): the mid-rank share of works before each year, less a half, times the
    width. Windows run over years, not works; one year alone is at 0."""
    per = works.where(F.col("year").isNotNull()).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = Window.partitionBy()
    x = ((below + F.col("n") / 2) / F.sum("n").over(every) - 0.5) * width
    return per.select("year", F.when(F.count(F.lit(1)).over(every) > 1, x).otherwise(F.lit(0.0)).alias("x"))


def appearance_order(works: DataFrame) -> DataFrame:
    """(id, position): the collection first, most cited first; then outside works by
    year (unknown last), most cited first. Ties by id; positions start at 0."""
    order = [F.col("depth"), F.when(F.col("depth") == 0, -F.col("cited_by")), F.when(F.col("depth") != 0, F.col("year")).asc_nulls_last(), F.desc("cited_by"), F.col("id")]
    return numbered(works, *order).select("id", F.col("position").cast("int").alias("position"))


def circle_places(works: DataFrame) -> DataFrame:
    """(id, x, y) of the collection's works on the unit circle, by year (unknown last),
    clockwise from the top."""
    placed = numbered(works.select("id", "year"), F.col("year").asc_nulls_last(), F.col("id"))
    n = works.agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("n"))
    angle = -F.pi() / 2 + 2 * F.pi() * F.col("position") / F.col("n")
    return placed.crossJoin(F.broadcast(n)).withColumn("angle", angle).select("id", F.cos("angle").alias("x"), F.sin("angle").alias("y"))
