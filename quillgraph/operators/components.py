"""Connected components and maximum spanning forests, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.lineage import cut


def roots(parents: DataFrame, name: str = "roots") -> DataFrame:
    """(id, root) of parents(id, parent), trees whose roots are their own parents: pointers
    are doubled until all point at roots."""
    state = cut(parents.select("id", F.col("parent").alias("root")), name)
    while True:
        up = state.select(F.col("id").alias("root"), F.col("root").alias("next"))
        jumped = cut(state.join(up, "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), name)
        if jumped.where("moved").isEmpty():
            return jumped.select("id", "root")
        state = jumped.select("id", "root")


def hooked(choice: DataFrame) -> DataFrame:
    """(id, parent) of choice(id, other): each id hangs on its other; where two chose each
    other the smaller is the root. `other` must come from one total order of edges, best
    first, so that there are no longer cycles; ids that are only chosen are roots."""
    back = choice.select(F.col("id").alias("other"), F.col("other").alias("back"))
    both = choice.join(back, "other", "left")
    hung = both.select("id", F.when((F.col("back") == F.col("id")) & (F.col("id") < F.col("other")), F.col("id")).otherwise(F.col("other")).alias("parent"))
    chosen = choice.select(F.col("other").alias("id")).distinct().join(choice.select("id"), "id", "left_anti")
    return hung.unionByName(chosen.withColumn("parent", F.col("id")))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, similarity): the maximum spanning forest of edges(a, b, similarity), ties to
    the smaller (a, b), as Borůvka finds it.

    In a round every tree takes its best edge to another tree, an aggregation of one row a
    tree and task; trees so joined become one by doubling pointers, and what lies inside of
    a tree is dropped. At least half of the trees go each round, and no task holds more than
    its share of the edges."""
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").where("a <> b").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    # u and v are the trees of a and b
    left = cut(pairs.select("a", "b", "similarity", F.col("a").alias("u"), F.col("b").alias("v")), "forest-edges")
    forest = left.select("a", "b", "similarity").limit(0)
    while True:
        rank = F.struct((-F.col("similarity")).alias("s"), "a", "b")
        ends = left.select(F.col("u").alias("id"), F.col("v").alias("other"), rank.alias("e")).unionByName(left.select(F.col("v").alias("id"), F.col("u").alias("other"), rank.alias("e")))
        best = cut(ends.groupBy("id").agg(F.min(F.struct("e", "other")).alias("m")).select("id", F.col("m.other").alias("other"), F.col("m.e").alias("e")), "forest-best")
        if best.isEmpty():
            return forest
        forest = cut(forest.unionByName(best.select("e").distinct().select(F.col("e.a").alias("a"), F.col("e.b").alias("b"), (-F.col("e.s")).alias("similarity"))), "forest")
        tree = roots(hooked(best.select("id", "other")), "forest-roots")
        u, v = (tree.select(F.col("id").alias(x), F.col("root").alias(f"r{x}")) for x in "uv")
        left = cut(left.join(u, "u").join(v, "v").where("ru <> rv").select("a", "b", "similarity", F.col("ru").alias("u"), F.col("rv").alias("v")), "forest-edges")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each connected component of edges(a, b).

    Large and small stars in turn: each id hangs its neighbours on the least of them, first
    the larger ones, then the smaller. A hub's neighbours are rows, never a list."""
    pairs = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    every = cut(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), "star-ids")
    while True:
        both = pairs.select("u", "v").union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        small = cut(small, "stars")
        if small.exceptAll(pairs).isEmpty() and small.count() == pairs.count():
            return every.join(small.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        pairs = small
