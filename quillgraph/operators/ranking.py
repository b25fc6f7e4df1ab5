"""Reading suggestions and citing works: signals, scores, reasons, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.lineage import cut
from quillgraph.operators.graph import co_cited, common_citers

#: Weights of the signals.
CITES_VAULT = 0.5
OUTSIDE_CITER, OUTSIDE_MAX = 0.1, 1.0
CO_CITATION = 0.5
RECENCY, RECENT_YEARS = 0.2, 30
CITATIONS = 0.2


def round_half_up(x: Column) -> Column:
    """To two places, half up on the binary double."""
    return F.floor(x * 100 + 0.5) / 100


def bonus(year: Column, cited_by_count: Column, this_year: int) -> Column:
    """Recency (years to come count as this one) and citations in all."""
    recent = F.when(year.isNull(), F.lit(0.0)).otherwise(RECENCY * F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (this_year - year) / F.lit(float(RECENT_YEARS)))))
    return recent + CITATIONS * F.least(F.lit(1.0), F.log10(1 + F.coalesce(cited_by_count, F.lit(0))) / 4)


def suggestions(nodes: DataFrame, edges: DataFrame, info: DataFrame, this_year: int) -> DataFrame:
    """Works outside the collection with signals and score.

    `edges` get the depths ds and dt of their ends, once for all signals. Edges are
    aggregated once per end; only edges from the collection go into co-citation."""
    depth = nodes.select("id", "depth")
    sided = edges.select("source", "target").join(depth.select(F.col("id").alias("source"), F.col("depth").alias("ds")), "source").join(depth.select(F.col("id").alias("target"), F.col("depth").alias("dt")), "target")
    sided = cut(sided, "sided")
    into = sided.where("dt <> 0").groupBy(F.col("target").alias("id")).agg(F.count(F.when(F.col("ds") == 0, 1)).alias("vault_citers"), F.count(F.when(F.col("ds") != 0, 1)).alias("outside_citers"))
    out = sided.where("ds <> 0 and dt = 0").groupBy(F.col("source").alias("id")).agg(F.countDistinct("target").alias("cites_vault"))
    shared = co_cited(sided.where("ds = 0 and dt <> 0").select("source", "target"))
    core = common_citers(sided.where("ds = 0 and dt <> 0"), minimum=2).agg(F.count(F.lit(1)).alias("whole_core"))
    rows = nodes.where("depth <> 0").select("id", "title").join(into, "id", "left").join(out, "id", "left").join(shared, "id", "left").join(info, "id", "left").crossJoin(F.broadcast(core))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = rows.select("id", "title", "year", "cited_by_count", *(zero(c).alias(c) for c in ("vault_citers", "cites_vault", "outside_citers", "co_cited")), F.coalesce("core_size", "whole_core", F.lit(0)).alias("core_size"))
    score = (
        F.col("vault_citers")
        + CITES_VAULT * F.col("cites_vault")
        + F.least(F.lit(OUTSIDE_MAX), OUTSIDE_CITER * F.col("outside_citers"))
        + F.when(F.col("core_size") > 0, CO_CITATION * F.col("co_cited") / F.col("core_size")).otherwise(0.0)
        + bonus(F.col("year"), F.col("cited_by_count"), this_year)
    )
    return rows.withColumn("score", round_half_up(score))


def reading_order(label: str) -> Column:
    """Labels as a reader sorts them: letters first, then accents, then case."""
    return F.collate(label, "UNICODE")


def ranked(rows: DataFrame, limit: int, *second: str, label: str | None = None) -> DataFrame:
    """The best `limit` rows with their rank; ties by the further columns, then, if it is
    given, by the `label` column as a reader sorts it, then id.

    The top-k runs first, so the one-partition window has `limit` rows."""
    order = [F.desc("score"), *(F.desc(c) for c in second), *([reading_order(label)] if label else []), F.col("id")]
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rank_citing(works: DataFrame, this_year: int) -> DataFrame:
    """(id, cites, year, cited_by_count) -> with score: works of the collection that
    each cites, and the small bonuses."""
    return works.withColumn("score", round_half_up(F.col("cites") + bonus(F.col("year"), F.col("cited_by_count"), this_year)))


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def reasons(citers: Column | None = None, cited: Column | None = None) -> Column:
    """Why a work is suggested, strongest first: an array of lines. citers and cited are
    texts that name works of the collection; null, or none given, names nothing."""
    c = F.col
    named = lambda names: F.lit("") if names is None else F.coalesce(F.concat(F.lit(": "), names), F.lit(""))
    lines = F.array(
        F.when(c("vault_citers") > 0, F.concat(F.lit("Cited by "), plural(c("vault_citers"), "work"), F.lit(" of your vault"), named(citers))),
        F.when(c("cites_vault") > 0, F.concat(F.lit("Cites "), plural(c("cites_vault"), "work"), F.lit(" of your vault"), named(cited))),
        F.when(c("outside_citers") > 0, F.concat(F.lit("Cited by "), plural(c("outside_citers"), "other work"), F.lit(" of the graph"))),
        F.when(c("co_cited") > 0, F.concat(F.lit("Cited along with "), c("co_cited").cast("string"), F.lit(" of the "), c("core_size").cast("string"), F.lit(" works your vault cites most (cited by several of its works)"))),
        F.when(c("year").isNotNull(), F.concat(F.lit("Published in "), c("year").cast("string"))),
        F.when(c("cited_by_count").isNotNull(), F.concat(F.lit("Cited "), c("cited_by_count").cast("string"), F.lit(" times in all (OpenAlex)"))),
    )
    return F.filter(lines, lambda x: x.isNotNull())


def first_names(rows: DataFrame, nodes: DataFrame, edges: DataFrame, end: str, name: str, shown: int = 5) -> DataFrame:
    """(id, `name`): for each of rows(id) that is the `end` (source or target) of an edge, the
    labels of the first `shown` works of the collection at the other end, in a reader's
    order, and how many more there are. nodes(id, depth, label) may have null labels:
    those are named by their id.

    Spark cuts each group to `shown` rows before the shuffle, so a work with millions of
    citers is no task of its own; the others are only counted."""
    other = "source" if end == "target" else "target"
    own = nodes.where("depth = 0").select(F.col("id").alias("other"), F.coalesce("label", "id").alias("label"))
    pairs = edges.select(F.col(end).alias("id"), F.col(other).alias("other")).distinct().join(rows.select("id").distinct(), "id", "left_semi").join(own, "other")
    first = Window.partitionBy("id").orderBy(reading_order("label"), "other")
    top = pairs.withColumn("place", F.row_number().over(first)).where(F.col("place") <= shown)
    listed = top.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "label"))), lambda s: s["label"]), "; ").alias("listed"))
    more = pairs.groupBy("id").agg((F.count(F.lit(1)) - shown).alias("more"))
    return listed.join(more, "id").select("id", F.when(F.col("more") > 0, F.concat("listed", F.lit("… (+"), F.col("more").cast("string"), F.lit(")"))).otherwise(F.col("listed")).alias(name))


def named_reasons(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, why): reasons of suggestions that name the works of the collection."""
    rows = cut(rows, "suggested")
    both = rows.join(first_names(rows, nodes, edges, "target", "citer_names"), "id", "left").join(first_names(rows, nodes, edges, "source", "cited_names"), "id", "left")
    return both.select("id", reasons(F.col("citer_names"), F.col("cited_names")).alias("why"))


#: An export's fields, in their order.
FIELDS = ("rank", "score", "label", "title", "authors", "year", "doi", "openalex_id", "reference", "cited_by_vault", "cites_vault", "co_cited", "core_size", "cited_by_count", "why")


def export_records(rows: DataFrame, nodes: DataFrame, edges: DataFrame, works: DataFrame | None = None) -> DataFrame:
    """The 15 fields of ranked suggestions. nodes(id, depth) and edges(source, target) name
    the works of the collection that cite each and that each cites; works(id, label, authors,
    doi, openalex_id, reference) say what is known of them. Lists are of the suggestions
    ranked alone, and of the collection's works."""
    own = nodes.where("depth = 0").select(F.col("id").alias("other"))
    rows = cut(rows, "suggested")
    asked = rows.select("id")

    def named(end: str, other: str, name: str) -> DataFrame:
        pairs = edges.select(F.col(end).alias("id"), F.col(other).alias("other")).join(asked, "id", "left_semi").join(own, "other", "left_semi")
        return pairs.groupBy("id").agg(F.sort_array(F.collect_set("other")).alias(name))

    none = F.array().cast("array<string>")
    both = rows.join(named("target", "source", "cited_by_vault"), "id", "left").join(named("source", "target", "cites_vault_paths"), "id", "left")
    if works is not None:
        both = both.join(works.select("id", "label", "authors", "doi", "openalex_id", "reference"), "id", "left")
    missing = {c: F.lit(None).cast("string") for c in ("label", "doi", "openalex_id", "reference") if c not in both.columns} | ({} if "authors" in both.columns else {"authors": none})
    both = both.withColumns(missing | {"why": reasons()}).withColumns({"cites_vault": F.coalesce("cites_vault_paths", none), "cited_by_vault": F.coalesce("cited_by_vault", none), "authors": F.coalesce("authors", none), "title": F.when(F.col("title") != "", F.col("title"))})
    return both.select(*FIELDS)


def export_lines(records: DataFrame) -> DataFrame:
    """(rank, line): JSON lines of the records, nulls included."""
    return records.select("rank", F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}).alias("line"))


def write_export(records: DataFrame, path: str, meta: dict) -> None:
    """One text file: a meta line, then a line for each record in order. It is there as a
    whole or, if anything fails before, as it was."""
    import json

    from quillgraph.sources.sinks import publish_lines

    head = records.sparkSession.createDataFrame([(0, json.dumps({"_meta": True, **meta}))], "rank int, line string")
    publish_lines(head.union(export_lines(records)), "rank", "line", path)
