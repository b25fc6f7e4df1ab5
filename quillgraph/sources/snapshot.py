"""External works from a snapshot of JSON records, with negative caching and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import normalize_doi
from quillgraph.operators.order import numbered

#: The raw records' fields that are read.
RAW = (
    "id string, doi string, display_name string, publication_year int, cited_by_count long, referenced_works array<string>, "
    "authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>>, "
    "topics array<struct<id:string,display_name:string,score:double>>, keywords array<struct<display_name:string,score:double>>, abstract_inverted_index map<string,array<int>>"
)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Summaries of a JSON-lines snapshot; a schema is given, so nothing is inferred."""
    return summarize(spark.read.schema(RAW).json(path))


def summarize(raw: DataFrame, *kept: str) -> DataFrame:
    """Ids without their prefix, DOIs normalised, authors without empty names. Missing
    topics and keywords stay null, which isn't the same as none. Columns `kept` go along."""
    short = lambda c: F.regexp_replace(c, "^.*/", "")
    return raw.select(
        *kept,
        short(F.col("id")).alias("id"),
        normalize_doi(F.col("doi")).alias("doi"),
        F.coalesce("display_name", F.lit("")).alias("title"),
        F.col("publication_year").alias("year"),
        F.filter(F.transform(F.coalesce("authorships", F.array()), lambda a: a["author"]["display_name"]), lambda n: n.isNotNull() & (n != "")).alias("authors"),
        F.col("primary_location.source.display_name").alias("venue"),
        F.transform(F.coalesce("referenced_works", F.array()), short).alias("references"),
        F.col("cited_by_count"),
        F.transform("topics", lambda t: F.struct(short(t["id"]).alias("id"), t["display_name"].alias("name"), t["score"].alias("score"))).alias("topics"),
        F.transform("keywords", lambda k: F.struct(k["display_name"].alias("name"), k["score"].alias("score"))).alias("keywords"),
        abstract_text(F.col("abstract_inverted_index")).alias("abstract"),
    )


def abstract_text(inverted):
    """The words of an inverted index in the order of their places; null if empty."""
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(pairs), lambda s: s["w"]), " "), F.lit(""))


def lookup(dois: DataFrame, doi_to_id: DataFrame, works: DataFrame) -> DataFrame:
    """dois(pos, doi) in order with their works; unknown ones go, repeats stay."""
    known = dois.join(doi_to_id.where("id is not null"), "doi")
    return known.join(works, "id").orderBy("pos")


def to_fetch(dois: DataFrame, doi_to_id: DataFrame, batch: int = 50) -> DataFrame:
    """(doi, batch) of DOIs that were never asked for; known-unknown ones aren't."""
    new = dois.select("doi").distinct().join(doi_to_id.select("doi"), "doi", "left_anti")
    return numbered(new, "doi").select("doi", F.floor(F.col("position") / batch).alias("batch"))


def citing_works(works: DataFrame, ids: DataFrame, limit: int = 50) -> DataFrame:
    """(id, citing, cited_by_count, total, rank): the most cited works that cite each id."""
    from pyspark.sql import Window

    cites = works.select(F.col("id").alias("citing"), "cited_by_count", F.explode("references").alias("id")).join(ids, "id", "left_semi")
    w = Window.partitionBy("id")
    return cites.withColumn("total", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("cited_by_count"), "citing"))).where(F.col("rank") <= limit)


def prune(works: DataFrame, keep: DataFrame, vault: DataFrame) -> DataFrame:
    """Works to keep: named ones, the collection's, and what those cite; outside works
    keep only their references into the collection."""
    own = vault.select("id")
    cited = works.join(own, "id", "left_semi").select(F.explode("references").alias("id"))
    ids = keep.select("id").union(own).union(cited).distinct()
    inside = works.select("id", F.explode_outer("references").alias("ref")).join(own.withColumn("mine", F.lit(True)).withColumnRenamed("id", "ref"), "ref", "left").where("mine").groupBy("id").agg(F.sort_array(F.collect_list("ref")).alias("inside"))
    flagged = works.join(ids, "id", "left_semi").join(own.withColumn("own", F.lit(True)), "id", "left").join(inside, "id", "left")
    return flagged.withColumn("references", F.when(F.col("own"), F.col("references")).otherwise(F.coalesce("inside", F.array().cast("array<string>")))).drop("own", "inside")
