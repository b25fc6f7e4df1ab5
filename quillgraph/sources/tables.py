"""The driver's tables seen as a literature collection.

Suppliers are the works of the collection (depth 0), parts the works outside it
(depth 1); a line item is a citation from a supplier to a part, and its return flag
says where the citation was found (A link, N bibliography, R openalex).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt to all cores by a key. A table of few bytes is one file and one task,
    whatever is computed from each of its rows."""
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, key)


#: Rows of one task, where tables are dealt by their size.
TASK_ROWS = 250_000


def dealt(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The rows, some n, dealt by a key to so many tasks that each has few, however large
    the table is: what is grouped by that key next needs no further shuffle."""
    return rows.repartition(max(8, -(-n // TASK_ROWS)), key)


def raw_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, kind, quantity) of every line item, repeats included."""
    kind = F.when(F.col("l_returnflag") == "A", "link").when(F.col("l_returnflag") == "N", "bibliography").otherwise("openalex")
    return read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("source"), F.concat(F.lit("P"), F.col("l_partkey")).alias("target"), kind.alias("kind"), F.col("l_quantity").alias("quantity")
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, kind) of every line item."""
    return raw_citations(spark, sf_dir).select("source", "target", "kind")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, depth, title, keywords) of both sorts of works."""
    vault = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("id"), F.lit(0).alias("depth"), F.col("s_name").alias("title"), F.array().cast("array<string>").alias("keywords"))
    outside = read(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("id"), F.lit(1).alias("depth"), F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("keywords"))
    return vault.union(outside)


def work_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, year, cited_by_count) of the works outside."""
    return read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max(F.year("l_shipdate")).alias("year"), F.sum("l_quantity").cast("long").alias("cited_by_count")).select(F.concat(F.lit("P"), F.col("l_partkey")).alias("id"), "year", "cited_by_count")
