"""The register of queries: a name, a function of (spark, sf_dir), and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def joined(column: str, by: str = "|"):
    """An array as text, which both engines compare alike."""
    return F.array_join(column, by)


def rounded(column, places: int = 6):
    """Half up on the double, in the same steps as the SQL's."""
    return F.floor(column * 10**places + 0.5) / 10**places


#: The views that the SQL shares.
CITE = """cite AS (
  SELECT 'S' || l_suppkey AS source, 'P' || l_partkey AS target,
    CASE l_returnflag WHEN 'A' THEN 'link' WHEN 'N' THEN 'bibliography' ELSE 'openalex' END AS kind
  FROM lineitem
), edges AS (SELECT DISTINCT source, target FROM cite)"""
INFO = """info AS (
  SELECT 'P' || l_partkey AS id, max(year(l_shipdate))::BIGINT AS year, sum(l_quantity)::BIGINT AS cited_by_count FROM lineitem GROUP BY l_partkey
)"""
BONUS = "CASE WHEN year IS NULL THEN 0.0::DOUBLE ELSE 0.2::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - (2026 - year) / 30.0::DOUBLE)) END + 0.2::DOUBLE * least(1.0::DOUBLE, log10((1 + coalesce(cited_by_count, 0))::DOUBLE) / 4)"
