"""Graph and ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import graph, ranking
from quillgraph.plans.base import BONUS, CITE, INFO, joined, query, rounded
from quillgraph.sources import tables as T

THIS_YEAR = 2026
PRIORITY = ("link", "bibliography", "openalex")


def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.merge_edges(T.citations(spark, d))


@query("edge_merge", "SELECT 'S' || l_suppkey AS source, 'P' || l_partkey AS target, array_to_string(list_sort(list(DISTINCT CASE l_returnflag WHEN 'A' THEN 'link' WHEN 'N' THEN 'bibliography' ELSE 'openalex' END)), '|') AS kinds FROM lineitem GROUP BY 1, 2")
def edge_merge(s, d):
    return graph.merge_edges(T.raw_citations(s, d), T.nodes(s, d)).select("source", "target", joined("kinds").alias("kinds"))


@query("edge_first_source", f"WITH {CITE} SELECT source, target, arg_min(kind, CASE kind WHEN 'link' THEN 1 WHEN 'bibliography' THEN 2 ELSE 3 END) AS kind FROM cite GROUP BY 1, 2")
def edge_first_source(s, d):
    return graph.first_source(T.citations(s, d), PRIORITY)


@query("in_degree", f"WITH {CITE} SELECT 'P' || p_partkey AS id, count(source)::BIGINT AS cited_by FROM part LEFT JOIN edges ON target = 'P' || p_partkey GROUP BY 1 UNION ALL SELECT 'S' || s_suppkey, 0 FROM supplier")
def in_degree(s, d):
    return graph.in_degree(edges(s, d), T.nodes(s, d))


@query("degree", f"WITH {CITE} SELECT id, count(*)::BIGINT AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id")
def degree(s, d):
    return graph.degree(edges(s, d))


@query("hover_counts", f"WITH {CITE} SELECT id, sum(o)::BIGINT AS cites, sum(i)::BIGINT AS cited_by FROM (SELECT source AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, 0, 1 FROM edges) GROUP BY id")
def hover_counts(s, d):
    return graph.hover_counts(edges(s, d))


@query("node_radius", f"WITH {CITE} SELECT id, floor(least(40.0::DOUBLE, CASE WHEN id LIKE 'S%' THEN 8 + 4.4::DOUBLE * sqrt(greatest(o, i)) ELSE 4 + 2.4::DOUBLE * sqrt(greatest(o, i)) END) * 1000000 + 0.5) / 1000000 AS radius FROM (SELECT id, sum(o) AS o, sum(i) AS i FROM (SELECT source AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, 0, 1 FROM edges) GROUP BY id)")
def node_radius(s, d):
    counts = graph.hover_counts(edges(s, d))
    return counts.select("id", rounded(graph.node_radius(F.when(F.col("id").startswith("S"), 0).otherwise(1), F.col("cited_by"), F.col("cites"))).alias("radius"))


@query("edge_classes", f"WITH {CITE} SELECT source, target, false AS in_vault FROM edges")
def edge_classes(s, d):
    return graph.edge_classes(edges(s, d), T.nodes(s, d))


_COUNTS = f"WITH {CITE}, n AS (SELECT target AS id, count(*)::BIGINT AS n FROM edges GROUP BY 1) "


def cited_counts(s, d):
    return edges(s, d).groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query("most_cited_budget", _COUNTS + "SELECT id, n FROM n WHERE n >= 2 ORDER BY n DESC, id LIMIT 300")
def most_cited_budget(s, d):
    return graph.most_cited(cited_counts(s, d), minimum=2, limit=300)


@query("left_out_count", _COUNTS + "SELECT count(*)::BIGINT AS eligible, least(count(*), 300)::BIGINT AS kept, greatest(count(*) - 300, 0)::BIGINT AS left_out FROM n WHERE n >= 2")
def left_out_count(s, d):
    return graph.left_out(cited_counts(s, d), minimum=2, limit=300)


@query("edge_source_filter", f"WITH {CITE} SELECT source, target, array_to_string(list_sort(list(DISTINCT kind)), '|') AS kinds FROM cite WHERE kind <> 'openalex' GROUP BY 1, 2")
def edge_source_filter(s, d):
    return graph.merge_edges(graph.allowed_sources(T.citations(s, d), {"openalex"})).select("source", "target", joined("kinds").alias("kinds"))


@query("hide_isolated", f"WITH {CITE}, e AS (SELECT DISTINCT source AS id FROM edges UNION SELECT target FROM edges UNION SELECT 'P1') SELECT 'P' || p_partkey AS id, 1 AS depth FROM part WHERE 'P' || p_partkey IN (SELECT id FROM e) UNION ALL SELECT 'S' || s_suppkey, 0 FROM supplier WHERE 'S' || s_suppkey IN (SELECT id FROM e)")
def hide_isolated(s, d):
    return graph.without_isolated(T.nodes(s, d).select("id", "depth"), edges(s, d), "P1")


_CITING = "SELECT DISTINCT 'C' || o_custkey AS source, 'S' || l_suppkey AS target FROM orders JOIN lineitem ON l_orderkey = o_orderkey"


def citing_edges(s, d):
    orders, lines = T.read(s, d, "orders"), T.read(s, d, "lineitem")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("C"), F.col("o_custkey")).alias("source"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("target")).distinct()


@query("cited_by_stage", f"WITH c AS ({_CITING}) SELECT source AS id, count(*)::BIGINT AS n, array_to_string(list_sort(list(target)), '|') AS cites FROM c GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, id LIMIT 500")
def cited_by_stage(s, d):
    return graph.cited_by_stage(citing_edges(s, d), minimum=2, limit=500).select("id", "n", joined("cites").alias("cites"))


@query("co_citation_core", f"WITH {CITE} SELECT target AS id, count(*)::BIGINT AS citers FROM edges GROUP BY 1 HAVING count(*) >= 2")
def co_citation_core(s, d):
    return graph.common_citers(edges(s, d), minimum=2)


_CO = """core AS (SELECT target FROM edges GROUP BY 1 HAVING count(*) >= 2),
co AS (SELECT e.target AS id, count(DISTINCT c.target)::BIGINT AS co_cited FROM edges e JOIN edges c ON e.source = c.source JOIN core ON core.target = c.target WHERE c.target <> e.target GROUP BY 1)"""


@query("co_cited_count", f"WITH {CITE}, {_CO} SELECT t.target AS id, coalesce(co_cited, 0)::BIGINT AS co_cited, ((SELECT count(*) FROM core) - (t.target IN (SELECT target FROM core))::INT)::BIGINT AS core_size FROM (SELECT DISTINCT target FROM edges) t LEFT JOIN co ON co.id = t.target")
def co_cited_count(s, d):
    return graph.co_cited(edges(s, d))


_SUGGEST = f"""
WITH {CITE}, {INFO}, {_CO}, v AS (SELECT target AS id, count(*)::BIGINT AS vault_citers FROM edges GROUP BY 1),
r AS (
  SELECT 'P' || p_partkey AS id, p_name AS title, info.year, cited_by_count, coalesce(vault_citers, 0)::BIGINT AS vault_citers, coalesce(co_cited, 0)::BIGINT AS co_cited,
    ((SELECT count(*) FROM core) - ('P' || p_partkey IN (SELECT target FROM core))::INT)::BIGINT AS core_size
  FROM part LEFT JOIN v ON v.id = 'P' || p_partkey LEFT JOIN co ON co.id = 'P' || p_partkey LEFT JOIN info ON info.id = 'P' || p_partkey
), s AS (
  SELECT *, floor((vault_citers + CASE WHEN core_size > 0 THEN 0.5::DOUBLE * co_cited / core_size ELSE 0.0 END + ({BONUS})) * 100 + 0.5) / 100 AS score FROM r
), k AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, vault_citers DESC, id)::BIGINT AS rank FROM s
)"""


def suggested(s, d):
    rows = ranking.suggestions(T.nodes(s, d).select("id", "depth", "title"), edges(s, d).select("source", "target"), T.work_info(s, d), THIS_YEAR)
    return ranking.ranked(rows, 1000, "vault_citers")


@query("reading_suggestions", _SUGGEST + "SELECT rank, id, title, year, cited_by_count, vault_citers, co_cited, core_size, score FROM k WHERE rank <= 1000")
def reading_suggestions(s, d):
    return suggested(s, d).select(F.col("rank").cast("long").alias("rank"), "id", "title", F.col("year").cast("long").alias("year"), "cited_by_count", "vault_citers", "co_cited", "core_size", "score")


@query(
    "suggestion_reasons",
    _SUGGEST
    + """SELECT id, concat_ws(chr(10), CASE WHEN vault_citers > 0 THEN 'Cited by ' || vault_citers || ' work' || CASE WHEN vault_citers = 1 THEN '' ELSE 's' END || ' of your vault' END,
 CASE WHEN co_cited > 0 THEN 'Cited along with ' || co_cited || ' of the ' || core_size || ' works your vault cites most (cited by several of its works)' END,
 CASE WHEN year IS NOT NULL THEN 'Published in ' || year END, CASE WHEN cited_by_count IS NOT NULL THEN 'Cited ' || cited_by_count || ' times in all (OpenAlex)' END) AS why FROM k WHERE rank <= 1000""",
)
def suggestion_reasons(s, d):
    return suggested(s, d).select("id", F.array_join(ranking.reasons(), "\n").alias("why"))


@query("suggestions_by_label", _SUGGEST + "SELECT row_number() OVER (ORDER BY score DESC, vault_citers DESC, title, id)::BIGINT AS rank, id, title, score FROM s QUALIFY rank <= 1000")
def suggestions_by_label(s, d):
    """Ties go by label, as a reader sorts it."""
    rows = ranking.suggestions(T.nodes(s, d).select("id", "depth", "title"), edges(s, d).select("source", "target"), T.work_info(s, d), THIS_YEAR)
    return ranking.ranked(rows, 1000, "vault_citers", label="title").select(F.col("rank").cast("long").alias("rank"), "id", "title", "score")


@query(
    "named_reasons",
    _SUGGEST
    + """, m AS (SELECT target AS id, s_name, row_number() OVER (PARTITION BY target ORDER BY s_name, source) AS i FROM edges JOIN supplier ON 'S' || s_suppkey = source),
n AS (SELECT id, string_agg(s_name, '; ' ORDER BY i) FILTER (i <= 5) || CASE WHEN count(*) > 5 THEN '… (+' || count(*) - 5 || ')' ELSE '' END AS names FROM m GROUP BY id)
SELECT id, concat_ws(chr(10), CASE WHEN vault_citers > 0 THEN 'Cited by ' || vault_citers || ' work' || CASE WHEN vault_citers = 1 THEN '' ELSE 's' END || ' of your vault: ' || names END,
 CASE WHEN co_cited > 0 THEN 'Cited along with ' || co_cited || ' of the ' || core_size || ' works your vault cites most (cited by several of its works)' END,
 CASE WHEN year IS NOT NULL THEN 'Published in ' || year END, CASE WHEN cited_by_count IS NOT NULL THEN 'Cited ' || cited_by_count || ' times in all (OpenAlex)' END) AS why FROM k LEFT JOIN n USING (id) WHERE rank <= 1000""",
)
def named_reasons(s, d):
    named = ranking.named_reasons(suggested(s, d), T.nodes(s, d).select("id", "depth", F.col("title").alias("label")), edges(s, d))
    return named.select("id", F.array_join("why", "\n").alias("why"))


def suggestion_rows(s, d):
    works = T.nodes(s, d).where("depth > 0").select("id", F.col("title").alias("label"), F.col("keywords").alias("authors"), F.lit(None).cast("string").alias("doi"), F.col("id").alias("openalex_id"), F.lit(None).cast("string").alias("reference"))
    return ranking.export_records(suggested(s, d), T.nodes(s, d), edges(s, d), works)


@query("suggestion_export")
def suggestion_export(s, d):
    return ranking.export_lines(suggestion_rows(s, d))


@query(
    "suggestion_records",
    _SUGGEST
    + """SELECT rank, id AS openalex_id, p_name AS label, p_name AS title, p_brand || '|' || p_type AS authors, score, co_cited, core_size, (SELECT string_agg(source, '|' ORDER BY source) FROM edges e WHERE e.target = k.id) AS cited_by_vault, '' AS cites_vault
 FROM k JOIN part ON 'P' || p_partkey = id WHERE rank <= 1000""",
)
def suggestion_records(s, d):
    lists = [F.array_join(c, "|").alias(c) for c in ("authors", "cited_by_vault", "cites_vault")]
    return suggestion_rows(s, d).select("rank", "openalex_id", "label", "title", "score", "co_cited", "core_size", *lists)


@query("citing_works_rank", f"WITH c AS ({_CITING}), w AS (SELECT source AS id, count(*)::BIGINT AS cites FROM c GROUP BY 1), i AS (SELECT 'C' || o_custkey AS id, max(year(o_orderdate))::BIGINT AS year, count(*)::BIGINT AS cited_by_count FROM orders GROUP BY 1), s AS (SELECT *, floor((cites + ({BONUS})) * 100 + 0.5) / 100 AS score FROM w JOIN i USING (id)) SELECT row_number() OVER (ORDER BY score DESC, cites DESC, id)::BIGINT AS rank, id, cites, year, cited_by_count, score FROM s QUALIFY rank <= 200")
def citing_works_rank(s, d):
    works = citing_edges(s, d).groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("cites"))
    info = T.read(s, d, "orders").groupBy(F.concat(F.lit("C"), F.col("o_custkey")).alias("id")).agg(F.max(F.year("o_orderdate")).cast("long").alias("year"), F.count(F.lit(1)).alias("cited_by_count"))
    rows = ranking.ranked(ranking.rank_citing(works.join(info, "id"), THIS_YEAR), 200, "cites")
    return rows.select(F.col("rank").cast("long").alias("rank"), "id", "cites", "year", "cited_by_count", "score")


def _local(direction: str) -> str:
    step = {"out": "SELECT source, target FROM edges", "in": "SELECT target AS source, source AS target FROM edges", "both": "SELECT source, target FROM edges UNION ALL SELECT target, source FROM edges"}[direction]
    start = "P1" if direction == "in" else "S1"
    return f"WITH RECURSIVE {CITE}, e AS ({step}), r(id, distance) AS (SELECT '{start}', 0 UNION SELECT e.target, r.distance + 1 FROM r JOIN e ON e.source = r.id WHERE r.distance < 2) SELECT id, min(distance)::INTEGER AS distance FROM r GROUP BY id"


for _direction in ("out", "in", "both"):

    @query(f"local_graph_{_direction}", _local(_direction))
    def local_graph(s, d, direction=_direction):
        return graph.local_graph(edges(s, d), "P1" if direction == "in" else "S1", depth=2, direction=direction)


@query("induced_edges", f"WITH {CITE}, m AS (SELECT target AS id FROM edges GROUP BY 1 HAVING count(*) >= 4 UNION SELECT 'S' || s_suppkey FROM supplier) SELECT source, target FROM edges WHERE source IN (SELECT id FROM m) AND target IN (SELECT id FROM m)")
def induced_edges(s, d):
    own = graph.common_citers(edges(s, d), minimum=4).select("id").union(T.nodes(s, d).where("depth = 0").select("id"))
    return graph.induced(edges(s, d).select("source", "target"), own)


@query("status_counts", f"WITH {CITE} SELECT (SELECT count(*) FROM supplier)::BIGINT AS vault_works, (SELECT count(*) FROM part)::BIGINT AS outside_works, (SELECT count(*) FROM edges)::BIGINT AS citations")
def status_counts(s, d):
    return graph.status_counts(T.nodes(s, d), edges(s, d))


@query("timeline_cumulative", f"WITH {INFO} SELECT year, count(*)::BIGINT AS n, (sum(count(*)) OVER (ORDER BY year))::BIGINT AS shown FROM info WHERE year > 1000 AND year < 3000 GROUP BY year")
def timeline_cumulative(s, d):
    return graph.timeline(T.work_info(s, d).withColumn("year", F.col("year").cast("long")))


@query("timeline_filter", f"WITH {INFO} SELECT id, year FROM info WHERE year IS NULL OR year <= 2000")
def timeline_filter(s, d):
    from quillgraph.functions.predicates import out_of_time

    return T.work_info(s, d).select("id", F.col("year").cast("long").alias("year")).where(out_of_time(F.col("year"), 2000))


@query("year_scale", "WITH y AS (SELECT year(o_orderdate)::BIGINT AS year, count(*) AS n FROM orders GROUP BY 1) SELECT year, floor((((sum(n) OVER (ORDER BY year) - n) + n / 2::DOUBLE) / (sum(n) OVER ()) - 0.5::DOUBLE) * 800 * 1000000 + 0.5) / 1000000 AS x FROM y")
def year_scale(s, d):
    years = T.read(s, d, "orders").select(F.year("o_orderdate").cast("long").alias("year"))
    return graph.year_scale(years, 800.0).select("year", rounded(F.col("x")).alias("x"))


_WORKS = f"WITH {CITE}, {INFO}, w AS (SELECT 'S' || s_suppkey AS id, 0 AS depth, NULL::BIGINT AS year, (s_suppkey % 7)::BIGINT AS cited_by FROM supplier UNION ALL SELECT 'P' || p_partkey, 1, year, coalesce(n, 0) FROM part LEFT JOIN info ON id = 'P' || p_partkey LEFT JOIN (SELECT target, count(*)::BIGINT AS n FROM edges GROUP BY 1) ON target = 'P' || p_partkey) "


def all_works(s, d):
    vault = T.read(s, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("id"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("year"), (F.col("s_suppkey") % 7).alias("cited_by"))
    n = cited_counts(s, d)
    outside = T.nodes(s, d).where("depth = 1").select("id", "depth").join(T.work_info(s, d).select("id", "year"), "id", "left").join(n, "id", "left").select("id", "depth", F.col("year").cast("long").alias("year"), F.coalesce("n", F.lit(0)).alias("cited_by"))
    return vault.union(outside)


@query("appearance_order", _WORKS + "SELECT id, (row_number() OVER (ORDER BY depth, CASE WHEN depth = 0 THEN -cited_by END, CASE WHEN depth <> 0 THEN year END NULLS LAST, cited_by DESC, id) - 1)::INTEGER AS position FROM w")
def appearance_order(s, d):
    return graph.appearance_order(all_works(s, d))


@query("circle_places", "WITH k AS (SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_nationkey > 20 THEN NULL ELSE 1990 + s_nationkey END NULLS LAST, 'S' || s_suppkey) - 1 AS k, count(*) OVER () AS n FROM supplier) SELECT 'S' || s_suppkey AS id, floor(cos(-pi() / 2 + 2 * pi() * k / n) * 1000000 + 0.5) / 1000000 AS x, floor(sin(-pi() / 2 + 2 * pi() * k / n) * 1000000 + 0.5) / 1000000 AS y FROM k")
def circle_places(s, d):
    works = T.read(s, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("id"), F.when(F.col("s_nationkey") <= 20, 1990 + F.col("s_nationkey")).alias("year"))
    return graph.circle_places(works).select("id", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


@query("unresolved_tab", _WORKS + "SELECT id FROM w WHERE depth = 1 AND cited_by = 0")
def unresolved_tab(s, d):
    nodes = T.nodes(s, d).where("depth = 1")
    return nodes.join(edges(s, d).select(F.col("target").alias("id")), "id", "left_anti").select("id")


@query("reliable_outside", "SELECT doc_id FROM documents WHERE length(text) >= 200")
def reliable_outside(s, d):
    return T.read(s, d, "documents").where(F.length("text") >= 200).select("doc_id")
