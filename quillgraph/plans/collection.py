"""A collection of notes over the driver's tables: index, graph, and panel queries.

Each supplier k (from 0) of n is a note with a work, two citation links and three
references, to its neighbours k + 1, ... (mod n); every tenth is a draft outside the literature folder,
every third has a DOI. External works are suppliers of even number (their references are
the parts of their line items and one other supplier) and parts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import collection as C
from quillgraph.plans.base import joined, query
from quillgraph.sources import tables as T

WORDS = ("alpha", "gamma", "delta", "omega")


def _letters(k, digits=5):
    """A number of so many digits in letters; of longer ones, as in the SQL, the first."""
    return F.translate(F.lpad(k.cast("string"), digits, "0"), "0123456789", "abcdefghij")


def _title(k, digits=5):
    return F.concat(F.lit("Survey of xx"), _letters(k, digits), F.lit("xx and yy"), _letters(k, digits), F.lit("yy"))


def _author(k):
    return F.concat(F.lit("Auth"), F.char(97 + k % 26), F.lit("son"))


def _year(k):
    return (1950 + k % 60).cast("string")


def _entry(k):
    return F.concat(F.lit("- "), _author(k), F.lit(", A. ("), _year(k), F.lit("). "), _title(k), F.lit(". Journal, 1, 1-2."))


def vault(s, d):
    suppliers = T.spread(T.read(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k")), "k")
    n = suppliers.count()
    k = F.col("k")
    at = lambda off: (k + off + 1) % n
    doi = lambda j: F.concat(F.lit("10.1000/s"), j)
    see = F.concat(F.lit("See [x](<obsidian://cite?note=N"), at(0), F.lit("&q=some words>) and [y](obsidian://cite?doi="), doi(at(2)), F.lit(")."))
    outsider = F.concat(F.lit("- Outsider, B. (1999). "), F.element_at(F.array(*map(F.lit, WORDS)), (k % 4 + 1).cast("int")), F.lit(" unknown matters of old. Press, 1, 2-3."))
    text = F.concat_ws("\n", F.lit("Intro."), see, F.lit(""), F.lit("## References"), F.concat(_entry(at(3)), F.lit(" https://doi.org/"), doi(at(3))), _entry(at(6)), outsider)
    folder = F.when(k % 10 == 9, "Drafts/").otherwise("Literature/")
    has_doi = F.when(k % 3 == 0, F.create_map(F.lit("DOI"), F.concat(F.lit("https://doi.org/"), F.upper(doi(k))))).otherwise(F.create_map().cast("map<string,string>"))
    properties = F.map_concat(F.create_map(F.lit("Title"), _title(k), F.lit("authors"), F.concat(_author(k), F.lit(", A. B.")), F.lit("year"), _year(k)), has_doi)
    return suppliers.select(F.concat(folder, F.lit("N"), k, F.lit(".md")).alias("path"), F.concat(F.lit("N"), k).alias("basename"), text.alias("text"), properties.alias("properties"))


def external(s, d):
    suppliers = T.read(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    n = suppliers.count()
    k, p = F.col("k"), F.col("p_partkey")
    parts = T.read(s, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("k"), F.concat(F.lit("W"), F.col("l_partkey")).alias("ref"))
    refs = suppliers.select("k", F.concat(F.lit("WS"), (k + 5) % n).alias("ref")).union(parts).groupBy("k").agg(F.collect_set("ref").alias("references"))
    even = suppliers.where("k % 2 = 0").join(refs, "k").select(F.concat(F.lit("WS"), k).alias("id"), F.concat(F.lit("10.1000/s"), k).alias("doi"), _title(k).alias("title"), (1950 + k % 60).alias("year"), F.array(F.concat(F.lit("Anna "), _author(k))).alias("authors"), "references", k.alias("cited_by_count"))
    cites = F.array(F.concat(F.lit("WS"), p % n))
    part = T.read(s, d, "part").select(F.concat(F.lit("W"), p).alias("id"), F.lit(None).cast("string").alias("doi"), F.col("p_name").alias("title"), (1990 + F.col("p_size") % 30).cast("long").alias("year"), F.array(F.concat(F.lit("Bea de "), F.lit("Part"), F.char(97 + p % 26))).alias("authors"), cites.alias("references"), F.col("p_size").cast("long").alias("cited_by_count"))
    dois = suppliers.select(F.concat(F.lit("10.1000/s"), k).alias("doi"), F.when(k % 2 == 0, F.concat(F.lit("WS"), k)).alias("id"))
    missing = T.read(s, d, "part").where(p % 50 == 0).select(F.concat(F.lit("W"), p).alias("id"))
    return C.External(even.union(part), dois, missing)


def indexed(s, d):
    return C.index(vault(s, d))


# ---- the same in SQL: of each note k, whether it is literature (l), has a DOI (o), is an external work as well (v)

_NOTES = """n AS (SELECT count(*)::BIGINT AS n FROM supplier),
t AS (SELECT s_suppkey::BIGINT AS k, translate(lpad(s_suppkey::VARCHAR, 5, '0'), '0123456789', 'abcdefghij') AS x FROM supplier),
note AS (SELECT k, k % 10 <> 9 AS l, k % 3 = 0 AS o, k % 6 = 0 AND k % 10 <> 9 AS v, CASE WHEN k % 10 = 9 THEN 'Drafts/N' ELSE 'Literature/N' END || k || '.md' AS path,
  'Survey of xx' || x || 'xx and yy' || x || 'yy' AS title, 'Auth' || chr((97 + k % 26)::INT) || 'son' AS author, (1950 + k % 60) AS year, '10.1000/s' || k AS doi,
  'Auth' || chr((97 + k % 26)::INT) || 'son, ' || (1950 + k % 60) AS label,
  'auth' || chr((97 + k % 26)::INT) || 'son|' || (1950 + k % 60) || '|survey xx' || x || 'xx yy' || x || 'yy' AS key FROM t),
near AS (SELECT a.k, a.path, a.l, a.o, a.v, off, b.k AS jk, b.path AS jpath, b.l AS jl, b.o AS jo, b.v AS jv, b.doi AS jdoi, b.key AS jkey, b.label AS jlabel, b.title AS jtitle, b.author AS jauthor, b.year AS jyear
  FROM note a CROSS JOIN n CROSS JOIN (SELECT unnest([0, 2, 3, 4, 6]) AS off) JOIN note b ON b.k = (a.k + off + 1) % n.n)"""
_INSIDE = """inside AS (SELECT path AS source, jpath AS target, 'link' AS kind, l AND jl AS lit FROM near WHERE off = 0 OR off = 2 AND jo
  UNION ALL SELECT path, jpath, 'bibliography', l AND jl FROM near WHERE l AND (off IN (3, 6) AND jl OR off = 3 AND jo)
  UNION ALL SELECT path, jpath, 'openalex', true FROM near WHERE off = 4 AND v AND jv)"""
_OUTSIDE = """found AS (SELECT path AS source, 'WS' || jk AS target, 'openalex' AS kind, 1 AS rank FROM near WHERE off = 4 AND v AND NOT jv
  UNION ALL SELECT DISTINCT path, 'W' || l_partkey, 'openalex', 1 FROM note JOIN lineitem ON l_suppkey = k WHERE v
  UNION ALL SELECT path, CASE WHEN jk % 2 = 0 THEN 'WS' || jk ELSE 'doi:' || jdoi END, 'link', 2 FROM near WHERE l AND off = 2 AND NOT jo
  UNION ALL SELECT path, 'WS' || jk, 'bibliography', 3 FROM near WHERE l AND off = 3 AND NOT jl AND NOT jo AND jk % 2 = 0),
local AS (SELECT path AS source, CASE WHEN jk % 2 = 0 AND off = 6 AND 'WS' || jk IN (SELECT target FROM found) THEN 'WS' || jk ELSE 'ref:' || jkey END AS target, 'bibliography' AS kind, 3 AS rank
    FROM near WHERE l AND NOT jl AND (off = 6 OR off = 3 AND NOT jo AND jk % 2 = 1)
  UNION ALL SELECT path, 'ref:outsider|1999|' || CASE k % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'gamma' WHEN 2 THEN 'delta' ELSE 'omega' END || ' unknown matters', 'bibliography', 3 FROM note WHERE l),
cites AS (SELECT source, target, arg_min(kind, rank) AS kind FROM (SELECT * FROM found UNION ALL SELECT * FROM local) GROUP BY ALL),
counts AS (SELECT target AS id, count(*)::BIGINT AS n FROM cites GROUP BY 1),
kept AS (SELECT id, n FROM counts WHERE n >= 2 ORDER BY n DESC, id LIMIT 50),
miss AS (SELECT 'W' || p_partkey AS id FROM part WHERE p_partkey % 50 = 0),
outer_nodes AS (SELECT id FROM kept WHERE id NOT IN (SELECT id FROM miss)),
nodes AS (SELECT path AS id, 0 AS depth FROM note WHERE l UNION ALL SELECT id, 1 FROM outer_nodes),
edges AS (SELECT source, target, array_to_string(list_sort(list(DISTINCT kind)), '|') AS kinds FROM (SELECT source, target, kind FROM inside WHERE lit UNION ALL SELECT source, target, kind FROM cites)
  WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes) GROUP BY ALL)"""


@query("note_works", f"WITH {_NOTES} SELECT path, l AS literature, CASE WHEN o THEN doi END AS doi, 'auth' || chr((97 + k % 26)::INT) || 'son' AS authors, year::VARCHAR AS year, title, label FROM note")
def note_works(s, d):
    return C.own_works(vault(s, d), C.Settings()).select("path", "literature", "doi", joined("authors").alias("authors"), "year", "title", "label")


@query("graph_depth0", f"WITH {_NOTES}, {_INSIDE} SELECT source, target, array_to_string(list_sort(list(DISTINCT kind)), '|') AS kinds FROM inside WHERE lit GROUP BY ALL")
def graph_depth0(s, d):
    return C.build(indexed(s, d), external(s, d), C.Options(depth=0))[1].select("source", "target", joined("kinds").alias("kinds"))


def _depth1(s, d):
    v = vault(s, d)
    return C.build(C.index(v), external(s, d), C.Options(max_nodes=v.where("path like 'Literature/%'").count() + 50))


@query("graph_depth1_edges", f"WITH {_NOTES}, {_INSIDE}, {_OUTSIDE} SELECT source, target, kinds FROM edges")
def graph_depth1_edges(s, d):
    return _depth1(s, d)[1].select("source", "target", joined("kinds").alias("kinds"))


@query(
    "graph_depth1_nodes",
    f"""WITH {_NOTES}, {_INSIDE}, {_OUTSIDE}, named AS (
  SELECT path AS id, 0 AS depth, label, title FROM note WHERE l
  UNION ALL SELECT id, 1, CASE WHEN starts_with(id, 'ref:outsider') THEN 'Outsider, 1999' WHEN starts_with(id, 'ref:') THEN r.label WHEN starts_with(id, 'doi:') THEN id[5:] WHEN starts_with(id, 'WS') THEN CASE WHEN w.k % 2 = 0 THEN w.label ELSE 'Unknown work' END
    ELSE 'de Part' || chr((97 + p_partkey % 26)::INT) || ', ' || (1990 + p_size % 30) END,
    CASE WHEN starts_with(id, 'ref:outsider') THEN split_part(id, '|', 3) || ' of old' WHEN starts_with(id, 'ref:') THEN r.title WHEN starts_with(id, 'WS') AND w.k % 2 = 0 THEN w.title WHEN p_partkey IS NOT NULL THEN p_name ELSE '' END
  FROM outer_nodes LEFT JOIN note w ON id = 'WS' || w.k LEFT JOIN note r ON id = 'ref:' || r.key LEFT JOIN part ON id = 'W' || p_partkey)
SELECT id, depth, label, title, (SELECT count(*) FROM edges WHERE target = id)::BIGINT AS cited_by FROM named""",
)
def graph_depth1_nodes(s, d):
    return _depth1(s, d)[0].select("id", "depth", "label", "title", "cited_by")


@query("graph_left_out", f"WITH {_NOTES}, {_INSIDE}, {_OUTSIDE} SELECT count(*)::BIGINT AS eligible, least(count(*), 50)::BIGINT AS kept, greatest(count(*) - 50, 0)::BIGINT AS left_out FROM counts WHERE n >= 2")
def graph_left_out(s, d):
    return _depth1(s, d)[2]


@query("graph_all_notes", f"WITH {_NOTES}, {_INSIDE} SELECT source, target, array_to_string(list_sort(list(DISTINCT kind)), '|') AS kinds FROM inside GROUP BY ALL")
def graph_all_notes(s, d):
    return C.build(indexed(s, d), external(s, d), C.Options(depth=0, all_notes=True))[1].select("source", "target", joined("kinds").alias("kinds"))


@query("graph_without_links", f"WITH {_NOTES}, {_INSIDE} SELECT source, target, array_to_string(list_sort(list(DISTINCT kind)), '|') AS kinds FROM inside WHERE lit AND kind <> 'link' GROUP BY ALL")
def graph_without_links(s, d):
    return C.build(indexed(s, d), external(s, d), C.Options(depth=0, off=frozenset({"link"})))[1].select("source", "target", joined("kinds").alias("kinds"))


_CITED_BY = f"""WITH {_NOTES}, {_INSIDE}, pairs AS (SELECT DISTINCT note.path AS target, 'W' || p_partkey AS source FROM part CROSS JOIN n JOIN note ON note.k = p_partkey % n.n WHERE v AND p_partkey % 50 <> 0),
own AS (SELECT path AS source, jpath AS target, 'openalex' AS kind FROM near WHERE off = 4 AND v AND jv), counts AS (SELECT source AS id, count(*)::BIGINT AS n FROM pairs GROUP BY 1),
kept AS (SELECT id FROM counts WHERE n >= 1 ORDER BY n DESC, id LIMIT 40)"""


@query("graph_cited_by", _CITED_BY + " SELECT source, target, array_to_string(list_sort(list(DISTINCT kind)), '|') AS kinds FROM (SELECT source, target, kind FROM inside WHERE lit UNION ALL SELECT * FROM own UNION ALL SELECT source, target, 'openalex' FROM pairs WHERE source IN (SELECT id FROM kept)) GROUP BY ALL")
def graph_cited_by(s, d):
    v, ext = vault(s, d), external(s, d)
    citing = ext.works.select(F.col("id").alias("citing"), F.explode("references").alias("id"))
    options = C.Options(min_citations=1, max_nodes=v.where("path like 'Literature/%'").count() + 40)
    return C.build_cited_by(C.index(v), ext, citing, options)[1].select("source", "target", joined("kinds").alias("kinds"))


@query(
    "panel_cites",
    f"""WITH {_NOTES} SELECT path, 'note' AS kind, jpath AS key, jlabel AS label, 1::BIGINT AS links, 'some words' AS passages FROM near WHERE off = 0
UNION ALL SELECT path, CASE WHEN jo THEN 'note' ELSE 'doi' END, CASE WHEN jo THEN jpath ELSE jdoi END, CASE WHEN jo THEN jlabel ELSE 'y' END, 1, '' FROM near WHERE off = 2""",
)
def panel_cites(s, d):
    return C.cited_works(indexed(s, d)).select("path", "kind", "key", "label", "links", joined("passages").alias("passages"))


@query(
    "panel_cited_by",
    f"WITH {_NOTES} SELECT jpath AS path, path AS citing, CASE WHEN off IN (0, 2) THEN 'link' ELSE 'bibliography' END AS via, CASE WHEN off IN (0, 2) THEN '2' WHEN off = 3 THEN '5' ELSE '6' END AS lines FROM near WHERE off = 0 OR off = 2 AND jo OR l AND (off IN (3, 6) AND jl OR off = 3 AND jo)",
)
def panel_cited_by(s, d):
    return C.citing_notes(indexed(s, d)).select("path", "citing", "via", joined(F.transform("lines", lambda x: x.cast("string"))).alias("lines"))


@query(
    "panel_references",
    f"""WITH {_NOTES} SELECT path, CASE off WHEN 3 THEN 4 ELSE 5 END AS line, CASE WHEN jl OR off = 3 AND jo THEN 'note' WHEN off = 3 THEN 'doi' ELSE 'entry' END AS kind, CASE WHEN jl OR off = 3 AND jo THEN jpath WHEN off = 3 THEN jdoi END AS target, jlabel AS label FROM near WHERE l AND off IN (3, 6)
UNION ALL SELECT path, 6, 'entry', NULL, 'Outsider, 1999' FROM note WHERE l""",
)
def panel_references(s, d):
    return C.own_references(indexed(s, d)).select("path", "line", "kind", "target", "label")


@query("panel_linked", f"WITH {_NOTES} SELECT path, 3::BIGINT AS entries, sum((jl OR off = 3 AND jo)::INT)::BIGINT AS linked FROM near WHERE l AND off IN (3, 6) GROUP BY path")
def panel_linked(s, d):
    return C.linked_counts(indexed(s, d))


_REFS = "refs AS (SELECT path, 'WS' || jk AS id, jk % 2 = 0 AS known, jpath, jo, jk, jlabel FROM near WHERE off = 4 AND v UNION ALL SELECT DISTINCT path, 'W' || l_partkey, l_partkey % 50 <> 0, NULL, false, NULL::BIGINT, NULL FROM note JOIN lineitem ON l_suppkey = k WHERE v)"


@query("panel_external", f"WITH {_NOTES}, {_REFS} SELECT path, count(*)::BIGINT AS total, sum(known::INT)::BIGINT AS loaded, sum((NOT known)::INT)::BIGINT AS missing FROM refs GROUP BY path")
def panel_external(s, d):
    return C.external_references(indexed(s, d), external(s, d))


@query(
    "panel_related_references",
    f"""WITH {_NOTES}, {_REFS}, r AS (SELECT path, 'note' AS kind, jpath AS key, jlabel AS label, 0 AS rank FROM near WHERE off = 0 OR off = 2 AND jo
  UNION ALL SELECT path, CASE WHEN jo THEN 'note' ELSE 'doi' END, CASE WHEN jo THEN jpath WHEN jk IS NOT NULL THEN '10.1000/s' || jk ELSE id END, coalesce(jlabel, 'de Part' || chr((97 + p_partkey % 26)::INT) || ', ' || (1990 + p_size % 30)), 1 FROM refs LEFT JOIN part ON id = 'W' || p_partkey WHERE known),
m AS (SELECT path, key, arg_min(kind, rank) AS kind, arg_min(label, rank) AS label FROM r GROUP BY ALL), c AS (SELECT path, count(*) AS external FROM refs GROUP BY 1)
SELECT m.path, kind, key, label, greatest(count(*) OVER (PARTITION BY m.path), coalesce(external, 0))::BIGINT AS total FROM m LEFT JOIN c ON c.path = m.path""",
)
def panel_related_references(s, d):
    return C.related(indexed(s, d), external(s, d), "references")


@query(
    "panel_related_citing",
    f"""WITH {_NOTES}, e AS (SELECT path, 'W' || p_partkey AS id, p_size AS n, 'de Part' || chr((97 + p_partkey % 26)::INT) || ', ' || (1990 + p_size % 30) AS label, p_partkey % 50 <> 0 AS known, NULL AS jpath, NULL AS doi FROM part CROSS JOIN n JOIN note ON k = p_partkey % n.n WHERE v
  UNION ALL SELECT jpath, 'WS' || k, k, a.label, true, CASE WHEN near.o THEN near.path END, '10.1000/s' || k FROM near JOIN note a USING (k) WHERE off = 4 AND jv AND k % 2 = 0),
x AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, id) <= 5), r AS (SELECT jpath AS path, 'note' AS kind, near.path AS key, a.label, 0 AS rank FROM near JOIN note a USING (k) WHERE off = 0 OR off = 2 AND jo
  UNION ALL SELECT path, CASE WHEN jpath IS NOT NULL THEN 'note' ELSE 'doi' END, coalesce(jpath, doi, id), label, 1 FROM x WHERE known),
m AS (SELECT path, key, arg_min(kind, rank) AS kind, arg_min(label, rank) AS label FROM r GROUP BY ALL), c AS (SELECT path, count(*) AS external FROM e GROUP BY 1)
SELECT m.path, kind, key, label, greatest(count(*) OVER (PARTITION BY m.path), coalesce(external, 0))::BIGINT AS total FROM m LEFT JOIN c ON c.path = m.path""",
)
def panel_related_citing(s, d):
    return C.related(indexed(s, d), external(s, d), "citing", 5)


@query("panel_duplicates", "SELECT 'Literature/B' || p_partkey || '.md' AS path, 'doi' AS reason, 'Literature/A' || p_partkey || '.md' AS others FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'Literature/A' || p_partkey || '.md', 'doi', 'Literature/B' || p_partkey || '.md' FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'Literature/B' || p_partkey || '.md', 'title', 'Literature/A' || p_partkey || '.md' FROM part WHERE p_partkey % 4 = 1 UNION ALL SELECT 'Literature/A' || p_partkey || '.md', 'title', 'Literature/B' || p_partkey || '.md' FROM part WHERE p_partkey % 4 = 1")
def panel_duplicates(s, d):
    """Parts as pairs of notes: some share a DOI, some author, year and title, some differ in the title. Titles
    hold all digits of the part's key, so no two parts have the same."""
    p = T.read(s, d, "part").select(F.col("p_partkey").cast("long").alias("k")).withColumn("side", F.explode(F.array(F.lit("A"), F.lit("B"))))
    k = F.col("k")
    title = F.when((k % 4 == 2) & (F.col("side") == "B"), F.concat(F.lit("Something wholly different zz"), _letters(k, 19), F.lit("zz"))).otherwise(_title(k, 19))
    doi = F.when(k % 4 == 0, F.concat(F.lit("10.1000/P"), k)).when(k % 4 == 3, F.concat(F.lit("10.1000/"), "side", k))
    rows = p.select(F.concat(F.lit("Literature/"), "side", k, F.lit(".md")).alias("path"), F.concat("side", k).alias("basename"), F.lit("Text.").alias("text"), F.map_filter(F.create_map(F.lit("title"), title, F.lit("authors"), _author(k), F.lit("year"), _year(k), F.lit("doi"), doi), lambda _, v: v.isNotNull()).alias("properties"))
    return C.duplicate_warnings(C.index(rows)).select("path", "reason", joined("others").alias("others"))


@query("links_naming", f"WITH {_NOTES} SELECT path, 'N' || jk AS note FROM near WHERE off = 0 AND jk = 3")
def links_naming(s, d):
    return C.links_naming(indexed(s, d).links, "Literature/N3.md").select("path", "note")


@query("cited_works_union", f"WITH {_NOTES}, {_INSIDE}, {_REFS} SELECT DISTINCT source AS path, target AS cited FROM inside UNION SELECT path, id FROM refs WHERE jk IS NULL OR NOT (jo AND jk % 2 = 0 AND jk % 10 <> 9)")
def cited_works_union(s, d):
    return C.works_cited_by(indexed(s, d), external(s, d))


@query("cited_by_collection", f"WITH {_NOTES}, {_REFS} SELECT DISTINCT id FROM refs WHERE jk IS NULL OR jk % 2 = 0 AND NOT (jo AND jk % 10 <> 9)")
def cited_by_collection(s, d):
    return C.cited_by_collection(indexed(s, d), external(s, d))


@query("meaning_context", f"WITH {_NOTES}, {_INSIDE}, {_OUTSIDE} SELECT target AS id, array_to_string(list_sort(list(DISTINCT source)), '|') AS context FROM edges WHERE target IN (SELECT id FROM outer_nodes) GROUP BY 1")
def meaning_context(s, d):
    nodes, edges, _ = _depth1(s, d)
    return C.neighbours_in_collection(edges, nodes).select("id", joined("context").alias("context"))


@query("note_signatures", "SELECT count(*)::BIGINT AS notes, count(*)::BIGINT AS same, (SELECT count(*) FROM supplier WHERE s_suppkey % 5 = 0)::BIGINT AS changed FROM supplier")
def note_signatures(s, d):
    """An edit of prose leaves signatures alone; one of a link changes its note's."""
    v = vault(s, d)
    prose = v.withColumn("text", F.regexp_replace("text", "^Intro\\.", "Another beginning, and more of it."))
    link = v.withColumn("text", F.when(F.regexp_extract("basename", "[0-9]+", 0).cast("int") % 5 == 0, F.replace("text", F.lit("some words"), F.lit("other words"))).otherwise(F.col("text")))
    a, b, c = (C.signatures(C.index(x)).withColumnRenamed("signature", n) for x, n in ((v, "a"), (prose, "b"), (link, "c")))
    both = a.join(b, "path").join(c, "path")
    return both.agg(F.count(F.lit(1)).alias("notes"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("same"), F.count(F.when(F.col("a") != F.col("c"), 1)).alias("changed"))
