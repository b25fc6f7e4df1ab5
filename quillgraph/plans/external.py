"""Queries of the external stores, labels and template values over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.functions import works as W
from quillgraph.lineage import own_dir
from quillgraph.operators import graph, ranking
from quillgraph.plans.base import BONUS, INFO, joined, query, rounded
from quillgraph.sources import external as E
from quillgraph.sources import service as V
from quillgraph.sources import tables as T
from quillgraph.sources.snapshot import RAW, summarize


def parts(s, d):
    return T.spread(T.read(s, d, "part"), "p_partkey").withColumn("k", F.col("p_partkey").cast("long"))


#: Full names and what their surname, and their form in a reference, should be.
NAMES = (
    ("Paul J. van den Berg", "van den Berg", "van den Berg, P. J."), ("Maria De la Cruz", "De la Cruz", "De la Cruz, M."), ("Plato", "Plato", "Plato"),
    ("Ana-Lúcia Moreira da Silva", "da Silva", "da Silva, A.-L. M."), ("van Dyke", "Dyke", "Dyke, V."), ("Jörg Müller", "Müller", "Müller, J."), ("  Ida   Noddack ", "Noddack", "Noddack, I."),
)
_NAME_CASE = "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{{{i}}}'" for i in range(7)) + " END"


def _case(place: int) -> str:
    return _NAME_CASE.format(*(n[place] for n in NAMES))


def _name(k):
    return F.element_at(F.array(*(F.lit(n[0]) for n in NAMES)), (k % 7 + 1).cast("int"))


@query("surnames", f"SELECT p_partkey AS id, {_case(1)} AS surname, {_case(2)} AS reference FROM part")
def surnames(s, d):
    return parts(s, d).select(F.col("p_partkey").alias("id"), W.surname(_name(F.col("k"))).alias("surname"), W.with_initials(_name(F.col("k"))).alias("reference"))


_TWO = f"{_case(1)}"
_NEXT = _TWO.replace("p_partkey % 7", "(p_partkey + 1) % 7")


@query("work_labels", f"SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name[:40] WHEN 1 THEN {_TWO} WHEN 2 THEN {_TWO} || ' & ' || {_NEXT} ELSE {_TWO} || ' et al.' END || ', ' || CASE WHEN p_size > 5 THEN (1950 + p_size)::VARCHAR ELSE 'n.d.' END AS en, CASE p_partkey % 4 WHEN 0 THEN p_name[:40] WHEN 1 THEN {_TWO} WHEN 2 THEN {_TWO} || ' et ' || {_NEXT} ELSE {_TWO} || ' et al.' END || ', ' || CASE WHEN p_size > 5 THEN (1950 + p_size)::VARCHAR ELSE 's.d.' END AS fr FROM part")
def work_labels(s, d):
    k = F.col("k")
    authors = F.slice(F.array(_name(k), _name(k + 1), _name(k + 2)), F.lit(1), (k % 4).cast("int"))
    year = F.when(F.col("p_size") > 5, 1950 + F.col("p_size"))
    return parts(s, d).select(F.col("p_partkey").alias("id"), *(W.work_label(authors, year, F.col("p_name"), lang).alias(lang) for lang in ("en", "fr")))


@query("note_labels", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_brand || ' & Co, ' || p_size WHEN 1 THEN 'Doe, ' || p_size WHEN 2 THEN 'Doe & WHO, n.d.' ELSE 'N' || p_partkey END AS label FROM part")
def note_labels(s, d):
    k = F.col("k") % 4
    stored = F.when(k == 0, F.concat(F.lit(" ("), "p_brand", F.lit(" et Co, "), "p_size", F.lit(") ")))
    authors = F.when(k == 1, "Doe, J.-P., A").when(k == 2, "Doe, J.; WHO")
    return parts(s, d).select(F.col("p_partkey").alias("id"), W.citation_text(stored, authors, F.when(k == 1, F.col("p_size").cast("string")), F.concat(F.lit("N"), "p_partkey")).alias("label"))


@query("own_dois", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '10.1000/p' || p_partkey WHEN 1 THEN '10.1000/t' || p_partkey WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE '10.1000/a' || p_partkey END AS doi FROM part")
def own_dois(s, d):
    """By property; in the text; only below a reference heading; too far down; two of them."""
    k, url = F.col("k") % 5, lambda c: F.concat(F.lit(f"https://doi.org/10.1000/{c}"), "p_partkey")
    text = F.when(k == 1, F.concat(F.lit("# Title\nSee <"), url("T"), F.lit(".>, ok"))).when(k == 2, F.concat(F.lit("Intro\n## References\n- "), url("R"))).when(k == 3, F.concat(F.repeat(F.lit("far "), 1250), url("F"))).when(k == 4, F.concat(url("a"), F.lit(" and "), url("b"))).otherwise(url("X"))
    return parts(s, d).select(F.col("p_partkey").alias("id"), W.own_doi(F.when(k == 0, F.concat(F.lit("DOI: 10.1000/P"), "p_partkey")), text).alias("doi"))


@query("entry_labels", "SELECT p_partkey AS id, 'Roe' || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' & O’Neil' ELSE ' et al.' END || ', ' || (1950 + p_size) AS label FROM part")
def entry_labels(s, d):
    k = F.col("k") % 3
    y = (1950 + F.col("p_size")).cast("string")
    text = F.concat(F.lit("Roe, A."), F.when(k == 1, " & O’Neil, B.").when(k == 2, ", O’Neil, B., Poe, C.").otherwise(""), F.lit(" ("), y, F.lit("). "), "p_name")
    authors = F.slice(F.array(F.lit("roe"), F.lit("oneil"), F.lit("poe")), F.lit(1), (k + 1).cast("int"))
    return parts(s, d).select(F.col("p_partkey").alias("id"), W.entry_label(F.lit("Roe"), authors, F.lit(False), y, text).alias("label"))


_VALUES = """SELECT p_partkey AS id, '(' || CASE WHEN p_size > 5 THEN 'Müller & Plato, ' || (1950 + p_size) ELSE 'Müller & Plato, n.d.' END || ')' AS citation_text,
 'Müller, J., & Plato (' || CASE WHEN p_size > 5 THEN (1950 + p_size)::VARCHAR ELSE 'n.d.' END || '). ' || CASE WHEN p_partkey % 2 = 0 THEN '_' || p_name || '_. Press.' ELSE p_name || '. _' || p_brand || '_, _' || p_size || '_(2), ' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '–' || (p_size + 9) END || '.' END || CASE WHEN p_partkey % 5 = 0 THEN ' https://doi.org/10.1/' || p_partkey ELSE ' https://x.org/' || p_partkey END AS citation,
 CASE WHEN p_partkey % 2 = 0 THEN 'Book' ELSE 'Article' END AS type, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END AS journal, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'https://x.org/' || p_partkey END AS url FROM part"""


@query("template_values", _VALUES)
def template_values(s, d):
    k = F.col("k")
    rows = parts(s, d).select(
        "p_partkey", F.when(k % 5 == 0, F.concat(F.lit("10.1/"), k)).alias("doi"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 5, 1950 + F.col("p_size")).alias("year"), F.array(F.lit("Jörg Müller"), F.lit("Plato")).alias("authors"),
        F.when(k % 2 == 0, "book").otherwise("review").alias("type"), F.col("p_brand").alias("journal"), F.col("p_size").cast("string").alias("volume"), F.lit("2").alias("issue"), F.col("p_size").cast("string").alias("first_page"),
        F.when(k % 3 == 0, F.col("p_size")).otherwise(F.col("p_size") + 9).cast("string").alias("last_page"), F.lit("Press").alias("publisher"), F.lit(None).cast("string").alias("issn"), F.lit("en").alias("language"), F.lit(None).cast("string").alias("pdf_url"),
        F.concat(F.lit("https://x.org/"), k).alias("open_access_url"), F.lit(None).cast("string").alias("abstract"),
    )
    v = W.values_of_details()
    return rows.select(F.col("p_partkey").alias("id"), v["citationText"].alias("citation_text"), v["citation"].alias("citation"), v["type"].alias("type"), v["journal"].alias("journal"), v["url"].alias("url"))


@query("work_texts", "SELECT p_partkey AS id, p_name || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || p_brand || ' ' || p_type ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || 'Abstract.' ELSE '' END AS text, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE p_brand END AS keyword FROM part")
def work_texts(s, d):
    k = F.col("k")
    text = W.outside_text(F.col("p_name"), F.when(k % 2 == 0, F.array("p_brand", "p_type")), F.array().cast("array<string>"), F.when(k % 3 == 0, "Abstract."), F.lit(""))
    own = W.listed(F.when(k % 4 == 0, F.concat(F.lit(" , "), "p_type", F.lit(" ,"))))
    return parts(s, d).select(F.col("p_partkey").alias("id"), text.alias("text"), W.work_keywords(own, F.array("p_brand"))[0].alias("keyword"))


@query("vector_bytes", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), b AS (SELECT vec_id, list_transform(e, lambda x: greatest(-127, least(127, floor(x * 127 + 0.5)))) AS b FROM v) SELECT vec_id, floor(b[1] / sqrt(list_dot_product(b, b)) * 1000000 + 0.5) / 1000000 AS first, len(b)::INTEGER AS n FROM b")
def vector_bytes(s, d):
    v = W.unpacked(W.packed(F.transform("embedding", lambda x: x.cast("double"))))
    return T.read(s, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", rounded(F.col("v")[0]).alias("first"), F.size("v").alias("n"))


@query("node_limits", "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 3000.0 WHEN 1 THEN NULL WHEN 2 THEN 100.0 WHEN 3 THEN 2500.0 ELSE 3000.0 END::DOUBLE AS n FROM nation")
def node_limits(s, d):
    raw = F.element_at(F.array(*map(F.lit, ("many", "0", "7", "2500", "NaN"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return T.read(s, d, "nation").select("n_nationkey", W.max_nodes(raw).alias("n"))


@query("graph_text_filter", "SELECT p_partkey AS id FROM part WHERE contains(lower(p_brand || ' ' || p_name), '#1')")
def graph_text_filter(s, d):
    return parts(s, d).where(W.graph_filter(" #1 ", F.col("p_brand"), F.col("p_name"))).select(F.col("p_partkey").alias("id"))


# ---- stores


@query("works_in_order", "SELECT p_partkey * 10 + i AS pos, 'W' || p_partkey AS id, p_name AS title FROM part CROSS JOIN (SELECT unnest([0, 1]) AS i) WHERE p_partkey % 3 <> 0 AND p_partkey % 7 <> 0")
def works_in_order(s, d):
    p = parts(s, d)
    asked = p.select("k", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select((F.col("k") * 10 + F.col("i")).alias("pos"), F.concat(F.lit("W"), "k").alias("id"))
    works = p.where("k % 3 <> 0").select(F.concat(F.lit("W"), "k").alias("id"), F.col("p_name").alias("title"))
    return E.works_by_ids(asked, works, p.where("k % 7 = 0").select(F.concat(F.lit("W"), "k").alias("id"))).select("pos", "id", "title")


def _known(s, d):
    return parts(s, d).where("k % 3 <> 0").select(F.concat(F.lit("10.1/"), "k").alias("value"), F.when(F.col("k") % 3 == 1, F.concat(F.lit("W"), "k")).alias("id"))


@query("request_batches", "SELECT batch, count(*)::BIGINT AS n, min(v) AS first FROM (SELECT '10.1/' || p_partkey AS v, (row_number() OVER (ORDER BY '10.1/' || p_partkey) - 1) // 50 AS batch FROM part WHERE p_partkey % 3 = 0) GROUP BY batch")
def request_batches(s, d):
    twice = parts(s, d).select(F.concat(F.lit("10.1/"), "k").alias("value")).crossJoin(s.range(2).drop("id"))
    return E.to_ask(twice, _known(s, d)).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first"))


@query("doi_states", "SELECT '10.1/' || p_partkey AS doi, CASE WHEN p_partkey % 3 = 1 THEN 'W' || p_partkey WHEN p_partkey % 12 = 0 THEN 'N' || p_partkey END AS id, CASE p_partkey % 3 WHEN 1 THEN 'found' WHEN 2 THEN 'unknown' ELSE CASE WHEN p_partkey % 12 = 0 THEN 'found' WHEN p_partkey % 6 = 0 THEN 'unknown' ELSE 'new' END END AS state FROM part")
def doi_states(s, d):
    """After a request for every sixth DOI, of which every second is found."""
    p = parts(s, d)
    asked = p.where("k % 6 = 0").select(F.concat(F.lit("10.1/"), "k").alias("value"))
    found = p.where("k % 12 = 0").select(F.concat(F.lit("10.1/"), "k").alias("value"), F.concat(F.lit("N"), "k").alias("id"))
    return E.doi_state(p.select(F.concat(F.lit("https://doi.org/10.1/"), "k").alias("doi")), E.remember(_known(s, d), asked, found))


@query("citing_listings", "WITH r AS (SELECT l_suppkey AS k, l_partkey AS p, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) - 1 AS i FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) WHERE l_suppkey % 2 = 0) SELECT 'S' || s_suppkey AS id, CASE WHEN s_suppkey % 4 = 1 THEN 'old' ELSE array_to_string(list('P' || p ORDER BY i), '|') END AS ids FROM supplier LEFT JOIN r ON k = s_suppkey WHERE s_suppkey % 4 <> 3 GROUP BY s_suppkey")
def citing_listings(s, d):
    from pyspark.sql import Window

    pairs = T.read(s, d, "lineitem").where("l_suppkey % 2 = 0").select("l_suppkey", "l_partkey").distinct()
    placed = pairs.withColumn("i", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_partkey")) - 1).withColumn("page", F.floor(F.col("i") / E.PAGE))
    pages = placed.groupBy("l_suppkey", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.concat(F.lit("P"), "l_partkey").alias("p")))), lambda x: x["p"]).alias("results")).select(F.concat(F.lit("S"), "l_suppkey").alias("id"), F.lit(1).cast("long").alias("at"), "page", "results")
    supplier = T.read(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("S"), "s_suppkey").alias("id"))
    lists = supplier.where("k % 4 = 1").select("id", F.lit(0).cast("long").alias("at"), F.array(F.lit("old")).alias("ids"))
    return E.citing_lists(lists, supplier.where("k % 4 <> 3").select("id"), pages).select("id", joined("ids").alias("ids"))


@query("trimmed_references", "WITH r AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS k FROM lineitem) SELECT 'P' || p AS id, coalesce(array_to_string(list_sort(list('S' || k) FILTER (p % 9 = 0 OR k % 2 = 0)), '|'), '') AS refs, p % 9 <> 0 AS trimmed FROM r GROUP BY p")
def trimmed_references(s, d):
    works = T.read(s, d, "lineitem").groupBy("l_partkey").agg(F.sort_array(F.collect_set(F.concat(F.lit("S"), "l_suppkey"))).alias("references")).select(F.concat(F.lit("P"), "l_partkey").alias("id"), "references")
    own = T.read(s, d, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), "s_suppkey").alias("id")).union(parts(s, d).where("k % 9 = 0").select(F.concat(F.lit("P"), "k")))
    return E.kept_references(works, own).select("id", joined("references").alias("refs"), "trimmed")


@query("completed_extras", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'own' WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 5 = 0 THEN '' END AS topics, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 15 IN (5, 10) THEN '' END AS abstract FROM part")
def completed_extras(s, d):
    p = parts(s, d).withColumn("id", F.col("p_partkey"))
    none = F.lit(None).cast("array<string>")
    works = p.select("id", F.when(F.col("k") % 2 == 0, F.array(F.lit("own"))).otherwise(none).alias("topics"), none.alias("keywords"), F.lit(None).cast("string").alias("abstract"))
    answers = p.where("k % 3 = 0").select("id", F.array("p_type").alias("topics"), none.alias("keywords"), F.col("p_name").alias("abstract"))
    return E.complete(works, p.where("k % 3 = 0 or k % 5 = 0").select("id"), answers).select("id", joined("topics").alias("topics"), "abstract")


@query("topic_upserts", "SELECT p_type AS topic, arg_max(p_name, p_partkey) AS name FROM part GROUP BY p_type")
def topic_upserts(s, d):
    rows = parts(s, d).select(F.col("p_type").alias("topic"), F.col("p_name").alias("name"), F.col("k").alias("seq"))
    return E.keep_topics(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")).select("topic", "name")


@query("ghost_notes", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'by id' WHEN 1 THEN 'by doi' WHEN 2 THEN 'by entry' END AS ghost FROM part")
def ghost_notes(s, d):
    k = F.col("k")
    works = parts(s, d).select(F.col("p_partkey").alias("part"), F.when(k % 4 < 2, F.concat(F.lit("W"), k)).alias("id"), F.when(k % 4 == 1, F.concat(F.lit("10.1/A"), k)).alias("doi"), F.concat(F.lit("entry "), k).alias("entry"))
    ghosts = parts(s, d).where("k % 4 < 3").select(F.when(k % 4 == 0, F.concat(F.lit("W"), k)).when(k % 4 == 1, F.concat(F.lit("10.1/a"), k)).otherwise(F.concat(F.lit("entry "), k)).alias("key"), F.when(k % 4 == 0, "by id").when(k % 4 == 1, "by doi").otherwise("by entry").alias("text"))
    return E.ghosts_of(works, ghosts).select(F.col("part").alias("id"), "ghost")


@query("stale_notes", "SELECT p_partkey AS path FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0")
def stale_notes(s, d):
    k = F.col("k")
    now = parts(s, d).select(F.col("p_partkey").alias("path"), (k + F.when(k % 5 == 0, 1).otherwise(0)).alias("mtime"), F.col("p_size").alias("size"), F.lit("doi").alias("setting"))
    seen = parts(s, d).where("k % 3 <> 0").select(F.col("p_partkey").alias("path"), k.alias("mtime"), F.col("p_size").alias("size"), F.lit("doi").alias("setting"), F.lit("f").alias("fingerprint"))
    return E.unread_notes(now, seen).select("path")


@query("model_rows", "WITH v AS (SELECT vec_id AS term, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127 AS s FROM embeddings) SELECT term, floor(floor(e[1] / s + 0.5) * s * 1000000 + 0.5) / 1000000 AS first FROM v")
def model_rows(s, d):
    basis = T.read(s, d, "embeddings").select(F.col("vec_id").alias("term"), F.transform("embedding", lambda x: x.cast("double")).alias("row"))
    return E.dequantised(E.quantised(basis)).select("term", rounded(F.col("row")[0]).alias("first"))


# ---- all five signals of a suggestion: citations of every direction

_ALL = """c AS (SELECT DISTINCT CASE l_linenumber % 4 WHEN 1 THEN 'P' || l_partkey WHEN 2 THEN 'P' || (l_partkey // 3) WHEN 3 THEN 'S' || l_suppkey ELSE 'S' || l_suppkey END AS source,
  CASE l_linenumber % 4 WHEN 1 THEN 'S' || l_suppkey WHEN 2 THEN 'P' || l_partkey WHEN 3 THEN 'S' || (l_suppkey // 2) ELSE 'P' || l_partkey END AS target FROM lineitem), e AS (SELECT * FROM c WHERE source <> target AND source <> 'P0')"""


def all_directions(s, d):
    n, p, k = (F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey"))
    part, sup = lambda x: F.concat(F.lit("P"), x), lambda x: F.concat(F.lit("S"), x)
    source = F.when(n % 4 == 1, part(p)).when(n % 4 == 2, part(F.floor(p / 3))).otherwise(sup(k))
    target = F.when(n % 4 == 1, sup(k)).when(n % 4 == 2, part(p)).when(n % 4 == 3, sup(F.floor(k / 2))).otherwise(part(p))
    return T.read(s, d, "lineitem").select(source.alias("source"), target.alias("target")).where("source <> target and source <> 'P0'").distinct()


_SIGNALS = f"""WITH {_ALL}, {INFO}, ve AS (SELECT * FROM e WHERE source LIKE 'S%' AND target LIKE 'P%'), core AS (SELECT target FROM ve GROUP BY 1 HAVING count(*) >= 2),
co AS (SELECT a.target AS id, count(DISTINCT b.target)::BIGINT AS n FROM ve a JOIN ve b ON a.source = b.source AND a.target <> b.target JOIN core ON core.target = b.target GROUP BY 1),
r AS (SELECT 'P' || p_partkey AS id, p_name AS title, info.year, cited_by_count, (SELECT count(*) FROM ve WHERE target = 'P' || p_partkey)::BIGINT AS vault_citers, (SELECT count(DISTINCT target) FROM e WHERE source = 'P' || p_partkey AND target LIKE 'S%')::BIGINT AS cites_vault,
  (SELECT count(*) FROM e WHERE target = 'P' || p_partkey AND source LIKE 'P%')::BIGINT AS outside_citers, coalesce(co.n, 0)::BIGINT AS co_cited, ((SELECT count(*) FROM core) - ('P' || p_partkey IN (SELECT target FROM core))::INT)::BIGINT AS core_size
  FROM part LEFT JOIN info ON info.id = 'P' || p_partkey LEFT JOIN co ON co.id = 'P' || p_partkey)
SELECT id, vault_citers, cites_vault, outside_citers, co_cited, core_size, floor((vault_citers + 0.5::DOUBLE * cites_vault + least(1.0::DOUBLE, 0.1::DOUBLE * outside_citers) + CASE WHEN core_size > 0 THEN 0.5::DOUBLE * co_cited / core_size ELSE 0.0 END + ({BONUS})) * 100 + 0.5) / 100 AS score FROM r"""


@query("suggestion_signals", _SIGNALS)
def suggestion_signals(s, d):
    rows = ranking.suggestions(T.nodes(s, d).select("id", "depth", "title"), all_directions(s, d), T.work_info(s, d), 2026)
    return rows.select("id", "vault_citers", "cites_vault", "outside_citers", "co_cited", "core_size", "score")


@query("edge_classes_mixed", f"WITH {_ALL} SELECT source, target, source LIKE 'S%' AND target LIKE 'S%' AS in_vault FROM e WHERE target <> 'P0' AND target IN (SELECT 'P' || p_partkey FROM part UNION ALL SELECT 'S' || s_suppkey FROM supplier) AND source IN (SELECT 'P' || p_partkey FROM part UNION ALL SELECT 'S' || s_suppkey FROM supplier)")
def edge_classes_mixed(s, d):
    return graph.edge_classes(all_directions(s, d).where("target <> 'P0'"), T.nodes(s, d))


def store_answers(asked, records, folder: str):
    """Write the stored responses of asked(value, batch) with records(value, record): a file
    for each batch, by the tasks that hold them."""
    import json

    from pyarrow import fs

    from quillgraph.sources.service import request_name, request_params

    bodies = asked.join(records, "value", "left").groupBy("batch").agg(F.sort_array(F.collect_list("value")).alias("values"), F.concat(F.lit('{"results":['), F.array_join(F.collect_list("record"), ","), F.lit("]}")).alias("body"))

    def write(frames):
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for frame in frames:
            for values, body in zip(frame["values"], frame["body"]):
                name = request_name("/works", request_params("doi", list(values), E.BATCH))
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(json.dumps({"status": 200, "body": body}).encode())
            yield frame[["batch"]]

    return bodies.mapInPandas(write, "batch long")


@query("fetched_works", "SELECT '10.1/p' || p_partkey AS value, CASE WHEN p_size % 3 <> 0 AND p_size <> 1 THEN 'W' || p_partkey END AS id, CASE WHEN p_size % 3 <> 0 AND p_size <> 1 THEN p_name END AS title, CASE WHEN p_size % 3 <> 0 AND p_size <> 1 THEN p_size::INTEGER END AS year FROM part")
def fetched_works(s, d):
    """Every part's DOI is asked for, but for those known to be unknown (size 1); the service
    knows those whose size 3 doesn't divide. Its responses are made of the table first."""
    p = parts(s, d).select(F.concat(F.lit("10.1/p"), "p_partkey").alias("value"), F.concat(F.lit("W"), "p_partkey").alias("id"), "p_name", F.col("p_size").cast("int").alias("p_size"))
    known = p.where("p_size = 1").select("value", F.lit(None).cast("string").alias("id"))
    works = summarize(s.createDataFrame([], RAW)).withColumns({"partial": F.lit(False), "trimmed": F.lit(False)})
    record = F.to_json(F.struct(F.concat(F.lit("https://w/"), "id").alias("id"), F.concat(F.lit("https://doi.org/"), "value").alias("doi"), F.col("p_name").alias("display_name"), F.col("p_size").alias("publication_year")))
    folder = f"{own_dir(s)}/responses-{uuid.uuid4().hex}"
    asked = V.batched(V.to_refetch(p.select("value"), known, works))
    store_answers(asked, p.where("p_size % 3 <> 0").select("value", record.alias("record")), folder).count()
    known, works, _ = V.fetch(p.select("value"), known, works, folder)
    return known.join(works.select("id", "title", "year"), "id", "left").select("value", "id", "title", "year")
