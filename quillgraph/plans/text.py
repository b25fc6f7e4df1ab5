"""Text, predicate and resolution queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import predicates as P
from quillgraph.functions import text as X
from quillgraph.operators import meaning, notes, resolve, similarity
from quillgraph.plans.base import joined, query, rounded
from quillgraph.sources import tables as T
from quillgraph.sources.snapshot import abstract_text
from quillgraph.sources.vault import is_literature

STOPS = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
TITLE_STOPS = "[" + ", ".join(f"'{w}'" for w in [*X.STOP_WORDS, *X.TITLE_STOP_WORDS]) + "]"
EN, FR = ("[" + ", ".join(f"'{w}'" for w in X.FUNCTION_WORDS[k]) + "]" for k in ("en", "fr"))


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(strip_accents({expr})), '[^\\p{{L}}]+'), lambda w: length(w) >= 4)"


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 0.0::DOUBLE ELSE len(list_filter({a}, lambda w: list_contains({b}, w) OR len(list_filter({b}, lambda t: ends_with(t, w) AND length(t) - length(w) BETWEEN 1 AND 3)) > 0)) / len({a})::DOUBLE END"


# Synthetic references over the driver's tables.
ENTRY = "'- Auth' || chr(97 + n_nationkey::INT) || 'son, A. (' || (1950 + p_size) || '). ' || p_name || ' of ' || p_type || '. Journal, 1, 1-2. https://doi.org/10.1000/' || p_partkey"
ENTRIES = f"entries AS (SELECT p_partkey AS id, {ENTRY} AS text, 'Auth' || chr(97 + n_nationkey::INT) || 'son' AS author, (1950 + p_size)::VARCHAR AS year, '10.1000/' || p_partkey AS doi, p_name || ' of ' || p_type AS title FROM part JOIN nation ON n_nationkey = p_partkey % 25)"


def entries(s, d):
    part, nation = T.read(s, d, "part"), T.read(s, d, "nation")
    year = (1950 + F.col("p_size")).cast("string")
    title = F.concat("p_name", F.lit(" of "), "p_type")
    doi = F.concat(F.lit("10.1000/"), F.col("p_partkey"))
    author = F.concat(F.lit("Auth"), F.char(97 + F.col("n_nationkey")), F.lit("son"))
    return part.join(F.broadcast(nation), F.col("n_nationkey") == F.col("p_partkey") % 25).select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("- "), author, F.lit(", A. ("), year, F.lit("). "), title, F.lit(". Journal, 1, 1-2. https://doi.org/"), doi).alias("text"), author.alias("author"), year.alias("year"), doi.alias("doi"), title.alias("title")
    )


@query("normalize_doi", f"WITH {ENTRIES} SELECT id, lower(doi) AS doi FROM entries")
def normalize_doi(s, d):
    forms = (" https://doi.org/", "http://dx.doi.org/", "DOI: ", "doi.org/", "dx.DOI.org/", "https://doi.org/doi:", "")
    raw = F.concat(F.element_at(F.array(*map(F.lit, forms)), (F.col("id") % len(forms) + 1).cast("int")), F.upper("doi"), F.lit(" "))
    return entries(s, d).select("id", X.normalize_doi(raw).alias("doi"))


@query("isbn_extract", "SELECT p_partkey AS id, '978' || lpad(p_partkey::VARCHAR, 10, '0') || '|979' || lpad((p_partkey * 7)::VARCHAR, 10, '0') || '|979' || lpad((p_partkey * 3 + 1)::VARCHAR, 10, '0') AS isbns FROM part")
def isbn_extract(s, d):
    k = F.lpad(F.col("p_partkey").cast("string"), 10, "0")
    j = F.lpad((F.col("p_partkey") * 7).cast("string"), 10, "0")
    text = F.concat(F.lit("ISBN 978-"), F.substring(k, 1, 4), F.lit("-"), F.substring(k, 5, 6), F.lit(", 979"), j, F.lit("; 978"), k, F.lit(", 979."), F.regexp_replace(F.lpad((F.col("p_partkey") * 3 + 1).cast("string"), 10, "0"), "(.)(.{4})(.{4})(.)", "$1.$2 $3.$4"))
    return T.read(s, d, "part").select(F.col("p_partkey").alias("id"), joined(X.isbns_in(text)).alias("isbns"))


@query("entry_parse_roundtrip", f"WITH {ENTRIES} SELECT id, author AS first_author, year, doi, lower(author) AS authors, false AS et_al FROM entries")
def entry_parse_roundtrip(s, d):
    lines = entries(s, d).select(F.col("id").cast("string").alias("path"), "text")
    return notes.parsed_entries(lines).select(F.col("path").cast("long").alias("id"), "first_author", "year", "doi", joined("authors").alias("authors"), "et_al")


@query("entry_title", f"WITH {ENTRIES} SELECT id, title FROM entries")
def entry_title(s, d):
    return entries(s, d).select("id", X.entry_title(F.col("text"), F.col("year")).alias("title"))


@query("work_key", f"WITH {ENTRIES}, w AS (SELECT id, author, year, {words('title')} AS words FROM entries) SELECT id, CASE WHEN len(words) >= 2 THEN lower(author) || '|' || year || '|' || array_to_string(words[1:3], ' ') END AS key FROM w")
def work_key(s, d):
    return entries(s, d).select("id", X.work_key(X.name_key(F.col("author")), F.col("year"), F.col("title")).alias("key"))


@query("name_key", r"SELECT doc_id, regexp_replace(lower(strip_accents(text)), '[^\p{L}]', '', 'g') AS key FROM documents")
def name_key(s, d):
    return T.read(s, d, "documents").select("doc_id", X.name_key(F.col("text")).alias("key"))


#: Names of several scripts and forms, and their keys.
SCRIPTS = (("Ёлкин", "елкин"), ("Άννα", "αννα"), ("ﬁsher", "fisher"), ("Ｗａｎｇ", "wang"), ("d'Étienne-Ŵ", "detiennew"), ("Nguyễn", "nguyen"), ("김", "김"), ("ﷺx", "صلىاللهعليهوسلمx"), ("O’Neil 3", "oneil"))


@query("name_key_scripts", "SELECT n_nationkey, CASE n_nationkey % 9 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(SCRIPTS)) + " END || regexp_replace(lower(n_name), '[^a-z]', '', 'g') AS key FROM nation")
def name_key_scripts(s, d):
    """By the Column expression; the note scanners' own key must agree (tests)."""
    name = F.concat(F.element_at(F.array(*(F.lit(n) for n, _ in SCRIPTS)), (F.col("n_nationkey") % len(SCRIPTS) + 1).cast("int")), F.lit(" "), F.col("n_name"))
    return T.read(s, d, "nation").select("n_nationkey", X.name_key(name).alias("key"))


@query("literature_folder", "SELECT p_partkey AS id, p_partkey % 4 = 0 AS is_literature FROM part")
def literature_folder(s, d):
    path = F.concat(F.element_at(F.array(*map(F.lit, ("Literature/", "My Literature/", "x/Literature/", "Literature.md/"))), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_name"), F.lit(".md"))
    return T.read(s, d, "part").select(F.col("p_partkey").alias("id"), is_literature(path, "Literature/").alias("is_literature"))


@query("reference_heading", "SELECT r_regionkey, (r_regionkey % 2 = 0) AS is_reference FROM region")
def reference_heading(s, d):
    text = F.element_at(F.array(*map(F.lit, ["**References**", "Results and references to the literature", "7. References:", "Methods", "<BIBLIOGRAPHIE>"])), F.col("r_regionkey") + 1)
    return T.read(s, d, "region").select("r_regionkey", X.is_reference_heading(text).alias("is_reference"))


@query("title_overlap", f"WITH p AS (SELECT p_partkey, p_size, {words('p_name')} AS w, {words('p_type')} AS t FROM part) SELECT a.p_partkey AS id_a, b.p_partkey AS id_b, floor(({overlap('a.w', 'b.w')}) * 1000000 + 0.5) / 1000000 AS overlap FROM p a JOIN p b ON a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def title_overlap(s, d):
    p = T.read(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("block"), X.title_words(F.col("p_name")).alias("words"))
    return similarity.all_overlaps(p).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), rounded(F.col("overlap")).alias("overlap"))


@query("title_matches", f"WITH p AS (SELECT p_partkey, p_size, {words('p_name')} AS w FROM part), j AS (SELECT a.p_partkey AS title, b.p_partkey AS text, {overlap('a.w', 'b.w')} AS o FROM p a JOIN p b ON a.p_size = b.p_size AND a.p_partkey <> b.p_partkey) SELECT title, text, floor(o * 1000000 + 0.5) / 1000000 AS overlap FROM j WHERE o >= 0.6::DOUBLE")
def title_matches(s, d):
    p = T.read(s, d, "part").select("p_partkey", F.col("p_size").alias("block"), X.title_words(F.col("p_name")).alias("words"))
    titles, texts = p.withColumnRenamed("p_partkey", "title"), p.withColumnRenamed("p_partkey", "text")
    return similarity.overlap_join(titles, texts, resolve.MIN_TITLE_OVERLAP).where("title <> text").select("title", "text", rounded(F.col("overlap")).alias("overlap"))


_BLOCK = f"""p AS (SELECT p_partkey, p_brand, p_size, p_name, {words('p_name')} AS w FROM part), pairs AS (
  SELECT a.p_partkey AS a, b.p_partkey AS b FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey
  WHERE (a.p_partkey % 4 <> 0 OR b.p_partkey % 4 <> 0) AND least({overlap('a.w', 'b.w')}, {overlap('b.w', 'a.w')}) >= 0.9::DOUBLE)"""


def part_works(s, d):
    """Parts as works: the brand is the author, the size the year."""
    return T.read(s, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("10.1/"), F.col("p_partkey"))).alias("doi"), F.lower("p_brand").alias("first_author"), F.col("p_size").cast("string").alias("year"), F.col("p_name").alias("title"))


@query("duplicate_pairs_title", f"WITH {_BLOCK} SELECT a, b FROM pairs")
def duplicate_pairs_title(s, d):
    return resolve.title_pairs(part_works(s, d)).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


@query("duplicate_groups_star")
def duplicate_groups_star(s, d):
    return resolve.duplicate_groups(part_works(s, d)).select(joined("paths").alias("paths"), "reason")


_STARS = f"""WITH RECURSIVE {_BLOCK}, o AS (SELECT a, row_number() OVER (ORDER BY a) AS i FROM (SELECT DISTINCT a FROM pairs)), r AS (
  SELECT 0::BIGINT AS i, []::BIGINT[] AS taken, NULL::BIGINT AS a, []::BIGINT[] AS got
  UNION ALL
  SELECT o.i, CASE WHEN g.open THEN list_concat(r.taken, g.mine) ELSE r.taken END, o.a, CASE WHEN g.open THEN list_filter(g.mine, lambda x: NOT list_contains(r.taken, x)) ELSE []::BIGINT[] END
  FROM r JOIN o ON o.i = r.i + 1, LATERAL (SELECT NOT list_contains(r.taken, o.a) AS open, (SELECT list(b) FROM pairs p WHERE p.a = o.a) AS mine) g
)
SELECT a::VARCHAR AS path, a::VARCHAR AS grp FROM r WHERE len(got) > 0 UNION ALL SELECT unnest(got)::VARCHAR, a::VARCHAR FROM r"""


@query("duplicate_members", _STARS)
def duplicate_members(s, d):
    """Which part stands in the middle of which; their DOIs are all different."""
    return resolve.duplicate_members(part_works(s, d)).select("path", "grp")


@query("duplicate_groups_exact", "SELECT md5(text) AS key, array_to_string(list_sort(list(lpad(doc_id::VARCHAR, 12, '0'))), '|') AS paths FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) >= 2")
def duplicate_groups_exact(s, d):
    works = T.read(s, d, "documents").select(F.md5("text").alias("doi"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"))
    return resolve.doi_groups(works).select(F.col("doi").alias("key"), joined("paths").alias("paths"))


_RESOLVE = f"""
WITH {ENTRIES}, works AS (SELECT p_partkey, 'auth' || chr(97 + n_nationkey::INT) || 'son' AS a1, (1950 + p_size)::VARCHAR AS year, CASE WHEN p_partkey % 3 = 0 THEN '10.1000/' || p_partkey END AS doi, {words("p_name || ' of ' || p_type")} AS w FROM part JOIN nation ON n_nationkey = p_partkey % 25),
e AS (SELECT id, CASE WHEN id % 2 = 0 THEN doi END AS doi, lower(author) AS a1, year, {words("CASE WHEN id % 2 = 0 THEN text ELSE regexp_replace(text, ' https.*$', '') END")} AS t FROM entries),
hit AS (SELECT e.*, w.p_partkey AS owner FROM e LEFT JOIN works w ON w.doi = e.doi),
pairs AS (SELECT h.id, w.p_partkey FROM hit h JOIN works w ON w.a1 = h.a1 AND w.year = h.year AND w.p_partkey <> h.id + 1 WHERE h.owner IS NULL
  AND NOT (h.doi IS NOT NULL AND w.doi IS NOT NULL AND NOT starts_with(w.doi, h.doi) AND NOT starts_with(h.doi, w.doi)) AND ({overlap('w.w', 'h.t')}) >= 0.6::DOUBLE),
n AS (SELECT id, count(*) AS n, min(p_partkey) AS p FROM pairs GROUP BY id)
"""


def resolved(s, d):
    e = entries(s, d)
    text = F.when(F.col("id") % 2 == 0, F.col("text")).otherwise(F.regexp_replace("text", " https.*$", ""))
    from_path = (F.col("id") + 1).cast("string")
    entry = e.select(F.col("id").alias("entry_id"), from_path.alias("from_path"), F.when(F.col("id") % 2 == 0, F.col("doi")).alias("doi"), "year", F.array(F.lower("author")).alias("authors"), F.lit(False).alias("et_al"), text.alias("text"))
    work = e.select(F.col("id").cast("string").alias("path"), F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, F.col("doi")).alias("doi"), "year", F.array(F.lower("author")).alias("authors"), F.array("title").alias("titles"))
    return resolve.resolve_entries(entry, work)


@query("entry_resolution", _RESOLVE + "SELECT hit.id AS entry_id, CASE WHEN owner IS NOT NULL THEN CASE WHEN owner <> hit.id + 1 THEN owner END WHEN n.n = 1 THEN n.p END::VARCHAR AS path FROM hit LEFT JOIN n ON n.id = hit.id")
def entry_resolution(s, d):
    return resolved(s, d)


@query("ambiguous_entries", _RESOLVE + "SELECT hit.id AS entry_id FROM hit LEFT JOIN n ON n.id = hit.id WHERE NOT (owner IS NOT NULL AND owner <> hit.id + 1) AND NOT (owner IS NULL AND coalesce(n.n, 0) = 1)")
def ambiguous_entries(s, d):
    return resolved(s, d).where("path is null").select("entry_id")


@query(
    "same_work_match",
    f"""WITH c AS (SELECT o_orderkey AS entry_id, p_partkey AS work_id, p_name AS title, p_size::BIGINT AS n, p_partkey AS ord, {words('p_name')} AS tw FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
u AS (SELECT DISTINCT * FROM c WHERE len(tw) > 0), h AS (SELECT *, first_value(tw) OVER (PARTITION BY entry_id ORDER BY ord) AS head FROM u)
SELECT entry_id, coalesce(CASE WHEN bool_and(least({overlap('tw', 'head')}, {overlap('head', 'tw')}) >= 0.8::DOUBLE) THEN arg_max(work_id, n * 1000000000 - ord) END, -1)::BIGINT AS work_id FROM h GROUP BY entry_id""",
)
def same_work_match(s, d):
    part = T.read(s, d, "part").select(F.col("p_partkey").alias("work_id"), X.title_words(F.col("p_name")).alias("words"), F.col("p_size").cast("long").alias("n"))
    lines = T.read(s, d, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("work_id"))
    size, orders = lines.count(), T.read(s, d, "orders").select(F.col("o_orderkey").alias("entry_id"))
    pairs = T.dealt(lines, "entry_id", size).join(orders, "entry_id").distinct()  # a semi join would be moved before the dealing
    rows = T.dealt(T.dealt(pairs, "work_id", size).join(part, "work_id"), "entry_id", size)
    cand = rows.select("entry_id", "work_id", F.col("words").alias("title_words"), F.col("words").alias("text_words"), "n", F.col("work_id").alias("ord"))
    return resolve.same_work(cand).select("entry_id", F.coalesce("work_id", F.lit(-1)).alias("work_id"))


@query("book_of_part", "SELECT '10.1016/b978' || lpad((p_partkey // 2)::VARCHAR, 10, '0') || '.' || p_partkey AS doi, min(s_suppkey)::VARCHAR AS path FROM part JOIN supplier ON s_suppkey // 3 = p_partkey // 2 GROUP BY p_partkey HAVING count(DISTINCT s_suppkey) = 1")
def book_of_part(s, d):
    doi = F.concat(F.lit("10.1016/b978"), F.lpad((F.floor(F.col("p_partkey") / 2)).cast("string"), 10, "0"), F.lit("."), F.col("p_partkey"))
    books = T.read(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.array(F.concat(F.lit("978"), F.lpad(F.floor(F.col("s_suppkey") / 3).cast("string"), 10, "0"))).alias("isbns"))
    return resolve.book_of_part(T.read(s, d, "part").select(doi.alias("doi")), books)


@query("link_resolution", "SELECT p_partkey AS link_id, CASE WHEN p_partkey % 3 = 0 AND p_partkey <= (SELECT max(s_suppkey) FROM supplier) THEN 'note' WHEN p_partkey % 3 = 1 THEN CASE WHEN p_size <= 25 AND p_size IN (SELECT s_nationkey FROM supplier) THEN 'note' ELSE 'doi' END ELSE 'broken' END AS kind, CASE WHEN p_partkey % 3 = 0 AND p_partkey <= (SELECT max(s_suppkey) FROM supplier) THEN 'S' || p_partkey WHEN p_partkey % 3 = 1 THEN (SELECT 'S' || min(s_suppkey) FROM supplier WHERE s_nationkey = p_size) END AS path, CASE WHEN p_partkey % 3 = 1 AND p_size NOT IN (SELECT s_nationkey FROM supplier) THEN 'D' || p_size END AS doi FROM part")
def link_resolution(s, d):
    links = T.read(s, d, "part").select(F.col("p_partkey").alias("link_id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("S"), F.col("p_partkey"))).alias("note"), F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("D"), F.col("p_size"))).alias("doi"))
    own = T.read(s, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("path"), F.concat(F.lit("D"), F.col("s_nationkey")).alias("doi"), F.col("s_suppkey").alias("ord"))
    return resolve.resolve_targets(links, own.select("path"), own)


@query("tokenize_counts", f"WITH t AS (SELECT doc_id, unnest(list_transform(list_filter(regexp_extract_all(lower(strip_accents(text)), '[a-z]{{3,}}'), lambda w: NOT list_contains({STOPS}, w)), lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN w[:-2] ELSE w END)) AS term FROM documents WHERE lang = 'en') SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL")
def tokenize_counts(s, d):
    return english_counts(s, d)


def english_counts(s, d):
    docs = T.read(s, d, "documents").where("lang = 'en'")
    return meaning.term_counts(docs.select("doc_id", X.tokenize(F.col("text")).alias("tokens")))


_TF = f"t AS (SELECT doc_id, unnest(list_transform(list_filter(regexp_extract_all(lower(strip_accents(text)), '[a-z]{{3,}}'), lambda w: NOT list_contains({STOPS}, w)), lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN w[:-2] ELSE w END)) AS term FROM documents WHERE lang = 'en'), c AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL), n AS (SELECT count(*)::BIGINT AS n FROM documents WHERE lang = 'en'), v AS (SELECT term, count(*)::BIGINT AS df FROM c GROUP BY term HAVING df >= 2 AND df <= greatest(2, 0.5::DOUBLE * (SELECT n FROM n)) ORDER BY df DESC, term LIMIT 30000)"


def english_size(s, d):
    return T.read(s, d, "documents").where("lang = 'en'").count()


@query("document_frequency", f"WITH {_TF} SELECT term, df, floor(ln((SELECT n FROM n) / df::DOUBLE) * 1000000 + 0.5) / 1000000 AS idf FROM v")
def document_frequency(s, d):
    return meaning.vocabulary(english_counts(s, d), english_size(s, d)).select("term", "df", rounded(F.col("idf")).alias("idf"))


@query("tfidf_top_terms", f"WITH {_TF}, w AS (SELECT doc_id, term, (1 + ln(tf)) * ln((SELECT n FROM n) / df::DOUBLE) AS w FROM c JOIN v USING (term)), u AS (SELECT doc_id, term, floor(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) * 10000 + 0.5) / 10000 AS weight FROM w) SELECT doc_id, term, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term)::INTEGER AS rank FROM u QUALIFY rank <= 5")
def tfidf_top_terms(s, d):
    counts = english_counts(s, d)
    weights = meaning.tfidf(counts, meaning.vocabulary(counts, english_size(s, d))).withColumn("weight", rounded(F.col("weight"), 4))
    return meaning.top_per(weights, "doc_id", 5, F.desc("weight"), F.col("term")).select("doc_id", "term", "weight", "rank")


@query("language_guess", f"WITH w AS (SELECT doc_id, regexp_split_to_array(lower(substr(text, 1, 50000)), '[^a-zàâçéèêëîïôûùüÿœ]+') AS w FROM documents), n AS (SELECT doc_id, len(list_filter(w, lambda x: list_contains({EN}, x))) AS en, len(list_filter(w, lambda x: list_contains({FR}, x))) AS fr FROM w) SELECT doc_id, CASE WHEN greatest(en, fr) < 30 OR greatest(en, fr) < 1.5 * least(en, fr) THEN '' WHEN en >= fr THEN 'en' ELSE 'fr' END AS lang FROM n")
def language_guess(s, d):
    return T.read(s, d, "documents").select("doc_id", X.language_of(F.col("text")).alias("lang"))


@query("majority_language", "SELECT source, arg_max(lang, n * 1000 - ascii(lang)) AS lang FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def majority_language(s, d):
    per = T.read(s, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("source").agg(F.max_by("lang", F.col("n") * 1000 - F.ascii("lang")).alias("lang"))


@query("title_terms", f"WITH w AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z]{{3,}}') AS w FROM part) SELECT p_partkey, array_to_string(flatten(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_contains({TITLE_STOPS}, w[i]) THEN [] WHEN i < len(w) AND NOT list_contains({TITLE_STOPS}, w[i + 1]) THEN [w[i], w[i] || ' ' || w[i + 1]] ELSE [w[i]] END)), '|') AS terms FROM w")
def title_terms(s, d):
    return T.read(s, d, "part").select("p_partkey", joined(X.title_terms(F.col("p_name"))).alias("terms"))


@query("markdown_links", r"WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"()\s<>]*)\">[^<\[\]]*</a>')) AS a FROM pages) SELECT page_id, regexp_extract(a, '>([^<]*)<', 1) AS text, regexp_extract(a, 'href=\"([^\"]*)\"', 1) AS url, count(*)::BIGINT AS n FROM m GROUP BY ALL")
def markdown_links(s, d):
    pages = T.read(s, d, "pages")
    anchors = F.regexp_extract_all("html", F.lit(r'<a href="([^"()\s<>]*)">[^<\[\]]*</a>'), F.lit(0))
    md = F.array_join(F.transform(anchors, lambda a: F.regexp_replace(a, r'<a href="([^"]*)">([^<]*)</a>', r"[$2]($1)")), "\n")
    found = notes.markdown_links(pages.select(F.col("page_id").cast("string").alias("path"), md.alias("text")))
    return found.groupBy(F.col("path").cast("long").alias("page_id"), "text", "url").agg(F.count(F.lit(1)).alias("n"))


@query("citation_urls", "SELECT p_partkey AS id, p_name || ' & 40% (' || p_size || ')' AS q, 'N' || p_partkey AS note, (p_size % 3) AS occ FROM part")
def citation_urls(s, d):
    url = F.concat(F.lit("[x](<obsidian://cite?note=N"), F.col("p_partkey"), F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("&occ="), F.col("p_size") % 3)).otherwise(""), F.lit("&q="), F.regexp_replace("p_name", " ", "%20"), F.lit(" & 40% ("), F.col("p_size"), F.lit(")>)"))
    found = notes.citation_links(T.read(s, d, "part").select(F.col("p_partkey").cast("string").alias("path"), url.alias("text")))
    return found.select(F.col("path").cast("long").alias("id"), "q", "note", F.coalesce("occ", F.lit(0)).alias("occ"))


@query("code_fence_state", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents) SELECT doc_id, n::INTEGER AS n, (sum((length(line) % 7 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY n)) % 2 = 1 AS inside FROM l")
def code_fence_state(s, d):
    lines = T.read(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.select("doc_id", "n", X.fence_parity(F.length("line") % 7 == 0, Window.partitionBy("doc_id").orderBy("n")).alias("inside"))


@query("fingerprint_drift", "SELECT floor(avg((a.doc_id IS NULL OR b.doc_id IS NULL OR a.text <> b.text)::INT::DOUBLE) * 1000000 + 0.5) / 1000000 AS drift FROM (SELECT doc_id, text FROM documents WHERE doc_id % 50 <> 0) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN text || '.' ELSE text END AS text FROM documents WHERE doc_id % 49 <> 0) b ON a.doc_id = b.doc_id")
def fingerprint_drift(s, d):
    from quillgraph.streaming.incremental import drift

    docs = T.read(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    before = docs.where("id % 50 <> 0").select("id", F.xxhash64("text").alias("fingerprint"))
    after = docs.where("id % 49 <> 0").select("id", F.xxhash64(F.when(F.col("id") % 20 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("fingerprint"))
    return drift(before, after).select(rounded(F.col("drift")).alias("drift"))


@query("abstract_from_index", r"SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), ' ') AS abstract FROM conversations")
def abstract_from_index(s, d):
    words_ = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    placed = T.read(s, d, "conversations").select("conv_id", "turn", F.posexplode(words_).alias("p", "w"))
    index = placed.groupBy("conv_id", "turn", "w").agg(F.collect_list("p").alias("ps")).groupBy("conv_id", "turn").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return index.select("conv_id", "turn", abstract_text(F.col("m")).alias("abstract"))


@query("apa_reference", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN n_name WHEN 2 THEN n_name || ', & ' || p_brand ELSE n_name || ', ' || p_brand || ', & ' || p_type END AS authors FROM part JOIN nation ON n_nationkey = p_partkey % 25")
def apa_reference(s, d):
    names = F.slice(F.array("n_name", "p_brand", "p_type"), F.lit(1), (F.col("p_partkey") % 4).cast("int"))
    rows = T.read(s, d, "part").join(F.broadcast(T.read(s, d, "nation")), F.col("n_nationkey") == F.col("p_partkey") % 25)
    return rows.select(F.col("p_partkey").alias("id"), X.reference_authors(names).alias("authors"))


@query("in_text_citation", "SELECT p_partkey AS id, '(' || CASE p_partkey % 3 WHEN 0 THEN n_name WHEN 1 THEN n_name || ' & ' || p_brand ELSE n_name || ' et al.' END || ', ' || coalesce((CASE WHEN p_size > 5 THEN 1950 + p_size END)::VARCHAR, 'n.d.') || ')' AS citation FROM part JOIN nation ON n_nationkey = p_partkey % 25")
def in_text_citation(s, d):
    names = F.slice(F.array("n_name", "p_brand", "p_type"), F.lit(1), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = T.read(s, d, "part").join(F.broadcast(T.read(s, d, "nation")), F.col("n_nationkey") == F.col("p_partkey") % 25)
    return rows.select(F.col("p_partkey").alias("id"), X.in_text_citation(names, F.when(F.col("p_size") > 5, 1950 + F.col("p_size"))).alias("citation"))


@query("file_name", "SELECT p_partkey AS id, p_name || ' ab, ' || p_size AS name FROM part")
def file_name(s, d):
    return T.read(s, d, "part").select(F.col("p_partkey").alias("id"), X.file_name(F.concat(F.lit("("), "p_name", F.lit(":  a/b, "), F.col("p_size"), F.lit(")"))).alias("name"))


@query("author_initials", "SELECT n_nationkey, upper(n_name[1]) || '. ' || upper(n_name[2]) || '.-X.' AS initials FROM nation")
def author_initials(s, d):
    given = F.concat("n_name", F.lit("  "), F.substring("n_name", 2, 3), F.lit("-xavier"))
    return T.read(s, d, "nation").select("n_nationkey", X.initials(given).alias("initials"))


_GROUPS = "// colours\n[brand:brand#1] = red\ntag:#promo = green\npath:plated = blue\nfile:1 = grey\n"


def part_notes(s, d):
    return T.read(s, d, "part").select("p_partkey", F.concat(F.lit("Lit/"), "p_type", F.lit("/"), "p_name").alias("path"), F.col("p_partkey").cast("string").alias("name"), F.col("p_name").alias("title"), F.array(F.concat(F.lit("#"), F.regexp_extract(F.lower("p_type"), "^[a-z]*", 0), F.lit("/x"))).alias("tags"), F.create_map(F.lit("Brand"), F.col("p_brand")).alias("properties"))


@query("color_group_first_match", "SELECT p_partkey, CASE WHEN lower(p_brand) LIKE '%brand#1%' THEN 'red' WHEN regexp_extract(lower(p_type), '^[a-z]*') = 'promo' THEN 'green' WHEN lower('Lit/' || p_type || '/' || p_name) LIKE '%plated%' THEN 'blue' WHEN p_partkey::VARCHAR LIKE '%1%' THEN 'grey' END AS color FROM part")
def color_group_first_match(s, d):
    fields = {k: F.col(k) for k in ("path", "name", "title", "tags", "properties")}
    return part_notes(s, d).select("p_partkey", P.color_for(P.parse_groups(_GROUPS), **fields).alias("color"))


@query("search_works", "SELECT p_partkey AS id FROM part WHERE contains(lower(p_brand || ' ' || p_name), 'brand') AND contains(lower(p_brand || ' ' || p_name), (SELECT lower(min(split_part(p_name, ' ', 1))) FROM part)) ORDER BY starts_with(lower(p_brand), 'brand ' || (SELECT lower(min(split_part(p_name, ' ', 1))) FROM part)) DESC, p_size DESC, p_brand, p_partkey LIMIT 30")
def search_works(s, d):
    part = T.read(s, d, "part")
    word = part.agg(F.min(F.split("p_name", " ")[0])).first()[0]
    works = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"), F.col("p_name").alias("title"), F.lit(1).alias("depth"), F.col("p_size").alias("cited_by"))
    return P.search(works, f"Brand {word}").select("id")


@query("autocomplete", "SELECT value, CASE WHEN starts_with(lower(value), 'brand#1') THEN 0 ELSE 1 END AS rank FROM (SELECT DISTINCT p_brand AS value FROM part) WHERE contains(lower(value), 'brand#1') ORDER BY rank, value LIMIT 50")
def autocomplete(s, d):
    return P.autocomplete(T.read(s, d, "part").select(F.col("p_brand").alias("value")), "BRAND#1")


@query("property_catalog", "SELECT DISTINCT 'brand' AS key, p_brand AS value FROM part UNION SELECT DISTINCT 'segment', c_mktsegment FROM customer")
def property_catalog(s, d):
    both = T.read(s, d, "part").select(F.lit("brand").alias("key"), F.col("p_brand").alias("value")).union(T.read(s, d, "customer").select(F.lit("segment"), "c_mktsegment"))
    return P.property_catalog(both)


@query("folder_catalog", "SELECT DISTINCT 'Lit' AS folder FROM part UNION SELECT DISTINCT 'Lit/' || p_type FROM part")
def folder_catalog(s, d):
    return P.folders(part_notes(s, d).select("path"))


@query("main_topics", "SELECT p_type AS topic, count(*)::BIGINT AS works FROM part GROUP BY 1 ORDER BY works DESC, topic LIMIT 12")
def main_topics(s, d):
    return T.read(s, d, "part").groupBy(F.col("p_type").alias("topic")).agg(F.count(F.lit(1)).alias("works")).orderBy(F.desc("works"), "topic").limit(12)


@query("incremental_latest", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def incremental_latest(s, d):
    from quillgraph.streaming.incremental import latest

    return latest(T.read(s, d, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"])


@query("citing_top_n", "WITH e AS (SELECT DISTINCT l_suppkey AS id, l_partkey AS citing FROM lineitem), r AS (SELECT e.id, citing, p_size::BIGINT AS cited_by_count, count(*) OVER (PARTITION BY id)::BIGINT AS total, row_number() OVER (PARTITION BY id ORDER BY p_size DESC, citing)::INTEGER AS rank FROM e JOIN part ON p_partkey = citing) SELECT * FROM r WHERE rank <= 5")
def citing_top_n(s, d):
    from quillgraph.sources.snapshot import citing_works

    refs = T.read(s, d, "lineitem").groupBy("l_partkey").agg(F.collect_set("l_suppkey").alias("references"))
    works = refs.join(T.read(s, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("cited_by_count"), "references")
    return citing_works(works, T.read(s, d, "supplier").select(F.col("s_suppkey").alias("id")), 5).select("id", "citing", "cited_by_count", "total", "rank")

