"""A collection of notes as an index of works, links and references; its graph; and what
a reading panel shows of each note.

Everything is joins over per-note rows: nothing is stored resolved, so a change of one
note changes others' results by running the same plan again. Views are for all notes at
once; a caller that shows one filters by its path, which Catalyst pushes down.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.functions import works as W
from quillgraph.lineage import cut
from quillgraph.operators import graph, notes, resolve
from quillgraph.sources.tables import spread
from quillgraph.sources.vault import is_literature

#: Where citations come from; for works outside the first of these in order counts.
SOURCES = ("link", "bibliography", "openalex")
FIRST = ("openalex", "link", "bibliography")
UNKNOWN = "Unknown work"


@dataclass(frozen=True)
class Settings:
    """Names of a note's properties, and how works are labelled."""

    literature_folder: str = "Literature"
    title: str = "title"
    authors: str = "authors"
    year: str = "year"
    doi: str = "doi"
    isbn: str = "isbn"
    citation_text: str = "citation-text"
    aliases: str = "aliases"
    keywords: str = "keywords"
    language: str = "en"
    note_name_as_citation: bool = False


@dataclass(frozen=True)
class Options:
    """What a graph holds: works outside are shown from min_citations on, the most cited
    ones up to max_nodes nodes in all."""

    depth: int = 1
    min_citations: int = 2
    max_nodes: int = 3000
    local_works: bool = True
    all_notes: bool = False
    off: frozenset[str] = frozenset()


@dataclass(frozen=True)
class External:
    """What is known of works outside: summaries(id, doi, title, year, authors,
    references), doi_ids(doi, id; a null id: asked for and unknown), missing(id)."""

    works: DataFrame
    doi_ids: DataFrame
    missing: DataFrame


@dataclass(frozen=True)
class Index:
    settings: Settings
    works: DataFrame
    links: DataFrame
    entries: DataFrame
    owners: DataFrame = field(repr=False)


def own_works(vault: DataFrame, s: Settings, *more: str) -> DataFrame:
    """(path, basename, ord, literature, doi, isbns, authors, year, title, titles,
    keywords, label) of notes(path, basename, text, properties), and `more` of their columns."""
    p = lambda key: X.property_value(F.col("properties"), key)
    title = F.trim(F.coalesce(p(s.title), F.lit("")))
    described = F.size("properties") > 0
    return vault.select(
        "path", "basename", F.col("path").alias("ord"), is_literature(F.col("path"), s.literature_folder).alias("literature"),
        W.own_doi(p(s.doi), F.col("text")).alias("doi"), X.isbns_in(F.coalesce(p(s.isbn), F.lit(""))).alias("isbns"),
        F.when(described, W.author_keys(p(s.authors))).otherwise(F.array().cast("array<string>")).alias("authors"), F.trim(F.coalesce(p(s.year), F.lit(""))).alias("year"),
        F.coalesce(p(s.title), "basename").alias("title"), F.filter(F.concat(F.array(title), W.listed(p(s.aliases))), lambda t: t != "").alias("titles"),
        W.listed(p(s.keywords)).alias("keywords"),
        W.citation_text(p(s.citation_text), p(s.authors), p(s.year), F.col("basename"), language=s.language, by_name=s.note_name_as_citation).alias("label"), *more,
    )


def doi_owners(works: DataFrame, dois: DataFrame) -> DataFrame:
    """(doi, owner): the first note by path with each of dois(doi), or the one literature
    note without a DOI that has an ISBN of it."""
    direct = works.where("doi is not null").groupBy("doi").agg(F.min_by("path", "ord").alias("direct"))
    books = works.where("doi is null and literature and size(isbns) > 0").select("path", "isbns")
    wanted = dois.select("doi").where("doi is not null").distinct()
    part = resolve.book_of_part(wanted, books).withColumnRenamed("path", "book")
    return wanted.join(direct, "doi", "left").join(part, "doi", "left").select("doi", F.coalesce("direct", "book").alias("owner")).where("owner is not null")


def link_targets(links: DataFrame, works: DataFrame, owners: DataFrame) -> DataFrame:
    """The links with (kind, target, target_doi): by a note's path or name (the shortest
    path of several), else by DOI to a note, else the DOI, else broken."""
    stem = F.regexp_replace("path", r"\.md$", "")
    names = works.select(F.explode(F.array(F.struct(F.col("path").alias("name"), F.lit(0).alias("rank")), F.struct(stem.alias("name"), F.lit(0).alias("rank")), F.struct(F.col("basename").alias("name"), F.lit(1).alias("rank")))).alias("n"), "path")
    named = names.groupBy(F.col("n.name").alias("note")).agg(F.min_by("path", F.struct("n.rank", F.length("path"), "path")).alias("by_note"))
    asked = links.withColumn("asked_doi", X.normalize_doi(F.col("doi")))
    both = asked.join(named, "note", "left").join(owners.select(F.col("doi").alias("asked_doi"), F.col("owner").alias("by_doi")), "asked_doi", "left")
    target = F.coalesce("by_note", "by_doi")
    kind = F.when(target.isNotNull(), "note").when(F.col("asked_doi").isNotNull(), "doi").otherwise("broken")
    return both.select(*links.columns, kind.alias("kind"), target.alias("target"), F.when(target.isNull(), F.col("asked_doi")).alias("target_doi"))


def index(vault: DataFrame, settings: Settings = Settings()) -> Index:
    """Works, resolved links and resolved reference entries of all notes. Only literature
    notes have references, and only they are found by author, year and title.

    Each table is written once: the scanners read every note a single time, however
    many views follow."""
    works = cut(own_works(vault, settings))
    literature = vault.where(is_literature(F.col("path"), settings.literature_folder))
    raw_links, raw_entries = cut(notes.citation_links(vault)), cut(notes.bibliographies(literature))
    owners = cut(doi_owners(works, raw_links.select(X.normalize_doi(F.col("doi")).alias("doi")).union(raw_entries.select("doi")).union(works.select("doi"))))
    entry_id = F.concat_ws("#", "path", "entry_ord")
    asked = raw_entries.select(entry_id.alias("entry_id"), F.col("path").alias("from_path"), "doi", "year", "authors", "et_al", "text")
    known = works.withColumn("authors", F.when(F.col("literature"), F.col("authors")).otherwise(F.array().cast("array<string>")))
    found = resolve.resolve_entries(asked, known, owners).withColumnRenamed("path", "target")
    return Index(settings, works, cut(link_targets(raw_links, works, owners)), cut(raw_entries.withColumn("entry_id", entry_id).join(found, "entry_id", "left")), owners)


def _drawn(ix: Index, options: Options) -> DataFrame:
    """(path, literature) of the notes that a graph shows."""
    lit = ix.works.where("literature").select("path", "literature")
    if not options.all_notes:
        return lit
    other = ix.works.where("not literature").select("path", "literature")
    citing = other.join(ix.links, "path", "left_semi")
    cited = ix.links.where("kind = 'note'").join(lit.union(citing).select("path"), "path", "left_semi").select(F.col("target").alias("path"))
    return lit.union(citing).union(other.join(cited, "path", "left_semi")).distinct()


def vault_ids(ix: Index, ext: External) -> DataFrame:
    """(id, path): the external works that literature notes are."""
    asked = ix.works.where("literature and doi is not null").select("doi").distinct()
    mine = asked.join(ext.doi_ids.where("id is not null"), "doi").select("id").distinct().join(ext.works.select("id", "doi"), "id")
    return cut(mine.join(ix.owners, "doi").select("id", F.col("owner").alias("path")))


def reference_targets(ix: Index, ext: External, ids: DataFrame) -> DataFrame:
    """(path, id, target): the references of the collection's works, with the literature
    note that each is: by id, or by the DOI of its record."""
    refs = ext.works.join(ids, "id").select("path", F.explode("references").alias("id")).distinct()
    lit = ix.works.where("literature").select("path")
    by_doi = ext.works.select("id", "doi").join(doi_owners(ix.works, ext.works.select("doi")), "doi").join(lit.withColumnRenamed("path", "owner"), "owner", "left_semi").select("id", F.col("owner").alias("by_doi"))
    return cut(refs.join(ids.withColumnRenamed("path", "by_id"), "id", "left").join(by_doi, "id", "left").select("path", "id", F.coalesce("by_id", "by_doi").alias("target")))


def outside_citations(ix: Index, ext: External, drawn: DataFrame, ids: DataFrame, refs: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """(source, target, kind) of citations of works outside, and (target, entry fields)
    of those known from reference lists alone.

    A reference's DOI that is known to be unknown is taken as damaged: its entry then
    counts as one without a DOI, which joins a known work of the same author, year and
    title, or stands for itself by its key."""
    mine = ids.select(F.col("id").alias("target"))
    by_ref = refs.where("target is null").select(F.col("path").alias("source"), F.col("id").alias("target"), F.lit("openalex").alias("kind"))
    state = ext.doi_ids.select(F.col("doi").alias("cited_doi"), "id", F.lit(True).alias("asked"))
    key = F.coalesce("id", F.concat(F.lit("doi:"), "cited_doi"))
    in_links = ix.links.where("kind = 'doi'").join(drawn, "path", "left_semi").select("path", F.col("target_doi").alias("cited_doi")).join(state, "cited_doi", "left")
    by_link = in_links.select(F.col("path").alias("source"), key.alias("target"), F.lit("link").alias("kind")).join(mine, "target", "left_anti")
    open_ = ix.entries.where("target is null").withColumnRenamed("doi", "cited_doi").drop("target").join(state, "cited_doi", "left")
    unknown = F.col("asked") & F.col("id").isNull()
    with_doi = open_.where("cited_doi is not null").where(~F.coalesce(unknown, F.lit(False)))
    by_entry = with_doi.select(F.col("path").alias("source"), key.alias("target"), F.lit("bibliography").alias("kind")).join(mine, "target", "left_anti")
    columns = ("source", "target", "kind")
    cites = cut(graph.allowed_sources(by_ref.select(*columns).union(by_link.select(*columns)).union(by_entry.select(*columns)), set(options.off)))
    nothing = open_.limit(0).select(F.lit("").alias("target"), "text", "year", "first_author", "authors", "et_al")
    if not options.local_works or "bibliography" in options.off:
        return graph.first_source(cites, FIRST), nothing
    key_of = X.work_key(F.coalesce(F.try_element_at("authors", F.lit(1)), F.lit("")), F.coalesce("year", F.lit("")), X.entry_title(F.col("text"), F.col("year")))
    loose = open_.where(F.col("cited_doi").isNull() | unknown).withColumn("key", key_of).withColumn("text_words", X.title_words(F.col("text"))).withColumn("block", resolve.block_key(F.col("authors"), F.col("year")))
    loose = cut(loose).where("key is not null")
    counts = cites.groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("n"))
    # step by step, since each of these names its input several times
    known = ext.works.join(counts, "id").select(F.col("id").alias("work_id"), "title", "n", "year", F.try_element_at("authors", F.lit(1)).alias("author"))
    known = known.withColumn("surname", W.surname(F.col("author"))).withColumn("first", X.name_key(F.col("surname"))).withColumn("block", resolve.block_key(F.array("first"), F.col("year").cast("string")))
    known = cut(known.select("work_id", X.title_words(F.col("title")).alias("title_words"), "n", "block")).where("block is not null")
    matched = resolve.same_work(loose.select("entry_id", "text_words", "block").join(known, "block").select("entry_id", "work_id", "title_words", "text_words", "n", F.xxhash64("work_id").alias("ord")))
    placed = cut(loose.drop("text_words").join(matched, "entry_id", "left").withColumn("target_", F.coalesce("work_id", F.concat(F.lit("ref:"), "key"))))
    local = placed.where("work_id is null").groupBy(F.col("target_").alias("target")).agg(F.min_by(F.struct("text", "year", "first_author", "authors", "et_al"), F.struct("path", "entry_ord")).alias("e")).select("target", "e.*")
    cites = cites.union(placed.select(F.col("path").alias("source"), F.col("target_").alias("target"), F.lit("bibliography").alias("kind")))
    return graph.first_source(cites, FIRST), local


def build(ix: Index, ext: External, options: Options = Options()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, left_out) of the literature graph.

    nodes(id, depth, doi, external_id, label, title, cited_by); edges(source, target,
    kinds); left_out(eligible, kept, left_out) of works outside. Only what is counted and
    kept goes on to be described, a top-k of at most max_nodes rows."""
    lang, off = ix.settings.language, set(options.off)
    drawn = cut(_drawn(ix, options))
    ids = vault_ids(ix, ext)
    refs = reference_targets(ix, ext, ids)
    inside = (
        ix.links.where("kind = 'note'").select(F.col("path").alias("source"), "target", F.lit("link").alias("kind"))
        .union(ix.entries.where("target is not null").select(F.col("path").alias("source"), "target", F.lit("bibliography").alias("kind")))
        .union(refs.where("target is not null").select(F.col("path").alias("source"), "target", F.lit("openalex").alias("kind")))
    )
    inside = graph.allowed_sources(inside, off)
    own_id = ids.groupBy("path").agg(F.min("id").alias("external_id"))
    own = ix.works.join(drawn.select("path"), "path", "left_semi").join(own_id, "path", "left").select(F.col("path").alias("id"), F.lit(0).alias("depth"), "doi", "external_id", "label", "title")
    cites, nodes = inside, own
    counts = None
    if options.depth > 0:
        outside, local = outside_citations(ix, ext, drawn, ids, refs, options)
        outside = cut(outside)
        counts = outside.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        room = max(0, options.max_nodes - drawn.count())
        kept = cut(graph.most_cited(counts, minimum=options.min_citations, limit=room))
        described = kept.join(local.withColumnRenamed("target", "id"), "id", "left").join(ext.works.select("id", F.col("doi").alias("wdoi"), F.col("title").alias("wtitle"), F.col("year").alias("wyear"), F.col("authors").alias("wauthors"), F.lit(True).alias("known")), "id", "left").join(ext.missing.select("id"), "id", "left_anti")
        is_ref, is_doi = F.col("id").startswith("ref:"), F.col("id").startswith("doi:")
        bare = F.when(is_doi, F.substring("id", 5, 1_000_000))
        doi = F.coalesce(bare, F.when(~is_ref, F.col("wdoi")))
        label = F.when(is_ref, W.entry_label(F.col("first_author"), F.col("authors"), F.col("et_al"), F.col("year"), F.col("text"), lang)).when(F.col("known"), W.work_label(F.col("wauthors"), F.col("wyear"), F.col("wtitle"), lang)).otherwise(F.coalesce(bare, F.lit(UNKNOWN)))
        title = F.when(is_ref, X.entry_title(F.col("text"), F.col("year"))).otherwise(F.coalesce("wtitle", F.lit("")))
        nodes = own.union(described.select("id", F.lit(1).alias("depth"), doi.alias("doi"), F.when(~is_ref & ~is_doi, F.col("id")).alias("external_id"), label.alias("label"), title.alias("title")))
        cites = inside.union(outside.select("source", "target", "kind"))
    nodes = cut(nodes)
    edges = cut(graph.merge_edges(cites, nodes))
    left = graph.left_out(counts, minimum=options.min_citations, limit=max(0, options.max_nodes - drawn.count())) if counts is not None else None
    cited = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("cited_by"))
    full = nodes.join(cited, "id", "left").select(*nodes.columns, F.coalesce("cited_by", F.lit(0)).alias("cited_by"))
    return full, edges, left if left is not None else full.sparkSession.createDataFrame([(0, 0, 0)], "eligible long, kept long, left_out long")


def build_cited_by(ix: Index, ext: External, citing: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cited-by graph: works outside that cite the collection's, of citing(id,
    citing), from min_citations works of it on; those that are the collection's
    themselves give edges inside it."""
    base_nodes, base_edges, _ = build(ix, ext, Options(depth=0, off=options.off, all_notes=options.all_notes))
    if "openalex" in options.off:
        return base_nodes, base_edges, base_nodes.sparkSession.createDataFrame([(0, 0, 0)], "eligible long, kept long, left_out long")
    ids = vault_ids(ix, ext)
    pairs = citing.join(ids, "id").select(F.col("path").alias("target"), F.col("citing").alias("id")).distinct().join(ext.missing.select("id"), "id", "left_anti")
    lit = ix.works.where("literature").select(F.col("path").alias("owner"))
    by_doi = ext.works.select("id", "doi").join(doi_owners(ix.works, ext.works.select("doi")), "doi").join(lit, "owner", "left_semi").select("id", "owner")
    sided = pairs.join(ids.withColumnRenamed("path", "by_id"), "id", "left").join(by_doi, "id", "left").withColumn("own", F.coalesce("by_id", "owner"))
    within = sided.where("own is not null").select(F.col("own").alias("source"), "target", F.lit("openalex").alias("kind"))
    outside = sided.where("own is null").select(F.col("id").alias("source"), "target", F.lit("openalex").alias("kind"))
    counts = outside.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    room = max(0, options.max_nodes - base_nodes.count())
    kept = graph.most_cited(counts, minimum=options.min_citations, limit=room)
    described = kept.join(ext.works.select("id", "doi", "title", "year", "authors", F.lit(True).alias("known")), "id", "left")
    label = F.when(F.col("known"), W.work_label(F.col("authors"), F.col("year"), F.col("title"), ix.settings.language)).otherwise(F.lit(UNKNOWN))
    nodes = base_nodes.drop("cited_by").union(described.select("id", F.lit(1).alias("depth"), "doi", F.col("id").alias("external_id"), label.alias("label"), F.coalesce("title", F.lit("")).alias("title")))
    edges = graph.merge_edges(base_edges.select("source", "target", F.explode("kinds").alias("kind")).union(within).union(outside), nodes)
    return nodes, edges, graph.left_out(counts, minimum=options.min_citations, limit=room)


# ---- what a reading panel shows


def _shown(link: bool) -> Column:
    return F.when(F.col("kind") == "note", F.col("note_label")).otherwise(F.col("text"))


def cited_works(ix: Index) -> DataFrame:
    """(path, kind, key, label, links, passages): the works that each note's links cite,
    one row a work; passages in the order of the links, empty for the whole work."""
    label = ix.works.select(F.col("path").alias("target"), F.col("label").alias("note_label"))
    rows = ix.links.join(label, "target", "left").withColumn("label", _shown(True)).withColumn("key", F.coalesce("target", "target_doi", "label"))
    passage = F.when(F.coalesce("q", F.lit("")) == "", "").otherwise(F.concat("q", F.when(F.coalesce("qe", F.lit("")) == "", "").otherwise(F.concat(F.lit(" … "), "qe"))))
    grouped = rows.groupBy("path", "kind", "key").agg(F.min_by("label", "link_ord").alias("label"), F.count(F.lit(1)).alias("links"), F.sort_array(F.collect_list(F.struct("link_ord", passage.alias("p")))).alias("ps"))
    return grouped.select("path", "kind", "key", "label", "links", F.transform("ps", lambda p: p["p"]).alias("passages"))


def citing_notes(ix: Index) -> DataFrame:
    """(path, citing, via, lines): the notes that cite each note, by links and by
    reference lists, with the lines (from 1)."""
    by_link = ix.links.where("kind = 'note'").groupBy(F.col("target").alias("path"), F.col("path").alias("citing")).agg(F.sort_array(F.collect_list(F.col("line") + 1)).alias("lines")).withColumn("via", F.lit("link"))
    by_list = ix.entries.where("target is not null").groupBy(F.col("target").alias("path"), F.col("path").alias("citing")).agg(F.sort_array(F.collect_list(F.col("line") + 1)).alias("lines")).withColumn("via", F.lit("bibliography"))
    return by_link.unionByName(by_list).select("path", "citing", "via", "lines")


def own_references(ix: Index) -> DataFrame:
    """(path, line, kind, target, label, detail): each note's reference list; an entry is
    a note, a DOI, or an entry alone."""
    note = ix.works.select(F.col("path").alias("target"), F.col("label").alias("note_label"), F.col("title").alias("note_title"))
    rows = ix.entries.join(note, "target", "left")
    named = F.when(F.col("first_author").isNotNull() & F.col("year").isNotNull(), F.concat_ws(", ", "first_author", "year")).otherwise(F.substring("text", 1, 40))
    kind = F.when(F.col("target").isNotNull(), "note").when(F.col("doi").isNotNull(), "doi").otherwise("entry")
    return rows.select("path", "line", kind.alias("kind"), F.coalesce("target", "doi").alias("target"), F.coalesce("note_label", named).alias("label"), F.coalesce("note_title", "text").alias("detail"))


def linked_counts(ix: Index) -> DataFrame:
    """(path, entries, linked): how many entries of each list are notes."""
    return ix.entries.groupBy("path").agg(F.count(F.lit(1)).alias("entries"), F.count("target").alias("linked"))


def external_references(ix: Index, ext: External) -> DataFrame:
    """(path, total, loaded, missing): of each literature note's external references, how
    many there are, are described, and could not be loaded."""
    ids = vault_ids(ix, ext)
    refs = ext.works.join(ids, "id").select("path", F.explode("references").alias("id"))
    known = ext.works.select("id", F.lit(1).alias("known")).join(ext.missing.select("id"), "id", "left_anti")
    return refs.join(known, "id", "left").groupBy("path").agg(F.count(F.lit(1)).alias("total"), F.count("known").alias("loaded")).withColumn("missing", F.col("total") - F.col("loaded"))


def related(ix: Index, ext: External, which: str = "references", limit: int = 50) -> DataFrame:
    """(path, kind, key, label, total): the second level of each note: the works it cites
    (by links and external references), or that cite it (notes, and the `limit` most
    cited external ones). A work found both ways is one row, the note's; total is the
    external count, or the rows if these are more."""
    ids = vault_ids(ix, ext)
    if which == "references":
        local = ix.links.where("kind = 'note'").select("path", F.col("target").alias("key"))
        outside = ext.works.join(ids, "id").select("path", F.explode("references").alias("id"))
        counts = outside.groupBy("path").agg(F.count(F.lit(1)).alias("external"))
    else:
        from pyspark.sql import Window

        local = ix.links.where("kind = 'note'").select(F.col("target").alias("path"), F.col("path").alias("key"))
        every = ext.works.select(F.col("id").alias("citing"), F.coalesce("cited_by_count", F.lit(0)).alias("n"), F.explode("references").alias("id")).join(ids, "id").select("path", F.col("citing").alias("id"), "n")
        counts = every.groupBy("path").agg(F.count(F.lit(1)).alias("external"))
        outside = every.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "id"))).where(F.col("rank") <= limit).select("path", "id")
    # a label is made once for each work, by all cores; works without a DOI are no one key
    works = spread(ext.works.select("id", "doi", "title", "year", "authors"), "id").join(ext.missing.select("id"), "id", "left_anti")
    works = works.select("id", "doi", W.work_label(F.col("authors"), F.col("year"), F.col("title"), ix.settings.language).alias("label"), F.coalesce("doi", F.concat(F.lit("\0"), "id")).alias("asked"))
    notes_ = ix.works.select(F.col("path").alias("key"), F.col("label").alias("note_label"))
    owner = doi_owners(ix.works, works.select("doi")).withColumnRenamed("doi", "asked")
    found = spread(outside, "id").join(works.join(owner, "asked", "left"), "id")
    rows = local.select("path", F.lit("note").alias("kind"), "key", F.lit(None).cast("string").alias("label"), F.lit(0).alias("rank"))
    rows = rows.union(found.select("path", F.when(F.col("owner").isNotNull(), "note").otherwise("doi"), F.coalesce("owner", "doi", "id"), "label", F.lit(1)))
    merged = rows.groupBy("path", "key").agg(F.min_by(F.struct("kind", "label"), "rank").alias("r")).select("path", "key", "r.kind", "r.label")
    named = merged.join(notes_, "key", "left").withColumn("label", F.when(F.col("kind") == "note", F.col("note_label")).otherwise(F.col("label"))).drop("note_label")
    shown = named.groupBy("path").agg(F.count(F.lit(1)).alias("shown"))
    total = named.join(shown, "path").join(counts, "path", "left")
    return total.select("path", "kind", "key", "label", F.greatest("shown", F.coalesce("external", F.lit(0))).alias("total"))


def duplicate_warnings(ix: Index) -> DataFrame:
    """(path, reason, others) of literature notes that seem to be others' works."""
    works = ix.works.where("literature").select("path", "ord", "doi", F.coalesce(F.try_element_at("authors", F.lit(1)), F.lit("")).alias("first_author"), "year", F.coalesce(F.try_element_at("titles", F.lit(1)), F.lit("")).alias("title"))
    groups = resolve.duplicate_groups(works)
    return groups.select(F.explode("paths").alias("path"), "reason", "paths").select("path", "reason", F.array_except("paths", F.array("path")).alias("others"))


def links_naming(links: DataFrame, old_path: str, *, folder: bool = False) -> DataFrame:
    """The links that name a renamed note (by path or name), or one below a folder."""
    name = F.regexp_replace("note", r"\.md$", "")
    if folder:
        return links.where(name.startswith(f"{old_path.rstrip('/')}/"))
    stem = old_path.removesuffix(".md")
    return links.where(name.isin(stem, stem.rsplit("/", 1)[-1]))


def works_cited_by(ix: Index, ext: External) -> DataFrame:
    """(path, cited): all works that each literature note cites, from external
    references, reference lists and links, itself excluded."""
    ids = vault_ids(ix, ext)
    refs = reference_targets(ix, ext, ids).select("path", F.coalesce("target", "id").alias("cited"))
    lists = ix.entries.where("target is not null").select("path", F.col("target").alias("cited"))
    links = ix.links.where("kind = 'note'").select("path", F.col("target").alias("cited"))
    return refs.union(lists).union(links).where("path <> cited").distinct()


def cited_by_collection(ix: Index, ext: External) -> DataFrame:
    """(id): the described works that the collection's works refer to, not its own."""
    ids = vault_ids(ix, ext)
    refs = ext.works.join(ids, "id").select(F.explode("references").alias("id")).distinct()
    return refs.join(ids.select("id"), "id", "left_anti").join(ext.works.select("id"), "id", "left_semi")


def neighbours_in_collection(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, context): for each work outside, the sorted works of the collection that cite
    it or that it cites."""
    side = nodes.select("id", "depth")
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("other")).union(edges.select("target", "source"))
    own = side.where("depth = 0").select(F.col("id").alias("other"))
    return both.join(side.where("depth > 0").select("id"), "id", "left_semi").join(own, "other", "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("other")).alias("context"))


def signatures(ix: Index) -> DataFrame:
    """(path, signature): of all that others depend on in a note: its links, DOI, ISBNs,
    entries and description; edits of anything else leave it as it is."""
    links = ix.links.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("link_ord", "text", "url"))), lambda x: F.concat_ws("\t", x["text"], x["url"])).alias("links"))
    entries = ix.entries.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("entry_ord", "text"))), lambda x: x["text"]).alias("entries"))
    state = F.to_json(F.struct("doi", "isbns", "authors", "year", "titles", "label", "literature", "links", "entries"))
    return ix.works.join(links, "path", "left").join(entries, "path", "left").select("path", F.sha2(state, 256).alias("signature"))
