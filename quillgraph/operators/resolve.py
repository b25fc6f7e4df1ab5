"""Entity resolution: entries to works, works to their duplicates.

All matching is blocked by equi-joins (DOI, or first author and year); the fuzzy part
is a residual on the block. Ambiguity gives null, never a best guess.

Joins of entries and works are merged: their tables are small as files and large in
memory, where a broadcast would hold them whole in the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import isbns_in, title_overlap, title_words
from quillgraph.lineage import cut
from quillgraph.operators.similarity import first_leaders, mutual_pairs

#: Shares of title words.
MIN_TITLE_OVERLAP, SAME_WORK, SAME_TITLE = 0.6, 0.8, 0.9


def entry_matches(e, w) -> Column:
    """Whether an entry (fields doi, year, authors, et_al, text_words) is a work (doi,
    year, authors, title_sets). e and w give a Column by field name."""
    both = e("doi").isNotNull() & w("doi").isNotNull()
    same = e("doi") == w("doi")
    apart = ~w("doi").startswith(e("doi")) & ~e("doi").startswith(w("doi"))
    first = (F.size(e("authors")) > 0) & (F.size(w("authors")) > 0) & (F.try_element_at(e("authors"), F.lit(1)) == F.try_element_at(w("authors"), F.lit(1)))
    by_title = F.exists(w("title_sets"), lambda t: title_overlap(t, e("text_words")) >= MIN_TITLE_OVERLAP)
    by_list = F.when(e("et_al"), F.size(w("authors")) >= 3).otherwise(e("authors") == w("authors"))
    rest = (e("year") == w("year")) & first & F.when(F.size(w("title_sets")) > 0, by_title).otherwise(by_list)
    return F.when(both & same, True).when(both & apart, False).otherwise(F.coalesce(rest, F.lit(False)))


def block_key(authors, year) -> Column:
    """First author and year; null without either, so that such rows meet nothing."""
    first = F.try_element_at(authors, F.lit(1))
    return F.when((first != "") & (year != ""), F.concat(first, F.lit("|"), year))


def resolve_entries(entries: DataFrame, works: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """(entry_id, path) of entries(entry_id, from_path, doi, year, authors, et_al, text)
    against works(path, ord, doi, year, authors, titles).

    A DOI that a work has decides: that work, or null where it is the citing note
    itself. Else the one other work of the block that matches; several give null. With
    owners(doi, owner), these say which work has a DOI."""
    entry = entries.withColumn("text_words", title_words(F.col("text"))).withColumn("block", block_key(F.col("authors"), F.col("year")))
    work = works.withColumn("title_sets", F.transform(F.filter("titles", lambda t: F.trim(t) != ""), title_words)).withColumn("block", block_key(F.col("authors"), F.col("year")))
    if owners is None:
        owners = work.where("doi is not null").groupBy("doi").agg(F.min_by("path", "ord").alias("owner"))
    hit = entry.join(owners.hint("merge"), "doi", "left").select("entry_id", "from_path", "owner", "block", "doi", "year", "authors", "et_al", "text_words")
    open_ = cut(hit.where("owner is null and block is not null and from_path is not null").drop("owner"), "open-entries")
    side = cut(work.where("block is not null and path is not null").select("block", "path", "doi", "year", "authors", "title_sets"), "open-works")
    direct = F.when(F.col("owner") != F.col("from_path"), F.col("owner"))
    found = hit.join(_only_match(open_, side).hint("merge"), "entry_id", "left")
    return found.select("entry_id", F.when(F.col("owner").isNotNull(), direct).otherwise(F.col("found")).alias("path"))


def _only_match(entries: DataFrame, works: DataFrame) -> DataFrame:
    """(entry_id, found): the one other work of its block that an entry matches.

    Where DOIs don't decide, entries of the same words match the same works, so classes of
    entries and of works are compared, however many are alike. Of a class's works their
    number and the first and last path are kept: with more than two, one is always left
    beside the entry's own. Works with DOIs can match entries with another one only if one
    is the other's beginning; these are looked up by the beginnings."""
    alike = ["block", "year", "authors", "et_al", "text_words"]
    bare = F.col("doi").isNull()
    counts = lambda of, n: (F.count(F.when(of, 1)).alias(n), F.min(F.when(of, F.col("path"))).alias(f"{n}_first"), F.max(F.when(of, F.col("path"))).alias(f"{n}_last"))
    classes = works.groupBy("block", "year", "authors", "title_sets").agg(*counts(F.lit(True), "n"), *counts(bare, "m"))
    asked = entries.select(*alike).distinct()
    named = classes.select("block", F.struct(F.lit(None).cast("string").alias("doi"), "year", "authors", "title_sets").alias("w"), *(c for c in classes.columns if c[:1] in "nm"))
    no_doi = lambda c: F.lit(None).cast("string") if c == "doi" else F.col(c)
    pairs = asked.join(named.hint("merge"), "block").where(entry_matches(no_doi, lambda c: F.col(f"w.{c}")))
    matched = pairs.groupBy(*alike).agg(*(f(c).alias(c) for n in "nm" for f, c in ((F.sum, n), (F.min, f"{n}_first"), (F.max, f"{n}_last"))))
    matched = cut(matched, "matched-entries")

    # DOIs that are the beginning of one another, or equal
    begins = lambda rows, name, less: rows.where(F.length("doi") >= less).select("block", F.col("doi").alias(name), F.explode(F.sequence(F.lit(0), F.length("doi") - less)).alias("l"))
    own, other = (x.where("doi is not null").select("block", "doi").distinct() for x in (entries, works))
    longer = begins(other, "w_doi", 0).withColumn("doi", F.substring("w_doi", F.lit(1), F.col("l"))).join(own.hint("merge"), ["block", "doi"]).select("block", "doi", "w_doi")
    shorter = begins(own, "doi", 1).withColumn("w_doi", F.substring("doi", F.lit(1), F.col("l"))).join(other.withColumnRenamed("doi", "w_doi").hint("merge"), ["block", "w_doi"]).select("block", "doi", "w_doi")
    near = entries.join(longer.union(shorter).hint("merge"), ["block", "doi"]).join(works.select("block", F.col("doi").alias("w_doi"), "path", F.struct("doi", "year", "authors", "title_sets").alias("w")).hint("merge"), ["block", "w_doi"])
    near = near.where(F.col("path") != F.col("from_path")).where(entry_matches(lambda c: F.col(c), lambda c: F.col(f"w.{c}"))).select("entry_id", F.lit(1).alias("n"), F.col("path").alias("found"))

    side = matched.select(*(F.col(c).alias(f"_{c}") for c in alike), *(c for c in matched.columns if c not in alike))
    rows = entries.join(side.hint("merge"), (F.col("block") == F.col("_block")) & F.col("text_words").eqNullSafe(F.col("_text_words")) & F.col("et_al").eqNullSafe(F.col("_et_al")) & (F.col("year") == F.col("_year")) & (F.col("authors") == F.col("_authors")))
    n, first, last = (F.when(bare, F.col(f"n{x}")).otherwise(F.col(f"m{x}")) for x in ("", "_first", "_last"))
    left = F.filter(F.when(n == 1, F.array(first)).when(n == 2, F.array(first, last)).otherwise(F.array().cast("array<string>")), lambda p: p != F.col("from_path"))
    rows = rows.select("entry_id", F.when(n > 2, F.lit(2)).otherwise(F.size(left)).alias("n"), F.try_element_at(left, F.lit(1)).alias("found"))
    return rows.unionByName(near).groupBy("entry_id").agg(F.sum("n").alias("n"), F.max("found").alias("found")).where("n = 1").select("entry_id", "found")


def same_work(candidates: DataFrame) -> DataFrame:
    """(entry_id, work_id): of candidates(entry_id, work_id, title_words, text_words, n, ord)
    whose titles overlap the entry enough, the most cited if all have the first one's title,
    else null. Words come with the candidates, made once for each title and text before
    they were joined."""
    fit = candidates.where(title_overlap(F.col("title_words"), F.col("text_words")) >= MIN_TITLE_OVERLAP).drop("text_words")
    first = F.first("title_words").over(Window.partitionBy("entry_id").orderBy("ord"))
    scored = fit.withColumn("head", first)
    mutual = F.least(title_overlap(F.col("title_words"), F.col("head")), title_overlap(F.col("head"), F.col("title_words"))) >= SAME_WORK
    best = F.max_by("work_id", F.struct("n", -F.col("ord")))
    return scored.groupBy("entry_id").agg(F.when(F.min(mutual), best).alias("work_id"))


def doi_groups(works: DataFrame) -> DataFrame:
    """(doi, paths) of DOIs that two or more works(path, doi) share."""
    return works.where("doi is not null").groupBy(F.lower("doi").alias("doi")).agg(F.sort_array(F.collect_list("path")).alias("paths")).where(F.size("paths") >= 2)


def title_classes(works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of works(path, ord, doi, first_author, year, title) with author, year and title
    words: (path, ord, has_doi, block, node), where node is the earliest work of the block
    with the same words that, like the work, has a DOI or none; and the links (block, a,
    b, a_ord, b_ord) between nodes whose titles are the same, never two with DOIs.

    Copies of a title are compared once, however many there are."""
    block = F.concat_ws("|", "first_author", "year")
    rows = works.where("first_author <> '' and year is not null").select("path", F.struct("ord", "path").alias("ord"), F.col("doi").isNotNull().alias("has_doi"), block.alias("block"), F.sort_array(title_words(F.col("title"))).alias("words"))
    rows = cut(rows.where("size(words) > 0"), "titles")
    alike = ["block", "words", "has_doi"]
    nodes = cut(rows.groupBy(*alike).agg(F.min("ord").alias("first")), "titles")
    texts = nodes.select("block", F.struct("has_doi", F.col("first.path").alias("path")).alias("text"), F.col("first").alias("ord"), "words")
    links = mutual_pairs(texts, SAME_TITLE).where("not (a.has_doi and b.has_doi)").select("block", F.col("a.path").alias("a"), F.col("b.path").alias("b"), "a_ord", "b_ord")
    return rows.join(nodes, alike).select("path", "ord", "has_doi", "block", F.col("first.path").alias("node")), links


def title_pairs(works: DataFrame) -> DataFrame:
    """(a, b) of works(path, ord, doi, first_author, year, title) of one block with the
    same title both ways, never two that both have DOIs; a comes first."""
    rows, links = title_classes(works)
    a, b = (rows.select(F.col("node").alias(c), F.col("ord").alias(f"{c}_row")) for c in "ab")
    across = links.select("a", "b").join(a, "a").join(b, "b").select(F.least("a_row", "b_row").alias("a"), F.greatest("a_row", "b_row").alias("b"))
    plain = rows.where("not has_doi").select("node", "ord")
    inside = plain.alias("a").join(plain.alias("b"), (F.col("a.node") == F.col("b.node")) & (F.col("a.ord") < F.col("b.ord"))).select(F.col("a.ord").alias("a"), F.col("b.ord").alias("b"))
    return across.union(inside).select("a.path", "b.path").toDF("a", "b")


def duplicate_members(works: DataFrame) -> DataFrame:
    """(path, grp, reason), a row for each work that is in a group: those that share a
    DOI (grp is the DOI), and of the rest, stars by title (grp is the work in the middle). In
    order, a work that is in no group yet takes all later ones of its block with its title.

    No group is ever held by one task, whatever its size."""
    shared = works.where("doi is not null").select("path", F.lower("doi").alias("grp"))
    many = shared.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    by_doi = shared.join(many, "grp").select("path", "grp", F.lit("doi").alias("reason"))
    rows, links = title_classes(works.join(by_doi.select("path"), "path", "left_anti"))
    taken = first_leaders(links).select("node", "leader")
    # of a title's copies with DOIs, the first alone can be in the middle
    placed = rows.join(taken, "node", "left").where("leader is not null or not has_doi or path = node").select("path", F.coalesce("leader", "node").alias("grp"))
    stars = cut(placed, "stars")
    big = stars.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return by_doi.union(stars.join(big, "grp").select("path", "grp", F.lit("title").alias("reason")))


def duplicate_groups(works: DataFrame) -> DataFrame:
    """(paths, reason): the groups of duplicate_members, each as a sorted array, to be
    shown; groups too large for a row are read from duplicate_members."""
    return duplicate_members(works).groupBy("grp", "reason").agg(F.sort_array(F.collect_list("path")).alias("paths")).select("paths", "reason")


def book_of_part(parts: DataFrame, books: DataFrame) -> DataFrame:
    """(doi, path): the one book (path, isbns) that has an ISBN of a part's DOI."""
    wanted = parts.select("doi", F.explode(isbns_in(F.col("doi"))).alias("isbn"))
    owned = books.select("path", F.explode("isbns").alias("isbn"))
    found = wanted.join(owned, "isbn").groupBy("doi").agg(F.countDistinct("path").alias("n"), F.min("path").alias("path"))
    return found.where("n = 1").select("doi", "path")


def resolve_targets(links: DataFrame, notes: DataFrame, dois: DataFrame) -> DataFrame:
    """links(link_id, note, doi) -> (link_id, kind, path, doi): by note path, else
    by DOI to a note, else the DOI, else broken."""
    by_note = notes.select(F.col("path").alias("note"), F.col("path").alias("by_note"))
    owners = dois.groupBy("doi").agg(F.min_by("path", "ord").alias("by_doi"))
    path = F.coalesce("by_note", "by_doi")
    kind = F.when(path.isNotNull(), "note").when(F.col("doi").isNotNull(), "doi").otherwise("broken")
    return links.join(by_note, "note", "left").join(owners, "doi", "left").select("link_id", kind.alias("kind"), path.alias("path"), F.when(path.isNull(), F.col("doi")).alias("doi"))
