"""Names of the regions of a map in one call: a keyword near the region's meaning, else
the topic of many of its works, else its most typical term; below it topic and terms.

Names are dealt out in rounds of aggregations, so nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.lineage import cut
from quillgraph.operators.maps import region_meanings
from quillgraph.operators.meaning import region_topics

#: A term's least share of its region's works with terms, the terms below a
#: name, what a term of several words counts, a term's greatest share of all works.
TERM_COVERAGE, TERMS, PHRASE, MAX_SHARE = 0.05, 3, 1.5, 0.1


def spelled(term: Column) -> Column:
    """As names are shown: trimmed, with a capital."""
    bare = F.trim(term)
    return F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, 2, 2**31 - 1))


def term_key(term: Column) -> Column:
    return F.lower(F.trim(term))


def deal_names(candidates: DataFrame) -> DataFrame:
    """(grp, name, score): of candidates(grp, name, score), each once, the best first,
    each group and each name once. Ties go by name, then by group.

    A candidate that is the best of its group and of its name is dealt, as nothing better
    can take either; then both are out. A round deals at least the best candidate of all,
    mostly one in every few, and there are at most as many rounds as groups."""
    rest = cut(candidates.where("grp is not null and name is not null and score is not null").select((-F.col("score")).alias("cost"), "name", "grp"), "names")
    rounds = []
    while not rest.isEmpty():
        best = lambda by: rest.groupBy(F.col(by).alias("by")).agg(F.min(F.struct("cost", "name", "grp")).alias("c")).select("c")
        dealt = cut(best("grp").join(best("name"), "c", "left_semi").select("c.*"), "dealt")
        rounds.append(dealt)
        rest = cut(rest.join(F.broadcast(dealt.select("grp")), "grp", "left_anti").join(F.broadcast(dealt.select("name")), "name", "left_anti").select("cost", "name", "grp"), "names")
    out = rest
    for dealt in rounds:
        out = out.unionByName(dealt)
    return out.select("grp", "name", (-F.col("cost")).alias("score"))


def typical_terms(works: DataFrame, terms: DataFrame) -> DataFrame:
    """(grp, term, score) of works(id, grp; null grp: in no region) and terms(id, term),
    terms as keys: (share of the region's terms) ln(1 + mean region / uses everywhere).
    Terms of fewer than two works or 5 % of the region's works with terms say nothing, nor
    do those of more than a tenth of all works (1.5 regions' worth where that is more)."""
    own = cut(terms.where(F.length("term") > 2).distinct().join(works.select("id", "grp"), "id"), "terms")
    placed = own.where("grp is not null")
    per = placed.groupBy("grp", "term").agg(F.count(F.lit(1)).alias("c"))
    per = cut(per, "terms")
    size = per.groupBy("grp").agg(F.sum("c").alias("size")).join(placed.groupBy("grp").agg(F.countDistinct("id").alias("with_terms")), "grp")
    uses = per.groupBy("term").agg(F.sum("c").alias("uses"))
    regions = works.agg(F.countDistinct("grp").alias("regions"))
    whole = per.agg(F.sum("c").alias("sizes")).crossJoin(own.agg(F.countDistinct("id").alias("described"))).crossJoin(regions)
    rated = per.join(size, "grp").join(uses, "term").crossJoin(F.broadcast(whole))
    share = F.greatest(F.lit(MAX_SHARE), 1.5 / F.greatest(F.lit(1), F.col("regions")))
    fit = rated.where((F.col("c") >= F.greatest(F.lit(2.0), F.col("with_terms") * TERM_COVERAGE)) & (F.col("uses") <= share * F.col("described")))
    boost = F.when(F.col("term").contains(" "), PHRASE).otherwise(1.0)
    return fit.select("grp", "term", (F.col("c") / F.col("size") * F.log(1 + F.col("sizes") / F.col("regions") / F.col("uses")) * boost).alias("score"))


def repeats(a: Column, b: Column) -> Column:
    """Whether one holds the other; an empty or missing one holds and is in nothing."""
    return F.coalesce((a != "") & (b != "") & (a.contains(b) | b.contains(a)), F.lit(False))


def kept_terms(scores: DataFrame, taken: DataFrame, n: int = TERMS) -> DataFrame:
    """(grp, place, term): the best n terms of scores(grp, term, score) of each group that
    neither repeat one of taken(grp, keys array) nor one kept before. One round a place."""
    rest = scores.join(F.broadcast(taken), "grp", "left").where(~F.exists(F.coalesce("keys", F.array().cast("array<string>")), lambda k: repeats(k, F.col("term")))).select("grp", "term", "score")
    out = None
    for place in range(n):
        rest = cut(rest, "terms")
        best = cut(rest.groupBy("grp").agg(F.min(F.struct((-F.col("score")).alias("cost"), "term")).alias("c")).select("grp", F.lit(place).alias("place"), "c.term"), "kept")
        out = best if out is None else out.unionByName(best)
        chosen = F.broadcast(best.select("grp", F.col("term").alias("kept")))
        rest = rest.join(chosen, "grp").where(~repeats(F.col("kept"), F.col("term"))).drop("kept")
    return out


def region_names(works: DataFrame, keywords: DataFrame, topics: DataFrame, terms: DataFrame, *, topic_coverage: float = 0.3, topic_lift: float = 1.2) -> DataFrame:
    """(grp, title, topic, terms) of each region of works(id, grp, v), with keywords(id,
    keyword), topics(id, topic) and terms(id, term; of titles).

    title is '' where nothing names the region. topic is null where it is the title;
    terms is an array of at most three. Names are shown as the least id spells them. Null
    and blank keywords, topics and terms, and those of ids that aren't works, are nothing;
    a region without named works still has its row. Regions are few (dozens): only one row
    a region is broadcast."""
    named = lambda df, c: df.where(F.trim(c) != "").select("id", F.trim(c).alias(c)).distinct().join(works.select("id"), "id", "left_semi")
    keywords, topics, terms = named(keywords, "keyword"), named(topics, "topic"), cut(named(terms, "term"), "terms")
    regions = works.where("grp is not null").select("grp").distinct()
    titles = deal_names(region_meanings(works, keywords).withColumnRenamed("keyword", "name")).select("grp", F.col("name").alias("title_key"))
    about = region_topics(topics.join(works.select("id", "grp"), "id"), coverage=topic_coverage, lift=topic_lift).where("grp is not null").select("grp", "topic")

    every = keywords.select("id", F.lit(0).alias("source"), F.col("keyword").alias("term")).unionByName(terms.select("id", F.lit(1).alias("source"), "term"))
    shown = cut(every.groupBy(term_key(F.col("term")).alias("key")).agg(F.min(F.struct("id", "source", "term"))["term"].alias("shown"), F.min(F.when(F.col("source") == 0, F.struct("id", "term")))["term"].alias("as_keyword")), "shown")
    base = cut(regions.join(titles, "grp", "left").join(about, "grp", "left").join(shown.select(F.col("key").alias("title_key"), spelled(F.col("as_keyword")).alias("title")), "title_key", "left").select("grp", F.coalesce("title", "topic", F.lit("")).alias("title"), "topic"), "regions")
    taken = base.select("grp", F.array_compact(F.array(term_key(F.col("title")), term_key(F.col("topic")))).alias("keys"))
    kept = kept_terms(typical_terms(works, every.select("id", term_key(F.col("term")).alias("term"))), taken)
    lists = kept.join(shown, kept["term"] == shown["key"]).groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("place", spelled(F.col("shown")).alias("term")))).alias("kept"))
    names = base.join(lists, "grp", "left").withColumn("terms", F.coalesce(F.transform("kept", lambda k: k["term"]), F.array().cast("array<string>")))
    bare = F.col("title") == ""
    first = F.coalesce(F.try_element_at("terms", F.lit(1)), F.lit(""))
    title = F.when(bare, first).otherwise(F.col("title"))
    return names.select("grp", title.alias("title"), F.when(F.col("topic") != title, F.col("topic")).alias("topic"), F.when(bare, F.slice("terms", 2, TERMS)).otherwise(F.col("terms")).alias("terms"))
