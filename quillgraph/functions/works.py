"""Expressions about works: names, labels, what a note says of its work, and its values
for a template. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions import text as X

#: Words that belong to a surname when they come before it.
PARTICLES = "van von der den de del della di da du des dos das le la ter ten st. saint al el bin ibn".split(" ")
#: Kinds of works and their names in English and French.
TYPES = {
    "article": ("Article", "Article"), "review": ("Article", "Article"), "letter": ("Article", "Article"), "book": ("Book", "Livre"),
    "book-chapter": ("Chapter", "Chapitre"), "dissertation": ("Thesis", "Thèse"), "report": ("Report", "Rapport"), "preprint": ("Preprint", "Prépublication"),
}
#: How far a note's own DOI is looked for, how much of its text is read
#: for meaning, and from which lengths on an outside work's text is reliable.
OWN_DOI_WITHIN, NOTE_TEXT, ABSTRACT, GHOST = 5000, 200_000, 200, 300


def surname(full_name: Column) -> Column:
    """The last word of a name with the particles before it, never the first word."""
    words = F.filter(F.split(F.trim(full_name), r"\s+"), lambda w: w != "")
    n = F.size(words)
    middle = F.reverse(F.when(n > 2, F.slice(words, F.lit(2), n - 2)).otherwise(F.array().cast("array<string>")))
    particle = lambda w: F.lower(w).isin(*PARTICLES)
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("go"))
    step = lambda a, w: F.struct((a["n"] + (a["go"] & particle(w)).cast("int")).alias("n"), (a["go"] & particle(w)).alias("go"))
    before = F.aggregate(middle, start, step, lambda a: a["n"])
    return F.when(n > 0, F.array_join(F.slice(words, n - before, before + 1), " ")).otherwise(full_name)


def with_initials(full_name: Column) -> Column:
    """Family, I. J.; the family name alone without given names."""
    family = surname(full_name)
    name = F.trim(full_name)
    given = X.initials(F.substring(name, F.lit(1), F.greatest(F.lit(0), F.length(name) - F.length(family))))
    return F.when(given != "", F.concat(family, F.lit(", "), given)).otherwise(family)


def work_label(authors: Column, year: Column, title: Column, language: str = "en") -> Column:
    """A, 2001 / A & B, 2001 / A et al., 2001; without authors the title's beginning."""
    names = F.transform(authors, surname)
    return F.when(F.size(names) > 0, X.citation_label(names, year, language)).otherwise(F.concat(F.substring(title, 1, 40), F.lit(", "), X.year_or_none(year, language)))


def entry_label(first_author: Column, authors: Column, et_al: Column, year: Column, text: Column, language: str = "en") -> Column:
    """The label of a reference entry; the second name as the entry writes it."""
    first, y = F.coalesce(first_author, F.lit("?")), X.year_or_none(year, language)
    second = F.try_element_at(F.filter(F.split(text, r"[\s,;&.()*_]+"), lambda t: (F.length(t) > 1) & (X.name_key(t) == F.try_element_at(authors, F.lit(2)))), F.lit(1))
    both = F.when((F.size(authors) == 2) & second.isNotNull(), F.concat(first, F.lit(" et " if language == "fr" else " & "), second))
    return F.concat(F.when(et_al | (F.size(authors) >= 3), F.concat(first, F.lit(" et al."))).otherwise(F.coalesce(both, first)), F.lit(", "), y)


def localized(text: Column, language: str = "en") -> Column:
    """A stored citation in the language: its "and" and its "no date"."""
    if language == "fr":
        return F.regexp_replace(F.regexp_replace(text, " (?:&|and) ", " et "), r"\bn\.d\.", "s.d.")
    return F.regexp_replace(F.regexp_replace(text, r" et (?!al\.)", " & "), r"\bs\.d\.", "n.d.")


def citation_text(stored: Column, authors: Column, year: Column, basename: Column, *, language: str = "en", by_name: bool = False) -> Column:
    """A note's label: its stored citation, else its authors and year, else its name."""
    if by_name:
        return basename
    own = F.trim(F.regexp_replace(F.trim(F.coalesce(stored, F.lit(""))), r"^\((.*)\)$", "$1"))
    families = X.family_names(F.coalesce(authors, F.lit("")))
    built = X.citation_label(families, F.nullif(F.trim(F.coalesce(year, F.lit(""))), F.lit("")), language)
    return F.when(own != "", localized(own, language)).when(F.size(families) > 0, built).otherwise(basename)


def own_doi(stored: Column, text: Column) -> Column:
    """A note's DOI: its property, else the first resolver URL near its start and before
    any reference heading."""
    lines = F.split(F.substring(text, 1, OWN_DOI_WITHIN), "\n")
    heading = r"^#{1,6}\s+(.*)$"
    at = F.array_position(F.transform(lines, lambda x: x.rlike(heading) & X.is_reference_heading(F.regexp_extract(x, heading, 1))), True)
    before = F.array_join(F.when(at > 0, F.slice(lines, F.lit(1), (at - 1).cast("int"))).otherwise(lines), "\n")
    found = F.regexp_extract(before, r"""(?i)doi\.org/(10\.[0-9]{4,9}/[^\s)\]>"']+)""", 1)
    return F.when(F.trim(F.coalesce(stored, F.lit(""))) != "", X.normalize_doi(stored)).when(found != "", X.normalize_doi(F.regexp_replace(found, r"[.,;]+$", "")))


def author_keys(authors: Column) -> Column:
    """Comparable family names of an authors property; initials alone are dropped."""
    parts = F.filter(F.split(F.coalesce(authors, F.lit("")), r"\s*[,;]\s*"), lambda p: (p != "") & ~p.rlike(r"^(\p{Lu}\.?[\s.-]*)+$"))
    return F.filter(F.transform(parts, X.name_key), lambda k: k != "")


def listed(value: Column) -> Column:
    """A property's list, or comma-separated text, as trimmed items."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")


def work_keywords(own: Column, external: Column) -> Column:
    """A note's keywords if it has any, else the external ones."""
    return F.when(F.size(own) > 0, own).otherwise(F.coalesce(external, F.array().cast("array<string>")))


def note_text(title: Column, keywords: Column, body: Column) -> Column:
    """Title, keywords and body (without frontmatter and references), up to NOTE_TEXT."""
    return F.substring(F.concat_ws("\n", title, F.array_join(keywords, " "), body), 1, NOTE_TEXT)


def outside_text(title: Column, topics: Column, keywords: Column, abstract: Column, ghost: Column) -> Column:
    """What is known of a work outside: its parts by line; missing ones are left out."""
    parts = F.array(title, F.array_join(topics, " "), F.array_join(keywords, " "), abstract, ghost)
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n")


def reliable(abstract: Column, ghost: Column) -> Column:
    """Whether there is enough text for a meaning: of an abstract, or of a note body
    without frontmatter and headings."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(ghost, F.lit("")), r"(?s)^---\n.*?\n---\n?", ""), r"(?m)^#{1,6}\s.*$", "")
    return (F.length(F.coalesce(abstract, F.lit(""))) >= ABSTRACT) | (F.length(F.trim(bare)) >= GHOST)


def property_text(value: Column) -> Column:
    """A property (list or text) as searched text."""
    return F.lower(F.coalesce(F.array_join(value, " "), F.lit("")))


def graph_filter(query: str, label: Column, title: Column) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", label, title)), F.lit(query.strip().lower()))


def max_nodes(setting: Column) -> Column:
    """The node limit of a setting: 3000 if it's no number, none (null) if it's 0 or
    less, at least 100."""
    number = setting.try_cast("double")
    odd = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(odd, F.lit(3000.0)).when(number > 0, F.greatest(F.lit(100.0), number))


def values_of_details(language: str = "en") -> dict[str, Column]:
    """A template's values of rows with a work's details."""
    c = F.col
    fr = language == "fr"
    text = lambda name: F.coalesce(c(name), F.lit(""))
    year = F.coalesce(c("year").cast("string"), F.lit(""))
    families, full = F.transform("authors", surname), F.transform("authors", with_initials)
    pages = F.when(c("first_page").isNull() | (c("first_page") == ""), "").when(c("last_page").isNotNull() & (c("last_page") != "") & (c("last_page") != c("first_page")), F.concat("first_page", F.lit("-"), "last_page")).otherwise(c("first_page"))
    book = F.coalesce(c("type").isin("book", "dissertation", "report"), F.lit(False))
    citation = X.in_text_citation(families, F.nullif(year, F.lit("")), language)
    some = lambda col: col.isNotNull() & (col != "")
    journal = F.concat(
        F.lit("_"), text("journal"), F.lit("_"), F.when(some(c("volume")), F.concat(F.lit(", _"), c("volume"), F.lit("_"))).otherwise(""),
        F.when(some(c("issue")), F.concat(F.lit("("), c("issue"), F.lit(")"))).otherwise(""), F.when(pages != "", F.concat(F.lit(", "), F.replace(pages, F.lit("-"), F.lit("–")))).otherwise(""), F.lit("."),
    )
    authors = X.reference_authors(full, language)
    parts = F.array(
        F.concat(F.when(authors != "", F.concat(authors, F.lit(" "))).otherwise(""), F.lit("("), X.year_or_none(F.nullif(year, F.lit("")), language), F.lit(").")),
        F.when(book, F.concat(F.lit("_"), c("title"), F.lit("_."))).otherwise(F.concat(c("title"), F.lit("."))),
        F.when(~book & some(c("journal")), journal).when(some(c("publisher")), F.concat(c("publisher"), F.lit("."))),
        F.when(some(c("doi")), F.concat(F.lit("https://doi.org/"), c("doi"))).when(some(c("open_access_url")), c("open_access_url")),
    )
    kind = F.lit("")
    for name, (en, other) in reversed(TYPES.items()):
        kind = F.when(c("type") == name, other if fr else en).otherwise(kind)
    return {
        "title": c("title"), "citationText": citation, "citation": F.array_join(parts, " "), "authors": F.array_join(full, ", "), "year": year, "type": kind,
        "journal": F.when(book, "").otherwise(text("journal")), "volume": text("volume"), "issue": text("issue"), "pages": pages, "publisher": text("publisher"), "issn": text("issn"),
        "doi": text("doi"), "url": F.when(some(c("doi")), "").otherwise(F.coalesce("open_access_url", "pdf_url", F.lit(""))), "language": text("language"), "abstract": text("abstract"),
        "topics": F.array().cast("array<string>"), "keywords": F.array().cast("array<string>"), "fileName": X.file_name(citation),
    }


def values_of_entry(text: Column, title: Column, label: Column, year: Column) -> dict[str, Column]:
    """The values of a work known only from a reference list: the rest is empty."""
    own = {"title": title, "citationText": F.concat(F.lit("("), label, F.lit(")")), "citation": text, "year": year, "fileName": X.file_name(F.concat(F.lit("("), label, F.lit(")")))}
    empty = ("authors", "type", "journal", "volume", "issue", "pages", "publisher", "issn", "doi", "url", "language", "abstract")
    lists = {"topics": F.array().cast("array<string>"), "keywords": F.array().cast("array<string>")}
    return own | {k: F.lit("") for k in empty} | lists


def packed(vector: Column) -> Column:
    """A unit vector as base64 of one signed byte a component, 127 times its value."""
    level = lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x * 127 + 0.5))).cast("int")
    return F.base64(F.unhex(F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(F.pmod(level(x), F.lit(256))), 2, "0")), "")))


def unpacked(packed_: Column) -> Column:
    """The vector again, of unit length; null if it is zero."""
    byte = lambda x: F.conv(x, 16, 10).cast("int")
    levels = F.transform(F.regexp_extract_all(F.hex(F.unbase64(packed_)), F.lit(".."), F.lit(0)), lambda x: F.when(byte(x) > 127, byte(x) - 256).otherwise(byte(x)).cast("double"))
    # the size goes along as the fold's result, so that the levels are read once
    scaled = lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)))
    return F.transform(F.array(levels), lambda v: F.when(F.exists(v, lambda x: x != 0), scaled(v)))[0]


def with_keywords(text: Column, key: str, names: Column) -> tuple[Column, Column]:
    """(text, status) of a note that gets keywords: status is kept where the note's
    property holds some already, none where there are none to write, else written, and
    then the text has them as a list under the property, in the case the note uses. A
    note without frontmatter gets one. A null text is an empty one; a null list is none.

    The frontmatter is what stands between a first line of --- and the next one."""
    text = F.coalesce(text, F.lit(""))
    end = F.locate("\n---", text, 4)
    has = text.startswith("---\n") & (end > 0)
    inner = F.when(end > 4, F.substring(text, F.lit(5), end - 5)).otherwise("")
    lines = F.when(has & (inner != ""), F.split(inner, "\n", -1)).otherwise(F.array().cast("array<string>"))
    at = F.array_position(F.transform(lines, lambda x: F.lower(F.regexp_extract(x, r"^([^\s:#-][^:]*?)\s*:", 1)) == key.lower()), True).cast("int")
    line = F.when(at > 0, F.element_at(lines, F.when(at > 0, at).otherwise(1)))
    after = F.when((at > 0) & (at < F.size(lines)), F.element_at(lines, F.when((at > 0) & (at < F.size(lines)), at + 1).otherwise(1)))
    filled = ~line.rlike(r"^[^:]*:\s*(\[\s*\]|\"\s*\"|'\s*'|null|~)?\s*$") | F.coalesce(after.rlike(r"^\s*-\s+\S"), F.lit(False))
    names = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n.isNotNull() & (F.trim(n) != ""))
    status = F.when(F.coalesce(filled, F.lit(False)), "kept").when(F.size(names) == 0, "none").otherwise("written")
    plain = lambda n: n.rlike(r"^[\p{L}\p{N}][\p{L}\p{N} ._/()+-]*$") & ~n.rlike(r"(?i)^(true|false|null|yes|no|[0-9._+-]+)$|\s$")
    escaped = lambda n: F.replace(F.replace(n, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    items = F.transform(names, lambda n: F.concat(F.lit("  - "), F.when(plain(n), n).otherwise(F.concat(F.lit('"'), escaped(n), F.lit('"')))))
    own = F.coalesce(F.regexp_extract(line, r"^([^:]*?)\s*:", 1), F.lit(key))
    block = F.concat(F.array(F.concat(own, F.lit(":"))), items)
    before = F.when(at > 0, F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(lines)
    rest = F.when((at > 0) & (at < F.size(lines)), F.slice(lines, F.greatest(at + 1, F.lit(1)), F.size(lines))).otherwise(F.array().cast("array<string>"))
    head = F.concat(F.lit("---\n"), F.array_join(F.concat(before, block, rest), "\n"))
    tail = F.when(has, F.substring(text, end, F.length(text))).otherwise(F.concat(F.lit("\n---\n"), text))
    return F.when(status == "written", F.concat(head, tail)).otherwise(text), status
