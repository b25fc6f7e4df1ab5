"""Text expressions: identifiers, names, titles, tokens, languages, citations.

Everything here is a Column expression, so it stays in the JVM. Spark has no Unicode
normalisation; letters with marks and compatibility forms go by tables that are built
from Unicode's decompositions, and combining marks by a pattern.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decomposed(form: str) -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose decomposition without marks is another one, and those where it
    is none or several. Hangul syllables stay whole."""
    one, many = {}, {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if not unicodedata.decomposition(c) or "\uac00" <= c <= "\ud7a3" or unicodedata.category(c)[0] == "M":
            continue
        plain = "".join(x for x in unicodedata.normalize(form, c) if unicodedata.category(x)[0] != "M")
        if plain != c:
            (one if len(plain) == 1 else many)[c] = plain
    return one, many


_MARKED, _ = _decomposed("NFD")
_SINGLE, _SEVERAL = _decomposed("NFKD")
_SPELLED = "\x02".join(f"{c}\x01{plain}" for c, plain in _SEVERAL.items())

#: Words of English and French that say nothing about a subject.
STOP_WORDS = (
    "the and for are but not you all any can had her was one our out day get has him his how man new now old see two way who "
    "boy did its let put say she too use that with have this will your from they know want been good much some time very when "
    "come here just like long make many more only over such take than them well were what where which while would there their "
    "these those into also then than other about after again under upon each both between through during before above below "
    "could should might must shall being does done doing having however therefore thus within without among although because "
    "figure fig et al data results result study studies used using use based may however les des une est pour par dans "
    "sur avec qui que aux ces ses sont pas plus ete etre cette leur leurs ont ainsi entre comme mais nous vous elle ils elles "
    "dont tout tous toute toutes fait faire peut peuvent sans sous chez vers selon lors aussi donc alors encore tres bien"
).split(" ")
#: Further words that make poor names of groups.
TITLE_STOP_WORDS = "der die das und von mit fur ein eine den dem effect effects case review analysis approach approaches new evidence".split(" ")
#: The commonest small words of two languages.
FUNCTION_WORDS = {
    "en": "the and of to in is for with that are was by this from which be as on it not were have".split(" "),
    "fr": "le la les des une est pour dans avec que qui sur par pas ont aux cette sont du au en se ne il elle".split(" "),
}


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def strip_accents(text: Column) -> Column:
    """Letters without their marks, in any script."""
    bare = F.regexp_replace(F.translate(text, "".join(_MARKED), "".join(_MARKED.values())), r"\p{M}", "")
    return F.when(_ascii(text), text).otherwise(bare)


def plain_letters(text: Column) -> Column:
    """Letters without marks, compatibility forms (ligatures, wide and styled letters)
    as the plain ones. The few texts with a form that stands for several letters are
    rewritten character by character."""
    table = F.str_to_map(F.lit(_SPELLED), F.lit("\x02"), F.lit("\x01"))  # one literal, folded once a plan
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    whole = F.when(F.length(F.translate(text, "".join(_SEVERAL), "")) < F.length(text), spelled).otherwise(text)
    bare = F.regexp_replace(F.translate(whole, "".join(_SINGLE), "".join(_SINGLE.values())), r"\p{M}", "")
    return F.when(_ascii(text), text).otherwise(bare)


def fold(text: Column) -> Column:
    """Lower case without accents, to compare typed text."""
    return F.lower(plain_letters(text))


def name_key(name: Column) -> Column:
    """A family name for comparison: letters only, lower case, no accents."""
    return F.regexp_replace(fold(name), r"[^\p{L}]", "")


def normalize_doi(doi: Column) -> Column:
    """Trimmed, lower case, without resolver (its scheme is optional), then without a
    scheme of its own."""
    bare = F.regexp_replace(F.trim(doi), r"(?i)^(https?://)?(dx\.)?doi\.org/", "")
    return F.lower(F.regexp_replace(bare, r"(?i)^doi:\s*", ""))


def isbns_in(text: Column) -> Column:
    """Distinct 13-digit ISBNs, as digits, in order; hyphens, dots or blanks may stand
    between digits."""
    found = F.regexp_extract_all(text, F.lit(r"97[89](?:[-.\s]?[0-9]){10}"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "[^0-9]", "")))


def title_words(text: Column) -> Column:
    """Words of four letters and more, repeats kept."""
    return F.filter(F.split(fold(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 4)


def title_overlap(title_words_: Column, text_words: Column) -> Column:
    """Share of a title's words in a text, glued ones (one to three letters in front)
    included; repeats count; 0 without words."""
    glued = lambda w: F.exists(text_words, lambda t: t.endswith(w) & (F.length(t) - F.length(w)).between(1, 3))
    hits = F.filter(title_words_, lambda w: F.array_contains(text_words, w) | glued(w))
    return F.when(F.size(title_words_) == 0, F.lit(0.0)).otherwise(F.size(hits) / F.size(title_words_))


def work_key(first_author_key: Column, year: Column, title: Column) -> Column:
    """first|year|three words; null without author, year or two words."""
    words = F.slice(title_words(title), 1, 3)
    return F.when((first_author_key != "") & (year != "") & (F.size(words) >= 2), F.concat(first_author_key, F.lit("|"), year, F.lit("|"), F.array_join(words, " ")))


def tokenize(text: Column) -> Column:
    """Words of three letters and more without stop words, a plural s dropped."""
    words = F.regexp_extract_all(F.lower(strip_accents(text)), F.lit("[a-z]{3,}"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
    plural = lambda w: (F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss")
    return F.transform(kept, lambda w: F.when(plural(w), F.substring(w, 1, F.length(w) - 1)).otherwise(w))


def title_terms(title: Column) -> Column:
    """Words and adjacent pairs of a title, never across punctuation or stop words."""
    parts = F.split(F.lower(strip_accents(title)), r"[,.:;!?()\[\]\"«»]|\s[-–—]\s")
    keep = lambda w: ~w.isin(*STOP_WORDS, *TITLE_STOP_WORDS)

    def of(part: Column) -> Column:
        words = F.regexp_extract_all(part, F.lit("[a-z]{3,}"), F.lit(0))
        pairs = F.arrays_zip(words.alias("w"), F.slice(words, 2, 1_000_000).alias("n"))
        both = F.transform(pairs, lambda p: F.when(keep(p["w"]), F.filter(F.array(p["w"], F.when(keep(p["n"]), F.concat(p["w"], F.lit(" "), p["n"]))), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")))
        return F.flatten(both)

    return F.flatten(F.transform(parts, of))


def language_of(text: Column) -> Column:
    """en or fr by their small words in the first 50,000 characters; empty with fewer
    than 30, or less than 1.5 times the other's."""
    words = F.split(F.lower(F.substring(text, 1, 50_000)), "[^a-zàâçéèêëîïôûùüÿœ]+")
    hits = lambda own: F.size(F.filter(words, lambda w: w.isin(*own)))
    n = {k: hits(own) for k, own in FUNCTION_WORDS.items()}
    first = F.when(n["en"] >= n["fr"], "en").otherwise("fr")
    best, second = F.greatest(*n.values()), F.least(*n.values())
    return F.when((best < 30) | (best < 1.5 * second), "").otherwise(first)


def plain_heading(text: Column) -> Column:
    """A heading without tags (capitals in angle brackets are text), links, emphasis."""
    kept = F.regexp_replace(text, r"<(\p{Lu}+)>", "$1")
    for pattern, by in ((r"<[^<>]*>", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"[*_`]", ""), (r"\{#[^}]*\}\s*$", "")):
        kept = F.regexp_replace(kept, pattern, by)
    return F.trim(kept)


#: Titles of reference sections.
SECTION_TITLE = (
    r"(?iu)^(?:\d+(?:\.\d+)*\.?\s+)?(references(?: cited)?|literature cited|cited literature|works cited|bibliography|bibliographie|references and notes|further readings?|suggested readings?|sources"
    r"|références(?: bibliographiques| citées| directes)?|liste des références|lectures suggérées|lectures complémentaires|literatur(?:verzeichnis)?)\s*:?$"
)


def is_reference_heading(text: Column) -> Column:
    return plain_heading(text).rlike(SECTION_TITLE)


def entry_title(text: Column, year: Column) -> Column:
    """The sentence after an entry's year."""
    plain = text
    for pattern, by in ((r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^<>]*>", ""), (r"[*_]", ""), (r"https?://\S+", "")):
        plain = F.regexp_replace(plain, pattern, by)
    at = F.instr(plain, year)
    rest = F.trim(F.regexp_replace(F.substring(plain, at + F.length(year), F.length(plain)), r"^[a-z]?\s*\)?\s*[.,:;]?\s*", ""))
    sentence = F.regexp_extract(rest, r"^(.+?)(?:\.\s|([?!])\s|$)", 1)
    mark = F.regexp_extract(rest, r"^.+?(?:\.\s|([?!])\s|$)", 1)
    return F.when(year.isNull() | (at == 0), "").otherwise(F.trim(F.concat(sentence, mark)))


def family_names(authors: Column) -> Column:
    """Family names of "Family, I., Family, I.": parts of initials alone are dropped."""
    parts = F.transform(F.split(authors, r"[,;]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (x != "") & ~x.rlike(r"^(\p{Lu}\.[\s-]*)+$|^\p{Lu}$"))


def year_or_none(year: Column, language: str = "en") -> Column:
    return F.coalesce(year.cast("string"), F.lit("s.d." if language == "fr" else "n.d."))


def citation_label(names: Column, year: Column, language: str = "en") -> Column:
    """year / A, year / A & B, year / A et al., year."""
    both = " et " if language == "fr" else " & "
    who = F.when(F.size(names) == 1, F.try_element_at(names, F.lit(1))).when(F.size(names) == 2, F.concat(F.try_element_at(names, F.lit(1)), F.lit(both), F.try_element_at(names, F.lit(2)))).otherwise(F.concat(F.try_element_at(names, F.lit(1)), F.lit(" et al.")))
    y = year_or_none(year, language)
    return F.when(F.size(names) == 0, y).otherwise(F.concat(who, F.lit(", "), y))


def in_text_citation(names: Column, year: Column, language: str = "en") -> Column:
    return F.concat(F.lit("("), citation_label(names, year, language), F.lit(")"))


def initials(given: Column) -> Column:
    """Élisabeth Claire -> É. C.; Jean-Pierre -> J.-P."""
    one = lambda part: F.array_join(F.transform(F.filter(F.split(part, "-"), lambda x: x != ""), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lit("."))), "-")
    return F.array_join(F.transform(F.filter(F.split(F.trim(given), r"\s+"), lambda x: x != ""), one), " ")


def reference_authors(names: Column, language: str = "en") -> Column:
    """An APA author list: the last one after & (et); of more than 20, nineteen and the
    last."""
    last, rest = F.try_element_at(names, F.lit(-1)), F.array_join(F.slice(names, F.lit(1), F.greatest(F.lit(0), F.size(names) - 1)), ", ")
    few = F.concat(rest, F.lit(" et " if language == "fr" else ", & "), last)
    many = F.concat(F.array_join(F.slice(names, 1, 19), ", "), F.lit(", … "), last)
    return F.when(F.size(names) == 0, "").when(F.size(names) == 1, last).when(F.size(names) <= 20, few).otherwise(many)


def file_name(text: Column) -> Column:
    """A note's name: outer parentheses and characters no file may have are cut."""
    out = text
    for pattern, by in ((r"^\(|\)$", ""), (r'[\\/:*?"<>|#^\[\]]', ""), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def fence_parity(is_fence: Column, window) -> Column:
    """Whether a line is inside a code block: an opening fence is inside, a closing one
    is not."""
    return F.sum(is_fence.cast("int")).over(window) % 2 == 1


def property_value(properties: Column, key: str) -> Column:
    """A map's value by key: the exact spelling first, else the first that differs in
    case only."""
    same = F.map_values(F.map_filter(properties, lambda k, v: F.lower(k) == key.lower()))
    return F.coalesce(F.try_element_at(properties, F.lit(key)), F.try_element_at(same, F.lit(1)))


def runs(lines: Column, inside) -> Column:
    """(first, last) of each run of consecutive lines for which inside holds, counted
    from 0. One pass within a row: the lines outside are the bounds of the runs."""
    outside = F.array_compact(F.transform(lines, lambda x, i: F.when(~F.coalesce(inside(x), F.lit(False)), i)))
    bounds = F.concat(F.array(F.lit(-1)), outside, F.array(F.size(lines)))
    both = F.zip_with(F.slice(bounds, F.lit(1), F.size(bounds) - 1), F.slice(bounds, F.lit(2), F.size(bounds) - 1), lambda a, b: F.struct((a + 1).alias("first"), (b - 1).alias("last")))
    return F.filter(both, lambda r: r["first"] <= r["last"])
