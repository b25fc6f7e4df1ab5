"""The note scanners: what is written from fields is read back as these fields, among noise."""

import random
import string
from urllib.parse import quote

import pytest

from quillgraph.functions import notes as N

FAMILIES = ["Quill", "Øster", "Žižek", "MacArdle", "Okonkwo", "Petit-Jean", "Nguyễn", "Сорокин", "Παππάς", "Iturbe"]
WORDS = "glacier tariff lantern harbour membrane viaduct orchard syllable turbine ledger quartz monsoon".split()


def phrase(rng, n):
    return " ".join(rng.choices(WORDS, k=n)).capitalize()


def reference(rng, authors, year, doi=None, style=0):
    """One reference as people write it, in one of several styles."""
    names = [f"{f}, {rng.choice(string.ascii_uppercase)}." if style != 2 else f"{f} {rng.choice(string.ascii_uppercase)}" for f in authors]
    listed = names[0] if len(names) == 1 else ", ".join(names[:-1]) + (", & " if style == 1 else ", ") + names[-1]
    dated = f"({year})." if style != 2 else f"{year}."
    tail = f" https://doi.org/{doi}" if doi else ""
    return f"{listed} {dated} {phrase(rng, 6)}. {phrase(rng, 2)}, {rng.randint(1, 90)}, {rng.randint(1, 400)}.{tail}"


@pytest.mark.parametrize("style", [0, 1, 2])
def test_references_are_read_back(style):
    rng = random.Random(style)
    for _ in range(60):
        authors = rng.sample(FAMILIES, rng.randint(1, 4))
        year = str(rng.randint(1890, 2024))
        doi = f"10.{rng.randint(1000, 99999)}/{rng.choice(WORDS)}.{rng.randint(1, 999)}" if rng.random() < 0.5 else None
        entry = N.parse_entry(reference(rng, authors, year, doi, style))
        assert (entry.first_author, entry.year, entry.doi) == (authors[0], year, doi)
        assert entry.authors == [N.name_key(a) for a in authors] and not entry.et_al


def test_open_author_lists_and_short_lines():
    rng = random.Random(9)
    cut = N.parse_entry(f"Okonkwo, B., Iturbe, L., et al. (1977). {phrase(rng, 7)}. {phrase(rng, 2)}, 3.")
    assert cut.et_al and cut.authors[:2] == ["okonkwo", "iturbe"]
    assert N.parse_entry("Okonkwo 1977") is None and N.parse_entry("") is None


@pytest.mark.parametrize("mark", ["- ", "* ", "+ ", "1. ", "12) ", "[3] "])
def test_list_marks_are_no_part_of_an_entry(mark):
    rng = random.Random(5)
    line = reference(rng, ["Iturbe", "Quill"], "2009")
    plain, marked = N.parse_entry(line), N.parse_entry(mark + line)
    assert (marked.first_author, marked.year, marked.authors) == (plain.first_author, plain.year, plain.authors)


NAMES = ["references", "bibliography", "works cited", "literature cited", "bibliographie", "références"]


@pytest.mark.parametrize("name", NAMES)
def test_headings_in_any_dress(name):
    for dress in ("{}", "{}:", "**{}**", "*{}*", "__{}__", "4. {}", "2.3 {}", "<b>{}</b>"):
        for cased in (name, name.upper(), name.capitalize()):
            assert N.is_reference_heading(dress.format(cased)), dress.format(cased)


@pytest.mark.parametrize("text", ["", "**", "Methods", "References to light in the novels", "On bibliography"])
def test_other_headings(text):
    assert not N.is_reference_heading(text)


def a_note(rng, entries, heading):
    """Prose with years and names, a reference section, and a section after it."""
    prose = [f"in what {rng.choice(FAMILIES)} ({rng.randint(1900, 2020)}) holds that {phrase(rng, 9).lower()}." for _ in range(4)]
    return ["# " + phrase(rng, 3), "", *prose, "", heading, "", *entries, "", "## Appendix", "", *prose]


def test_sections_hold_their_entries_only():
    rng = random.Random(3)
    for heading in ("## References", "## Bibliographie", "### 7. Works cited:"):
        keys = [(rng.choice(FAMILIES), str(rng.randint(1900, 2020))) for _ in range(12)]
        lines = a_note(rng, ["- " + reference(rng, [f], y, style=rng.randint(0, 2)) for f, y in keys], heading)
        found = N.bibliography("\n".join(lines))
        assert [(e.first_author, e.year) for e in found] == keys
        assert [lines[e.line] for e in found] == [x for x in lines if x.startswith("- ")]
        rest = N.without_lines("\n".join(lines), [e.line for e in found])
        assert not any(reference_line in rest for reference_line in lines if reference_line.startswith("- ")) and "Appendix" in rest


def test_lists_without_a_heading_count_from_some_length_on():
    rng = random.Random(8)
    lines = [reference(rng, [f], str(1950 + i)) for i, f in enumerate(FAMILIES)]
    assert [e.year for e in N.bibliography("\n".join(["Some words first.", "", *lines]))] == [str(1950 + i) for i in range(len(lines))]
    assert N.bibliography("\n".join(["Some words first.", "", *lines[:2]])) == []


def test_an_entry_goes_on_in_the_next_item_if_that_is_none():
    rng = random.Random(2)
    first, second = reference(rng, ["Quill"], "1999"), reference(rng, ["Iturbe"], "2001")
    head, _, tail = first.rpartition(". ")
    found = N.bibliography(f"## References\n\n- {head}\n- {tail.lower()}\n- {second}\n")
    assert [e.year for e in found] == ["1999", "2001"]


def test_family_names_in_both_orders():
    for family in FAMILIES:
        for written in (f"{family} K", f"{family} K. L.", f"K. {family}", f"K. L. {family}", family):
            assert N.family_of(written) == family, written


def test_escaped_dois():
    for doi in ("10.5555/s0301-4797(02)00005-7", "10.5555/a_b;c", "10.5555/plain"):
        escaped = "".join("\\" + c if c in "()_;" else c for c in doi)
        assert N.unescape_doi(escaped) == doi


def test_citation_urls_round_trip():
    rng = random.Random(4)
    odd = "%&=#?()[] é中,;'\"+"
    for _ in range(80):
        fields = {"note": "".join(rng.choices(string.ascii_letters + odd, k=9)).strip() or "n", "q": "".join(rng.choices(string.ascii_letters + odd, k=14)).strip() or "q"}
        if rng.random() < 0.5:
            fields["qe"] = phrase(rng, 3)
        if rng.random() < 0.5:
            fields["occ"] = rng.randint(1, 9)
        url = "obsidian://cite?" + "&".join(f"{k}={quote(str(v), safe='')}" for k, v in rng.sample(list(fields.items()), len(fields)))
        assert N.parse_citation_url(url) == fields
    for other in ("", "obsidian://open?note=x", "http://cite?note=x", "note=x"):
        assert N.parse_citation_url(other) is None


def test_unescaped_values_are_taken_as_they_stand():
    assert N.parse_citation_url("obsidian://cite?note=n&q=60% of (most) lanterns")["q"] == "60% of (most) lanterns"
    # what a protocol handler has split at & is put together again
    assert N.citation_params({"note": "n", "q": "salt", "pepper": "true"})["q"] == "salt&pepper"


def test_links_among_noise():
    rng = random.Random(6)
    noise = ["plain words", "a [bracket] alone", "(see)", "![image](x.png)", "`code`", "x](y"]
    for _ in range(40):
        urls = [f"obsidian://cite?note={quote(phrase(rng, 2))}&q={quote(phrase(rng, 3))}" for _ in range(rng.randint(1, 3))]
        line = " ".join(f"{rng.choice(noise[:3])} [{phrase(rng, 1)}, {1990 + i}]({'<' + u + '>' if rng.random() < 0.3 else u}) and" for i, u in enumerate(urls))
        assert [x.url for x in N.markdown_links(line) if x.url.startswith("obsidian")] == urls
        for x in N.markdown_links(line):
            assert line[x.start] == "[" and line[x.start + 1 :].startswith(x.text)


def test_fenced_lines_are_code():
    link = "[x](obsidian://cite?note=x)"
    for fence in ("```", "~~~", "````"):
        note = "\n".join([link, fence + "md", link, fence, link, fence, link])
        assert [x["line"] for x in N.citation_links(note)] == [0, 4]


def test_hostile_texts_end():
    for text in ("[" * 20_000, "(" * 20_000, "- " * 20_000, "a," * 20_000, "](" * 20_000, "10." * 20_000):
        N.markdown_links(text)
        N.bibliography("## References\n- " + text)


def test_name_keys_agree_with_the_expression(spark):
    from pyspark.sql import functions as F

    from quillgraph.functions import text as X
    from quillgraph.plans.text import SCRIPTS

    names = [n for n, _ in SCRIPTS] + ["İstanbul", "ĳssel", "㎏", "Ǆ", "½x", "Ω", "한글", "ａ１", "𝐀𝐛", "ß", "", "néé"]
    got = [r.k for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(X.name_key(F.col("n")).alias("k")).collect()]
    assert got == [N.name_key(n) for n in names] and got[: len(SCRIPTS)] == [k for _, k in SCRIPTS]


def test_fingerprints_tell_texts_apart():
    rng = random.Random(1)
    texts = {phrase(rng, 5) for _ in range(300)} | {"", " "}
    assert len({N.fingerprint(t) for t in texts}) == len(texts) and all(len(N.fingerprint(t)) == 8 for t in texts)


def test_frontmatter_and_templates_round_trip():
    rng = random.Random(7)
    for _ in range(30):
        values = {"title": f"{phrase(rng, 2)}: {phrase(rng, 1)} \"x\"", "authors": rng.sample(FAMILIES, rng.randint(1, 3)), "year": rng.randint(1900, 2020), "doi": None}
        out = N.fill_template("---\ntitle: {{title}}\nauthors: {{authors}}\nyear: {{year}}\ndoi: {{doi}}\n---\n# {{title}}\n", values)
        read, body = N.frontmatter(out)
        assert read["title"] == values["title"] and read["authors"] == values["authors"] and read["year"] == str(values["year"])
        assert N.frontmatter(f"---\nauthors: [{', '.join(chr(39) + a + ', x' + chr(39) for a in values['authors'])}]\n---\n")[0]["authors"] == [a + ", x" for a in values["authors"]]
        assert not read.get("doi") and body.strip() == "# " + values["title"]
