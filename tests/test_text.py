"""Column expressions against plain versions of what they say, over made-up rows."""

import colorsys
import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import geometry as G
from quillgraph.functions import predicates as P
from quillgraph.functions import text as X


def column(spark, values, of, kind="string"):
    """`of` of each value, in one job."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", of(F.col("v")).alias("x")).orderBy("i").collect()]


NOUNS = "valley furnace anchor violin pollen granite saddle candle".split()


def test_tokens_are_long_words_without_stop_words_and_plurals(spark):
    rng = random.Random(1)
    texts, want = [], []
    for _ in range(40):
        words = rng.choices(NOUNS, k=6)
        shown = [rng.choice([w.upper(), w.capitalize(), w, w + "s"]) for w in words]
        texts.append(" ".join(f"{rng.choice(['the', 'of', 'and', 'an', 'is'])} {w}{rng.choice([',', '.', '', '; 42'])}" for w in shown))
        want.append(words)
    assert column(spark, texts, X.tokenize) == want
    assert column(spark, ["", None, "to be or", "Élève à Zürich"], X.tokenize)[-1] == ["eleve", "zurich"]


def test_title_of_an_entry(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(30):
        title, year = " ".join(rng.choices(NOUNS, k=5)).capitalize(), str(rng.randint(1900, 2020))
        rows.append((f"Iturbe, L. ({year}). {title}. Annals of {rng.choice(NOUNS)}s, 3, 4.", year, title))
    df = spark.createDataFrame(rows, "entry string, year string, title string")
    assert all(r.x == r.title for r in df.select("title", X.entry_title(F.col("entry"), F.col("year")).alias("x")).collect())


def test_overlap_of_titles_is_a_share_of_the_title(spark):
    rng = random.Random(3)
    rows = []
    for k in range(len(NOUNS) + 1):
        words = rng.sample(NOUNS, len(NOUNS))
        rows.append((" ".join(words), "Quill 1999 " + " ".join(words[:k]) + " unrelated matter", k / len(NOUNS)))
    df = spark.createDataFrame(rows, "title string, text string, want double")
    for r in df.select("want", X.title_overlap(X.title_words(F.col("title")), X.title_words(F.col("text"))).alias("x")).collect():
        assert r.x == pytest.approx(r.want)


def test_keys_of_works(spark):
    rows = spark.createDataFrame([("quill", "1999", "Granite, Pollen & Other THINGS"), ("quill", "1999", "granite pollen other things at length")], "a string, y string, t string")
    keys = {r.k for r in rows.select(X.work_key(F.col("a"), F.col("y"), F.col("t")).alias("k")).collect()}
    assert len(keys) <= 2 and all(k.startswith("quill|1999|granite") for k in keys)


def test_dois_in_every_form_are_one(spark):
    rng = random.Random(4)
    for _ in range(5):
        doi = f"10.{rng.randint(1000, 9999)}/{rng.choice(NOUNS)}.{rng.randint(1, 99)}"
        forms = [p + rng.choice([doi, doi.upper()]) + rng.choice(["", " "]) for p in ("", "doi:", "DOI: ", "https://doi.org/", "http://dx.doi.org/", "doi.org/")]
        assert set(column(spark, forms, X.normalize_doi)) == {doi}


def test_isbns(spark):
    rng = random.Random(5)
    isbns = [rng.choice(["978", "979"]) + "".join(rng.choices("0123456789", k=10)) for _ in range(20)]
    spaced = [f"{i[:3]}{s}{i[3]}{s}{i[4:8]}{s}{i[8:12]}{s}{i[12]}" for i, s in zip(isbns, ["-", " ", ""] * 7)]
    assert column(spark, [f"ISBN {x} (cloth)" for x in spaced], X.isbns_in) == [[i] for i in isbns]
    assert column(spark, [" and ".join(spaced[:3])], X.isbns_in) == [isbns[:3]]
    assert column(spark, ["977 1 23456 789 0", "978-12", ""], X.isbns_in) == [[], [], []]


def test_names(spark):
    people = [("Okonkwo", "B."), ("Žižek", "S.-P."), ("Petit-Jean", "A."), ("Iturbe", "L. M.")]
    assert column(spark, [", ".join(f"{f}, {i}" for f, i in people)], X.family_names) == [[f for f, _ in people]]
    given = ["Ida", "Ida Ruth", "Ida-Ruth", "élan Vital"]
    by_hand = [" ".join("-".join(p[0].upper() + "." for p in w.split("-")) for w in g.split()) for g in given]
    assert column(spark, given, X.initials) == by_hand


def test_file_names_hold_no_forbidden_characters(spark):
    made = column(spark, [f"a{c}b" for c in '\\/:*?"<>|#^[]'] + ["plain words, 1999"], X.file_name)
    assert all(not re.search(r'[\\/:*?"<>|#^\[\]]', m) for m in made) and made[-1] == "plain words, 1999"


def test_languages_need_enough_words(spark):
    rng = random.Random(6)
    english, french = "the of and to in is that with for".split(), "le la les des une dans est pour avec".split()
    say = lambda words, n: " ".join(rng.choices(words, k=n) + rng.choices(NOUNS, k=n))
    texts = [say(english, 80), say(french, 80), say(english, 6), "", say(english, 60) + " " + say(french, 60)]
    assert column(spark, texts, X.language_of) == ["en", "fr", "", "", ""]


def test_colours_are_those_of_the_standard_library(spark):
    rng = random.Random(7)
    rows = [(float(rng.randrange(360)), rng.random(), rng.random()) for _ in range(60)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h double, s double, l double")
    got = [r.c for r in df.select("i", G.hsl_color(F.col("h"), F.col("s"), F.col("l")).alias("c")).orderBy("i").collect()]
    for (h, s, l), c in zip(rows, got):
        want = [round(255 * x) for x in colorsys.hls_to_rgb(h / 360, l, s)]
        assert all(abs(a - b) <= 1 for a, b in zip(want, c.to_bytes(3, "big")))
    assert column(spark, [0x010203, 0xABCDEF], G.hex_color, "int") == ["010203", "abcdef"]


def test_blends_are_weighted_means(spark):
    rows = spark.createDataFrame([(0x204060, 3), (0x60A0E0, 1)], "c int, w int")
    assert rows.select(G.hex_color(G.blend(F.col("c"), F.col("w"))).alias("x")).first().x == "305880"


NOTES = [("Shelf/anchor.md", "anchor", "On Anchors", ["#sea/iron"], {"State": "Read", "year": "1999"}), ("Drafts/violin.md", "violin", None, [], {}), ("Shelf/deep/pollen.md", "pollen", "Grains", ["#air"], {"state": "open"})]
ASKED = {
    "tag:#SEA": ["anchor"], "tag:#sea/iron": ["anchor"], "tag:#ir": [], "path:shelf/": ["anchor", "pollen"], "file:VIOL": ["violin"],
    "[state]": ["anchor", "pollen"], "[state:re]": ["anchor"], "[year:1999]": ["anchor"], "[none]": [], "grain": ["pollen"],
}


def test_queries_of_groups(spark):
    notes = spark.createDataFrame(NOTES, "path string, name string, title string, tags array<string>, properties map<string,string>")
    fields = {k: F.col(k) for k in ("path", "name", "title", "tags", "properties")}
    flags = notes.select("name", *(P.compile_query(q, **fields).alias(f"q{i}") for i, q in enumerate(ASKED))).collect()
    for i, (q, want) in enumerate(ASKED.items()):
        assert [r.name for r in flags if r[f"q{i}"]] == want, q
    rng = random.Random(8)
    pairs = [(q, rng.choice(["red", "#00ff7f"])) for q in ASKED]
    assert P.parse_groups("\n// a note\n".join(f"{q}  =  {c}" for q, c in pairs) + "\nno colour here") == pairs


def test_search_puts_labels_before_titles_and_folds_accents(spark):
    rows = [("a", "Sable, 1990", "On rivers", 1, 1), ("b", "Rivière, 1991", "On sand", 1, 5), ("c", "Riviere, 1980", "Sables", 0, 0), ("d", "Mont, 2000", "Nothing", 0, 900)]
    works = spark.createDataFrame(rows, "id string, label string, title string, depth int, cited_by int")
    found = lambda q: [r.id for r in P.search(works, q).collect()]
    assert set(found("riviere")) == {"b", "c"} and set(found("sable")) == {"a", "c"} and found("sable")[0] == "a"
    assert found("MONT") == ["d"] and found("") == [] and found("absent") == []
