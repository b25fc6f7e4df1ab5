"""A mini collection, end to end, and the snapshot source."""

import json

from pyspark.sql import functions as F

from quillgraph.operators import graph, notes, resolve
from quillgraph.sources import snapshot, vault


def test_mini_vault(spark, tmp_path):
    lit = tmp_path / "vault" / "Literature"
    lit.mkdir(parents=True)
    (lit / "Smith 2001.md").write_text("---\ndoi: https://doi.org/10.1/A\ntags: [peat]\n---\nText.\n\n## References\n- Doe, A. (1999). Carbon balance of bogs. Journal, 2, 3-4.\n- Roe, B. (1998). Unknown. Press. https://doi.org/10.9999/zz\n")
    (lit / "Doe 1999.md").write_text("---\nauthors: Doe, A.\n---\nSee [Smith](obsidian://cite?note=Smith%202001&q=x).\n")
    (tmp_path / "vault" / "draft.md").write_text("No references.")
    rows = vault.read_vault(spark, str(tmp_path / "vault"))
    got = {r.basename: r for r in rows.collect()}
    assert set(got) == {"Smith 2001", "Doe 1999", "draft"} and got["Smith 2001"].tags == ["#peat"] and got["Smith 2001"].properties["doi"].endswith("10.1/A")
    assert rows.where(vault.is_literature(F.col("path"), "Literature/")).count() == 2
    named = rows.select(F.col("basename").alias("path"), F.col("body").alias("text"))
    entries = notes.bibliographies(named)
    assert [(r.first_author, r.doi) for r in entries.orderBy("entry_ord").collect()] == [("Doe", None), ("Roe", "10.9999/zz")]
    works = spark.createDataFrame([("Doe 1999", 1, None, "1999", ["doe"], ["Carbon balance of bogs"]), ("Smith 2001", 2, "10.1/a", "2001", ["smith"], [])], "path string, ord int, doi string, year string, authors array<string>, titles array<string>")
    asked = entries.select(F.col("entry_ord").alias("entry_id"), F.col("path").alias("from_path"), "doi", "year", "authors", "et_al", "text")
    resolved = resolve.resolve_entries(asked, works).where("path is not null").select(F.lit("Smith 2001").alias("source"), F.col("path").alias("target"), F.lit("bibliography").alias("kind"))
    linked = notes.citation_links(named).select(F.col("path").alias("source"), F.col("note").alias("target"), F.lit("link").alias("kind"))
    assert {(r.source, r.target, tuple(r.kinds)) for r in graph.merge_edges(resolved.union(linked)).collect()} == {("Smith 2001", "Doe 1999", ("bibliography",)), ("Doe 1999", "Smith 2001", ("link",))}


def test_snapshot(spark, tmp_path):
    records = [
        {"id": "https://x.org/W1", "doi": "https://doi.org/10.1/A", "display_name": "One", "publication_year": 2001, "cited_by_count": 5, "referenced_works": ["https://x.org/W2", "https://x.org/W3"], "authorships": [{"author": {"display_name": "Ann Lee"}}, {"author": {"display_name": ""}}], "abstract_inverted_index": {"b": [1], "a": [0, 2]}},
        {"id": "https://x.org/W2", "display_name": "Two", "referenced_works": ["https://x.org/W1", "https://x.org/W9"], "topics": []},
    ]
    (tmp_path / "s.json").write_text("\n".join(map(json.dumps, records)))
    works = snapshot.read_snapshot(spark, str(tmp_path / "s.json"))
    a, b = works.orderBy("id").collect()
    assert (a.id, a.doi, a.authors, a.references, a.abstract, a.topics) == ("W1", "10.1/a", ["Ann Lee"], ["W2", "W3"], "a b a", None) and b.topics == []
    dois = spark.createDataFrame([(0, "10.1/a"), (1, "10.5/no"), (2, "10.1/a"), (3, "10.6/new")], "pos int, doi string")
    known = spark.createDataFrame([("10.1/a", "W1"), ("10.5/no", None)], "doi string, id string")
    assert [r.id for r in snapshot.lookup(dois, known, works).collect()] == ["W1", "W1"]
    assert [r.doi for r in snapshot.to_fetch(dois, known).collect()] == ["10.6/new"]
    kept = snapshot.prune(works, spark.createDataFrame([], "id string"), spark.createDataFrame([("W1",)], "id string"))
    assert {r.id: r.references for r in kept.collect()} == {"W1": ["W2", "W3"], "W2": ["W1"]}
