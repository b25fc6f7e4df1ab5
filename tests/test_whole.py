"""Queries do the whole job: held against brute force, or SQL without any cut."""

import os

import pytest

from quillgraph.plans import catalog

SF = "/root/testdata/sf0.001"


def put(spark, d, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{d}/{name}.parquet")


def ask(spark, name, d):
    return [tuple(r) for r in catalog.QUERIES[name](spark, str(d)).collect()]


def test_code_fence_of_long_texts(spark, tmp_path):
    texts = {1: "x" * 7 + "\nab\n" + "y" * 14, 2: "\n".join("z" * (i % 9) for i in range(2000))}
    put(spark, tmp_path, "documents", list(texts.items()), "doc_id long, text string")
    want = set()
    for doc_id, text in texts.items():
        inside = False
        for n, line in enumerate(text.split("\n")):
            inside ^= len(line) % 7 == 0
            want.add((doc_id, n, inside))
    assert len(texts[2]) > 3000 and set(ask(spark, "code_fence_state", tmp_path)) == want


def without(sql, *cuts):
    for cut in cuts:
        sql = sql.replace(cut, "")
    return sql


def by_sql(sql):
    import duckdb

    c = duckdb.connect()
    for t in "part supplier orders lineitem".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c.sql(sql).fetchall()


tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@tables
def test_same_work_of_all_orders(spark):
    want = by_sql(without(catalog.ORACLES["same_work_match"], " WHERE o_orderkey % 10 = 0"))
    got = ask(spark, "same_work_match", SF)
    assert sorted(got) == sorted(want) and any(entry % 10 for entry, _ in got)


@tables
def test_title_overlap_of_all_pairs(spark):
    want = by_sql(without(catalog.ORACLES["title_overlap"], " AND a.p_partkey % 10 = b.p_partkey % 10"))
    got = ask(spark, "title_overlap", SF)
    assert sorted(got) == sorted(want) and any((a - b) % 10 for a, b, _ in got)


@tables
@pytest.mark.parametrize("name", ["cited_by_stage", "citing_works_rank", "citing_top_n"])
def test_citations_of_all_line_items(spark, name):
    sql = without(catalog.ORACLES[name], " WHERE l_quantity >= 45", " WHERE l_quantity >= 40")
    assert "l_quantity" not in sql and sorted(ask(spark, name, SF)) == sorted(by_sql(sql))


def test_name_key_of_whole_texts(spark, tmp_path):
    rows = [(1, "Muller " * 20 + "End", "en"), (2, "Élise Straße-Gößl, 3.", "de"), (3, "", "fr")]
    put(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string")
    assert sorted(ask(spark, "name_key", tmp_path)) == [(1, "muller" * 20 + "end"), (2, "elisestraßegoßl"), (3, "")]


def test_lsa_of_rare_terms(spark, tmp_path):
    # 200 pairs of documents share 26 terms each, 5,200 in all; those of the last pair come last.
    name = lambda n: "".join(chr(97 + n // 26**i % 26) for i in (3, 2, 1, 0)) + "x"
    rows = [(i, " ".join(name(i // 2 * 26 + j) for j in range(26)), "en") for i in range(400)]
    put(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string")
    got = dict(ask(spark, "lsa_groups", tmp_path))
    assert set(got) == set(range(400)) and all(v is None or len(v) == 64 for v in got.values())
