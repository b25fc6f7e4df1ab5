"""What larger tables brought to light."""

from __future__ import annotations

import math
import time

import numpy as np
from pyspark.sql import functions as F

from quillgraph.operators import communities, meaning, resolve, similarity
from quillgraph.operators.nearest import blocks_for, largest_products
from quillgraph.plans import collection


def test_groups_of_unequal_size_that_lie_apart(spark):
    """First centres are in the middle of equal runs of angles, so a group somewhat larger than
    the others has one of them, not two."""
    sizes = [34, 33, 35, 41, 32, 35]
    rows = [(100 * g + i, 10 * math.cos(g * math.pi / 3 + 0.1) + i / 1000, 10 * math.sin(g * math.pi / 3 + 0.1) - i / 900) for g, n in enumerate(sizes) for i in range(n)]
    grp = {r.id: r.grp for r in meaning.kmeans(spark.createDataFrame(rows, "id long, x double, y double"), 6)[0].collect()}
    assert [len({v for i, v in grp.items() if i // 100 == g}) for g in range(6)] == [1] * 6 and len(set(grp.values())) == 6


def test_fewer_works_than_groups(spark):
    rows = spark.createDataFrame([(1, 1.0, 0.0), (2, 0.0, 1.0)], "id long, x double, y double")
    assert len(meaning.kmeans(rows, 6)[1]) == 2 and meaning.kmeans(rows.limit(0), 6)[0].count() == 0


def test_parts_of_six_digits_have_titles_of_their_own(spark, tmp_path):
    """Pairs of parts whose keys have the same first five digits, and with them author and year."""
    same = [(k, 10 * k + x) for k in range(10_000, 99_999) for x in range(10) if (9 * k + x) % 780 == 0 and k % 4 == 1 and (10 * k + x) % 4 == 1][:3]
    spark.createDataFrame([(k,) for pair in same for k in pair], "p_partkey int").write.parquet(str(tmp_path / "part.parquet"))
    got = {(r.path, r.reason, r.others) for r in collection.panel_duplicates(spark, str(tmp_path)).collect()}
    sides = (("A", "B"), ("B", "A"))
    assert got == {(f"Literature/{a}{k}.md", "title", f"Literature/{b}{k}.md") for pair in same for k in pair for a, b in sides}


def test_copies_of_a_title_are_compared_once(spark):
    """2,000 copies make four million pairs, none of which goes through a shuffle."""
    written = lambda: time.sleep(1) or spark._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    rows = spark.createDataFrame([(i, 1, ["alpha", "beta"]) for i in range(2000)] + [(5000, 1, ["beta"]), (5001, None, ["beta"])], "id long, block int, words array<string>").localCheckpoint()
    before = written()
    got = similarity.overlap_join(rows.withColumnRenamed("id", "title"), rows.withColumnRenamed("id", "text"), 0.6).groupBy("overlap").count().collect()
    assert {(r.overlap, r["count"]) for r in got} == {(1.0, 2000 * 2000 + 2001)}
    assert written() - before < 2_000_000


def test_all_overlaps_of_a_block(spark):
    titles = {1: (1, "a b"), 2: (1, "b"), 3: (1, "a b"), 4: (2, "b"), 5: (None, "b"), 6: (1, ""), 7: (1, "c xxa")}
    rows = spark.createDataFrame([(i, g, w.split()) for i, (g, w) in titles.items()], "id long, block int, words array<string>")
    got = {(r.a, r.b): r.overlap for r in similarity.all_overlaps(rows).collect()}
    near = lambda w, t: w in t or any(x.endswith(w) and 1 <= len(x) - len(w) <= 3 for x in t)
    share = lambda a, b: sum(near(w, b) for w in a) / len(a) if a else 0.0
    assert got == {(a, b): share(x.split(), y.split()) for a, (g, x) in titles.items() for b, (h, y) in titles.items() if a < b and g == h and g is not None}


def test_nearest_of_a_dense_middle_and_of_copies(spark):
    """Places far out don't make those in the middle meet all of their ring, nor copies each
    other: what is shuffled grows with places and neighbours, not with pairs."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(5000, 2)) * 1e-3, np.full((3000, 2), 0.25), rng.normal(size=(500, 2)) * 50]).round(6)
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, x double, y double").localCheckpoint()
    written = lambda: time.sleep(1) or spark._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = written()
    got: dict[int, list] = {}
    for r in sorted(meaning.knn_plane(rows, 6).collect(), key=lambda r: (r.id, r["rank"])):
        got.setdefault(r.id, []).append(r.neighbour)
    assert written() - before < 10_000_000
    for i in [*range(0, 8000, 97), *range(8000, 8500, 7)]:
        d = np.hypot(*(x - x[i]).T)
        d[i] = np.inf
        assert got[i] == np.lexsort((np.arange(len(x)), d))[:6].tolist()


def test_largest_products_of_copies_zeros_and_what_is_not_finite():
    rng = np.random.default_rng(3)
    x, y = rng.integers(-3, 4, (300, 5)).astype(float), rng.integers(-3, 4, (900, 5)).astype(float) * 1e20
    y[400:700], y[5, 1], x[7, 0], x[9] = y[0], np.inf, np.nan, 0
    r, j, s = largest_products(x, y, 12)
    for i in range(len(x)):
        p = (x[i] @ y.T) if i != 7 else np.full(len(y), -np.inf)
        p[5] = -np.inf
        best = [b for b in np.lexsort((np.arange(len(y)), -p))[:12] if np.isfinite(p[b])]
        assert j[r == i].tolist() == best and np.array_equal(s[r == i], p[best])


def test_a_vector_is_sent_to_few_blocks(spark):
    """20,000 vectors were dealt into five blocks and each sent ten times; a million would be sent
    490 times, now 62 times."""
    assert blocks_for(20_000) == 5 and blocks_for(200_000) <= 7 and blocks_for(1_000_000) == 31
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(40)], "id long, v array<double>")
    got = meaning.knn_cosine(v, 2).where("id = 5").select("neighbour").collect()
    assert sorted(r.neighbour for r in got) == [2, 8]


def test_a_shared_work_is_one_row_of_the_fold(spark, monkeypatch):
    """A task that folds a connected graph sorts a row for each work and atom, not one for each
    pair of them."""
    kind, seen = type(spark.range(1)), []
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: seen.append(self.count()) or plain(self, *a, **b))
    edges = spark.createDataFrame([(f"S{a}", f"P{b:03}") for a in range(12) for b in range(60) if (a + b) % 3], "source string, target string")
    got = {r.id: r.nucleus for r in communities.atoms(edges).collect()}
    size = dict.fromkeys((f"S{a}" for a in range(12)), 0)
    for b in range(60):
        pick = min((f"S{a}" for a in range(12) if (a + b) % 3), key=lambda x: (size[x], x))
        size[pick] += 1
        assert got[f"P{b:03}"] == pick
    assert seen == [60 + 12]


def _shuffled(spark, job):
    written = lambda: time.sleep(1) or spark._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = written()
    out = job()
    return out, written() - before


def test_a_pass_of_local_moves_reads_a_quarter_of_the_links(spark):
    """Links of nodes that may not move aren't weighed, and go through two shuffles at most."""
    links = spark.range(120_000).selectExpr("id % 2000 AS a", "(id % 2000 * 7 + id div 2000 * 31 + 1) % 2000 AS b", "1.0D AS w").localCheckpoint()
    state = links.groupBy("a").count().selectExpr("a AS node", "a AS label", "double(count) AS degree").localCheckpoint()
    got, size = _shuffled(spark, lambda: communities._local_moves(links, state, 120_000.0, passes=1, seed=3).collect())
    assert len(got) == 2000 and 0 < sum(r.node != r.label for r in got) < 1000
    assert size < 700_000


def test_propagated_labels_are_numbers_in_shuffles(spark):
    """Names are long here; they go through shuffles when nodes are numbered, not in rounds."""
    name = lambda c: f"concat('a name of a work that is long ', sha2(cast({c} AS string), 256))"
    ids = spark.range(900)
    pairs = ids.toDF("a").join(ids.toDF("b"), F.expr("a < b AND a div 45 = b div 45"))
    edges = pairs.selectExpr(f"{name('a')} AS source", f"{name('b')} AS target").localCheckpoint()
    got, size = _shuffled(spark, lambda: communities.label_propagation(edges).groupBy("community").count().collect())
    assert sum(r["count"] for r in got) == 900 and max(r["count"] for r in got) == 45
    assert size < 3_000_000


def test_small_tables_are_dealt_to_all_cores(spark, tmp_path):
    """One small file is one task; labels and template values cost much for each row."""
    from quillgraph.plans import external

    spark.range(100).selectExpr("int(id) AS p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert external.parts(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_entries_of_the_same_words_are_resolved_once(spark):
    """Against all pairs: DOIs that begin like another, the entry's own note, copies; then a block of 20,000 copies each."""
    titles, dois = ["alpha beta gamma", "alpha beta delta", "omega", ""], [None, None, "10.1/a", "10.1/ab", "10.1/abc", "10.1/z", ""]
    works = [(f"N{i}", i, dois[i * 5 % 7], str(2000 + i % 2), ["doe", "roe"][: 1 + i % 2], [titles[i % 4]]) for i in range(24)]
    entries = [(i, f"N{i % 24}", dois[i * 3 % 7], str(2000 + i % 2), ["doe", "roe"][: 1 + i // 2 % 2], i % 3 == 0, "On " + titles[i // 4 % 4]) for i in range(96)]
    w = spark.createDataFrame(works, "path string, ord int, doi string, year string, authors array<string>, titles array<string>")
    e = spark.createDataFrame(entries, "entry_id int, from_path string, doi string, year string, authors array<string>, et_al boolean, text string")
    owners = spark.createDataFrame([("10.1/z", "N1")], "doi string, owner string")
    pairs = e.withColumn("text_words", resolve.title_words(F.col("text"))).crossJoin(w.select("path", F.struct("doi", "year", "authors", F.transform(F.filter("titles", lambda t: F.trim(t) != ""), resolve.title_words).alias("title_sets")).alias("w")))
    fits = pairs.where("path <> from_path and coalesce(doi, '') <> '10.1/z'").where(resolve.entry_matches(lambda c: F.col(c), lambda c: F.col(f"w.{c}")))
    blocks = fits.where("authors[0] = w.authors[0] and year = w.year")
    want = {r.entry_id: r.path for r in blocks.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"), F.first("path").alias("path")).where("n = 1").collect()}
    want |= {x[0]: "N1" for x in entries if x[2] == "10.1/z" and x[1] != "N1"}
    got = {r.entry_id: r.path for r in resolve.resolve_entries(e, w, owners).collect()}
    assert len(want) > 10 and got == {x[0]: want.get(x[0]) for x in entries}
    one = "array('doe') AS authors"
    many = spark.range(20_000).selectExpr("id AS entry_id", "concat('N', id) AS from_path", "string(null) AS doi", "'2000' AS year", one, "false AS et_al", "'alpha beta gamma' AS text")
    copies = spark.range(20_000).selectExpr("concat('N', id) AS path", "id AS ord", "string(null) AS doi", "'2000' AS year", one, "array('alpha beta gamma') AS titles")
    assert resolve.resolve_entries(many, copies).where("path is not null").isEmpty()


def test_notes_of_a_small_table_are_dealt_to_all_cores(spark, tmp_path):
    spark.range(100).selectExpr("int(id) AS s_suppkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    assert collection.vault(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def _tables(tmp_path, **tables):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name, columns in tables.items():
        pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
    return str(tmp_path)


def test_entries_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """No task gets more than its share of line items, and titles aren't keys of a fold
    before the shuffle."""
    import __spark_entry__ as entry
    from quillgraph.sources import tables as T

    monkeypatch.setattr(T, "TASK_ROWS", 10, raising=False)
    n = 600
    d = _tables(
        tmp_path,
        orders={"o_orderkey": list(range(60))},
        lineitem={"l_orderkey": [i % 60 for i in range(n)], "l_partkey": [i % 50 for i in range(n)]},
        part={"p_partkey": list(range(50)), "p_name": [f"survey of matters {'abcde'[i % 5] * 4}" for i in range(50)], "p_size": [i % 7 for i in range(50)]},
    )
    out = entry.queries()["same_work_match"](spark, d)
    got = {r.entry_id: r.work_id for r in out.collect()}
    lines = {(i % 60, i % 50) for i in range(n)}
    same = lambda e: {p % 5 for k, p in lines if k == e}
    want = {e: max(((p % 7, -p), p) for k, p in lines if k == e)[1] for e in range(60) if len(same(e)) == 1}
    assert set(got) == set(range(60)) and {e: got[e] for e in want} == want
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString() and out.rdd.getNumPartitions() == n // 10


def test_labels_of_works_are_made_before_they_are_joined(spark, tmp_path):
    """A label is one for each work, made by all cores, not by the tasks of one small file."""
    from quillgraph.plans import collection as P
    from quillgraph.operators import collection as C

    n = 40
    d = _tables(
        tmp_path,
        supplier={"s_suppkey": list(range(n))},
        part={"p_partkey": list(range(n)), "p_name": [f"p{i}" for i in range(n)], "p_size": list(range(n))},
        lineitem={"l_suppkey": [i % n for i in range(400)], "l_partkey": [i * 7 % n for i in range(400)]},
    )
    plan = C.related(P.indexed(spark, d), P.external(spark, d), "references")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan


def test_a_vector_is_dealt_once_however_many_blocks(spark, monkeypatch):
    """Blocks meet in a cross join of a table, so no copy of a vector is made for a block."""
    monkeypatch.setattr(meaning, "blocks_for", lambda n: 5)
    v = np.random.default_rng(7).normal(size=(120, 4))
    v /= np.linalg.norm(v, axis=1)[:, None]
    out = meaning.knn_cosine(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "id long, v array<double>"), 3)
    s = v @ v.T
    np.fill_diagonal(s, -np.inf)
    got = {(r.id, r["rank"]): r.neighbour for r in out.collect()}
    assert got == {(i, k + 1): int(j) for i in range(120) for k, j in enumerate(np.argsort(-s[i])[:3])}
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_entries_and_works_are_never_broadcast(spark):
    """Small files of them are large in memory, and a broadcast is held by the driver."""
    entries = spark.createDataFrame([(i, f"p{i}", f"10.1/{i}" if i % 2 else None, "2001", ["a"], False, f"alpha beta {i}") for i in range(40)], "entry_id long, from_path string, doi string, year string, authors array<string>, et_al boolean, text string")
    works = spark.createDataFrame([(f"w{i}", i, f"10.1/{i}0" if i % 3 else None, "2001", ["a"], [f"alpha {i}"]) for i in range(40)], "path string, ord long, doi string, year string, authors array<string>, titles array<string>")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    resolve.resolve_entries(entries, works).collect()
    time.sleep(1)
    ran = store.executionsList()
    plans = [ran.apply(i).physicalPlanDescription() for i in range(before, ran.size())]
    assert len(plans) > 2 and any("Join" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)
