"""Graph, ranking, resolution and meaning operators against plain versions."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import communities, graph, meaning, ranking, resolve
from quillgraph.streaming import incremental as S


def literature(seed, own=12, outside=30, edges=170):
    """A random graph of works of a collection (v...) and others (w...)."""
    rng = random.Random(seed)
    vault, others = [f"v{i:02}" for i in range(own)], [f"w{i:02}" for i in range(outside)]
    pairs = set()
    while len(pairs) < edges:
        a, b = rng.choice(vault if rng.random() < 0.8 else others), rng.choice(others if rng.random() < 0.8 else vault)
        if a != b:
            pairs.add((a, b))
    info = {w: (rng.choice([None, 1955, 1999, 2020, 2031]), rng.choice([None, 0, 9, 123, 98765])) for w in others if rng.random() < 0.7}
    return vault, others, sorted(pairs), info


def bonus_of(year, cited, now):
    recent = 0 if year is None else 0.2 * min(1, max(0, 1 - (now - year) / 30))
    return recent + 0.2 * min(1, math.log10(1 + (cited or 0)) / 4)


def scores_by_hand(vault, others, pairs, info, now):
    """A point for each citing work of the collection, half for each it cites, a tenth for
    each other citing work (one at most), half the share of the core it is cited with."""
    cited_by = {w: {a for a, b in pairs if b == w and a in vault} for w in others}
    core = {w for w, c in cited_by.items() if len(c) > 1}
    out = {}
    for w in others:
        with_it = {x for x in core - {w} if cited_by[x] & cited_by[w]}
        most = len(core - {w})
        score = len(cited_by[w]) + 0.5 * sum(a == w and b in vault for a, b in pairs) + min(1, 0.1 * sum(b == w and a in others for a, b in pairs))
        out[w] = score + (0.5 * len(with_it) / most if most else 0) + bonus_of(*info.get(w, (None, None)), now), len(with_it)
    return out


def rated(spark, vault, others, pairs, info, now=2026):
    nodes = spark.createDataFrame([(x, 0, x) for x in vault] + [(x, 1, x) for x in others], "id string, depth int, title string")
    edges = spark.createDataFrame(pairs, "source string, target string")
    return ranking.suggestions(nodes, edges, spark.createDataFrame([(k, *v) for k, v in info.items()], "id string, year int, cited_by_count long"), now)


@pytest.mark.parametrize("seed", [1, 2])
def test_suggestions_score_as_by_hand(spark, seed):
    graph_ = literature(seed)
    rows = ranking.ranked(rated(spark, *graph_), 20, "vault_citers").orderBy("rank").collect()
    want = scores_by_hand(*graph_, 2026)
    assert len(rows) == 20 and [r["rank"] for r in rows] == list(range(1, 21))
    for r in rows:
        assert abs(r.score - want[r.id][0]) <= 0.00501 and r.co_cited == want[r.id][1]
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
    assert min(r.score for r in rows) >= sorted((s for s, _ in want.values()), reverse=True)[19] - 0.01


def test_reasons_say_what_counts_and_no_more(spark):
    graph_ = literature(3)
    info = graph_[3]
    for r in rated(spark, *graph_).withColumn("why", ranking.reasons()).collect():
        year, cited = info.get(r.id, (None, None))
        parts = [r.vault_citers, r.cites_vault, r.outside_citers, r.co_cited]
        assert len(r.why) == sum(p > 0 for p in parts) + (year is not None) + (cited is not None)
        numbers = [[int(x) for x in re.findall(r"\d+", line)] for line in r.why]
        assert [n[0] for n in numbers[: sum(p > 0 for p in parts)]] == [p for p in parts if p > 0]
        assert not any("1 works" in line or " 1 others" in line for line in r.why)


def test_citing_works_go_by_what_they_cite_then_by_bonus(spark):
    rng = random.Random(5)
    rows = [(f"c{i:02}", rng.randint(1, 4), rng.choice([None, 1970, 2005, 2026]), rng.choice([None, 0, 50, 10**6])) for i in range(40)]
    works = spark.createDataFrame(rows, "id string, cites int, year int, cited_by_count long")
    got = ranking.ranked(ranking.rank_citing(works, 2026), 40, "cites").orderBy("rank").collect()
    want = {i: n + bonus_of(y, c, 2026) for i, n, y, c in rows}
    assert all(abs(r.score - want[r.id]) <= 0.00501 for r in got)
    assert [(-r.score, -r.cites, r.id) for r in got] == sorted((-r.score, -r.cites, r.id) for r in got)


def test_half_up_on_the_double(spark):
    assert spark.range(1).select(ranking.round_half_up(F.lit(1.005).cast("double")).alias("x")).first().x == 1.0


def test_duplicates_share_a_doi_or_author_year_and_title(spark):
    """Pairs planted among works that differ in one of the three."""
    rng = random.Random(6)
    rows, planted = [], []
    for i in range(30):
        author, year, title = f"family{i % 5}", str(1980 + i % 3), " ".join("".join(rng.choices("bcdfglmnprst", k=7)) for _ in range(5))
        doi = f"10.7777/k{i}" if i % 2 else None
        rows.append((f"{i:02} first", 2 * i, doi, author, year, title))
        if i % 6 == 1:  # the same DOI, another title
            rows.append((f"{i:02} second", 2 * i + 1, doi.upper(), "someone", "1900", "Wholly other words here"))
            planted.append(([f"{i:02} first", f"{i:02} second"], "doi"))
        elif i % 6 == 2:  # no DOI, the same description
            rows.append((f"{i:02} second", 2 * i + 1, None, author, year, title))
            planted.append(([f"{i:02} first", f"{i:02} second"], "title"))
        elif i % 6 == 4:  # another year: no copy
            rows.append((f"{i:02} second", 2 * i + 1, None, author, "1979", title))
    works = spark.createDataFrame(rows, "path string, ord int, doi string, first_author string, year string, title string")
    assert sorted((r.paths, r.reason) for r in resolve.duplicate_groups(works).collect()) == sorted(planted)


def test_resolution_traps(spark):
    entries = spark.createDataFrame(
        [(1, "n1", "10.1/a", "2001", ["smith"], False, "Smith 2001 Peat hydrology basics"), (2, "n2", None, "2001", ["smith"], False, "Smith 2001 Peat hydrology basics"), (3, "n3", None, "1999", ["doe"], False, "Doe 1999 Carbon balance")],
        "entry_id int, from_path string, doi string, year string, authors array<string>, et_al boolean, text string",
    )
    works = spark.createDataFrame([("n1", 1, "10.1/a", "2001", ["smith"], ["Peat hydrology basics"]), ("c1", 2, None, "1999", ["doe"], ["Carbon balance"]), ("c2", 3, None, "1999", ["doe"], ["Carbon balance"])], "path string, ord int, doi string, year string, authors array<string>, titles array<string>")
    got = {r.entry_id: r.path for r in resolve.resolve_entries(entries, works).collect()}
    assert got == {1: None, 2: "n1", 3: None}  # itself; the one match; ambiguous


def test_local_graph_and_isolated(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "a")], "source string, target string")
    assert {(r.id, r.distance) for r in graph.local_graph(edges, "a", depth=2, direction="out").collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r.id for r in graph.local_graph(edges, "a", depth=9, direction="both").collect()} == {"a", "b", "c", "d", "x"}
    nodes = spark.createDataFrame([("a", 0), ("q", 1), ("z", 1)], "id string, depth int")
    assert {r.id for r in graph.without_isolated(nodes, edges, "z").collect()} == {"a", "z"}


def test_sequential_louvain_beats_any_single_move():
    rng = random.Random(7)
    n = 40
    edges = [(a, b) for a in range(n) for b in range(a) if rng.random() < (0.6 if a % 4 == b % 4 else 0.03)]
    got = communities.louvain(edges, n)

    def value(own):
        degree = [sum(i in e for e in edges) for i in range(n)]
        return sum(own[a] == own[b] for a, b in edges) / len(edges) - sum(sum(d for d, c in zip(degree, own) if c == k) ** 2 for k in set(own)) / (2 * len(edges)) ** 2

    best = value(got)
    assert all({got[j] for j in range(i, n, 4)} == {got[i]} for i in range(4)) and len(set(got)) == 4
    assert all(value([*got[:i], c, *got[i + 1 :]]) <= best + 1e-12 for i in range(n) for c in set(got))


def test_knn_plane_is_exact(spark):
    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.normal(0, 0.01, (150, 2)), rng.normal(0, 1, (150, 2))])
    places = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    got = {(r.id, r["rank"]): r.distance for r in meaning.knn_plane(places, 4).collect()}
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :4]
    assert len(got) == 1200 and max(abs(got[i, k + 1] - want[i, k]) for i in range(300) for k in range(4)) < 1e-12


def test_blends_are_of_unit_length_and_between(spark):
    rng = np.random.default_rng(9)
    own, near = rng.normal(size=(6, 5)), rng.normal(size=(6, 3, 5))
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own) if i != 5], "id int, v array<double>")
    b = spark.createDataFrame([(i, v.tolist()) for i, vs in enumerate(near) for v in vs if i != 4], "id int, v array<double>")
    for weight in (1.0, 2.0):
        got = {r.id: np.array(r.v) for r in meaning.blend_neighbours(a, b, weight).collect()}
        for i in range(6):
            mean = near[i].mean(0) / np.linalg.norm(near[i].mean(0))
            want = own[i] if i == 4 else mean if i == 5 else own[i] + weight * mean
            assert np.allclose(got[i], want / np.linalg.norm(want))


def test_spanning_forests_are_kruskals(spark):
    """With ties, loops, repeated and turned edges, and several components."""
    from quillgraph.operators.components import components, spanning_forest

    rng = random.Random(11)
    rows = [(rng.randrange(40), rng.randrange(40), rng.choice([0.1, 0.5, 0.5, 0.9, rng.random()])) for _ in range(150)] + [(100 + i, 101 + i, 0.3) for i in range(9)]
    best = {}
    for a, b, s in rows:
        if a != b:
            best[min(a, b), max(a, b)] = max(s, best.get((min(a, b), max(a, b)), 0))
    label = {x: x for e in best for x in e}
    want = set()
    for (a, b), s in sorted(best.items(), key=lambda e: (-e[1], e[0])):
        if label[a] != label[b]:
            want.add((a, b, s))
            gone, stays = max(label[a], label[b]), min(label[a], label[b])
            label = {x: stays if y == gone else y for x, y in label.items()}
    edges = spark.createDataFrame(rows, "a long, b long, similarity double")
    assert {(r.a, r.b, r.similarity) for r in spanning_forest(edges).collect()} == want
    assert {r.id: r.component for r in components(edges).collect()} == {x: label.get(x, x) for e in rows for x in e[:2]}
    assert spanning_forest(edges.limit(0)).count() == 0


def atoms_by_hand(nodes, pairs):
    """One work after the other, as the operator's text says."""
    own = {i for i, d in nodes if d == 0}
    nucleus, size = {}, {i: 0 for i in own}
    for d in (1, 2):
        of = {i: {nucleus.get(a, a if a in own else None) for a, b in pairs if b == i and a != i and (a in own or d == 2 and a in nucleus)} - {None} for i, x in sorted(nodes) if x == d}
        for several in (False, True):
            for i, atoms in of.items():
                if atoms and (len(atoms) > 1) == several:
                    pick = min(atoms, key=lambda a: (size[a], a))
                    nucleus[i] = pick
                    size[pick] += 1
    return nucleus


@pytest.mark.parametrize("seed", [1, 2])
def test_atoms_grow_as_works_join(spark, seed):
    rng = random.Random(seed)
    nodes = [(f"a{i:02}", 0) for i in range(9)] + [(f"b{i:02}", 1) for i in range(40)] + [(f"c{i:02}", 2) for i in range(40)]
    ids = [i for i, _ in nodes]
    pairs = {(rng.choice(ids[:9]), rng.choice(ids[9:49])) for _ in range(70)} | {(rng.choice(ids[:49]), rng.choice(ids[49:])) for _ in range(70)} | {(rng.choice(ids[49:]), rng.choice(ids)) for _ in range(20)}
    got = communities.atoms(spark.createDataFrame(sorted(pairs), "source string, target string"), spark.createDataFrame(nodes, "id string, depth int")).collect()
    assert {r.id: r.nucleus for r in got} == atoms_by_hand(nodes, pairs)


def test_incremental_equals_batch(spark, tmp_path):
    events = [(1, "changed", "a", None, "one"), (2, "changed", "b", None, "two"), (3, "renamed", "a", "c", None), (4, "deleted", "b", None, None), (5, "changed", "d", None, "x\n y")]
    for k, rows in enumerate((events[:2], events[2:])):
        spark.createDataFrame(rows, S.EVENT).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        state = S.run_available(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "cp"))
    assert {(r.path, r.text) for r in state.read().collect()} == {("c", "one"), ("d", "x\n y")}
    after = S.apply_changes(state.read(), spark.createDataFrame([(9, "changed", "d", None, "x y"), (10, "changed", "c", None, "three")], S.EVENT))
    assert {(r.path, r.kind) for r in S.change_kinds(state.read(), after).collect()} == {("d", "moved"), ("c", "changed")}


def test_state_survives_a_new_checkpoint(spark, tmp_path):
    import json

    from quillgraph.streaming import incremental as S

    def put(n, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))

    put(1, [{"seq": 1, "op": "changed", "path": "a", "text": "one"}])
    S.run_available(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "cp1"))
    put(2, [{"seq": 2, "op": "changed", "path": "b", "text": "two"}])
    state = S.run_available(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "cp2"))
    assert {r.path for r in state.read().collect()} == {"a", "b"}
    version = state.version()
    state.update(spark.createDataFrame([(3, "changed", "c", None, "x")], S.EVENT), 0, str(tmp_path / "cp2"))  # a repeated batch
    assert state.version() == version


def test_numbering_and_unions_against_brute_force(spark):
    import random

    from quillgraph.operators import graph
    from quillgraph.operators.order import numbered

    rng = random.Random(3)
    rows = [(rng.randrange(9), i) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "a int, position long").repartition(7), "a", "position", name="at").collect()
    assert [r["at"] for r in sorted(got, key=lambda r: (r.a, r.position))] == list(range(500))
    edges = {(f"s{rng.randrange(30) if i % 3 else 0}", f"t{rng.randrange(120)}") for i in range(700)}  # s0 holds a third of all
    citers = {}
    for u, v in edges:
        citers.setdefault(v, set()).add(u)
    core = {v for v, c in citers.items() if len(c) >= 2}
    want = {v: (len({w for u, w in edges if u in c and w in core} - {v}), len(core - {v})) for v, c in citers.items()}
    assert {r.id: (r.co_cited, r.core_size) for r in graph.co_cited(spark.createDataFrame(list(edges), "source string, target string")).collect()} == want


def shuffled(spark):
    """Bytes that the session's tasks have written to shuffles so far."""
    time.sleep(1)  # the store is updated from time to time
    return spark._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()


def test_co_citation_never_shuffles_unions(spark):
    """Two collections apart, with targets in several blocks: sizes as counted, and bytes
    in proportion to the edges, not to each target's union."""
    rng = random.Random(31)
    edges = {(f"s{h}x{rng.randrange(90)}", f"t{h}x{rng.randrange(24_000)}") for h in (1, 2) for _ in range(60_000)} | {("s1x0", "s2x0")}
    cites, citers = {}, {}
    for u, v in edges:
        cites.setdefault(u, set()).add(v)
        citers.setdefault(v, set()).add(u)
    core = {v for v, c in citers.items() if len(c) >= 2}
    wanted = {v: (len((set().union(*(cites[u] for u in c)) & core) - {v}), len(core - {v})) for v, c in citers.items() if rng.random() < 0.02}
    table = spark.createDataFrame(list(edges), "source string, target string").localCheckpoint()
    before = shuffled(spark)
    got = {r.id: (r.co_cited, r.core_size) for r in graph.co_cited(table).collect()}
    assert shuffled(spark) - before < 150 * len(edges)
    assert got.keys() == citers.keys() and {v: got[v] for v in wanted} == wanted


def test_co_citation_of_sources_whose_targets_lie_all_over(spark):
    """One graph without parts: a source's works are sent to few blocks, however many targets there are."""
    n = 1_000_000
    table = spark.range(n).select(F.concat(F.lit("s"), F.col("id") % 2000).alias("source"), F.concat(F.lit("t"), F.pmod(F.xxhash64("id"), F.lit(400_000))).alias("target")).distinct().localCheckpoint()
    before = shuffled(spark)
    got = {r.id: (r.co_cited, r.core_size) for r in graph.co_cited(table).collect()}
    assert shuffled(spark) - before < 155 * n
    cites, citers = {}, {}
    for u, v in table.collect():
        cites.setdefault(u, set()).add(v)
        citers.setdefault(v, set()).add(u)
    core = {v for v, c in citers.items() if len(c) >= 2}
    some = [v for v in sorted(citers) if v.endswith("777")]
    assert got.keys() == citers.keys() and all(got[v] == (len((set().union(*(cites[u] for u in citers[v])) & core) - {v}), len(core - {v})) for v in some)


def test_sizes_of_unions_by_lists_and_by_bits():
    """Sources that cite much of a block, little of it, and places with very many sources."""
    rng = np.random.default_rng(11)
    for width in (1, 70, 5000):
        lists = [rng.choice(width, rng.integers(1, 1 + max(1, width // (2 if i % 9 == 0 else 100))), replace=False) for i in range(300)]
        places = [np.unique(np.append(rng.integers(0, 40, 5), 7)) for _ in lists]
        want = {}
        for x, at in zip(lists, places, strict=True):
            for k in at.tolist():
                want.setdefault(k, set()).update(x.tolist())
        found, n = graph._union_sizes(np.concatenate(places), np.array([len(x) for x in places]), np.concatenate(lists).astype("i4"), np.array([len(x) for x in lists]))
        assert dict(zip(found.tolist(), n.tolist(), strict=True)) == {k: len(v) for k, v in want.items()}


def test_ties_go_by_label_as_a_reader_sorts(spark):
    rows = spark.createDataFrame([("1", 2.0, "zebra"), ("2", 2.0, "Écrin"), ("3", 2.0, "eclair"), ("4", 2.0, "Zebra"), ("5", 3.0, "zz"), ("6", 2.0, None), ("7", 2.0, "eclair")], "id string, score double, title string")
    assert [r.id for r in ranking.ranked(rows, 7, label="title").orderBy("rank").collect()] == ["5", "6", "3", "7", "2", "1", "4"]


def test_reasons_name_the_first_works(spark):
    """Seven citers, one of them outside of the collection; repeats of an edge count once."""
    labels = ["Émile", "anna", "Zoe", "Bert", "carl", "Dora"]
    nodes = spark.createDataFrame([(f"v{i}", 0, n) for i, n in enumerate(labels)] + [("v9", 0, None), ("x", 1, "X"), ("y", 1, "Y")], "id string, depth int, label string")
    edges = spark.createDataFrame([(f"v{i}", "x") for i in (0, 1, 2, 3, 4, 5, 5)] + [("y", "x"), ("x", "v9"), ("x", "v1"), ("v1", "y")], "source string, target string")
    rows = spark.createDataFrame([("x", 6, 2, 1), ("y", 1, 0, 0)], "id string, vault_citers long, cites_vault long, outside_citers long").selectExpr("*", "0L AS co_cited", "3L AS core_size", "CAST(NULL AS INT) AS year", "CAST(NULL AS LONG) AS cited_by_count")
    got = {r.id: r.why for r in ranking.named_reasons(rows, nodes, edges).collect()}
    assert got["x"] == ["Cited by 6 works of your vault: anna; Bert; carl; Dora; Émile… (+1)", "Cites 2 works of your vault: anna; v9", "Cited by 1 other work of the graph"]
    assert got["y"] == ["Cited by 1 work of your vault: anna"]
