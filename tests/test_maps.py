"""Maps of works against numpy and plain loops; keywords written into notes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.functions import works as W
from quillgraph.operators import maps as P
from quillgraph.operators.order import running_sum


def test_plane_is_the_two_main_directions(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 6)) * [5, 3, 1, 1, 0.5, 0.1] @ np.linalg.qr(rng.normal(size=(6, 6)))[0] + 2
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)]
    got = {r.id: (r.x, r.y) for r in P.plane_of(spark.createDataFrame(rows, "id long, v array<double>").repartition(5)).collect()}
    left = (v - v.mean(0)) @ np.linalg.svd(v - v.mean(0))[2][:2].T
    left /= np.sqrt((left**2).mean(0))
    mine = np.array([got[i] for i in range(300)])
    assert got[999] == (None, None)
    for c in range(2):
        assert min(abs(mine[:, c] - s * left[:, c]).max() for s in (1, -1)) < 1e-8


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [3.0]), (2, [5.0])]])
def test_plane_of_few_or_equal_vectors(spark, rows):
    got = {r.id: (r.x, r.y) for r in P.plane_of(spark.createDataFrame(rows, "id long, v array<double>")).collect()}
    want = {i: (None, None) if v is None else (0.0, 0.0) for i, v in rows}
    assert got == (want if len(rows) < 2 or rows[0][1] == rows[1][1] else {1: (-1.0, 0.0), 2: (1.0, 0.0)})


def test_region_keywords_of_nothing(spark):
    works = spark.createDataFrame([], "id long, grp int, v array<double>")
    words = spark.createDataFrame([(1, "a")], "id long, keyword string")
    assert P.region_meanings(works, words).count() == 0
    works = spark.createDataFrame([(i, None if i > 7 else i % 2, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(8)] + [(9, 0, None)], "id long, grp int, v array<double>")
    words = spark.createDataFrame([(i, " Odd" if i % 2 else "even") for i in range(8)] + [(0, ""), (1, None), (77, "lost")], "id long, keyword string")
    got = {(r.grp, r.keyword): r.score for r in P.region_meanings(works, words).collect()}
    assert got == pytest.approx({(0, "even"): 2.0, (1, "odd"): 2.0})  # nearness 1, the other's -1


def test_share_within_by_plain_search(spark):
    random.seed(5)
    values = [round(random.random(), 1) for _ in range(60)] + [None]
    asked = [round(random.random() * 1.4 - 0.2, 2) for _ in range(80)] + [None, 0.5, 0.5]
    kept = sorted(v for v in values if v is not None)

    def plain(r):
        if r is None:
            return None
        if r <= kept[0] or r >= kept[-1]:
            return float(r > kept[0])
        lo = max(i for i, v in enumerate(kept) if v <= r)
        return (lo + (r - kept[lo]) / (kept[lo + 1] - kept[lo])) / (len(kept) - 1)

    rows = spark.createDataFrame([(v,) for v in values], "v double")
    at = spark.createDataFrame(list(enumerate(asked)), "id int, v double")
    got = {r.id: r.share for r in P.share_within(rows, "v", at).collect()}
    assert got == pytest.approx({i: plain(r) for i, r in enumerate(asked)})
    for few in ([], [(3.0,)]):
        ends = P.share_within(spark.createDataFrame(few, "v double"), "v", spark.createDataFrame([(-1.0,), (0.0,), (3.0,), (None,)], "v double"))
        assert sorted(map(tuple, ends.collect()), key=str) == sorted([(-1.0, 0.0), (0.0, 0.0), (3.0, 1.0), (None, None)], key=str)


def test_camera_without_nodes_and_without_outliers(spark):
    none = spark.createDataFrame([], "x double, y double, radius double")
    assert P.fit_camera(none, 100, 100).count() == 0
    few = spark.createDataFrame([(0.0, 0.0, 5.0), (100.0, None, 5.0)], "x double, y double, radius double")
    assert P.fit_camera(few, 0, 100).count() == 0
    assert tuple(P.fit_camera(few, 150, 100).first()) == pytest.approx((50.0, 0.0, 150 * 0.92 / 150))
    many = spark.createDataFrame([(float(i % 10), 0.0, 5.0) for i in range(300)] + [(9e9, -9e9, 5.0)], "x double, y double, radius double")
    assert tuple(P.fit_camera(many, 590, 590).first()) == pytest.approx((4.5, 0.0, 2.0))


def test_slots_in_several_rows(spark):
    places = spark.range(2000).select("id", F.cos(F.col("id") / 200).alias("x"), F.sin(F.col("id") / 200).alias("y"), F.lit(1).alias("grp"), F.lit(None).cast("int").alias("sub"))
    works, hubs = P.radial_slots(places, spacing=10, gap=4)
    rows = {r.slot: math.hypot(r.x, r.y) for r in works.collect()}
    assert sorted(rows) == list(range(2000))
    assert len({round(v, 6) for v in rows.values()}) == 2 and rows[1] - rows[0] == pytest.approx(10)
    assert {(h.level, h.grp, h.sub) for h in hubs.collect()} == {(1, 1, None), (2, 1, None)}


def test_running_sum_over_parts(spark):
    random.seed(2)
    rows = [(i, random.randrange(50) if i % 9 else None) for i in range(500)]
    got = {r.id: (r.before, r.position) for r in running_sum(spark.createDataFrame(rows, "id int, v long").repartition(7), "v", F.desc("id")).collect()}
    total, want = 0, {}
    for at, (i, v) in enumerate(reversed(rows)):
        want[i] = (total, at)
        total += v or 0
    assert got == want


def test_runs_of_lines(spark):
    texts = ["", "a", "a\n\nb\nc\n", "\n\n", None, "x\ny"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", X.runs(F.split("t", "\n", -1), lambda x: x != "").alias("r"))
    got = {r.id: None if r.r is None else [tuple(x) for x in r.r] for r in df.collect()}
    assert got == {0: [], 1: [(0, 0)], 2: [(0, 0), (2, 3)], 3: [], 4: None, 5: [(0, 1)]}


NOTES = [
    ("", ["a"], "---\nkeywords:\n  - a\n---\n", "written"),
    (None, None, "", "none"),
    ("---\n---\nText", ["a: b", "true"], '---\nkeywords:\n  - "a: b"\n  - "true"\n---\nText', "written"),
    ("---\nkeywords: [x]\n---\n", ["a"], "---\nkeywords: [x]\n---\n", "kept"),
    ("---\nKEYWORDS:\n- x\n---\n", ["a"], "---\nKEYWORDS:\n- x\n---\n", "kept"),
    ("---\nkeywords: x\n---\n", [], "---\nkeywords: x\n---\n", "kept"),
    ('---\nkeywords: ""\ny: 1\n---\n', ["$1 \\ \"q\""], '---\nkeywords:\n  - "$1 \\\\ \\"q\\""\ny: 1\n---\n', "written"),
    ("--- no\nkeywords: x", ["a"], "---\nkeywords:\n  - a\n---\n--- no\nkeywords: x", "written"),
    ("---\na: 1\nkeywords:\n---\nkeywords: body", ["é"], "---\na: 1\nkeywords:\n  - é\n---\nkeywords: body", "written"),
]


@pytest.mark.parametrize("text,names,want,status", NOTES)
def test_keywords_written_into_a_note(spark, text, names, want, status):
    df = spark.createDataFrame([(text, names)], "t string, n array<string>")
    new, how = W.with_keywords(F.col("t"), "keywords", F.col("n"))
    assert tuple(df.select(new, how).first()) == (want, status)
    again, how = W.with_keywords(F.lit(want), "keywords", F.col("n"))
    assert status == "none" or tuple(df.select(again, how).first()) == (want, "kept")
