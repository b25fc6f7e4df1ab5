"""Names of regions, dealt in rounds, held against the same done one after another."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from quillgraph.operators import naming


def one_by_one(candidates):
    names, used = {}, set()
    for score, name, grp in sorted((-s, n, g) for g, n, s in candidates):
        if grp not in names and name not in used:
            names[grp] = name
            used.add(name)
    return names


@pytest.mark.parametrize("seed", range(3))
def test_names_are_dealt_best_first(spark, seed):
    """Few scores, so that ties decide; some regions are left without a name."""
    rng = random.Random(seed)
    rows = list({(g, f"n{k}"): (g, f"n{k}", float(rng.randrange(4))) for g in range(12) for k in rng.sample(range(9), 5)}.values())
    got = {r.grp: r.name for r in naming.deal_names(spark.createDataFrame([*rows, (None, "n1", 9.0), (1, None, 9.0)], "grp int, name string, score double")).collect()}
    assert got == one_by_one(rows) and len(got) == 9


def test_a_chain_takes_a_round_each(spark):
    """Each region's best name is dearer to the one before it."""
    rows = [r for g in range(6) for r in ((g, f"n{g}", 10.0 - 2 * g), (g + 1, f"n{g}", 9.5 - 2 * g))]
    got = {r.grp: r.name for r in naming.deal_names(spark.createDataFrame(rows, "grp int, name string, score double")).collect()}
    assert got == one_by_one(rows) == {g: f"n{g}" for g in range(6)}


def test_kept_terms_repeat_nothing(spark):
    scores = spark.createDataFrame([(1, "soil", 9.0), (1, "soil moisture", 8.0), (1, "plant", 7.0), (1, "planting", 6.0), (1, "root", 5.0), (1, "ash", 4.0), (2, "oak", 1.0), (3, "fern", 1.0)], "grp int, term string, score double")
    taken = spark.createDataFrame([(1, ["root", ""]), (2, ["oak forest"])], "grp int, keys array<string>")
    got = {(r.grp, r.place): r.term for r in naming.kept_terms(scores, taken).collect()}
    assert got == {(1, 0): "soil", (1, 1): "plant", (1, 2): "ash", (3, 0): "fern"}


def unit(v):
    n = np.linalg.norm(v)
    return None if n < 1e-12 else v / n


def plain_names(works, keywords, topics, terms, coverage=0.3, lift=1.2):
    """From what the docstrings say, over dicts of lists."""
    key = lambda t: t.strip().lower()
    show = lambda t: t.strip()[:1].upper() + t.strip()[1:]
    grp = {i: g for i, g, _ in works}
    vec = {i: np.array(v) for i, _, v in works if v is not None}
    regions = sorted({g for g in grp.values() if g is not None})
    own = {i: {key(k) for k in keywords.get(i, []) if k.strip()} for i in grp}
    described = [i for i in grp if own[i]]
    overall = np.mean(list(vec.values()), axis=0)
    meaning = lambda ids: unit(np.mean([vec[i] for i in ids], axis=0) - overall) if ids else None
    centre = {g: meaning([i for i in vec if grp[i] == g]) for g in regions}
    uses = Counter(k for i in grp for k in own[i])
    most = max(0.1, 1.5 / len(regions))
    found = []
    for g in regions:
        named = [i for i in described if grp[i] == g]
        here = Counter(k for i in named for k in own[i])
        for k, n in here.items():
            m = meaning([i for i in vec if k in own[i]])
            share = n / len(named)
            if not (3 <= uses[k] <= most * len(described)) or n < 2 or share < 0.08 or share / (uses[k] / len(described)) < 1.2 or m is None or centre[g] is None:
                continue
            mine, other = centre[g] @ m, max([centre[h] @ m for h in regions if h != g and centre[h] is not None], default=-1.0)
            found.append((g, k, (mine + 0.5 * (mine - other)) * math.sqrt(share)))
    names = one_by_one(found)
    all_terms = {i: sorted({key(t) for t in [*keywords.get(i, []), *terms.get(i, [])] if len(key(t)) > 2}) for i in grp}
    spelling = {}
    for i in sorted(grp):
        for t in [*sorted(keywords.get(i, [])), *sorted(terms.get(i, []))]:
            spelling.setdefault(key(t), t.strip())
    per = {g: Counter(t for i in grp if grp[i] == g for t in all_terms[i]) for g in regions}
    everywhere = sum(per.values(), Counter())
    mean = sum(everywhere.values()) / len(regions)
    out = {}
    with_topics = [i for i in grp if topics.get(i)]
    for g in regions:
        inside = [i for i in with_topics if grp[i] == g]
        best = None
        for t, n in sorted(Counter(t for i in inside for t in set(topics[i])).items()):
            share = n / len(inside)
            up = share / (sum(t in topics[i] for i in with_topics) / len(with_topics))
            if share >= coverage and up >= lift and (best is None or share * math.log(1 + up) > best[0] + 1e-12):
                best = (share * math.log(1 + up), t)
        topic = best[1] if best else None
        title = show(spelling[names[g]]) if g in names else topic or ""
        size, least = sum(per[g].values()), max(2, 0.05 * sum(bool(all_terms[i]) for i in grp if grp[i] == g))
        rated = sorted((-(n / size) * math.log(1 + mean / everywhere[t]) * (1.5 if " " in t else 1), t) for t, n in per[g].items() if n >= least and everywhere[t] <= most * sum(map(bool, all_terms.values())))
        kept = []
        for _, t in rated:
            if len(kept) < 3 and not any(x in t or t in x for x in [key(title), key(topic or ""), *kept] if x):
                kept.append(t)
        lines = [show(spelling[t]) for t in kept]
        if not title:
            title, lines = (lines[0], lines[1:]) if lines else ("", [])
        out[g] = (title, topic if topic != title else None, lines)
    return out


def test_names_of_regions(spark):
    rng = random.Random(3)
    works, keywords, topics, terms = [], {}, {}, {}
    stock = {g: [f"w{g}{c}" for c in "abcdefgh"] for g in range(6)}
    for i in range(300):
        g = None if i % 17 == 0 else i % 6
        v = None if i % 11 == 0 else [rng.gauss(0, 0.4) + 3 * (d == g) for d in range(6)]
        works.append((i, g, v))
        mine = stock[g if g is not None else rng.randrange(6)]
        if g in (0, 1, 2, 3):  # two share their keywords, so that a name is wanted twice
            pool = {0: ["Alpine lakes", "alpine lakes ", "river"], 1: ["alpine lakes", "River"], 2: ["desert"], 3: ["Coral reef", "coral"]}[g]
            keywords[i] = rng.sample(pool, k=rng.randrange(1, len(pool) + 1)) + (["common"] if rng.random() < 0.7 else [])
        if rng.random() < 0.8:
            topics[i] = rng.sample([f"Topic {g}", "Biology"], k=rng.randrange(1, 3)) if g in (1, 4) else ["Biology"]
        terms[i] = rng.sample(mine, k=3) + (["two words"] if g == 5 and rng.random() < 0.5 else []) + ["at", "study"]
    listed = lambda d, c: spark.createDataFrame([(i, t) for i, ts in d.items() for t in ts] + [(999, "lost"), (5, " "), (5, None)], f"id long, {c} string")
    got = naming.region_names(spark.createDataFrame(works, "id long, grp int, v array<double>"), listed(keywords, "keyword"), listed(topics, "topic"), listed(terms, "term"))
    want = plain_names(works, keywords, topics, terms)
    assert {r.grp: (r.title, r.topic, r.terms) for r in got.collect()} == want
    assert want[4][0] == "Topic 4" and want[5][0] == "Two words" and want[0][0] != want[1][0]


def test_names_of_nothing(spark):
    empty = lambda c: spark.createDataFrame([], f"id long, {c} string")
    works = spark.createDataFrame([(1, 7, None), (2, None, [1.0])], "id long, grp int, v array<double>")
    got = naming.region_names(works, empty("keyword"), empty("topic"), empty("term")).collect()
    assert [tuple(r) for r in got] == [(7, "", None, [])]
    assert naming.region_names(works.where("id = 0"), empty("keyword"), empty("topic"), empty("term")).count() == 0


def test_words_of_works_are_found_once(spark):
    """Terms are made a single time, however often the names look at them."""
    looked = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            looked.add(b.num_rows)
            yield b

    works = spark.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in range(6)], "id long, grp int, v array<double>")
    terms = spark.createDataFrame([(i, f"word{i % 3}") for i in range(6)], "id long, term string").mapInArrow(seen, "id long, term string")
    none = lambda c: spark.createDataFrame([], f"id long, {c} string")
    assert naming.region_names(works, none("keyword"), none("topic"), terms).count() == 2
    assert looked.value == 6
