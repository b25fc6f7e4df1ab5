"""Merkle manifests, vector codes and virtual slots against plain versions, with the edge
cases of their contracts."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import codes, merkle, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "doc_id long, text string, lang string, source string, n_chars long, level int, tree string, idx string, digest string, _row int, shard string, slot string, copies string, size int"


@pytest.fixture
def as_table(spark, tmp_path):
    """Rows written as a table; returns the folder that queries read."""

    def write(rows, schema, name):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(doc_id, text, lang, source, n_chars, *_):
    return h(field(doc_id), field(source), field(lang), field(n_chars), field(text))


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path_of(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
        out.append((i % 8, run[: i % 8], run[i % 8 + 1 :]))
        i //= 8
    return out


def plain_manifest(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees[lang] = own, levels_of([leaf_of(*r) for r in own])
    top = levels_of([trees[x][1][-1][0] for x in langs])
    out = []
    for place, lang in enumerate(langs):
        own, levels = trees[lang]
        for i, r in enumerate(own):
            path = path_of(levels, i) + path_of(top, place)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            text = r[1].translate(str.maketrans(merkle.UPPER, merkle.LOWER)) if bad else r[1]
            end = leaf_of(r[0], text, *r[2:])
            for _, left, right in path:
                end = h(*left, end, *right)
            out.append((r[0], leaf_of(*r), levels[-1][0], top[-1][0], h(*(x for _, a, b in path for x in a + b)), end, end == top[-1][0]))
    return out


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check_manifest(spark, folder, rows):
    got = [tuple(r) for r in merkle.op11_merkle_manifest(spark, folder).select(*NAMES).collect()]
    assert Counter(got) == Counter(plain_manifest(rows))
    return got


def test_manifest_of_odd_rows(spark, as_table):
    texts = [None, "", "ÀBC é", "lower only", "Tie", "Tie", "İSTANBUL", "x" * 70_000 + "Z", "a:b-c", " "]
    rows = [(i if i % 11 else None, texts[i % 10], (None, "", "de", "Zz", "é")[i % 5] if i % 3 else "en", f"s{i % 4}" if i % 6 else None, i if i % 9 else None) for i in range(150)]
    rows += [(7, "Tie", "en", "s1", 3)] * 40 + [(9, "Alone", "one row", None, None)]
    got = check_manifest(spark, as_table(rows, DOCS, "documents"), rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_with_clashing_columns_and_one_language(spark, as_table):
    rows = [(i, f"Text {i}", "en", "s", i, i, "t", "i", "d", 0, "a", "b", "c", 1) for i in range(9)]
    check_manifest(spark, as_table(rows, CLASH, "documents"), rows)


@pytest.mark.parametrize("n", [1, 8, 65])
def test_manifest_sizes(spark, as_table, n):
    rows = [(i, f"T{i}", "en", "s", i) for i in range(n)]
    check_manifest(spark, as_table(rows, DOCS, "documents"), rows)


def test_manifest_of_nothing(spark, as_table):
    assert merkle.op11_merkle_manifest(spark, as_table([], DOCS, "documents")).count() == 0


def test_frontier_rounds_and_link_blocks(spark, monkeypatch):
    """More levels than a round or a block spans, from scattered rows: the same root and proofs."""
    monkeypatch.setattr(merkle, "SMALL_FRONTIER", 0)
    monkeypatch.setattr(merkle, "ROUND_LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 2)
    leaves = [h(str(i)) for i in range(5000)]
    events = spark.createDataFrame([(0, 5000, i, d) for i, d in enumerate(leaves)], "tree long, size long, idx long, digest string").repartition(7, "digest")
    nodes, roots = merkle.forest(events)
    levels = levels_of(leaves)
    assert [r.digest for r in roots.collect()] == levels[-1]
    assert {(r.level, r.idx): r.digest for r in nodes.collect()} == {(k, i): d for k, own in enumerate(levels) if k for i, d in enumerate(own)}
    tops = spark.createDataFrame([(0, len(levels) - 1, [], levels[-1][0])], "tree long, level int, path array<string>, subroot string")
    paths = merkle.with_paths(events.select("tree", "idx", F.struct("idx").alias("payload")), nodes, tops).collect()
    assert len(paths) == 5000
    for r in paths[::97]:
        assert merkle.folded(leaves[r.idx], r.path) == levels[-1][0]
        assert [(int(p[0]), p[1:]) for p in r.path] == [(at, "".join(a + b)) for at, a, b in path_of(levels, r.idx)]


def test_ordered_rows_leave_a_small_frontier(spark):
    events = spark.range(0, 20_000, 1, 5).select(F.lit(0).cast("long").alias("tree"), F.lit(20_000).cast("long").alias("size"), F.col("id").alias("idx"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    rows = events.select("tree", "size", F.lit(0).alias("level"), "idx", "digest").mapInArrow(merkle.combine_batches, merkle.STEP)
    assert rows.where("kind = 'open'").count() < 5 * 2 * 7 * 6


# ---------------------------------------------------------------- codes

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [int(np.floor(256 * float(c))) for c in v], lab) for i, v, lab in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    x = [v + [0] * (parts * width - len(v)) for _, v, _ in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in x]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))

    def assign():
        return [[min((far(v[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p] for v, f in zip(cut, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    by = Counter()
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by[lab] += e
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, by[lab], digest) for (i, _, lab), f, e in zip(kept, found, errors, strict=True))


def check_codes(spark, folder, rows):
    got = codes.op12_annular_codes(spark, folder).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert Counter(map(tuple, got)) == plain_codes(rows)


def test_codes_of_odd_vectors(spark, as_table):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=32) * (i % 7 + 0.1)], None if i % 9 == 0 else i % 3) for i in range(200)]
    rows += [(300 + i, [0.5] * 32, 1) for i in range(60)] + [(5, [0.0] * 32, 2), (5, [0.0] * 32, 2), (None, [1.0] * 32, 1)]
    rows += [(400, None, 1), (401, [None] * 32, 1), (402, [float("nan")] * 32, 1), (403, [float("inf")] + [0.0] * 31, 1), (404, [], 1), (405, [2.0] * 7, 1), (406, [-0.001] * 32, None)]
    check_codes(spark, as_table(rows, VECTORS, "embeddings"), rows)


def test_codes_with_few_rows_and_extra_columns(spark, as_table):
    rows = [(i, [float(i), -float(i)] * 8, i % 2) for i in range(5)]
    folder = as_table([(*r, "x", 1, "y") for r in rows], VECTORS + ", code string, v int, salt string", "embeddings")
    check_codes(spark, folder, rows)


def test_codes_of_nothing(spark, as_table):
    assert codes.op12_annular_codes(spark, as_table([(1, None, 1)], VECTORS, "embeddings")).count() == 0


def test_annulus_is_exact_and_prunes():
    rng = np.random.default_rng(3)
    for scale in (1, 50, 1 << 20):
        entries = rng.integers(-scale, scale + 1, (64, 4))
        entries[10] = entries[40]
        x = np.concatenate([rng.integers(-scale, scale + 1, (3000, 4)), entries])
        got, far, evaluated = codes.nearest(x, entries)
        every = ((x[:, None, :] - entries) ** 2).sum(2)
        assert (far == every.min(1)).all() and (got == every.argmin(1)).all()
        reach = np.sqrt(every.min(1)) + 1e-6
        gap = np.abs(np.sqrt((x * x).sum(1))[:, None] - np.sqrt((entries**2).sum(1)))
        # no fewer than the annuli of the final distances hold, and not many more
        assert (gap <= reach[:, None]).sum() * 0.99 < evaluated < 1.35 * (gap <= reach[:, None]).sum() + 2 * len(x)
    wide = np.full((2, 256), codes.MOST)
    assert codes.nearest(-wide, wide[:1])[1].tolist() == [256 * (2 * codes.MOST) ** 2] * 2


def test_codes_stand_for_near_vectors(spark, as_table):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 32))
    rows = [(i, [float(c) for c in centres[i % 20] + rng.normal(size=32) * 0.01], 0) for i in range(400)]
    kept = codes.whole_vectors(spark.createDataFrame(rows, VECTORS))
    books = codes.train(kept)
    for r in codes.encoded(kept, books).collect()[:50]:
        back = codes.decoded(np.array([r.codes]), books)[0] / codes.SCALE
        assert np.abs(back - centres[r.vec_id % 20]).max() < 0.1


# ---------------------------------------------------------------- sharding


def check_slots(rows, got):
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.law for r in got} <= {"bytes"} and all(r.grown_shard is None for r in got)


def test_slots_of_odd_rows(spark, as_table):
    texts = [None, "", "é", "word " * 50, "y" * 20_000, "tie", "tie"]
    rows = [(i if i % 5 else None, texts[i % 7], "en", "s", i) for i in range(900)] + [(3, "hot", "en", "s", 1)] * 900
    got = sharding.op13_virtual_slots(spark, as_table(rows, DOCS, "documents")).collect()
    check_slots(rows, got)
    loads = Counter()
    for r in got:
        loads[r.shard] += r["size"]
    assert len(loads) == 40 and max(loads.values()) - min(loads.values()) <= 20_016
    again = sharding.op13_virtual_slots(spark, as_table(rows[::-1], DOCS, "documents")).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_slots_with_clashing_columns_and_none(spark, as_table):
    rows = [(i, f"T{i}", "en", "s", i, i, "t", "i", "d", 0, "a", "b", "c", 1) for i in range(9)]
    check_slots(rows, sharding.op13_virtual_slots(spark, as_table(rows, CLASH, "documents")).collect())
    assert sharding.op13_virtual_slots(spark, as_table([], DOCS, "documents")).count() == 0


def test_map_versions_and_growth(spark):
    """Each version is an edit: few slots move, loads come nearer; a new shard only takes."""
    weights = spark.range(512).select(F.col("id").alias("virtual_slot"), (F.pmod(F.col("id") * 7919, F.lit(1000)) + F.when(F.col("id") % 10 == 0, 5000).otherwise(0)).alias("bytes"), F.lit(1).alias("rows"))
    bytes_of = {r.virtual_slot: r.bytes for r in weights.collect()}
    read = lambda m: {r.virtual_slot: r.shard for r in m.collect()}

    def loads(m, n):
        out = [0] * n
        for slot, shard in m.items():
            out[shard] += bytes_of[slot]
        return out

    first = sharding.first_map(spark, 10, 512)
    second = sharding.rebalanced(first, weights, 10)
    a, b = read(first), read(second)
    spread = lambda m, n: max(loads(m, n)) - min(loads(m, n))
    assert set(a) == set(b) == set(range(512)) and spread(b, 10) < spread(a, 10) / 4
    third = read(sharding.grown(second, weights, 10))
    assert all(third[s] in (b[s], 10) for s in third)
    even = sum(bytes_of.values()) / 11
    assert 0.9 * even < loads(third, 11)[10] <= even
