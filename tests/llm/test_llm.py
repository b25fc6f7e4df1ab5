"""Corpus operators against brute force, round trips and held-out labels, with the
edge cases of their contracts: nulls, empty and long texts, ties, repeated rows, empty
tables, extra columns with clashing names."""

import hashlib
import itertools
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import ann, bpe, common, mixing, neardup, pii, quality, topk, toxicity, urlfilter, warc
from quillgraph.llm.blocks import usable

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
needs_vocabulary = pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="no vocabularies")


def docs_of(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", "   ", "a", "word " * 30_000, "tie tie", "tie tie", "é" * 300, "x" * 100_000, "0 " * 200]

# ---------------------------------------------------------------- 1 WARC


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip_and_lookup(spark):
    big = "<p>ü</p>" * 400
    rows = [(1, "http://a/x\r\ny", big), (2, None, big), (3, "http://b/", "small"), (4, "http://c/", "small"), (5, "u", None), (6, "u", big + "!"), (7, "u", big), (7, "u", big), (None, "n", big)]
    root = common.new_path(spark, "warc-test")
    index = warc.write_archives(warc.plan_revisits(pages_of(spark, rows)), root, frame_bytes=5000)
    got = warc.read_archives(index, root, payloads=True).collect()
    assert len(got) == len(rows)
    want = {1: ("revisit", 7), 2: ("revisit", 7), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), None: ("revisit", 7)}
    html = {r[0]: r[2] or "" for r in rows}
    for r in got:
        assert (r.record_type, r.refers_to) == want[r.page_id]
        data = html[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert r.payload == (html[r.page_id] if r.record_type == "response" else None)
    assert len({(r.file, r.frame) for r in got}) > 1
    one = warc.fetch_records(spark.createDataFrame([(6,)], "page_id long"), index, root).collect()
    assert len(one) == 1 and one[0].payload == big + "!"


def test_warc_empty_and_seek_table(spark, tmp_path):
    root = common.new_path(spark, "warc-test")
    index = warc.write_archives(warc.plan_revisits(pages_of(spark, [])), root)
    assert warc.read_archives(index, root).count() == 0
    import zstandard

    path = tmp_path / "x.zst"
    with open(path, "wb") as f:
        w = warc.BundleWriter(f, 10)
        at = [w.add(x) for x in (b"a" * 8, b"b" * 8, b"c" * 30)]
        w.close()
    assert at == [(0, 0), (1, 0), (2, 0)]
    data = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert data == b"a" * 8 + b"b" * 8 + b"c" * 30  # any Zstandard reader takes the bundle


# ---------------------------------------------------------------- 2 URL filter


def test_url_filter_edges(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://WWW.Example.ORG/es/x"), (4, "https://a.example.org/en/12?q"), (5, "http://x.com/de/1"), (6, "http://x.com/fr/1"), (7, "http://n.net/p/?utm_source=a&x=1#f"), (8, "http://n.net/p"), (8, "http://n.net/p"), (9, "http://y.org"), (10, "http://notexample.org/es/"), (11, "http://com/de/"), (12, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash"))
    listed = spark.createDataFrame([("https://www.n.net/p/?x=1",), (None,), ("broken",)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages, listed).collect()}
    assert got[1] == ("", "", None, "allow") and got[2] == ("", "", None, "allow") and got[12] == ("", "", None, "allow")
    assert got[3] == ("www.example.org", "/es/x", "example.org/es/", "block") and got[4][2:] == ("example.org/en/1", "block")
    assert got[5][2:] == ("com/de/", "block") and got[6][2:] == ("com/fr/", "allow") and got[11][2:] == ("com/de/", "block")
    assert got[7] == ("n.net", "/p/", None, "block") and got[8] == ("n.net", "/p", None, "allow")
    assert got[9] == ("y.org", "", None, "allow") and got[10][2:] == ("org/", "allow")
    assert urlfilter.filter_urls(pages, listed).count() == len(rows)
    assert urlfilter.filter_urls(pages.limit(0), listed.limit(0)).count() == 0


def test_url_filter_without_broadcast_and_no_misses(spark):
    urls = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.net/"), F.col("id")).alias("url"))
    listed = urls.where("page_id % 3 = 0").select("url")
    for limit in (1 << 23, 0):
        got = urlfilter.filter_urls(urls, listed, broadcast_bytes=limit).collect()
        assert all((r.verdict == "block") == (r.page_id % 3 == 0) for r in got) and len(got) == 3000


# ---------------------------------------------------------------- 3 BPE


@needs_vocabulary
def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    ref, own = Tokenizer.from_file(path), bpe.vocabulary(path)
    rng = np.random.default_rng(8)
    parts = ["a", "b", "er", "th", "ing", " ", "  ", "\n", "\t", "1", "23", "é", "ñ", "'s", "<|endoftext|>", "<|endof", " ", "　", "中", "😀", "!", "...", "THE", "²", "\x00", "\x85", "́"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(1, 70))) for _ in range(1500)] + ["a" * 5000, "ab" * 3000, ""]
    want = [e.ids for e in ref.encode_batch(texts, add_special_tokens=False)]
    got = own.encode(texts)
    assert got == want
    assert [own.decode(x) for x in want] == [ref.decode(x, skip_special_tokens=False) for x in want]


@needs_vocabulary
def test_bpe_compatibility_is_exact():
    v = bpe.vocabulary(bpe.default_vocabulary())
    rng = np.random.default_rng(3)
    ids = np.array([i for i in v.guess.values() if len(v.bytes_of[i]) <= 6])
    a, b = rng.choice(ids, 4000), rng.choice(ids, 4000)
    got = v.compatible(a, b)
    want = [v.exact(v.bytes_of[x] + v.bytes_of[y]) == [x, y] for x, y in zip(a, b)]
    assert got.tolist() == want and 0 < sum(want) < 4000
    long = bytes(rng.choice(list(b"etaoin "), 300).tolist())
    short, bpe.SHORT = bpe.SHORT, 0
    try:
        by_heap = v.exact(long)
    finally:
        bpe.SHORT = 1000
        by_scan = v.exact(long)
        bpe.SHORT = short
    assert by_heap == by_scan


@needs_vocabulary
def test_bpe_documents(spark):
    docs = docs_of(spark, ODD).withColumn("ids", F.lit("clash"))
    enc = bpe.encode_documents(docs)
    dec = {r.doc_id: r.decoded for r in bpe.decode_documents(enc).collect()}
    assert [dec[i] for i in range(len(ODD))] == [t or "" for t in ODD]
    digest = {r.doc_id: r for r in bpe.digest_documents(docs).collect()}
    assert digest[0].n_tokens == 0 and digest[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    for r in enc.collect():
        assert digest[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert digest[r.doc_id].decoded_sha256 == hashlib.sha256((ODD[r.doc_id] or "").encode()).hexdigest()
    assert bpe.digest_documents(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 4 toxicity


def test_folding():
    assert toxicity.fold_text("1D10T") == " idiot "
    assert toxicity.fold_text("ѕсum​! Ï").split() == ["scum", "ï", "i"]  # accents stay, and are read again without
    assert toxicity.fold_text("e\u0301t\u00e9").split() == ["été", "ete"]
    assert toxicity.fold_text("ＬＯＳＥＲ").split() == ["loser"]
    assert "idiot" in toxicity.fold_text("an i.d.i-o t here").split() and "idiot" in toxicity.fold_text("1 d 1 0 7").split()
    assert toxicity.fold_text("a b c").split() == ["a", "b", "c"]


def test_toxicity_matches_equal_a_naive_search():
    rng = np.random.default_rng(9)
    lexicon = {" ab": 3.0, " abc ": 5.0, " bcd": 2.5, " " + "z" * 40 + " ": 4.0, " é": 6.0}
    auto = toxicity.automaton(lexicon)
    for _ in range(600):
        text = toxicity.fold_text(" ".join("".join(rng.choice(list("abcdé"), rng.integers(1, 7))) for _ in range(8)) + rng.choice([" " + "z" * 40, "", " " + "z" * 41]))
        start, inside = {}, {}
        for k, w in lexicon.items():
            for i in range(len(text)):
                if text.startswith(k, i) and w > start.get(i, ("", 0))[1]:
                    start[i] = (k, w)
                inner = k.strip()
                whole = not k.endswith(" ") or i + len(inner) < len(text) and text[i + len(inner)].isspace()
                if i and not text[i - 1].isspace() and text.startswith(inner, i) and whole and w > inside.get(i, ("", 0))[1]:
                    inside[i] = (k, w)
        got = toxicity.matches(auto, text)
        assert got[0] == [(a, *start[a]) for a in sorted(start)] and got[1] == [(a, *inside[a]) for a in sorted(inside)], text


def test_toxicity_phrases():
    folded = toxicity.fold_text("one, two  three four")
    assert toxicity.phrases(folded, folded.index(" two")) == ["one two", "two three"]
    assert toxicity.phrases(" two ", 0) == []


def test_toxicity_learns_long_words_and_many(spark):
    rng = np.random.default_rng(10)
    own = [f"{''.join(rng.choice(list('bcdfgh'), 30))}" for _ in range(6)]
    rows = [(i, " ".join([*rng.choice(["xa", "xe", "xi", "xo"], 20), *([own[i % 6]] if i % 4 == 0 else [])]), i) for i in range(240)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(quality.learning_rows(docs, labels, "toxic", 3, 1, keep=False))
    score = toxicity.score_texts(model, [f"xa xe {w} xi" for w in own[::2]] + ["xa xe xi xo", ""])
    assert (score[:3] >= toxicity.CUT).all() and (score[3:] < toxicity.CUT).all()


def test_toxicity_of_odd_tables(spark):
    docs, labels = labelled(spark, 60)
    odd = docs.union(docs.limit(5)).withColumn("score", F.lit("mine")).withColumn("y", F.lit(3)).withColumn("half", F.lit(0)).union(spark.createDataFrame([(None, None, None, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, score string, y int, half int"))
    model = toxicity.train(quality.learning_rows(odd, labels, "toxic", 3, 1, keep=False))
    assert toxicity.score_documents(odd, model).count() == 66 and toxicity.score_documents(odd.limit(0), model).count() == 0


def labelled(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    common_words = [f"w{a}{b}" for a in "bcdfg" for b in "aeiou"]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(common_words, 40))
        toxic = i % 5 == 0
        if toxic:
            words[5] = rng.choice(["idiot", "sc0m", "gloman", "glotix"])
        elif i % 3 == 0:
            words[7], words[8] = "idiot", "savant"
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_words_stems_and_exceptions(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(quality.learning_rows(docs, labels, "toxic", 3, 1, keep=False))
    keys = {k.strip() for k in model["lexicon"]}
    assert {"glom", "glot"} <= keys or "glo" in keys
    texts = ["wba wbe glossy", "wba GLOmanic wbe", None, "", "wba wbe wbi"]
    score = toxicity.score_texts(model, texts)
    assert score[1] > score[4] and score[2] == score[3] and ((0 <= score) & (score <= 1)).all()
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i % 5 == 0) for i in held]) > 0.9


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, ODD)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(quality.learning_rows(docs, labels, "toxic", 3, 1, keep=False))
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)


# ---------------------------------------------------------------- 5, 6 vectors


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_top(x, ids, q, k):
    s = x[q] @ x.T
    order = sorted((i for i in range(len(ids)) if ids[i] != ids[q]), key=lambda i: (-s[i], ids[i]))
    return [(int(ids[i]), s[i]) for i in order[:k]]


def test_ann_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    x = np.float32(rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, (1500, 1)))
    v = usable(vectors_of(spark, [(i, r.tolist(), 0) for i, r in enumerate(x)]), zero=False)
    got = ann.nearest(v, v.where("vec_id % 20 = 0"), 20).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x64, ids, hits = x.astype(float), np.arange(1500), 0
    for q, rows in by.items():
        want = brute_top(x64, ids, q, 20)
        hits += len({i for i, _ in want} & {i for _, i, _ in rows})
        assert [r for r, _, _ in sorted(rows)] == list(range(1, 21))
        assert all(abs(s - x64[q] @ x64[i]) < 1e-9 for _, i, s in rows)
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in itertools.pairwise(sorted(rows)))
    assert len(by) == 75 and hits / (75 * 20) >= 0.9


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (20, [1.0, 0.0], 0), (40, [0.0, 0.0], 0), (1, None, 0), (2, [nan, 1.0], 0), (3, [inf, 1.0], 0), (4, [None, 1.0], 0), (5, [1.0], 0), (6, [-1.0, 0.5], 0), (0, [1.0, 0.0], 0), (None, [1.0, 1.0], 0)]
    table = vectors_of(spark, rows)
    v = usable(table, zero=False)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(v, v.where("vec_id % 20 = 0"), 20).collect()}
    assert got == {(0, 1): (5, 1.0), (0, 2): (20, 1.0), (0, 3): (6, -1.0), (20, 1): (0, 1.0), (20, 2): (5, 1.0), (20, 3): (6, -1.0)}
    z = usable(table, zero=True)
    top = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(z, z.where("vec_id % 50 = 0"), 5).collect()}
    assert top == {(0, 1): (5, 65536), (0, 2): (20, 65536), (0, 3): (40, 0), (0, 4): (6, -65536)}
    none = v.limit(0)
    assert ann.nearest(none, none, 20).count() == 0 and topk.top_k(none, none, 5).count() == 0


def test_topk_is_exact_with_ties(spark):
    rng = np.random.default_rng(5)
    x = np.float32(rng.integers(-3, 4, (700, 10)) / 7)
    v = usable(vectors_of(spark, [(i, r.tolist(), 0) for i, r in enumerate(x)]), zero=True)
    q = np.floor(256 * x.astype(float))
    for shard in (16_384, 90):
        topk_rows = _with_shards(shard, lambda: topk.top_k(v, v.where("vec_id % 50 = 0"), 5).collect())
        got = {}
        for r in topk_rows:
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        for i, rows in got.items():
            assert [(v_, s) for _, v_, s in sorted(rows)] == [(a, int(b)) for a, b in brute_top(q, np.arange(700), i, 5)]
        assert len(got) == 14


def test_topk_resolves_few_pairs():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, q = np.arange(6000), np.floor(256 * x)
    r, vec, score, resolved = topk.resolve(x, ids, x[:200], ids[:200], np.full(200, -np.inf), 5)
    for i in range(0, 200, 20):
        assert [(int(v), int(s)) for v, s in zip(vec[r == i], score[r == i])] == [(a, int(b)) for a, b in brute_top(q, ids, i, 5)]
    heads = np.sort((q[:200] @ q[1000:3000].T), axis=1)[:, -5]  # any vectors give a safe cutoff
    again = topk.resolve(x, ids, x[:200], ids[:200], heads, 5)
    assert (again[1] == vec).all() and (again[2] == score).all()
    assert again[3] < 0.25 * 200 * 6000 and again[3] < resolved


def test_topk_of_large_numbers(spark):
    rows = [(0, [3e17, 1.0], 0), (1, [2e17, 5.0], 0), (2, [-1e17, 0.5], 0), (50, [1.0, 1.0], 0)]
    v = usable(vectors_of(spark, rows), zero=True)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 5).collect()}
    assert got[0, 1] == (1, 2**63 - 1) and got[0, 3] == (2, -(2**63)) and got[50, 1][0] == 0


@pytest.mark.parametrize("kind", ["unit", "lognormal", "one long", "clustered"])
@pytest.mark.parametrize("width", [64, 256])
def test_ann_recall_of_unequal_norms(kind, width):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lognormal":
        x *= rng.lognormal(0, 1, size=(3000, 1))
    if kind == "one long":
        x[7] *= 100
    if kind == "clustered":
        x = x[rng.integers(0, 40, 3000)] + x * 0.3
    ids = np.arange(3000)
    r, vec, score, verified = ann.search(ann.Shard(x, ids, np.linalg.norm(x, axis=1).max()), x[:100], ids[:100], np.full(100, -np.inf), 20)
    hits = sum(len({i for i, _ in brute_top(x, ids, i, 20)} & set(vec[r == i].tolist())) for i in range(100))
    assert hits >= 0.92 * 2000 and np.allclose(score, (x[r] * x[vec]).sum(1))
    assert verified < {"unit": 0.95, "one long": 0.95, "lognormal": 0.5, "clustered": 0.5}[kind] * 100 * 3000


def test_ann_cells_and_rounds(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 20))
    x = centres[rng.integers(0, 30, 2000)] + 0.2 * rng.normal(size=(2000, 20))
    x = np.float32(x / np.linalg.norm(x, axis=1, keepdims=True)).astype(float)
    x[100:160] = x[100]  # a hot vector
    v = usable(vectors_of(spark, [(i, r.tolist(), 0) for i, r in enumerate(x)]), zero=False)
    got = {}
    for r in ann.nearest(v, v.where("vec_id % 20 = 0"), 20, shard_rows=100, block_rows=30).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = sum(len({i for i, _ in brute_top(x, np.arange(2000), q, 20)} & {i for _, i, _ in rows}) for q, rows in got.items())
    assert len(got) == 100 and hits >= 0.9 * 2000
    # copies of a query's vector tie, and the smaller ids win
    assert [i for _, i, _ in sorted(got[100])] == [i for i in range(101, 121)]


def test_repeated_vectors_and_other_columns(spark):
    rows = [(0, [1.0, 2.0], 5), (0, [0.5, 2.0], 6), (50, [1.0, 1.0], 7), (50, [1.0, 1.0], 8), (7, [3.0, 0.0], 9)]
    t = vectors_of(spark, rows).withColumn("v", F.lit("mine")).withColumn("rank", F.lit(0)).withColumn("is_query", F.lit(True)).withColumn("query_id", F.lit(1))
    z, v = usable(t, zero=True), usable(t, zero=False)
    top = [tuple(r) for r in topk.top_k(z, z.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()]
    assert top == [(0, 1, 50, 2 * 65536 + 32768), (0, 2, 7, 98304), (50, 1, 7, 3 * 65536), (50, 2, 0, 2 * 65536 + 32768)]
    near = [tuple(r) for r in ann.nearest(v, v.where("vec_id % 50 = 0"), 20).orderBy("query_id", "rank").collect()]
    assert near == [(0, 1, 50, 2.5), (0, 2, 7, 1.5), (50, 1, 7, 3.0), (50, 2, 0, 2.5)]


def _with_shards(rows, run):
    from quillgraph.llm import blocks

    old = blocks.paired.__kwdefaults__["shard_rows"]
    blocks.paired.__kwdefaults__["shard_rows"] = rows
    try:
        return run()
    finally:
        blocks.paired.__kwdefaults__["shard_rows"] = old


# ---------------------------------------------------------------- 7 near duplicates


def bag(text):
    w = text.lower().split()
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows):
    least, root = {}, {}
    for i, t in rows:
        if t is not None:
            least[t] = min(least.get(t, i), i)
    bags = {i: bag(t) for t, i in least.items()}
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(bags), 2):
        if bags[a] and jaccard(bags[a], bags[b]) >= 0.8:
            u, v = find(a), find(b)
            root[max(u, v)] = min(u, v)
    return {i: find(least[t]) if t is not None else i for i, t in rows}


def test_bag_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    for top in (2, 9, 1000):
        a = {i: int(rng.integers(1, top)) for i in range(150)}
        b = {i: max(1, int(v * rng.uniform(0.6, 1.4))) for i, v in a.items() if rng.random() < 0.9} | {999 + i: 3 for i in range(9)}
        doc = np.repeat([0, 1], [len(a), len(b)])
        h = neardup.mix64(np.array([*a, *b], np.uint64))
        s = neardup.bag_minhash(doc, h, np.array([*a.values(), *b.values()]), 2, 4096)
        assert abs((s[0] == s[1]).mean() - jaccard(Counter(a), Counter(b))) < 0.035


@pytest.mark.parametrize("small", [64, 2])
def test_near_classes_equal_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(500)]
    base = list(rng.choice(words, 120))
    texts = []
    for _ in range(60):
        own = base[:]
        for _ in range(int(rng.integers(0, 6))):
            own[int(rng.integers(120))] = str(rng.choice(words))
        texts.append(" ".join(own))
    texts += [" ".join(rng.choice(words, 80)) for _ in range(20)] + texts[:3] + ["Same words", "same  WORDS", "", "", " ", None, None, "x", "long " * 20_000]
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in neardup.classify(docs.withColumn("key", F.lit(1))).collect()} == want
    kept = neardup.keep_one(docs.withColumn("extra", F.lit(1)).union(docs.withColumn("extra", F.lit(1)).limit(5)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_near_dedup_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.classify(empty).count() == 0


def test_repeated_ids_keep_their_texts(spark):
    """Rows that repeat a doc_id with other texts are documents of their own."""
    a, b = " ".join(f"word{i}" for i in range(60)), " ".join(f"other{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a), (3, b + " more"), (1, a), (None, a), (4, None), (4, None)]
    docs = docs_of(spark, [t for _, t in rows]).withColumnRenamed("doc_id", "row")
    ids = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(rows)], "row long, doc_id long")
    docs = docs.join(ids, "row")
    got = sorted(((r.doc_id, r.class_id) for r in neardup.classify(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (1, 1), (None, 1), (4, 4), (4, 4)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in neardup.keep_one(docs).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (None, a), (4, None), (4, None)], key=str)


# ---------------------------------------------------------------- 8 mixing


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        rate = (total - sum(fixed.values())) / max(1, sum(w[s] for s in rest))
        over = [s for s in rest if rate * w[s] >= cap * sizes[s]]
        if not over:
            return fixed | {s: rate * w[s] for s in rest}
        fixed |= {s: float(cap * sizes[s]) for s in over}


def test_mix_targets_and_limits(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join("w" for _ in range(int(rng.integers(0, 60)))), rng.choice(["a", "b", "big", "zß", "é"], p=[0.02, 0.1, 0.6, 0.2, 0.08])) for i in range(900)]
    rows += [(900, None, "a"), (901, "", None), (902, "x y z", None), (902, "x y z", None), (None, "q", "b")]
    docs = spark.createDataFrame([(a, b, None if c is None else str(c)) for a, b, c in rows], "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    first, again = (mixing.mix(docs, shard_docs=64).collect() for _ in range(2))
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == len(rows)
    size = {}
    for a, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = brute_targets({None if k is None else str(k): v for k, v in size.items()})
    by_size = {(size[k], round(target[None if k is None else str(k)], 6)): 0 for k in size}
    for r in first:
        by_size[r.source_size, round(r.target, 6)] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    for (_, t), taken in by_size.items():
        assert abs(taken - t) <= max(3, 0.02 * t)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_sainte_lague_by_quotients(spark):
    rng = np.random.default_rng(1)
    votes = [int(v) for v in rng.integers(1, 5000, 23)]
    parties = spark.createDataFrame([(i, float(v), 301, 10_000) for i, v in enumerate(votes)], "pos int, votes double, seats long, most long")
    got = {r.pos: r.won for r in mixing.sainte_lague(parties, [], "pos", "votes", "seats", "most").collect()}
    quotients = sorted(((v / (2 * k + 1), -i) for i, v in enumerate(votes) for k in range(301)), reverse=True)[:301]
    assert got == {i: sum(1 for _, j in quotients if -j == i) for i in range(len(votes))}


def test_apply_mix_keeps_words(spark):
    docs = docs_of(spark, [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(40)])
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    assert abs(sum(len(r.text.split()) for r in out.collect()) - sum(taken.values())) <= 60


# ---------------------------------------------------------------- 9 PII

BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(text):
    out = []
    for k, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 13 <= len(digits) <= 19 and pii.luhn(digits) or k == 3 and 9 <= len(digits) <= 15:
                out.append((k, *m.span()))
    return out


def test_pii_base_equals_the_patterns():
    rng = np.random.default_rng(7)
    chars, parts = list("a1.@+- (2)0é%\n"), ["1.2.3.4", "256", "4111111111111111", "4111 1111-1111 1111", "a@b.c", "@", ".", " ", "+1 (555) 123-4567", "0004", "x"]
    for i in range(8000):
        text = "".join(rng.choice(chars if i % 2 else parts, rng.integers(0, 20 if i % 2 else 7)))
        assert pii.base_spans(text)[0] == brute_base(text), text
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pii_skip_chain_adds_repeats_and_keeps_base():
    rng = np.random.default_rng(1)
    train = [f"aa bb +1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)} cc 3.1 dd 2001 x.{i}@mail.org ee 10.{i % 250}.3.4" for i in range(300)]
    model = pii.fit(train)
    text = "Call +1 (988) 555-2485 or (988) 555-2485, not 555-1111 or 2001."
    base, every = pii.all_spans([text], model)[0]
    assert [text[a:b] for _, a, b in base] == ["+1 (988) 555-2485"]
    assert set(base) <= set(every) and "(988) 555-2485" in [text[a:b] for _, a, b in every]
    assert not any("2001" in text[a:b] for _, a, b in every)
    assert pii.all_spans([""], model) == [([], [])]


def test_pii_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    for loops, close in ((False, 1e-4), (True, 0.05)):
        for _ in range(20):
            n, c = 5, 3
            score, chain_w, skip_w = rng.normal(size=(n, c)), rng.normal(size=(c, c)), np.eye(c) * 0.8
            chain = np.array([(0, 1), (1, 2)])
            skip = np.array([(2, 3), (3, 4), *([(0, 4)] if loops else [])])
            want = np.zeros((n, c))
            for y in itertools.product(range(c), repeat=n):
                e = sum(score[i, y[i]] for i in range(n)) + sum(chain_w[y[a], y[b]] for a, b in chain) + sum(skip_w[y[a], y[b]] for a, b in skip)
                for i in range(n):
                    want[i, y[i]] += np.exp(e)
            want /= want.sum(1, keepdims=True)
            got = pii.propagated(score, chain, skip, chain_w, skip_w, rounds=80)
            assert np.abs(got - want).max() < close


def test_pii_adds_what_the_patterns_lose(spark):
    rng = np.random.default_rng(4)
    phone = lambda: f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
    card = lambda: (h := f"4{rng.integers(10**13, 10**14)}") + next(str(k) for k in range(10) if pii.luhn(h + str(k)))
    rows = [f"ab {phone()} cd {card()} ef {rng.integers(1, 255)}.3.{i % 250}.9 gh u{i}@mail.org ij {rng.integers(10**15, 10**16)} version 3." for i in range(300)]
    model = pii.fit([pii.reduced(t) for t in rows])
    a, b, d = card(), card(), phone()
    text = f"both {a} {b} here, then {d} 10.20.30.40 and 2.0. twice 2001"
    base, every = pii.all_spans([text], model)[0]
    added = [(pii.KINDS[k], text[x:y]) for k, x, y in every if (k, x, y) not in base]
    assert added == [("card", a), ("card", b), ("phone", d)] and set(base) <= set(every)
    # tokens that differ only behind their two hundredth character aren't the same
    long = [f"{'7' * 250}1", f"{'7' * 250}2"]
    assert not len(pii.Graph([f"{long[0]} x {long[1]}"]).skip) and len(pii.Graph([f"{long[0]} x {long[0]}"]).skip) == 1


def test_pii_threshold_by_precision():
    assert pii.least_threshold(np.array([0.99, 0.9, 0.8, 0.7]), np.array([True, True, True, False])) == pytest.approx(0.75)
    assert pii.least_threshold(np.array([0.9]), np.array([False])) > 0.9 and pii.least_threshold(np.zeros(0), np.zeros(0, bool)) == pii.THRESHOLD


def test_pii_sample_of_hot_rows(spark):
    rows = [(None, "same 10.0.0.1 text")] * 500 + [(i, f"own {i} 10.0.{i % 200}.7") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sample = pii.training_sample(docs, limit=50, among=400)
    assert len(sample) == 50 and sum("10.0.0.1 " in t for t in sample) <= 2 and all(len(t) < 40 for t in sample)
    assert sum(map(len, pii.training_sample(docs, chars=200))) <= 200


def test_pii_documents(spark):
    texts = [*ODD, "mail a@b.cd and 10.0.0.1", "1" * 50_000, "@" * 50_000, "9 " * 30_000]
    docs = docs_of(spark, texts).withColumn("spans", F.lit(1))
    model = pii.train(docs)
    got = {r.doc_id: r for r in pii.find_spans(docs, model).collect()}
    assert len(got) == len(texts) and got[0].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[10].n_email, got[10].n_ip) == (1, 1)
    out = {r.doc_id: r for r in pii.redact_documents(docs, model).collect()}
    assert out[10].text == "mail <EMAIL> and <IP>" and out[10].n_chars == len(out[10].text) and out[0].text is None
    assert pii.find_spans(docs.limit(0), pii.train(docs.limit(0))).count() == 0


# ---------------------------------------------------------------- 10 quality


def test_factorisation_machine_identity():
    rng = np.random.default_rng(2)
    model = {"w": rng.normal(size=quality.COLUMNS), "v": rng.normal(size=(quality.COLUMNS, quality.FACTORS)), "b": 0.3}
    col, value = rng.choice(quality.COLUMNS, 12, replace=False), rng.normal(size=12)
    z, _, _ = quality.machine(model, np.array([0, 12]), col, value)
    pairs = sum(model["v"][col[i]] @ model["v"][col[j]] * value[i] * value[j] for i, j in itertools.combinations(range(12), 2))
    assert np.isclose(z[0], 0.3 + model["w"][col] @ value + pairs)


def test_quality_scores_all_texts(spark):
    texts = [f"A calm line of words number {i} and more words here." if i % 4 else "BUY!! NOW!! CHEAP!! " * 5 for i in range(400)]
    docs = docs_of(spark, texts).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(quality.learning_rows(docs, labels, "quality", 5, 0, keep=False))
    got = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    assert np.mean([(got[i] >= quality.CUT) == (i % 4 > 0) for i in got]) > 0.98
    odd = quality.score(model, pa.array(ODD, pa.string()))
    assert ((odd >= 0) & (odd <= 1)).all() and odd[0] == odd[1]
    none = quality.train(quality.learning_rows(docs, labels.limit(0), "quality", 5, 0, keep=False))
    assert quality.score_documents(docs.limit(3), none).count() == 3
    assert quality.score_documents(docs.limit(0), none).count() == 0


# ---------------------------------------------------------------- the queries


@needs_tables
def test_pipeline_and_queries_run(spark):
    import __spark_entry__ as entry
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.where("not round_trip").count() == 0
    assert {f"op{i}" for i in range(1, 11)} == {n.split("_")[0] for n in entry.queries() if re.match(r"op\d+_", n)}


@needs_tables
@pytest.mark.parametrize("name", ["op1_warc_bundle", "op2_url_filter", "op6_top_k", "op8_source_mix"])
def test_sql(spark, name):
    import duckdb

    from quillgraph.llm.catalog import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), c.sql(ORACLE_SQL[name])
    rows = sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect())))
    assert rows == sorted(map(str, want.fetchall()))


@needs_vocabulary
def test_pipeline_stages_alone_against_brute_force(spark, tmp_path):
    """Each stage on odd rows: nulls, empty and long texts, repeats, other columns."""
    import corpus_pipeline

    rng = np.random.default_rng(12)
    words = [f"w{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnr"]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(30)]
    texts += [texts[3], texts[3] + " more", "", None, None, "word " * 20_000, f"mail a.b@c.org or 10.1.2.3 {texts[5]}"]
    rows = [(i, t, "en", [None, "s1", "s2"][i % 3], len(t) if t is not None else None, 0.5, f"c{i}", i) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "no id", "en", "s1", 5, 0.5, "c", 1)]
    docs = spark.createDataFrame(rows, DOCS + ", score double, row string, spans int")
    labels = [(i, int(i % 2 == 0), 0) for i in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    table = lambda df: sorted(map(tuple, df.collect()), key=str)

    model = quality.train_query(spark, docs, str(tmp_path))
    scores = quality.score(model, pa.array([r[1] for r in rows], pa.string()))
    assert table(stages["quality"](spark, docs, str(tmp_path))) == sorted((r for r, s in zip(rows, scores) if s >= quality.CUT), key=str)

    classes = brute_classes([(i, t) for i, t in enumerate(texts)])
    kept = stages["near_dedup"](spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(i for i, c in classes.items() if i == c)
    assert sum(r.doc_id is None for r in kept) == 1 and kept[0].asDict().keys() == set(docs.columns)

    model = pii.train(docs)
    want = []
    for r in rows:
        _, spans = pii.all_spans([r[1] or ""], model)[0]
        clean = pii.redact(r[1], spans) if spans else r[1]
        want.append((r[0], clean, r[2], r[3], r[4] if clean == r[1] else len(clean), *r[5:]))
    got = table(stages["pii"](spark, docs, str(tmp_path)))
    assert got == sorted(want, key=str) and any("<EMAIL>" in (r[1] or "") and "<IP>" in r[1] for r in got)

    mixed = stages["mix"](spark, docs, str(tmp_path))
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_source, size = Counter(), Counter()
    for r in mixed.collect():
        by_source[r.source] += count(r.text)
        assert (texts[r.doc_id] if r.doc_id is not None else "no id").startswith(r.text.rstrip()[:40])
    for r in rows:
        size[r[3]] += count(r[1])
    target = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(size.items()), "source string, source_size long")).collect()}
    assert all(abs(by_source[k] - target[k]) <= 0.05 * target[k] + 1024 for k in target) and mixed.columns == docs.columns

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_vocabulary())
    tokenizer.no_padding()
    tokenizer.no_truncation()
    encoded = stages["bpe"](spark, docs, str(tmp_path)).collect()
    assert len(encoded) == len(rows)
    for r in encoded:
        if r.doc_id is not None:
            assert r.ids == tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
