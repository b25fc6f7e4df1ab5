"""The index kept up by a stream, against one made from scratch."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.streaming import note_index as S
from quillgraph.streaming.incremental import EVENT


def note(doi=None, cites=(), prose="", refs=(), title="T", pad=0):
    head = f"---\ntitle: {title}\n" + (f"doi: {doi}\n" if doi else "") + "---\n"
    links = "".join(f"See [({c})](obsidian://cite?doi={c}).\n" for c in cites)
    tail = "\n## References\n" + "".join(f"- {r}\n" for r in refs) if refs else ""
    return head + "\n" * pad + prose + "\n" + links + tail


def write(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(e) for e in events))


def event(seq, op, path, text=None, new_path=None):
    return {"seq": seq, "op": op, "path": path, "new_path": new_path, "text": text}


def kinds(index):
    return [(r.seq, r.path, r.kind) for r in index.feed().orderBy("seq", "path").collect()]


def test_only_what_others_depend_on_counts(spark, tmp_path):
    a, b = "Literature/a.md", "Literature/b.md"
    index = S.NoteIndex(spark, f"{tmp_path}/index")
    write(tmp_path / "in", "1", [event(1, "changed", a, note("10.1000/x", ["10.1/c"])), event(2, "changed", b, note("10.1000/x"))])
    index.run_available(f"{tmp_path}/in")
    assert kinds(index) == [(1, a, "changed"), (2, b, "changed")]
    assert {r.doi: r.owner for r in index.owners().collect()} == {"10.1000/x": a}
    write(tmp_path / "in", "2", [event(3, "changed", a, note("10.1000/x", ["10.1/c"], prose="Other words.")), event(4, "changed", a, note("10.1000/x", ["10.1/c"], pad=3))])
    index.run_available(f"{tmp_path}/in")
    assert kinds(index)[2:] == [(4, a, "moved")]  # prose: nothing; lines: moved
    # the owner goes and the next takes its DOI; a late event of its past changes nothing
    write(tmp_path / "in", "3", [event(6, "deleted", a), event(5, "changed", a, note("10.1000/y"))])
    write(tmp_path / "in", "4", [event(2, "changed", a, note("10.1000/z"))])
    index.run_available(f"{tmp_path}/in")
    assert kinds(index)[3:] == [(5, a, "changed"), (6, a, "deleted")]
    assert {r.doi: r.owner for r in index.owners().collect()} == {"10.1000/x": b}
    index.run_available(f"{tmp_path}/in")  # nothing new: nothing happens
    assert len(kinds(index)) == 5


@pytest.mark.parametrize("seed", [1, 2])
def test_random_histories_equal_an_index_from_scratch(spark, tmp_path, seed):
    rng = random.Random(seed)
    paths = [f"Literature/{c}.md" for c in "abcdef"] + ["Other/g.md"]
    texts, order, history = {}, {}, []
    for seq in range(1, 60):
        path = rng.choice(paths)
        op = rng.choice(["changed"] * 4 + ["deleted", "renamed"])
        doi = rng.choice([None, "10.1000/x", "10.1000/y"])
        text = note(doi, rng.sample(["10.1/c", "10.1/d"], rng.randint(0, 2)), rng.choice(["p", "q"]), rng.sample(["Smith, J. (2001). On birds.", "Lee, K. (1999). On fish."], rng.randint(0, 2)), pad=rng.randint(0, 1))
        if op == "changed":
            texts[path] = text
            history.append(event(seq, op, path, text))
        elif path in texts:
            old = texts.pop(path)
            if op == "deleted":
                history.append(event(seq, op, path))
            else:
                to = rng.choice([p for p in paths if p != path])
                texts[to] = old
                history.append(event(seq, op, path, old, to))
    # who holds a DOI since when, by going through the history once
    holds, since = {}, {}
    for e in history:
        ends = [e["path"]] if e["op"] != "changed" else []
        begins = e["new_path"] if e["op"] == "renamed" else e["path"] if e["op"] == "changed" else None
        for p in ends:
            holds.pop(p, None)
            since.pop(p, None)
        if begins:
            doi = next((line[5:] for line in e["text"].split("\n") if line.startswith("doi: ")), None)
            if doi is None:
                since.pop(begins, None)
            else:
                since.setdefault(begins, e["seq"])
            holds[begins] = doi
        held = {}
        for p in sorted(since, key=since.get):
            held.setdefault(holds[p], []).append(p)
        for doi in ("10.1000/x", "10.1000/y"):
            if order.get(doi) not in held.get(doi, []):
                order[doi] = held.get(doi, [None])[0]
    for k in range(0, len(history), 9):
        write(tmp_path / "in", f"{k:03}", history[k : k + 9])
    index = S.NoteIndex(spark, f"{tmp_path}/index")
    index.run_available(f"{tmp_path}/in", files_per_batch=3)
    events = spark.createDataFrame([(i, "changed", p, None, t) for i, (p, t) in enumerate(texts.items())], EVENT)
    fresh = S.signed(S.note_rows(events))
    want = {(r.path, r.signature, r.doi) for r in fresh.select("path", "signature", "doi").collect()}
    assert {(r.path, r.signature, r.doi) for r in index.notes().collect()} == want
    assert {r.doi: r.owner for r in index.owners().collect()} == {d: p for d, p in order.items() if p}
    assert index.feed().where(F.col("kind") == "deleted").count() > 0
