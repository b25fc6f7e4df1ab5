"""The paged source: stored responses in a folder, and a server of our own."""

import http.server
import json
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import external, service

WORKS = "id string, doi string, title string, year int, authors array<string>, venue string, references array<string>, cited_by_count long, topics array<struct<id:string,name:string,score:double>>, keywords array<struct<name:string,score:double>>, abstract string, partial boolean, trimmed boolean"


def raw(n, **more):
    return {"id": f"https://works.example/W{n}", "doi": f"https://doi.org/10.1/{n}", "display_name": f"Work {n}", "publication_year": 2000 + n, "referenced_works": ["https://works.example/W1"]} | more


def store(folder, field, values, status=200, results=(), per_page=50, cursor=None, following=None, body=None):
    name = service.request_name("/works", service.request_params(field, values, per_page, cursor))
    body = body if body is not None else json.dumps({"meta": {"count": len(results), "next_cursor": following}, "results": list(results)})
    (folder / name).write_text(json.dumps({"status": status, "body": body}))


def frames(spark, known=(), works=()):
    empty = lambda w: (w["id"], w.get("doi"), "old", None, [], None, [], None, None, None, None, w.get("partial", False), w.get("trimmed", False))
    return spark.createDataFrame(list(known), "value string, id string"), spark.createDataFrame([empty(w) for w in works], WORKS)


def values(spark, *dois):
    return spark.createDataFrame([(d,) for d in dois], "value string")


def as_dict(known):
    return {r.value: r.id for r in known.collect()}


def test_found_and_unknown(spark, tmp_path):
    """What an answered batch doesn't bring is known to be unknown; null isn't asked."""
    store(tmp_path, "doi", ["10.1/1", "10.1/2", "10.1/3"], results=[raw(1), raw(3)])
    known, works, ends = service.fetch(values(spark, "10.1/2", "https://doi.org/10.1/1", "10.1/3", "10.1/3", None), *frames(spark), str(tmp_path))
    assert as_dict(known) == {"10.1/1": "W1", "10.1/2": None, "10.1/3": "W3"}
    assert {r.id: (r.title, r.year, r.partial) for r in works.collect()} == {"W1": ("Work 1", 2001, False), "W3": ("Work 3", 2003, False)}
    assert [r.state for r in ends.collect()] == ["done"]


def test_nothing_to_ask(spark, tmp_path):
    known, works, ends = service.fetch(values(spark), *frames(spark), str(tmp_path))
    assert (known.count(), works.count(), ends.count()) == (0, 0, 0)
    known, works, ends = service.fetch(values(spark, "10.1/9"), *frames(spark, [("10.1/9", None)]), str(tmp_path))
    assert as_dict(known) == {"10.1/9": None} and ends.count() == 0


def test_a_404_is_an_answer(spark, tmp_path):
    known, _, ends = service.fetch(values(spark, "10.1/1"), *frames(spark), str(tmp_path))
    assert as_dict(known) == {"10.1/1": None} and ends.first().state == "absent"


@pytest.mark.parametrize("status, state", [(429, "limited"), (500, "failed"), (403, "failed")])
def test_no_answer_teaches_nothing(spark, tmp_path, status, state):
    store(tmp_path, "doi", ["10.1/1"], status=status, body="Daily budget used up")
    known, works, ends = service.fetch(values(spark, "10.1/1"), *frames(spark), str(tmp_path), interval=0)
    end = ends.first()
    assert known.count() == works.count() == 0 and end.state == state
    assert (end.until is not None) == (status == 429) and (end.until or 0) % 86_400_000 == 0


def test_partial_and_trimmed_works_are_asked_again(spark, tmp_path):
    known, works = frames(spark, [("10.1/1", "W1"), ("10.1/2", "W2"), ("10.1/3", "W3"), ("10.1/4", None)], [{"id": "W1", "partial": True}, {"id": "W2", "trimmed": True}, {"id": "W3"}])
    asked = values(spark, "10.1/1", "10.1/2", "10.1/3", "10.1/4", "10.1/5")
    want = lambda whole: {r.value for r in service.to_refetch(asked, known, works, whole=whole).collect()}
    assert want(False) == {"10.1/1", "10.1/5"} and want(True) == {"10.1/1", "10.1/2", "10.1/5"}
    store(tmp_path, "doi", ["10.1/1", "10.1/2", "10.1/5"], results=[raw(1), raw(2)])
    known, works, _ = service.fetch(asked, known, works, str(tmp_path), whole=True)
    assert as_dict(known) == {"10.1/1": "W1", "10.1/2": "W2", "10.1/3": "W3", "10.1/4": None, "10.1/5": None}
    assert {r.id: (r.title, r.partial, r.trimmed, r.references) for r in works.collect()} == {"W1": ("Work 1", False, False, ["W1"]), "W2": ("Work 2", False, False, ["W1"]), "W3": ("old", False, False, [])}


@pytest.mark.parametrize("budget", [0, 3, 100])
def test_the_budget_is_kept_over_all_tasks(spark, tmp_path, budget):
    dois = [f"10.1/{i:04}" for i in range(500)]
    for i in range(0, 500, 50):
        store(tmp_path, "doi", dois[i : i + 50], results=[raw(int(d[5:])) | {"doi": d} for d in dois[i : i + 50 : 2]])
    known, _, ends = service.fetch(values(spark, *dois), *frames(spark), str(tmp_path), budget=budget, tasks=4)
    states = [r.state for r in ends.collect()]
    assert len(states) == 10 and states.count("done") == min(budget, 10) and states.count("unasked") == 10 - min(budget, 10)
    found = as_dict(known)
    assert len(found) == 50 * min(budget, 10) and sum(v is None for v in found.values()) == len(found) // 2
    # the next run asks for the rest alone
    left = service.to_refetch(values(spark, *dois), known, frames(spark)[1]).count()
    assert left == 500 - len(found)


def test_listings_follow_cursors(spark, tmp_path):
    """Three pages, none, and one that breaks off: it isn't a listing."""
    kept = dict(per_page=200, field="cites")
    store(tmp_path, values=["W1"], cursor="*", following="c1", results=[raw(5), raw(4)], **kept)
    store(tmp_path, values=["W1"], cursor="c1", following="c2", results=[raw(3)], **kept)
    store(tmp_path, values=["W1"], cursor="c2", following="c3", results=[], **kept)
    store(tmp_path, values=["W2"], cursor="*", results=[], **kept)
    store(tmp_path, values=["W3"], cursor="*", following="gone", results=[raw(6)], **kept)
    ids = spark.createDataFrame([("W1",), ("W2",), ("W3",)], "id string")
    pages, ends = service.citing_pages(ids, str(tmp_path), interval=0)
    assert {(r.id, r.page): r.results for r in pages.collect()} == {("W1", 0): ["W5", "W4"], ("W1", 1): ["W3"]}
    states = {r.id: r.state for r in ends.collect()}
    assert states == {"W1": "done", "W2": "done", "W3": "failed"}
    lists = spark.createDataFrame([], "id string, at long, ids array<string>")
    listed = external.citing_lists(lists, ends.where("state = 'done'").select("id"), pages.withColumn("at", F.lit(7).cast("long")))
    assert {r.id: r.ids for r in listed.collect()} == {"W1": ["W5", "W4", "W3"], "W2": []}


@pytest.fixture
def server():
    """Answers all but the first request of each batch, and none for what is called never."""
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))["filter"]
            seen.append((asked, self.headers.get("Authorization")))
            first = [a for a, _ in seen].count(asked) == 1
            code = 503 if "never" in asked else 429 if first else 200
            body = json.dumps({"results": [raw(1)]}) if code == 200 else "too many requests"
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    http_server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http_server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http_server.server_port}", seen
    http_server.shutdown()


def test_a_live_service_is_asked_again_after_an_overload(spark, server):
    address, seen = server
    known, _, ends = service.fetch(values(spark, "10.1/1"), *frames(spark), address, interval=0, token="key")
    assert as_dict(known) == {"10.1/1": "W1"} and seen == [("doi:10.1/1", "Bearer key")] * 2
    known, _, ends = service.fetch(values(spark, "10.1/1"), *frames(spark), address, interval=0, retries=0)
    assert as_dict(known) == {"10.1/1": "W1"}
    known, _, ends = service.fetch(values(spark, "10.1/never"), *frames(spark), address, interval=0, retries=3)
    assert known.count() == 0 and ends.first().state == "failed" and sum("never" in a for a, _ in seen) == 4


def test_read_by_its_name(spark, tmp_path):
    spark.dataSource.register(service.ServiceSource)
    spark.createDataFrame([("10.1/1", 0), ("10.1/2", 1)], "value string, batch long").write.parquet(str(tmp_path / "asked"))
    store(tmp_path, "doi", ["10.1/1"], results=[raw(1)])
    got = spark.read.format("works_service").options(service=str(tmp_path), asked=str(tmp_path / "asked"), batches="2", tasks="2").load()
    assert got.rdd.getNumPartitions() == 2
    assert sorted((r.batch, r.page, r.pos, r.state, r.total) for r in got.collect()) == [(0, 0, 0, "record", None), (0, 1, -1, "done", 1), (1, 0, -1, "absent", None)]
