"""A service of works as a Spark source: requests in batches, pages by cursor, retries, a
budget, and negative answers.

    spark.dataSource.register(ServiceSource)
    spark.read.format("works_service").options(service=..., asked=..., batches=...).load()

`service` is a folder of stored responses (a file for each request) or an http(s)
address. `asked` is a Parquet table (value, batch), so that what is asked for never
passes through the driver; a task reads the batches of its range. All executors must
reach both. `fetch` does the whole way from values to a store's new rows.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillgraph.functions.text import normalize_doi
from quillgraph.lineage import cut, own_dir
from quillgraph.operators.order import numbered
from quillgraph.sources.external import BATCH, PAGE
from quillgraph.sources.snapshot import RAW, summarize

#: A record of a page, or how a batch ended (pos -1): done, absent (404), limited (429 or
#: the budget's end, nothing is known), failed, unasked. until: when a limit ends, in ms.
ROWS = "batch long, page int, pos int, state string, total long, until long, record string"
#: Ends after which it is known that what didn't come isn't there.
SETTLED = ("done", "absent")
#: How long an overload lasts if the service doesn't say, in ms.
OVERLOAD = 60_000


def request_name(path: str, params: dict[str, str]) -> str:
    """The file of a request's stored response."""
    asked = f"{path}?{urllib.parse.urlencode(sorted(params.items()))}"
    return hashlib.sha1(asked.encode()).hexdigest() + ".json"


def request_params(field: str, values: list[str], per_page: int, cursor: str | None = None) -> dict[str, str]:
    return {"filter": f"{field}:{'|'.join(values)}", "per-page": str(per_page)} | ({"cursor": cursor} if cursor else {})


def stored_answer(folder: str, path: str, params: dict[str, str]) -> tuple[int, str]:
    """A stored response is {"status": ..., "body": ...}; none is a 404."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    try:
        with system.open_input_stream(f"{base}/{request_name(path, params)}") as f:
            found = json.loads(f.read())
    except FileNotFoundError:
        return 404, ""
    return found["status"], found["body"]


def live_answer(address: str, path: str, params: dict[str, str], token: str | None) -> tuple[int, str]:
    """One GET; a connection that fails counts as a 503."""
    headers = {"Authorization": f"Bearer {token}"} if token else {}
    try:
        with urllib.request.urlopen(urllib.request.Request(f"{address}{path}?{urllib.parse.urlencode(params)}", headers=headers), timeout=60) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")
    except (urllib.error.URLError, TimeoutError, ConnectionError):
        return 503, ""


def next_midnight() -> int:
    now = datetime.datetime.now(datetime.UTC)
    return int((now.replace(hour=0, minute=0, second=0, microsecond=0) + datetime.timedelta(days=1)).timestamp() * 1000)


class Batches(InputPartition):
    """Batches first to last - 1, with a share of the budget (None: no limit)."""

    def __init__(self, first: int, last: int, budget: int | None):
        self.first, self.last, self.budget = first, last, budget


class ServiceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        get = lambda name, default: options.get(name, default)
        self.service, self.asked, self.field = options["service"].rstrip("/"), options["asked"], get("field", "doi")
        self.batches, self.tasks = int(options["batches"]), max(1, int(get("tasks", "8")))
        self.per_page, self.paged = int(get("per_page", str(BATCH))), get("paged", "false").lower() == "true"
        self.retries, self.interval = int(get("retries", "2")), float(get("interval", "0.1"))
        self.budget = int(options["budget"]) if "budget" in options else None
        self.token = options.get("token")

    def partitions(self) -> list[Batches]:
        """Even ranges of batches; the budget is dealt out to them, so that all tasks
        together stay within it."""
        n = max(1, min(self.tasks, self.batches))
        share = lambda whole, i: whole * (i + 1) // n - whole * i // n
        return [Batches(self.batches * i // n, self.batches * (i + 1) // n, None if self.budget is None else share(self.budget, i)) for i in range(n)]

    def answer(self, params: dict[str, str]) -> tuple[int, str]:
        if self.service.startswith(("http://", "https://")):
            time.sleep(self.interval * min(self.tasks, self.batches))  # tasks run side by side
            return live_answer(self.service, "/works", params, self.token)
        return stored_answer(self.service, "/works", params)

    def values(self, part: Batches) -> Iterator[tuple[int, list[str]]]:
        """The batches of a range, one after another; only their row groups are read."""
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.asked)
        table = ds.dataset(base, filesystem=system, format="parquet")
        column = ds.field("batch")
        for at in range(part.first, part.last, 1000):
            rows = table.to_table(columns=["batch", "value"], filter=(column >= at) & (column < min(part.last, at + 1000))).sort_by([("batch", "ascending"), ("value", "ascending")])
            of: dict[int, list[str]] = {}
            for batch, value in zip(rows["batch"].to_pylist(), rows["value"].to_pylist()):
                of.setdefault(batch, []).append(value)
            yield from of.items()

    def read(self, part: Batches) -> Iterator[tuple]:
        left, stopped, until = part.budget, False, None
        for batch, values in self.values(part):
            page, cursor, end, total = 0, "*" if self.paged else None, None, None
            while end is None:
                status, body = 0, ""
                for attempt in range(self.retries + 1):
                    if stopped or left == 0:
                        break
                    left = None if left is None else left - 1
                    status, body = self.answer(request_params(self.field, values, self.per_page, cursor))
                    spent = status == 429 and "budget" in body.lower()
                    if status < 500 and (status != 429 or spent):
                        break
                    if attempt < self.retries:
                        time.sleep(self.interval * 2**attempt)
                if status == 0:  # nothing was asked
                    end = "unasked" if page == 0 else "limited"
                elif status == 429:
                    stopped, end = True, "limited"
                    until = next_midnight() if spent else int(time.time() * 1000) + OVERLOAD
                elif status == 404:
                    end = "absent" if page == 0 else "failed"
                elif status >= 400:
                    end = "failed"
                else:
                    found = json.loads(body)
                    results, meta = found.get("results") or [], found.get("meta") or {}
                    total = meta.get("count", total)
                    for pos, record in enumerate(results):
                        yield batch, page, pos, "record", None, None, json.dumps(record)
                    cursor = meta.get("next_cursor") if self.paged and results else None
                    page, end = page + 1, None if cursor else "done"
            yield batch, page, -1, end, total, until, None


class ServiceSource(DataSource):
    """See the module's docstring. Options besides: field (doi, openalex_id, cites), tasks,
    per_page, paged (follow cursors), retries (of overloads and failures), interval
    (seconds between requests of all tasks), budget (requests in all), token."""

    @classmethod
    def name(cls) -> str:
        return "works_service"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> ServiceReader:
        return ServiceReader(dict(self.options))


def batched(values: DataFrame, size: int = BATCH) -> DataFrame:
    """(value, batch) of the distinct values(value), numbered into batches of `size`."""
    return numbered(values.where("value is not null").select("value").distinct(), "value").select("value", F.floor(F.col("position") / size).alias("batch"))


def answers(spark: SparkSession, asked: DataFrame, service: str, field: str, **options) -> DataFrame:
    """The answers (ROWS) for asked(value, batch), written once: reading them again asks
    nothing again."""
    path = f"{own_dir(spark)}/asked-{uuid.uuid4().hex}"
    asked.sortWithinPartitions("batch").write.parquet(path)
    last = spark.read.schema("value string, batch long").parquet(path).agg(F.max("batch")).first()[0]
    spark.dataSource.register(ServiceSource)
    given = {k: str(v) for k, v in options.items() if v is not None}
    got = spark.read.format("works_service").options(service=service, asked=path, batches=str(0 if last is None else last + 1), field=field, **given).load()
    return cut(got, "answers")


def answered_works(got: DataFrame) -> DataFrame:
    """(batch, page, pos, and a summary) of the records of answers."""
    records = got.where("state = 'record'").select("batch", "page", "pos", F.from_json("record", RAW).alias("raw"))
    works = summarize(records.select("batch", "page", "pos", "raw.*"), "batch", "page", "pos")
    return works.where("id is not null")


def settled(asked: DataFrame, got: DataFrame) -> DataFrame:
    """The rows of asked whose batch was answered to its end."""
    return asked.join(got.where(F.col("state").isin(*SETTLED)).select("batch").distinct(), "batch", "left_semi")


def to_refetch(values: DataFrame, known: DataFrame, works: DataFrame, *, whole: bool = False) -> DataFrame:
    """(value) of values(value) to ask for, by known(value, id) and works(id, partial,
    trimmed): those never asked for, those whose work is stored in part, and with
    `whole` those whose references were cut. What is known to be unknown isn't asked again."""
    state = known.join(works.select("id", "partial", "trimmed"), "id", "left").select("value", "id", F.coalesce("partial", F.lit(False)).alias("partial"), F.coalesce("trimmed", F.lit(False)).alias("trimmed"), F.lit(True).alias("asked"))
    lacking = F.col("partial") | (F.col("trimmed") if whole else F.lit(False))
    return values.where("value is not null").select("value").distinct().join(state, "value", "left").where(F.col("asked").isNull() | (F.col("id").isNotNull() & lacking)).select("value")


def fetch(values: DataFrame, known: DataFrame, works: DataFrame, service: str, field: str = "doi", *, whole: bool = False, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(known, works, ends) after asking for values(value) of `field` (doi or openalex_id)
    what to_refetch says. Works that came replace stored ones, whole; values of batches
    that were answered are known with an id or with null; those of others stay as they
    were, and can be asked for again. ends(batch, state, until) tells how batches ended.

    works has the columns of summaries and partial, trimmed."""
    spark = values.sparkSession
    if field == "doi":
        values = values.select(normalize_doi(F.col("value")).alias("value"))
    asked = cut(batched(to_refetch(values, known, works, whole=whole)), "asked")
    got = answers(spark, asked, service, field, **options)
    came = answered_works(got).dropDuplicates(["id"]).drop("batch", "page", "pos").withColumns({"partial": F.lit(False), "trimmed": F.lit(False)})
    came = cut(came, "works")
    ids = came.where("doi is not null").groupBy(F.col("doi").alias("value")).agg(F.min("id").alias("id")) if field == "doi" else came.select(F.col("id").alias("value"), "id")
    fresh = settled(asked, got).select("value").join(ids, "value", "left").unionByName(ids.join(settled(asked, got).select("value"), "value", "left_anti"))
    return (
        cut(known.join(fresh.select("value"), "value", "left_anti").unionByName(fresh), "known"),
        cut(works.join(came.select("id"), "id", "left_anti").unionByName(came.select(works.columns)), "works"),
        got.where("pos = -1").select("batch", "state", "until"),
    )


def citing_pages(ids: DataFrame, service: str, **options) -> tuple[DataFrame, DataFrame]:
    """Every work that cites each of ids(id), page by page: (id, page, results) of listings
    that came to their end, as external.citing_lists takes them (with `at` added), and (id,
    state) of all. A listing is cut into its pages, never one row."""
    spark = ids.sparkSession
    asked = cut(batched(ids.select(F.col("id").alias("value")), 1), "asked")
    got = answers(spark, asked, service, "cites", paged="true", per_page=PAGE, **options)
    pages = answered_works(got).groupBy("batch", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("results"))
    whole = settled(asked, got).select("batch", F.col("value").alias("id"))
    return pages.join(whole, "batch").select("id", "page", "results"), got.where("pos = -1").join(asked, "batch").select(F.col("value").alias("id"), "state")
