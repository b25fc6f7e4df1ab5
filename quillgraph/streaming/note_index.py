"""The index of a collection kept up by a stream of changes.

Each note's state is kept by key: what others depend on (as a signature), where its citations
stand, its DOI. An event is compared with that state alone, so a batch costs what its paths
cost: `changed` if the signature differs, `moved` if only lines do, `deleted`, or nothing, for
edits of prose. An event that is older than what a note has seen is ignored: the later wins.

The change feed is a table; a second stream reads it and keeps who owns each DOI: the first
note that had one, and when it goes or changes its DOI, the next that holds it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillgraph.functions import notes as N
from quillgraph.operators.collection import Settings, own_works
from quillgraph.streaming.incremental import EVENT, latest

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NOTE = "path string, basename string, text string, properties map<string,string>, seq long, gone boolean, links array<string>, entries array<string>, lines string"
CHANGE = "path string, seq long, kind string, signature string, doi string, was_doi string, since long"
STATE = "seq long, signature string, lines string, doi string, since long"
OWNER = "doi string, seq long, owner string, was_owner string"


def note_rows(events: DataFrame) -> DataFrame:
    """NOTE rows of events(seq, op, path, new_path, text): a row for each path that an event
    concerns. A rename is the old path's end and the new path's text, which the source of
    changes gives as it reads the note there."""
    old = F.struct("seq", "path", F.lit(True).alias("gone"), F.lit(None).cast("string").alias("text"))
    new = F.struct("seq", F.when(F.col("op") == "renamed", F.col("new_path")).otherwise(F.col("path")).alias("path"), F.lit(False).alias("gone"), F.coalesce("text", F.lit("")).alias("text"))
    each = F.when(F.col("op") == "deleted", F.array(old)).when(F.col("op") == "renamed", F.array(old, new)).otherwise(F.array(new))
    rows = events.select(F.explode(each).alias("e")).select("e.*").where("path is not null")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type
        from pyspark.sql.types import MapType, StringType

        kinds = [pa.string(), pa.string(), pa.string(), to_arrow_type(MapType(StringType(), StringType())), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
        names = ["path", "basename", "text", "properties", "seq", "gone", "links", "entries", "lines"]
        for b in batches:
            out = []
            for seq, path, gone, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = text or ""
                flat = [(k, ", ".join(v) if isinstance(v, list) else v) for k, v in N.frontmatter(text)[0].items()]
                links, entries = N.citation_links(text), N.bibliography(text)
                lines = ",".join(str(x) for x in [*(x["line"] for x in links), "/", *(e.line for e in entries)])
                out.append((path, path.rsplit("/", 1)[-1].removesuffix(".md"), text, flat, seq, gone, [f"{x['text']}\t{x['url']}" for x in links], [e.text for e in entries], lines))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=names)

    return rows.select("seq", "path", "gone", "text").mapInArrow(scan, NOTE)


def signed(notes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(path, seq, gone, signature, lines, doi) of NOTE rows. The signature covers links, DOI,
    ISBNs, what describes the work and, in the literature folder, reference entries."""
    works = own_works(notes, settings, "seq", "gone", "links", "entries", "lines")
    own = works.withColumn("entries", F.when(F.col("literature"), F.col("entries")))
    covered = F.to_json(F.struct("doi", "isbns", "authors", "year", "titles", "label", "literature", "links", "entries"))
    return own.select("path", "seq", "gone", F.sha2(covered, 256).alias("signature"), "lines", "doi")


class NoteChanges(StatefulProcessor):
    """By path: its rows against its state; gives CHANGE rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.note = handle.getValueState("note", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.note.get() if self.note.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            if state is not None and r.seq <= state[0]:
                continue
            known = state is not None and state[1] is not None
            was_doi, since = (state[3], state[4]) if known else (None, None)
            if r.gone:
                if known:
                    out.append((key[0], int(r.seq), "deleted", None, None, was_doi, None))
                state = (int(r.seq), None, None, None, None)  # remembered, so that older events stay without effect
                continue
            doi = r.doi if isinstance(r.doi, str) else None
            since = None if doi is None else int(since) if was_doi is not None else int(r.seq)
            if not known or r.signature != state[1]:
                out.append((key[0], int(r.seq), "changed", r.signature, doi, was_doi, since))
            elif r.lines != state[2]:
                out.append((key[0], int(r.seq), "moved", r.signature, doi, was_doi, since))
            state = (int(r.seq), r.signature, r.lines, doi, since)
        self.note.update(state)
        names = ["path", "seq", "kind", "signature", "doi", "was_doi", "since"]
        yield pd.DataFrame(out, columns=names).astype({"since": "Int64", "seq": "int64"})

    def close(self) -> None:
        pass


class DoiOwners(StatefulProcessor):
    """By DOI: who holds it since when; gives OWNER rows whenever the owner changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.holders = handle.getMapState("holders", "path string", "since long")
        self.owner = handle.getValueState("owner", "path string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        owner = self.owner.get()[0] if self.owner.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values(["seq", "holds"]).itertuples(index=False):
            before = owner
            if r.holds:
                self.holders.updateValue((r.path,), (int(r.since),))
                owner = owner or r.path
            else:
                if self.holders.containsKey((r.path,)):
                    self.holders.removeKey((r.path,))
                if owner == r.path:
                    owner = min(((since[0], path[0]) for path, since in self.holders.iterator()), default=(None, None))[1]
            if out and out[-1][1] == r.seq:  # one event may take a DOI and give it: one row
                before = out.pop()[3]
            if owner != before:
                out.append((key[0], int(r.seq), owner, before))
        if owner is None:
            self.owner.clear()
        else:
            self.owner.update((owner,))
        yield pd.DataFrame(out, columns=["doi", "seq", "owner", "was_owner"])

    def close(self) -> None:
        pass


def changes(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The change feed of a stream of events."""
    return signed(note_rows(events), settings).groupBy("path").transformWithStateInPandas(NoteChanges(), outputStructType=CHANGE, outputMode="Append", timeMode="None")


def owner_changes(feed: DataFrame) -> DataFrame:
    """Hand-overs of DOIs, of a stream of CHANGE rows."""
    keeps = F.col("doi").eqNullSafe(F.col("was_doi"))
    lost = F.when(F.col("was_doi").isNotNull() & ~keeps, F.struct(F.col("was_doi").alias("doi"), "path", "seq", F.lit(False).alias("holds"), F.lit(None).cast("long").alias("since")))
    held = F.when(F.col("doi").isNotNull() & ~keeps, F.struct("doi", "path", "seq", F.lit(True).alias("holds"), "since"))
    rows = feed.select(F.explode(F.array_compact(F.array(lost, held))).alias("e")).select("e.*")
    return rows.groupBy("doi").transformWithStateInPandas(DoiOwners(), outputStructType=OWNER, outputMode="Append", timeMode="None")


class NoteIndex:
    """The change feed, the hand-overs and what they amount to, below a shared folder."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings()):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings

    def run_available(self, source: str, *, files_per_batch: int | None = None) -> None:
        """Take in the event files below `source` that weren't yet, then stop: when this
        returns, feed and owners are as of all of them. State lives in the checkpoints."""
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        reader = self.spark.readStream.schema(EVENT)
        events = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(source)
        self._finish(changes(events, self.settings), "changes")
        self._finish(owner_changes(self.spark.readStream.schema(CHANGE).parquet(f"{self.root}/changes")), "owners")

    def _finish(self, rows: DataFrame, name: str) -> None:
        rows.writeStream.format("parquet").option("path", f"{self.root}/{name}").option("checkpointLocation", f"{self.root}/_state/{name}").trigger(availableNow=True).start().awaitTermination()

    def feed(self) -> DataFrame:
        return self.spark.read.schema(CHANGE).parquet(f"{self.root}/changes")

    def notes(self) -> DataFrame:
        """(path, signature, doi) of the notes there are."""
        return latest(self.feed(), "path", ["seq"]).where("kind <> 'deleted'").select("path", "signature", "doi")

    def owners(self) -> DataFrame:
        """(doi, owner) as of now."""
        log = self.spark.read.schema(OWNER).parquet(f"{self.root}/owners")
        return latest(log, "doi", ["seq"]).where("owner is not null").select("doi", "owner")
