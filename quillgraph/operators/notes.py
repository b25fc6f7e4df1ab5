"""The note scanners over DataFrames, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import notes as N

LINK_SCHEMA = "path string, line int, start int, end int, text string, url string"
CITATION_SCHEMA = "path string, line int, start int, end int, text string, url string, note string, q string, qe string, occ int, doi string, link_ord int"
ENTRY_SCHEMA = "path string, line int, text string, first_author string, year string, doi string, authors array<string>, et_al boolean, entry_ord int"


def _per_note(notes: DataFrame, schema: str, of: Callable[[str], list[dict]]) -> DataFrame:
    """`of` of each note's text as rows; notes without text give none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = notes.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"path": p, **r} for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for r in of(t)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return notes.select("path", "text").mapInArrow(run, kind)


def markdown_links(notes: DataFrame) -> DataFrame:
    return _per_note(notes, LINK_SCHEMA, lambda t: [{"line": i, "start": x.start, "end": x.end, "text": x.text, "url": x.url} for i, line in enumerate(t.split("\n")) for x in N.markdown_links(line)])


def citation_links(notes: DataFrame) -> DataFrame:
    """Only notes with a citation URL reach Python."""
    return _per_note(notes.where(F.contains("text", F.lit(N.CITE_PREFIX))), CITATION_SCHEMA, lambda t: [{**x, "link_ord": i} for i, x in enumerate(N.citation_links(t))])


def bibliographies(notes: DataFrame) -> DataFrame:
    return _per_note(notes, ENTRY_SCHEMA, lambda t: [{**asdict(e), "entry_ord": i} for i, e in enumerate(N.bibliography(t))])


def parsed_entries(lines: DataFrame) -> DataFrame:
    """(path, entry fields) of (path, text), each text one reference line."""
    return _per_note(lines, ENTRY_SCHEMA, lambda t: [{**asdict(e), "entry_ord": 0} for e in [N.parse_entry(t)] if e])


def fingerprints(texts: DataFrame) -> DataFrame:
    return _per_note(texts, "path string, fingerprint string", lambda t: [{"fingerprint": N.fingerprint(t)}])
