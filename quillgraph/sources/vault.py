"""Markdown collections as tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.notes import frontmatter

NOTE_SCHEMA = "path string, basename string, text string, body string, properties map<string,string>, tags array<string>, mtime timestamp, size long"


def _prefix(root: str) -> str:
    """The root as it stands in file URLs, which may differ in their scheme's slashes."""
    return "/" + root.split(":", 1)[-1].strip("/") + "/" if root.strip("/") else "/"


def read_vault(spark: SparkSession, root: str) -> DataFrame:
    """Every Markdown note below a folder, by its path from there; files that can't be
    read are skipped.

    List properties become comma-separated text; the tags property gives #tags."""
    above = _prefix(root)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type
        from pyspark.sql.types import MapType, StringType

        for b in batches:
            rows = []
            for path, mtime, size, content in zip(*(b.column(c).to_pylist() for c in ("path", "modificationTime", "length", "content"))):
                text = content.decode("utf-8", "replace")
                fm, body = frontmatter(text)
                tags = fm.get("tags") or []
                tags = [f"#{str(t).lstrip('#')}" for t in (tags if isinstance(tags, list) else str(tags).split(",")) if str(t).strip()]
                flat = [(k, ", ".join(v) if isinstance(v, list) else v) for k, v in fm.items()]
                own = path.split(above, 1)[-1] if above in path else path
                rows.append((own, path.rsplit("/", 1)[-1].removesuffix(".md"), text, body, flat, tags, mtime, size))
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), to_arrow_type(MapType(StringType(), StringType())), pa.list_(pa.string()), b.column("modificationTime").type, pa.int64()]
            names = ["path", "basename", "text", "body", "properties", "tags", "mtime", "size"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=names)

    return files.mapInArrow(parse, NOTE_SCHEMA)


def is_literature(path: Column, folder: str) -> Column:
    """Below the literature folder, for paths relative to the collection's root; an
    empty folder means all."""
    folder = folder.rstrip("/")
    return F.lit(True) if not folder else path.startswith(f"{folder}/")
