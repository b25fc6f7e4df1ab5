"""Files that appear at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def publish_lines(rows: DataFrame, order: str, line: str, path: str) -> None:
    """Write `line` of all rows, sorted by `order`, as the one text file `path`.

    Tasks write parts of a range of the order to a folder beside it, which Spark commits or
    leaves empty; the parts are then put together, streamed, and the file takes its name in
    one step, replacing what was there. After any failure the old file is still whole."""
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs_path = jvm.org.apache.hadoop.fs.Path
    target = fs_path(path)
    staged = fs_path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    try:
        rows.orderBy(order).select(line).write.text(str(staged.toString()))
        parts = sorted(str(s.getPath().getName()) for s in fs.listStatus(staged))
        whole = fs_path(staged, "_whole")
        out = fs.create(whole, True)
        try:
            for part in parts:
                if part.startswith("part-"):
                    piece = fs.open(fs_path(staged, part))
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(piece, out, conf, False)
                    finally:
                        piece.close()
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), conf)
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(whole), fs.makeQualified(target), options)
    finally:
        fs.delete(staged, True)
