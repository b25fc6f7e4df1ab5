"""A Merkle manifest of a dataset: one tree for each language, and one over their roots.

Building is an event-driven combineByKey. A digest that arrives is put into its parent's
partial entry at its index; the parent's arity follows from the tree's size, so an entry
knows by itself when it is complete. It then becomes a digest that arrives one level up, and
so on, all inside the task that saw the last child. Entries still open when a task ends are
the unresolved frontier: only these go through a shuffle, keyed by an ancestor, until none is
left. Rows come in range-partitioned order, so the frontier has a few rows for each task and
level, whatever the number of documents.

A completed parent keeps its children's digests: the reverse links. Proofs go down along
them in blocks of four levels (at most 4,096 leaves and 585 parents), each block led by the
path of its top, so a proof's long part crosses a shuffle once a block, not once a leaf.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import small_batches, table, written
from quillgraph.llm.sharding import CRC_TABLE, crc_sql

ARITY = 8
#: Levels that a round of the frontier, and a block of links, span.
ROUND_LEVELS, BLOCK_LEVELS = 5, 4
#: A frontier of so few rows goes to one group a tree at once.
SMALL_FRONTIER = 32_768
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EVENT = "tree long, size long, level int, idx long, digest string"
STEP = f"kind string, {EVENT}, kids array<string>"


class Manifest(NamedTuple):
    """leaves: (tree, size, idx, digest, row); nodes: completed parents of the language trees;
    top: those of the tree over them; subroots: (tree, level, digest, lang); root: hex, null for no rows."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    top: DataFrame
    root: str | None


def framed(*columns: Column) -> Column:
    """Fields as one text: `-` for null, else the UTF-8 byte count, `:`, the value."""
    return F.concat(*(F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns))


def ascii_lower(text: Column) -> Column:
    """A-Z alone lower-cased; the fast way where every character is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, changed): the row's digest, and that of its tampered form. A null
    doc_id has no decimal form and is never tampered with."""
    head = framed(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"))
    leaf = F.sha2(F.concat(head, framed(F.col("text"))), 256)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False)) & F.col("text").isNotNull()
    changed = F.when(hit, F.sha2(F.concat(head, framed(ascii_lower(F.col("text")))), 256)).otherwise(leaf)
    return docs.select("doc_id", "lang", leaf.alias("leaf"), changed.alias("changed"))


def placed(rows: DataFrame, group: str, *order: str, name: str) -> DataFrame:
    """The rows as (row struct, idx, size): place in their group from 0, and the group's size.

    One range partition over group and order; a stored row number splits runs of equal
    rows. Then only (part, group) counts are summed, by group, over parts."""
    numbered = written(rows.withColumn("_row", F.monotonically_increasing_id()), f"{name}-rows")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = numbered.orderBy(F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), "_row").drop("_row")
    dealt = written(dealt.select(F.struct("*").alias("row"), F.spark_partition_id().alias("part"), at.alias("at")), f"{name}-sorted")
    runs = dealt.groupBy("part", F.col(f"row.{group}").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    by = Window.partitionBy("g")
    runs = runs.select("part", "g", (F.sum("n").over(by.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(by).alias("size"))
    runs = runs.withColumnRenamed("part", "run_part")
    return dealt.join(runs, (F.col("part") == F.col("run_part")) & F.col(f"row.{group}").eqNullSafe(F.col("g"))).select("row", (F.col("at") + F.col("shift")).alias("idx"), "size")


def width_at(size: int, level: int) -> int:
    """Nodes at a level of a tree with so many leaves."""
    for _ in range(level):
        size = -(-size // ARITY)
    return size


def combined(events: Iterator[tuple]) -> Iterator[tuple]:
    """Events (tree, size, level, idx, digest) to rows of STEP: `node` for a completed parent
    with its children, `root` for a tree's last digest, `open` for what waits at the end."""
    partial: dict[tuple, dict[int, str]] = {}
    sizes: dict[int, int] = {}
    for tree, size, level, idx, digest in events:
        sizes[tree] = size
        while (width := width_at(size, level)) > 1:
            parent = idx // ARITY
            key = (tree, level + 1, parent)
            kids = partial.setdefault(key, {})
            kids[idx - ARITY * parent] = digest
            if len(kids) < min(ARITY, width - ARITY * parent):
                break
            held = partial.pop(key)
            children = [held[i] for i in range(len(held))]
            digest, level, idx = sha256("".join(children).encode()).hexdigest(), level + 1, parent
            yield "node", tree, size, level, idx, digest, children
        else:
            yield "root", tree, size, level, idx, digest, None
    for (tree, level, parent), kids in partial.items():
        for i, digest in kids.items():
            yield "open", tree, sizes[tree], level - 1, ARITY * parent + i, digest, None


STEP_ARROW = pa.schema([("kind", pa.string()), ("tree", pa.int64()), ("size", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("kids", pa.list_(pa.string()))])


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def combine_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(combined(_tuples(batches)), STEP_ARROW)


def forest(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """leaves(tree, size, idx, digest) -> (nodes, roots) of all trees. After round k nothing
    below level k * ROUND_LEVELS is open, so rounds end with the highest tree."""
    out = written(leaves.select("tree", "size", F.lit(0).alias("level"), "idx", "digest").mapInArrow(combine_batches, STEP), "merkle-round")
    done, cut = [out], 0
    while frontier := (waiting := out.where("kind = 'open'").drop("kind", "kids")).count():
        cut = 64 if frontier <= SMALL_FRONTIER else cut + ROUND_LEVELS
        top = F.greatest(F.lit(cut), F.col("level") + 1)
        keyed = waiting.withColumn("top", top).withColumn("ancestor", F.expr("CASE WHEN 3 * (top - level) > 62 THEN 0L ELSE shiftright(idx, 3 * (top - level)) END"))
        out = written(keyed.repartition("tree", "top", "ancestor").drop("top", "ancestor").mapInArrow(combine_batches, STEP), "merkle-round")
        done.append(out)
    every = done[0]
    for t in done[1:]:
        every = every.unionByName(t)
    return every.where("kind = 'node'").drop("kind"), every.where("kind = 'root'").select("tree", "size", "level", "digest")


def build_manifest(docs: DataFrame) -> Manifest:
    """The manifest of docs(doc_id, source, lang, n_chars, text). Leaves of a language go by
    doc_id, null first, ties by digest; languages by UTF-8 bytes, null first."""
    rows = placed(leaf_rows(docs), "lang", "doc_id", "leaf", name="merkle-leaves")
    sizes = rows.where("idx = 0").select(F.col("row.lang").alias("lang"), "size")
    trees = placed(sizes.withColumn("all", F.lit(0)), "all", "lang", name="merkle-trees").select(F.col("row.lang").alias("t_lang"), F.col("idx").alias("tree"), F.col("size").alias("trees"))
    trees = written(trees, "merkle-trees")
    leaves = rows.join(trees, F.col("row.lang").eqNullSafe(F.col("t_lang"))).select("tree", "size", "idx", F.col("row.leaf").alias("digest"), "row")
    nodes, roots = forest(leaves)
    subroots = roots.join(trees, "tree").select("tree", "level", "digest", F.col("t_lang").alias("lang"), "trees")
    top, crown = forest(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("trees").alias("size"), F.col("tree").alias("idx"), "digest"))
    root = crown.first()
    return Manifest(leaves, nodes, subroots, top, root.digest if root else None)


def _walked(rows: Iterator[tuple], finish: Callable | None) -> Iterator[tuple]:
    """Rows (tree, block, level, kind, idx, kids, path, subroot, payload) of sorted blocks: a
    path (kind 0), then parents from the top (1), then what paths are asked for (2). A path's
    steps, from the bottom, are `slot` and the siblings' digests."""
    here, paths, subroot = None, {}, None
    for tree, block, level, kind, idx, kids, path, sub, payload in rows:
        if (tree, block) != here:
            here, paths, subroot = (tree, block), {}, None
        if kind == 0:
            paths[level, idx], subroot = path, sub
        elif kind == 1:
            above = paths.pop((level, idx))
            for i in range(len(kids)):
                paths[level - 1, ARITY * idx + i] = [str(i) + "".join(kids[:i]) + "".join(kids[i + 1 :]), *above]
        else:
            own = paths.pop((level, idx))
            yield (tree, level, idx, own, subroot) if finish is None else finish(payload, own, subroot)


PATH = "tree long, level int, idx long, path array<string>, subroot string"
PATH_ARROW = pa.schema([("tree", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("path", pa.list_(pa.string())), ("subroot", pa.string())])


def with_paths(leaves: DataFrame, nodes: DataFrame, tops: DataFrame, finish: Callable | None = None, schema: str = PATH, arrow: pa.Schema = PATH_ARROW) -> DataFrame:
    """Each leaf with its path to the root. leaves(tree, idx, payload), tops(tree, level,
    path, subroot) of the trees' own roots. `finish(payload, path, subroot)` makes a row of
    `schema` in place of the path itself."""
    highest = nodes.agg(F.max("level")).first()[0] or 0
    cuts = range(BLOCK_LEVELS * max(0, -(-highest // BLOCK_LEVELS) - 1), -1, -BLOCK_LEVELS)
    payload = leaves.schema["payload"].dataType
    known, ordered = None, ["tree", "block", "level", "kind", "idx", "kids", "path", "subroot", "payload"]
    empty = {"kids": F.lit(None).cast("array<string>"), "path": F.lit(None).cast("array<string>"), "subroot": F.lit(None).cast("string"), "payload": F.lit(None).cast(payload)}

    def part(rows: DataFrame, kind: int, level: int) -> DataFrame:
        block = F.expr(f"shiftright(idx, 3 * ({level + BLOCK_LEVELS} - level))")
        return rows.withColumns({"kind": F.lit(kind), "block": block} | {k: v for k, v in empty.items() if k not in rows.columns}).select(*ordered)

    for c in cuts:
        within = (F.col("level") > c) & (F.col("level") <= c + BLOCK_LEVELS)
        heads = tops.where(within | ((F.col("level") == 0) & F.lit(c == 0))).withColumn("idx", F.lit(0).cast("long"))
        own = nodes.where(within).select("tree", "level", "idx", "kids")
        asked = leaves.select("tree", F.lit(0).alias("level"), "idx", "payload") if c == 0 else nodes.where(F.col("level") == c).select("tree", "level", "idx").join(tops.where(F.col("level") == c).select("tree", F.lit(1).alias("is_top")), "tree", "left").where("is_top IS NULL").drop("is_top")
        rows = part(heads, 0, c).unionByName(part(own, 1, c)).unionByName(part(asked, 2, c))
        if known is not None:
            rows = rows.unionByName(part(known, 0, c))
        dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", F.desc("level"), "kind", "idx")
        last = c == 0

        def walk(batches: Iterator[pa.RecordBatch], finish=finish if last else None, arrow=arrow if last else PATH_ARROW) -> Iterator[pa.RecordBatch]:
            yield from _batches(_walked(_tuples(batches), finish), arrow)

        out = dealt.mapInArrow(walk, schema if last else PATH)
        known = out if last else written(out, "merkle-paths")
    return known


def folded(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its path give."""
    for step in path:
        at = 1 + 64 * int(step[0])
        leaf = sha256((step[1:at] + leaf + step[at:]).encode()).hexdigest()
    return leaf


def tree_tops(made: Manifest) -> DataFrame:
    """(tree, level, path, subroot) of the language trees, along the tree over them."""
    crown = made.leaves.sparkSession.createDataFrame([(0, made.root)], "tree long, subroot string")
    height = made.top.agg(F.coalesce(F.max("level"), F.lit(0)).cast("int").alias("level"))
    heads = crown.crossJoin(height).select("tree", "level", F.array().cast("array<string>").alias("path"), "subroot")  # one row by one row
    paths = with_paths(made.subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.struct("tree").alias("payload")), made.top, heads)
    paths = paths.select(F.col("idx").alias("tree"), "path")
    return made.subroots.select("tree", "level", F.col("digest").alias("subroot")).join(paths, "tree")


def proofs(made: Manifest) -> DataFrame:
    """(tree, level, idx, path, subroot): each leaf's proof. A step of a path is the leaf's
    (or ancestor's) place among its siblings and their digests, from the bottom to the root."""
    return with_paths(made.leaves.select("tree", "idx", F.struct("idx").alias("payload")), made.nodes, tree_tops(made))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as leaves, with proofs and the check of tampered rows: a row for each
    row. Null fields are hashed as `-`, empty texts as `0:`; a null doc_id comes first and is
    never tampered with; repeated rows are own leaves, ties go by digest; a null lang is a
    language, the first; other columns are ignored; an empty table gives no rows."""
    small_batches(spark, 4096)
    docs = table(spark, sf_dir, "documents")
    made = build_manifest(docs)
    root = made.root
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digests(row: dict, path: list[str], subroot: str) -> tuple:
        ends = folded(row["changed"], path)
        return row["doc_id"], row["leaf"], subroot, root, sha256("".join(p[1:] for p in path).encode()).hexdigest(), ends, ends == root

    columns = [("leaf", "string"), ("subroot", "string"), ("root", "string"), ("proof_sha256", "string"), ("folded_root", "string"), ("verified", "boolean")]
    arrow = pa.schema([("doc_id", pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string())] + [(n, pa.bool_() if k == "boolean" else pa.string()) for n, k in columns])
    leaves = made.leaves.select("tree", "idx", F.col("row").alias("payload"))
    return with_paths(leaves, made.nodes, tree_tops(made), digests, ", ".join([f"doc_id {kind}", *(f"{n} {k}" for n, k in columns)]), arrow)


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWERED = f"translate(text, '{UPPER}', '{LOWER}')"

ORACLE = f"""
WITH RECURSIVE crc AS MATERIALIZED ({CRC_TABLE}), raw AS (
  SELECT doc_id, lang, sha256({_HEAD} || {_FIELD.format("text")}) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND text IS NOT NULL AND {crc_sql("doc_id::VARCHAR")} % 3 = 0 THEN sha256({_HEAD} || {_FIELD.format(_LOWERED)}) END AS other
  FROM documents, crc
), leaf AS MATERIALIZED (
  SELECT row_number() OVER () AS r, *, coalesce(other, leaf) AS changed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM raw
), node (tree, level, idx, digest) AS (
  SELECT lang, 0, pos, leaf FROM leaf
  UNION ALL
  SELECT tree, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS w FROM node) WHERE w > 1 GROUP BY tree, level, idx // 8
), nodes AS MATERIALIZED (SELECT * FROM node), sub AS MATERIALIZED (
  SELECT tree AS lang, level AS height, digest AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place
  FROM (SELECT *, max(level) OVER (PARTITION BY tree) AS h FROM nodes) WHERE level = h
), crown (level, idx, digest) AS (
  SELECT 0, place, subroot FROM sub
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS w FROM crown) WHERE w > 1 GROUP BY level, idx // 8
), tops AS MATERIALIZED (SELECT * FROM crown), root AS (SELECT digest AS root FROM tops ORDER BY level DESC LIMIT 1), sibling AS (
  SELECT r, level AS step, idx, digest FROM leaf JOIN nodes n ON n.tree IS NOT DISTINCT FROM leaf.lang
  WHERE idx // 8 = (pos // (8 ** level)::BIGINT) // 8 AND idx <> pos // (8 ** level)::BIGINT
  UNION ALL
  SELECT r, 1000 + level, idx, digest FROM leaf JOIN sub ON sub.lang IS NOT DISTINCT FROM leaf.lang, tops
  WHERE idx // 8 = (place // (8 ** level)::BIGINT) // 8 AND idx <> place // (8 ** level)::BIGINT
), proof AS (SELECT r, sha256(string_agg(digest, '' ORDER BY step, idx)) AS proof_sha256 FROM sibling GROUP BY r), fold (r, lang, level, own, cur) AS (
  SELECT r, lang, 0, pos, changed FROM leaf
  UNION ALL
  SELECT f.r, f.lang, f.level + 1, f.own // 8, sha256(string_agg(CASE WHEN n.idx = f.own THEN f.cur ELSE n.digest END, '' ORDER BY n.idx))
  FROM fold f JOIN sub ON sub.lang IS NOT DISTINCT FROM f.lang JOIN nodes n ON n.tree IS NOT DISTINCT FROM f.lang AND n.level = f.level AND n.idx // 8 = f.own // 8
  WHERE f.level < sub.height GROUP BY f.r, f.lang, f.level, f.own, f.cur
), up (r, level, own, cur) AS (
  SELECT r, 0, place, cur FROM fold JOIN sub ON sub.lang IS NOT DISTINCT FROM fold.lang WHERE level = height
  UNION ALL
  SELECT u.r, u.level + 1, u.own // 8, sha256(string_agg(CASE WHEN t.idx = u.own THEN u.cur ELSE t.digest END, '' ORDER BY t.idx))
  FROM up u JOIN tops t ON t.level = u.level AND t.idx // 8 = u.own // 8 WHERE u.level < (SELECT max(level) FROM tops) GROUP BY u.r, u.level, u.own, u.cur
)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM leaf JOIN sub ON sub.lang IS NOT DISTINCT FROM leaf.lang JOIN up USING (r) LEFT JOIN proof USING (r), root
WHERE up.level = (SELECT max(level) FROM tops)
"""
