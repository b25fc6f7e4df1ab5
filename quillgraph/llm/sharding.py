"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots; bytes are added up per slot; a
versioned table says which shard holds each slot. Rebalancing edits that table: a slot
moves from its shard to the lightest one where that lowers the heavier of the two. Records
never move by themselves, so what a new version costs is the bytes of the slots it moves.

Rows that are equal in (doc_id, size, checksum) are counted before anything is shuffled and
dealt around the slots from their hash on, so neither a document repeated in a third of the
rows nor a null doc_id makes a slot heavy. A position in a shard is the slot's offset and the
place within the slot; no window spans a shard. DataFrame functions only: the fold over the
slots is a SQL `aggregate` over one row of at most `slots` entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import table, written

SHARDS = 40
SLOTS = 4096
#: Bytes that a record takes besides its text.
OVERHEAD = 16
SEED = "quillgraph-shard-1"
#: Versions made after the first: each goes once over all slots, heaviest first.
ROUNDS = 3


def slot_of(slots: int, seed: str, *parts: Column) -> Column:
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(slots))


def slot_records(docs: DataFrame, *, slots: int = SLOTS, seed: str = SEED) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, size, text_crc32, virtual_slot, copies): equal rows as
    one row a slot, m of them dealt to min(m, slots) slots, the first by their hash."""
    body = F.col("text").cast("binary")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length(body), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("m"))
    first = slot_of(slots, seed, F.col("doc_id"), F.col("text_crc32"), F.col("size"))
    dealt = counted.withColumn("first", first).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("m"), F.lit(slots)) - 1)))
    copies = F.floor(F.col("m") / slots) + F.when(F.col("j") < F.col("m") % slots, 1).otherwise(0)
    return dealt.select("doc_id", "size", "text_crc32", F.pmod(F.col("first") + F.col("j"), F.lit(slots)).alias("virtual_slot"), copies.cast("long").alias("copies"))


def slot_weights(records: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows) of the slots that hold records."""
    return records.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, shard) of version 1: slots dealt in turn."""
    return spark.range(slots).select(F.col("id").alias("virtual_slot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def _moves(slot_map: DataFrame, weights: DataFrame, shards: int, target: Column | None) -> DataFrame:
    """(virtual_slot, to): one pass over the slots that hold records, heaviest first, ties to
    the smaller slot. A slot goes to the lightest shard (the smallest number of several), or
    to `target` while that stays at or below an even share, if its own stays the heavier one.
    The loads of all shards and the moves made are the fold's state."""
    held = slot_map.join(weights, "virtual_slot")
    items = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "shard", "bytes")))
    found = held.agg(items.alias("items"))
    load = lambda s: F.aggregate(F.filter("items", lambda x: x.shard == s), F.lit(0).cast("long"), lambda a, x: a + x.bytes)
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: load(s))
    moved = "array<struct<virtual_slot:bigint,to:int>>"
    start = F.struct(F.col("loads").alias("loads"), F.array().cast(moved).alias("moved"))

    def after(acc: Column, x: Column) -> Column:
        low = F.array_min(acc.loads)
        to = target if target is not None else (F.array_position(acc.loads, low) - 1).cast("int")
        seen = F.array(F.struct(to.alias("to"), F.element_at(acc.loads, to + 1).alias("low"), F.element_at(acc.loads, x.shard + 1).alias("own")))

        def step(s: Column) -> Column:
            better = s.low + x.bytes < s.own
            if target is not None:
                share = F.aggregate(acc.loads, F.lit(0).cast("long"), lambda a, v: a + v) / shards
                better = better & (s.low + x.bytes <= share)
            changed = F.transform(acc.loads, lambda v, i: v + F.when(i == s.to, x.bytes).when(i == x.shard, -x.bytes).otherwise(F.lit(0).cast("long")))
            note = F.array(F.struct(x.virtual_slot.alias("virtual_slot"), s.to.alias("to"))).cast(moved)
            return F.struct(F.when(better, changed).otherwise(acc.loads).alias("loads"), F.when(better, F.concat(acc.moved, note)).otherwise(acc.moved).alias("moved"))

        return F.element_at(F.transform(seen, step), 1)

    folded = found.withColumn("loads", loads).select(F.aggregate("items", start, after).alias("end"))
    return folded.select(F.inline("end.moved"))


def _edited(slot_map: DataFrame, moves: DataFrame, name: str) -> DataFrame:
    return written(slot_map.join(F.broadcast(moves), "virtual_slot", "left").select("virtual_slot", F.coalesce("to", "shard").alias("shard")), name)


def rebalanced(slot_map: DataFrame, weights: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The map's next version, stored: near equal bytes, few slots moved."""
    return _edited(slot_map, _moves(slot_map, weights, shards, None), "slot-map")


def grown(slot_map: DataFrame, weights: DataFrame, shards: int) -> DataFrame:
    """The next version for one shard more than `shards`: slots move only into the new one,
    up to an even share of the bytes."""
    return _edited(slot_map, _moves(slot_map, weights, shards + 1, F.lit(shards)), "slot-map-grown")


def versions(records: DataFrame, *, shards: int = SHARDS, slots: int = SLOTS, rounds: int = ROUNDS) -> list[DataFrame]:
    """The stored maps, version 1 first. At most `slots` rows each."""
    weights = written(slot_weights(records), "slot-weights")
    maps = [written(first_map(records.sparkSession, shards, slots), "slot-map")]
    for _ in range(rounds):
        maps.append(rebalanced(maps[-1], weights, shards))
    return maps


def placed(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """A row for each record: its shard, and its slot there from 0 without gaps. Only the
    map, at most a row for each virtual slot, is broadcast."""
    rows = slot_weights(records).select("virtual_slot", "rows")
    by_shard = Window.partitionBy("shard").orderBy("virtual_slot")
    starts = slot_map.join(rows, "virtual_slot").select("virtual_slot", "shard", (F.sum("rows").over(by_shard) - F.col("rows")).alias("start"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    before = records.withColumn("before", F.sum("copies").over(within) - F.col("copies")).join(F.broadcast(starts), "virtual_slot")
    each = before.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("before") + F.col("copy")).alias("slot"), "virtual_slot")


def shard_documents(docs: DataFrame, *, shards: int = SHARDS, slots: int = SLOTS, seed: str = SEED, rounds: int = ROUNDS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, shard, slot, virtual_slot."""
    records = written(slot_records(docs, slots=slots, seed=seed), "slot-records")
    return placed(records, versions(records, shards=shards, slots=slots, rounds=rounds)[-1])


def op13_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes: a row for each row. A null text has
    no bytes (size 16, checksum 0); null and repeated doc_ids and repeated rows are own
    records, spread over slots; ties within a slot go by doc_id, checksum and size; other
    columns are ignored; an empty table gives no rows."""
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def _round_sql(k: int) -> str:
    was = f"map{k - 1}"
    return f""", items{k} AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS k, virtual_slot, shard, bytes FROM {was} JOIN weights USING (virtual_slot)
), fold{k} (k, loads, virtual_slot, dest) AS (
  SELECT 0::BIGINT, list(coalesce(b, 0) ORDER BY s), NULL::BIGINT, NULL::INT FROM (SELECT range::INT AS s FROM range({SHARDS})) LEFT JOIN (SELECT shard AS s, sum(bytes)::BIGINT AS b FROM items{k} GROUP BY 1) USING (s)
  UNION ALL
  SELECT i.k, CASE WHEN f.low + i.bytes < f.loads[i.shard + 1]
      THEN list_transform(f.loads, lambda v, p: v + CASE WHEN p = f.place THEN i.bytes WHEN p = i.shard + 1 THEN -i.bytes ELSE 0 END) ELSE f.loads END,
    CASE WHEN f.low + i.bytes < f.loads[i.shard + 1] THEN i.virtual_slot END, (f.place - 1)::INT
  FROM (SELECT *, list_min(loads) AS low, list_position(loads, list_min(loads)) AS place FROM fold{k}) f JOIN items{k} i ON i.k = f.k + 1
), map{k} AS MATERIALIZED (
  SELECT m.virtual_slot, coalesce(f.dest, m.shard) AS shard FROM {was} m LEFT JOIN (SELECT virtual_slot, dest FROM fold{k} WHERE virtual_slot IS NOT NULL) f USING (virtual_slot)
)"""


#: The checksum's table follows from its polynomial.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, (a & 1) * 3988292384))) AS tab"


def crc_sql(text: str) -> str:
    octets = f"list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT))"
    return f"xor(4294967295::BIGINT, list_reduce({octets}, lambda a, x: xor(xor(a, x) >> 8, tab[(xor(a, x) & 255) + 1])))"


ORACLE = f"""
WITH RECURSIVE crc AS MATERIALIZED ({CRC_TABLE}), rec AS MATERIALIZED (
  SELECT doc_id, size, text_crc32, count(*) AS m, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || text_crc32 || ':' || size), 1, 8))::BIGINT % {SLOTS} AS first
  FROM (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT + {OVERHEAD} AS size, {crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents, crc) GROUP BY ALL
), each AS MATERIALIZED (
  SELECT doc_id, size, text_crc32, (first + copy) % {SLOTS} AS virtual_slot FROM (SELECT *, unnest(range(m)) AS copy FROM rec)
), weights AS MATERIALIZED (
  SELECT virtual_slot, sum(size)::BIGINT AS bytes, count(*) AS n FROM each GROUP BY 1
), map0 AS MATERIALIZED (
  SELECT range::BIGINT AS virtual_slot, (range % {SHARDS})::INT AS shard FROM range({SLOTS})
){"".join(_round_sql(k) for k in range(1, ROUNDS + 1))}
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, NULL::INT AS grown_shard, virtual_slot
FROM each JOIN map{ROUNDS} USING (virtual_slot)
"""
