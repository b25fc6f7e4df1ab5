"""Mixing sources to target weights by Sainte-Laguë apportionment.

A source's documents, in a seeded order, make a stream of words; equal-token blocks
are cut from it, and the stream repeats up to `max_repeats` times. Targets come from
weights by water-filling under the cap of max_repeats times a source's size.
Sainte-Laguë then gives blocks to sources by highest quotients target / (2k - 1), and
once more inside each source to its shards, so every shard has an integer quota. A
shard takes its quota as a prefix of its seeded, repeated stream.

The seats are found without listing all blocks: most are certain from the quota rule's
bounds, and only the last few per source compete by quotient. Hot sources are cut
into shards of at most about `shard_docs` documents, so no window spans a source.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import table, written

SEED = "quillgraph-mix-1"
MAX_REPEATS = 3
#: Weights by source, in code point order, repeating.
WEIGHTS = (1, 2, 3)
BLOCK_WORDS = 1024
SHARD_DOCS = 4096
SHARD_WORDS = 1 << 25
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(doc_id: Column, seed: str) -> Column:
    """48 bits that order documents and deal them to shards."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def source_targets(sources: DataFrame, *, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets of (source, source_size): T * w / sum(w), at most max_repeats * size,
    the excess reshared by weight among the others until none is above.

    Sources sorted by cap/weight are capped from the front; the first that is not
    fixes the rate per weight for it and all behind."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    weighted = sources.withColumn("pos", F.row_number().over(order)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("pos") - 1, F.lit(n)) + 1).cast("long"))
    weighted = weighted.withColumn("cap", F.col("source_size") * max_repeats)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "pos")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        weighted.withColumn("total", F.sum("source_size").over(every))
        .withColumn("rate", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
        .withColumn("place", F.row_number().over(by_ratio))
    )
    free = F.col("cap") > F.col("rate") * F.col("weight")
    fixed = filled.withColumn("first_free", F.min(F.when(free, F.struct("place", "rate"))).over(every))
    capped = F.col("first_free").isNull() | (F.col("place") < F.col("first_free.place"))
    return fixed.select("source", "source_size", "pos", "weight", "cap", "total", F.when(capped, F.col("cap").cast("double")).otherwise(F.col("first_free.rate") * F.col("weight")).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], key: str, votes: str, seats: str, most: str) -> DataFrame:
    """Add `won`: the seats that `key` wins of its group's `seats` by highest quotients
    votes / (2k - 1), never above `most`; ties to the smaller key.

    With p a party's share and S parties, it surely has ceil(p*seats - p*S/2 - 2)
    seats; the next 2*p*S + 8 compete, about 10 S rows in all."""
    own = Window.partitionBy(*group) if group else Window.partitionBy()
    p = F.col(votes) / F.sum(votes).over(own)
    s = F.count(F.lit(1)).over(own)
    sized = parties.withColumn("_p", F.coalesce(F.when(F.sum(votes).over(own) > 0, p), F.lit(0.0))).withColumn("_s", s)
    sure = F.greatest(F.lit(0), F.ceil(F.col("_p") * F.col(seats) - F.col("_p") * F.col("_s") / 2 - 2))
    sized = sized.withColumn("_sure", F.least(sure, F.col(most))).withColumn("_left", F.col(seats) - F.sum("_sure").over(own))
    upto = F.least(F.col(most), F.col("_sure") + F.ceil(2 * F.col("_p") * F.col("_s")) + 8)
    rivals = (
        sized.where(F.col("_p") > 0)
        .select(*group, key, votes, "_left", F.explode(F.when(upto > F.col("_sure"), F.sequence(F.col("_sure") + 1, upto))).alias("_seat"))
        .withColumn("_rank", F.row_number().over((Window.partitionBy(*group) if group else Window).orderBy(F.desc(F.col(votes) / (2 * F.col("_seat") - 1)), key)))
        .where(F.col("_rank") <= F.col("_left"))
        .groupBy(*group, key)
        .agg(F.count(F.lit(1)).alias("_extra"))
    )
    return sized.join(rivals, [*group, key], "left").withColumn("won", F.col("_sure") + F.coalesce("_extra", F.lit(0))).drop("_p", "_s", "_sure", "_left", "_extra")


def mix(docs: DataFrame, *, seed: str = SEED, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, size, source_size, target, taken.

    Null or blank texts have size 0 and take 0; repeated rows count as own documents;
    a null source is a source, the last. The block is `block_words`, or smaller where
    the smallest positive target asks for it (a two-hundredth of it)."""
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), seeded(F.col("doc_id"), seed).alias("luck")), "mix-sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    targets = source_targets(sources.select("source", "source_size"), weights=weights, max_repeats=max_repeats)
    every = Window.partitionBy()
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(every) / 200)))
    planned = targets.withColumn("block", F.coalesce(block, F.lit(1)).cast("long"))
    planned = planned.withColumn("seats", F.floor(F.col("total") / F.col("block"))).withColumn("most", F.floor(F.col("cap") / F.col("block")))
    quotas = sainte_lague(planned, [], "pos", "target", "seats", "most").select("source", "source_size", "target", "pos", "block", F.col("won").alias("quota"))
    counts = sources.select("source", F.greatest(F.lit(1), F.ceil(F.col("source_docs") / shard_docs), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("n_shards"))
    quotas = quotas.join(counts.withColumnRenamed("source", "c_source"), F.col("source").eqNullSafe(F.col("c_source"))).drop("c_source")
    dealt = sizes.join(quotas.withColumnRenamed("source", "q_source"), F.col("source").eqNullSafe(F.col("q_source"))).withColumn("shard", F.pmod(F.col("luck"), F.col("n_shards")))
    shards = dealt.groupBy("pos", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"), F.first("block").alias("block")).withColumn("most", F.floor(F.col("shard_size") * max_repeats / F.col("block")))
    won = sainte_lague(shards, ["pos"], "shard", "shard_size", "quota", "most").select("pos", "shard", "shard_size", (F.col("won") * F.col("block")).alias("words"))
    stream = Window.partitionBy("pos", "shard").orderBy("luck", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("size").over(stream), F.lit(0))).join(won, ["pos", "shard"])
    whole = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0)
    part = F.col("words") - whole * F.col("shard_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), part) - F.col("start"))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them: a row for each whole copy, and one with the
    first words where a block's end cuts the text; what isn't taken goes, null and blank
    texts among it.

    `taken` belongs to a row, so rows get their own number while it is worked out. They
    travel as one struct, so their columns may have any names."""
    names = docs.columns
    # the row's own number must not depend on how the rows are read again
    numbered = written(docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"), F.monotonically_increasing_id().alias("row")), "mix-rows")
    keyed = numbered.select(F.to_json(F.struct(F.col("doc.doc_id").alias("d"), F.col("row").alias("r"))).alias("doc_id"), F.col("doc.text").alias("text"), F.col("doc.source").alias("source"))
    taken = mix(keyed, **options).where("taken > 0").select(F.get_json_object("doc_id", "$.r").cast("long").alias("row"), "size", "taken")
    part = F.col("taken") % F.col("size")
    rows = numbered.join(taken, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")))))
    cut = (F.col("copy") > F.floor(F.col("taken") / F.col("size"))) & (part > 0)
    first = F.array_join(F.slice(F.regexp_extract_all("doc.text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), part.cast("int")), "")
    text = F.when(cut, first).otherwise(F.col("doc.text"))
    made = {"text": text}
    if "n_chars" in names:
        made["n_chars"] = F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return rows.select(*(made.get(c, F.col(f"doc.`{c}`")).alias(c) for c in names))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the contract's weights: a row for each row. Null and blank
    texts have size 0 and take 0, repeated rows count as own documents, a null source is
    a source, the last; other columns are ignored; an empty table gives no rows."""
    return mix(table(spark, sf_dir, "documents"))


def _apportion(src: str, group: str, key: str, votes: str, seats: str, most: str, name: str) -> str:
    part = f"PARTITION BY {group}" if group else ""
    by = f"{group}, " if group else ""
    on = f"USING ({by}{key})"
    return f"""
{name}_s AS (
  SELECT *, coalesce({votes} / nullif(sum({votes}) OVER ({part}), 0)::DOUBLE, 0.0) AS _p, count(*) OVER ({part}) AS _s FROM {src}
), {name}_t AS (
  SELECT *, least(greatest(0, ceil(_p * {seats} - _p * _s / 2 - 2)), {most})::BIGINT AS _sure FROM {name}_s
), {name}_u AS (
  SELECT *, {seats} - sum(_sure) OVER ({part}) AS _left, least({most}, _sure + ceil(2 * _p * _s) + 8)::BIGINT AS _upto FROM {name}_t
), {name}_r AS (
  SELECT {by}{key}, _left, row_number() OVER ({part} ORDER BY {votes}::DOUBLE / (2 * _seat - 1) DESC, {key}) AS _rank
  FROM (SELECT *, unnest(range(_sure + 1, _upto + 1)) AS _seat FROM {name}_u WHERE _p > 0)
), {name} AS (
  SELECT u.*, _sure + coalesce(_extra, 0) AS won FROM {name}_u u
  LEFT JOIN (SELECT {by}{key}, count(*) AS _extra FROM {name}_r WHERE _rank <= _left GROUP BY ALL) {on}
)"""


ORACLE = f"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT AS luck
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_docs FROM sizes GROUP BY source
), w AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS pos FROM src
), w2 AS (
  SELECT *, ((pos - 1) % 3 + 1)::BIGINT AS weight, source_size * {MAX_REPEATS} AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM w
), f AS (
  SELECT *, (total - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS rate,
    row_number() OVER (ORDER BY cap::DOUBLE / weight, pos) AS place
  FROM w2 WINDOW b AS (ORDER BY cap::DOUBLE / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), ff AS (
  SELECT min(place) AS place, arg_min(rate, place) AS rate FROM f WHERE cap > rate * weight
), tg AS (
  SELECT f.*, CASE WHEN ff.place IS NULL OR f.place < ff.place THEN cap::DOUBLE ELSE ff.rate * weight END AS target FROM f, ff
), pl AS (
  SELECT *, coalesce(greatest(1, least({BLOCK_WORDS}, floor((min(target) FILTER (target > 0) OVER ()) / 200))), 1)::BIGINT AS block,
    greatest(1, ceil(source_docs / {SHARD_DOCS}.0), ceil(source_size / {SHARD_WORDS}.0))::BIGINT AS n_shards FROM tg
), planned AS (
  SELECT *, total // block AS seats, cap // block AS most FROM pl
), {_apportion('planned', '', 'pos', 'target', 'seats', 'most', 'q')}
, dealt AS (
  SELECT s.*, q.source_size, q.target, q.pos, q.block, q.won AS quota, s.luck % q.n_shards AS shard
  FROM sizes s JOIN q ON s.source IS NOT DISTINCT FROM q.source
), shards AS (
  SELECT pos, shard, sum(size)::BIGINT AS shard_size, any_value(quota) AS quota, any_value(block) AS block,
    (sum(size)::BIGINT * {MAX_REPEATS}) // any_value(block) AS most FROM dealt GROUP BY pos, shard
), {_apportion('shards', 'pos', 'shard', 'shard_size', 'quota', 'most', 'h')}
, placed AS (
  SELECT d.*, h.shard_size, h.won * h.block AS words,
    coalesce(sum(d.size) OVER (PARTITION BY d.pos, d.shard ORDER BY d.luck, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM dealt d JOIN h ON d.pos = h.pos AND d.shard = h.shard
), parts AS (
  SELECT *, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS whole FROM placed
)
SELECT doc_id, size, source_size, target,
  (whole * size + greatest(0, least(start + size, words - whole * shard_size) - start))::BIGINT AS taken
FROM parts
"""
