"""URL filters: prefix rules, and a listed-URL filter behind a blocked Bloom filter.

The list is canonicalised and hashed into 512-bit blocks of eight 64-bit words; a key
sets one bit in each word of its block. The filter is a table (block, w0..w7) built
with bit_or, so building it is one partial aggregation. Its size is known before it
is used: below `broadcast_bytes` it is broadcast and pages that miss cost no shuffle;
above, the join on block is left to Catalyst. Possible hits go to an exact join on the
canonical URL, which removes the false positives. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import table

#: (host, path, verdict) of the query's contract; the longest that fits wins.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that name a visit, not a page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"
BITS_PER_KEY = 16
WORDS = 8
BLOCK_BYTES = 96  # of a row: the block and eight words, with overhead
BROADCAST_BYTES = 8 * 1024 * 1024


def _rest(url: Column) -> Column:
    """What follows the first ://, or null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    """Up to / ? # or end, A-Z lower-cased; empty where null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the host's end up to ? # or end; empty where null or without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """host + path + lasting parameters: no scheme, leading www., default port,
    fragment, tracking parameters or trailing slash. Null where there is no ://."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(url_path(url), "/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, both null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest ends outermost
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def _masks(key: Column) -> list[Column]:
    bits = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks).cast("long"))


def bloom_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w7) of the listed canonical URLs in column `canonical`."""
    words = listed.select(_block(F.col("canonical"), n_blocks).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("canonical")))))
    return words.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def filter_urls(pages: DataFrame, listed_urls: DataFrame, *, rules=RULES, bits_per_key: int = BITS_PER_KEY, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Judge pages(page_id, url) by the rules, and by the list where no rule fits.

    `listed_urls` has a column url. Rows without a usable URL are allowed; repeated
    rows are judged one by one; an empty list allows all that no rule blocks."""
    listed = listed_urls.select(canonical_url(F.col("url")).alias("canonical")).where(F.col("canonical").isNotNull()).distinct()
    n_blocks = max(1, -(-listed.count() * bits_per_key // (64 * WORDS)))
    bloom = bloom_filter(listed, n_blocks)
    if n_blocks * BLOCK_BYTES <= broadcast_bytes:
        bloom = F.broadcast(bloom)
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path")).select("page_id", "url", "host", "path", rule.alias("rule"), said.alias("said"))
    asked = judged.where(F.col("said").isNull()).withColumn("canonical", canonical_url(F.col("url")))
    probed = asked.withColumn("block", F.when(F.col("canonical").isNotNull(), _block(F.col("canonical"), n_blocks)).otherwise(-1)).join(bloom, "block", "left")
    possible = F.lit(True)
    for i, m in enumerate(_masks(F.col("canonical"))):
        possible = possible & F.coalesce(F.col(f"w{i}").bitwiseAND(m) == m, F.lit(False))
    probed = probed.withColumn("possible", possible)
    hits = probed.where("possible").join(listed.withColumn("listed", F.lit(True)), "canonical", "left")
    out = lambda df, verdict: df.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
    return (
        out(judged.where(F.col("said").isNotNull()), F.col("said"))
        .unionByName(out(probed.where(~F.col("possible")), F.lit("allow")))
        .unionByName(out(hits, F.when(F.col("listed"), "block").otherwise("allow")))
    )


def listed_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's list: URLs of pages whose document (the number that ends their
    path) is labelled toxic."""
    doc = F.expr(r"try_cast(regexp_extract(url, '/([0-9]+)(\\.html|/)?([?#].*)?$', 1) as bigint)")
    toxic = labels.where("toxic = 1").select(F.col("doc_id").alias("listed_doc")).distinct()
    return pages.select("url", doc.alias("listed_doc")).where("listed_doc is not null").join(toxic, "listed_doc", "left_semi").select("url")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged: rules first, the listed-URL filter for the rest."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, listed_pages(pages, table(spark, sf_dir, "labels")))


_REST = "case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end"
ORACLE = rf"""
WITH u AS (
  SELECT page_id, url, {_REST} AS rest FROM pages
), p AS (
  SELECT page_id, url, rest,
    translate(coalesce(regexp_extract(rest, '^[^/?#]*', 0), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query
  FROM u
), c AS (
  SELECT *, list_aggregate(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}')), 'string_agg', '&') AS kept,
    CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p
), k AS (
  SELECT *, CASE WHEN rest IS NOT NULL THEN
    regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN coalesce(kept, '') <> '' THEN '?' || kept ELSE '' END END AS canonical
  FROM c
), listed AS (
  SELECT DISTINCT canonical FROM k
  WHERE canonical IS NOT NULL AND try_cast(regexp_extract(url, '/([0-9]+)(\.html|/)?([?#].*)?$', 1) AS BIGINT) IN (SELECT doc_id FROM labels WHERE toxic = 1)
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
       WHEN rule IS NOT NULL THEN 'allow'
       WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM k
"""
