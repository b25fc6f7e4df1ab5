"""Queries over maps of works: planes, regions, circles, extents, sizes; label order, runs of lines, keywords of notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.functions import works as W
from quillgraph.operators import maps as P
from quillgraph.operators import naming as N
from quillgraph.operators.order import numbered
from quillgraph.plans.base import joined, query, rounded
from quillgraph.plans.meaning import PLACES, VEC, places, r6, vectors
from quillgraph.sources import tables as T


def at5(*columns: str):
    return [rounded(F.col(c), 5).alias(c) for c in columns]


@query("plane_places")
def plane_places(s, d):
    return P.plane_of(vectors(s, d).select("id", "v"))


# Of two components the directions have a closed form: half the angle of (2 cov, difference of variances).
_AXES = "m AS (SELECT id, x - avg(x) OVER () AS x, 3 * y - avg(3 * y) OVER () AS y FROM p), c AS (SELECT avg(x * x) AS xx, avg(y * y) AS yy, avg(x * y) AS xy FROM m), t AS (SELECT *, 0.5::DOUBLE * atan2(2 * xy, xx - yy) AS t, sqrt(((xx - yy) / 2) ** 2 + xy ** 2) AS r FROM c), a AS (SELECT CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN sign(cos(t)) ELSE sign(sin(t)) END AS f, CASE WHEN abs(sin(t)) >= abs(cos(t)) THEN sign(-sin(t)) ELSE sign(cos(t)) END AS g, * FROM t)"


@query("plane_of_two", f"WITH {PLACES}, {_AXES} SELECT id, {r6('f * (x * cos(t) + y * sin(t)) / sqrt((xx + yy) / 2 + r)', 5)} AS x, {r6('g * (y * cos(t) - x * sin(t)) / sqrt((xx + yy) / 2 - r)', 5)} AS y FROM m, a")
def plane_of_two(s, d):
    v = places(s, d).select("id", F.array(F.col("x"), 3 * F.col("y")).alias("v"))
    return P.plane_of(v).select("id", *at5("x", "y"))


_MEANT = f"""{VEC}, w AS (SELECT id, CASE WHEN label < 8 THEN label END AS grp, v FROM v), e AS (SELECT id, grp, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM w),
whole AS (SELECT pos, avg(x) AS m FROM e GROUP BY pos),
c0 AS (SELECT grp, pos, avg(x) - any_value(m) AS u FROM e JOIN whole USING (pos) WHERE grp IS NOT NULL GROUP BY grp, pos), c AS (SELECT grp, pos, u / sqrt(sum(u * u) OVER (PARTITION BY grp)) AS u FROM c0),
kw AS (SELECT id, 'k' || label || '_' || id % 3 AS keyword FROM v UNION SELECT id, 'm' || id % 11 FROM v UNION SELECT id, 'wide' FROM v),
k AS (SELECT kw.*, grp FROM kw JOIN w USING (id)), uses AS (SELECT keyword, count(*) AS uses FROM k GROUP BY keyword HAVING count(*) >= 3 AND count(*) <= greatest(0.1::DOUBLE, 1.5::DOUBLE / 8) * (SELECT count(*) FROM v)),
k0 AS (SELECT keyword, pos, avg(x) - any_value(m) AS u FROM k JOIN uses USING (keyword) JOIN e USING (id) JOIN whole USING (pos) GROUP BY keyword, pos), kv AS (SELECT keyword, pos, u / sqrt(sum(u * u) OVER (PARTITION BY keyword)) AS u FROM k0),
near AS (SELECT grp, keyword, sum(c.u * kv.u) AS s FROM c JOIN kv USING (pos) GROUP BY grp, keyword), z AS (SELECT grp, count(*) AS size FROM w WHERE grp IS NOT NULL GROUP BY grp),
h AS (SELECT grp, keyword, count(*) AS here FROM k WHERE grp IS NOT NULL GROUP BY grp, keyword HAVING count(*) >= 2),
f AS (SELECT h.grp, h.keyword, here / size::DOUBLE AS coverage, uses / (SELECT count(*) FROM v)::DOUBLE AS everywhere FROM h JOIN z USING (grp) JOIN uses USING (keyword)),
o AS (SELECT f.grp, f.keyword, coverage, near.s AS own, (SELECT max(s) FROM near b WHERE b.keyword = f.keyword AND b.grp <> f.grp) AS other FROM f JOIN near USING (grp, keyword) WHERE coverage >= 0.08::DOUBLE AND coverage / everywhere >= 1.2::DOUBLE)"""


@query("region_keywords", f"WITH {_MEANT} SELECT grp, keyword, {r6('(own + 0.5::DOUBLE * (own - other)) * sqrt(coverage)', 5)} AS score FROM o")
def region_keywords(s, d):
    v = vectors(s, d)
    works = v.select("id", F.when(F.col("label") < 8, F.col("label")).alias("grp"), "v")
    named = F.explode(F.array(F.concat(F.lit(" K"), "label", F.lit("_"), F.col("id") % 3), F.concat(F.lit("m"), F.col("id") % 11), F.lit("Wide"), F.lit("wide ")))
    return P.region_meanings(works, v.select("id", named.alias("keyword"))).select("grp", "keyword", rounded(F.col("score"), 5).alias("score"))


#: Candidates one by one, best first: one is dealt if its region and its name are free.
_DEALT = f"""WITH RECURSIVE {_MEANT}, best AS (SELECT grp, keyword, row_number() OVER (ORDER BY {r6('(own + 0.5::DOUBLE * (own - other)) * sqrt(coverage)', 5)} DESC, keyword, grp) AS i FROM o), fold AS (
  SELECT 0::BIGINT AS i, []::VARCHAR[] AS used, []::VARCHAR[] AS named, NULL::INTEGER AS grp, NULL::VARCHAR AS keyword
  UNION ALL
  SELECT b.i, CASE WHEN f.free THEN list_append(fold.used, b.keyword) ELSE fold.used END, CASE WHEN f.free THEN list_append(fold.named, b.grp::VARCHAR) ELSE fold.named END, CASE WHEN f.free THEN b.grp END, b.keyword
  FROM fold JOIN best b ON b.i = fold.i + 1, LATERAL (SELECT NOT list_contains(fold.used, b.keyword) AND NOT list_contains(fold.named, b.grp::VARCHAR) AS free) f
)
SELECT grp, keyword FROM fold WHERE grp IS NOT NULL"""


@query("dealt_names", _DEALT)
def dealt_names(s, d):
    return N.deal_names(region_keywords(s, d).withColumnRenamed("keyword", "name")).select("grp", F.col("name").alias("keyword"))


@query("region_names")
def region_names(s, d):
    """Vectors and documents of one id are a work: its label the region, its source the
    topic, its words (of the whole text) the terms."""
    v = vectors(s, d)
    works = v.select("id", F.when(F.col("label") < 8, F.col("label")).alias("grp"), "v")
    words = F.explode(F.array(F.concat(F.lit("K"), "label", F.lit("_"), F.col("id") % 3), F.concat(F.lit("m"), F.col("id") % 11)))
    # texts that aren't works name nothing; the others are dealt to all cores before their words are found
    docs = T.spread(T.read(s, d, "documents").select(F.col("doc_id").alias("id"), "source", "text").join(v.select("id"), "id", "left_semi"), "id")
    terms = docs.select("id", F.explode(F.array_distinct(X.tokenize(F.col("text")))).alias("term"))
    named = N.region_names(works, v.where("label % 2 = 0").select("id", words.alias("keyword")), docs.select("id", F.col("source").alias("topic")), terms, topic_coverage=0.05, topic_lift=1.0)
    return named.select("grp", "title", "topic", joined("terms").alias("terms"))


def grouped(s, d):
    return places(s, d).select("id", "x", "y", F.col("label").alias("grp"), (F.col("id") % 3).cast("int").alias("sub"))


_SLOTS = f"""{PLACES}, q AS (SELECT id, x, y, label AS grp, (id % 3)::INTEGER AS sub FROM p), g AS (SELECT grp, row_number() OVER (ORDER BY atan2(avg(y), avg(x)), grp) - 1 AS g FROM q GROUP BY grp),
sb AS (SELECT q.grp, sub, any_value(g) AS g, row_number() OVER (ORDER BY any_value(g), atan2(avg(y), avg(x)), sub) - 1 AS s FROM q JOIN g ON g.grp = q.grp GROUP BY q.grp, sub),
sl AS (SELECT id, q.grp, q.sub, row_number() OVER (ORDER BY s, atan2(y, x), id) - 1 + 6 * g + 2 * (s - g) AS slot FROM q JOIN sb ON sb.grp = q.grp AND sb.sub = q.sub),
n AS (SELECT max(slot) + 1 AS slots, greatest(1, floor(sqrt((max(slot) + 1) / 400.0::DOUBLE) + 0.5)) AS rows_ FROM sl), m AS (SELECT rows_, ceil(slots / rows_) AS cols, greatest(1.0::DOUBLE, ceil(slots / rows_) * 12.0::DOUBLE / (2 * pi())) AS radius FROM n),
a AS (SELECT sl.*, m.*, 2 * pi() * floor(slot / rows_) / cols - pi() / 2 AS a FROM sl, m)"""


@query("radial_slots", f"WITH {_SLOTS} SELECT id, slot::BIGINT AS slot, {r6('(radius + slot % rows_ * 12.0::DOUBLE) * cos(a)', 5)} AS x, {r6('(radius + slot % rows_ * 12.0::DOUBLE) * sin(a)', 5)} AS y FROM a")
def radial_slots(s, d):
    return P.radial_slots(grouped(s, d), spacing=12.0, gap=6)[0].select("id", "slot", *at5("x", "y"))


def _hub(level: int, share: str, keys: str, sub: str) -> str:
    mid = "(min(a) + max(a)) / 2"
    cells = [f"{share}::DOUBLE * any_value(radius) * cos({mid})", f"{share}::DOUBLE * any_value(radius) * sin({mid})", "min(a) - pi() / any_value(cols)", "max(a) + pi() / any_value(cols)"]
    return f"SELECT {level}::INTEGER AS level, grp, {sub} AS sub, " + ", ".join(f"{r6(c, 5)} AS {n}" for c, n in zip(cells, ("x", "y", "first", "last"))) + f" FROM a GROUP BY {keys}"


@query("radial_hubs", f"WITH {_SLOTS} {_hub(1, '0.35', 'grp', '-1::INTEGER')} UNION ALL {_hub(2, '0.7', 'grp, sub', 'sub')}")
def radial_hubs(s, d):
    return P.radial_slots(grouped(s, d), spacing=12.0, gap=6)[1].select("level", "grp", F.coalesce("sub", F.lit(-1)).alias("sub"), *at5("x", "y", "first", "last"))


_SHARE = "n AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi FROM r), q AS (SELECT id, v, (SELECT count(*) - 1 FROM r WHERE r.v <= t.v) AS k, (SELECT max(v) FROM r WHERE r.v <= t.v) AS a, (SELECT min(v) FROM r WHERE r.v > t.v) AS b FROM t)"


@query("share_within", f"WITH {PLACES}, r AS (SELECT sqrt(x * x + y * y) AS v FROM p), t AS (SELECT id, CASE WHEN label < 5 THEN sqrt(x * x + y * y) ELSE 2 * x END AS v FROM p), {_SHARE} SELECT id, {r6('CASE WHEN v <= lo THEN 0.0::DOUBLE WHEN v >= hi THEN 1.0::DOUBLE ELSE (k + (v - a) / (b - a)) / (n - 1) END', 5)} AS share FROM q, n")
def share_within(s, d):
    """Of works with labels below 5 their own distance from the middle, of others twice their x."""
    p = places(s, d).withColumn("v", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    asked = p.select("id", F.when(F.col("label") < 5, F.col("v")).otherwise(2 * F.col("x")).alias("v"))
    return P.share_within(p, "v", asked).select("id", *at5("share"))


@query("fit_camera", f"WITH {PLACES}, n AS (SELECT count(*) AS n, CASE WHEN count(*) >= 200 THEN floor(count(*) * 0.01::DOUBLE)::BIGINT ELSE 0 END AS cut, max(4 + label) + 20.0::DOUBLE AS pad, list_sort(list(100 * x)) AS xs, list_sort(list(100 * y)) AS ys FROM p), b AS (SELECT xs[cut + 1] AS x0, xs[n - cut] AS x1, ys[cut + 1] AS y0, ys[n - cut] AS y1, pad FROM n) SELECT {r6('(x0 + x1) / 2', 5)} AS x, {r6('(y0 + y1) / 2', 5)} AS y, {r6('least(2.0::DOUBLE, 800 * 0.92::DOUBLE / (x1 - x0 + 2 * pad), 600 * 0.92::DOUBLE / (y1 - y0 + 2 * pad))', 5)} AS scale FROM b")
def fit_camera(s, d):
    nodes = places(s, d).select((100 * F.col("x")).alias("x"), (100 * F.col("y")).alias("y"), (4.0 + F.col("label")).alias("radius"))
    return P.fit_camera(nodes, 800, 600).select(*at5("x", "y", "scale"))


@query("island_centres", f"WITH z AS (SELECT p_type AS grp, count(*) AS size FROM part GROUP BY p_type), b AS (SELECT *, row_number() OVER (ORDER BY size DESC, grp) - 1 AS i, coalesce(sum(size) OVER (ORDER BY size DESC, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before FROM z), f AS (SELECT *, CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE sqrt(before) * 37.5::DOUBLE + sqrt(size) * 30 END AS far FROM b) SELECT grp, {r6('far * cos(i * pi() * (3 - sqrt(5)))', 5)} AS x, {r6('far * sin(i * pi() * (3 - sqrt(5)))', 5)} AS y FROM f")
def island_centres(s, d):
    sizes = T.read(s, d, "part").groupBy(F.col("p_type").alias("grp")).agg(F.count(F.lit(1)).alias("size"))
    return P.island_centres(sizes, 30.0).select("grp", *at5("x", "y"))


@query("map_sizes", f"WITH n AS (SELECT p_type AS grp, count(*)::DOUBLE AS a, (count(*) FILTER (p_size > 10))::DOUBLE AS b, (count(*) FILTER (p_size > 40))::DOUBLE AS c FROM part GROUP BY p_type UNION ALL SELECT 'all', count(*), count(*) * 50, count(*) * 500 FROM part) SELECT grp, least(24, greatest(3, floor(sqrt(c) / 6 + 0.5)))::INTEGER AS groups, least(10, greatest(1, floor(sqrt(b) / 3 + 0.5)))::INTEGER AS subgroups, {r6('greatest(1000, 60 * sqrt(c))', 5)} AS width, {r6('greatest(300, a * 18 / (2 * pi()))', 5)} AS circle, {r6('greatest(120, sqrt(a) * 28) + 180 + sqrt(b) * 12', 5)} AS ring1, {r6('greatest(120, sqrt(a) * 28) + 360 + sqrt(b) * 12 + sqrt(c) * 12', 5)} AS ring2 FROM n")
def map_sizes(s, d):
    p = T.read(s, d, "part")
    count = lambda cond: F.count(F.when(cond, 1)).cast("double")
    n = p.groupBy(F.col("p_type").alias("grp")).agg(F.count(F.lit(1)).cast("double").alias("a"), count(F.col("p_size") > 10).alias("b"), count(F.col("p_size") > 40).alias("c"))
    every = p.agg(F.count(F.lit(1)).cast("double").alias("a")).select(F.lit("all").alias("grp"), "a", (F.col("a") * 50).alias("b"), (F.col("a") * 500).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    one, two = P.layer_radii(a, b, c, 30)
    sized = n.union(every).select("grp", P.group_count(c).alias("groups"), P.subgroup_count(b).alias("subgroups"), P.timeline_width(c).alias("width"), P.circle_radius(a).alias("circle"), one.alias("ring1"), two.alias("ring2"))
    return sized.select("grp", "groups", "subgroups", *at5("width", "circle", "ring1", "ring2"))


@query("label_order", "WITH l AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE upper(p_name[1]) || p_name[2:] END AS label FROM part) SELECT id, label, row_number() OVER (ORDER BY lower(label), CASE WHEN label = lower(label) THEN 0 WHEN label = upper(label) THEN 2 ELSE 1 END, id) - 1 AS position FROM l")
def label_order(s, d):
    """Labels in the order of a reader's language: letters first, then accents, then case."""
    name = F.col("p_name")
    label = F.when(F.col("p_partkey") % 3 == 0, F.upper(name)).when(F.col("p_partkey") % 3 == 1, name).otherwise(F.concat(F.upper(name.substr(1, 1)), name.substr(F.lit(2), F.length(name))))
    rows = T.read(s, d, "part").select(F.col("p_partkey").alias("id"), label.alias("label"))
    return numbered(rows, F.collate("label", "UNICODE"), "id")


@query("line_runs", "WITH l AS (SELECT doc_id, generate_subscripts(t, 1) - 1 AS n, unnest(t) AS line FROM (SELECT doc_id, string_split(replace(text, '. ', chr(10)), chr(10)) AS t FROM documents)), f AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS island FROM l WHERE len(line) % 4 <> 0) SELECT doc_id, min(n)::INTEGER AS first, max(n)::INTEGER AS last FROM f GROUP BY doc_id, island")
def line_runs(s, d):
    """Runs of sentences or lines whose length is no multiple of 4."""
    lines = F.split(F.replace("text", F.lit(". "), F.lit("\n")), "\n", -1)
    return T.read(s, d, "documents").select("doc_id", F.explode(X.runs(lines, lambda x: F.length(x) % 4 != 0)).alias("r")).select("doc_id", "r.first", "r.last")


_HEAD = "'---' || chr(10) || 'title: T' || chr(10)"
_REST = "'---' || chr(10) || 'Body $1 of ' || p_name"
_ITEMS = "'  - ' || p_type || chr(10) || '  - \"' || p_brand || '\"' || chr(10)"


@query("keyword_notes", f"SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'kept' WHEN 1 THEN 'none' ELSE 'written' END AS status, CASE p_partkey % 5 WHEN 0 THEN {_HEAD} || 'keywords:' || chr(10) || '  - own' || chr(10) || {_REST} WHEN 1 THEN {_HEAD} || {_REST} WHEN 2 THEN {_HEAD} || 'Keywords:' || chr(10) || {_ITEMS} || 'year: 2001' || chr(10) || {_REST} WHEN 3 THEN {_HEAD} || 'keywords:' || chr(10) || {_ITEMS} || {_REST} ELSE '---' || chr(10) || 'keywords:' || chr(10) || {_ITEMS} || '---' || chr(10) || 'Body of ' || p_name END AS text FROM part")
def keyword_notes(s, d):
    """Keywords written into notes that have none: kept, unknown, empty, missing, and a note without properties."""
    k, rest = F.col("p_partkey") % 5, F.concat(F.lit("---\nBody $1 of "), "p_name")
    head = F.when(k == 0, "keywords:\n  - own\n").when(k == 2, "Keywords: []\nyear: 2001\n").otherwise("")
    text = F.when(k == 4, F.concat(F.lit("Body of "), "p_name")).otherwise(F.concat(F.lit("---\ntitle: T\n"), head, rest))
    names = F.when(k != 1, F.array("p_type", "p_brand"))
    new, status = W.with_keywords(text, "keywords", names)
    return T.read(s, d, "part").select(F.col("p_partkey").alias("id"), status.alias("status"), new.alias("text"))
