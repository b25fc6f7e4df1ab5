"""Vector, place, colour and naming queries over embeddings, parts and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import geometry as G
from quillgraph.operators import components as C
from quillgraph.operators import meaning as M
from quillgraph.operators.order import numbered
from quillgraph.plans.base import CITE, query, rounded
from quillgraph.sources import tables as T

DOT = "list_dot_product(a.v, b.v)"
VEC = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
PLACES = "p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings)"


def r6(expr: str, n: int = 6) -> str:
    return f"floor(({expr}) * {10**n} + 0.5) / {10**n}"


def vectors(s, d):
    return T.read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


def places(s, d):
    e = F.col("embedding")
    return T.read(s, d, "embeddings").select(F.col("vec_id").alias("id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), "label")


_KNN = f"{VEC}, s AS (SELECT a.id, b.id AS neighbour, {DOT} AS similarity FROM v a JOIN v b ON a.id <> b.id), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour)::INTEGER AS rank FROM s)"


@query("knn_cosine", f"WITH {_KNN} SELECT id, neighbour, {r6('similarity')} AS similarity, rank FROM k WHERE rank <= 10")
def knn_cosine(s, d):
    return M.knn_cosine(vectors(s, d).select("id", "v"), 10).select("id", "neighbour", rounded(F.col("similarity")).alias("similarity"), "rank")


_PLANE = f"{PLACES}, c AS (SELECT greatest(max(x) - min(x), max(y) - min(y), 1e-9) / greatest(1, ceil(sqrt(count(*) / 5))) / 2 AS scale FROM p), s AS (SELECT a.id, b.id AS neighbour, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM p a JOIN p b ON a.id <> b.id), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour)::INTEGER AS rank FROM s)"


@query("knn_plane", f"WITH {_PLANE} SELECT id, neighbour, {r6('distance')} AS distance, {r6('1 / (1 + distance / scale)')} AS closeness, rank FROM k, c WHERE rank <= 5")
def knn_plane(s, d):
    near = M.knn_plane(places(s, d).select("id", "x", "y"), 5)
    return near.select("id", "neighbour", rounded(F.col("distance")).alias("distance"), rounded(F.col("closeness")).alias("closeness"), "rank")


@query("kin_filter", f"WITH {_PLANE.replace('rank FROM s)', 'rank FROM s)')}, {VEC}, q AS (SELECT k.id, k.neighbour, {DOT} AS similarity FROM k JOIN v a ON a.id = k.id JOIN v b ON b.id = k.neighbour WHERE rank <= 30), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour)::INTEGER AS rank FROM q WHERE similarity >= 0.3::DOUBLE) SELECT id, neighbour, {r6('similarity')} AS similarity, rank FROM t WHERE rank <= 6")
def kin_filter(s, d):
    near = M.knn_plane(places(s, d).select("id", "x", "y"), 30).select("id", "neighbour")
    v = T.read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))  # as stored: half the size to shuffle
    both = near.join(v, "id").join(v.select(F.col("id").alias("neighbour"), F.col("v").alias("w")), "neighbour").withColumn("similarity", G.dot(F.col("v"), F.col("w")))
    return M.top_per(both.where("similarity >= 0.3"), "id", 6, F.desc("similarity"), F.col("neighbour")).select("id", "neighbour", rounded(F.col("similarity")).alias("similarity"), "rank")


@query("place_among", f"WITH {_KNN}, {PLACES}, w AS (SELECT k.id, p.x, p.y, exp(20 * (similarity - max(similarity) OVER (PARTITION BY k.id))) AS w FROM k JOIN p ON p.id = neighbour WHERE rank <= 8) SELECT id, {r6('sum(w * x) / sum(w)', 5)} AS x, {r6('sum(w * y) / sum(w)', 5)} AS y FROM w GROUP BY id")
def place_among(s, d):
    put = M.place_among(M.knn_cosine(vectors(s, d).select("id", "v"), 8), places(s, d))
    return put.select("id", rounded(F.col("x"), 5).alias("x"), rounded(F.col("y"), 5).alias("y"))


@query("blend_neighbors", f"WITH {_KNN}, m AS (SELECT k.id, list_transform(range(1, 65), lambda i: 0.0) AS z, list(v.v) AS vs FROM k JOIN v ON v.id = neighbour WHERE rank <= 5 GROUP BY k.id), e AS (SELECT id, list_transform(range(1, 65), lambda i: list_avg(list_transform(vs, lambda w: w[i]))) AS mean FROM m), u AS (SELECT e.id, list_transform(range(1, 65), lambda i: v.v[i] + mean[i] / sqrt(list_dot_product(mean, mean))) AS b FROM e JOIN v ON v.id = e.id) SELECT id, {r6('b[1] / sqrt(list_dot_product(b, b))', 5)} AS b1, {r6('b[64] / sqrt(list_dot_product(b, b))', 5)} AS b64 FROM u")
def blend_neighbors(s, d):
    v = vectors(s, d).select("id", "v")
    near = M.knn_cosine(v, 5).select("id", F.col("neighbour").alias("n")).join(v.select(F.col("id").alias("n"), "v"), "n").select("id", "v")
    b = M.blend_neighbours(v, near)
    return b.select("id", rounded(F.col("v")[0], 5).alias("b1"), rounded(F.col("v")[63], 5).alias("b64"))


@query("unit_norm", f"WITH {VEC} SELECT id, {r6('3 * v[1] / sqrt(9 * list_dot_product(v, v))', 5)} AS u1, 1.0::DOUBLE AS norm FROM v")
def unit_norm(s, d):
    u = vectors(s, d).select("id", G.unit(F.transform("v", lambda x: x * 3)).alias("u"))
    return u.select("id", rounded(F.col("u")[0], 5).alias("u1"), rounded(G.norm(F.col("u")), 5).alias("norm"))


@query("centroid_by_label", f"WITH {VEC}, e AS (SELECT label, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM v) SELECT label, pos::INTEGER AS pos, {r6('avg(x)', 5)} AS mean FROM e GROUP BY ALL")
def centroid_by_label(s, d):
    e = vectors(s, d).select("label", F.posexplode("v").alias("pos", "x"))
    return e.groupBy("label", "pos").agg(rounded(F.avg("x"), 5).alias("mean"))


@query("center_scale", f"WITH {PLACES}, m AS (SELECT id, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y FROM p) SELECT id, {r6('x / sqrt(avg(x * x + y * y) OVER ())', 5)} AS x, {r6('y / sqrt(avg(x * x + y * y) OVER ())', 5)} AS y FROM m")
def center_scale(s, d):
    return M.centred(places(s, d)).select("id", rounded(F.col("x"), 5).alias("x"), rounded(F.col("y"), 5).alias("y"))


@query("align_procrustes", f"WITH {PLACES} SELECT id, {r6('x', 5)} AS x, {r6('y', 5)} AS y FROM p")
def align_procrustes(s, d):
    own = places(s, d).select("id", "x", "y")
    c, i = 0.8, 0.6
    turned = own.select("id", (c * F.col("x") + i * F.col("y")).alias("x"), (i * F.col("x") - c * F.col("y")).alias("y"))
    return M.align(turned, own).select("id", rounded(F.col("x"), 5).alias("x"), rounded(F.col("y"), 5).alias("y"))


_CENTRES = "c AS (SELECT label AS grp, min_by(x, id) AS cx, min_by(y, id) AS cy FROM p WHERE label < 5 GROUP BY label)"


def centres(s, d):
    return places(s, d).where("label < 5").groupBy(F.col("label").alias("grp")).agg(F.min_by("x", "id").alias("x"), F.min_by("y", "id").alias("y"))


@query("kmeans_step", f"WITH {PLACES}, {_CENTRES}, a AS (SELECT id, x, y, min_by(grp, struct_pack(d := (x - cx) ** 2 + (y - cy) ** 2, g := grp)) AS grp FROM p, c GROUP BY ALL) SELECT c.grp, {r6('coalesce(avg(a.x), any_value(cx))', 5)} AS x, {r6('coalesce(avg(a.y), any_value(cy))', 5)} AS y, count(a.id)::BIGINT AS n FROM c LEFT JOIN a ON a.grp = c.grp GROUP BY c.grp")
def kmeans_step(s, d):
    assigned, moved = M.kmeans_step(places(s, d), centres(s, d))
    n = assigned.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return moved.join(n, "grp", "left").select("grp", rounded(F.col("x"), 5).alias("x"), rounded(F.col("y"), 5).alias("y"), F.coalesce("n", F.lit(0)).alias("n"))


@query("group_targets", f"WITH {PLACES}, {_CENTRES}, k AS (SELECT id, cx, cy, 1 / ((sqrt((x - cx) ** 2 + (y - cy) ** 2) + 1e-9) ** 3) AS w, row_number() OVER (PARTITION BY id ORDER BY (x - cx) ** 2 + (y - cy) ** 2, grp) AS rank FROM p, c) SELECT id, {r6('sum(w * cx) / sum(w)', 5)} AS x, {r6('sum(w * cy) / sum(w)', 5)} AS y FROM k WHERE rank <= 2 GROUP BY id")
def group_targets(s, d):
    c = centres(s, d).select("grp", F.col("x").alias("cx"), F.col("y").alias("cy"))
    far = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2
    two = M.top_per(places(s, d).crossJoin(F.broadcast(c)).withColumn("far", far), "id", 2, "far", "grp").withColumn("w", 1 / (F.sqrt("far") + 1e-9) ** 3)
    return two.groupBy("id").agg(rounded(F.sum(F.col("w") * F.col("cx")) / F.sum("w"), 5).alias("x"), rounded(F.sum(F.col("w") * F.col("cy")) / F.sum("w"), 5).alias("y"))


@query("quantile_radius", f"WITH {PLACES}, m AS (SELECT label, list_sort(list(x)) AS xs, list_sort(list(y)) AS ys FROM p GROUP BY label), q AS (SELECT p.label, list_sort(list(sqrt((x - xs[len(xs) // 2 + 1]) ** 2 + (y - ys[len(ys) // 2 + 1]) ** 2))) AS rs FROM p JOIN m ON m.label = p.label GROUP BY p.label) SELECT q.label, {r6('xs[len(xs) // 2 + 1]')} AS x, {r6('ys[len(ys) // 2 + 1]')} AS y, {r6('rs[floor(0.8::DOUBLE * len(rs))::INT + 1]')} AS radius FROM q JOIN m ON m.label = q.label")
def quantile_radius(s, d):
    p = places(s, d)
    mid = M.quantile_of(p, "label", "x", 0.5).withColumnRenamed("x", "mx").join(M.quantile_of(p, "label", "y", 0.5).withColumnRenamed("y", "my"), "label")
    far = p.join(mid, "label").withColumn("far", F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2))
    return M.quantile_of(far, "label", "far", 0.8).join(mid, "label").select("label", rounded(F.col("mx")).alias("x"), rounded(F.col("my")).alias("y"), rounded(F.col("far")).alias("radius"))


@query("legend_center", f"WITH {PLACES} SELECT label, {r6('avg(x)', 5)} AS x, {r6('avg(y)', 5)} AS y, count(*)::BIGINT AS works FROM p GROUP BY label")
def legend_center(s, d):
    return places(s, d).groupBy("label").agg(rounded(F.avg("x"), 5).alias("x"), rounded(F.avg("y"), 5).alias("y"), F.count(F.lit(1)).alias("works"))


@query("even_hues", f"WITH {PLACES}, a AS (SELECT id, atan2(y, x) AS angle FROM p) SELECT id, {r6('(row_number() OVER (ORDER BY angle, id) - 1 + 0.5::DOUBLE) / count(*) OVER () * 360', 5)} AS hue FROM a")
def even_hues(s, d):
    a = places(s, d).select("id", F.atan2("y", "x").alias("angle"))
    n = a.agg(F.count(F.lit(1)).alias("n"))
    return numbered(a, "angle", "id", name="k").crossJoin(F.broadcast(n)).select("id", rounded((F.col("k") + 0.5) / F.col("n") * 360, 5).alias("hue"))


_HSL = """CASE WHEN h < 1 THEN [c, x, 0] WHEN h < 2 THEN [x, c, 0] WHEN h < 3 THEN [0, c, x] WHEN h < 4 THEN [0, x, c] WHEN h < 5 THEN [x, 0, c] ELSE [c, 0, x] END"""


def hsl_sql(source: str, hue: str, sat: str, light: str) -> str:
    return f"h AS (SELECT *, fmod(fmod({hue}, 360) + 360, 360) / 60 AS h, (1 - abs(2 * ({light})::DOUBLE - 1)) * ({sat}) AS c, ({light})::DOUBLE AS l FROM {source}), hx AS (SELECT *, c * (1 - abs(fmod(h, 2) - 1)) AS x_ FROM h), hc AS (SELECT *, {_HSL.replace('x', 'x_')} AS rgb FROM hx), color AS (SELECT *, list_transform(rgb, lambda k: floor((k + l - c / 2) * 255 + 0.5)::INT) AS q FROM hc)"


@query("hsl_color", f"WITH s AS (SELECT p_partkey, (p_partkey * 37 % 720 - 180)::DOUBLE AS hue, (p_size % 5) / 4::DOUBLE AS sat FROM part), {hsl_sql('s', 'hue', 'sat', '0.5')} SELECT p_partkey, (q[1] * 65536 + q[2] * 256 + q[3])::INTEGER AS color FROM color")
def hsl_color(s, d):
    return T.read(s, d, "part").select("p_partkey", G.hsl_color((F.col("p_partkey") * 37 % 720 - 180).cast("double"), F.col("p_size") % 5 / 4, F.lit(0.5)).alias("color"))


@query("place_color", f"WITH {PLACES}, {hsl_sql('p', 'degrees(atan2(y, x))', '0.35::DOUBLE + 0.5::DOUBLE * least(1.0::DOUBLE, sqrt(x * x + y * y) / 1.5::DOUBLE)', '0.55')} SELECT id, lower(printf('%06x', q[1] * 65536 + q[2] * 256 + q[3])) AS color FROM color")
def place_color(s, d):
    return places(s, d).select("id", G.hex_color(G.color_of_place(F.col("x"), F.col("y"), 0.55)).alias("color"))


@query("mix_color", "WITH k AS (SELECT p_partkey, (p_partkey * 7919 % 16777216)::BIGINT AS a, (p_partkey * 104729 % 16777216)::BIGINT AS b, p_size / 50::DOUBLE AS t FROM part) SELECT p_partkey, (floor((a >> 16 & 255) + ((b >> 16 & 255) - (a >> 16 & 255)) * t + 0.5) * 65536 + floor((a >> 8 & 255) + ((b >> 8 & 255) - (a >> 8 & 255)) * t + 0.5) * 256 + floor((a & 255) + ((b & 255) - (a & 255)) * t + 0.5))::INTEGER AS color FROM k")
def mix_color(s, d):
    a, b = (F.col("p_partkey") * k % 16777216 for k in (7919, 104729))
    return T.read(s, d, "part").select("p_partkey", G.mix_color(a.cast("int"), b.cast("int"), F.col("p_size") / 50).alias("color"))


@query("shared_keyword_blend", "WITH k AS (SELECT p_partkey AS id, p_brand || '/' || p_size AS w, (p_partkey * 7919 % 16777216)::BIGINT AS c FROM part UNION ALL SELECT p_partkey, p_type || '/' || p_size, (p_partkey * 7919 % 16777216)::BIGINT FROM part), m AS (SELECT a.id, b.id AS other, any_value(b.c) AS c, count(*) AS n FROM k a JOIN k b ON a.w = b.w WHERE a.id % 5 = 0 AND b.id % 5 <> 0 GROUP BY ALL) SELECT id, (floor(sum((c >> 16 & 255) * n) / sum(n) + 0.5) * 65536 + floor(sum((c >> 8 & 255) * n) / sum(n) + 0.5) * 256 + floor(sum((c & 255) * n) / sum(n) + 0.5))::INTEGER AS color FROM m GROUP BY id")
def shared_keyword_blend(s, d):
    words = F.explode(F.array(F.concat("p_brand", F.lit("/"), "p_size"), F.concat("p_type", F.lit("/"), "p_size")))
    k = T.read(s, d, "part").select(F.col("p_partkey").alias("id"), words.alias("w"), (F.col("p_partkey") * 7919 % 16777216).cast("int").alias("c"))
    # keywords and colours are summed per keyword first: a keyword's pairs are never rows
    per = k.where("id % 5 <> 0").groupBy("w").agg(*(F.sum(G.channel(F.col("c"), sh)).alias(f"c{sh}") for sh in (16, 8, 0)), F.count(F.lit(1)).alias("n"))
    own = k.where("id % 5 = 0").join(per, "w").groupBy("id").agg(*(F.floor(F.sum(f"c{sh}") / F.sum("n") + 0.5).alias(f"c{sh}") for sh in (16, 8, 0)))
    return own.select("id", G.rgb(F.col("c16"), F.col("c8"), F.col("c0")).alias("color"))


_WORDS = "w AS (SELECT DISTINCT p_partkey AS id, (p_size % 6)::INTEGER AS grp, unnest(list_transform(regexp_extract_all(lower(p_name), '[a-z]{3,}'), lambda t: t)) AS term FROM part), z AS (SELECT (p_size % 6)::INTEGER AS grp, count(*) AS size FROM part GROUP BY 1), c AS (SELECT grp, term, count(*) AS c FROM w GROUP BY ALL), t AS (SELECT term, count(*) AS total FROM w GROUP BY ALL)"


def part_words(s, d):
    return T.read(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 6).alias("grp"), F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]{3,}"), F.lit(0))).alias("term"))


@query("group_name_scores", f"WITH {_WORDS} SELECT c.grp, c.term, {r6('(c / size::DOUBLE) * (c / total::DOUBLE)')} AS score FROM c JOIN z ON z.grp = c.grp JOIN t ON t.term = c.term WHERE c >= 5")
def group_name_scores(s, d):
    return M.group_name_scores(part_words(s, d)).select("grp", "term", rounded(F.col("score")).alias("score"))


@query("class_tfidf", f"WITH {_WORDS} SELECT c.grp, c.term, {r6('(c / size::DOUBLE) * ln(1 + (SELECT avg(size) FROM z) / total)')} AS score FROM c JOIN z ON z.grp = c.grp JOIN t ON t.term = c.term")
def class_tfidf(s, d):
    return M.class_tfidf(part_words(s, d)).select("grp", "term", rounded(F.col("score")).alias("score"))


@query("region_topic", f"WITH k AS (SELECT p_partkey AS id, (p_size % 6)::INTEGER AS grp, split_part(p_type, ' ', 1) AS topic FROM part), r AS (SELECT grp, topic, count(*) / (SELECT count(*) FROM k b WHERE b.grp = k.grp)::DOUBLE AS coverage, (count(*) / (SELECT count(*) FROM k b WHERE b.grp = k.grp)::DOUBLE) / ((SELECT count(*) FROM k b WHERE b.topic = k.topic) / (SELECT count(*) FROM k)::DOUBLE) AS lift FROM k GROUP BY grp, topic) SELECT grp, topic, {r6('coverage * ln(1 + lift)')} AS score FROM r WHERE coverage >= 0.1::DOUBLE AND lift >= 1.0::DOUBLE QUALIFY row_number() OVER (PARTITION BY grp ORDER BY coverage * ln(1 + lift) DESC, topic) = 1")
def region_topic(s, d):
    k = T.read(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 6).alias("grp"), F.split("p_type", " ")[0].alias("topic"))
    return M.region_topics(k, coverage=0.1, lift=1.0).select("grp", "topic", rounded(F.col("score")).alias("score"))


#: Edges one by one, best first: one is of the forest if its ends have other labels still.
_FOREST = f"""WITH RECURSIVE {_KNN}, pairs AS (
  SELECT least(id, neighbour) AS a, greatest(id, neighbour) AS b, max(floor(similarity * 1e9::DOUBLE + 0.5) / 1e9::DOUBLE) AS s FROM k WHERE rank <= 10 GROUP BY 1, 2
), places AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS i FROM v), ordered AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY s DESC, a, b) AS n, a, b, s, p.i AS x, q.i AS y FROM pairs JOIN places p ON p.id = a JOIN places q ON q.id = b
), fold (n, labels, taken) AS (
  SELECT 0::BIGINT, list(i ORDER BY i), false FROM places
  UNION ALL
  SELECT o.n, CASE WHEN labels[x] <> labels[y] THEN list_transform(labels, lambda l: CASE WHEN l = labels[y] THEN labels[x] ELSE l END) ELSE labels END, labels[x] <> labels[y]
  FROM fold JOIN ordered o ON o.n = fold.n + 1
) SELECT a, b, s AS similarity FROM fold JOIN ordered USING (n) WHERE taken"""


@query("spanning_tree_weight", _FOREST)
def spanning_tree_weight(s, d):
    """The maximum spanning forest of each vector's ten nearest."""
    near = M.knn_cosine(vectors(s, d).select("id", "v"), 10)
    return C.spanning_forest(near.select(F.col("id").alias("a"), F.col("neighbour").alias("b"), rounded(F.col("similarity"), 9).alias("similarity")))


@query("spanning_tree_shape", "SELECT n_nationkey AS a, n_nationkey + 1 AS b FROM nation WHERE n_nationkey % 5 <> 4")
def spanning_tree_shape(s, d):
    """Of complete graphs of five nations, whose similarity falls with their distance, the path stays."""
    n = T.read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    edges = n.select(F.col("k").alias("a")).join(n.select(F.col("k").alias("b")), (F.floor(F.col("a") / 5) == F.floor(F.col("b") / 5)) & (F.col("a") < F.col("b")))
    return C.spanning_forest(edges.withColumn("similarity", (1.0 / (F.col("b") - F.col("a"))).cast("double"))).select("a", "b")


@query("lsa_groups")
def lsa_groups(s, d):
    from quillgraph.operators.meaning_model import latent_vectors
    from quillgraph.plans.text import english_counts, english_size

    counts = english_counts(s, d)
    return latent_vectors(M.tfidf(counts, M.vocabulary(counts, english_size(s, d))))


@query("meaning_groups_apart", "SELECT label, count(*)::BIGINT AS n, 1::BIGINT AS groups FROM embeddings WHERE label < 6 GROUP BY label")
def meaning_groups_apart(s, d):
    """Places far apart by label: each label is one group."""
    p = places(s, d).where("label < 6").select("id", "label", (10 * F.cos(F.col("label") * F.pi() / 3 + 0.1) + F.col("x") / 10).alias("x"), (10 * F.sin(F.col("label") * F.pi() / 3 + 0.1) + F.col("y") / 10).alias("y"))
    return p.join(M.kmeans(p.select("id", "x", "y"), 6)[0], "id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("grp").alias("groups"))


@query("meaning_groups")
def meaning_groups(s, d):
    return M.kmeans(places(s, d).select("id", "x", "y"), 6)[0]


@query("communities_apart", "SELECT n_regionkey, count(*)::BIGINT AS works, 1::BIGINT AS communities FROM nation GROUP BY n_regionkey")
def communities_apart(s, d):
    """Nations of a region all linked to each other, regions not: each region is one community."""
    from quillgraph.operators.communities import label_propagation

    n = T.read(s, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), "n_regionkey")
    edges = n.withColumnRenamed("id", "source").join(n.withColumnRenamed("id", "target"), "n_regionkey").where("source < target").select("source", "target")
    return n.join(label_propagation(edges), "id").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("works"), F.countDistinct("community").alias("communities"))


@query("atoms_alone", "WITH c AS (SELECT 'P' || l_partkey AS id, min('S' || l_suppkey) AS nucleus FROM lineitem WHERE l_suppkey % 5 = l_partkey % 5 GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1) SELECT id, nucleus FROM c")
def atoms_alone(s, d):
    from quillgraph.operators.communities import atoms as place_atoms

    e = T.read(s, d, "lineitem").where("l_suppkey % 5 = l_partkey % 5").select(F.concat(F.lit("S"), "l_suppkey").alias("source"), F.concat(F.lit("P"), "l_partkey").alias("target")).distinct()
    return place_atoms(e).where("not shared").select("id", "nucleus")


@query("communities")
def communities(s, d):
    from quillgraph.operators.communities import label_propagation
    from quillgraph.plans.graph import edges

    return label_propagation(edges(s, d).select("source", "target"))


#: Shared works one by one, in order, with the atoms' sizes so far.
_ATOMS = f"""WITH RECURSIVE {CITE}, few AS MATERIALIZED (SELECT target, count(*) AS n, min(source) AS one FROM edges GROUP BY 1), nuclei AS MATERIALIZED (
  SELECT source, row_number() OVER (ORDER BY source) AS i FROM (SELECT DISTINCT source FROM edges)
), shared AS MATERIALIZED (
  SELECT target, row_number() OVER (ORDER BY target) AS k, list(i ORDER BY i) AS c FROM edges JOIN few USING (target) JOIN nuclei USING (source) WHERE n > 1 GROUP BY target
), fold (k, sizes, id, pick) AS (
  SELECT 0::BIGINT, list(coalesce(n, 0)::BIGINT ORDER BY i), NULL::VARCHAR, NULL::BIGINT FROM nuclei LEFT JOIN (SELECT one AS source, count(*) AS n FROM few WHERE n = 1 GROUP BY 1) USING (source)
  UNION ALL
  SELECT k, list_transform(sizes, lambda x, p: x + (p = best)::BIGINT), target, best
  FROM (SELECT s.k, sizes, target, list_min(list_transform(c, lambda i: sizes[i] * 1000000 + i)) % 1000000 AS best FROM fold f JOIN shared s ON s.k = f.k + 1)
) SELECT target AS id, one AS nucleus, false AS shared FROM few WHERE n = 1 UNION ALL SELECT id, source, true FROM fold JOIN nuclei ON i = pick"""


@query("atoms", _ATOMS)
def atoms(s, d):
    from quillgraph.operators.communities import atoms as place_atoms
    from quillgraph.plans.graph import edges

    return place_atoms(edges(s, d).select("source", "target"), T.nodes(s, d))


