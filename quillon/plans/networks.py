"""Graphs once more: labels stated in SQL, routes, the choice of communities, layouts, fitted models by what must hold of them."""

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import lattice as L
from ..operators import quality
from ..session import load
from .graphs import _DIST, _map_edges, nodes
from .joins import _EDGES, codebook
from .registry import ORACLE, query


def _propagated(rounds, edges="w_edges"):
    """SQL of synchronous label propagation, a table for each round."""
    out = f", two_way AS (SELECT a, b, w FROM {edges} UNION ALL SELECT b, a, w FROM {edges}), l0 AS (SELECT DISTINCT a AS v, a AS label FROM two_way)"
    for i in range(rounds):
        out += f""", h{i} AS (SELECT v, label, round(sum(w), 9) AS w FROM (SELECT t.a AS v, l.label, t.w FROM two_way t JOIN l{i} l ON t.b = l.v UNION ALL SELECT v, label, 1e-6 FROM l{i}) GROUP BY v, label),
l{i + 1} AS (SELECT v, min_by(label, (-w, label)) AS label FROM h{i} GROUP BY v)"""
    return out


_W = _EDGES + _DIST + ", w_edges AS (SELECT bundle_id, a, b, 1 / (1 + distance) AS w FROM d)"
ORACLE["propagated_labels"] = _W + _propagated(8) + " SELECT v, label FROM l8"


@query(_W + " SELECT bundle_id, count(DISTINCT v) AS n_nodes, true AS whole, true AS canonical, true AS better FROM (SELECT bundle_id, a AS v FROM w_edges UNION ALL SELECT bundle_id, b FROM w_edges) GROUP BY bundle_id")
def modularity_holds(spark, d):
    """Communities by modularity: each node once, numbered by first occurrence, and no worse than those of propagation."""
    edges = _map_edges(spark, d)
    found = G.modularity_communities(edges, "bundle_id")
    q = G.modularity(edges, found, "bundle_id")
    ends = edges.select("bundle_id", F.inline(F.array(F.struct(F.col("a").alias("v")), F.struct(F.col("b").alias("v"))))).distinct()
    heard = ends.join(G.label_propagation(edges), "v").select("bundle_id", "v", F.col("label").alias("community"))
    other = G.modularity(edges, heard, "bundle_id").withColumnRenamed("q", "other")
    first = found.groupBy("bundle_id", "community").agg(F.min("v").alias("first"))
    ordered = first.groupBy("bundle_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "community"))), lambda x: x["community"]).alias("c"))
    canonical = ordered.select("bundle_id", F.forall(F.transform("c", lambda x, i: x == i), lambda x: x).alias("canonical"))
    one = found.groupBy("bundle_id").agg(F.countDistinct("v").alias("n_nodes"), (F.countDistinct("v") == F.count(F.lit(1))).alias("whole"))
    return one.join(canonical, "bundle_id").join(q, "bundle_id").join(other, "bundle_id").select("bundle_id", "n_nodes", "whole", "canonical", (F.col("q") >= F.col("other") - 1e-9).alias("better"))


_REACH = _EDGES + ", s AS (SELECT bundle_id, min(node_id) AS v FROM nodes WHERE node_id IN (SELECT a FROM edges UNION SELECT b FROM edges) GROUP BY bundle_id)" + """, two_way AS (SELECT bundle_id, a, b FROM edges UNION ALL SELECT bundle_id, b, a FROM edges),
p AS (WITH RECURSIVE r(v, d) USING KEY (v) AS (SELECT v, 0 FROM s UNION SELECT b, min(r.d + 1) FROM r JOIN two_way ON r.v = two_way.a LEFT JOIN recurring.r AS o ON o.v = b WHERE o.v IS NULL OR o.d > r.d + 1 GROUP BY b) SELECT * FROM r),
far AS (SELECT bundle_id, min_by(v, (-d, v)) AS v FROM p JOIN nodes ON v = node_id GROUP BY bundle_id),
back AS (SELECT t.b AS v, min(t.a) AS previous FROM two_way t JOIN p x ON x.v = t.a JOIN p y ON y.v = t.b WHERE y.d = x.d + 1 GROUP BY t.b)"""


@query(_REACH + ", walk AS (WITH RECURSIVE w(target, place, v) AS (SELECT v, 0, v FROM far UNION ALL SELECT target, place + 1, previous FROM w JOIN back USING (v)) SELECT * FROM w) SELECT target, place::INTEGER AS place, v FROM walk")
def lattice_routes(spark, d):
    """A shortest path from the smallest connected node of each map to the farthest one of smallest id."""
    n = nodes(spark, d)
    edges = L.edges(n).withColumn("w", F.lit(1.0))
    ends = edges.select("bundle_id", F.inline(F.array(F.struct(F.col("a").alias("v")), F.struct(F.col("b").alias("v")))))
    sources = ends.groupBy("bundle_id").agg(F.min("v").alias("v"))
    reached = G.small_paths(edges, "bundle_id", sources)
    far = reached.groupBy("bundle_id").agg(F.min_by("v", F.struct(-F.col("distance"), F.col("v"))).alias("v"))
    return G.small_routes(reached, "bundle_id", far)


_PLACE = "CASE WHEN y IS NULL OR x IS NULL THEN 0 ELSE (least(2, floor(y * 3 / 8)) * 3 + least(2, floor(x * 3 / 8)))::INTEGER END"
_CHOICE = _W + _propagated(8) + f""", pub AS (SELECT bundle_id, node_id, y, x, CASE WHEN (hash_of % 3) = 0 THEN community WHEN (hash_of % 3) = 1 THEN community % 2 END AS community, {_PLACE} AS place FROM (SELECT *, ascii(right(bundle_id, 1)) AS hash_of FROM nodes)),
a AS (SELECT pub.*, coalesce(label, node_id) AS heard FROM pub LEFT JOIN l8 ON v = node_id), c AS (SELECT bundle_id, count(DISTINCT community) AS np, count(DISTINCT heard) AS nh FROM a GROUP BY bundle_id),
k AS (SELECT a.*, CASE WHEN np >= 3 THEN 'graph' WHEN nh BETWEEN 3 AND 20 THEN 'label-propagation' ELSE 'spatial' END AS source FROM a JOIN c USING (bundle_id)),
lab AS (SELECT bundle_id, node_id, y, x, source, CASE source WHEN 'graph' THEN coalesce(community, -1) WHEN 'spatial' THEN place ELSE heard END AS label FROM k),
f AS (SELECT bundle_id, label, row_number() OVER (PARTITION BY bundle_id ORDER BY min(node_id)) - 1 AS community FROM lab GROUP BY bundle_id, label),
chosen AS (SELECT lab.bundle_id, node_id, community, source, y, x FROM lab JOIN f USING (bundle_id, label))"""


def _chosen(spark, d):
    """Maps whose labels are as published, thinned to two, or taken away, by the last sign of their name, so that every source is met."""
    n, third = nodes(spark, d), lambda c: F.least(F.lit(2), F.floor(F.col(c) * 3 / 8))
    mark = F.ascii(F.right("bundle_id", F.lit(1))) % 3
    n = n.withColumn("published", F.when(mark == 0, F.col("community")).when(mark == 1, F.col("community") % 2)).withColumn("place", F.coalesce((third("y") * 3 + third("x")).cast("int"), F.lit(0)))
    return n, G.chosen_communities(n, _map_edges(spark, d), "bundle_id", "node_id", "published", "place")


@query(_CHOICE + " SELECT bundle_id, node_id, community, source FROM chosen")
def chosen_communities(spark, d):
    """Communities of each map from the best signal there is: published, propagated or by place."""
    return _chosen(spark, d)[1].select("bundle_id", "node_id", "community", "source")


@query(_CHOICE + ", m AS (SELECT bundle_id, community, avg((x + 0.5) / 8.0 * 2 - 1) AS mx, avg((y + 0.5) / 8.0 * 2 - 1) AS my FROM chosen GROUP BY ALL) SELECT bundle_id, community, round(coalesce(mx * CASE WHEN sqrt(mx * mx + my * my) > 1e-6 THEN 2.1 ELSE 0 END, 0), 6) AS x, round(coalesce(my * CASE WHEN sqrt(mx * mx + my * my) > 1e-6 THEN 2.1 ELSE 0 END, 0), 6) AS y FROM m")
def community_anchors(spark, d):
    """Where each community of a map is drawn to: its mean place, pushed out."""
    n, chosen = _chosen(spark, d)
    at = G.anchors(chosen.join(n.select("bundle_id", "node_id", "y", "x"), ["bundle_id", "node_id"]), "bundle_id", "community", "y", "x", 8)
    return at.select("bundle_id", "community", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""WITH e AS (SELECT DISTINCT feature_id, x.token_idx AS token FROM (SELECT feature_id, unnest(exemplars) AS x FROM concept_feature) WHERE x.token_idx IS NOT NULL),
t AS (SELECT token, max(feature_id) AS feature FROM e GROUP BY token), c AS (SELECT token % 7 AS community, feature % 5 AS feature, count(*) AS n FROM t GROUP BY ALL)
SELECT community, CASE WHEN max(n) > 1 THEN min_by(feature, (-n, feature)) END AS feature, max(n) AS n FROM c GROUP BY community""")
def plurality_labels(spark, d):
    """The feature that most tokens of a community fire, if more than one does."""
    e = load(spark, d, "concept_feature").select("feature_id", F.explode("exemplars").alias("x")).filter("x.token_idx IS NOT NULL")
    top = e.groupBy(F.col("x.token_idx").alias("token")).agg(F.max("feature_id").alias("feature"))
    return G.plurality(top.select((F.col("token") % 7).alias("community"), (F.col("feature") % 5).alias("feature")), ["community"], "feature")


@query("""WITH book AS (SELECT label AS code, list(m ORDER BY i) AS w FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
n AS (SELECT DISTINCT ON (node_id) node_id, bundle_id, grid, weight FROM sgp_node WHERE len(weight) = 64), u AS (SELECT * FROM n WHERE len(list_filter(weight, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND grid.z IS NOT NULL),
dist AS (SELECT u.*, code, row_number() OVER (PARTITION BY node_id ORDER BY list_sum(list_transform(list_zip(u.weight, b.w), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2]))), code) AS place FROM u, book b)
SELECT bundle_id, code, grid.z AS z, grid.y AS y, grid.x AS x FROM dist WHERE place = 1 AND grid.z = 2""")
def unit_voxels(spark, d):
    """The cells of one depth with their best unit: nearest codebook vector of each cell's weight."""
    from ..operators import dense

    n = nodes(spark, d).filter("z = 2")
    best = dense.nearest(n.select("node_id", "weight"), "node_id", "weight", codebook(spark, d), "code", "centre")
    return n.join(best, "node_id").select("bundle_id", F.col("code").cast("int").alias("code"), "z", "y", "x")


def _spectrum_sql():
    return """WITH n AS (SELECT DISTINCT ON (node_id) bundle_id, grid.z AS z, grid.y AS y, grid.x AS x, hits FROM sgp_node WHERE grid.z IS NOT NULL AND grid.y >= 0 AND grid.x >= 0),
g AS (SELECT bundle_id, z, max(y) + 1 AS ny, max(x) + 1 AS nx FROM n GROUP BY ALL), c AS (SELECT g.*, i AS y, j AS x, coalesce(hits, 0)::DOUBLE AS v FROM g, range(ny) a(i), range(nx) b(j) LEFT JOIN n ON n.bundle_id = g.bundle_id AND n.z = g.z AND n.y = i AND n.x = j),
m AS (SELECT *, v - avg(v) OVER (PARTITION BY bundle_id, z) AS e FROM c),
k AS (SELECT m.bundle_id, m.z, ny, nx, ky, kx, sum(e * cos(2 * pi() * (ky * y::DOUBLE / ny + kx * x::DOUBLE / nx))) AS re, sum(e * sin(2 * pi() * (ky * y::DOUBLE / ny + kx * x::DOUBLE / nx))) AS im FROM m, range(ny) a(ky), range(nx // 2 + 1) b(kx) GROUP BY ALL),
r AS (SELECT *, re * re + im * im AS power, sqrt(power(CASE WHEN ky < (ny + 1) // 2 THEN ky ELSE ky - ny END / ny::DOUBLE, 2) + power(kx / nx::DOUBLE, 2)) AS radius FROM k),
t AS (SELECT *, max(radius) OVER (PARTITION BY bundle_id, z) + 1e-9 AS top FROM r),
b AS (SELECT bundle_id, z, power, (least(7, floor(radius / top * 8 + 1e-12)) + 0.5) / 8 * top AS middle FROM t)
SELECT bundle_id, z, round(sum(middle * power) / (sum(power) + 1e-9), 6) AS centroid FROM b GROUP BY bundle_id, z"""


ORACLE["depth_spectra"] = _spectrum_sql()


def _fitted_sql(epochs=4, start=2.0, end=0.5):
    """SQL of the batch steps of a map from the label means, an update for each epoch."""
    out = """WITH RECURSIVE u0 AS (SELECT label::BIGINT AS code, label // 6 AS z, label // 3 % 2 AS y, label % 3 AS x, list(m ORDER BY i) AS w FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"""
    for t in range(epochs):
        sigma = start * (end / start) ** (t / max(epochs - 1, 1))
        out += f""", b{t} AS (SELECT e.vec_id, min_by(u.code, (list_sum(list_transform(list_zip(e.embedding, u.w), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2]))), u.code)) AS code FROM embeddings e, u{t} u GROUP BY e.vec_id),
s{t} AS (SELECT code, i, sum(v) AS s, count(*) AS n FROM (SELECT code, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings JOIN b{t} USING (vec_id)) GROUP BY code, i),
k{t} AS (SELECT u.code, s.i, sum(h * s.s) / greatest(sum(h * s.n), 1e-12) AS t FROM (SELECT a.code, b.code AS other, exp(-((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) / {2 * sigma * sigma!r}) AS h FROM u{t} a, u{t} b) u JOIN s{t} s ON u.other = s.code GROUP BY u.code, s.i),
u{t + 1} AS (SELECT code, z, y, x, list(w[i] + (t - w[i]) * 0.5 ORDER BY i) AS w FROM u{t} JOIN k{t} USING (code) GROUP BY code, z, y, x)"""
    return out + f" SELECT code, z, y, x, round(w[1], 6) AS w0 FROM u{epochs}"


ORACLE["som_fit"] = _fitted_sql()


@query("SELECT count(*) AS n, true AS within, true AS nearest FROM embeddings")
def kmeans_holds(spark, d):
    """Seeded k-means: every row has a cluster of the ten, that of the nearest centre."""
    from pyspark.ml.clustering import KMeans

    from .evaluation import _vectors

    rows = _vectors(spark, d)
    model = KMeans(k=10, seed=7, maxIter=20).fit(rows)
    from ..operators import dense

    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "code bigint, w array<double>")
    near = dense.nearest(load(spark, d, "embeddings"), "vec_id", "embedding", centres, "code", "w").select("vec_id", "code")
    said = model.transform(rows).select("vec_id", "prediction").join(near, "vec_id")
    return said.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("prediction").between(0, 9)).alias("within"), F.bool_and(F.col("prediction") == F.col("code")).alias("nearest"))


@query("SELECT label, count(*) AS n, true AS sorted FROM (SELECT (code % 10)::INTEGER AS label FROM (SELECT DISTINCT label AS code FROM embeddings)) GROUP BY label")
def unit_communities(spark, d):
    """Communities of a map's units by k-means over their weights, numbered by first occurrence."""
    from ..operators import som

    units = codebook(spark, d)
    found = som.unit_communities(units.select(F.col("code").cast("bigint").alias("code"), F.col("centre").alias("w")), 3)
    firsts = found.groupBy("community").agg(F.min("code").alias("first"))
    held = firsts.agg(F.forall(F.transform(F.array_sort(F.collect_list(F.struct("first", "community"))), lambda x, i: x["community"] == i), lambda x: x).alias("sorted"))
    return found.crossJoin(F.broadcast(held)).groupBy(F.col("code").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.bool_and("sorted").alias("sorted"))


@query("SELECT count(*) AS n, true AS uncorrelated, true AS falling, true AS best FROM embeddings")
def pca_holds(spark, d):
    """Two components: uncorrelated, the first of more variance, and together of as much as the two largest eigenvalues."""
    import numpy as np

    from .evaluation import pca_coordinates

    p = pca_coordinates(spark, d)
    cov = quality.covariance(load(spark, d, "embeddings"), "embedding", 64)
    most = float(np.linalg.eigvalsh(cov)[-2:].sum())
    got = p.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"))
    return got.select("n", (F.abs("r") < 1e-3).alias("uncorrelated"), (F.col("vx") >= F.col("vy")).alias("falling"), (F.abs(F.col("vx") + F.col("vy") - most) < 1e-3 * most).alias("best"))


_UNIT = "(({w0} % 1000000 * 4294967296 + {w1}) % 1000000 * 4294967296 + {w2}) % 1000000 * 4294967296 + {w3}".format(**{f"w{i}": f"('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT" for i in range(4)})


@query(f"WITH h AS (SELECT label, md5(vec_id::VARCHAR || '-1') AS h FROM embeddings), u AS (SELECT label, (({_UNIT}) % 1000000) / 1000000.0 AS u FROM h) SELECT label::DOUBLE AS label, count(*) AS n, true AS within FROM u WHERE u >= 0.8 GROUP BY label")
def probe_holds(spark, d):
    """The linear probe answers every held-out row of every class."""
    from .evaluation import linear_probe

    return linear_probe(spark, d).select("label", "n", F.col("recall").between(0, 1).alias("within"))


@query("SELECT layer, count(*) AS n, true AS same_basis FROM concept_feature WHERE len(firing_rates) = 7 GROUP BY layer")
def layer_trajectories(spark, d):
    """One basis fitted on all rows, and every layer's rows on it: a layer alone gives the same places as all together."""
    from ..operators import quality as Q

    rows = load(spark, d, "concept_feature").filter("size(firing_rates) = 7").select("feature_id", "layer", "firing_rates")
    placed = Q.projected_steps(rows, "layer", "feature_id", "firing_rates")
    alone = Q.projected_steps(rows, "layer", "feature_id", "firing_rates", only=9).select("feature_id", F.col("x").alias("ax"), F.col("y").alias("ay"))
    near = F.coalesce((F.abs(F.col("x") - F.col("ax")) < 1e-9) & (F.abs(F.col("y") - F.col("ay")) < 1e-9), F.lit(True))
    return placed.join(alone, "feature_id", "left").groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.bool_and(near).alias("same_basis"))


_TOKENS = "tok AS (SELECT token_idx AS token, avg(activation) AS size, max(activation) AS score FROM exemplar_ref WHERE token_idx IS NOT NULL AND activation > 0 AND isfinite(activation) GROUP BY token_idx)"


@query(f"""WITH {_TOKENS}, att AS (SELECT token_idx AS dst, (token_idx * 7 + class_label) % 197 AS src, sum(activation) AS w FROM exemplar_ref WHERE token_idx IS NOT NULL AND activation > 0 AND isfinite(activation) AND class_label >= 0 GROUP BY ALL),
n AS (SELECT dst, src, w / sum(w) OVER (PARTITION BY dst) AS w FROM att), c AS (SELECT token, CASE WHEN token > 0 THEN ((token - 1) % 14 + 0.5) / 14 ELSE 0 END AS x, CASE WHEN token > 0 THEN ((token - 1) // 14 + 0.5) / 14 ELSE 0 END AS y FROM tok),
v AS (SELECT dst AS token, sum(w * (b.x - a.x)) AS vx, sum(w * (b.y - a.y)) AS vy FROM n JOIN c a ON a.token = dst JOIN c b ON b.token = src WHERE dst > 0 AND src > 0 GROUP BY dst),
got AS (SELECT src AS token, sum(w) AS s FROM n GROUP BY src), f AS (SELECT token, x, y, coalesce(vx, 0) AS vx, coalesce(vy, 0) AS vy, size, score, coalesce(s, 0) AS s FROM tok JOIN c USING (token) LEFT JOIN v USING (token) LEFT JOIN got USING (token)),
g AS (SELECT *, 1 + 1.5 * least(1, sqrt(vx * vx + vy * vy) / 0.35) AS ratio FROM f)
SELECT token, round(x, 6) AS x, round(y, 6) AS y, round(0.5 / 14 * sqrt(ratio), 6) AS rx, round(0.5 / 14 / sqrt(ratio), 6) AS ry, round(CASE WHEN sqrt(vx * vx + vy * vy) > 1e-9 THEN atan2(vy, vx) ELSE 0 END, 6) AS theta, round(size / max(size) OVER (), 6) AS opacity, round(score / max(score) OVER (), 6) AS glow, round(s / max(s) OVER (), 6) AS halo FROM g""")
def token_field(spark, d):
    """A field of ellipses over tokens: place, stretch and turn toward what is attended to, and how strong each is."""
    from ..operators import attribution as A

    good = load(spark, d, "exemplar_ref").filter("token_idx IS NOT NULL AND activation > 0 AND activation < double('inf')")
    t = F.col("token_idx")
    tokens = good.groupBy(t.alias("token")).agg(F.avg("activation").alias("size"), F.max("activation").alias("score"))
    attention = good.filter("class_label >= 0").groupBy(t.alias("dst"), ((t * 7 + F.col("class_label")) % 197).alias("src")).agg(F.sum("activation").alias("w"))
    total = attention.groupBy("dst").agg(F.sum("w").alias("t"))
    attention = attention.join(total, "dst").select("dst", "src", (F.col("w") / F.col("t")).alias("w"))
    f = A.token_field(tokens, attention, grid=14)
    return f.select("token", *[F.round(c, 6).alias(c) for c in ("x", "y", "rx", "ry", "theta", "opacity", "glow", "halo")])


@query("""WITH p AS (SELECT l_orderkey % 224 AS y, (l_partkey * 7 + l_linenumber) % 224 AS x, l_quantity / 50 AS r, l_discount * 10 AS g, l_tax * 12 AS b FROM lineitem)
SELECT 1 + (y // 16) * 14 + x // 16 AS token, round(least(1, avg(r)), 6) AS r, round(least(1, avg(g)), 6) AS g, round(least(1, avg(b)), 6) AS b FROM p GROUP BY y // 16, x // 16 UNION ALL SELECT 0, round(least(1, avg(r)), 6), round(least(1, avg(g)), 6), round(least(1, avg(b)), 6) FROM p""")
def patch_colours(spark, d):
    """Mean colour of each patch of pixels, and of the whole image at the class token."""
    from ..operators import attribution as A

    pixels = load(spark, d, "lineitem").select((F.col("l_orderkey") % 224).alias("y"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 224).alias("x"), (F.col("l_quantity") / 50).alias("r"), (F.col("l_discount") * 10).alias("g"), (F.col("l_tax") * 12).alias("b"))
    c = A.patch_colours(pixels, 14, 16)
    return c.select("token", *[F.round(n, 6).alias(n) for n in "rgb"])


@query("SELECT unnest(['pca', 'random']) AS method, (SELECT count(*) FROM embeddings) AS n, true AS spread")
def projection_methods(spark, d):
    """Every method that is there, fitted and applied; one whose library is absent is passed over."""
    placed = quality.projections(load(spark, d, "embeddings"), "vec_id", "embedding", ["pca", "umap", "random"])
    return placed.groupBy("method").agg(F.count(F.lit(1)).alias("n"), ((F.stddev("x") > 0) & (F.stddev("y") > 0)).alias("spread"))
