"""Lattice, community and concept graphs."""

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import lattice as L
from ..session import load
from .joins import _EDGES, _NODES
from .registry import query

_GOOD = "good AS (SELECT node_id, weight FROM nodes WHERE len(weight) = 64 AND len(list_filter(weight, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"
_DIST = ", " + _GOOD + """, d AS (SELECT e.bundle_id, a, b, sqrt(list_sum(list_transform(list_zip(x.weight, y.weight), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])))) AS distance
FROM edges e JOIN good x ON x.node_id = a JOIN good y ON y.node_id = b)"""


def nodes(spark, d):
    return L.nodes(load(spark, d, "sgp_node"))


def good(n):
    w = F.col("weight")
    return n.filter((F.size(w) == 64) & ~F.exists(w, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


@query(_EDGES + _DIST + ", s AS (SELECT a AS node_id, distance FROM d UNION ALL SELECT b, distance FROM d), m AS (SELECT node_id, avg(distance) AS u FROM s GROUP BY node_id) SELECT node_id, round(coalesce(u, 0), 6) AS u FROM good LEFT JOIN m USING (node_id)")
def umatrix(spark, d):
    """Mean distance of each node to its lattice neighbours."""
    n = good(nodes(spark, d))
    return L.umatrix(L.edges(n), n).select("node_id", F.round("u", 6).alias("u"))


@query(_EDGES + _DIST + " SELECT bundle_id, a, b, round(1 / (1 + distance), 6) AS w FROM d")
def similarity_edges(spark, d):
    n = good(nodes(spark, d))
    return L.with_weights(L.edges(n), n).select("bundle_id", "a", "b", F.round(1 / (1 + F.col("distance")), 6).alias("w"))


@query(_EDGES + ", n AS (SELECT bundle_id, count(*) AS n_nodes, count(*) FILTER (dead) AS n_dead, count(DISTINCT community) AS n_communities FROM nodes GROUP BY bundle_id), e AS (SELECT bundle_id, count(*) AS n_edges FROM edges GROUP BY bundle_id) SELECT bundle_id, n_nodes, n_dead, n_communities, coalesce(n_edges, 0) AS n_edges FROM n LEFT JOIN e USING (bundle_id)")
def som_graph_asset(spark, d):
    """Size of each map's graph: nodes, dead nodes, communities, edges."""
    n = nodes(spark, d)
    e = L.edges(n).groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n_edges"))
    one = n.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.count(F.when(F.col("dead"), 1)).alias("n_dead"), F.countDistinct("community").alias("n_communities"))
    return one.join(e, "bundle_id", "left").select("bundle_id", "n_nodes", "n_dead", "n_communities", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


@query("WITH " + _NODES + " SELECT bundle_id, z, y, x FROM nodes WHERE community = 1 AND NOT dead")
def community_voxels(spark, d):
    return nodes(spark, d).filter("community = 1 AND NOT dead").select("bundle_id", "z", "y", "x")


@query("WITH " + _NODES + " SELECT node_id, CASE WHEN y IS NULL OR x IS NULL THEN 0 ELSE (least(2, floor(y * 3 / 8)) * 3 + least(2, floor(x * 3 / 8)))::INTEGER END AS region FROM nodes")
def spatial_regions(spark, d):
    """Three by three buckets of the plane of each map."""
    third = lambda c: F.least(F.lit(2), F.floor(F.col(c) * 3 / 8))
    return nodes(spark, d).select("node_id", F.coalesce((third("y") * 3 + third("x")).cast("int"), F.lit(0)).alias("region"))


@query("WITH " + _NODES + ", m AS (SELECT bundle_id, community, count(*) AS n, min(node_id) AS first_id, string_agg(node_id, ',' ORDER BY node_id) AS members FROM nodes WHERE community IS NOT NULL GROUP BY ALL) SELECT bundle_id, row_number() OVER (PARTITION BY bundle_id ORDER BY first_id) - 1 AS place, n, members FROM m")
def community_members(spark, d):
    """Sorted members of each community, communities by their smallest member."""
    from pyspark.sql import Window

    m = nodes(spark, d).filter("community IS NOT NULL").groupBy("bundle_id", "community").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("node_id")).alias("m"))
    place = F.row_number().over(Window.partitionBy("bundle_id").orderBy(F.element_at("m", 1))) - 1
    return m.select("bundle_id", place.cast("bigint").alias("place"), "n", F.array_join(F.col("m").cast("array<string>"), ",").alias("members"))


def _map_edges(spark, d):
    n = good(nodes(spark, d))
    return L.with_weights(L.edges(n), n).select("bundle_id", "a", "b", (1 / (1 + F.col("distance"))).alias("w"))


@query()
def propagated_labels(spark, d):
    """Labels of the map nodes by synchronous propagation over similarity edges."""
    return G.label_propagation(_map_edges(spark, d))


@query()
def modularity_labels(spark, d):
    """Communities of each map by greedy modularity, one small graph per task."""
    return G.modularity_communities(_map_edges(spark, d), "bundle_id")


@query(_EDGES + ", s AS (SELECT bundle_id, min(node_id) AS v FROM nodes WHERE node_id IN (SELECT a FROM edges UNION SELECT b FROM edges) GROUP BY bundle_id)" + """, two_way AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
p AS (WITH RECURSIVE r(v, d) USING KEY (v) AS (SELECT v, 0 FROM s UNION SELECT b, min(r.d + 1) FROM r JOIN two_way ON r.v = two_way.a LEFT JOIN recurring.r AS o ON o.v = b WHERE o.v IS NULL OR o.d > r.d + 1 GROUP BY b) SELECT * FROM r)
SELECT v, d::DOUBLE AS distance FROM p""")
def lattice_distances(spark, d):
    """Steps over lattice edges from the smallest connected node of each map."""
    edges = L.edges(nodes(spark, d)).withColumn("w", F.lit(1.0))
    ends = edges.select("bundle_id", F.inline(F.array(F.struct(F.col("a").alias("v")), F.struct(F.col("b").alias("v")))))
    return G.small_paths(edges, "bundle_id", ends.groupBy("bundle_id").agg(F.min("v").alias("v"))).select("v", "distance")


@query("""SELECT 'concept' AS kind, 'c' || feature_id AS id FROM concept_feature UNION ALL SELECT DISTINCT 'image', 'i' || e.image_id FROM (SELECT unnest(exemplars) AS e FROM concept_feature) WHERE e.image_id IS NOT NULL
UNION ALL SELECT DISTINCT 'class', 'k' || e.class_label FROM (SELECT unnest(exemplars) AS e FROM concept_feature) WHERE e.class_label >= 0 UNION ALL SELECT DISTINCT 'dataset', 'd' || dataset_id FROM concept_feature""")
def concept_graph_nodes(spark, d):
    """Typed nodes of the concept graph."""
    f = load(spark, d, "concept_feature")
    e = f.select(F.explode("exemplars").alias("e"))
    typed = lambda rows, kind, mark, name: rows.select(F.lit(kind).alias("kind"), F.concat(F.lit(mark), F.col(name).cast("string")).alias("id"))
    parts = [typed(f, "concept", "c", "feature_id"), typed(e.filter("e.image_id IS NOT NULL").select("e.image_id").distinct(), "image", "i", "image_id")]
    parts += [typed(e.filter("e.class_label >= 0").select("e.class_label").distinct(), "class", "k", "class_label"), typed(f.select("dataset_id").distinct(), "dataset", "d", "dataset_id")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("""SELECT 'fires_on' AS kind, 'c' || feature_id AS a, 'i' || e.image_id AS b, round(max(e.activation), 6) AS w FROM (SELECT feature_id, unnest(exemplars) AS e FROM concept_feature) WHERE e.image_id IS NOT NULL AND isfinite(e.activation) GROUP BY ALL
UNION ALL SELECT 'belongs_to', 'c' || feature_id, 'd' || dataset_id, 1.0 FROM concept_feature""")
def concept_graph_edges(spark, d):
    """Typed edges of the concept graph."""
    f = load(spark, d, "concept_feature")
    e = f.select("feature_id", F.explode("exemplars").alias("e")).select("feature_id", "e.*")
    e = e.filter("image_id IS NOT NULL AND activation IS NOT NULL AND NOT isnan(activation) AND abs(activation) < double('inf')")
    fires = e.groupBy("feature_id", "image_id").agg(F.round(F.max("activation"), 6).alias("w"))
    fires = fires.select(F.lit("fires_on").alias("kind"), F.concat(F.lit("c"), F.col("feature_id").cast("string")).alias("a"), F.concat(F.lit("i"), "image_id").alias("b"), "w")
    within = f.select(F.lit("belongs_to").alias("kind"), F.concat(F.lit("c"), F.col("feature_id").cast("string")).alias("a"), F.concat(F.lit("d"), "dataset_id").alias("b"), F.lit(1.0).alias("w"))
    return fires.unionByName(within)


@query("""WITH w AS (SELECT l_partkey AS dst, l_suppkey AS src, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), t AS (SELECT dst, sum(w) AS t FROM w GROUP BY dst)
SELECT dst, src, round(0.5 * w / t, 6) AS w FROM w JOIN t USING (dst)""")
def residual_attention(spark, d):
    """Half the row-normalized weight of every edge; the other half is the implicit residual edge."""
    w = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("dst"), F.col("l_suppkey").alias("src")).agg(F.sum("l_quantity").alias("w"))
    t = w.groupBy("dst").agg(F.sum("w").alias("t"))
    return w.join(t, "dst").select("dst", "src", F.round(0.5 * F.col("w") / F.col("t"), 6).alias("w"))


@query("""SELECT node_id, round(sqrt(power((x - 3.5) * cos(0.3) + (y - 3.5) * sin(0.3), 2) / 4 + power((y - 3.5) * cos(0.3) - (x - 3.5) * sin(0.3), 2)), 6) AS m FROM (SELECT DISTINCT ON (node_id) node_id, grid.x AS x, grid.y AS y FROM sgp_node) WHERE x IS NOT NULL AND y IS NOT NULL""")
def ellipse_distances(spark, d):
    """Mahalanobis distance of every node to a turned ellipse."""
    n = nodes(spark, d).filter("x IS NOT NULL AND y IS NOT NULL")
    dx, dy = F.col("x") - 3.5, F.col("y") - 3.5
    c, s = F.cos(F.lit(0.3)), F.sin(F.lit(0.3))
    return n.select("node_id", F.round(F.sqrt(F.pow(dx * c + dy * s, 2) / 4 + F.pow(dy * c - dx * s, 2)), 6).alias("m"))
