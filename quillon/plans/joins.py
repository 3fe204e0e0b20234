"""Joins: lookups, nearest neighbours, inverted index, lattice adjacency, pairs within concepts."""

from pyspark.sql import functions as F

from ..operators import dense, lattice
from ..session import load
from .registry import query


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def listed_semi_join(spark, d):
    """Rows of a listing that an annotation list names."""
    listed = load(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return load(spark, d, "part").join(listed, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("""SELECT s.s_suppkey, s.s_name, n.n_name, r.r_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def taxonomy_lookup(spark, d):
    """Class to category through two dimension tables."""
    nation, region = load(spark, d, "nation"), load(spark, d, "region")
    both = load(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("s_suppkey", "s_name", "n_name", "r_name")


@query("""WITH c AS (SELECT image_id, dataset_id, row_number() OVER (PARTITION BY image_id ORDER BY CASE dataset_id WHEN 'ds03' THEN 0 WHEN 'ds01' THEN 1 ELSE 2 END, dataset_id, row_id) AS rn, row_id
FROM image_metadata WHERE image_id IS NOT NULL) SELECT image_id, dataset_id, row_id FROM c WHERE rn = 1""")
def prioritized_source(spark, d):
    """The first of the candidate sources, in their given order, that has an image."""
    rank = F.when(F.col("dataset_id") == "ds03", 0).when(F.col("dataset_id") == "ds01", 1).otherwise(2)
    best = F.min(F.struct(rank.alias("r"), "dataset_id", "row_id"))
    return load(spark, d, "image_metadata").filter("image_id IS NOT NULL").groupBy("image_id").agg(best.alias("b")).select("image_id", "b.dataset_id", "b.row_id")


_EX = "SELECT feature_id, unnest(exemplars, recursive := true) FROM concept_feature"


@query(f"""WITH e AS ({_EX}) SELECT DISTINCT token_idx, feature_id FROM e WHERE token_idx IS NOT NULL""")
def inverted_index(spark, d):
    """Token to the concepts that fire on it, as postings of one row each: lists would grow with the concepts."""
    e = load(spark, d, "concept_feature").select("feature_id", F.explode("exemplars").alias("e")).filter("e.token_idx IS NOT NULL")
    return e.select("e.token_idx", "feature_id").distinct()


@query(f"""WITH e AS (SELECT DISTINCT feature_id, image_id, token_idx FROM ({_EX}) WHERE token_idx IS NOT NULL AND image_id IS NOT NULL)
SELECT 'token' AS kind, image_id || ':' || token_idx AS ref, feature_id FROM e UNION SELECT 'node', 'L11_T' || token_idx, feature_id FROM e
UNION SELECT 'patch', ((token_idx - 1) // 14) || ':' || ((token_idx - 1) % 14), feature_id FROM e WHERE token_idx > 0
UNION SELECT 'point', image_id, feature_id FROM e WHERE token_idx = 0""")
def cross_view_resolve(spark, d):
    """Every concept to its linked tokens, graph nodes, patches, and for the class token the point."""
    from ..functions import scalars as S

    e = load(spark, d, "concept_feature").select("feature_id", F.explode("exemplars").alias("e")).select("feature_id", "e.image_id", "e.token_idx")
    e = e.filter("token_idx IS NOT NULL AND image_id IS NOT NULL")
    t = F.col("token_idx")
    refs = [("token", S.ref_key(F.col("image_id"), t), None), ("node", S.node_id(F.lit(11), t), None), ("patch", S.ref_key(S.token_row(t).cast("string"), S.token_col(t)), t > 0), ("point", F.col("image_id"), t == 0)]
    linked = F.array(*[F.struct(F.lit(kind).alias("kind"), (ref if when is None else F.when(when, ref)).alias("ref")) for kind, ref, when in refs])
    return e.select("feature_id", F.inline(linked)).filter("ref IS NOT NULL").select("kind", "ref", "feature_id").distinct()


_CODEBOOK = """book AS (SELECT label AS code, list(m ORDER BY i) AS w FROM (
  SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"""
_D2 = "list_sum(list_transform(list_zip(e.embedding, b.w), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])))"
_BMU = f"""WITH {_CODEBOOK}, dist AS (SELECT e.vec_id, b.code, {_D2} AS d2 FROM embeddings e, book b),
bmu AS (SELECT vec_id, code, d2, row_number() OVER (PARTITION BY vec_id ORDER BY d2, code) AS place FROM dist)"""


def codebook(spark, d):
    """The label means of the embeddings as a codebook (code, centre)."""
    return dense.dimension_means(load(spark, d, "embeddings"), "label", "embedding", 64).withColumnRenamed("label", "code")


@query(_BMU + " SELECT vec_id, code, round(sqrt(d2), 6) AS distance FROM bmu WHERE place = 1")
def som_best_units(spark, d):
    """The nearest codebook vector of every embedding."""
    near = dense.nearest(load(spark, d, "embeddings"), "vec_id", "embedding", codebook(spark, d), "code", "centre")
    return near.select("vec_id", F.col("code").cast("int").alias("code"), F.round(F.sqrt("d2"), 6).alias("distance"))


@query(_BMU + """ SELECT g.code, count(b.vec_id) AS hits, count(b.vec_id) = 0 AS dead FROM generate_series(0, 11) g(code)
LEFT JOIN (SELECT * FROM bmu WHERE place = 1) b USING (code) GROUP BY g.code""")
def som_hit_counts(spark, d):
    """Hits of all units of a lattice of twelve, those without hits too."""
    near = dense.nearest(load(spark, d, "embeddings"), "vec_id", "embedding", codebook(spark, d), "code", "centre")
    hits = near.groupBy("code").agg(F.count(F.lit(1)).alias("hits"))
    return spark.range(12).toDF("code").join(hits, "code", "left").select("code", F.coalesce("hits", F.lit(0)).alias("hits"), F.col("hits").isNull().alias("dead"))


_COS = "round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: p[1]::DOUBLE * p[2])) / sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x))) / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x))), 9)"
_KNN = f"""WITH pairs AS (SELECT q.vec_id AS query, e.vec_id AS neighbour, e.label, q.label AS own, {_COS} AS s FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS place FROM pairs QUALIFY place <= 5)"""


@query(_KNN + " SELECT query, neighbour, round(s, 6) AS similarity, place FROM near")
def knn_graph(spark, d):
    """The five nearest by cosine of the stated queries (ids divisible by 20), among all rows."""
    e = load(spark, d, "embeddings")
    near = dense.cosine_neighbours(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)
    return near.select("query", "neighbour", F.round("s", 6).alias("similarity"), "place")


@query(_KNN + """, votes AS (SELECT query, own, label, count(*) AS n FROM near GROUP BY ALL),
pred AS (SELECT query, own, min_by(label, (-n, label)) AS predicted FROM votes GROUP BY query, own)
SELECT query, predicted, predicted = own AS correct FROM pred""")
def knn_vote(spark, d):
    """Majority label among the five nearest; ties go to the smallest label."""
    e = load(spark, d, "embeddings")
    near = dense.cosine_neighbours(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)
    voted = dense.vote(near, e, "vec_id", "label")
    own = e.select(F.col("vec_id").alias("query"), F.col("label").alias("own"))
    return voted.join(own, "query").select("query", "predicted", (F.col("predicted") == F.col("own")).alias("correct"))


@query(_KNN.replace(" WHERE q.vec_id % 20 = 0", "") + " SELECT query, neighbour, round(s, 6) AS similarity, place FROM near")
def knn_whole(spark, d):
    """The five nearest by cosine of every row, among all rows."""
    e = load(spark, d, "embeddings")
    return dense.cosine_neighbours(e, e, "vec_id", "embedding", 5).select("query", "neighbour", F.round("s", 6).alias("similarity"), "place")


_NODES = "nodes AS (SELECT DISTINCT ON (node_id) node_id, bundle_id, idx, grid.z AS z, grid.y AS y, grid.x AS x, hits, umatrix, community, dead, weight FROM sgp_node)"
_EDGES = f"""WITH {_NODES}, edges AS (SELECT a.bundle_id, a.node_id AS a, b.node_id AS b FROM nodes a JOIN nodes b ON a.bundle_id = b.bundle_id AND a.node_id <> b.node_id
 AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1 AND (a.z, a.y, a.x) < (b.z, b.y, b.x))"""


@query(_EDGES + " SELECT bundle_id, a, b FROM edges")
def lattice_edges(spark, d):
    """Undirected edges between face neighbours of each published map."""
    return lattice.edges(lattice.nodes(load(spark, d, "sgp_node"))).select("bundle_id", "a", "b")




@query("""WITH u AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), p AS (
 SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM u a JOIN u b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL)
SELECT a, b, n FROM p WHERE n >= 2""")
def coactivation_pairs(spark, d):
    """Pairs i < j that are active together (suppliers in one order), a bounded set within each key."""
    u = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    pairs = u.select("l_orderkey", F.col("l_suppkey").alias("a")).join(u.select("l_orderkey", F.col("l_suppkey").alias("b")), "l_orderkey").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


@query("""SELECT lower(sex) AS attribute, dx AS concept, count(*) AS n FROM (SELECT trim(lower(dx)) AS dx, trim(sex) AS sex FROM image_metadata) WHERE dx IS NOT NULL AND sex IS NOT NULL GROUP BY ALL""")
def attribute_by_concept(spark, d):
    rows = load(spark, d, "image_metadata").select(F.lower(F.trim("sex")).alias("attribute"), F.trim(F.lower("dx")).alias("concept"))
    return rows.filter("attribute IS NOT NULL AND concept IS NOT NULL").groupBy("attribute", "concept").agg(F.count(F.lit(1)).alias("n"))


@query(_EDGES + """, sel AS (SELECT node_id FROM nodes WHERE NOT dead AND hits > 1000), two_way AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges)
SELECT node_id FROM sel UNION SELECT b FROM two_way JOIN sel ON a = node_id""")
def neighbour_focus(spark, d):
    """Selected nodes and their direct neighbours."""
    nodes = lattice.nodes(load(spark, d, "sgp_node"))
    chosen = nodes.filter("NOT dead AND hits > 1000").select("node_id")
    near = lattice.both_ways(lattice.edges(nodes)).join(chosen, F.col("a") == F.col("node_id"), "left_semi").select(F.col("b").alias("node_id"))
    return chosen.union(near).distinct()


@query("""SELECT o.o_orderkey, count(l.l_orderkey) AS n_lines FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_quantity > 45 GROUP BY o.o_orderkey""")
def optional_asset(spark, d):
    """An asset that need not be there: a left join, absent as zero."""
    lines = load(spark, d, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return load(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"))
