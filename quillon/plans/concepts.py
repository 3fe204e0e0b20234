"""Concepts: probes, sparse codes and their diagnostics, clusters of units, tokens of one layer, contrast of two views."""

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import concepts as C
from ..operators import dense, som
from ..session import load
from .attribution import scores
from .joins import codebook
from .registry import query

_FIRES = "fires AS (SELECT image_id, feature_id, avg(activation) AS activation FROM exemplar_ref WHERE image_id IS NOT NULL AND isfinite(activation) GROUP BY ALL)"


def fires(spark, d):
    rows = load(spark, d, "exemplar_ref").filter("NOT isnan(activation) AND abs(activation) < double('inf')")
    return C.probe_activations(rows, "image_id", "feature_id", "activation")


@query(f"WITH {_FIRES} SELECT image_id, feature_id, round(activation, 9) AS activation FROM fires")
def probe_activations(spark, d):
    """Mean activation of each unit in each image, over all its fires there."""
    return fires(spark, d).select("image_id", "feature_id", F.round("activation", 9).alias("activation"))


@query(f"WITH {_FIRES}, units AS (SELECT DISTINCT feature_id FROM fires WHERE feature_id % 3 = 0), places AS (SELECT feature_id AS channel, row_number() OVER (ORDER BY feature_id) - 1 AS place FROM units) SELECT image_id, place, channel, round(activation, 9) AS activation FROM fires JOIN places ON feature_id = channel")
def tracked_units(spark, d):
    """A state kept by subsampled place, given back its original channels."""
    from ..operators.positions import with_position

    rows = fires(spark, d)
    index = with_position(rows.filter("feature_id % 3 = 0").select(F.col("feature_id").alias("channel")).distinct().withColumn("g", F.lit(0)), "g", [F.col("channel").asc()], "p")
    index = index.select((F.col("p") - 1).alias("place"), "channel")
    kept = rows.join(index, F.col("feature_id") == F.col("channel")).select("image_id", "place", "activation")
    return C.tracked_units(kept, "place", index).select("image_id", "place", "channel", F.round("activation", 9).alias("activation"))


_CODES = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
w AS (SELECT label AS feature, list(m ORDER BY i) AS d FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label
 UNION ALL SELECT label + 100, list_transform(list(m ORDER BY i), lambda x: x * 2) FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) WHERE label = 0 GROUP BY label
 UNION ALL SELECT 200, list_transform(range(0, 64), lambda i: -100.0)),
o AS (SELECT vec_id, feature, greatest(list_sum(list_transform(list_zip(x, d), lambda p: p[1] * p[2])), 0) AS a FROM v, w),
c AS (SELECT vec_id, feature, a FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY a DESC, feature) AS k FROM o WHERE feature <> 200) WHERE k <= 3 AND a > 0)"""


def _decoder(spark, d):
    """The label means as directions, one of them twice over, and one that nothing is coded by."""
    book = codebook(spark, d).select(F.col("code").cast("bigint").alias("feature"), F.col("centre").alias("d"))
    twin = book.filter("feature = 0").select((F.col("feature") + 100).alias("feature"), F.transform("d", lambda x: x * 2).alias("d"))
    unused = spark.range(1).select(F.lit(200).cast("bigint").alias("feature"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.lit(-100.0)).alias("d"))
    return book.unionByName(twin).unionByName(unused)


def _codes(spark, d):
    import numpy as np

    rows = _decoder(spark, d).filter("feature <> 200").orderBy("feature").collect()  # a dictionary of bounded size
    names = spark.createDataFrame([(i, r.feature) for i, r in enumerate(rows)], "place bigint, feature bigint")
    found = som.sparse_codes(load(spark, d, "embeddings"), "vec_id", "embedding", np.array([r.d for r in rows]), np.zeros(64), 3)
    return found.withColumnRenamed("feature", "place").join(F.broadcast(names), "place").select("vec_id", "feature", "activation")


@query(_CODES + " SELECT vec_id, feature, round(a, 6) AS activation FROM c")
def sparse_codes(spark, d):
    """The three largest positive outputs of each vector over a dictionary of directions."""
    return _codes(spark, d).select("vec_id", "feature", F.round("activation", 6).alias("activation"))


@query(_CODES + """, r AS (SELECT vec_id, i, sum(a * x) AS y FROM (SELECT vec_id, a, unnest(d) AS x, generate_subscripts(d, 1) AS i FROM c JOIN w USING (feature)) GROUP BY ALL),
e AS (SELECT sum(power(v.x[i] - coalesce(y, 0), 2)) / 64 AS e FROM v CROSS JOIN range(1, 65) t(i) LEFT JOIN r USING (vec_id, i) GROUP BY v.vec_id),
s AS (SELECT p.feature, max(list_sum(list_transform(list_zip(p.d, q.d), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(p.d, lambda x: x * x))) / sqrt(list_sum(list_transform(q.d, lambda x: x * x)))) AS s FROM w p JOIN w q ON p.feature <> q.feature GROUP BY p.feature)
SELECT (SELECT count(*) FROM w) AS n_features, round((SELECT count(*) FROM w WHERE feature NOT IN (SELECT feature FROM c)) / (SELECT count(*) FROM w), 9) AS dead_rate,
round((SELECT count(*) FROM c) / (SELECT count(*) FROM v), 9) AS l0, round((SELECT avg(e) FROM e), 6) AS recon_loss, round((SELECT count(*) FROM s WHERE s > 0.9) / (SELECT count(*) FROM w), 9) AS duplicate_rate""")
def sparse_diagnostics(spark, d):
    """Dead rate, L0, reconstruction loss and duplicate rate of the codes."""
    inputs = load(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    one = C.sparse_diagnostics(_codes(spark, d), "vec_id", "feature", "activation", inputs, _decoder(spark, d), 64)
    return one.select("n_features", *[F.round(c, 6 if c == "recon_loss" else 9).alias(c) for c in one.columns[1:]])


@query("""WITH live AS (SELECT coalesce(coherence, 0) AS c, exemplars[1] AS e FROM concept_feature WHERE len(exemplars) > 0), rates AS (SELECT count(*) FILTER (coalesce(len(exemplars), 0) = 0) / count(*) AS dead FROM concept_feature),
g AS (SELECT count(*) AS live, avg(c) AS coherence, 1 - count(DISTINCT (coalesce(e.image_id, chr(0)), coalesce(e.token_idx::VARCHAR, chr(0)))) / count(*) AS dup FROM live)
SELECT live, round(dead, 9) AS dead_rate, list_filter([CASE WHEN dead > 0.02 THEN 'dead_feature_rate' END, CASE WHEN coherence < 0.3 THEN 'exemplar_coherence' END, CASE WHEN dup > 0.35 THEN 'duplicate_feature_rate' END], lambda x: x IS NOT NULL) AS reasons FROM g, rates""")
def quality_gate_dead(spark, d):
    """The gate fed with the dead rate of the dictionary: features without an exemplar."""
    gate = C.quality_gate(load(spark, d, "concept_feature"), dead=None, most_dead=0.02)
    return gate.select("live", F.round("dead_rate", 9).alias("dead_rate"), "reasons")


@query("""SELECT count(*) AS n_units, 1 AS found, true AS whole FROM (SELECT DISTINCT l_suppkey FROM lineitem)""")
def concept_clusters(spark, d):
    """Ward clusters of the suppliers by whom they share orders with: eight concepts, every active unit in one."""
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey").repartition("l_orderkey")  # one shuffle for counts and pairs
    u = rows.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("a"))
    pairs, activity = C.correlated(u, "l_orderkey", "l_suppkey", "a")
    found = C.concept_clusters(pairs, activity, least_units=1)
    return found.agg(F.count(F.lit(1)).alias("n_units"), F.when(F.countDistinct("unit") == F.count(F.lit(1)), 1).otherwise(0).alias("found"), (F.countDistinct("concept") <= 8).alias("whole"))


@query("""WITH e AS (SELECT feature_id, layer, unnest(exemplars) AS x FROM concept_feature) SELECT feature_id, x.token_idx AS token_idx, round(max(x.activation), 9) AS activation FROM e
WHERE layer = (SELECT max(layer) FROM concept_feature) AND x.token_idx = 0 AND isfinite(x.activation) GROUP BY ALL""")
def final_step_tokens(spark, d):
    """The class token's activations at the last layer."""
    f = load(spark, d, "concept_feature")
    last = f.agg(F.max("layer").alias("layer"))
    e = f.join(F.broadcast(last), "layer").select("feature_id", F.explode("exemplars").alias("x")).select("feature_id", "x.*")
    e = e.filter("token_idx = 0 AND NOT isnan(activation) AND abs(activation) < double('inf')")
    return e.groupBy("feature_id", "token_idx").agg(F.round(F.max("activation"), 9).alias("activation"))


@query("""SELECT layer, feature_id, len(exemplars) AS n FROM concept_feature WHERE layer = 9 AND exemplars IS NOT NULL""")
def layer_slice(spark, d):
    """The features of one layer; a layer that is not there is an error."""
    return V.at_step(load(spark, d, "concept_feature"), "layer", 9).filter("exemplars IS NOT NULL").select("layer", "feature_id", F.size("exemplars").cast("bigint").alias("n"))


_PAIRS = """WITH z AS (SELECT vec_id AS k, 0 AS view, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings UNION ALL
 SELECT vec_id, 1, list_transform(list_zip(embedding, range(0, 64)), lambda p: p[1]::DOUBLE * (1 + 0.01 * p[2])) FROM embeddings),
n AS (SELECT k, view, (list_transform(x, lambda v: v / l))::DOUBLE[64] AS x FROM (SELECT *, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS l FROM z)),
s AS (SELECT a.k, a.view, b.k = a.k AS own, array_inner_product(a.x, b.x) / 0.5 AS s FROM n a JOIN n b ON (a.k, a.view) <> (b.k, b.view))"""


@query(_PAIRS + " SELECT k AS vec_id, view, round(ln(sum(exp(s))) - max(s) FILTER (own), 6) AS loss FROM s GROUP BY k, view")
def view_contrast(spark, d):
    """Cross-entropy of each view's pair among all other views, at a temperature of one half; all rows are one batch."""
    e = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    views = e.withColumn("b", F.transform("a", lambda x, i: x * (1 + 0.01 * i)))
    return dense.pair_contrast(views, "vec_id", "a", "b", 0.5).select("vec_id", "view", F.round("loss", 6).alias("loss"))


@query("""SELECT run_id, round(sum(list_sum([0.5 * coalesce(a, 0), 2.0 * coalesce(b, 0)])), 9) AS total FROM (SELECT run_id, avg(prediction.confidence) FILTER (isfinite(prediction.confidence)) AS a, avg(timings.predict_ms) FILTER (isfinite(timings.predict_ms)) AS b FROM pack_manifest GROUP BY run_id) GROUP BY run_id""")
def weighted_terms(spark, d):
    """Sum of named terms by their weights; a term without a weight counts nothing."""
    fine = lambda c: F.avg(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)))
    p = load(spark, d, "pack_manifest").select("run_id", F.col("prediction.confidence").alias("c"), F.col("timings.predict_ms").alias("t"))
    terms = p.groupBy("run_id").agg(F.create_map(F.lit("a"), fine("c"), F.lit("b"), fine("t"), F.lit("unweighed"), F.lit(99.0)).alias("terms"))
    return terms.select("run_id", F.round(V.weighted_sum(F.col("terms"), {"a": 0.5, "b": 2.0}), 9).alias("total"))


@query("""SELECT feature_id, round((max(activation) - 0.1) * avg(token_idx), 6) AS x FROM exemplar_ref WHERE isfinite(activation) AND token_idx IS NOT NULL GROUP BY feature_id""")
def path_attributions(spark, d):
    """Difference from a baseline times the mean gradient over the steps of a path."""
    from ..operators import attribution as A

    rows = load(spark, d, "exemplar_ref").filter("token_idx IS NOT NULL AND NOT isnan(activation) AND abs(activation) < double('inf')")
    return rows.groupBy("feature_id").agg(F.round(A.path_attribution(F.col("activation"), F.lit(0.1), F.col("token_idx")), 6).alias("x"))


@query("""SELECT feature_id, count(*) AS n, round(avg(activation), 9) AS mean_gradient, round(avg(token_idx), 9) AS mean_baseline, coalesce(stddev_samp(activation) / nullif(abs(avg(activation)), 0) < 1e-4, false) AS constant
FROM exemplar_ref WHERE isfinite(activation) GROUP BY feature_id""")
def expected_gradients(spark, d):
    """Mean gradient and baseline of each unit, and whether its gradient hardly varies."""
    from ..operators import attribution as A

    rows = load(spark, d, "exemplar_ref").filter("NOT isnan(activation) AND abs(activation) < double('inf')")
    return rows.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("activation"), 9).alias("mean_gradient"), F.round(F.avg("token_idx"), 9).alias("mean_baseline"), A.constancy(F.col("activation")).alias("constant"))


_S = "s AS (SELECT feature_id, token_idx::INTEGER AS token, max(activation) AS score FROM exemplar_ref WHERE token_idx IS NOT NULL AND isfinite(activation) GROUP BY ALL)"


@query(f"""WITH {_S}, w AS (SELECT token, avg(score) AS w FROM s GROUP BY token) SELECT feature_id, round(greatest(sum(score * w), 0), 5) AS cam FROM s JOIN w USING (token) GROUP BY feature_id""")
def class_activation(spark, d):
    """Positive part of the sum over channels of activation times the channel's mean gradient."""
    from ..operators import attribution as A

    s = scores(spark, d)
    w = s.groupBy("token").agg(F.avg("score").alias("w"))
    return s.join(w, "token").groupBy("feature_id").agg(F.round(A.weighted_maps(F.col("score"), F.col("w")), 5).alias("cam"))


_LAYERS = """t AS (SELECT feature_id AS image, (token_idx % 3) AS layer, token_idx % 5 AS dst, (token_idx // 5) % 5 AS src, max(activation) AS w FROM exemplar_ref WHERE token_idx IS NOT NULL AND activation > 0 AND isfinite(activation) GROUP BY ALL),
size AS (SELECT image, max(greatest(dst, src)) + 1 AS n FROM t GROUP BY image), grid AS (SELECT image, l AS layer, i AS dst, j AS src, n FROM size, range(3) a(l), range(n) b(i), range(n) c(j)),
m AS (SELECT g.*, coalesce(w, 0) AS w FROM grid g LEFT JOIN t USING (image, layer, dst, src)),
live AS (SELECT DISTINCT image, layer FROM t)"""


def _attention(spark, d):
    """Attention of three layers and five tokens for each concept: token_idx names layer, row and column."""
    t = F.col("token_idx")
    rows = load(spark, d, "exemplar_ref").filter("token_idx IS NOT NULL AND activation > 0 AND activation < double('inf')")
    return rows.groupBy(F.col("feature_id").alias("image"), (t % 3).alias("layer"), (t % 5).alias("dst"), (F.floor(t / 5) % 5).alias("src")).agg(F.max("activation").alias("w"))


def _unrolled(step):
    """SQL of three matrix products in a row, each layer's matrix given by ``step(layer)``; a layer without rows changes nothing."""
    out = ", r0 AS (SELECT image, dst AS i, src AS j, (dst = src)::INT::DOUBLE AS v FROM grid WHERE layer = 0)"
    for layer in range(3):
        out += f", a{layer} AS ({step(layer)}), p{layer} AS (SELECT a.image, a.i, r.j, sum(a.v * r.v) AS v FROM a{layer} a JOIN r{layer} r ON a.image = r.image AND a.j = r.i GROUP BY ALL)"
        out += f", r{layer + 1} AS (SELECT r.image, r.i, r.j, %s FROM r{layer} r LEFT JOIN p{layer} p USING (image, i, j))"
    return out


_ROLL = _unrolled(lambda k: f"SELECT image, dst AS i, src AS j, (0.5 * w + 0.5 * (dst = src)::INT) / greatest(sum(0.5 * w + 0.5 * (dst = src)::INT) OVER (PARTITION BY image, dst), 1e-12) AS v FROM m WHERE layer = {k} AND (image, layer) IN (SELECT (image, layer) FROM live)").replace("%s", "CASE WHEN p.v IS NULL THEN r.v ELSE p.v END AS v")
_GROW = _unrolled(lambda k: f"SELECT image, dst AS i, src AS j, w AS v FROM m WHERE layer = {k} AND (image, layer) IN (SELECT (image, layer) FROM live)").replace("%s", "r.v + coalesce(p.v, 0) AS v")


@query(f"WITH {_LAYERS}{_ROLL} SELECT image, j AS token, round(v, 6) AS score FROM r3 WHERE i = 0")
def attention_rollout(spark, d):
    """Rollout over three layers: half attention, half identity, rows normalized, layers multiplied."""
    from ..operators import attribution as A

    return A.rollout(_attention(spark, d)).select("image", "token", F.round("score", 6).alias("score"))


@query(f"WITH {_LAYERS}{_GROW} SELECT image, j AS token, round(v / 1000, 4) AS score FROM r3 WHERE i = 0")
def attention_relevance(spark, d):
    """Relevance over three layers: R grows by the positive part of attention times gradient, times R."""
    from ..operators import attribution as A

    rows = _attention(spark, d).withColumn("head", F.lit(0)).withColumn("g", F.lit(1.0))
    return A.relevance(rows).select("image", "token", F.round(F.col("score") / 1000, 4).alias("score"))
