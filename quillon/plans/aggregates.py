"""Aggregations: firing rates, coherence, gates, affinities, effect sizes, taxonomy readouts."""

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import concepts as C
from ..session import load
from .registry import query

_REFS = "refs AS (SELECT DISTINCT feature_id, image_id, token_idx, activation, class_label FROM exemplar_ref WHERE isfinite(activation))"


def refs(spark, d):
    rows = load(spark, d, "exemplar_ref").select("feature_id", "image_id", "token_idx", "activation", "class_label")
    return rows.filter(~F.isnan("activation") & (F.abs("activation") < float("inf"))).distinct()


@query(f"""WITH {_REFS}, f AS (SELECT DISTINCT feature_id FROM refs), c AS (SELECT DISTINCT class_label FROM refs WHERE class_label >= 0),
r AS (SELECT feature_id, class_label, avg((activation > 0)::INT) AS rate FROM refs WHERE class_label >= 0 GROUP BY ALL)
SELECT feature_id, class_label, round(coalesce(rate, 0), 9) AS rate FROM f CROSS JOIN c LEFT JOIN r USING (feature_id, class_label)""")
def firing_rates(spark, d):
    """Share of active tokens by feature and class, over the whole grid of classes."""
    return C.firing_rates(refs(spark, d), "feature_id", "class_label", "activation").select("feature_id", "class_label", F.round("rate", 9).alias("rate"))


@query("""WITH e AS (SELECT feature_id, unnest(exemplars, recursive := true) FROM concept_feature), n AS (
SELECT feature_id, class_label, count(*) AS n FROM e WHERE class_label IS NOT NULL GROUP BY ALL)
SELECT feature_id, round(max(n) / sum(n), 9) AS coherence FROM n GROUP BY feature_id""")
def exemplar_coherence(spark, d):
    e = load(spark, d, "concept_feature").select("feature_id", F.explode("exemplars").alias("e")).select("feature_id", "e.class_label").filter("class_label IS NOT NULL")
    return C.coherence(e, "feature_id", "class_label").select("feature_id", F.round("coherence", 9).alias("coherence"))


@query("""WITH t AS (SELECT feature_id, coherence, exemplars FROM concept_feature WHERE len(exemplars) > 0)
SELECT count(*) AS live, round(avg(coalesce(coherence, 0)), 9) AS coherence,
 round(1 - count(DISTINCT (exemplars[1].image_id, exemplars[1].token_idx)) / count(*), 9) AS duplicate_rate FROM t""")
def quality_gate(spark, d):
    """Live features, their mean coherence, and the share that repeats another's first exemplar."""
    return C.quality_gate(load(spark, d, "concept_feature")).select("live", F.round("coherence", 9).alias("coherence"), F.round("duplicate_rate", 9).alias("duplicate_rate"))


@query("""WITH e AS (SELECT feature_id, unnest(exemplars, recursive := true) FROM concept_feature)
SELECT feature_id, round(sum(activation), 9) AS strength, count(*) AS n FROM e WHERE token_idx > 0 AND isfinite(activation) GROUP BY feature_id""")
def feature_strength(spark, d):
    """Summed activation and count of each feature, class token left out."""
    e = load(spark, d, "concept_feature").select("feature_id", F.explode("exemplars").alias("e")).select("feature_id", "e.*")
    e = e.filter((F.col("token_idx") > 0) & ~F.isnan("activation") & (F.abs("activation") < float("inf")))
    return e.groupBy("feature_id").agg(F.round(F.sum("activation"), 9).alias("strength"), F.count(F.lit(1)).alias("n"))


_UNIT = """vals AS (SELECT l_suppkey AS unit, l_returnflag AS class, l_orderkey AS id, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
normed AS (SELECT *, q / (sqrt(sum(q * q) OVER (PARTITION BY id)) + 1e-8) AS a FROM vals)"""


def activations(spark, d):
    return C.normalized(load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("class")).agg(F.sum("l_quantity").alias("q")), "id", "q", "a")


@query(f"WITH {_UNIT}, n AS (SELECT class, count(DISTINCT id) AS n FROM normed GROUP BY class) SELECT unit, class, round(sum(a) / any_value(n), 9) AS affinity FROM normed JOIN n USING (class) GROUP BY ALL")
def class_affinity(spark, d):
    """Mean normalized activation of each unit by class."""
    return C.class_affinity(activations(spark, d), "id", "unit", "class", "a").select("unit", "class", F.round("affinity", 9).alias("affinity"))


@query(f"""WITH {_UNIT}, n AS (SELECT class, count(DISTINCT id) AS n FROM normed GROUP BY class), af AS (SELECT unit, class, sum(a) / any_value(n) AS x FROM normed JOIN n USING (class) GROUP BY ALL)
SELECT unit, class, round(x / max(x) OVER (PARTITION BY class), 9) AS fingerprint FROM af""")
def class_fingerprints(spark, d):
    """Affinity over the class's largest."""
    x = C.class_affinity(activations(spark, d), "id", "unit", "class", "a")
    top = x.groupBy("class").agg(F.max("affinity").alias("top"))
    return x.join(top, "class").select("unit", "class", F.round(F.col("affinity") / F.nullif(F.col("top"), F.lit(0.0)), 9).alias("fingerprint"))


_PAIRS = f"""WITH {_UNIT}, u AS (SELECT id, unit, sum(q) AS q FROM vals GROUP BY ALL), h AS (SELECT id, unit, q / (sqrt(sum(q * q) OVER (PARTITION BY id)) + 1e-8) AS a FROM u),
total AS (SELECT count(DISTINCT id) AS n FROM h), co AS (SELECT x.unit AS i, y.unit AS j, sum(x.a * y.a) / (SELECT n FROM total) AS c FROM h x JOIN h y ON x.id = y.id AND x.unit <= y.unit GROUP BY ALL)"""


def coactivations(spark, d):
    q = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("unit")).agg(F.sum("l_quantity").alias("q"))
    return C.coactivation(C.normalized(q, "id", "q", "a"), "id", "unit", "a")


@query(_PAIRS + " SELECT i, j, round(c, 8) AS c FROM co")
def coactivation_matrix(spark, d):
    """Upper triangle of the mean outer product of normalized activations."""
    return coactivations(spark, d).select("i", "j", F.round("c", 8).alias("c"))


@query(_PAIRS + """ SELECT p.i, p.j, round(p.c / sqrt(greatest(a.c, 1e-12)) / sqrt(greatest(b.c, 1e-12)), 9) AS r FROM co p JOIN co a ON a.i = p.i AND a.j = p.i JOIN co b ON b.i = p.j AND b.j = p.j""")
def coactivation_correlation(spark, d):
    """Co-activation over the roots of the diagonal."""
    return C.correlation(coactivations(spark, d)).select("i", "j", F.round("r", 9).alias("r"))


@query(_PAIRS + " SELECT i, j, round(c, 8) AS c FROM co WHERE i < j AND c > 0 ORDER BY round(c, 8) DESC, i, j LIMIT 50")
def strongest_pairs(spark, d):
    """The fifty strongest pairs of different units."""
    return coactivations(spark, d).filter("i < j AND c > 0").select("i", "j", F.round("c", 8).alias("c")).orderBy(F.desc("c"), "i", "j").limit(50)


@query("SELECT l_suppkey AS concept, l_returnflag AS class, round(avg(l_discount), 9) AS score FROM lineitem GROUP BY ALL")
def concept_scores(spark, d):
    """Mean of the member units of each concept by class."""
    return load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("concept"), F.col("l_returnflag").alias("class")).agg(F.round(F.avg("l_discount"), 9).alias("score"))


@query("""SELECT o_orderpriority AS attribute, round((avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus <> 'F')) / (stddev_samp(o_totalprice) + 1e-8), 9) AS effect
FROM orders GROUP BY o_orderpriority HAVING count(*) FILTER (o_orderstatus = 'F') >= 5 AND count(*) FILTER (o_orderstatus <> 'F') >= 5""")
def effect_size(spark, d):
    """Standardized difference of means, where both sides have five rows."""
    return C.effect_size(load(spark, d, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F", "o_totalprice").select(F.col("o_orderpriority").alias("attribute"), F.round("effect", 9).alias("effect"))


@query("""WITH c AS (SELECT l_suppkey, l_returnflag AS cls, avg(l_quantity) AS w FROM lineitem GROUP BY ALL), p AS (SELECT l_returnflag AS cls, l_linestatus AS attr, avg(l_discount * 100) AS v FROM lineitem GROUP BY ALL),
m AS (SELECT attr, avg(v) AS mean FROM p GROUP BY attr)
SELECT l_suppkey, attr, round(sum(w * v) / sum(w) - any_value(mean), 9) AS lift FROM c JOIN p USING (cls) JOIN m USING (attr) GROUP BY ALL HAVING sum(w * v) / sum(w) - any_value(mean) > 0""")
def attribute_lift(spark, d):
    """Affinity-weighted class attributes over their mean; positive lifts only."""
    lines = load(spark, d, "lineitem")
    weights = lines.groupBy("l_suppkey", F.col("l_returnflag").alias("cls")).agg(F.avg("l_quantity").alias("w"))
    profile = lines.groupBy(F.col("l_returnflag").alias("cls"), F.col("l_linestatus").alias("attr")).agg(F.avg(F.col("l_discount") * 100).alias("v"))
    return C.attribute_lift(weights, profile, "l_suppkey").select("l_suppkey", "attr", F.round("lift", 9).alias("lift"))


_P = "p AS (SELECT DISTINCT lens_id, list_transform(probabilities, lambda x: x::DOUBLE) AS p FROM lens_lesion WHERE len(probabilities) = 7)"


def probabilities(spark, d):
    return load(spark, d, "lens_lesion").filter(F.size("probabilities") == 7).select("lens_id", "probabilities").distinct().select("lens_id", F.transform("probabilities", lambda x: x.cast("double")).alias("p"))


@query(f"WITH {_P} SELECT lens_id, round(least(1, greatest(0, coalesce(p[1], 0) + coalesce(p[2], 0) + coalesce(p[5], 0))), 9) AS malignant FROM p")
def flagged_probability(spark, d):
    """Probability mass of the flagged classes, within [0, 1]."""
    return probabilities(spark, d).select("lens_id", F.round(C.flagged_mass(F.col("p"), (0, 1, 4)), 9).alias("malignant"))


@query(f"""WITH {_P}, s AS (SELECT lens_id, list_sum(p) AS t, list_sum(list_transform(list_zip(p, [1, 2, 0, 0, 2, 0, 1]), lambda z: z[1] * z[2])) AS e FROM p)
SELECT lens_id, round(CASE WHEN t > 0 THEN e / t ELSE 0 END, 9) AS expected FROM s""")
def expected_level(spark, d):
    return probabilities(spark, d).select("lens_id", F.round(C.expected_level(F.col("p"), (1, 2, 0, 0, 2, 0, 1)), 9).alias("expected"))


@query(f"WITH {_P} SELECT lens_id, [1, 2, 0, 0, 2, 0, 1][list_position(p, list_max(p))] AS level FROM p WHERE list_max(p) IS NOT NULL")
def hard_level(spark, d):
    levels = F.array(*[F.lit(x) for x in (1, 2, 0, 0, 2, 0, 1)])
    p = F.col("p")
    return probabilities(spark, d).filter(F.array_max(p).isNotNull()).select("lens_id", F.element_at(levels, V.argmax(p) + 1).alias("level"))


@query("""SELECT dataset_id, round(sum(prediction.confidence * image.width) / sum(image.width), 9) AS confidence, count(*) FILTER (prediction.confidence > 0.5) AS n_sure, count(*) AS n
FROM (SELECT DISTINCT ON (pack_id) * FROM pack_manifest) WHERE prediction.confidence BETWEEN 0 AND 1 AND image.width > 0 GROUP BY dataset_id""")
def weighted_rollup(spark, d):
    """Size-weighted mean, count of hits and total."""
    packs = load(spark, d, "pack_manifest").select("pack_id", "dataset_id", F.col("prediction.confidence").alias("c"), F.col("image.width").alias("w")).dropDuplicates(["pack_id"])
    packs = packs.filter("c BETWEEN 0 AND 1 AND w > 0")
    return packs.groupBy("dataset_id").agg(F.round(F.sum(F.col("c") * F.col("w")) / F.sum("w"), 9).alias("confidence"), F.count(F.when(F.col("c") > 0.5, 1)).alias("n_sure"), F.count(F.lit(1)).alias("n"))


@query("SELECT run_id, count(DISTINCT image.id) AS n_images, count(DISTINCT dataset_id) AS n_datasets FROM pack_manifest GROUP BY run_id")
def distinct_counts(spark, d):
    return load(spark, d, "pack_manifest").groupBy("run_id").agg(F.countDistinct("image.id").alias("n_images"), F.countDistinct("dataset_id").alias("n_datasets"))


@query("""SELECT bundle_id, round(coalesce(avg(umatrix) FILTER (NOT dead), 0), 12) AS mean_live, min(umatrix) AS low, max(umatrix) AS high
FROM (SELECT DISTINCT ON (node_id) * FROM sgp_node) GROUP BY bundle_id""")
def bounds_and_means(spark, d):
    """Extrema, and the mean over the living members with 0 for none."""
    nodes = load(spark, d, "sgp_node").dropDuplicates(["node_id"])
    return nodes.groupBy("bundle_id").agg(F.round(F.coalesce(F.avg(F.when(~F.col("dead"), F.col("umatrix"))), F.lit(0.0)), 12).alias("mean_live"), F.min("umatrix").alias("low"), F.max("umatrix").alias("high"))


@query("""SELECT prediction.label AS label, round(avg((prediction.confidence > 0.5)::INT), 9) AS recall, count(*) AS n FROM (SELECT DISTINCT ON (pack_id) * FROM pack_manifest) WHERE isfinite(prediction.confidence) GROUP BY ALL""")
def per_class_accuracy(spark, d):
    packs = load(spark, d, "pack_manifest").select("pack_id", F.col("prediction.label").alias("label"), F.col("prediction.confidence").alias("c")).dropDuplicates(["pack_id"])
    packs = packs.filter(~F.isnan("c") & (F.abs("c") < float("inf")))
    return packs.groupBy("label").agg(F.round(F.avg((F.col("c") > 0.5).cast("int")), 9).alias("recall"), F.count(F.lit(1)).alias("n"))
