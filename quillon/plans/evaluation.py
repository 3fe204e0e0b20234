"""Evaluation: accuracy, map quality, projection quality, estimators, reports."""

from pyspark.sql import functions as F

from ..operators import dense, quality
from ..session import load
from .joins import _BMU, _KNN, codebook
from .registry import query


@query(_KNN + """, votes AS (SELECT query, own, label, count(*) AS n FROM near GROUP BY ALL), pred AS (SELECT query, own, min_by(label, (-n, label)) AS predicted FROM votes GROUP BY query, own)
SELECT count(*) AS n, round(avg((predicted = own)::INT), 9) AS accuracy FROM pred""")
def knn_accuracy(spark, d):
    """Share of the stated queries whose five nearest rows vote for their label."""
    from .joins import knn_vote

    return knn_vote(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("int")), 9).alias("accuracy"))


@query(_BMU + """, two AS (SELECT vec_id, min(code) FILTER (place = 1) AS c1, min(code) FILTER (place = 2) AS c2, min(d2) FILTER (place = 1) AS d2 FROM bmu GROUP BY vec_id),
g AS (SELECT *, c1 // 6 AS z1, c1 // 3 % 2 AS y1, c1 % 3 AS x1, c2 // 6 AS z2, c2 // 3 % 2 AS y2, c2 % 3 AS x2 FROM two)
SELECT round(avg(sqrt(d2)), 9) AS quantization_error, round(avg(((z1 - z2) * (z1 - z2) + (y1 - y2) * (y1 - y2) + (x1 - x2) * (x1 - x2) > 3)::INT), 9) AS topographic_error, round(1 - count(DISTINCT c1) / 12, 9) AS dead_fraction FROM g""")
def som_quality(spark, d):
    """Quantization and topographic error and dead share on a lattice of 2 x 2 x 3 units."""
    two = dense.nearest(load(spark, d, "embeddings"), "vec_id", "embedding", codebook(spark, d), "code", "centre", k=2)
    c = F.col("code")
    units = spark.range(12).toDF("code").select("code", F.floor(c / 6).alias("z"), (F.floor(c / 3) % 2).alias("y"), (c % 3).alias("x"))
    q = quality.som_quality(two, units)
    return q.select(*[F.round(n, 9).alias(n) for n in q.columns])


@query("""WITH s AS (SELECT vec_id, embedding AS e FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 400), n AS (SELECT count(*) AS n FROM s),
d AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2]))), 9) AS h,
 round(power(a.e[1]::DOUBLE - b.e[1], 2) + power(a.e[2]::DOUBLE - b.e[2], 2), 9) AS l FROM s a JOIN s b ON a.vec_id <> b.vec_id),
r AS (SELECT row_number() OVER (PARTITION BY i ORDER BY h, j) AS rh, row_number() OVER (PARTITION BY i ORDER BY l, j) AS rl FROM d)
SELECT any_value(n) AS n, round(1 - 2.0 / (any_value(n) * 7 * (2 * any_value(n) - 22)) * coalesce(sum(rh - 7) FILTER (rl <= 7 AND rh > 7), 0), 9) AS trustworthiness,
 round(1 - 2.0 / (any_value(n) * 7 * (2 * any_value(n) - 22)) * coalesce(sum(rl - 7) FILTER (rh <= 7 AND rl > 7), 0), 9) AS continuity FROM r, n""")
def manifold_quality(spark, d):
    """Trustworthiness and continuity of the first two dimensions against all."""
    rows = load(spark, d, "embeddings").select("vec_id", "embedding", F.slice("embedding", 1, 2).alias("low"))
    q = quality.trustworthiness(rows, "vec_id", "embedding", "low")
    return q.select("n", F.round("trustworthiness", 9).alias("trustworthiness"), F.round("continuity", 9).alias("continuity"))


@query("""WITH s AS (SELECT vec_id, embedding AS e FROM embeddings), n AS (SELECT count(*) AS n FROM s),
d AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2]))), 9) AS h,
 round(power(a.e[1]::DOUBLE - b.e[1], 2) + power(a.e[2]::DOUBLE - b.e[2], 2), 9) AS l FROM s a JOIN s b ON a.vec_id <> b.vec_id),
r AS (SELECT row_number() OVER (PARTITION BY i ORDER BY h, j) AS rh, row_number() OVER (PARTITION BY i ORDER BY l, j) AS rl FROM d)
SELECT any_value(n) AS n, round(1 - 2.0 / (any_value(n) * 7 * (2 * any_value(n) - 22)) * coalesce(sum(rh - 7) FILTER (rl <= 7 AND rh > 7), 0), 9) AS trustworthiness,
 round(1 - 2.0 / (any_value(n) * 7 * (2 * any_value(n) - 22)) * coalesce(sum(rl - 7) FILTER (rh <= 7 AND rl > 7), 0), 9) AS continuity FROM r, n""")
def manifold_quality_whole(spark, d):
    """Trustworthiness and continuity of the first two dimensions against all, over every row."""
    rows = load(spark, d, "embeddings").select("vec_id", "embedding", F.slice("embedding", 1, 2).alias("low"))
    q = quality.trustworthiness(rows, "vec_id", "embedding", "low", rows=None)
    return q.select("n", F.round("trustworthiness", 9).alias("trustworthiness"), F.round("continuity", 9).alias("continuity"))


@query()
def depth_spectra(spark, d):
    """Spectral centroid of the hits of each depth of each map."""
    n = load(spark, d, "sgp_node").dropDuplicates(["node_id"]).select("bundle_id", F.col("grid.z").alias("z"), F.col("grid.y").alias("y"), F.col("grid.x").alias("x"), "hits").filter("z IS NOT NULL AND y >= 0 AND x >= 0")
    return quality.radial_spectra(n, ["bundle_id", "z"], "y", "x", "hits").select("bundle_id", "z", F.round("centroid", 6).alias("centroid"))


def _vectors(spark, d):
    from pyspark.ml.functions import array_to_vector

    return load(spark, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@query()
def kmeans_codes(spark, d):
    """Cluster of every embedding by seeded k-means."""
    from pyspark.ml.clustering import KMeans

    rows = _vectors(spark, d)
    return KMeans(k=10, seed=7, maxIter=20).fit(rows).transform(rows).select("vec_id", F.col("prediction").alias("code"))


@query()
def pca_coordinates(spark, d):
    """Two principal components of every embedding; signs are those of the solver."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    rows = _vectors(spark, d)
    two = PCA(k=2, inputCol="features", outputCol="p").fit(rows).transform(rows)
    return two.select("vec_id", F.round(vector_to_array("p")[0], 5).alias("x"), F.round(vector_to_array("p")[1], 5).alias("y"))


@query()
def linear_probe(spark, d):
    """Recall by class of a logistic regression fitted and read on the hash split."""
    from pyspark.ml.classification import LogisticRegression

    from ..operators.splitting import hashed

    rows = hashed(_vectors(spark, d), F.col("vec_id"), 0.8, 0.1, 1)
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(rows.filter("split = 'train'"))
    said = model.transform(rows.filter("split <> 'train'"))
    return said.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("int")), 9).alias("recall"))


@query("""WITH p AS (SELECT DISTINCT ON (pack_id) model.arch AS arch, dataset_id, faithfulness.deletion_auc.chefer AS a FROM pack_manifest)
SELECT arch, round(avg(a) FILTER (dataset_id = 'ds01'), 12) AS ds01, round(avg(a) FILTER (dataset_id = 'ds02'), 12) AS ds02, round(avg(a) FILTER (dataset_id = 'ds03'), 12) AS ds03 FROM p WHERE isfinite(a) AND a BETWEEN 0 AND 1 AND arch IS NOT NULL GROUP BY arch""")
def ablation_table(spark, d):
    """Variants by dataset, as a pivot of the long metrics."""
    p = load(spark, d, "pack_manifest").select("pack_id", F.col("model.arch").alias("arch"), "dataset_id", F.col("faithfulness.deletion_auc.chefer").alias("a")).dropDuplicates(["pack_id"])
    p = p.filter("arch IS NOT NULL AND NOT isnan(a) AND a BETWEEN 0 AND 1")
    return p.groupBy("arch").pivot("dataset_id", ["ds01", "ds02", "ds03"]).agg(F.round(F.avg("a"), 12))


@query("""WITH p AS (SELECT DISTINCT ON (pack_id) * FROM pack_manifest), m AS (SELECT count(*) AS n, avg(prediction.confidence) FILTER (prediction.confidence BETWEEN 0 AND 1) AS c, avg(faithfulness.deletion_auc.chefer) FILTER (faithfulness.deletion_auc.chefer BETWEEN 0 AND 1) AS a, avg(timings.predict_ms) FILTER (timings.predict_ms > 0 AND isfinite(timings.predict_ms)) AS t FROM p)
SELECT n, printf('%.4f', c) AS confidence, printf('%.4f', a) AS chefer, printf('%.4f', t) AS predict_ms, 'n/a' AS missing FROM m""")
def evaluation_report(spark, d):
    """One row of rendered metrics, n/a for what there is not."""
    from ..functions.scalars import formatted

    p = load(spark, d, "pack_manifest").dropDuplicates(["pack_id"])
    c, a, t = F.col("prediction.confidence"), F.col("faithfulness.deletion_auc.chefer"), F.col("timings.predict_ms")
    m = p.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when((c >= 0) & (c <= 1), c)).alias("c"), F.avg(F.when((a >= 0) & (a <= 1), a)).alias("a"), F.avg(F.when((t > 0) & (t < float("inf")), t)).alias("t"))
    return m.select("n", formatted(F.col("c")).alias("confidence"), formatted(F.col("a")).alias("chefer"), formatted(F.col("t")).alias("predict_ms"), formatted(F.lit(None).cast("double")).alias("missing"))
