"""Vector operators: norms, projections, quantization, soft similarity, axis with off-axis flag."""

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import axis as A
from ..operators import dense
from ..operators.cumulative import exact_percentiles
from ..session import load
from .joins import codebook
from .registry import query

_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
_LONG = "l AS (SELECT vec_id, label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v)"


@query(f"WITH {_V} SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS length FROM v")
def vector_norms(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("length"))


@query(f"""WITH {_V}, {_LONG}, s AS (SELECT i, avg(x) AS m, stddev_samp(x) AS sd FROM l GROUP BY i)
SELECT vec_id, round(sum(abs((x - m) / (sd + 1e-6))), 5) AS spread FROM l JOIN s USING (i) GROUP BY vec_id""")
def standardized(spark, d):
    """Z-scores by the sample deviation of each dimension; the row's total size of them."""
    rows = load(spark, d, "embeddings")
    stats = rows.agg(*[F.avg(F.get(F.col("embedding"), F.lit(i)).cast("double")).alias(f"m{i}") for i in range(64)], *[F.stddev_samp(F.get(F.col("embedding"), F.lit(i)).cast("double")).alias(f"s{i}") for i in range(64)])
    one = stats.select(F.array(*[f"m{i}" for i in range(64)]).alias("m"), F.array(*[f"s{i}" for i in range(64)]).alias("s"))
    z = F.zip_with(F.zip_with("embedding", "m", lambda x, m: x.cast("double") - m), "s", lambda x, s: F.abs(x / (s + 1e-6)))
    return rows.join(F.broadcast(one)).select("vec_id", F.round(V.total(z), 5).alias("spread"))


_AXIS = f"""WITH {_V}, {_LONG}, c AS (SELECT i, avg(x) FILTER (label < 3) AS m, avg(x) FILTER (label >= 3) AS b FROM l GROUP BY i),
n AS (SELECT sqrt(sum((m - b) * (m - b))) AS n FROM c), u AS (SELECT i, b, (m - b) / n AS u FROM c, n),
p AS (SELECT vec_id, any_value(label) AS label, sum(x * u) AS proj, sum((x - b) * u) AS along, sum((x - b) * (x - b)) AS d2 FROM l JOIN u USING (i) GROUP BY vec_id),
r AS (SELECT *, sqrt(greatest(d2 - along * along, 0)) AS residual FROM p),
a AS (SELECT quantile_cont(proj, 0.05) FILTER (label >= 3) AS lo, quantile_cont(proj, 0.95) FILTER (label < 3) AS hi, quantile_cont(residual, 0.95) AS thr, min(proj) AS pmin, max(proj) AS pmax FROM r),
anchors AS (SELECT CASE WHEN hi <= lo THEN pmin ELSE lo END AS lo, CASE WHEN hi <= lo THEN pmax + 1e-9 ELSE hi END AS hi, thr FROM a)"""


@query(_AXIS + " SELECT vec_id, round(greatest(0, least(1, (proj - lo) / (hi - lo))), 6) AS position, round(residual, 6) AS residual, residual > thr + 1e-9 AS ood FROM r, anchors")
def axis_projection(spark, d):
    """Position on the axis between the centroids of two groups, and whether it lies too far off."""
    rows = load(spark, d, "embeddings")
    axis = A.build(rows, "embedding", F.col("label") < 3, 64)
    return A.project(rows, "embedding", axis).select("vec_id", F.round("position", 6).alias("position"), F.round("residual", 6).alias("residual"), "ood")


@query(_AXIS + " SELECT round(lo, 6) AS anchor_lo, round(hi, 6) AS anchor_hi, round(thr, 6) AS residual_threshold FROM anchors")
def axis_build(spark, d):
    axis = A.build(load(spark, d, "embeddings"), "embedding", F.col("label") < 3, 64)
    return spark.createDataFrame([(round(axis["anchor_lo"], 6), round(axis["anchor_hi"], 6), round(axis["residual_threshold"], 6))], "anchor_lo double, anchor_hi double, residual_threshold double")


_Q = "q AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, CASE WHEN list_max(embedding) > 0 THEN list_max(embedding)::DOUBLE ELSE 1.0 END AS s FROM embeddings), z AS (SELECT vec_id, e, s, list_transform(e, lambda x: greatest(0, least(255, round_even(x / s * 255, 0)))::INTEGER) AS q FROM q)"


@query(f"WITH {_Q} SELECT vec_id, list_sum(q)::BIGINT AS total, round(s, 6) AS scale FROM z")
def quantize_rows(spark, d):
    q = load(spark, d, "embeddings").select("vec_id", V.quantized(F.col("embedding")).alias("z"))
    return q.select("vec_id", F.aggregate("z.q", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.round("z.scale", 6).alias("scale"))


@query(f"WITH {_Q} SELECT vec_id, round(list_max(list_transform(list_zip(e, q), lambda p: CASE WHEN p[1] >= 0 THEN abs(p[1] - p[2] / 255.0 * s) ELSE 0 END)) / s, 6) AS error FROM z")
def dequantize_error(spark, d):
    """Largest error of a value that is not negative, over the row's scale: at most 0.5 / 255."""
    z = load(spark, d, "embeddings").select("vec_id", "embedding", V.quantized(F.col("embedding")).alias("z"))
    back = V.dequantized(F.col("z.q"), F.col("z.scale"))
    error = F.zip_with("embedding", back, lambda x, y: F.when(x >= 0, F.abs(x.cast("double") - y)).otherwise(0.0))
    return z.select("vec_id", F.round(F.array_max(error) / F.col("z.scale"), 6).alias("error"))


@query("""WITH b AS (SELECT l_orderkey * 7 + l_linenumber AS id, ((l_orderkey * 2654435761 + l_linenumber * 40503) % 65536)::BIGINT AS h FROM lineitem), p AS (SELECT h, h >> 15 AS s, (h >> 10) & 31 AS e, h & 1023 AS m FROM (SELECT DISTINCT h FROM b))
SELECT h, round(CASE WHEN s = 1 THEN -1 ELSE 1 END * CASE WHEN e = 0 THEN m * power(2.0, -24) ELSE power(2.0, e - 15.0) * (1 + m / 1024.0) END, 9) AS v FROM p WHERE e < 31""")
def half_decode(spark, d):
    """Half-precision bit patterns to numbers."""
    h = F.pmod(F.col("l_orderkey") * 2654435761 + F.col("l_linenumber") * 40503, F.lit(65536)).cast("int")
    bits = load(spark, d, "lineitem").select(h.alias("h")).distinct().filter(F.shiftright("h", 10).bitwiseAND(31) < 31)
    return bits.select(F.col("h").cast("bigint").alias("h"), F.round(V.half_to_float(F.col("h")), 9).alias("v"))


_SOFT = """WITH book AS (SELECT label AS code, list(m ORDER BY i) AS w FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
dist AS (SELECT e.vec_id, b.code, list_sum(list_transform(list_zip(e.embedding, b.w), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2]))) AS d2 FROM embeddings e, book b), m AS (SELECT median(d2) AS m FROM dist),
x AS (SELECT vec_id, code, exp(-d2 / (0.5 * (m + 1e-6))) AS x FROM dist, m)"""


@query(_SOFT + " SELECT vec_id, code, round(x / sum(x) OVER (PARTITION BY vec_id), 6) AS weight FROM x")
def soft_similarity(spark, d):
    """Softmax of -d2 over the temperature times the median of all distances: two passes."""
    near = dense.nearest(load(spark, d, "embeddings"), "vec_id", "embedding", codebook(spark, d), "code", "centre", k=None)
    middle = exact_percentiles(near, [], "d2", (0.5,)).select(F.col("p50").alias("m"))
    raised = near.join(F.broadcast(middle)).select("vec_id", "code", F.exp(-F.col("d2") / (0.5 * (F.col("m") + 1e-6))).alias("x"))
    total = raised.groupBy("vec_id").agg(F.sum("x").alias("t"))
    return raised.join(total, "vec_id").select("vec_id", F.col("code").cast("int").alias("code"), F.round(F.col("x") / F.col("t"), 6).alias("weight"))


@query(f"WITH {_V} SELECT vec_id, round(list_max(e) - list_min(e), 6) AS span, round(e[1] * 0.6 + e[2] * 0.8, 6) AS along FROM v")
def basis_projection(spark, d):
    """Dot product with a direction, and the span of the values."""
    e = F.col("embedding")
    direction = F.array(F.lit(0.6), F.lit(0.8))
    return load(spark, d, "embeddings").select("vec_id", F.round(F.array_max(e).cast("double") - F.array_min(e).cast("double"), 6).alias("span"), F.round(V.dot(F.slice(e, 1, 2), direction), 6).alias("along"))


@query("""WITH n AS (SELECT DISTINCT ON (node_id) node_id, list_transform(weight, lambda x: x::DOUBLE) AS w FROM sgp_node WHERE len(weight) = 64)
SELECT node_id, round(list_sum(list_transform(range(1, 64), lambda i: (w[i + 1] - w[i]) * (w[i + 1] - w[i]))) / 63, 6) AS variation FROM n WHERE len(list_filter(w, lambda x: x IS NULL OR NOT isfinite(x))) = 0""")
def total_variation(spark, d):
    """Mean squared first difference along a vector."""
    w = F.col("weight")
    n = load(spark, d, "sgp_node").select("node_id", "weight").dropDuplicates(["node_id"]).filter(F.size(w) == 64)
    n = n.filter(~F.exists(w, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return n.select("node_id", F.round(V.squared_distance(F.slice(w, 2, 63), F.slice(w, 1, 63)) / 63, 6).alias("variation"))


@query("""SELECT pack_id, round(-ln(exp(p / 0.5) / t), 6) AS loss FROM (SELECT pack_id, list_max(q) AS p, list_sum(list_transform(q, lambda x: exp(x / 0.5))) AS t FROM (
SELECT DISTINCT ON (pack_id) pack_id, list_transform(prediction.probabilities, lambda x: x::DOUBLE) AS q FROM pack_manifest WHERE len(prediction.probabilities) > 0)) WHERE isfinite(p) AND isfinite(t)""")
def contrastive_loss(spark, d):
    """Cross-entropy of the largest of a row's similarities at a temperature of one half."""
    q = load(spark, d, "pack_manifest").select("pack_id", F.col("prediction.probabilities").alias("q")).filter(F.size("q") > 0).dropDuplicates(["pack_id"])
    x = q.select("pack_id", F.array_max("q").cast("double").alias("p"), V.total(F.transform("q", lambda x: F.exp(x.cast("double") / 0.5))).alias("t"))
    fine = x.filter(~F.isnan("p") & ~F.isnan("t") & (F.abs("t") < float("inf")) & (F.abs("p") < float("inf")))
    return fine.select("pack_id", F.round(-F.log(F.exp(F.col("p") / 0.5) / F.col("t")), 6).alias("loss"))


@query("""SELECT event_id, round(20.0 * power(0.5 / 20.0, event_id / 10000.0), 6) AS sigma, round(CASE WHEN event_id < 500 THEN event_id / 500.0 ELSE 0.5 * (1 + cos(pi() * least(1, (event_id - 500) / 9500.0))) END, 6) AS rate FROM events""")
def annealing(spark, d):
    """Neighbourhood width by geometric decay, and a learning rate with warm-up and cosine."""
    s = F.col("event_id")
    rate = F.when(s < 500, s / 500.0).otherwise(0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(F.lit(1.0), (s - 500) / 9500.0))))
    return load(spark, d, "events").select("event_id", F.round(20.0 * F.pow(F.lit(0.5 / 20.0), s / 10000.0), 6).alias("sigma"), F.round(rate, 6).alias("rate"))


@query(f"""WITH {_V}, f AS (SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (e[i] - 0.1) * (i / 64.0))), 5) AS phi FROM v) SELECT * FROM f""")
def contributions(spark, d):
    """Additive contributions weight * (value - baseline), summed."""
    parts = F.transform("embedding", lambda x, i: (x.cast("double") - 0.1) * ((i + 1) / 64.0))
    return load(spark, d, "embeddings").select("vec_id", F.round(V.total(parts), 5).alias("phi"))
