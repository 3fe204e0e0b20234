"""Attribution, attention and map-training queries."""

from pyspark.sql import functions as F

from ..operators import attribution as A
from ..operators import som
from ..session import load
from .joins import codebook
from .registry import query

_S = "s AS (SELECT feature_id, token_idx::INTEGER AS token, max(activation) AS score FROM exemplar_ref WHERE token_idx IS NOT NULL AND isfinite(activation) GROUP BY ALL)"


def scores(spark, d):
    rows = load(spark, d, "exemplar_ref").filter("token_idx IS NOT NULL AND NOT isnan(activation) AND abs(activation) < double('inf')")
    return rows.groupBy("feature_id", F.col("token_idx").alias("token")).agg(F.max("activation").alias("score"))


@query(f"""WITH {_S}, p AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY score DESC, token) - 1 AS p, count(*) OVER (PARTITION BY feature_id) AS n FROM s)
SELECT feature_id, token, (CASE WHEN p < (n % 5) * (n // 5 + 1) THEN p // (n // 5 + 1) ELSE n % 5 + (p - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END)::INTEGER AS step FROM p""")
def masking_order(spark, d):
    """Tokens of each concept by importance in five near-equal runs."""
    return A.masking_steps(scores(spark, d), "feature_id", "token", "score", 5).select("feature_id", "token", "step")


@query(f"""WITH {_S}, g AS (SELECT *, min(score) OVER (PARTITION BY feature_id) AS lo, max(score) OVER (PARTITION BY feature_id) AS hi FROM s WHERE token > 0)
SELECT feature_id, (token - 1) // 14 AS row_no, (token - 1) % 14 AS col_no, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END, 9) AS v FROM g""")
def attribution_grid(spark, d):
    """Scores on the patch grid, class token left out, scaled to the range of each concept."""
    from ..functions import scalars as S
    from ..functions import vectors as V

    s = scores(spark, d).filter("token > 0")
    bounds = s.groupBy("feature_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    t = F.col("token")
    return s.join(bounds, "feature_id").select("feature_id", S.token_row(t).alias("row_no"), S.token_col(t).alias("col_no"), F.round(V.unit_range(F.col("score"), F.col("lo"), F.col("hi")), 9).alias("v"))


@query(f"""WITH {_S}, m AS (SELECT sum(score * x) / sum(score) AS cx, sum(score * y) / sum(score) AS cy, feature_id, count(*) AS n FROM (SELECT *, ((token - 1) % 14 + 0.5) / 14 AS x, ((token - 1) // 14 + 0.5) / 14 AS y FROM s WHERE token > 0 AND score > 0) GROUP BY feature_id)
SELECT feature_id, n, round(cx, 9) AS cx, round(cy, 9) AS cy FROM m""")
def attention_displacement(spark, d):
    """Attention-weighted mean place of each concept's tokens."""
    from ..functions import scalars as S

    s = scores(spark, d).filter("token > 0 AND score > 0").withColumn("c", S.patch_centre(F.col("token")))
    mean = lambda axis: F.round(F.sum(F.col("score") * F.col(f"c.{axis}")) / F.sum("score"), 9)
    return s.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), mean("x").alias("cx"), mean("y").alias("cy"))


@query("""SELECT feature_id, count(*) AS n, round(avg((activation > 0)::INT), 9) AS active, round(avg(greatest(activation, 0)), 9) AS mean_positive FROM exemplar_ref WHERE isfinite(activation) GROUP BY feature_id""")
def code_diagnostics(spark, d):
    """Share of active codes and mean positive activation of each feature."""
    rows = load(spark, d, "exemplar_ref").filter("NOT isnan(activation) AND abs(activation) < double('inf')")
    return rows.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("activation") > 0).cast("int")), 9).alias("active"), F.round(F.avg(F.greatest("activation", F.lit(0.0))), 9).alias("mean_positive"))


@query("""SELECT bundle_id, grid.y // 2 AS by, grid.x // 2 AS bx, round(avg(umatrix), 12) AS mean FROM (SELECT DISTINCT ON (node_id) * FROM sgp_node) WHERE grid.y IS NOT NULL AND grid.x IS NOT NULL GROUP BY ALL""")
def block_means(spark, d):
    """Mean over blocks of two by two cells."""
    n = load(spark, d, "sgp_node").dropDuplicates(["node_id"]).filter("grid.y IS NOT NULL AND grid.x IS NOT NULL")
    half = lambda c: F.floor(F.col(f"grid.{c}") / 2).cast("int")
    return n.groupBy("bundle_id", half("y").alias("by"), half("x").alias("bx")).agg(F.round(F.avg("umatrix"), 12).alias("mean"))


@query("""WITH n AS (SELECT DISTINCT ON (node_id) node_id, bundle_id, sqrt(power(grid.y - 2.2, 2) + power(grid.x - 3.1, 2)) AS r FROM sgp_node WHERE grid.y IS NOT NULL AND grid.x IS NOT NULL)
SELECT bundle_id, coalesce(min_by(node_id, (round(r, 9), node_id)) FILTER (r < 1.5), -1) AS picked FROM n GROUP BY bundle_id""")
def nearest_pick(spark, d):
    """The node nearest to a point within reach, -1 for none."""
    n = load(spark, d, "sgp_node").select("node_id", "bundle_id", "grid").dropDuplicates(["node_id"]).filter("grid.y IS NOT NULL AND grid.x IS NOT NULL")
    r = F.sqrt(F.pow(F.col("grid.y") - 2.2, 2) + F.pow(F.col("grid.x") - 3.1, 2))
    n = n.withColumn("r", r).withColumn("order", F.when(F.col("r") < 1.5, F.struct(F.round("r", 9), F.col("node_id"))))
    return n.groupBy("bundle_id").agg(F.coalesce(F.min_by("node_id", "order"), F.lit(-1)).alias("picked"))


@query()
def som_fit(spark, d):
    """Units of a small map after four batch steps from the label means."""
    c = F.col("code")
    units = codebook(spark, d).select(c.cast("bigint").alias("code"), F.floor(c / 6).alias("z"), (F.floor(c / 3) % 2).alias("y"), (c % 3).alias("x"), F.col("centre").alias("w"))
    fitted = som.fit(load(spark, d, "embeddings"), "vec_id", "embedding", units, 64)
    return fitted.select("code", "z", "y", "x", F.round(F.get("w", F.lit(0)), 6).alias("w0"))
