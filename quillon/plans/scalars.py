"""Scalar functions."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vectors as V
from ..session import load
from .registry import query

_T = "t AS (SELECT DISTINCT token_idx AS i FROM exemplar_ref WHERE token_idx >= 0)"


def tokens(spark, d):
    return load(spark, d, "exemplar_ref").select(F.col("token_idx").alias("i")).filter("i >= 0").distinct()


@query(f"""WITH {_T} SELECT i::INTEGER AS i, 'L3_T' || i::INTEGER AS node, CASE WHEN i > 0 THEN (i::INTEGER - 1) // 14 ELSE -1 END AS row_no, CASE WHEN i > 0 THEN (i::INTEGER - 1) % 14 ELSE -1 END AS col_no,
 round(CASE WHEN i > 0 THEN ((i::INTEGER - 1) % 14 + 0.5) / 14 ELSE 0 END, 6) AS x, round(CASE WHEN i > 0 THEN ((i::INTEGER - 1) // 14 + 0.5) / 14 ELSE 0 END, 6) AS y FROM t""")
def token_geometry(spark, d):
    i = F.col("i")
    c = S.patch_centre(i)
    return tokens(spark, d).select(i, S.node_id(F.lit(3), i).alias("node"), F.coalesce(S.token_row(i), F.lit(-1)).alias("row_no"), F.coalesce(S.token_col(i), F.lit(-1)).alias("col_no"), F.round(c["x"], 6).alias("x"), F.round(c["y"], 6).alias("y"))


@query(f"""WITH {_T} SELECT i::INTEGER AS i, 3 AS layer, i::INTEGER AS token FROM t""")
def node_id_round_trip(spark, d):
    i = F.col("i")
    parsed = S.parse_node_id(S.node_id(F.lit(3), i))
    return tokens(spark, d).select(i, parsed["layer"].alias("layer"), parsed["token"].alias("token"))


@query("SELECT c_custkey, replace(replace(regexp_replace('has_' || c_mktsegment || '::part_' || c_nationkey, '^has_', ''), '::', ': '), '_', ' ') AS pretty FROM customer")
def pretty_names(spark, d):
    raw = F.concat(F.lit("has_"), "c_mktsegment", F.lit("::part_"), F.col("c_nationkey").cast("string"))
    return load(spark, d, "customer").select("c_custkey", S.pretty_attribute(raw).alias("pretty"))


_DX = {"nv": "melanocytic nevus", "mel": "melanoma", "bkl": "benign keratosis"}


@query("SELECT row_id, CASE k WHEN 'nv' THEN 'melanocytic nevus' WHEN 'mel' THEN 'melanoma' WHEN 'bkl' THEN 'benign keratosis' ELSE upper(k[1]) || k[2:] END AS pretty FROM (SELECT row_id, lower(trim(dx)) AS k FROM image_metadata WHERE dx IS NOT NULL)")
def pretty_codes(spark, d):
    key = F.lower(F.trim("dx"))
    named = F.create_map(*[F.lit(x) for kv in _DX.items() for x in kv])
    return load(spark, d, "image_metadata").filter("dx IS NOT NULL").select("row_id", F.coalesce(F.try_element_at(named, key), F.initcap(key)).alias("pretty"))


@query("SELECT o_orderkey, (('0x' || substr(md5(o_orderkey::VARCHAR || '-9'), 25, 8))::BIGINT % 16)::INTEGER AS tail FROM orders")
def hash_tail(spark, d):
    digest = F.md5(F.concat_ws("-", F.col("o_orderkey").cast("string"), F.lit("9")))
    return load(spark, d, "orders").select("o_orderkey", (F.conv(F.substring(digest, 25, 8), 16, 10).cast("bigint") % 16).cast("int").alias("tail"))


@query("""SELECT event_id, floor(least(11, greatest(0, value / 10)))::INTEGER AS lo, least(floor(least(11, greatest(0, value / 10))) + 1, 11)::INTEGER AS hi, round(least(11, greatest(0, value / 10)) - floor(least(11, greatest(0, value / 10))), 6) AS frac FROM events WHERE value IS NOT NULL""")
def step_brackets(spark, d):
    b = S.bracket(F.col("value") / 10, F.lit(12))
    return load(spark, d, "events").filter("value IS NOT NULL").select("event_id", b["lo"].alias("lo"), b["hi"].alias("hi"), F.round(b["frac"], 6).alias("frac"))


@query("""SELECT l_orderkey, l_linenumber, round(l_tax + atan2(sin(l_quantity - l_tax), cos(l_quantity - l_tax)) * l_discount, 6) AS angle FROM lineitem""")
def angle_interpolation(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.lerp_angle(F.col("l_tax"), F.col("l_quantity"), F.col("l_discount")), 6).alias("angle"))


@query("""WITH n AS (SELECT DISTINCT ON (node_id) node_id, bundle_id, hits, grid.x AS x FROM sgp_node), m AS (SELECT bundle_id, max(hits) AS top, max(x) + 1 AS gx FROM n GROUP BY bundle_id)
SELECT node_id, round(CASE WHEN hits > 0 AND top > 0 THEN 0.16 + 0.84 * sqrt(hits / top) ELSE 0.16 END, 6) AS size, round(CASE WHEN gx > 1 THEN x / (gx - 1) * 1.8 - 0.9 ELSE 0 END, 6) AS wx FROM n JOIN m USING (bundle_id)""")
def node_display(spark, d):
    """Size by hits and centred coordinate of every node."""
    n = load(spark, d, "sgp_node").select("node_id", "bundle_id", "hits", F.col("grid.x").alias("x")).dropDuplicates(["node_id"])
    m = n.groupBy("bundle_id").agg(F.max("hits").alias("top"), (F.max("x") + 1).alias("gx"))
    return n.join(m, "bundle_id").select("node_id", F.round(S.size_for_hits(F.col("hits"), F.col("top")), 6).alias("size"), F.round(S.lattice_world(F.col("x"), F.col("gx")), 6).alias("wx"))


@query("""SELECT pack_id, CASE WHEN c IS NULL OR isnan(c) THEN 'n/a' WHEN isinf(c) THEN 'inf' ELSE printf('%.4f', c) END AS said FROM (SELECT DISTINCT ON (pack_id) pack_id, prediction.confidence AS c FROM pack_manifest)""")
def formatted_metrics(spark, d):
    c = F.col("c")
    packs = load(spark, d, "pack_manifest").select("pack_id", F.col("prediction.confidence").alias("c")).dropDuplicates(["pack_id"])
    return packs.select("pack_id", F.when(F.abs(c) == float("inf"), F.lit("inf")).otherwise(S.formatted(c)).alias("said"))


@query("""SELECT feature_id, i - 1 AS class, CASE WHEN abs(x) < 0.005 THEN 0 ELSE round(x::DOUBLE, 3) END AS rate FROM (SELECT feature_id, unnest(firing_rates) AS x, generate_subscripts(firing_rates, 1) AS i FROM concept_feature)""")
def pruned_rates(spark, d):
    return load(spark, d, "concept_feature").select("feature_id", F.posexplode(S.rounded_or_zero(F.col("firing_rates"))).alias("class", "rate")).withColumn("class", F.col("class").cast("bigint"))


@query("""WITH c AS (SELECT bundle_id, community, avg(grid.y) / 14 AS r, avg(grid.x) / 14 AS c FROM (SELECT DISTINCT ON (node_id) * FROM sgp_node) WHERE community IS NOT NULL GROUP BY ALL),
w AS (SELECT bundle_id, community, concat_ws('-', CASE WHEN r < 0.34 THEN 'upper' WHEN r > 0.66 THEN 'lower' END, CASE WHEN c < 0.34 THEN 'left' WHEN c > 0.66 THEN 'right' END) AS w FROM c)
SELECT bundle_id, community, CASE WHEN w = '' THEN 'central patches' ELSE w || ' patches' END AS region FROM w""")
def region_labels(spark, d):
    """Words for the mean place of each community."""
    n = load(spark, d, "sgp_node").select("node_id", "bundle_id", "community", "grid").dropDuplicates(["node_id"]).filter("community IS NOT NULL")
    m = n.groupBy("bundle_id", "community").agg((F.avg("grid.y") / 14).alias("r"), (F.avg("grid.x") / 14).alias("c"))
    return m.select("bundle_id", "community", S.region_words(F.col("r"), F.col("c")).alias("region"))


@query("""SELECT lens_id, i - 1 AS class, round(exp(p[i] - list_max(p)) / list_sum(list_transform(p, lambda y: exp(y - list_max(p)))), 6) AS soft FROM (SELECT *, generate_subscripts(p, 1) AS i FROM (
SELECT DISTINCT lens_id, list_transform(probabilities, lambda x: x::DOUBLE) AS p FROM lens_lesion WHERE len(probabilities) > 0))""")
def softmax_rows(spark, d):
    rows = load(spark, d, "lens_lesion").select("lens_id", "probabilities").filter(F.size("probabilities") > 0).distinct()
    long = rows.select("lens_id", F.posexplode(V.softmax(F.col("probabilities"))).alias("class", "soft"))
    return long.select("lens_id", F.col("class").cast("bigint").alias("class"), F.round("soft", 6).alias("soft"))


@query("""SELECT doc_id, CASE lower(split_part(p, '.', -1)) WHEN 'json' THEN 'application/json' WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp' ELSE 'application/octet-stream' END AS kind, 'packs/' || source || '/' || p AS url
FROM (SELECT doc_id, source, doc_id || CASE doc_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.png' ELSE '.bin' END AS p FROM documents)""")
def asset_urls(spark, d):
    suffix = F.when(F.col("doc_id") % 3 == 0, ".json").when(F.col("doc_id") % 3 == 1, ".png").otherwise(".bin")
    docs = load(spark, d, "documents").select("doc_id", "source", F.concat(F.col("doc_id").cast("string"), suffix).alias("p"))
    return docs.select("doc_id", S.content_type(F.col("p")).alias("kind"), F.concat(F.lit("packs/"), "source", F.lit("/"), "p").alias("url"))
