"""Top-k, limits and set operations."""

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.positions import top_positions
from ..session import load
from .registry import query


@query("""SELECT lens_id, array_to_string(list_transform(list_slice(list_sort(list_transform(list_zip(probabilities, range(len(probabilities))), lambda z: (-z[1], z[2]))), 1, 3), lambda t: t[2]), ',') AS top3
FROM (SELECT DISTINCT lens_id, probabilities FROM lens_lesion WHERE len(probabilities) > 0 AND len(list_filter(probabilities, lambda x: x IS NULL OR isnan(x))) = 0)""")
def top_classes(spark, d):
    """Places of the three largest probabilities of each row, stable."""
    rows = load(spark, d, "lens_lesion").select("lens_id", "probabilities").filter(F.size("probabilities") > 0).distinct()
    rows = rows.filter(~F.exists("probabilities", lambda x: x.isNull() | F.isnan(x)))
    return rows.select("lens_id", F.array_join(F.transform(V.top_k(F.col("probabilities"), 3), lambda s: s["i"].cast("string")), ",").alias("top3"))


@query("""WITH w AS (SELECT l_partkey AS dst, l_suppkey AS src, sum(l_quantity) AS w FROM lineitem GROUP BY ALL)
SELECT dst, src, w FROM w QUALIFY row_number() OVER (PARTITION BY dst ORDER BY w DESC, src) <= 3""")
def edges_per_destination(spark, d):
    """The three heaviest edges into each node; ties go to the smaller source."""
    w = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("dst"), F.col("l_suppkey").alias("src")).agg(F.sum("l_quantity").alias("w"))
    return top_positions(w.filter("dst IS NOT NULL"), "dst", [F.col("w").desc(), F.col("src").asc()], 3).select("dst", "src", "w")


@query("""SELECT feature_id, array_to_string(list_transform(list_slice(list_sort(list_transform(list_filter(exemplars, lambda e: isfinite(e.activation) AND e.image_id IS NOT NULL AND e.token_idx IS NOT NULL), lambda e: (-e.activation, e.image_id, e.token_idx))), 1, 2), lambda t: t[2]), ',') AS images
FROM concept_feature WHERE exemplars IS NOT NULL""")
def published_exemplars(spark, d):
    """Images of the two strongest published exemplars of each concept."""
    fine = F.filter("exemplars", lambda e: e["activation"].isNotNull() & ~F.isnan(e["activation"]) & (F.abs(e["activation"]) < float("inf")) & e["image_id"].isNotNull() & e["token_idx"].isNotNull())
    ranked = F.array_sort(F.transform(fine, lambda e: F.struct((-e["activation"]).alias("a"), e["image_id"].alias("i"), e["token_idx"].alias("t"))))
    return load(spark, d, "concept_feature").filter("exemplars IS NOT NULL").select("feature_id", F.array_join(F.transform(F.slice(ranked, 1, 2), lambda e: e["i"]), ",").alias("images"))


@query("""WITH v AS (SELECT run_id, prediction.confidence AS c FROM (SELECT DISTINCT ON (pack_id) * FROM pack_manifest) WHERE isfinite(prediction.confidence)),
r AS (SELECT run_id, c, row_number() OVER (PARTITION BY run_id ORDER BY c) AS rn, count(*) OVER (PARTITION BY run_id) AS n FROM v)
SELECT run_id, c AS threshold FROM r WHERE rn = greatest(0, least(n - 1, floor(0.9 * n))) + 1""")
def hot_threshold(spark, d):
    """Order statistic at floor(0.9 n): the nearest rank, not an interpolated percentile."""
    from ..operators.positions import with_position

    c = F.col("prediction.confidence")
    v = load(spark, d, "pack_manifest").select("pack_id", "run_id", c.alias("c")).dropDuplicates(["pack_id"]).filter("run_id IS NOT NULL AND NOT isnan(c) AND abs(c) < double('inf')")
    placed = with_position(v.select("run_id", "c"), "run_id", [F.col("c").asc()], "rn", "n")
    return placed.filter(F.col("rn") == F.greatest(F.lit(0), F.least(F.col("n") - 1, F.floor(0.9 * F.col("n")))) + 1).select("run_id", F.col("c").alias("threshold"))


@query("SELECT p_type, p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 40")
def gallery_head(spark, d):
    return load(spark, d, "part").select("p_type", "p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(40)


@query("SELECT folder AS class FROM image_metadata WHERE folder IS NOT NULL UNION SELECT label FROM (SELECT prediction.label AS label FROM pack_manifest) WHERE label IS NOT NULL")
def class_union(spark, d):
    """Sorted union of the classes of two places."""
    a = load(spark, d, "image_metadata").select(F.col("folder").alias("class"))
    b = load(spark, d, "pack_manifest").select(F.col("prediction.label").alias("class"))
    return a.union(b).filter("class IS NOT NULL").distinct()


@query("SELECT image_id, min(row_id) AS row_id FROM image_metadata WHERE image_id IS NOT NULL GROUP BY image_id")
def first_per_key(spark, d):
    return load(spark, d, "image_metadata").filter("image_id IS NOT NULL").groupBy("image_id").agg(F.min("row_id").alias("row_id"))


@query("SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, max(l_quantity) AS w FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY ALL")
def undirected_edges(spark, d):
    """Strongest weight of each undirected pair, loops dropped."""
    rows = load(spark, d, "lineitem").filter("l_partkey <> l_suppkey")
    return rows.groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).agg(F.max("l_quantity").alias("w"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def unseen_pairs(spark, d):
    """Pairs not emitted before."""
    rows = load(spark, d, "lineitem")
    pair = ["l_partkey", "l_suppkey"]
    return rows.filter("l_returnflag = 'A'").select(*pair).distinct().join(rows.filter("l_returnflag = 'R'").select(*pair), pair, "left_anti")


@query("""WITH g AS (SELECT feat_id, count(*) AS n, count(DISTINCT coalesce(split, '')) AS s FROM frozen_feature GROUP BY feat_id)
SELECT sum(n)::BIGINT AS n, count(*) AS ids, count(*) FILTER (s > 1) AS torn FROM g""")
def partition_check(spark, d):
    """Rows, ids, and ids that lie in more than one split."""
    rows = load(spark, d, "frozen_feature")
    by_id = rows.groupBy("feat_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.coalesce("split", F.lit(""))).alias("s"))
    return by_id.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("ids"), F.count(F.when(F.col("s") > 1, 1)).alias("torn"))


@query("""WITH e AS (SELECT user_id, count(*) AS n, sum(value) AS v FROM events GROUP BY user_id) SELECT user_id, n, round(v, 4) AS v FROM e ORDER BY n DESC, user_id LIMIT 20""")
def most_active(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v")).orderBy(F.desc("n"), "user_id").limit(20)
