"""Splits and dataset scans."""

from pyspark.sql import functions as F

from ..operators import splitting as S
from ..session import load
from .registry import query

_DRAW = "md5({k}::VARCHAR || '-{seed}')"
_ORDERS = "SELECT o_orderkey, o_orderpriority, o_custkey FROM orders"


@query("""WITH p AS (SELECT o_orderkey, o_orderpriority,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR || '-7'), o_orderkey) AS rn,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey, o_orderpriority, CASE WHEN rn <= round_even(n * 0.7, 0) THEN 'train'
  WHEN rn <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split FROM p""")
def split_stratified(spark, d):
    return S.stratified(load(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 0.7, 0.15, 7)


@query("""WITH g AS (SELECT o_custkey, min_by(o_orderpriority, o_orderkey) AS s FROM orders GROUP BY o_custkey), p AS (
  SELECT o_custkey, row_number() OVER (PARTITION BY s ORDER BY md5(o_custkey::VARCHAR || '-7'), o_custkey) AS rn,
  count(*) OVER (PARTITION BY s) AS n FROM g)
SELECT o.o_orderkey, o_custkey, CASE WHEN rn <= round_even(n * 0.7, 0) THEN 'train'
  WHEN rn <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split
FROM orders o JOIN p USING (o_custkey)""")
def split_grouped_stratified(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return S.grouped_stratified(orders, "o_custkey", "o_orderpriority", "o_orderkey", 0.7, 0.15, 7).select("o_orderkey", "o_custkey", "split")


_WORD = "('0x' || substr(h, {i}, 8))::BIGINT"
_UNIT = "(({w0} % 1000000 * 4294967296 + {w1}) % 1000000 * 4294967296 + {w2}) % 1000000 * 4294967296 + {w3}".format(**{f"w{i}": _WORD.format(i=1 + 8 * i) for i in range(4)})


@query(f"""WITH h AS (SELECT o_orderkey, md5(o_custkey::VARCHAR || '-42') AS h FROM orders),
u AS (SELECT o_orderkey, (({_UNIT}) % 1000000) / 1000000.0 AS u FROM h)
SELECT o_orderkey, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM u""")
def split_hashed(spark, d):
    return S.hashed(load(spark, d, "orders"), F.col("o_custkey"), 0.8, 0.1, 42).select("o_orderkey", "split")


@query("""WITH g AS (SELECT DISTINCT o_custkey FROM orders), p AS (
  SELECT o_custkey, row_number() OVER (ORDER BY md5(o_custkey::VARCHAR || '-3'), o_custkey) AS rn, count(*) OVER () AS n FROM g)
SELECT o_orderkey, CASE WHEN rn <= greatest(1, floor(n * 0.2)) THEN 'val' ELSE 'train' END AS split FROM orders JOIN p USING (o_custkey)""")
def split_random_groups(spark, d):
    return S.random_groups(load(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 0.2, 3).select("o_orderkey", "split")


@query("""WITH p AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey::VARCHAR || '-5'), p_partkey) AS rn,
  count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_partkey, p_brand, CASE WHEN rn <= CASE WHEN n > 1 THEN greatest(1, round_even(n * 0.1, 0)) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM p""")
def split_at_least_one(spark, d):
    return S.at_least_one(load(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey", "p_brand", 0.1, 5)


@query("""WITH h AS (SELECT o_custkey, md5(o_orderkey::VARCHAR || '-42') AS h FROM orders),
u AS (SELECT o_custkey, ((""" + _UNIT + """) % 1000000) / 1000000.0 AS u FROM h)
SELECT o_custkey, count(DISTINCT CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END) AS n_splits
FROM u WHERE o_custkey IS NOT NULL GROUP BY o_custkey HAVING n_splits > 1""")
def split_leaks(spark, d):
    """Groups that an ungrouped hash split tears apart."""
    return S.leaking_groups(S.hashed(load(spark, d, "orders"), F.col("o_orderkey"), 0.8, 0.1, 42), "o_custkey")


@query("SELECT split, count(*) AS n FROM frozen_feature WHERE split IN ('train', 'val', 'test') GROUP BY split")
def split_filter_counts(spark, d):
    return load(spark, d, "frozen_feature").filter(F.col("split").isin("train", "val", "test")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT dataset_id, image_id, min_by(folder, row_id) AS folder, min(row_id) AS row_id FROM image_metadata GROUP BY dataset_id, image_id""")
def image_index_first(spark, d):
    """First occurrence of an image wins, by row id."""
    rows = load(spark, d, "image_metadata")
    return rows.groupBy("dataset_id", "image_id").agg(F.min_by("folder", "row_id").alias("folder"), F.min("row_id").alias("row_id"))


_KNOWN = ("akiec", "bcc", "bkl", "df", "mel", "nv", "vasc")


@query(f"""WITH i AS (SELECT DISTINCT image.id AS image_id FROM pack_manifest WHERE image.id IS NOT NULL)
SELECT row_id, image_id, lower(trim(dx)) AS dx, try_cast(age AS DOUBLE) AS age FROM image_metadata JOIN i USING (image_id)
WHERE lower(trim(dx)) IN {_KNOWN}""")
def csv_scan_joined(spark, d):
    """Text rows with a known class, joined to the images that exist."""
    images = load(spark, d, "pack_manifest").select(F.col("image.id").alias("image_id")).filter("image_id IS NOT NULL").distinct()
    dx = F.lower(F.trim("dx"))
    rows = load(spark, d, "image_metadata").filter(dx.isin(*_KNOWN))
    return rows.join(images, "image_id").select("row_id", "image_id", dx.alias("dx"), F.col("age").try_cast("double").alias("age"))


@query("""SELECT lens_id, list_position(probabilities, list_max(probabilities)) - 1 AS label FROM (
  SELECT DISTINCT lens_id, probabilities FROM lens_lesion) WHERE list_max(probabilities) > 0""")
def onehot_labels(spark, d):
    from ..functions.vectors import argmax

    rows = load(spark, d, "lens_lesion").select("lens_id", "probabilities").distinct()
    return rows.filter(F.array_max("probabilities") > 0).select("lens_id", argmax(F.col("probabilities")).cast("bigint").alias("label"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 100")
def limit_subset(spark, d):
    """The first rows of a dataset in a fixed order, as the sampling option of the loaders asks."""
    return load(spark, d, "part").select("p_partkey", "p_name").orderBy("p_partkey").limit(100)


@query("""SELECT n_name, dense_rank() OVER (ORDER BY n_name) - 1 AS label FROM nation""")
def class_labels(spark, d):
    """Sorted class names to 0-based labels."""
    from ..operators.positions import with_position

    names = load(spark, d, "nation").select("n_name").distinct().withColumn("_one", F.lit(0))
    numbered = with_position(names, "_one", [F.col("n_name").asc()], "_place")
    return load(spark, d, "nation").select("n_name").join(numbered, "n_name").select("n_name", (F.col("_place") - 1).alias("label"))


@query("""SELECT DISTINCT regexp_replace(image_id, '_[0-9]+$', '') AS class FROM image_metadata""")
def classes_from_stems(spark, d):
    from ..functions.scalars import class_from_stem

    return load(spark, d, "image_metadata").select(class_from_stem(F.col("image_id")).alias("class")).distinct()


@query("""SELECT dataset_id, folder AS class, count(*) AS n FROM image_metadata WHERE folder IS NOT NULL GROUP BY ALL""")
def folder_scan(spark, d):
    return load(spark, d, "image_metadata").filter("folder IS NOT NULL").groupBy("dataset_id", F.col("folder").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT row_id, CASE WHEN y IS NULL THEN -1 WHEN y < 20 THEN 0 WHEN y < 40 THEN 1 WHEN y < 60 THEN 2 WHEN y < 80 THEN 3 ELSE 4 END AS bucket,
 CASE WHEN lower(trim(sex)) = 'male' THEN 1 ELSE 0 END AS male, CASE WHEN lower(trim(sex)) = 'female' THEN 1 ELSE 0 END AS female
FROM (SELECT row_id, sex, try_cast(age AS DOUBLE) AS y FROM image_metadata)""")
def metadata_attributes(spark, d):
    from ..functions.scalars import age_bucket

    sex = F.lower(F.trim("sex"))
    one = lambda v: F.when(sex == v, 1).otherwise(0)
    return load(spark, d, "image_metadata").select("row_id", F.coalesce(age_bucket(F.col("age")), F.lit(-1)).alias("bucket"), one("male").alias("male"), one("female").alias("female"))
