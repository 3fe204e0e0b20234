"""Problem 3: the N highest-scoring items of every group.

A global range-partitioned sort on group, score and identifier; the counts per partition are prefix-summed
into exact positions and positions up to N stay.  No group is gathered in one task: one that holds a third of
all rows lies over many partitions, and each of them hands on at most N of its rows.

Defined cases: items with a null group, image or token do not exist; activations that are null, NaN, infinite,
zero or negative count as absent; rows repeated or scored again give the item its highest activation; a null,
empty or missing exemplar list adds nothing; ties go to the smaller image_id by bytes, then the smaller
token_idx; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import finite, table, top_positions

ITEM = ("feature_id", "image_id", "token_idx")


def exemplar_items(refs: DataFrame, features: DataFrame) -> DataFrame:
    """Items of both places with their highest valid activation."""
    kept = features.select("feature_id", F.explode("exemplars").alias("e"))
    kept = kept.select("feature_id", F.col("e.image_id").alias("image_id"), F.col("e.token_idx").alias("token_idx"), F.col("e.activation").alias("activation"))
    both = refs.select(*ITEM, "activation").unionByName(kept)
    valid = finite(F.col("activation")) & (F.col("activation") > 0)
    for name in ITEM:
        valid = valid & F.col(name).isNotNull()
    return both.filter(valid).groupBy(*ITEM).agg(F.max("activation").alias("activation"))


def top_exemplars(refs: DataFrame, features: DataFrame, n: int = 10) -> DataFrame:
    """(feature_id, image_id, token_idx, activation, position) of the first ``n`` items of each feature."""
    order = [F.col("activation").desc(), F.col("image_id").asc(), F.col("token_idx").asc()]
    return top_positions(exemplar_items(refs, features), "feature_id", order, n)


def _tables(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "exemplar_ref"), table(spark, sf_dir, "concept_feature")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_exemplars(*_tables(spark, sf_dir)).select(*ITEM)


def p3_top_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_exemplars(*_tables(spark, sf_dir), n=64)


_ITEMS = """
WITH both_places AS (
  SELECT feature_id, image_id, token_idx, activation FROM exemplar_ref
  UNION ALL
  SELECT feature_id, e.image_id, e.token_idx, e.activation
  FROM (SELECT feature_id, unnest(exemplars) AS e FROM concept_feature)
), items AS (
  SELECT feature_id, image_id, token_idx, max(activation) AS activation
  FROM both_places
  WHERE feature_id IS NOT NULL AND image_id IS NOT NULL AND token_idx IS NOT NULL
    AND isfinite(activation) AND activation > 0
  GROUP BY ALL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY activation DESC, image_id, token_idx) AS position FROM items
)
"""

QUERIES = {"p3_found": p3_found, "p3_top_exemplars": p3_top_exemplars}
ORACLE = {
    "p3_found": _ITEMS + "SELECT feature_id, image_id, token_idx FROM placed WHERE position <= 10",
    "p3_top_exemplars": _ITEMS + "SELECT feature_id, image_id, token_idx, activation, position FROM placed WHERE position <= 64",
}
