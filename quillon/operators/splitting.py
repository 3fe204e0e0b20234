"""The four ways of assigning rows to splits. Groups and strata of any size are placed by a global sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import unit_hash
from .positions import with_position


def check_fractions(train: float, val: float, test: float) -> None:
    """Fractions are not negative and add up to one within 1e-6."""
    if min(train, val, test) < 0 or not math.isclose(train + val + test, 1.0, abs_tol=1e-6):
        raise ValueError(f"split fractions: {train}, {val}, {test} must be >= 0 and sum to 1")


def drawn(key: Column, seed) -> Column:
    """The seeded order of keys: md5 of key and seed, as no shuffle of a random generator is the same everywhere."""
    return F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed))))


def stratified(df: DataFrame, key: str, stratum: str, train: float, val: float, seed=0) -> DataFrame:
    """Adds ``split``: in each stratum round-half-even(f * n) rows for train and val, the rest for test."""
    check_fractions(train, val, 1 - train - val)
    placed = with_position(df.withColumn("_draw", drawn(F.col(key), seed)), stratum, [F.col("_draw").asc(), F.col(key).asc()], "_at", "_n")
    first = F.bround(F.col("_n") * F.lit(train)).cast("bigint")
    second = F.bround(F.col("_n") * F.lit(val)).cast("bigint")
    split = F.when(F.col("_at") <= first, "train").when(F.col("_at") <= first + second, "val").otherwise("test")
    return placed.withColumn("split", split).drop("_draw", "_at", "_n")


def grouped_stratified(df: DataFrame, group: str, stratum: str, order: str, train: float, val: float, seed=0) -> DataFrame:
    """Adds ``split``: groups are split within the stratum their first row (by ``order``) names; rows inherit it."""
    groups = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min_by(stratum, order).alias("_stratum"))
    placed = stratified(groups, group, "_stratum", train, val, seed).select(group, "split")
    return df.join(placed, group, "left")


def hashed(df: DataFrame, key: Column, train: float, val: float, seed=0) -> DataFrame:
    """Adds ``split``: the unit hash of the key against the cumulative fractions; needs no shuffle."""
    check_fractions(train, val, 1 - train - val)
    u = unit_hash(key, F.lit(str(seed)))
    return df.withColumn("split", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


def random_groups(df: DataFrame, group: str, val: float, seed=0) -> DataFrame:
    """Adds ``split``: the first max(1, floor(n * val)) groups of the seeded order are val, the others train."""
    groups = df.filter(F.col(group).isNotNull()).select(group).distinct().withColumn("_all", F.lit(0))
    placed = with_position(groups.withColumn("_draw", drawn(F.col(group), seed)), "_all", [F.col("_draw").asc(), F.col(group).asc()], "_at", "_n")
    chosen = F.col("_at") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(val)))
    return df.join(placed.select(group, F.when(chosen, "val").otherwise("train").alias("split")), group, "left")


def at_least_one(df: DataFrame, key: str, stratum: str, val: float, seed=0) -> DataFrame:
    """Adds ``split``: in each class of two or more rows at least one is val, in a class of one none."""
    placed = with_position(df.withColumn("_draw", drawn(F.col(key), seed)), stratum, [F.col("_draw").asc(), F.col(key).asc()], "_at", "_n")
    k = F.when(F.col("_n") > 1, F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(val)).cast("bigint"))).otherwise(F.lit(0))
    return placed.withColumn("split", F.when(F.col("_at") <= k, "val").otherwise("train")).drop("_draw", "_at", "_n")


def leaking_groups(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that are in more than one split."""
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.countDistinct(split).alias("n_splits")).filter("n_splits > 1")


def views(rows: DataFrame, split: str, train: str = "train") -> DataFrame:
    """Rows with ``view``: those of the training split twice, 0 and 1, to be augmented each by itself; all others once."""
    return rows.withColumn("view", F.explode(F.when(F.col(split) == train, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
