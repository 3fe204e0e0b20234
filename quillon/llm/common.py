"""Helpers shared by the operators: reading, spreading, one row per id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import checkpointed, cores, join_hot, scratch, shuffle_width, top_positions, with_position

__all__ = ["checkpointed", "cores", "finite", "join_hot", "once_per_id", "scratch", "shuffle_width", "spread", "table", "top_positions", "with_position"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Give an input of fewer files than cores enough partitions for a Python stage; leave others alone."""
    wanted = per_core * cores(df.sparkSession)
    return df.repartition(wanted) if df.rdd.getNumPartitions() * 2 < wanted else df


def once_per_id(df: DataFrame, key: str) -> DataFrame:
    """One row for each id.  Rows without an id cannot be told to be repeats, so each of them stays."""
    alone = "__row_without_id"
    return df.withColumn(alone, F.when(F.col(key).isNull(), F.monotonically_increasing_id())).dropDuplicates([key, alone]).drop(alone)


def finite(value: Column) -> Column:
    """True for a number that is not null, NaN or infinite; never null."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))
