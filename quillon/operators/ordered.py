"""Operators on ordered rows: ranks, correlations, curves, smoothing, state machines, relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positions import last_known, with_position


def average_rank(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Adds the 0-based rank of ``value`` in its group, ties sharing the mean of their places.

    Ranks are running sums over the different values, sorted by range over all partitions, so neither a group nor a
    value is one task's.
    """
    keyed = F.to_json(F.struct(*group), {"ignoreNullFields": "false"})
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_key", keyed)
    upto = with_position(counts, "_key", [F.col(value).asc()], "_upto", weight="_n")
    ranks = upto.select(*group, value, (F.col("_upto") - F.col("_n") + (F.col("_n") - 1) / 2.0).alias(name))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, value]]
    return df.alias("l").join(ranks.alias("r"), same).select("l.*", F.col(f"r.{name}"))


def spearman(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """(group, rho): Pearson correlation of the average ranks, 0 where one side does not vary."""
    both = average_rank(average_rank(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), group, a, "_ra"), group, b, "_rb")
    spread = F.stddev_pop("_ra") * F.stddev_pop("_rb")
    return both.groupBy(*group).agg(F.when(spread > 0, F.covar_pop("_ra", "_rb") / F.nullif(spread, F.lit(0.0))).otherwise(F.lit(0.0)).alias("rho"))


def with_previous(placed: DataFrame, key: list[str], place: str, value: str, name: str = "_previous") -> DataFrame:
    """Adds the value at the place before, null for the first: an equi-join on key and place, so no key is one task's."""
    before = placed.select(*key, (F.col(place) + 1).alias(place), F.col(value).alias(name))
    return placed.join(before, [*key, place], "left")


def migration(placed: DataFrame, cell: list[str], step: str, value: str) -> DataFrame:
    """(step, rate): share of cells whose value differs from that of the step before."""
    moved = with_previous(placed, cell, step, value).filter(F.col("_previous").isNotNull())
    return moved.groupBy(step).agg(F.avg((F.col(value) != F.col("_previous")).cast("int")).alias("rate"))


def ema_weights(back: Column, alpha: float) -> Column:
    """Weight of the value ``back`` places before the last in an average that starts at zero."""
    return F.lit(alpha) * F.pow(F.lit(1 - alpha), back)


def last_ema(placed: DataFrame, key: str, value: str, place: str, total: str, alpha: float) -> DataFrame:
    """(key, ema) after the last value: the fold unrolled to a weighted sum, so groups of any size combine on the map side."""
    return placed.groupBy(key).agg(F.sum(ema_weights(F.col(total) - F.col(place), alpha) * F.col(value)).alias("ema"))


def hysteresis(df: DataFrame, key: str, order: list[str], value: str, threshold: Column | float, margin: float = 0.06) -> DataFrame:
    """Adds ``visible``: on above threshold + margin, off at or below threshold - margin, else as before (at first off).

    The state is that of the last decisive value, carried over all partitions, so a key of any size is no single task's.
    Rows without a key are a timeline of their own.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    decisive = F.when(F.col(value) > limit + margin, True).when(F.col(value) <= limit - margin, False)
    marked = df.withColumn("_line", F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("-"))).withColumn("_decisive", decisive)
    placed = last_known(marked, "_line", [F.col(c).asc() for c in order], "_decisive", "_last")
    return placed.select(*df.columns, F.coalesce("_last", F.lit(False)).alias("visible"))


def first_seen_labels(df: DataFrame, group: list[str], label: str, order: str) -> DataFrame:
    """(group, label, canonical): labels renumbered from 0 by first occurrence. Labels per group are few."""
    first = df.filter(F.col(label).isNotNull()).groupBy(*group, label).agg(F.min(order).alias("_first"))
    return first.withColumn("canonical", (F.row_number().over(Window.partitionBy(*group).orderBy("_first")) - 1).cast("bigint")).drop("_first")


def not_rising(df: DataFrame, group: str, order: str, value: str, tolerance: float = 1e-4) -> DataFrame:
    """(group, steps, verdict): whether all steps stay within ``tolerance`` of not rising; two finite values at least."""
    fine = df.filter(~F.isnan(value) & (F.abs(value) < float("inf")) & F.col(group).isNotNull()).select(group, order, value)
    placed = with_position(fine, group, [F.col(order).asc()], "_place")
    step = F.col(value) - F.col("_previous")
    held = with_previous(placed, [group], "_place", value).withColumn("_step", step).groupBy(group).agg(F.count("_step").alias("steps"), F.bool_and(F.col("_step") <= tolerance).alias("_down"))
    verdict = F.when(F.col("steps") < 1, "undetermined").when(F.col("_down"), "monotone").otherwise("not monotone")
    return held.select(group, "steps", verdict.alias("verdict"))
