"""Problem 2: percentiles per group, from cumulative frequencies that can be combined.

Values are reduced to counts per group and value (the state: counts of days or files are added to combine
them), sorted by range over all partitions, given running sums inside each partition plus the offset of the
partitions before, and the first value that reaches each target rank is picked, all where the sort left them.
A group of any size is spread over partitions; what is gathered is two sums for each partition.

Error: none by default.  ``relative_error=e`` merges values into logarithmic cells, so that a state has a
bounded number of rows and every percentile is within ``e`` of the exact one, relative to its size.

Defined cases: each pack_id counts once; packs without an id count each; a null run_id is a group of its own;
values outside the measure's range, null, NaN and infinite are not counted; a group without valid values gives
no row; percentiles lie linearly between the two nearest ranks, so ties and one value alone are themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cumulative
from ..operators.cumulative import frequencies
from .common import finite, once_per_id, table

LEVELS = (0.05, 0.25, 0.5, 0.75, 0.95)


def combine(*states: DataFrame) -> DataFrame:
    """One state from the states of separate days, files or runs over the same columns."""
    first, *rest = states
    for state in rest:
        first = first.unionByName(state)
    return first.groupBy(*[c for c in first.columns if c != "n"]).agg(F.sum("n").alias("n"))


def percentiles(state: DataFrame, groups: list[str], value: str, levels=LEVELS, at_least: int = 1) -> DataFrame:
    """``groups``, ``n`` and one column ``pXX`` for each level, of the groups with ``at_least`` values."""
    return cumulative.percentiles(state, groups, value, levels, at_least)


def measures(packs: DataFrame) -> DataFrame:
    """Long form (run_id, day, measure, value) of the valid values of ``pack_manifest``, each pack once."""
    flat = packs.select(
        "pack_id",
        "run_id",
        F.to_date("created_at").alias("day"),
        F.col("faithfulness.deletion_auc.chefer").alias("chefer"),
        F.col("prediction.confidence").alias("confidence"),
        F.col("timings.predict_ms").alias("predict_ms"),
    )
    long = once_per_id(flat, "pack_id").select(
        "run_id",
        "day",
        F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in ("chefer", "confidence", "predict_ms")])).alias("x"),
    )
    long = long.select("run_id", "day", "x.measure", "x.value")
    v = F.col("value")
    within = F.when(F.col("measure") == "predict_ms", v > 0).otherwise((v >= 0) & (v <= 1))
    return long.filter(finite(v) & within)


GROUPS = ["run_id", "measure"]


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = frequencies(measures(table(spark, sf_dir, "pack_manifest")), GROUPS, "value")
    found = percentiles(state, GROUPS, "value")
    return found.select(*GROUPS, "n", *[F.round(c, 9).alias(c) for c in found.columns if c[0] == "p"])


def p2_combined_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles of each measure from states kept by day and put together afterwards."""
    by_day = frequencies(measures(table(spark, sf_dir, "pack_manifest")), ["day", "measure"], "value")
    state = combine(by_day.select("measure", "value", "n"))
    found = percentiles(state, ["measure"], "value")
    return found.select("measure", "n", *[F.round(c, 9).alias(c) for c in found.columns if c[0] == "p"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = frequencies(measures(table(spark, sf_dir, "pack_manifest")), GROUPS, "value")
    p = percentiles(state, GROUPS, "value", at_least=100)
    wide = F.greatest(F.col("p95") - F.col("p50"), F.col("p50") - F.col("p05")) >= 3 * (F.col("p75") - F.col("p25"))
    return p.filter(wide).select(*GROUPS)


_VALUES = """
WITH packs AS (
  SELECT DISTINCT ON (pack_id) run_id, faithfulness.deletion_auc.chefer AS chefer,
         prediction.confidence AS confidence, timings.predict_ms AS predict_ms
  FROM pack_manifest
), long AS (
  SELECT run_id, 'chefer' AS measure, chefer AS value FROM packs WHERE isfinite(chefer) AND chefer BETWEEN 0 AND 1
  UNION ALL
  SELECT run_id, 'confidence', confidence FROM packs WHERE isfinite(confidence) AND confidence BETWEEN 0 AND 1
  UNION ALL
  SELECT run_id, 'predict_ms', predict_ms FROM packs WHERE isfinite(predict_ms) AND predict_ms > 0
), p AS (
  SELECT {keys}, count(*) AS n, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.25) AS p25,
         quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95
  FROM long GROUP BY {keys}
)
"""
_ROUNDED = "n, round(p05, 9) AS p05, round(p25, 9) AS p25, round(p50, 9) AS p50, round(p75, 9) AS p75, round(p95, 9) AS p95"

QUERIES = {"p2_found": p2_found, "p2_percentiles": p2_percentiles, "p2_combined_days": p2_combined_days}
ORACLE = {
    "p2_found": _VALUES.format(keys="run_id, measure") + "SELECT run_id, measure FROM p WHERE n >= 100 AND greatest(p95 - p50, p50 - p05) >= 3 * (p75 - p25)",
    "p2_percentiles": _VALUES.format(keys="run_id, measure") + f"SELECT run_id, measure, {_ROUNDED} FROM p",
    "p2_combined_days": _VALUES.format(keys="measure") + f"SELECT measure, {_ROUNDED} FROM p",
}
