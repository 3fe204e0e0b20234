"""An axis between two groups of vectors, with calibrated ends and an off-axis threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .cumulative import exact_percentiles, level_name


def _components(df: DataFrame, vector: str, axis: dict) -> DataFrame:
    u = F.array(*[F.lit(x) for x in axis["u"]])
    base = F.array(*[F.lit(x) for x in axis["base"]])
    shifted = F.zip_with(vector, base, lambda x, b: x.cast("double") - b)
    out = df.withColumn("_proj", V.dot(F.col(vector), u)).withColumn("_shift", shifted)
    out = out.withColumn("_along", V.dot(F.col("_shift"), u))
    inside = V.dot(F.col("_shift"), F.col("_shift")) - F.col("_along") * F.col("_along")
    return out.withColumn("residual", F.sqrt(F.greatest(inside, F.lit(0.0)))).drop("_shift")


def build(df: DataFrame, vector: str, positive: Column, dimensions: int, low: float = 0.05, high: float = 0.95, off: float = 0.95) -> dict:
    """Unit difference of the two centroids, percentile anchors (or the full range where they cross) and the threshold.

    Only a few numbers per dimension reach the driver. Raises where a group is empty or the centroids coincide.
    """
    usable = df.filter(F.size(vector) == dimensions).withColumn("_positive", positive).filter(F.col("_positive").isNotNull())
    means = {r["_positive"]: r for r in usable.groupBy("_positive").agg(*[F.avg(F.get(F.col(vector), F.lit(i)).cast("double")).alias(f"d{i}") for i in range(dimensions)]).collect()}
    if set(means) != {True, False}:
        raise ValueError("an axis needs rows of both groups")
    base = [means[False][f"d{i}"] for i in range(dimensions)]
    difference = [means[True][f"d{i}"] - base[i] for i in range(dimensions)]
    length = sum(x * x for x in difference) ** 0.5
    if length == 0:
        raise ValueError("the centroids of the groups coincide; there is no axis")
    axis = {"u": [x / length for x in difference], "base": base}
    measured = _components(usable, vector, axis)
    kind = F.when(F.col("_positive"), "high").otherwise("low")
    long = measured.select(F.inline(F.array(F.struct(kind.alias("kind"), F.col("_proj").alias("x")), F.struct(F.lit("off").alias("kind"), F.col("residual").alias("x")))))
    found = {r["kind"]: r for r in exact_percentiles(long, ["kind"], "x", sorted({low, high, off})).collect()}  # three rows
    name = level_name
    one = measured.agg(F.min("_proj").alias("least"), F.max("_proj").alias("most")).first()
    bottom, top, threshold = found["low"][name(low)], found["high"][name(high)], found["off"][name(off)]
    lo, hi = (bottom, top) if top > bottom else (one.least, one.most + 1e-9)
    return axis | {"anchor_lo": lo, "anchor_hi": hi, "residual_threshold": threshold}


def project(df: DataFrame, vector: str, axis: dict) -> DataFrame:
    """Adds ``position`` in [0, 1], ``residual`` and ``ood``: the residual is beyond the threshold."""
    out = _components(df.filter(F.size(vector) == len(axis["u"])), vector, axis)
    span = axis["anchor_hi"] - axis["anchor_lo"] if axis["anchor_hi"] > axis["anchor_lo"] else 1.0
    position = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_proj") - axis["anchor_lo"]) / span))
    return out.withColumn("position", position).withColumn("ood", F.col("residual") > axis["residual_threshold"] + 1e-9).drop("_proj", "_along")
