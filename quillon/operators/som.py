"""Training steps of a self-organizing map and sparse codes, against a codebook of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dense import dimension_means, nearest, nearest_sums, spread
from .positions import checkpointed, top_positions, with_position


#: Places along one axis of a map, at most.
AXIS_MOST = 10_000
#: Units of a map, at most, whose hits are sent to every task.
FEW_UNITS = 2048


def _large_sums(rows: DataFrame, key: str, vector: str, units: DataFrame, dimensions: int) -> DataFrame:
    """As ``nearest_sums`` for a codebook of any size."""
    best = nearest(rows, key, vector, units, "code", "w").select(key, "code")
    hit = rows.join(best, key).groupBy("code").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get(F.col(vector), F.lit(i)).cast("double")).alias(f"d{i}") for i in range(dimensions)])
    return hit.select("code", "n", F.array(*[f"d{i}" for i in range(dimensions)]).alias("s"))


def _kernel_sums(moved_sums: DataFrame, units: DataFrame, sigma: float, dimensions: int) -> DataFrame:
    """(z, y, x, n, s): counts and sums of all hit places (n, s, z, y, x), weighed by the kernel, at the place of each unit.

    The kernel is a product over the axes, so it is applied along one axis after the other, and no unit meets all others.
    """
    for axis in "zyx":
        places = units.select(F.col(axis).alias("_to")).distinct()
        if len(places.take(AXIS_MOST + 1)) > AXIS_MOST:
            raise ValueError(f"more than {AXIS_MOST} places on axis {axis}; they are sent to every task")
        weight = F.exp(-(F.col("_to") - F.col(axis)) * (F.col("_to") - F.col(axis)) / (2 * sigma * sigma))
        met = moved_sums.join(F.broadcast(places)).withColumn("_h", weight)
        others = [c for c in "zyx" if c != axis]
        parts = [F.sum(F.col("_h") * F.get("s", F.lit(i))).alias(f"d{i}") for i in range(dimensions)]
        met = met.groupBy(*others, F.col("_to").alias(axis)).agg(F.sum(F.col("_h") * F.col("n")).alias("n"), *parts)
        moved_sums = met.select("z", "y", "x", "n", F.array(*[f"d{i}" for i in range(dimensions)]).alias("s"))
    return moved_sums


def _moved_units(hit: DataFrame, units: DataFrame, sigma: float, mix: float) -> DataFrame:
    """The step of a map of at most FEW_UNITS units, whose sums (code, n, s) are few enough to be worked on in one place."""
    import numpy as np

    own = units.select("code", "z", "y", "x", "w").orderBy("code").toPandas()
    sums = hit.orderBy("code").toPandas()
    place = own[["z", "y", "x"]].to_numpy("float64")
    if len(sums):
        at = np.searchsorted(own["code"].to_numpy(), sums["code"].to_numpy())
        h = np.exp(-((place[:, None, :] - place[at][None, :, :]) ** 2).sum(axis=2) / (2 * sigma * sigma))
        target = (h @ np.stack(sums["s"])) / np.maximum(h @ sums["n"].to_numpy("float64"), 1e-12)[:, None]
        w = np.stack(own["w"])
        own["w"] = list(w + (target - w) * mix)
    rows = [(int(r.code), int(r.z), int(r.y), int(r.x), [float(v) for v in r.w]) for r in own.itertuples()]
    return units.sparkSession.createDataFrame(rows, "code bigint, z bigint, y bigint, x bigint, w array<double>")


def batch_step(rows: DataFrame, key: str, vector: str, units: DataFrame, sigma: float, dimensions: int, mix: float = 0.5) -> DataFrame:
    """New units (code, z, y, x, w): each moves by ``mix`` to the kernel-weighted mean of all rows.

    The rows are summed per best unit first, so the kernel works on tables of the size of the codebook only.
    """
    hit = nearest_sums(rows, key, vector, units, "code", "w")
    hit = hit if hit is not None else _large_sums(rows, key, vector, units, dimensions)
    if len(units.take(FEW_UNITS + 1)) <= FEW_UNITS:
        return _moved_units(hit, units, sigma, mix)
    moved_sums = _kernel_sums(hit.join(units.select("code", "z", "y", "x"), "code").drop("code"), units, sigma, dimensions)
    sums = units.select("code", "z", "y", "x").join(moved_sums, ["z", "y", "x"])
    target = sums.select("code", F.transform("s", lambda x: x / F.greatest(F.col("n"), F.lit(1e-12))).alias("t"))
    moved = F.when(F.col("t").isNull(), F.col("w")).otherwise(F.zip_with("w", "t", lambda a, b: a + (b - a) * mix))
    return units.join(target, "code", "left").select("code", "z", "y", "x", moved.alias("w"))


def fit(rows: DataFrame, key: str, vector: str, units: DataFrame, dimensions: int, epochs: int = 4, start: float = 2.0, end: float = 0.5) -> DataFrame:
    """Units after ``epochs`` batch steps with a width that falls geometrically; each epoch is written to the checkpoint folder."""
    units = checkpointed(units)
    for epoch in range(epochs):
        sigma = start * (end / start) ** (epoch / max(epochs - 1, 1))
        units = checkpointed(batch_step(rows, key, vector, units, sigma, dimensions))
    return units


def revived(rows: DataFrame, key: str, vector: str, units: DataFrame, seed: int = 0) -> DataFrame:
    """Units in which those without hits take the vectors of seeded rows."""
    best = nearest(rows, key, vector, units, "code", "w")
    dead = units.join(best.select("code").distinct(), "code", "left_anti").select("code")
    one = F.lit(0).alias("_g")
    wanted = with_position(dead.select("code", one), "_g", [F.col("code").asc()], "_p")
    draw = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    donors = top_positions(rows.filter(F.col(vector).isNotNull()).select(key, vector, draw.alias("_d"), one), "_g", [F.col("_d").asc(), F.col(key).asc()], max(units.count(), 1), "_p")
    fresh = wanted.join(donors.select("_p", F.col(vector).cast("array<double>").alias("fresh")), "_p").select("code", "fresh")
    return units.join(fresh, "code", "left").withColumn("w", F.coalesce("fresh", "w")).drop("fresh")


def unit_communities(units: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(code, community): k-means of the units' weights, communities numbered from 0 by their smallest code."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from .ordered import first_seen_labels

    rows = units.select("code", array_to_vector(F.col("w").cast("array<double>")).alias("features"))
    said = KMeans(k=k, seed=seed, maxIter=50).fit(rows).transform(rows).select("code", "prediction", F.lit(0).alias("_g"))
    names = first_seen_labels(said, ["_g"], "prediction", "code")
    return said.join(names, ["_g", "prediction"]).select("code", F.col("canonical").alias("community"))


def sparse_codes(rows: DataFrame, key: str, vector: str, weights, bias, k: int) -> DataFrame:
    """(key, feature, activation): the ``k`` largest positive outputs of relu((x - bias) W'), W being features by dimensions."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, bias))

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        w, b = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(n, -1)
            out = np.maximum((x - b) @ w.T, 0)
            top = np.argsort(-out, axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(out, top, axis=1)
            row, place = np.nonzero(value > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(top[row, place].astype("int64")), pa.array(value[row, place])], names=[key, "feature", "activation"])

    usable = spread(rows.filter(F.col(vector).isNotNull()).select(key, vector))
    return usable.mapInArrow(encode, f"{key} {dict(rows.dtypes)[key]}, feature bigint, activation double")


__all__ = ["batch_step", "dimension_means", "fit", "revived", "sparse_codes", "unit_communities"]
