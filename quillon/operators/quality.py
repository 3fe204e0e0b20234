"""Quality of maps, projections and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that the rank-based projection measures take unless told otherwise, as their cost is quadratic by definition.
MANIFOLD_ROWS = 400


def som_quality(two_nearest: DataFrame, units: DataFrame) -> DataFrame:
    """One row: mean distance to the best unit, share whose two best units do not touch (26 neighbours), share of units without hits.

    ``two_nearest``: key, code, d2, place; ``units``: code, z, y, x.
    """
    best = two_nearest.filter("place = 1").select(two_nearest.columns[0], F.col("code").alias("c1"), "d2")
    second = two_nearest.filter("place = 2").select(two_nearest.columns[0], F.col("code").alias("c2"))
    at = lambda name: units.select(F.col("code").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in "zyx"])
    both = best.join(second, two_nearest.columns[0]).join(at("c1"), "c1").join(at("c2"), "c2")
    apart = sum((F.col(f"{c}_c1") - F.col(f"{c}_c2")) * (F.col(f"{c}_c1") - F.col(f"{c}_c2")) for c in "zyx")
    one = both.agg(F.avg(F.sqrt("d2")).alias("quantization_error"), F.avg((apart > 3 + 1e-6).cast("int")).alias("topographic_error"), F.countDistinct("c1").alias("_live"))
    return one.join(units.agg(F.count(F.lit(1)).alias("_units"))).select("quantization_error", "topographic_error", (1 - F.col("_live") / F.col("_units")).alias("dead_fraction"))


def trustworthiness(high: DataFrame, key: str, vector: str, low: str, k: int = 7, rows: int | None = MANIFOLD_ROWS) -> DataFrame:
    """One row (n, trustworthiness, continuity) of a seeded sample of at most ``rows`` rows in one task, or of all for None.

    NaN for fewer than four rows; ``k`` is lowered to (n - 1) / 2.
    """
    if rows is None:
        return _ranked_whole(high, key, vector, low, k)
    chosen = high.select(key, vector, low).orderBy(F.md5(F.col(key).cast("string")), key).limit(rows)

    def measure(rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values(key)
        n = len(rows)
        if n < 4:
            return pd.DataFrame({"n": [n], "trustworthiness": [float("nan")], "continuity": [float("nan")]})
        near = min(k, (n - 1) // 2)

        def ranks(x):
            x = np.stack([np.asarray(v, "float64") for v in x])
            d = np.round(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2), 9)
            np.fill_diagonal(d, -1)
            order = np.argsort(d, axis=1, kind="stable")
            out = np.empty_like(order)
            np.put_along_axis(out, order, np.arange(n)[None, :].repeat(n, 0), axis=1)
            return out

        a, b = ranks(rows[vector]), ranks(rows[low])
        scale = 2.0 / (n * near * (2 * n - 3 * near - 1))
        penalty = lambda of, inside: float((np.where((inside >= 1) & (inside <= near), np.maximum(of - near, 0), 0)).sum())
        return pd.DataFrame({"n": [n], "trustworthiness": [1 - scale * penalty(a, b)], "continuity": [1 - scale * penalty(b, a)]})

    return chosen.groupBy(F.lit(0).alias("_one")).applyInPandas(lambda rows: measure(rows), "n bigint, trustworthiness double, continuity double")


def _squares(x, y):
    """Squared distances rounded to nine places, between all rows of two matrices."""
    import numpy as np

    return np.round(np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ y.T + (y**2).sum(axis=1)[None, :], 0), 9)


def _ranked_whole(high: DataFrame, key: str, vector: str, low: str, k: int) -> DataFrame:
    """Trustworthiness and continuity over all rows.

    First the ``k`` nearest rows of each in both spaces, then for every such pair how many rows are nearer in the other
    space: two passes of blocks of stated rows against all rows, whose results are added up.  Ties go to the smaller key.
    """
    from .dense import BLOCK_ROWS, spread
    from .positions import checkpointed

    spark = high.sparkSession
    table = checkpointed(high.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("h"), F.col(low).cast("array<double>").alias("l")))
    n = table.count()
    if n < 4:
        return spark.createDataFrame([(n, float("nan"), float("nan"))], "n bigint, trustworthiness double, continuity double")
    near, all_rows = min(k, (n - 1) // 2), spread(table)
    parts = max(1, -(-n // BLOCK_ROWS))

    def blocks(df, columns):
        for part in range(parts):
            yield df.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).select(*columns).toPandas()

    def union(made):
        out = None
        for df in made:
            out = df if out is None else out.unionByName(df)
        return out

    def nearest(block):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches):
            import numpy as np
            import pandas as pd

            asked = shared.value
            for batch in batches:
                for space, column in enumerate("hl"):
                    d = _squares(np.stack(asked[column]), np.stack(batch[column]))
                    d[asked["id"].to_numpy()[:, None] == batch["id"].to_numpy()[None, :]] = np.inf
                    order = np.lexsort((np.broadcast_to(batch["id"].to_numpy(), d.shape), d), axis=1)[:, :near]
                    value = np.take_along_axis(d, order, axis=1)
                    row, place = np.nonzero(np.isfinite(value))
                    yield pd.DataFrame({"space": space, "i": asked["id"].to_numpy()[row], "j": batch["id"].to_numpy()[order[row, place]], "d": value[row, place]})

        return all_rows.mapInPandas(scan, "space int, i bigint, j bigint, d double")

    found = union(nearest(b) for b in blocks(table, ["id", "h", "l"]))
    place = F.row_number().over(Window.partitionBy("space", "i").orderBy("d", "j"))
    pairs = checkpointed(found.withColumn("p", place).filter(F.col("p") <= near).select("space", "i", "j"))
    ends = pairs.join(table.select(F.col("id").alias("i"), F.col("h").alias("hi"), F.col("l").alias("li")), "i").join(table.select(F.col("id").alias("j"), F.col("h").alias("hj"), F.col("l").alias("lj")), "j")
    # the rank of a neighbour in the space it was not found in
    other = lambda a, b: F.when(F.col("space") == 1, F.col(a)).otherwise(F.col(b))
    asked = ends.select("space", "i", "j", other("hi", "li").alias("x"), other("hj", "lj").alias("y"))

    def nearer(part):
        shared = spark.sparkContext.broadcast(asked.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == part).toPandas())

        def scan(batches):
            import numpy as np
            import pandas as pd

            block = shared.value
            for batch in batches:
                ids, count = batch["id"].to_numpy(), np.zeros(len(block), "int64")
                for space, column in ((1, "h"), (0, "l")):
                    own = np.flatnonzero(block["space"].to_numpy() == space)
                    for start in range(0, len(own), 2048):
                        some = block.iloc[own[start : start + 2048]]
                        x, y = np.stack(some["x"]), np.stack(some["y"])
                        limit = np.round(np.maximum((x**2).sum(axis=1) - 2 * (x * y).sum(axis=1) + (y**2).sum(axis=1), 0), 9)[:, None]
                        d, j = _squares(x, np.stack(batch[column])), some["j"].to_numpy()[:, None]
                        closer = ((d < limit) | ((d == limit) & (ids[None, :] < j))) & (ids[None, :] != some["i"].to_numpy()[:, None]) & (ids[None, :] != j)
                        count[own[start : start + 2048]] = closer.sum(axis=1)
                yield pd.DataFrame({"space": block["space"], "i": block["i"], "j": block["j"], "c": count})

        return all_rows.mapInPandas(scan, "space int, i bigint, j bigint, c bigint")

    ranks = union(nearer(p) for p in range(parts)).groupBy("space", "i", "j").agg((F.sum("c") + 1).alias("r"))
    scale = 2.0 / (n * near * (2 * n - 3 * near - 1))
    penalty = lambda space: 1 - scale * F.coalesce(F.sum(F.when(F.col("space") == space, F.greatest(F.col("r") - near, F.lit(0)))), F.lit(0))
    return ranks.agg(penalty(1).alias("trustworthiness"), penalty(0).alias("continuity")).select(F.lit(n).cast("bigint").alias("n"), "trustworthiness", "continuity")


def covariance(rows: DataFrame, vector: str, dimensions: int):
    """Sample covariance of the finite vectors, as a numpy matrix: sums of products of each batch, added up."""
    import numpy as np

    def sums(batches):
        import pyarrow as pa

        from .dense import finite_rows

        total = np.zeros((dimensions + 1, dimensions + 1))
        for batch in batches:
            _, x = finite_rows(batch, dimensions)
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            total += x.T @ x
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["at", "s"])

    parts = rows.select(F.lit(0).alias("_k"), vector).mapInArrow(sums, "at bigint, s double").groupBy("at").agg(F.sum("s").alias("s"))
    m = np.zeros((dimensions + 1) ** 2)
    for r in parts.collect():  # one number for each pair of dimensions
        m[r["at"]] = r["s"]
    m = m.reshape(dimensions + 1, dimensions + 1)
    n, mean = m[-1, -1], m[-1, :-1] / max(m[-1, -1], 1)
    return (m[:-1, :-1] - n * np.outer(mean, mean)) / max(n - 1, 1)


def projected_steps(rows: DataFrame, step: str, key: str, vector: str, only: int | None = None) -> DataFrame:
    """(step, key, x, y): two principal components fitted once on the rows of all steps, and each step's rows on them."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    both = rows.select(step, key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="p").fit(both)
    chosen = both if only is None else both.filter(F.col(step) == only)
    place = vector_to_array("p")
    return model.transform(chosen).select(step, key, place[0].alias("x"), place[1].alias("y"))


def _by_components(rows: DataFrame, key: str, vector: str, seed: int) -> DataFrame:
    return projected_steps(rows.withColumn("_step", F.lit(0)), "_step", key, vector).drop("_step")


def _by_directions(rows: DataFrame, key: str, vector: str, seed: int) -> DataFrame:
    """Two seeded directions: sums of the values with signs by a hash of seed, axis and place."""
    sign = lambda axis: F.transform(vector, lambda x, i: x.cast("double") * (1 - 2 * F.pmod(F.xxhash64(F.lit(seed), F.lit(axis), i), F.lit(2))))
    total = lambda axis: F.aggregate(sign(axis), F.lit(0.0), lambda a, x: a + x)
    return rows.select(key, total(0).alias("x"), total(1).alias("y"))


#: Methods of projection by name; those without a function need a library that may be absent.
PROJECTIONS = {"pca": _by_components, "random": _by_directions, "umap": None, "tsne": None}


def projections(rows: DataFrame, key: str, vector: str, methods: list[str], seed: int = 0) -> DataFrame:
    """(method, key, x, y) by each method; one whose library is absent is passed over, an unknown one is an error."""
    strange = [m for m in methods if m not in PROJECTIONS]
    if strange:
        raise ValueError(f"no projection {strange[0]!r}; there are {', '.join(PROJECTIONS)}")
    found = rows.sparkSession.createDataFrame([], f"method string, {key} {dict(rows.dtypes)[key]}, x double, y double")
    for name in methods:
        if PROJECTIONS[name] is not None:
            placed = PROJECTIONS[name](rows.select(key, vector), key, vector, seed)
            found = found.unionByName(placed.select(F.lit(name).alias("method"), key, "x", "y"))
    return found


def radial_spectra(slices: DataFrame, group: list[str], row: str, col: str, value: str, bins: int = 8) -> DataFrame:
    """(group, centroid): power-weighted mean radial frequency of each small grid, by FFT in one task per grid."""
    kinds = dict(slices.dtypes)
    schema = ", ".join(f"{g} {kinds[g]}" for g in group) + ", centroid double"

    def measure(rows):
        import numpy as np
        import pandas as pd

        ys, xs = rows[row].to_numpy("int64"), rows[col].to_numpy("int64")
        grid = np.zeros((ys.max() + 1, xs.max() + 1))
        grid[ys, xs] = np.nan_to_num(rows[value].to_numpy("float64"))
        power = np.abs(np.fft.rfft2(grid - grid.mean())) ** 2
        radius = np.hypot(np.fft.fftfreq(grid.shape[0])[:, None], np.fft.rfftfreq(grid.shape[1])[None, :])
        edges = np.linspace(0, radius.max() + 1e-9, bins + 1)
        place = np.clip(np.digitize(radius.ravel(), edges) - 1, 0, bins - 1)
        per_bin = np.bincount(place, power.ravel(), minlength=bins)
        middle = (edges[:-1] + edges[1:]) / 2
        return pd.DataFrame({**{g: [rows[g].iloc[0]] for g in group}, "centroid": [float((middle * per_bin).sum() / (per_bin.sum() + 1e-9))]})

    return slices.groupBy(*group).applyInPandas(measure, schema)
