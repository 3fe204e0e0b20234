"""Nearest-neighbour operators on dense vectors, as Arrow matrix products against a bounded side."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .positions import cores

#: Rows of the side that is sent to every task, at most; more are worked off in blocks of this size.
BLOCK_ROWS = 8192


def spread(df: DataFrame) -> DataFrame:
    """Give an input of fewer partitions than cores as many as there are cores."""
    wanted = cores(df.sparkSession)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def finite_rows(batch, dimensions: int):
    """(keys, matrix) of the rows of an Arrow batch (key, vector) whose vector has ``dimensions`` finite values; others are left out."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    good = pc.and_(pc.equal(pc.list_value_length(batch.column(1)), dimensions), batch.column(0).is_valid())
    batch = batch.filter(pc.fill_null(good, False))
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dimensions)  # a null becomes NaN
    fine = np.isfinite(x).all(axis=1)
    return batch.column(0).filter(pa.array(fine)), x[fine]


def codebook_blocks(codebook: DataFrame, key: str, vector: str):
    """Blocks (ids, matrix) of at most BLOCK_ROWS rows, by ascending id, streamed through the driver one at a time."""
    import numpy as np

    ids, rows = [], []
    d = None
    for r in codebook.select(key, vector).filter(F.col(key).isNotNull()).orderBy(key).toLocalIterator():
        if r[1] is None or any(x is None or not math.isfinite(x) for x in r[1]):
            continue
        if d is None:
            d = len(r[1])
        if len(r[1]) != d or not d:
            raise ValueError(f"vectors of {len(r[1])} and {d} values on the bounded side; all must have the same number, and one at least")
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == BLOCK_ROWS:
            yield np.array(ids), np.array(rows, "float64")
            ids, rows = [], []
    if ids:
        yield np.array(ids), np.array(rows, "float64")


def nearest(df: DataFrame, key: str, vector: str, codebook: DataFrame, code_key: str, code_vector: str, k: int | None = 1) -> DataFrame:
    """(key, code, d2, place): the ``k`` nearest codebook vectors of every row, all of them for None; ties go to the smaller code.

    Rows whose vector is null, has another number of values than the codebook's, or one that is null or not finite
    have none, nor do rows without a key; such codebook vectors are left out.
    """
    spark, found = df.sparkSession, None
    usable = spread(df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, vector))
    for ids, matrix in codebook_blocks(codebook, code_key, code_vector):
        shared = spark.sparkContext.broadcast((ids, matrix))

        def measure(batches, shared=shared):
            import numpy as np
            import pyarrow as pa

            codes, book = shared.value
            squares = (book**2).sum(axis=1)
            width = min(k or len(codes), len(codes))
            for batch in batches:
                names, x = finite_rows(batch, book.shape[1])
                if not len(x):
                    continue
                d2 = np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ book.T + squares[None, :], 0)
                best = np.argsort(d2, axis=1, kind="stable")[:, :width]
                value = np.take_along_axis(d2, best, axis=1)
                place = np.repeat(np.arange(len(x)), width)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(place)), pa.array(codes[best.ravel()].astype("int64")), pa.array(value.ravel())], names=[key, "code", "d2"]
                )

        part = usable.mapInArrow(measure, f"{key} {dict(df.dtypes)[key]}, code bigint, d2 double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"{key} {dict(df.dtypes)[key]}, code bigint, d2 double, place int")
    order = Window.partitionBy(key).orderBy("d2", "code")
    placed = found.withColumn("place", F.row_number().over(order))
    return placed if k is None else placed.filter(F.col("place") <= k)


def nearest_sums(df: DataFrame, key: str, vector: str, codebook: DataFrame, code_key: str, code_vector: str) -> DataFrame | None:
    """(code, n, s): count and sum of the vectors whose nearest codebook vector is ``code``, as in ``nearest``; each task
    adds its rows up before anything is sent.  None for a codebook of more than BLOCK_ROWS."""
    blocks = codebook_blocks(codebook, code_key, code_vector)
    block = next(blocks, None)
    if block is None or next(blocks, None) is not None:
        return None
    shared = df.sparkSession.sparkContext.broadcast(block)

    def add(batches):
        import numpy as np
        import pyarrow as pa

        codes, book = shared.value
        squares, total, count = (book**2).sum(axis=1), np.zeros(book.shape), np.zeros(len(codes), "int64")
        for batch in batches:
            _, x = finite_rows(batch, book.shape[1])
            if len(x):
                d2 = np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ book.T + squares[None, :], 0)
                best = d2.argmin(axis=1)
                np.add.at(total, best, x)
                count += np.bincount(best, minlength=len(codes))
        hit = np.flatnonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 1, dtype="int32") * book.shape[1]), pa.array(total[hit].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(codes[hit].astype("int64")), pa.array(count[hit]), lists], names=["code", "n", "s"])

    def merge(rows):
        import numpy as np
        import pyarrow as pa

        s = rows.column("s").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).sum(axis=0)
        whole = pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.array(s))
        return pa.table({"code": rows.column("code").slice(0, 1), "n": pa.array([np.sum(rows.column("n").to_numpy())], pa.int64()), "s": whole})

    usable = spread(df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, vector))
    kind = "code bigint, n bigint, s array<double>"
    return usable.mapInArrow(add, kind).groupBy("code").applyInArrow(merge, kind)


def cosine_neighbours(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, neighbour, s, place): the ``k`` most cosine-similar rows of ``base``, itself left out.

    The queries go out in blocks; each task keeps ``k`` of its rows per query. Similarities are rounded to nine
    places, ties go to the smaller id; vectors of zero, null, of another length or with a value that is null or not
    finite take no part.
    """
    spark, found = base.sparkSession, None
    usable = spread(base.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, vector))
    for ids, matrix in codebook_blocks(queries.filter(F.col(vector).isNotNull()), key, vector):
        shared = spark.sparkContext.broadcast((ids, matrix))

        def measure(batches, shared=shared):
            import numpy as np
            import pyarrow as pa

            asking, asked = shared.value
            length = np.linalg.norm(asked, axis=1)
            asking, asked = asking[length > 0], asked[length > 0] / length[length > 0][:, None]
            for batch in batches:
                names, x = finite_rows(batch, asked.shape[1])
                if not len(x) or not len(asking):
                    continue
                names = names.to_numpy()
                own = np.linalg.norm(x, axis=1)
                names, x = names[own > 0], x[own > 0] / own[own > 0][:, None]
                order = np.argsort(names, kind="stable")
                names, x = names[order], x[order]
                s = np.round(asked @ x.T, 9)
                s[asking[:, None] == names[None, :]] = -9
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(s, best, axis=1)
                row, col = np.nonzero(value > -8)
                yield pa.RecordBatch.from_arrays([pa.array(asking[row].astype("int64")), pa.array(names[best[row, col]].astype("int64")), pa.array(value[row, col])], names=["query", "neighbour", "s"])

        part = usable.mapInArrow(measure, "query bigint, neighbour bigint, s double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query bigint, neighbour bigint, s double, place int")
    order = Window.partitionBy("query").orderBy(F.col("s").desc(), F.col("neighbour").asc())
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def vote(neighbours: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(query, predicted): the most frequent label among the neighbours; ties go to the smallest label."""
    named = neighbours.join(labels.select(F.col(key).alias("neighbour"), F.col(label).alias("label")), "neighbour")
    counted = named.groupBy("query", "label").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("query").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("predicted"))


def whole_vectors(df: DataFrame, vector: str, dimensions: int) -> DataFrame:
    """The rows whose vector has ``dimensions`` values, all of them finite."""
    v = F.col(vector)
    return df.filter((F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def vector_sums(df: DataFrame, group: list[str], vector: str) -> DataFrame:
    """(group, n, s array<double>): count and sum of whole vectors of each group, added up before they are sent."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    whole = df.select(*group, array_to_vector(F.col(vector).cast("array<double>")).alias("_vector"))
    total = whole.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), Summarizer.sum(F.col("_vector")).alias("_sum"))
    return total.select(*group, "n", vector_to_array("_sum").alias("s"))


def dimension_means(df: DataFrame, group: str, vector: str, dimensions: int) -> DataFrame:
    """(group, centre array<double>): the mean of the whole, finite vectors of each group."""
    sums = vector_sums(whole_vectors(df, vector, dimensions), [group], vector)
    return sums.select(group, F.transform("s", lambda x: x / F.col("n")).alias("centre"))


def pair_contrast(rows: DataFrame, key: str, first: str, second: str, temperature: float) -> DataFrame:
    """(key, view, loss) of a batch of paired views: cross-entropy of each view's pair among all others of the batch.

    A batch is one set of stated rows; its normalized views go out in blocks of BLOCK_ROWS, and each task sums the
    exponentials of its rows against them, so no pair is a row.  Vectors that are null, zero or not finite are left out.
    """
    both = rows.select(F.col(key).alias("_k"), F.posexplode(F.array(first, second)).alias("view", "_v"))
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    unit = both.withColumn("_l", length).filter((F.col("_l") > 0) & (F.col("_l") < float("inf")))
    unit = unit.select((F.col("_k") * 2 + F.col("view")).alias("id"), F.transform("_v", lambda x: x / F.col("_l")).alias("v"))
    base, parts = spread(unit), None
    for ids, matrix in codebook_blocks(unit, "id", "v"):
        shared = rows.sparkSession.sparkContext.broadcast((ids, matrix))

        def measure(batches, shared=shared):
            import numpy as np
            import pyarrow as pa

            names, book = shared.value
            for batch in batches:
                own, x = finite_rows(batch, book.shape[1])
                if not len(x):
                    continue
                mine = own.to_numpy()
                s = x @ book.T / temperature
                other, pair = names[None, :] != mine[:, None], names[None, :] == (mine ^ 1)[:, None]
                yield pa.RecordBatch.from_arrays([own, pa.array((np.exp(s) * other).sum(axis=1)), pa.array((s * pair).sum(axis=1)), pa.array(pair.any(axis=1))], names=["id", "t", "p", "met"])

        part = base.mapInArrow(measure, "id bigint, t double, p double, met boolean")
        parts = part if parts is None else parts.unionByName(part)
    kind = dict(rows.dtypes)[key]
    if parts is None:
        return rows.sparkSession.createDataFrame([], f"{key} {kind}, view int, loss double")
    total = parts.groupBy("id").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.bool_or("met").alias("met")).filter("met")
    return total.select(F.floor(F.col("id") / 2).cast(kind).alias(key), (F.col("id") % 2).cast("int").alias("view"), (F.log("t") - F.col("p")).alias("loss"))
