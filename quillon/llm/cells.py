"""Vectors and the cells of a partition tree over them, shared by problems 1 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread

DIMENSIONS = 64
#: Rows, at most, from which trees and codebooks are fitted: a sample by a hash of the id.
FIT_ROWS = 32_768


def usable_vectors(df: DataFrame, key: str, vector: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, v, h1, h2): unit vectors as array<float> of the usable rows, with a 128-bit hash of the vector.

    Null, wrongly sized, not finite and zero vectors and rows without an id are left out.
    """

    def clean(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            good = pc.and_(pc.equal(pc.list_value_length(batch.column(1)), dimensions), batch.column(0).is_valid())
            batch = batch.filter(pc.fill_null(good, False))
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dimensions)
            most = np.abs(flat).max(axis=1)
            fine = np.isfinite(flat).all(axis=1) & (most > 0)
            if not fine.any():
                continue
            flat = flat[fine] / most[fine][:, None]  # no overflow or underflow of the square
            unit = (flat / np.linalg.norm(flat, axis=1)[:, None]).astype("float32")
            marks = np.frombuffer(b"".join(hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in unit), "int64").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(fine)).cast(pa.int64()), as_lists(unit), pa.array(marks[:, 0]), pa.array(marks[:, 1])],
                names=["id", "v", "h1", "h2"],
            )

    return spread(df.select(key, vector)).mapInArrow(clean, "id bigint, v array<float>, h1 bigint, h2 bigint")


def as_lists(rows):
    import numpy as np
    import pyarrow as pa

    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="int32") * width), pa.array(rows.astype("float32").ravel()))


def as_rows(column):
    import numpy as np

    n = len(column)
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, DIMENSIONS), "float32")


def first_copies(vectors: DataFrame, most: int) -> DataFrame:
    """Of each set of equal vectors the ``most`` smallest ids, each once.

    The limit is applied before the exchange too, so a set of copies of any size sends few rows.
    """
    placed = vectors.withColumn("copy", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("id")))
    return placed.filter(F.col("copy") <= most).dropDuplicates(["h1", "h2", "id"])


def sample(vectors: DataFrame, rows: int, most: int = FIT_ROWS):
    """Different unit vectors of at most about ``most`` rows, chosen by a hash of the id, as a numpy array."""
    import numpy as np

    share = min(1.0, most / max(rows, 1))
    chosen = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("v").toArrow()
    found = as_rows(chosen.column(0))
    return np.unique(found, axis=0) if len(found) else found


def split_cells(points, largest: int, seed: int = 7):
    """Centres of a tree of two-means splits, split until no leaf has more than ``largest`` of the points."""
    import numpy as np

    rng = np.random.default_rng(seed)
    centres, open_ = [], [np.arange(len(points))]
    while open_:
        own = open_.pop()
        x = points[own]
        if len(own) <= largest or len(own) < 4:
            centres.append(x.mean(axis=0))
            continue
        a, b = x[rng.choice(len(own), 2, replace=False)]
        for _ in range(6):
            near = x @ (a - b) > 0
            if near.all() or not near.any():
                break
            a, b = x[near].mean(axis=0), x[~near].mean(axis=0)
            a, b = a / max(np.linalg.norm(a), 1e-9), b / max(np.linalg.norm(b), 1e-9)
        side = x @ (a - b)
        near = side > 0
        if min(near.sum(), (~near).sum()) < len(own) // 8:
            near = side > np.median(side)  # keeps the tree balanced where one side is all but empty
        if near.all() or not near.any():
            near = np.arange(len(own)) % 2 == 0
        open_ += [own[near], own[~near]]
    found = np.array(centres, "float32")
    return found / np.maximum(np.linalg.norm(found, axis=1), 1e-9)[:, None]


def nearest_cells(points, centres, probes: int, margin: float):
    """(row, cell, home): for each point its nearest cell, and of the next up to ``probes`` those within ``margin``."""
    import numpy as np

    close = points @ centres.T
    probes = min(probes, len(centres))
    top = np.argpartition(-close, probes - 1, axis=1)[:, :probes] if probes < len(centres) else np.tile(np.arange(len(centres)), (len(points), 1))
    value = np.take_along_axis(close, top, axis=1)
    order = np.argsort(-value, axis=1, kind="stable")
    top, value = np.take_along_axis(top, order, axis=1), np.take_along_axis(value, order, axis=1)
    kept = value >= value[:, :1] - margin
    kept[:, 0] = True
    row, place = np.nonzero(kept)
    return row, top[row, place], place == 0
