"""Writers: arrays, documents, manifests as commits, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.positions import checkpointed


def write_rows(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_quantized(df: DataFrame, vector: str, path: str) -> None:
    """The vectors as 0..255 of the row's maximum with that maximum as scale."""
    z = V.quantized(F.col(vector))
    df.withColumn("_z", z).select(*[c for c in df.columns if c != vector], F.col("_z.q").alias("q"), F.col("_z.scale").alias("scale")).write.mode("overwrite").parquet(path)


def read_quantized(spark, path: str, vector: str) -> DataFrame:
    stored = spark.read.parquet(path)
    return stored.select(*[c for c in stored.columns if c not in ("q", "scale")], V.dequantized(F.col("q"), F.col("scale")).alias(vector))


def write_documents(df: DataFrame, path: str) -> None:
    """One compact JSON document per row, fields in sorted order."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)


def commit_pack(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write every table of a pack, then its manifest (asset, rows, columns) last: a pack without a manifest is not there."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in sorted(tables.items()):
        write_rows(df, f"{path}/{name}")
        rows.append((name, spark.read.parquet(f"{path}/{name}").count(), ",".join(df.columns)))
    manifest = spark.createDataFrame(rows, "asset string, rows bigint, columns string")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest_table")
    return manifest


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Old rows without those whose key comes anew, and the new ones; of new rows of one key the last by ``order``."""
    if order:
        new = new.groupBy(*key).agg(F.max_by(F.struct(*new.columns), order).alias("_r")).select("_r.*")
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def write_blobs(rows: DataFrame, path: str, content: str, root: str) -> DataFrame:
    """Write each row's bytes to the file ``root/<path>`` and return (path, bytes) of what was written, in Arrow batches.

    A file is written under another name and renamed, so a task that is run again leaves no half of one.  Rows without a
    path or content are left out; paths must be relative and stay below ``root``.
    """
    safe = F.col(path).isNotNull() & F.col(content).isNotNull() & ~F.col(path).rlike(r"^/|(^|/)\.\.(/|$)")

    def write(batches):
        import posixpath

        import pyarrow as pa
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            names, sizes = [], []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = posixpath.join(base, name)
                files.create_dir(posixpath.dirname(target), recursive=True)
                with files.open_output_stream(f"{posixpath.dirname(target)}/.{posixpath.basename(target)}.part") as out:
                    out.write(body)
                files.move(f"{posixpath.dirname(target)}/.{posixpath.basename(target)}.part", target)
                names.append(name)
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    bodies = rows.filter(safe).select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content"))
    return checkpointed(bodies.mapInArrow(write, "path string, bytes bigint"))


def packed_arrays(rows: DataFrame, group: str, order: str, vector: str, dtype: str) -> DataFrame:
    """(group, content, n): the vectors of each group as one C-order binary array of a numpy type, rows by ``order``."""
    kind = dict(rows.dtypes)[group]

    def pack(one):
        import numpy as np
        import pandas as pd

        grid = np.stack(one.sort_values(order)[vector].to_list()).astype(dtype)
        return pd.DataFrame({group: [one[group].iloc[0]], "content": [grid.tobytes()], "n": [len(grid)]})

    return rows.filter(F.col(group).isNotNull() & F.col(vector).isNotNull()).groupBy(group).applyInPandas(pack, f"{group} {kind}, content binary, n bigint")


def without_children(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str, gone: DataFrame) -> dict[str, DataFrame]:
    """What a delete that cascades leaves: the parents whose key is not in ``gone``, and of each child table its rows without them."""
    left = {"": parents.join(gone.select(key), key, "left_anti")}
    for name, (rows, column) in children.items():
        left[name] = rows.join(gone.select(F.col(key).alias(column)), column, "left_anti")
    return left


#: Writers by format name; each takes (table, path).
STORAGE = {
    "parquet": lambda df, path: df.write.mode("overwrite").parquet(path),
    "json": lambda df, path: df.write.mode("overwrite").json(path),
    "csv": lambda df, path: df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path),
    "documents": write_documents,
}


def storage(kind: str | None = None, root: str | None = None, settings: dict[str, str] | None = None):
    """A function (table, name) that writes below a root.  Arguments come before ``settings`` (storage.kind, storage.root), these before parquet."""
    settings = settings or {}
    kind = (kind or settings.get("storage.kind") or "parquet").lower()
    root = root or settings.get("storage.root")
    if kind not in STORAGE:
        raise ValueError(f"no storage {kind!r}; there are {', '.join(sorted(STORAGE))}")
    if not root:
        raise ValueError("storage.root: names no folder")

    def put(df: DataFrame, name: str) -> str:
        STORAGE[kind](df, f"{root.rstrip('/')}/{name}")
        return f"{root.rstrip('/')}/{name}"

    return put
