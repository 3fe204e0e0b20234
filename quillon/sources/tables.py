"""Readers of the published layouts: listings, annotation lists, attribute matrices, packs, bundles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: suffixes of files that are images.
IMAGES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")

EXEMPLAR = T.StructType().add("image_id", "string").add("token_idx", "integer").add("activation", "double").add("class_label", "integer")
MANIFEST = (
    T.StructType()
    .add("pack_version", "string")
    .add("model", T.StructType().add("arch", "string").add("num_layers", "integer").add("num_heads", "integer"))
    .add("image", T.StructType().add("id", "string").add("width", "integer").add("height", "integer"))
    .add("prediction", T.StructType().add("label", "string").add("class_index", "integer").add("confidence", "double"))
    .add("assets", T.MapType(T.StringType(), T.StructType().add("dtype", "string").add("shape", T.ArrayType(T.IntegerType())).add("encoding", "string").add("bytes", "long")))
)


def _files(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    """(path, name, suffix, parent) of the images under ``root``; contents are never read, as no plan selects them."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path")
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    out = listed.select("path", name.alias("name"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("suffix"), F.try_element_at(parts, F.lit(-2)).alias("parent"))
    return out.filter(F.col("suffix").isin(*IMAGES))


def folder_per_class(spark: SparkSession, root: str) -> DataFrame:
    """(path, class) of ``root/<class>/*``."""
    return _files(spark, root, True).select("path", F.col("parent").alias("class"))


def single_folder(spark: SparkSession, root: str) -> DataFrame:
    """(path, stem) of the images directly in ``root``."""
    return _files(spark, root, False).select("path", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"))


def presplit_folders(spark: SparkSession, root: str) -> DataFrame:
    """(path, class, split) of ``root/<split>/<class>/*``; splits by their usual names in any case."""
    part = F.lower(F.try_element_at(F.split("path", "/"), F.lit(-3)))
    split = F.when(part.isin("train", "training"), "train").when(part.isin("val", "valid", "validation"), "val").when(part.isin("test", "testing"), "test")
    return folder_per_class(spark, root).withColumn("split", split).filter(F.col("split").isNotNull())


def image_index(files: DataFrame) -> DataFrame:
    """(stem, path): the first path of each stem."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.groupBy(stem.alias("stem")).agg(F.min("path").alias("path"))


def annotation_list(spark: SparkSession, path: str) -> DataFrame:
    """(name): first token of each line that is neither blank nor a comment."""
    line = F.trim("value")
    return spark.read.text(path).filter((line != "") & ~line.startswith("#")).select(F.element_at(F.split(line, r"\s+"), 1).alias("name"))


def indexed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, value) of lines ``<id> <value ...>``; files are joined by id, never by place."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).filter(F.size(parts) == 2).select(parts[0].cast("bigint").alias("id"), parts[1].alias("value"))


def attribute_rows(spark: SparkSession, path: str) -> DataFrame:
    """(image, attribute, present) of long attribute lines; lines of fewer than three fields are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    long = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") >= 3)
    return long.select(F.col("p")[0].try_cast("bigint").alias("image"), F.col("p")[1].try_cast("int").alias("attribute"), (F.col("p")[2].try_cast("int") == 1).cast("int").alias("present"))


def number_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(values array<double>) of lines of numbers."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("double")).alias("values"))


def csv_rows(spark: SparkSession, path: str, needed: list[str] = ()) -> DataFrame:
    """Header CSV with every column as text; a needed column that is absent is named in the error."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    for name in needed:
        if name not in rows.columns:
            raise ValueError(f"column {name!r} is not in {path}; it has {', '.join(rows.columns)}")
    return rows


def one_hot_labels(rows: DataFrame, key: str, classes: list[str]) -> DataFrame:
    """(key, label): the class of the largest one-hot value; bad numbers are 0, rows without a positive one are dropped."""
    values = F.array(*[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in classes])
    names = F.array(*[F.lit(c) for c in classes])
    return rows.filter(F.array_max(values) > 0).select(key, F.element_at(names, F.array_position(values, F.array_max(values)).cast("int")).alias("label"))


def resolved(rows: DataFrame, name: str, folders: list[DataFrame]) -> DataFrame:
    """Rows with the path of their image in the first of ``folders`` (stem, path) that has it; others are dropped."""
    found = None
    for place, folder in enumerate(folders):
        part = folder.select(F.col("stem").alias(name), "path", F.lit(place).alias("_place"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy(name).agg(F.min_by("path", F.struct("_place", "path")).alias("path"))
    return rows.join(best, name)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Pack manifests under an explicit schema; a malformed document fails the read. Adds ``violations``."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.withColumn("violations", manifest_violations())


# Element types of assets and the bytes of each.
ELEMENT_BYTES = {"uint8": 1, "int8": 1, "float16": 2, "uint16": 2, "int16": 2, "float32": 4, "int32": 4, "float64": 8, "int64": 8}


def _whole_asset(asset):
    """Whether an asset has a known type and a shape, and its bytes are those of its shape where it is stored raw."""
    width = F.element_at(F.create_map(*[F.lit(x) for pair in ELEMENT_BYTES.items() for x in pair]), asset["dtype"])
    size = F.aggregate(asset["shape"], F.lit(1).cast("bigint"), lambda n, x: n * x) * width
    known = asset["dtype"].isin(*ELEMENT_BYTES) & F.coalesce(F.forall(asset["shape"], lambda x: x > 0), F.lit(False))
    return F.when(known, F.coalesce((asset["encoding"] != "raw") | (asset["bytes"] == size), F.lit(False))).otherwise(F.lit(False))


def manifest_violations():
    """Names of the fields that break the manifest's rules, as array<string>."""
    rules = {
        "pack_version": F.coalesce(~F.col("pack_version").rlike(r"^\d+\.\d+\.\d+$"), F.lit(True)),
        "model.num_layers": F.coalesce(F.col("model.num_layers") <= 0, F.lit(True)),
        "model.num_heads": F.coalesce(F.col("model.num_heads") <= 0, F.lit(True)),
        "image.width": F.coalesce(F.col("image.width") <= 0, F.lit(True)),
        "image.height": F.coalesce(F.col("image.height") <= 0, F.lit(True)),
        "prediction.class_index": F.coalesce(F.col("prediction.class_index") < 0, F.lit(True)),
        "prediction.confidence": F.coalesce(~F.col("prediction.confidence").between(0, 1), F.lit(True)),
        "assets": F.coalesce(~F.forall(F.map_values("assets"), _whole_asset), F.lit(False)),  # a pack may have none
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def raw_arrays(spark: SparkSession, path: str, dtype: str, width: int) -> DataFrame:
    """(path, row, values array<float>) of C-order binary assets of ``width`` columns, decoded in Arrow batches."""

    def decode(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                grid = np.frombuffer(content, dtype).reshape(-1, width).astype("float32")
                yield pd.DataFrame({"path": name, "row": range(len(grid)), "values": list(grid)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, "path string, row bigint, values array<float>")


def byte_range(files: DataFrame, start: int, end: int) -> DataFrame:
    """(path, part): bytes [start, end) of each file."""
    return files.select("path", F.substring("content", start + 1, end - start).alias("part"))


class Metadata:
    """The four metadata reads over JSON documents below a folder, in the absence of a service: datasets, models, gallery, dictionaries."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return self.spark.read.json(f"{self.root}/{name}")

    def datasets(self) -> DataFrame:
        """Datasets with the first of their models, null where there is none, by name."""
        first = self.table("models").groupBy(F.col("dataset_id").alias("id")).agg(F.min("arch").alias("arch"))
        return self.table("datasets").join(first, "id", "left").orderBy("name")

    def matching(self, name: str, **equal) -> DataFrame:
        """The rows of a table that have all the values given."""
        rows = self.table(name)
        for column, value in equal.items():
            rows = rows.filter(F.col(column) == F.lit(value))
        return rows

    def gallery(self, dataset: str) -> DataFrame:
        return self.matching("gallery", dataset_id=dataset).orderBy("id")

    def dictionary(self, model: str, layer: int) -> DataFrame:
        """The one dictionary of a model and layer, of several that of the smallest id; no row where there is none."""
        return self.matching("dictionaries", model_id=model, layer=layer).orderBy("id").limit(1)


def shapes(spark: SparkSession, items: int, side: int, seed: int = 0) -> DataFrame:
    """(item, label, seed, pixels): grey images of discs, squares and crosses, drawn in Arrow batches.

    The class goes round by item; place and size follow from the seed of the item by a seeded generator, so an image is
    the same in every run and on every executor.
    """
    from ..functions.random import sequence_of

    def draw(batches):
        import numpy as np
        import pyarrow as pa

        y, x = np.mgrid[0:side, 0:side]
        for batch in batches:
            own, labels, seeds, out = batch.column(0).to_pylist(), [], [], []
            for item in own:
                a, b, c = sequence_of(seed * 1_000_003 + item, 3)
                dy, dx, r = np.abs(y - side * (0.35 + 0.3 * a)), np.abs(x - side * (0.35 + 0.3 * b)), side * (0.12 + 0.15 * c)
                shape = (dy**2 + dx**2 <= r**2, np.maximum(dy, dx) <= r, (np.minimum(dy, dx) <= r / 3) & (np.maximum(dy, dx) <= r))[item % 3]
                labels.append(item % 3)
                seeds.append(seed * 1_000_003 + item)
                out.append((shape * 255).astype("uint8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.int32()), pa.array(seeds, pa.int64()), pa.array(out, pa.binary())], names=["item", "label", "seed", "pixels"])

    return spark.range(items).select(F.col("id").alias("item")).mapInArrow(draw, "item bigint, label int, seed bigint, pixels binary")


READERS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    """Decorator that files a reader under a name; empty and taken names are refused."""

    def keep(reader: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        key = name.strip().lower()
        if not key or key in READERS:
            raise ValueError(f"reader name {name!r} is empty or taken")
        if not callable(reader):
            raise TypeError(f"reader {name!r} is not callable")
        READERS[key] = reader
        return reader

    return keep


def items(spark: SparkSession, loader: str, **arguments) -> DataFrame:
    """The items (source, label, group) of a dataset by the name of its loader: csv, imagefolder or shapes."""
    if loader == "csv":
        rows = csv_rows(spark, arguments["path"], [c for c in (arguments["path_column"], arguments.get("label_column"), arguments.get("group_column")) if c])
        column = lambda name: F.col(name) if name else F.lit(None).cast("string")
        return rows.select(F.col(arguments["path_column"]).alias("source"), column(arguments.get("label_column")).alias("label"), column(arguments.get("group_column")).alias("group"))
    if loader == "imagefolder":
        return folder_per_class(spark, arguments["path"]).select(F.col("path").alias("source"), F.col("class").alias("label"), F.lit(None).cast("string").alias("group"))
    if loader == "shapes":
        made = shapes(spark, arguments["items"], arguments["side"], arguments.get("seed", 0))
        return made.select(F.col("item").cast("string").alias("source"), F.col("label").cast("string").alias("label"), F.lit(None).cast("string").alias("group"))
    raise KeyError(f"no loader {loader!r}; there are csv, imagefolder, shapes")


def reader(name: str) -> Callable[..., DataFrame]:
    key = name.strip().lower()
    if key not in READERS:
        raise KeyError(f"no reader {name!r}; there are {', '.join(sorted(READERS))}")
    return READERS[key]


for _name, _reader in (("folders", folder_per_class), ("folder", single_folder), ("presplit", presplit_folders), ("csv", csv_rows), ("list", annotation_list), ("manifest", manifests), ("shapes", shapes)):
    register(_name)(_reader)
