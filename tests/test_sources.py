import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import config
from quillon.sources import sinks, tables


@pytest.fixture
def tree(tmp_path):
    for split in ("train", "Val"):
        for name in ("cat", "dog"):
            folder = tmp_path / "img" / split / name
            folder.mkdir(parents=True)
            for i in range(2):
                (folder / f"{name}_{i}.PNG").write_bytes(b"x")
            (folder / "notes.txt").write_text("x")
    return tmp_path


def test_folder_scans(spark, tree):
    scan = tables.presplit_folders(spark, str(tree / "img"))
    assert {(r["class"], r.split): r["count"] for r in scan.groupBy("class", "split").count().collect()} == {(c, s): 2 for c in ("cat", "dog") for s in ("train", "val")}
    index = tables.image_index(tables.folder_per_class(spark, str(tree / "img")))
    assert index.count() == 4 and all("/Val/" in r.path for r in index.collect())  # first path wins
    assert tables.single_folder(spark, str(tree / "img" / "train" / "cat")).count() == 2


def test_text_scans(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# head\n\ncat_1 1 2\n  dog_2\n")
    assert [r.name for r in tables.annotation_list(spark, str(tmp_path / "list.txt")).collect()] == ["cat_1", "dog_2"]
    (tmp_path / "idx.txt").write_text("1 a b\n2 c\nbad\n")
    assert {(r.id, r.value) for r in tables.indexed_lines(spark, str(tmp_path / "idx.txt")).collect()} == {(1, "a b"), (2, "c")}
    (tmp_path / "att.txt").write_text("1 1 1 3 0.5\n1 2 0\n2 1\n")
    assert {tuple(r) for r in tables.attribute_rows(spark, str(tmp_path / "att.txt")).collect()} == {(1, 1, 1), (1, 2, 0)}
    (tmp_path / "m.txt").write_text("1 2.5\nx 3\n")
    assert [r["values"] for r in tables.number_matrix(spark, str(tmp_path / "m.txt")).collect()] == [[1.0, 2.5], [None, 3.0]]


def test_csv_scans(spark, tmp_path):
    (tmp_path / "t.csv").write_text("image,mel,nv\na,0,1\nb,0,0\nc,x,0.5\n")
    rows = tables.csv_rows(spark, str(tmp_path / "t.csv"), ["image"])
    assert {tuple(r) for r in tables.one_hot_labels(rows, "image", ["mel", "nv"]).collect()} == {("a", "nv"), ("c", "nv")}
    with pytest.raises(ValueError, match="lesion"):
        tables.csv_rows(spark, str(tmp_path / "t.csv"), ["lesion"])
    one = spark.createDataFrame([("a", "p1")], "stem string, path string")
    two = spark.createDataFrame([("a", "p2"), ("c", "p3")], "stem string, path string")
    assert {(r.image, r.path) for r in tables.resolved(rows, "image", [one, two]).collect()} == {("a", "p1"), ("c", "p3")}


def test_manifests(spark, tmp_path):
    good = {"pack_version": "1.0.0", "model": {"arch": "v", "num_layers": 2, "num_heads": 1}, "image": {"id": "i", "width": 4, "height": 4}, "prediction": {"label": "x", "class_index": 0, "confidence": 0.5}, "assets": {"a": {"dtype": "uint8", "shape": [2], "encoding": "raw", "bytes": 2}}}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps(good | {"pack_version": "one", "prediction": {"label": "x", "class_index": 0, "confidence": 7}}))
    (tmp_path / "c.json").write_text(json.dumps(good | {"pack_version": "2.0.0", "assets": {"a": {"dtype": "float16", "shape": [2, 3], "encoding": "raw", "bytes": 6}}}))
    (tmp_path / "d.json").write_text(json.dumps(good | {"pack_version": "3.0.0", "assets": {"a": {"dtype": "float16", "shape": [2, 3], "encoding": "raw", "bytes": 12}, "b": {"dtype": "complex", "shape": [1], "encoding": "raw", "bytes": 1}}}))
    found = {r.pack_version: r.violations for r in tables.manifests(spark, str(tmp_path)).collect()}
    assert found == {"1.0.0": [], "one": ["pack_version", "prediction.confidence"], "2.0.0": ["assets"], "3.0.0": ["assets"]}


def test_binary_assets(spark, tmp_path):
    grid = np.arange(6, dtype="<f2").reshape(3, 2)
    (tmp_path / "a.bin").write_bytes(grid.tobytes())
    got = tables.raw_arrays(spark, str(tmp_path / "a.bin"), "<f2", 2).orderBy("row").collect()
    assert [r["values"] for r in got] == grid.astype(float).tolist()
    part = tables.byte_range(spark.read.format("binaryFile").load(str(tmp_path / "a.bin")), 2, 6).first().part
    assert bytes(part) == grid.tobytes()[2:6]


def test_quantized_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0])], "id bigint, v array<double>")
    sinks.write_quantized(df, "v", str(tmp_path / "q"))
    assert sinks.read_quantized(spark, str(tmp_path / "q"), "v").first().v == pytest.approx([0.0, 1.0, 2.0], abs=0.5 / 255 * 2)


def test_commit_and_documents(spark, tmp_path):
    df = spark.range(3)
    manifest = sinks.commit_pack({"x": df, "y": df.limit(1)}, str(tmp_path / "pack"))
    assert {(r.asset, r.rows) for r in manifest.collect()} == {("x", 3), ("y", 1)}
    sinks.write_documents(df.select(F.col("id").alias("b"), F.lit("z").alias("a")), str(tmp_path / "docs"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "docs")).collect())[0] == '{"a":"z","b":0}'


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k bigint, v string, t int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k bigint, v string, t int")
    assert {tuple(r) for r in sinks.upserted(old, new, ["k"], "t").collect()} == {(1, "a", 0), (2, "d", 2), (3, "e", 1)}


def test_registry():
    assert tables.reader(" CSV ") is tables.csv_rows
    with pytest.raises(KeyError, match="folders"):
        tables.reader("nothing")
    with pytest.raises(ValueError):
        tables.register("csv")(tables.csv_rows)


def test_config_names_the_field():
    made = config.Settings({"loader": "imagefolder", "splits": {"train": 0.5, "val": 0.25, "test": 0.25}})
    assert made.override("splits.seed", 4).splits.seed == 4 and made["splits.train"] == 0.5 and made.image_size == 128
    for bad, name in (({"loader": "tape"}, "loader"), ({"loader": "csv"}, "path_column"), ({"loader": "shapes", "splits": {"train": 0.9}}, "splits"), ({"colour": 1}, "colour"), ({"loader": "shapes", "splits": {"val": 2}}, r"splits\.val"), ({"loader": "shapes", "augmentation": "x"}, "augmentation")):
        with pytest.raises(config.ConfigError, match=name):
            config.Settings(bad)
    with pytest.raises(KeyError, match="nope"):
        made.override("splits.nope", 1)
    assert config.policy("satellite_default")["rot90"] and config.normalization(3) == ((0.5,) * 3, (0.5,) * 3)
    assert config.backend({}) == "document" and config.backend({"metadata.url": "u", "metadata.key": "k"}) == "tables"
